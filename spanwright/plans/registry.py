"""Named queries over the driver tables, each with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanwright.plans import display_queries, grid_queries, metric_queries, pose_queries, sampling_queries, score_queries, source_queries, span_queries, text_queries, unit_queries

FLAGSHIP = "edge_match_main_score"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = span_queries.QUERIES | score_queries.QUERIES | metric_queries.QUERIES | text_queries.QUERIES | unit_queries.QUERIES | source_queries.QUERIES | grid_queries.QUERIES | display_queries.QUERIES | pose_queries.QUERIES | sampling_queries.QUERIES
ORACLE_SQL: dict[str, str] = span_queries.ORACLE_SQL | score_queries.ORACLE_SQL | metric_queries.ORACLE_SQL | text_queries.ORACLE_SQL | unit_queries.ORACLE_SQL | source_queries.ORACLE_SQL | grid_queries.ORACLE_SQL | display_queries.ORACLE_SQL | pose_queries.ORACLE_SQL | sampling_queries.ORACLE_SQL
