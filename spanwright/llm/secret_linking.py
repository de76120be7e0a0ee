"""Secret scans with multipart linking: weak candidates count only beside the parts that complete them.

Strong findings (``assign``, ``access``, ``hex``) are reported as they are.  Weak candidates are login names, long mixed tokens
and endpoints, each of them common and harmless alone.  An interval join within a scope looks for the
complementary part: spans of one text less than ``SCOPE`` code points apart.

- ``ident`` (a login or client name given to a key) needs a secret: an assign match or a mixed token;
- ``blob`` (a mixed token of 24 or more characters) needs an identifier: an access match or a login name;
- ``endpoint`` (a URL's scheme and host) needs both an identifier and a secret.

A weak candidate that overlaps a strong finding is left to that finding.

The join asks for each candidate only for the nearest part on either side, by running maxima in the order of the
text, so it is linear in the number of parts even where a text has thousands.

Defined results: a null text is empty.  Repeated rows give equal results.  Rows with a null doc_id are scanned like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.llm.common import written
from spanwright.llm.native import match_spans

#: The kinds in the order in which equal starts are listed.
KINDS = ["assign", "access", "hex", "ident", "blob", "endpoint"]
N_STRONG = 3
SCOPE = 400
#: The patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}+"
IDENT = r"""(?i:(username|user_?id|login|client_?id|account_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)"""
BLOB = r"[A-Za-z0-9+/]{24,}+"
MIXED = r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(:[0-9]+)?"


def _strong(text: Column) -> Column:
    # A run of hex digits or of key characters that is too short holds no longer match, so these two may ask
    # for the length at once; an assignment that is too short does consume what another could start in.
    return F.concat(
        match_spans(text, ASSIGN, 0, group=2, least=8), match_spans(text, ACCESS, 1), match_spans(text, HEX, 2)
    )


def _weak(text: Column) -> Column:
    return F.concat(
        match_spans(text, IDENT, 3, group=2, least=4), match_spans(text, BLOB, 4, also=MIXED), match_spans(text, ENDPOINT, 5)
    )


def scan_parts(documents: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and the strong and weak spans of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", F.xxhash64(text, F.length(text)).alias("text_key"), _strong(text).alias("strong"), _weak(text).alias("weak"))


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans that find their complement, as ``linked`` for each (doc_id, text_key)."""
    spread = parts.where((F.size("weak") > 0) & (F.size("weak") + F.size("strong") > 1)).select(
        "doc_id", "text_key", F.explode(F.concat("strong", "weak")).alias("span")
    )
    spread = spread.select("doc_id", "text_key", "span.start", "span.end", "span.kind")
    ahead = Window.partitionBy("doc_id", "text_key").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = (
        Window.partitionBy("doc_id", "text_key")
        .orderBy(F.desc("start"), F.desc("end"), F.desc("kind"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    classes = {"identifier": [1, 3], "secret": [0, 4], "strong": [0, 1, 2]}
    for name, kinds in classes.items():
        inside = F.col("kind").isin(kinds)
        spread = spread.withColumns(
            {
                f"{name}_before": F.max(F.when(inside, F.col("end"))).over(ahead),
                f"{name}_after": F.min(F.when(inside, F.col("start"))).over(behind),
            }
        )

    def near(name: str, within: int) -> Column:
        before = F.coalesce(F.col("start") - F.col(f"{name}_before") < within, F.lit(False))
        return before | F.coalesce(F.col(f"{name}_after") - F.col("end") < within, F.lit(False))

    identifier, secret = near("identifier", scope), near("secret", scope)
    complete = (
        F.when(F.col("kind") == 3, secret).when(F.col("kind") == 4, identifier).when(F.col("kind") == 5, identifier & secret)
    )
    return (
        spread.where((F.col("kind") >= N_STRONG) & complete & ~near("strong", 0))
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("start", "end", "kind")).alias("linked"))
    )


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    shown = F.transform(
        ordered, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(shown, ",")


def find_secrets(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts and spans for every row; ``strong`` and ``linked`` hold them as arrays."""
    parts = written(scan_parts(documents), "secret-parts")
    linked = link_parts(parts, scope).withColumnsRenamed({"doc_id": "linked_id", "text_key": "linked_key"})
    joined = parts.join(
        linked, parts["doc_id"].eqNullSafe(F.col("linked_id")) & (parts["text_key"] == F.col("linked_key")), "left"
    )
    count = lambda k: F.size(F.filter("strong", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    added = F.coalesce("linked", none)
    return joined.select(
        "doc_id",
        *[count(k) for k in range(N_STRONG)],
        F.sha2(_listed(F.col("strong")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("strong", added)).alias("spans"),
        "text_key",
        "strong",
        added.alias("linked"),
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones together, replaced by a mark."""
    kind_of = "array<struct<start:int,end:int,kind:int>>"
    ordered = F.sort_array(spans.cast(kind_of))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        piece = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        fresh = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], F.array(piece, F.lit(mark)))).otherwise(state["out"]).alias("out"),
        )

    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, first, step, rest)).otherwise(text)


def _oracle_sql() -> str:
    """The same in DuckDB, where the interval join is written as what it means: a complementary part within the scope."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    plain = [ASSIGN, ACCESS, HEX.rstrip("+"), IDENT, BLOB.rstrip("+"), ENDPOINT]
    raw = " union all ".join(
        f"select doc_id, {k} as kind, regexp_extract_all(t, {quoted(p)}) as m, regexp_split_to_array(t, {quoted(p)}) as b, "
        f"regexp_extract_all(t, {quoted(p)}, {2 if k in (0, 3) else 0}) as h from d where regexp_matches(t, {quoted(p)})"
        for k, p in enumerate(plain)
    )
    near = lambda kinds, within: (
        f"exists (select 1 from good p where p.doc_id = w.doc_id and (p.kind, p.s, p.e) <> (w.kind, w.s, w.e) "
        f"and p.kind in ({kinds}) and w.s - p.e < {within} and p.s - w.e < {within})"
    )
    identifier, secret = near("1, 3", SCOPE), near("0, 4", SCOPE)
    names = "[" + ", ".join(quoted(k) for k in KINDS) + "]"
    counts = ", ".join(f"count(*) filter (where kind = {k}) as n_{KINDS[k]}" for k in range(N_STRONG))
    listed = f"string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' order by s, kind, e)"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
raw as ({raw}),
found as (select doc_id, kind, m[k] as v, h[k] as g,
    cast(list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) as bigint) as s
  from raw, unnest(range(1, len(m) + 1)) u(k)),
good as (select doc_id, kind, s, s + length(v) as e from found where case kind when 0 then length(g) >= 8 when 3 then length(g) >= 4
  when 4 then regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]') else true end),
kept as (select * from good where kind < {N_STRONG} union all
  select * from good w where kind >= {N_STRONG} and not {near("0, 1, 2", 0)}
    and case kind when 3 then {secret} when 4 then {identifier} else {identifier} and {secret} end),
shown as (select doc_id, {counts}, coalesce({listed} filter (where kind < {N_STRONG}), '') as base, {listed} as spans from kept group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{KINDS[k]}, 0) as n_{KINDS[k]}" for k in range(N_STRONG))},
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join shown using (doc_id)
"""


ORACLE_SQL = _oracle_sql()
