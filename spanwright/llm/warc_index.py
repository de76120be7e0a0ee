"""WARC archives and a globally ordered index of what they hold.

``write_archives`` turns page rows into WARC/1.1 records and writes them, gzip-compressed, through Spark's own text sink, so
any file system that Spark writes will do.  Of pages with equal payloads of at least ``least_revisit`` bytes the one with
the smallest page_id is a response and the others revisit it.

``merge_index`` reads the archives back.  Every archive gives a run of index lines, sorted locally by URL key, time and page.
The runs are cut at common key ranges; the pieces of one range meet in one task, which merges them
with a loser tree.  A range holds about ``RANGE_ROWS`` lines, and its bounds are whole keys (URL key, time,
page), so a host or URL with very many captures is spread over ranges like any other.  ``capture_rank`` is a line's place in
the global order; a URL's capture history is its lines in that order.

Defined results: a null html is an empty payload, a null url has the key "-" and is read back as null.  Rows equal in page_id
and payload are one capture written twice: both are responses, or both revisit.  A page without page_id
is a response only if no page with an id has its payload.  Control characters in URLs are percent-encoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwright.llm.common import written

RECORDS_PER_FILE = 2000
RANGE_ROWS = 100_000
END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Captures without a time of their own are dated from here on, a second for each page number.
FIRST_SECOND = 1_704_067_200


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are twenty bits are four letters."""
    digits = F.sha1(payload)
    letters = []
    for k in range(8):
        bits = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(ALPHABET), at, F.lit(1)))
    return F.concat(*letters)


def as_records(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """One WARC record, as text, for every page row."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    base = base.withColumns({"digest": base32_sha1(F.encode("payload", "UTF-8")), "size": F.octet_length("payload")})
    firsts = (
        base.where(F.col("size") >= least_revisit)
        .groupBy(F.col("digest").alias("same"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
    )
    joined = base.join(firsts, base["digest"] == firsts["same"], "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False)) & F.col("first_id").isNotNull()
    second = F.timestamp_seconds(F.lit(FIRST_SECOND) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9)))
    date = F.date_format(F.to_utc_timestamp(second, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    block = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit(END),
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        name("page_id"),
        F.lit("\r\nWARC-Date: "),
        date,
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.when(
            revisit,
            F.concat(
                F.lit("\r\nWARC-Refers-To: "),
                name("first_id"),
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ),
        ).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
    )
    return joined.select(F.concat(header, F.octet_length(block).cast("string"), F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, path: str, least_revisit: int = 0) -> None:
    """Every record ends with two line ends, which the sink adds as its line separator."""
    sink = as_records(pages, least_revisit).write.option("lineSep", END).option("compression", "gzip")
    sink.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels from the right, no scheme, port 80 or 443, user or fragment."""
    if not url:
        return "-"
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url)
    if not m:
        return url
    host = ",".join(reversed(m[1].lower().split(".")))
    return f"{host}{m[2] if m[2] not in (None, ':80', ':443') else ''}){m[3] or '/'}"


def parse_archive(raw: bytes):
    """(offset, length, headers, payload) of each record of an uncompressed archive, in order."""
    at = 0
    while at < len(raw):
        split = raw.index(b"\r\n\r\n", at)
        lines = raw[at:split].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        block = raw[split + 4 : split + 4 + size]
        end = split + 4 + size
        if len(block) != size or raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut off")
        http, _, payload = block.partition(b"\r\n\r\n")
        headers["http"] = http.decode("utf-8")
        yield at, end + 4 - at, headers, payload
        at = end + 4


LINE = (
    "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, url string, archive string, offset long, length long, run long, seq long"
)


def _number(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def _order(row) -> tuple:
    """URL key, time, page; then where the record lies, so that equal captures have an order too."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index lines of every archive, each archive's own in order, numbered by ``seq``."""

    def run(batches):
        import xxhash

        for frame in batches:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                archive = name.rsplit("/", 1)[-1]
                rows = []
                for offset, length, headers, payload in parse_archive(gzip.decompress(content)):
                    kind = headers["WARC-Type"]
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(re.search(r"Content-Length: (\d+)", headers["http"])[1])
                    if kind == "response":
                        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{archive}: the payload at {offset} is not what its record says")
                    url = headers.get("WARC-Target-URI")
                    page, refers = _number(headers["WARC-Record-ID"]), _number(headers.get("WARC-Refers-To"))
                    rows.append([url_key(url), headers["WARC-Date"], page, size, digest, kind, refers, url, archive, offset, length])
                rows.sort(key=_order)
                run_id = xxhash.xxh3_64_intdigest(archive) >> 1
                made = pd.DataFrame([[*r, run_id, k] for k, r in enumerate(rows)], columns=[c.split()[0] for c in LINE.split(", ")])
                yield made.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInPandas(run, LINE)


class LoserTree:
    """Merge sorted lists: inner nodes hold the losers of a tournament, so a new head replays one path to the top."""

    def __init__(self, runs: list[list], key):
        self.key, self.runs, self.at = key, runs, [0] * len(runs)
        self.heads = [key(r[0]) if r else None for r in runs]
        self.k = len(runs)
        self.losers = [-1] * max(self.k, 1)
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            run, at = self.runs[w], self.at[w]
            yield run[at]
            self.at[w] = at = at + 1
            self.heads[w] = self.key(run[at]) if at < len(run) else None
            node = (w + self.k) // 2
            while node:
                if self._first(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def merge_runs(runs: DataFrame) -> DataFrame:
    """All lines with merge_range and merge_pos, their place in the global order."""
    n = max(1, math.ceil(runs.count() / RANGE_ROWS))
    columns = [c.split()[0] for c in LINE.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        pieces: dict[int, list] = {}
        for frame in batches:
            frame = frame.astype(object).where(frame.notna(), None)
            for row in frame.itertuples(index=False, name=None):
                pieces.setdefault(row[11], []).append(row)
        merged = list(LoserTree(list(pieces.values()), _order))
        made = pd.DataFrame(merged, columns=columns).drop(columns=["run", "seq"])
        made["merge_range"] = TaskContext.get().partitionId()
        made["merge_pos"] = range(len(made))
        yield made.astype({"page_id": "Int64", "refers_to": "Int64"})

    ranged = runs.repartitionByRange(n, "url_key", "captured", F.col("page_id").asc_nulls_first(), "archive", "offset")
    kind = LINE.rsplit(", run", 1)[0] + ", merge_range int, merge_pos long"
    return ranged.sortWithinPartitions("run", "seq").mapInPandas(run, kind)


def merge_index(spark: SparkSession, path: str) -> DataFrame:
    """All lines with their range, their place in it, and capture_rank, their place in all."""
    merged = written(merge_runs(written(sorted_runs(spark, path), "index-runs")), "index")
    # one row for each range, so this window and the join's small side are as short as the list of ranges
    before = Window.orderBy("merge_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = merged.groupBy("merge_range").agg(F.count("*").alias("n"))
    offsets = offsets.select("merge_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return merged.join(offsets, "merge_range").withColumn("capture_rank", F.col("ahead") + F.col("merge_pos")).drop("ahead")


def _oracle_sql() -> str:
    bits = lambda k: f"cast('0x' || substr(h, {5 * k + 1}, 5) as bigint)"
    letters = " || ".join(f"substr('{ALPHABET}', 1 + (({bits(k)} >> {s}) & 31)::int, 1)" for k in range(8) for s in (15, 10, 5, 0))
    pattern = r"'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/?#:]*)(:\d+)?([^#]*)'"
    part = lambda g: f"regexp_extract(url, {pattern}, {g})"
    return f"""
with p as (select page_id, url, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, url, octet_length(encode(payload)) as payload_bytes, {letters} as payload_digest, min(page_id) over (partition by h) as first_id,
  case when coalesce(url, '') = '' then '-' when not regexp_matches(url, {pattern}) then url
    else array_to_string(list_reverse(string_split(lower({part(1)}), '.')), ',') || case when {part(2)} in ('', ':80', ':443') then '' else {part(2)} end
      || ')' || case when {part(3)} = '' then '/' else {part(3)} end end as url_key,
  strftime(to_timestamp({FIRST_SECOND} + page_id % 1000000000) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as captured from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest, case when first_id <> page_id then 'revisit' else 'response' end as record_type,
  case when first_id <> page_id then first_id end as refers_to, url_key, captured, row_number() over (order by url_key, captured, page_id) - 1 as capture_rank
from d
"""


#: The same in DuckDB, for pages with distinct ids and URLs without control characters.
ORACLE_SQL = _oracle_sql()
