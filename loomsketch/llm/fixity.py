"""WARC fixity audit with Merkle trees (operator 1).

Each replica's records are serialised as WARC records and hashed. Records stand in the order of their id, and so in ordered
ranges of offsets; a range of 1024 ids is a node whose digest is over its children's digests and byte lengths, and so on up
to one root. Two replicas are compared from the roots down, and only below nodes that differ. The way down adds up the bytes
of the siblings that stand before, so that a damaged record is reported with its offset although no record beside it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Bits of the id that one level takes away: a node has 1024 children at most.
BITS = 10
_FIRST = -(1 << 63)


def record(url: Column, html: Column) -> Column:
    """A WARC record. A null url has no target line, a null payload no length line: both differ from empty ones."""
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n")), F.lit("")),
    )
    return F.concat(head, F.lit("\r\n"), F.coalesce(html, F.lit("")), F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """key, n, bytes and digest of each record id.

    Records that share an id, or have none, are one leaf: their digests are added up word by word, which any order and any
    partial sums leave the same, so that no id gathers its records in one task.
    """
    whole = record(F.col("url").cast("string"), F.col("html").cast("string"))
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(_FIRST)).alias("key"), F.octet_length(whole).cast("long").alias("bytes"), F.sha2(F.concat(F.lit("\0").cast("binary"), whole.cast("binary")), 256).alias("d"))
    words = [F.sum(F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("long")) for i in range(8)]
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return sums.select("key", "n", "bytes", F.unhex(F.sha2(F.concat_ws(":", "n", *[f"w{i}" for i in range(8)]), 256)).alias("digest"))


def parent(key: Column) -> Column:
    return F.shiftright(key, BITS)


def ranges(nodes: DataFrame, above: Column) -> DataFrame:
    """The nodes above: a digest over the ordered children, of which there are at most 1024."""
    kids = F.array_sort(F.collect_list(F.struct("key", "bytes", "digest")))
    rows = nodes.groupBy(above.alias("key")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), kids.alias("kids"))
    text = F.array_join(F.transform("kids", lambda c: F.concat_ws(":", c["key"], c["bytes"], F.hex(c["digest"]))), ",")
    return rows.select("key", "n", "bytes", F.unhex(F.sha2(F.concat(F.lit("\1"), text), 256)).alias("digest"))


def trees(a: DataFrame, b: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The levels of both replicas' trees as stored tables, leaves first, roots last. They are equally high: the last level
    under the roots has at most 1024 nodes in either."""
    levels = [(stored(leaves(a), "leaves"), stored(leaves(b), "leaves"))]
    while max(x.count() for x in levels[-1]) > 1 << BITS:
        levels.append(tuple(stored(ranges(x, parent(F.col("key"))), "ranges") for x in levels[-1]))
    levels.append(tuple(stored(ranges(x, F.lit(0).cast("long")), "root") for x in levels[-1]))
    return levels


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """The records of which replica b differs from replica a.

    Columns: page_id, status (`changed`, `missing` from b, `extra` in b), offset in replica a (of an extra record: where it
    would stand), bytes_a and bytes_b (null where there is none). Equal replicas give no rows; an empty replica makes every
    record of the other one missing or extra. Records that share a page_id are audited together as one row, likewise those
    with a null page_id, which stand first and are reported with page_id null. Null and empty urls and payloads differ.
    Columns other than page_id, url and html are ignored.
    """
    levels = trees(a, b)
    # nodes that differ, with the offset at which they begin; to begin with, whatever stands above the roots
    suspects = a.sparkSession.range(1).select(F.col("id").alias("key"), F.lit(0).cast("long").alias("offset"))
    for level in range(len(levels) - 1, -1, -1):
        above = F.lit(0).cast("long") if level >= len(levels) - 2 else parent(F.col("key"))
        sides = []
        for nodes, s in zip(levels[level], "ab", strict=True):
            up = suspects.select(F.col("key").alias("up"), F.col("offset").alias(f"from_{s}"))
            sides.append(nodes.select("key", above.alias("up"), F.col("bytes").alias(f"bytes_{s}"), F.col("digest").alias(f"digest_{s}")).join(up, "up"))
        both = sides[0].join(sides[1], ["up", "key"], "full")
        before = Window.partitionBy("up").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce("from_a", "from_b") + F.coalesce(F.sum(F.coalesce("bytes_a", F.lit(0))).over(before), F.lit(0))
        both = both.withColumn("offset", start).filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        suspects = both.select("key", "offset", "bytes_a", "bytes_b")
        if level:
            suspects = stored(suspects, "suspects")
    status = F.when(F.col("bytes_b").isNull(), "missing").when(F.col("bytes_a").isNull(), "extra").otherwise("changed")
    return suspects.select(F.expr(f"nullif(key, {_FIRST + 1} - 1)").alias("page_id"), status.alias("status"), "offset", "bytes_a", "bytes_b")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with faults whose places follow from page_id alone: 1 of 97 records changed, 1 of 101 lost, 1 of 103 more."""
    names = ["page_id", "url", "html"]
    kept = pages.select(*names).filter((F.col("page_id") % 101 != 7) | F.col("page_id").isNull())
    html = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("~"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    more = pages.filter(F.col("page_id") % 103 == 11).select((-F.col("page_id") - 1).alias("page_id"), "url", "html")
    return kept.select("page_id", "url", html.alias("html")).unionByName(more)


def _sql_record(url: str, html: str) -> str:
    return f"(31 + coalesce(19 + strlen({url}), 0) + coalesce(18 + strlen(CAST(strlen({html}) AS VARCHAR)), 0) + 2 + coalesce(strlen({html}), 0) + 4)"


OP1_SQL = f"""
WITH a AS (
  SELECT page_id, url, html, {_sql_record("url", "html")} AS bytes FROM pages
), o AS (
  SELECT *, sum(bytes) OVER (ORDER BY page_id) - bytes AS start FROM a
), c AS (
  SELECT page_id, start, bytes, CASE WHEN page_id % 97 = 5 THEN '~' || substr(html, 2) ELSE html END AS html, url, html AS was FROM o
)
SELECT page_id, 'missing' AS status, CAST(start AS BIGINT) AS "offset", CAST(bytes AS BIGINT) AS bytes_a, CAST(NULL AS BIGINT) AS bytes_b
FROM c WHERE page_id % 101 = 7
UNION ALL
SELECT page_id, 'changed', CAST(start AS BIGINT), CAST(bytes AS BIGINT), CAST({_sql_record("url", "html")} AS BIGINT)
FROM c WHERE page_id % 101 <> 7 AND html IS DISTINCT FROM was
UNION ALL
SELECT -page_id - 1, 'extra', CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(bytes AS BIGINT) FROM a WHERE page_id % 103 = 11
"""


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a damaged replica of `pages` against the table itself."""
    pages = table(spark, sf_dir, "pages")
    return audit(pages, damaged(pages))
