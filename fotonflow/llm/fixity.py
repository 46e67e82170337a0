"""Merkle fixity audit of WARC volumes.

Pages become WARC records and records are laid out in volumes of bounded size. Record digests are the leaves of
a tree per volume; inner nodes hash the ordered nodes of an offset range. To compare replicas, roots are
compared first, and only children of mismatching nodes are looked at, level by level down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotonflow.llm.common import materialize

CRLF = "\r\n"


def record(page_id: Column, url: Column, payload: Column) -> Column:
    """Text of a WARC resource record; nulls count as empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = [F.lit(f"WARC/1.0{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:page:"), text(page_id), F.lit(f">{CRLF}WARC-Target-URI: "), text(url), F.lit(f"{CRLF}Content-Length: "), F.octet_length(text(payload)).cast("string"), F.lit(CRLF * 2)]
    return F.concat(*head, text(payload), F.lit(CRLF * 2))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def layout(records: DataFrame, volume_bytes: int = 32 << 20) -> DataFrame:
    """Adds (volume, start) to rows with page_id, url, length and sha256: records by hash into volumes, end to end in order of (page_id, url, sha256).

    Equal records (same id, address and digest) are stored once. The number of volumes follows the total length.
    """
    once = materialize(records.dropDuplicates(["page_id", "url", "sha256"]), "records")
    total = once.agg(F.sum("length")).first()[0] or 0
    volumes = max(1, -(-total // volume_bytes))
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), "sha256").cast("binary"))
    volume = F.conv(F.substring(name, 1, 8), 16, 10).cast("long") % volumes
    before = Window.partitionBy("volume").orderBy("page_id", "url", "sha256").rowsBetween(Window.unboundedPreceding, -1)
    return once.withColumn("volume", volume).withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))


def tree(leaves: DataFrame, range_bytes: int = 1 << 16, fan: int = 16, levels: int = 4) -> list[DataFrame]:
    """From records (volume, start, sha256) up to the roots: a table (volume, node, parent, sha256) per level.

    Level 0 has a node per record, level 1 one per ``range_bytes`` of offsets, each further level one per ``fan`` nodes below,
    and the last one per volume. A node's digest covers the offsets and digests below it, in order.
    """
    steps = [range_bytes, *[fan] * (levels - 1)]
    now = leaves.select("volume", F.col("start").alias("node"), "sha256")
    out = []
    for step in [*steps, None]:
        now = now.withColumn("parent", F.floor(F.col("node") / step) if step else F.lit(0).cast("long"))
        out.append(now)
        # the nodes of one range: at most ``fan``, or the records that start within range_bytes
        inside = F.array_sort(F.collect_list(F.struct("node", "sha256")))
        joined = F.array_join(F.transform(inside, lambda x: F.concat_ws(":", x["node"].cast("string"), x["sha256"])), ",")
        now = now.groupBy("volume", F.col("parent").alias("node")).agg(F.sha2(joined.cast("binary"), 256).alias("sha256"))
    return [materialize(level, "tree") for level in [*out, now.withColumn("parent", F.lit(0).cast("long"))]]


def audit(primary: DataFrame, replica: DataFrame, **shape: int) -> DataFrame:
    """Records that differ: (volume, start, kind, expected_sha256, found_sha256), kind changed, missing or extra.

    Both sides have (volume, start, sha256) with one record per place. Equal replicas and empty tables give no rows.
    """
    ours, theirs = tree(primary, **shape), tree(replica, **shape)
    wrong = None
    for a, b in zip(reversed(ours), reversed(theirs)):
        if wrong is not None:
            a, b = (x.join(wrong, ["volume", "parent"], "left_semi") for x in (a, b))
        both = a.withColumnRenamed("sha256", "expected_sha256").join(b.withColumnRenamed("sha256", "found_sha256"), ["volume", "node", "parent"], "full")
        differ = materialize(both.where(~F.col("expected_sha256").eqNullSafe(F.col("found_sha256"))), "differ")
        wrong = differ.select("volume", F.col("node").alias("parent"))
    kind = F.when(F.col("expected_sha256").isNull(), "extra").when(F.col("found_sha256").isNull(), "missing").otherwise("changed")
    return differ.select("volume", F.col("node").alias("start"), kind.alias("kind"), "expected_sha256", "found_sha256")
