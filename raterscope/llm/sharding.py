"""Sharding by extendible hashing.

A directory of hash prefixes: every row hashes to a string of bits, a shard is a prefix, and only a
shard above its byte limit is split, on one more bit, until each fits. All prefixes of the row's hash
are weighed at once on a table of fine cells (one aggregation of narrow rows); rows whose deepest cell
is still too large go on to the next bits. The first bits come from the key, so that equal keys stay
together as long as they fit; after them come bits of a number given to each row, so that a key with a
third of all rows is split as well. A single row above the limit has a shard of its own.

Defined results: a null text counts no bytes, a null key is a key; repeated rows are rows of their own
and may go to different shards; an empty table gives no shards; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

KEY_BITS = 60
ROW_BITS = 60
# Bits looked at in one pass beyond those that equal shards would need.
SPARE_BITS = 6


def _bits(value: Column) -> Column:
    """The first 60 bits of the value's MD5, as text of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(value.cast("string")), 1, 15), 16, 2), 60, "0")


def _directory(cells: DataFrame, depths: range, limit: int) -> DataFrame:
    """For each prefix of the cells' bits its weight, kept where it is the shortest that fits.

    A prefix fits if its bytes are within the limit; the shortest one has a parent that does not.
    """
    prefixes = cells.select(
        F.explode(F.sequence(F.lit(depths.start), F.lit(depths.stop - 1))).alias("depth"), "bits", "n_bytes", "n_rows"
    ).select("depth", F.expr("substring(bits, 1, depth)").alias("shard"), "n_bytes", "n_rows")
    weights = prefixes.groupBy("depth", "shard").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"))
    weights = cut_lineage(weights)
    fits = (F.col("n_bytes") <= limit) | (F.col("n_rows") == 1)
    top = F.col("depth") == depths.start
    parents = weights.filter(~fits).select(F.col("shard").alias("parent"), F.lit(True).alias("split"))
    kept = weights.filter(fits).withColumn("parent", F.expr("substring(shard, 1, depth - 1)"))
    kept = kept.join(parents, "parent", "left")
    first = F.lit(depths.start == 0) & top
    return kept.filter(F.col("split").isNotNull() | first).select("shard", "depth", "n_bytes", "n_rows")


def shard_directory(rows: DataFrame, limit: int) -> DataFrame:
    """Shards of a table with ``bits`` and ``n_bytes``: shard, depth, n_bytes, n_rows. Runs jobs.

    The passes are bounded by the bits there are: with 6 spare bits, about one in a hundred thousand
    cells needs a second pass unless keys repeat.
    """
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    longest = KEY_BITS + ROW_BITS
    reach = min(longest, SPARE_BITS + math.ceil(math.log2(max(1, total / limit))))
    found, begin, remaining = None, 0, rows
    while True:
        cells = remaining.groupBy(F.substring("bits", 1, reach).alias("bits")).agg(
            F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows")
        )
        cells = cut_lineage(cells)
        # The deepest prefix of the pass before is known to be too large: it is the first parent here.
        part = _directory(cells, range(begin, reach + 1), limit)
        found = part if found is None else found.unionByName(part)
        heavy = cells.filter((F.col("n_bytes") > limit) & (F.col("n_rows") > 1)).select(F.col("bits").alias("heavy"))
        if reach == longest or heavy.isEmpty():
            break
        remaining = cut_lineage(
            remaining.withColumn("heavy", F.substring("bits", 1, reach)).join(cut_lineage(heavy), "heavy", "left_semi").drop("heavy")
        )
        begin, reach = reach, min(longest, reach + 3 * SPARE_BITS)
    return cut_lineage(found)


def assign_shards(df: DataFrame, limit: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shard of every row: the key, n_bytes, shard, shard_depth, shard_bytes, shard_rows.

    ``shard`` is the prefix of 0 and 1, empty for the only shard of a table that fits whole.
    """
    if limit < 1:
        raise ValueError("limit must be at least one byte")
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    rows = df.select(F.col(key_col).alias("key"), size.alias("n_bytes"), _bits(key).alias("key_bits"))
    # The number is written with the row: later reads and retried tasks see the same one.
    rows = cut_lineage(rows.withColumn("number", F.monotonically_increasing_id()))
    rows = rows.withColumn("bits", F.concat("key_bits", _bits(F.col("number"))))
    shards = shard_directory(rows, limit).withColumnsRenamed(
        {"n_bytes": "shard_bytes", "n_rows": "shard_rows", "depth": "shard_depth"}
    )
    # Every shard is found by its prefix; the depths in use are few, and each row has one shard.
    depths = [r["shard_depth"] for r in shards.select("shard_depth").distinct().collect()]
    if not depths:
        return rows.join(shards, F.lit(False)).select(F.col("key").alias(key_col), "n_bytes", *_SHARD)
    tries = F.array(*[F.substring("bits", 1, int(d)) for d in sorted(depths)])
    tried = rows.select("key", "n_bytes", F.explode(tries).alias("shard"))
    return tried.join(shards, "shard").select(F.col("key").alias(key_col), "n_bytes", *_SHARD)


_SHARD = ["shard", "shard_depth", "shard_bytes", "shard_rows"]


def write_shards(df: DataFrame, path: str, limit: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the table in one folder for each shard and return the directory. Keys must be unique.

    Rows are dealt out by shard, so that each shard is written by one task, which its limit bounds.
    """
    shards = cut_lineage(assign_shards(df, limit, key_col, text_col))
    placed = shards.select(F.col(key_col).alias("__key"), F.concat(F.lit("s"), "shard").alias("__shard"))
    joined = df.join(placed, F.col(key_col).eqNullSafe(F.col("__key"))).drop("__key")
    joined.repartition("__shard").write.partitionBy("__shard").parquet(path)
    return shards.select(*_SHARD).distinct()


ORACLE = """
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents),
weights AS (
  SELECT depth, substr(bits, 1, depth) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM rows, range(0, 25) AS r(depth) GROUP BY ALL),
fit AS (SELECT *, shard_bytes <= {limit} OR shard_rows = 1 AS fits FROM weights),
best AS (
  SELECT r.doc_id, min(f.depth) AS depth FROM rows r JOIN fit f ON f.shard = substr(r.bits, 1, f.depth)
  WHERE f.fits GROUP BY ALL)
SELECT r.doc_id, r.n_bytes, f.shard, f.depth::INT AS shard_depth, f.shard_bytes, f.shard_rows
FROM rows r JOIN best b USING (doc_id) JOIN fit f ON f.depth = b.depth AND f.shard = substr(r.bits, 1, b.depth)
"""
