"""Sharding by jump consistent hashing. DataFrame functions only.

The shard of a key follows from the key and the number of shards alone, without a ring table; with one more shard, a key
either keeps its shard or goes to the new one. The key's hash drives the 64-bit linear congruential generator of the
published algorithm (Lamping and Veach); its products modulo 2**64 are taken in decimals, which do not overflow.

A row's slot counts from 0 in its shard: rows of a shard are numbered in parts (by a hash of the key), so that no
task gets a whole shard, and the parts' counts, one row for each shard and part, give each part its first slot.

A null key is a key like any other, a null text is empty. Repeated rows get the same shard and different slots.
Empty tables give empty results; extra columns are kept by `write_shards` and ignored by `assign`.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

MULTIPLIER = 2862933555777941757
PARTS = 1024


def key_hash(key: Column) -> Column:
    """63 bits of a hash of the key's text that other engines have too (the first of its MD5)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("decimal(20,0)")


def jump(state: Column, shards: int) -> Column:
    """The shard, from 0, of a key whose hash is `state` (decimal(20,0), from 0 to 2**64 - 1).

    A jump goes to at least the next shard, so that `shards` steps are enough; steps after the last jump do nothing.
    """
    two64, two33, two31 = F.lit(Decimal(1 << 64)), F.lit(Decimal(1 << 33)), float(1 << 31)

    def step(a: Column, _: Column) -> Column:
        s = ((a["s"] * F.lit(Decimal(MULTIPLIER)) + F.lit(1)).cast("decimal(38,0)") % two64).cast("decimal(20,0)")
        high = ((s - s % two33) / two33).cast("double")
        j = F.floor((a["j"] + 1).cast("double") * (F.lit(two31) / (high + 1.0))).cast("long")
        return F.when(a["j"] >= shards, a).otherwise(F.struct(s.alias("s"), a["j"].alias("b"), j.alias("j")))

    def first(state: Column) -> Column:
        return F.struct(state.alias("s"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), first(state), step, lambda a: a["b"].cast("int"))


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (with one shard more)."""
    text = C.text_or_empty(f"`{text_col}`")
    key = key_hash(F.col("doc_id"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", jump(key, shards)).withColumn("grown_shard", jump(key, shards + 1)).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
    rows = C.materialize(rows)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))  # shards x parts rows at most
    firsts = counts.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("local", local).join(F.broadcast(firsts), ["shard", "part"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("local")).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", shard_col: str = "shard") -> None:
    """Writes docs with all their columns, one folder a shard; rows do not shuffle."""
    docs.withColumn(shard_col, jump(key_hash(F.col(f"`{id_col}`")), shards)).write.partitionBy(shard_col).parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(C.table(spark, sf_dir, "documents"))


def _oracle(shards: int) -> str:
    jumps = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS n, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15)) AS HUGEINT) AS s, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM (SELECT DISTINCT doc_id FROM documents)" for n in (shards, shards + 1)
    )
    return f"""
        WITH RECURSIVE walk AS ({jumps}
            UNION ALL
            SELECT doc_id, n, t, j, CAST(floor(CAST(j + 1 AS DOUBLE) * (2147483648.0::DOUBLE / (CAST(t // 8589934592 AS DOUBLE) + 1.0))) AS BIGINT)
            FROM (SELECT doc_id, n, j, (s * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS t FROM walk WHERE j < n)
        ), ends AS (SELECT doc_id, n, max(b) AS shard FROM walk WHERE j >= n GROUP BY doc_id, n)
        SELECT doc_id, shard, grown_shard FROM (SELECT doc_id, CAST(shard AS INTEGER) AS shard FROM ends WHERE n = {shards})
        JOIN (SELECT doc_id, CAST(shard AS INTEGER) AS grown_shard FROM ends WHERE n = {shards + 1}) USING (doc_id)
    """


SHARD_SQL = _oracle(24)
def shard_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op7_sharding that SQL can make too."""
    return op7_sharding(spark, sf_dir).select("doc_id", "size", "law", "shard", "grown_shard")


QUERIES = {"op7_sharding": op7_sharding, "shard_columns": shard_columns}
# crc32 and the order by hash inside a shard are not in SQL; a test compares them with plain Python
ORACLE_SQL = {"shard_columns": f"SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, 'key' AS law, shard, grown_shard FROM documents JOIN ({SHARD_SQL}) USING (doc_id)"}
