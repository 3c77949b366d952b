"""Exact deduplication: two-pass Bloom filtering.

The first pass fills a filter that counts, for each bit position, whether none, one or more rows hit it. A row
whose positions were all hit by more than one row is *possibly repeated*; every other row is certainly alone. Only
the possibly repeated rows shuffle, the rest pass straight through the second scan.

The filter has `bits_per_row` positions a row and at most `max_bits` (32 MB as bits), so what is broadcast is
bounded; where the table is larger than that, more rows are taken for possibly repeated, and results stay the same.

Texts are equal when identical, null counts as empty. Of equal texts the row with the largest doc_id stays, a null
doc_id counts as the smallest; of rows that also agree in doc_id, one stays. Empty tables give empty results. Extra
columns are kept by `drop_exact_copies` and ignored by `duplicate_groups`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SEGMENT = 1 << 16
PROBES = 3
FLUSH = 1 << 18


def _positions(keys: np.ndarray, bits: int) -> np.ndarray:
    keys = C.mix(keys.astype(np.int64).view(np.uint64))
    first, step = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)])


class Filter:
    """Bits that `probe` can test; what `build` or `build_repeated` returns."""

    def __init__(self, spark: SparkSession, bits: int, packed: np.ndarray):
        self.bits, self.shared = bits, spark.sparkContext.broadcast(packed)

    def probe(self, key: Column) -> Column:
        """True where the key may be in the filter."""
        test = self.tester()

        def maybe(keys: pd.Series) -> pd.Series:
            return pd.Series(test(keys.to_numpy()))

        return F.pandas_udf(maybe, "boolean")(key)

    def tester(self) -> Callable[[np.ndarray], np.ndarray]:
        """What `probe` does, for functions that have their keys in an array."""
        bits, shared = self.bits, self.shared

        def test(keys: np.ndarray) -> np.ndarray:
            packed, at = shared.value, _positions(keys, bits)
            return ((packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)

        return test


def size_bits(rows: int, bits_per_row: int, max_bits: int) -> int:
    return min(max_bits, max(SEGMENT, 1 << int(rows * bits_per_row - 1).bit_length()))


def build(keys: DataFrame, rows: int, repeated: bool, bits_per_row: int = 16, max_bits: int = 1 << 28, of: Callable[[pa.RecordBatch], Iterator[np.ndarray]] | None = None) -> Filter:
    """A filter of the one bigint column of keys (or what `of` makes of its batches): of all of them, or of the positions that two or more rows hit.

    Tasks send the positions they hit, by segments of 65,536; a merging task owns whole segments and streams over
    what it is sent, so that its memory is a few bytes a position.
    """
    spark, bits = keys.sparkSession, size_bits(max(rows, 1), bits_per_row, max_bits)
    name = keys.columns[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def segments(keys: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(_positions(np.concatenate(keys), bits).ravel(), return_counts=True)
        segment = (at // SEGMENT).astype(np.int32)
        cuts = np.flatnonzero(np.diff(segment, prepend=-1))
        low, ends = (at % SEGMENT).astype(np.uint16), [*cuts[1:].tolist(), len(at)]
        spans = list(zip(cuts.tolist(), ends))
        return pa.RecordBatch.from_arrays([pa.array(segment[cuts]), pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([low[a:b][n[a:b] > 1].tobytes() for a, b in spans], pa.binary())], ["segment", "hit", "more"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        for batch in batches:
            for some in of(batch) if of else [batch.column(name).to_numpy(zero_copy_only=False)]:
                keys.append(some)
                if sum(map(len, keys)) >= FLUSH:
                    yield segments(keys)
                    keys = []
        if sum(map(len, keys)):
            yield segments(keys)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        more: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, hit, twice in zip(*(batch.column(c).to_pylist() for c in ("segment", "hit", "more"))):
                if s not in once:
                    once[s], more[s] = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
                at = np.frombuffer(hit, np.uint16)
                more[s][at] |= once[s][at]
                more[s][np.frombuffer(twice, np.uint16)] = True
                once[s][at] = True
        kept = more if repeated else once
        for s, x in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

    found = keys.mapInArrow(local, "segment int, hit binary, more binary").repartition(max(1, min(tasks, bits // SEGMENT)), "segment").mapInArrow(merge, "segment int, bits binary")
    packed = np.zeros(bits // 8, np.uint8)
    for batch in found.toArrow().to_batches():  # bits / 8 bytes at most
        for segment, some in zip(batch.column("segment").to_pylist(), batch.column("bits")):
            packed[segment * SEGMENT // 8 : (segment + 1) * SEGMENT // 8] = np.frombuffer(some.as_buffer(), np.uint8)
    return Filter(spark, bits, packed)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **size: int) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, possibly_repeated."""
    digests = C.materialize(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.sha2(C.text_or_empty(f"`{text_col}`"), 256).alias("text_sha256")).withColumn("row", F.monotonically_increasing_id()))
    key = F.xxhash64("text_sha256")
    bloom = build(digests.select(key.alias("key")), digests.count(), repeated=True, **size)
    flagged = digests.withColumn("possibly_repeated", bloom.probe(key))
    alone = flagged.filter(~F.col("possibly_repeated")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "possibly_repeated")
    best = F.max(F.struct("doc_id", "row")).alias("best")
    some = C.group_back(flagged.filter("possibly_repeated"), ["text_sha256"], [F.count("*").alias("n"), best], [F.sum("n").alias("group_size"), F.max("best").alias("best")], F.col("row"))
    return alone.unionByName(some.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "possibly_repeated"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **size: int) -> DataFrame:
    """The rows of docs that stay, with all their columns; a group of copies shrinks to a row a task before it shuffles."""
    text, maybe = C.text_or_empty(f"`{text_col}`"), C.free("__maybe", docs)
    bloom = build(docs.select(F.xxhash64(text).alias("key")), docs.count(), repeated=True, **size)
    flagged = docs.withColumn(maybe, bloom.probe(F.xxhash64(text)))
    alone = flagged.filter(~F.col(maybe)).drop(maybe)
    rows = flagged.filter(F.col(maybe)).select(F.sha2(text, 256).alias("sha"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    best = rows.groupBy("sha").agg(F.max_by("row", F.struct(F.col("row").getField(id_col).isNotNull(), F.col("row").getField(id_col))).alias("row"))
    return alone.union(best.select("row.*"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(C.table(spark, sf_dir, "documents")).drop("possibly_repeated")


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE_SQL = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """
}
