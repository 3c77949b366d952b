"""Packing along a space-filling curve.

A document's token ids are counted into a hashed vector (256 places), which is scaled to unit length and projected to
four dimensions by fixed random directions. The four coordinates, 15 bits each, give the document's place on a Hilbert
curve. Documents are sorted by range over (place, doc_id) and laid end to end along the curve; every `length` tokens a
sequence ends, so that a document is cut only where a sequence is full, and only the last sequence of all has padding.

Texts are encoded once; ids are kept as two bytes each in a table in the shared folder. Range limits come from a bounded sample
of places (`sample` rows; they decide on balance alone, not on results), so a place that many documents share is split by
their ids. Each range's tokens are counted, the running sum over ranges (one row a range) gives each range's first place
in the whole, and one task streams over its range. No task holds more than a batch.

Null and empty texts are one token long (the end mark). Null doc_ids come first among equals. Repeated rows are packed each.
An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTH, END = 2048, 1
PLACES, DIMS, BITS = 256, 4, 15


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def encoding(path: str):  # noqa: ANN201
    """The byte-level BPE vocabulary at path (a tokenizers file whose ranks stand beside it), in the library that encodes it fastest."""
    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def hilbert(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of whole coordinates from 0 to 2**bits - 1 (Skilling's transform)."""
    x = coordinates.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    place = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def places(ids: list[np.ndarray]) -> np.ndarray:
    """Each document's place on the curve from its token ids."""
    sizes = np.array([len(x) for x in ids])
    flat = np.concatenate(ids).astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)
    mixed = C.mix(flat + np.uint64(1))
    sign = np.where(mixed >> np.uint64(63), 1.0, -1.0)
    cell = np.repeat(np.arange(len(ids)), sizes) * PLACES + (mixed % np.uint64(PLACES)).astype(np.int64)
    vectors = np.bincount(cell, sign, len(ids) * PLACES).reshape(len(ids), PLACES)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    directions = np.random.default_rng(2048).standard_normal((PLACES, DIMS))
    directions /= np.linalg.norm(directions, axis=0)
    points = np.clip((vectors @ directions + 1) / 2, 0, 1)
    return hilbert(np.minimum((points * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _encoded(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(path)
        if bpe.n_vocab > 1 << 16:
            raise ValueError(f"{path} has {bpe.n_vocab} ids; pieces hold ids of 16 bits")
        for batch in batches:
            for part in C.slices(batch, "text"):
                ids = [np.append(bpe.encode_to_numpy(x or "", allowed_special="all"), END).astype(np.uint16) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(places(ids)), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "place", "n", "ids"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, vocabulary: str | None = None, sample: int = 100_000) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (two bytes each)."""
    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), C.text_or_empty(f"`{text_col}`").alias("text"))
    table = C.materialize(plain.mapInArrow(_encoded(vocabulary or default_vocabulary()), "doc_id long, place long, n long, ids binary"))
    key = table.select("place", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), "n")
    rows, tokens = key.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ranges = max(1, min(rows, max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens >> 25)))
    some = sorted(tuple(r) for r in key.sample(min(1.0, sample / max(rows, 1)), seed=1).limit(2 * sample).collect())
    share = np.cumsum([n for _, _, n in some]) if some else np.zeros(0)  # ranges of equal shares of tokens, not of documents
    at = [some[k][:2] for k in np.searchsorted(share, share[-1] * np.arange(1, ranges) / ranges)] if some else []
    limits = spark.sparkContext.broadcast(np.array(at, [("place", "<i8"), ("o", "<i8")]))

    def range_of(place: pd.Series, o: pd.Series) -> pd.Series:
        both = np.empty(len(place), limits.value.dtype)
        both["place"], both["o"] = place, o
        return pd.Series(np.searchsorted(limits.value, both, "right").astype(np.int32))

    ranged = table.withColumn("o", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("range", F.pandas_udf(range_of, "int")("place", "o"))
    totals = dict(ranged.groupBy("range").agg(F.sum("n")).collect())  # a row a range
    firsts, total = {}, 0
    for i in range(ranges):
        firsts[i], total = total, total + totals.get(i, 0)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: dict[int, int] = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, n, ids, r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "range"))):
                first = before.get(r, firsts[r])
                before[r] = first + n
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, length)
                    size = min(length - offset, n - start)
                    for o, v in zip(out, (doc_id, start, size, n, sequence, offset, ids[2 * start : 2 * (start + size)])):
                        o.append(v)
                    start += size
            yield pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in out[:6]), pa.array(out[6], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    along = ranged.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "place", "o")
    return along.select("doc_id", "n", "ids", "range").mapInArrow(pieces, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def crc32_of(pieces: DataFrame) -> DataFrame:
    """Replaces ids by ids_crc32, over unsigned little-endian numbers of 32 bits."""

    def crc(ids: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(x, np.uint16).astype("<u4").tobytes()) for x in ids], dtype="int64")

    return pieces.withColumn("ids_crc32", F.pandas_udf(crc, "long")("ids")).drop("ids")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crc32_of(pack(C.table(spark, sf_dir, "documents")))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op3_packing": op3_packing}
ORACLE_SQL: dict[str, str] = {}
