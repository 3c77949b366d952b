"""Quality classifier: histogram gradient-boosted trees over document statistics.

A document's statistics (shares of kinds of characters, lengths of words and lines, repetition) are taken from its whole text
alone. Trees are fitted on the driver from at most `sample` labelled rows (40,000; taken by a hash of the id, so that the bound
decides on the fit's precision alone), with statistics cut into at most 64 bins at their quantiles. Each tree is a complete binary tree in flat
arrays, so that scoring is a walk of all rows at once: as many numpy steps as a tree is deep.

Labels are read only of rows whose CRC-32 of the id is not divisible by `every`. A null id counts as the text "null" and has no label.
Null and empty texts have statistics of zero and are scored. Null labels are left out; several labels of one document all count. Without labels every score is 0.5,
with labels of one class the share of that class, smoothed. Repeated rows are scored each. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .lattice_lm import held_out

SAMPLE = 40_000
BINS = 64
#: Kinds of bytes: 0 lower-case letter, 1 upper-case letter, 2 digit, 3 white space, 4 stop, 5 exclamation or question mark, 6 symbol, 7 other ASCII, 8 outside ASCII.
_KIND = np.full(256, 7, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:", b"!?", b"#*$%&|<>@^~{}[]\\/=+_")):
    _KIND[list(_chars)] = _k
_KIND[128:] = 8
KINDS = 9
NAMES = [*(f"kind_{i}" for i in range(KINDS)), "pipes", "log_chars", "log_words", "word_length", "word_spread", "distinct_share", "top_share", "same_as_last", "pairs_distinct", "log_lines", "line_length", "line_dup_share", "line_stop_share", "upper_words", "sentence_words"]


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of statistics per text."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(owner * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS).astype(float)
    pipes = np.bincount(owner[data == ord("|")], minlength=n)
    stops = np.bincount(owner[(data == ord(".")) | (data == ord("!")) | (data == ord("?"))], minlength=n)
    chars = np.maximum(sizes, 1)
    hashes, counts = C.word_hashes(texts, lower=False)
    whose = np.repeat(np.arange(n), counts)
    words = np.maximum(counts, 1)
    order = np.lexsort((hashes, whose))
    h, o = hashes[order], whose[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[new], minlength=n)
    at = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, o[at], np.diff(np.append(at, len(h))))
    inside = whose[1:] == whose[:-1]
    same = np.bincount(whose[1:][(hashes[1:] == hashes[:-1]) & inside], minlength=n)
    pairs = C.mix(hashes[:-1] + np.uint64(1)) ^ hashes[1:]
    pairs, pair_of = pairs[inside], whose[1:][inside]
    order = np.lexsort((pairs, pair_of))
    pairs, pair_of = pairs[order], pair_of[order]
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = (pairs[1:] != pairs[:-1]) | (pair_of[1:] != pair_of[:-1])
    pair_share = np.bincount(pair_of[fresh], minlength=n) / np.maximum(np.bincount(pair_of, minlength=n), 1)
    rest = np.zeros((n, 6))
    for i, t in enumerate(texts):
        ws = t.split()
        if not ws:
            continue
        lengths = np.fromiter(map(len, ws), np.int64, len(ws))
        lines = [x for x in t.split(b"\n") if x.strip()]
        rest[i] = lengths.std(), len(lines), len(t) / len(lines), 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), sum(map(bytes.isupper, ws)) / len(ws)
    columns = [*(kinds[:, k] / chars for k in range(KINDS)), pipes / chars, np.log1p(sizes), np.log1p(counts), (sizes - kinds[:, 3]) / words, rest[:, 0], distinct / words, top / words, same / words, pair_share, np.log1p(rest[:, 1]), np.log1p(rest[:, 2]), rest[:, 3], rest[:, 4], rest[:, 5], np.log1p(counts / np.maximum(stops, 1))]
    return np.stack(columns, axis=1).astype(np.float32)


class Trees:
    """Boosted complete trees in flat arrays: feature and threshold of inner nodes, value of leaves."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.feature: np.ndarray = np.zeros((0, (1 << depth) - 1), np.int32)
        self.threshold: np.ndarray = np.zeros((0, (1 << depth) - 1), np.float32)
        self.value: np.ndarray = np.zeros((0, 1 << depth))

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.2, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Trees for the probability of y = 1, grown level by level from histograms of gradients."""
    share = (y.sum() + 1) / (len(y) + 2)
    trees = Trees(float(np.log(share / (1 - share))), depth)
    if len(y) == 0 or y.min() == y.max():
        return trees
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)).astype(np.float32) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    wide = np.array([[len(e)] for e in edges])
    total = np.full(len(y), trees.base)
    offset = np.arange(x.shape[1]) * BINS
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros((1 << depth) - 1, np.int32), np.full((1 << depth) - 1, np.inf, np.float32)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * (x.shape[1] * BINS) + offset + bins).ravel()
            size = count * x.shape[1] * BINS
            hist = [np.bincount(cell, np.repeat(v, x.shape[1]), size).reshape(count, x.shape[1], BINS) for v in (g, h)]
            gl, hl = (np.cumsum(v, axis=2) for v in hist)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least) | (np.arange(BINS) >= wide)] = -np.inf
            flat = gain.reshape(count, -1)
            best = flat.argmax(axis=1)
            good = flat[np.arange(count), best] > 1e-6
            j, b = best // BINS, best % BINS
            feature[first : first + count] = np.where(good, j, 0)
            threshold[first : first + count] = [edges[a][c] if ok else np.inf for a, c, ok in zip(j, b, good)]
            at = node - first
            node = 2 * node + 1 + (good[at] & (bins[np.arange(len(y)), j[at]] > b[at]))
        leaf = node - len(feature)
        value = -rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    trees.feature, trees.threshold, trees.value = np.stack(features), np.stack(thresholds), np.stack(values)
    return trees


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", every: int = 5, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(F.col(f"`{id_col}`"), every).alias("held_out"), C.text_or_empty(f"`{text_col}`").alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "text"):
                rows = statistics(C.text_bytes(part.column("text")))
                offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], ["doc_id", "held_out", "x"])

    table = C.materialize(plain.mapInArrow(measured, "doc_id long, held_out boolean, x array<float>"))
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL").filter(~held_out(F.col("doc_id"), every))
    total = known.count()
    part = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.95 * sample / max(total, 1)))) if total > sample else known
    rows = table.filter("NOT held_out").join(part, "doc_id").select("doc_id", "x", "y").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample).collect()  # at most `sample` rows
    x, y = np.array([r.x for r in rows], np.float32).reshape(len(rows), len(NAMES)), np.array([r.y for r in rows], float)
    trees = docs.sparkSession.sparkContext.broadcast(fit(x, y))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            score = trees.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return table.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
