"""Substring deduplication: sliding sentence spans.

A text is cut into sentences, and these at their inner stops, so that little is left of a passage that begins or ends inside
a sentence: after any of `.!?…,;:` before white space, after full-width stops, and at line ends. A part of more than 16 words
is cut further, before each word whose hash is the least of some 9 neighbouring words of the part. Such a cut depends on
words nearby only, so that copies of a passage are cut alike but for at most 16 words at its beginning and 17 at its end: 50 repeated
words always hold at least 17 words in two or more equal parts, which is a run. Each character of scripts without spaces
(Chinese, Japanese, Thai, Lao, Burmese, Khmer) is a word to the cuts, and half a word to the lengths of runs, so that this holds for 100 such characters.
All texts of a slice are cut at once, by operations on whole arrays of their UTF-16 units.
What is said of sentences below holds for these parts. A run starts at each sentence and takes as many as are needed to hold `least` sentences with `min_words` words
together, or `long_words` words; and likewise backwards from each sentence, so that a repeated passage is covered up to both of its
ends. Runs are hashed over their words (A-Z lower-cased) to 128 bits, the hashes are joined over all documents, and every sentence
that a run covers which is not the first with its hash, by doc_id and place, is removed together with the white space
behind it. A passage that many documents share thus stays in the first of them.

The first scan of the texts fills a bounded Bloom filter straight from the runs' hashes; the second makes the runs again and
writes only those that the filter takes for possibly repeated. Their first places are found by partial
aggregation, and meet the runs again in a join whose sides both come from tables, so that a hot hash can be split. Only documents that lose sentences shuffle with their texts: a bounded Bloom filter lets
the others pass straight through. No run, document or passage is capped.

Null and empty texts have no sentences; a null text stays null. Null doc_ids come after all others. Repeated rows (same
id and text) are one document and share their result. An empty table gives an empty result. Extra columns are kept, but
for those named like the three that are added (n_sentences, n_removed, removed_spans), which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import exact_dedup

#: Of so many neighbouring words, the one with the least hash begins a part, in parts of more than 2 * WINDOW - 2 words.
WINDOW = 9
STOPS, FULL_STOPS = ".!?…,;:", "。！？，、；：．｡､"
#: Scripts that put no spaces between words: first and last characters. Those beyond U+FFFF are told by their high surrogates.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0xD840, 0xD87F)]
_SPACE, _PLAIN, _SINGLE, _FULL = range(4)
_KIND = np.full(1 << 16, _PLAIN, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
for _a, _b in UNSPACED:
    _KIND[_a : _b + 1] = _SINGLE
_KIND[[ord(c) for c in FULL_STOPS]] = _FULL
_STOP = np.zeros(1 << 16, bool)
_STOP[[ord(c) for c in STOPS + FULL_STOPS]] = True


#: For the size of the filter alone: about so many bytes of text make a run.
RUN_BYTES = 16


class Parts(NamedTuple):
    """The parts of some texts, one after another: own text, start, end and end with the white space behind it (in UTF-16 units of the text), length in words, two hashes of the words; and how many parts each text has."""

    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    stop: np.ndarray
    words: np.ndarray
    hashes: np.ndarray
    seconds: np.ndarray
    number: np.ndarray


def parts_of(texts: list[str]) -> Parts:
    raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n\0".join(raw) + b"\n\0", np.uint16)
    limits = np.cumsum([0, *(len(x) // 2 + 1 for x in raw)])
    kind, low = _KIND[data], (data & 0xFC00) == 0xDC00
    for i in np.flatnonzero(low).tolist():  # the second half of a character goes with the first
        kind[i] = max(kind[i - 1], _PLAIN) if i else _PLAIN
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
    begins = ((kind == _SINGLE) | (kind == _PLAIN) & (before != _PLAIN) | (kind == _FULL) & (before == _SPACE)) & ~low
    edges = np.flatnonzero(begins | (kind == _SPACE) & (before != _SPACE))
    at = np.flatnonzero(begins[edges])
    starts = edges[at]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Parts(none, none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), np.zeros(len(texts), np.int64))
    ends = edges[at + 1]
    lower = data + (((data >= 65) & (data <= 90)).astype(np.uint16) << 5)
    words = C.span_hashes(lower.view(np.uint8), 2 * starts, 2 * ends)
    text = np.searchsorted(limits, starts, "right") - 1
    last, gap = data[ends[:-1] - 1], starts[1:] > ends[:-1]
    lines = np.append(np.flatnonzero(data == 10), len(data))
    line = lines[np.searchsorted(lines, ends[:-1])] < starts[1:]
    cut = np.concatenate([np.ones(1, bool), (text[1:] != text[:-1]) | gap & (_STOP[last] | line) | ~gap & (_KIND[last] == _FULL)])
    part = np.cumsum(cut) - 1
    long = np.bincount(part) > 2 * WINDOW - 2
    windows = np.flatnonzero((part[: 1 - WINDOW] == part[WINDOW - 1 :]) & long[part[: 1 - WINDOW]]) if len(words) >= WINDOW else np.zeros(0, np.int64)
    if len(windows):
        near = np.lib.stride_tricks.sliding_window_view(words[::-1], WINDOW)[::-1]  # from a window's last word on
        cut[windows + WINDOW - 1 - near[windows].argmin(axis=1)] = True  # the last of equals
    first = np.flatnonzero(cut)
    n = np.diff(np.append(first, len(starts)))
    owner = text[first]
    mixed = C.mix(words ^ C.mix((np.arange(len(words)) - np.repeat(first, n)).astype(np.uint64)))
    hashes = C.mix(np.add.reduceat(mixed, first) + n.astype(np.uint64))
    seconds = C.mix(np.add.reduceat(C.mix(mixed ^ np.uint64(0xA0761D6478BD642F)), first) + n.astype(np.uint64))
    single = np.add.reduceat((kind[starts] == _SINGLE).astype(np.int64), first)
    start, end = starts[first], ends[first + n - 1]
    stop = np.minimum(np.append(start[1:], len(data)), limits[owner + 1] - 1)
    base = limits[owner]
    return Parts(owner, start - base, end - base, stop - base, n - single + (single + 1) // 2, hashes, seconds, np.bincount(owner, minlength=len(texts)))


def sentences(text: str) -> list[tuple[int, int, int]]:
    """Start, end and end with the white space behind it of each part of one text, in characters."""
    p = parts_of([text])
    second = np.array([ord(c) > 0xFFFF for c in text], np.int64)
    place = np.append(np.repeat(np.arange(len(text)), 1 + second), len(text))
    return [(int(place[a]), int(place[b]), int(place[c])) for a, b, c in zip(p.start, p.end, p.stop)]


def runs(p: Parts, least: int, min_words: int, long_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last part and the two hashes of all shortest runs, forwards and backwards."""
    n = len(p.hashes)
    if not n:
        return p.start, p.start, p.hashes, p.hashes
    cum = np.concatenate([[0], np.cumsum(p.words)])
    at = np.arange(n)
    to = lambda k: np.searchsorted(cum, cum[:-1] + k, "left") - 1  # noqa: E731  last sentence with which k words are there
    last = np.minimum(np.maximum(at + least - 1, to(min_words)), to(long_words))
    back = lambda k: np.searchsorted(cum, cum[1:] - k, "right") - 1  # noqa: E731  first sentence from which k words are there
    first = np.maximum(np.minimum(at - least + 1, back(min_words)), back(long_words))
    start, end = np.concatenate([at, first]), np.concatenate([last, at])
    inside = (start >= 0) & (end < n)
    start, end = start[inside], end[inside]
    inside = p.owner[start] == p.owner[end]
    both = np.unique(start[inside] * np.int64(n) + end[inside])
    start, end = both // n, both % n
    up, down = C._powers_to(n + 1)
    out = []
    for hashes in (p.hashes, p.seconds):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:n])])
        out.append(C.mix((sums[end + 1] - sums[start]) * down[start] + (end - start + 1).astype(np.uint64)))
    return start, end, out[0], out[1]


def _texts(part: pa.RecordBatch, text: str | int) -> list[str]:
    return [x or "" for x in part.column(text).to_pylist()]


def _run_hashes(lengths: tuple[int, int, int]) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    def of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in C.slices(batch, "text"):
            yield runs(parts_of(_texts(part, "text")), *lengths)[2].view(np.int64)

    return of


def _possible_runs(lengths: tuple[int, int, int], bloom: exact_dedup.Filter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    maybe = bloom.tester()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in C.slices(batch, "text")):
            p = parts_of(_texts(part, "text"))
            start, end, h, g = runs(p, *lengths)
            some = np.flatnonzero(maybe(h.view(np.int64)))
            start, end, h, g = start[some], end[some], h[some], g[some]
            own, begin = p.owner[start], np.cumsum(p.number) - p.number
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), part.column("o").take(pa.array(own)), part.column("doc").take(pa.array(own)), pa.array((start - begin[own]).astype(np.int32)), pa.array((end - begin[own]).astype(np.int32))], ["h", "g", "o", "doc", "first", "last"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, min_words: int = 16, long_words: int = 30, **bloom_size: int) -> DataFrame:
    """docs with their texts freed of repeated spans, and n_sentences, n_removed, removed_spans (first and last sentence; null where nothing is removed)."""
    added = ["n_sentences", "n_removed", "removed_spans"]
    docs = docs.drop(*added)
    doc = F.xxhash64(F.col(f"`{id_col}`").cast("long"), C.text_or_empty(f"`{text_col}`"))
    order = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1))
    keyed = docs.select(C.text_or_empty(f"`{text_col}`").alias("text"), order.alias("o"), doc.alias("doc"))
    lengths = (least, min_words, long_words)
    key, own_order, maybe, cut = (C.free(n, docs) for n in ("__doc", "__order", "__maybe", "__spans"))
    with C.scratch(docs.sparkSession) as keep:
        size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bloom = exact_dedup.build(keyed.select("text"), size // RUN_BYTES, repeated=True, of=_run_hashes(lengths), **bloom_size)
        found = C.materialize(keyed.mapInArrow(_possible_runs(lengths, bloom), "h long, g long, o long, doc long, first int, last int"))
        place = F.struct("o", "doc", "first")
        again = found.groupBy("h", "g").agg(F.min(place).alias("least"), F.count("*").alias("n")).filter("n > 1").select("h", "g", "least")
        again = C.materialize(again)
        spans = found.join(again, ["h", "g"]).filter(place != F.col("least")).select("o", "doc", F.struct("first", "last").alias("span")).distinct()
        spans = keep(C.materialize(spans.groupBy(F.col("o").alias(own_order), F.col("doc").alias(key)).agg(F.sort_array(F.collect_list("span")).alias(cut))))  # of one document
    bloom = exact_dedup.build(spans.select(key), spans.count(), repeated=False, **bloom_size)
    flagged = docs.withColumn(key, doc).withColumn(own_order, order).withColumn(maybe, bloom.probe(F.col(key)))
    own = [F.col(f"`{c}`") for c in docs.columns]
    passed = flagged.filter(~F.col(maybe)).select(*own, F.lit(None).cast("array<struct<first:int,last:int>>").alias(cut))
    met = flagged.filter(F.col(maybe)).join(spans, [own_order, key], "left").select(*own, cut)
    names, at = docs.columns, docs.columns.index(text_col)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in C.slices(batch, text_col)):
            p, texts, gone = parts_of(_texts(part, at)), part.column(at).to_pylist(), [0] * part.num_rows
            begin = np.cumsum(p.number) - p.number
            for i, spans in enumerate(part.column(len(names)).to_pylist()):
                if spans:
                    out = np.zeros(p.number[i] + 1, np.int64)
                    for s in spans:
                        out[s["first"]] += 1
                        out[s["last"] + 1] -= 1
                    out = np.cumsum(out[:-1]) > 0
                    raw, own = texts[i].encode("utf-16-le", "surrogatepass"), slice(begin[i], begin[i] + p.number[i])
                    start, stop = (2 * p.start[own]).tolist(), (2 * p.stop[own]).tolist()
                    texts[i] = (raw[: start[0]] + b"".join(raw[a:c] for a, c, x in zip(start, stop, out.tolist()) if not x)).decode("utf-16-le", "surrogatepass")
                    gone[i] = int(out.sum())
            columns = [part.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p.number, pa.int64()), pa.array(gone, pa.int64()), part.column(len(names))], [*names, *added])

    kinds = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema.fields)
    return passed.union(met).mapInArrow(cut_out, f"{kinds}, n_sentences long, n_removed long, removed_spans array<struct<first:int,last:int>>")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "text", "n_sentences", "n_removed")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
