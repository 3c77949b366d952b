"""LM scoring: subword lattice likelihood.

The model generates a text as a row of pieces of an existing subword vocabulary and then an end. A piece's probability is the
score of its place in the vocabulary at first (that of rank r falls as 1 / (r + 100)), and is then fitted to the
training texts by `rounds` rounds of expectation maximisation over all segmentations. A text's probability is the sum over all
segmentations of its words, each with a space before it, into pieces: pieces hold no inner space, so that it is the product of
the words' probabilities and the end's. A word's probability is found by forward recursion in log space over its bytes; all
single bytes are pieces, so every text has one.

Beside it stands a plain unigram model of words with additive smoothing.

Only distinct words are scored. Counts of words are gathered over all training texts, words and their scores make a table that
grows with the input. The `frequent` words of the largest counts (a fixed bound of 200,000) are broadcast, the other
words of each text meet the table in a join, where no word is frequent enough to make a hot key. Piece counts are summed over
tasks, at most one row a piece. The fit, the counts and the scores cover all texts.

Null and empty texts have the end alone. A text is held out of training by the CRC-32 of its id; a null id counts as the text
"null". Each input row is scored by itself, repeated rows and ids included. Empty tables give no rows; with no training rows,
counts are 0 and the vocabulary's scores stay as they are. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Bytes of the longest usable piece of the default vocabulary; that of any vocabulary is Pieces.longest, no piece is left out for its length.
LONGEST = 33
#: Up to so many bytes, expected counts are taken from plain probabilities.
PLAIN = 24
#: Longer words are walked in blocks of about so many lattice rows, whatever their length.
WALK = 1 << 12
FREQUENT, FREQUENT_BYTES = 200_000, 64
FLUSH = 200_000
#: Words and bytes of words that are walked at once: with a batch's thousand words a length has a few dozen, too few for operations on arrays.
GATHER, GATHER_BYTES = 1 << 15, 1 << 22
END = " "


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


_SPREAD = {22: np.uint64(0x9E3779B97F4A7C15), 18: np.uint64(0xC2B2AE3D27D4EB4F)}


def _roll(rows: np.ndarray) -> np.ndarray:
    """Hash sums of the prefixes of each row of bytes."""
    up, _ = C._powers_to(rows.shape[1] + 1)
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * up[: rows.shape[1]], axis=1, out=out[:, 1:])
    return out


class Pieces:
    """The vocabulary's pieces that a lower-cased word can hold (no inner space, no A-Z), of any length, found by their hashes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranked = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]
        kept = [(p, r) for p, r in ranked if b" " not in p[1:] and not any(C._IS_SPACE[c] for c in p[1:]) and p == p.lower() or len(p) == 1]
        self.n = len(kept)
        self.sizes = sorted({len(p) for p, _ in kept})
        self.longest = self.sizes[-1]
        weights = 1.0 / (np.array([r for _, r in kept]) + 100.0)
        self.start = np.log(weights / weights.sum())
        hashes = np.zeros(self.n, np.uint64)
        for n in self.sizes:
            here = [i for i, (p, _) in enumerate(kept) if len(p) == n]
            rows = np.frombuffer(b"".join(kept[i][0] for i in here), np.uint8).reshape(len(here), n)
            hashes[here] = _roll(rows)[:, n] + np.uint64(n)
        #: A place for each piece by bits of its hash; those whose place is taken go to a smaller table with places of their own.
        self.first, rest = self._table(hashes, np.arange(self.n), 22)
        self.second, rest = self._table(hashes, rest, 18)
        self.last = [(hashes[i], int(i)) for i in rest]
        self.taken = self.first < self.n  # a smaller table, for the many hashes of no piece
        self.hashes = np.append(hashes, np.uint64(0))  # that of none is never asked for: a hash of 0 belongs to no text

    @staticmethod
    def _table(hashes: np.ndarray, which: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """A table of 2**bits places, and the pieces that found theirs taken."""
        table = np.full(1 << bits, len(hashes), np.int32)
        place = ((hashes[which] * _SPREAD[bits]) >> np.uint64(64 - bits)).astype(np.int64)
        table[place[::-1]] = which[::-1]
        return table, which[table[place] != which]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The pieces of the hashes, or n for none."""
        place = ((hashes * _SPREAD[22]) >> np.uint64(42)).ravel()
        out = np.full(hashes.shape, self.n, np.int32)
        some = np.flatnonzero(self.taken[place])
        asked = hashes.ravel()[some]
        found = self.first[place[some]]
        miss = np.flatnonzero(self.hashes[found] != asked)  # a piece's place is taken, by itself or by another
        other = self.second[(asked[miss] * _SPREAD[18]) >> np.uint64(46)]
        found[miss] = np.where(self.hashes[other] == asked[miss], other, self.n)
        for h, i in self.last:
            found[asked == h] = i
        out.ravel()[some] = found
        return out

    def lattice(self, rows: np.ndarray) -> np.ndarray:
        """For rows of n bytes: the piece (or n of all pieces: none) that ends at each byte with each length, [rows, n, the longest that fits]."""
        count, n = rows.shape
        sums = _roll(rows)
        _, down = C._powers_to(n + 1)
        out = np.full((count, n, min(n, self.longest)), self.n, np.int32)
        for size in (k for k in self.sizes if k <= n):
            out[:, size - 1 :, size - 1] = self.find((sums[:, size:] - sums[:, : n - size + 1]) * down[: n - size + 1] + np.uint64(size))
        return out


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _log_sum(x: np.ndarray) -> np.ndarray:
    most = x.max(axis=-1)
    with np.errstate(divide="ignore"):
        return most + np.log(np.exp(x - most[..., None]).sum(axis=-1))


LOW = -1e30


def _forward(scores: np.ndarray) -> np.ndarray:
    """Log sums over all segmentations of each row's prefixes: [rows, n + longest], the empty prefix at longest - 1."""
    count, n, longest = scores.shape
    alpha = np.full((count, n + longest), LOW)
    alpha[:, longest - 1] = 0
    for i in range(n):  # pieces of 1, 2, ... bytes that end here begin at i, i - 1, ...
        alpha[:, longest + i] = _log_sum(alpha[:, i : i + longest][:, ::-1] + scores[:, i])
    return alpha


def _pieces_in(vocabulary: Pieces, rows: np.ndarray, a: int, b: int) -> np.ndarray:
    """What `lattice` says of the bytes from a to b alone, always [rows, b - a, longest]."""
    found = vocabulary.lattice(rows[:, a:b])
    return np.pad(found, ((0, 0), (0, 0), (0, vocabulary.longest - found.shape[2])), constant_values=vocabulary.n)


def _walk_ahead(rows: np.ndarray, vocabulary: Pieces, log_p: np.ndarray) -> np.ndarray:
    """What `_forward` gives, for words of any length: the lattice is made and left block by block, only sums stay."""
    (count, n), longest = rows.shape, vocabulary.longest
    alpha = np.full((count, n + longest), LOW)
    alpha[:, longest - 1] = 0
    step = max(longest, WALK // count)
    for a in range(0, n, step):
        b, low = min(n, a + step), max(0, a - longest + 1)
        scores = log_p[_pieces_in(vocabulary, rows, low, b)[:, a - low :]]
        for i in range(a, b):
            alpha[:, longest + i] = _log_sum(alpha[:, i : i + longest][:, ::-1] + scores[:, i - a])
    return alpha


def _walk_back(rows: np.ndarray, times: np.ndarray, vocabulary: Pieces, log_p: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in words of any length, from their ends on, block by block."""
    (count, n), longest = rows.shape, vocabulary.longest
    alpha, beta, total = _walk_ahead(rows, vocabulary, log_p), np.full((count, n + longest), LOW), np.zeros(vocabulary.n + 1)
    beta[:, n] = 0
    step = max(longest, WALK // count)
    for a in reversed(range(0, n, step)):
        b = min(n, a + step)
        found = _pieces_in(vocabulary, rows, a, min(n, b + longest - 1))
        starting = np.full((count, b - a, longest), vocabulary.n, np.int32)  # by where a piece begins
        for k in range(longest):
            here = found[:, k : k + b - a, k]
            starting[:, : here.shape[1], k] = here
        scores = log_p[starting]
        for i in range(b - 1, a - 1, -1):
            beta[:, i] = _log_sum(beta[:, i + 1 : i + 1 + longest] + scores[:, i - a])
        word, i, k = np.nonzero(starting < vocabulary.n)
        share = np.exp(alpha[word, longest - 1 + a + i] + scores[word, i, k] + beta[word, a + i + k + 1] - alpha[word, -1])
        total += np.bincount(starting[word, i, k], share * times[word], vocabulary.n + 1)
    return total


def _groups(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of bytes of words of one length, with a space in front, and the words' places; about 2 million lattice cells at a time."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        n = int(sizes[order[a]]) + 1
        step = max(1, (1 << 14) // n)
        for c in range(a, b, step):
            at = order[c : min(b, c + step)]
            yield np.frombuffer(b"".join(b" " + words[i] for i in at.tolist()), np.uint8).reshape(len(at), n), at


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, consecutive batches as one until they have GATHER words or GATHER_BYTES bytes."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        size += batch.column("word").nbytes
        if rows >= GATHER or size >= GATHER_BYTES:
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def word_scores(words: list[bytes], vocabulary: Pieces, log_p: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability; log_p has one place more than pieces, for none."""
    out = np.zeros(len(words))
    for rows, at in _groups(words):
        long = rows.size > WALK * 4 or rows.shape[1] > 4 * PLAIN
        alpha = _walk_ahead(rows, vocabulary, log_p) if long else _forward(log_p[vocabulary.lattice(rows)])
        out[at] = alpha[:, -1]
    return out


def expected_counts(words: list[bytes], times: np.ndarray, vocabulary: Pieces, log_p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, each taken so many times."""
    total, p = np.zeros(vocabulary.n + 1), np.exp(log_p)
    p[-1] = 0
    for rows, at in _groups(words):
        if rows.shape[1] > PLAIN:
            total += _walk_back(rows, times[at], vocabulary, log_p)
            continue
        found = vocabulary.lattice(rows)
        count, n, longest = found.shape
        part = p[found]  # of short words no product underflows, so that counts need no logarithms
        ahead = np.zeros_like(part)
        for k in range(longest):
            ahead[:, : n - k, k] = part[:, k:, k]
        alpha, beta = np.zeros((count, n + longest)), np.zeros((count, n + longest))
        alpha[:, longest - 1] = beta[:, n] = 1
        for i in range(n):
            alpha[:, longest + i] = np.einsum("rk,rk->r", alpha[:, i : i + longest][:, ::-1], part[:, i])
            j = n - 1 - i
            beta[:, j] = np.einsum("rk,rk->r", beta[:, j + 1 : j + 1 + longest], ahead[:, j])
        after = beta[:, 1 : n + 1] * (times[at] / alpha[:, -1])[:, None]
        for k in range(longest):
            part[:, :, k] *= alpha[:, longest - 1 - k : longest - 1 - k + n] * after
        total += np.bincount(found.ravel(), part.ravel(), vocabulary.n + 1)
    return total[:-1]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words, in all texts and in training texts; END is counted once a text."""
    counts: dict[bytes, list[int]] = {}

    def out() -> pa.RecordBatch:
        values = list(counts.values())
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())], ["word", "total", "trained"])

    end = END.encode()
    for batch in batches:
        for part in C.slices(batch, "text"):
            for text, held in zip(C.text_bytes(part.column("text")), part.column("held_out").to_pylist()):
                more = 0 if held else 1
                for w in [*text.lower().split(), end]:
                    v = counts.get(w)
                    if v is None:
                        counts[w] = [1, more]
                    else:
                        v[0] += 1
                        v[1] += more
            if len(counts) > FLUSH:
                yield out()
                counts = {}
    if counts:
        yield out()


def held_out(id_col: Column, every: int = 10) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")) % every == 0


def fit(words: DataFrame, vocabulary: str, rounds: int) -> tuple[np.ndarray, float]:
    """Log probabilities of all pieces (and LOW for none), and of the end, from the training counts of words (word, trained)."""
    known = pieces(vocabulary)
    inner = words.filter((F.col("trained") > 0) & (F.col("word") != F.lit(END).cast("binary")))
    texts = words.filter(F.col("word") == F.lit(END).cast("binary")).agg(F.coalesce(F.sum("trained"), F.lit(0))).first()[0]
    log_p, log_end = np.append(known.start, LOW), math.log(1e-3)
    log_p[:-1] += math.log1p(-1e-3)
    for _ in range(rounds if texts else 0):
        shared = words.sparkSession.sparkContext.broadcast(log_p)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v, total = pieces(vocabulary), None
            for batch in _gathered(batches):
                here = expected_counts(batch.column("word").to_pylist(), batch.column("trained").to_numpy(), v, shared.value)
                total = here if total is None else total + here
            if total is not None:
                some = np.flatnonzero(total > 0)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["piece", "n"])

        counts = np.full(known.n, 0.1)
        for row in inner.select("word", "trained").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # a row a piece
            counts[row.piece] += row.n
        whole = counts.sum() + texts
        log_p, log_end = np.append(np.log(counts / whole), LOW), math.log(texts / whole)
    return log_p, log_end


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, rounds: int = 4, frequent: int = FREQUENT, every: int = 10) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(F.col(f"`{id_col}`"), every).alias("held_out"), C.text_or_empty(f"`{text_col}`").alias("text"))
    counted = plain.select("text", "held_out").mapInArrow(_count_words, "word binary, total long, trained long")
    words = C.materialize(counted.groupBy("word").agg(F.sum("total").alias("total"), F.sum("trained").alias("trained")))
    tokens, distinct = words.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count(F.when(F.col("trained") > 0, 1))).first()
    log_p, log_end = fit(words, path, rounds)
    shared, end = spark.sparkContext.broadcast(log_p), END.encode()
    denominator = math.log10(tokens + 0.1 * (distinct + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path)
        for batch in _gathered(batches):
            ws, c = batch.column("word").to_pylist(), batch.column("trained").to_numpy()
            model = word_scores(ws, v, shared.value)
            model[[i for i, w in enumerate(ws) if w == end]] = log_end
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("total"), pa.array((c > 0).astype(np.int64)), pa.array(np.log10(c + 0.1) - denominator), pa.array(model / math.log(10))], ["word", "total", "known", "base", "model"])

    table = C.materialize(words.mapInArrow(scored, "word binary, total long, known long, base double, model double"))
    level = F.when(F.octet_length("word") <= FREQUENT_BYTES, F.floor(F.log2("total") * 16)).otherwise(-1)
    limit, above = 0, 0  # longer words are met by the join below
    for row in table.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred rows
        if above + row["count"] > frequent:
            limit = row["level"] + 1
            break
        above += row["count"]
    top = table.filter(level >= limit).select("word", "known", "base", "model").toPandas()  # at most `frequent` rows of at most FREQUENT_BYTES
    index = {w: i for i, w in enumerate(map(bytes, top["word"]))}
    values = spark.sparkContext.broadcast((index, np.vstack([top[["known", "base", "model"]].to_numpy(np.float64), np.zeros((1, 3))])))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with the sums over frequent words of each text, which is also the first of its other words', and a row for each further one."""
        (index, value), row = values.value, TaskContext.get().partitionId() << 33
        none, get = len(index), index.get
        for batch in batches:
            for part in C.slices(batch, "text", 1 << 20):
                keys, times, owner, first = [], [], [], []
                each = [[*t.lower().split(), end] for t in C.text_bytes(part.column("text"))]
                sizes = np.array([len(ws) for ws in each])
                codes = np.fromiter(map(get, chain.from_iterable(each), repeat(none)), np.int64, int(sizes.sum()))
                starts = np.cumsum(sizes) - sizes
                sums = np.add.reduceat(value[codes], starts, axis=0)
                for i, ws in enumerate(each):
                    other: dict[bytes, int] = {}
                    for k in np.flatnonzero(codes[starts[i] : starts[i] + sizes[i]] == none).tolist():
                        other[ws[k]] = other.get(ws[k], 0) + 1
                    first.append(len(keys))
                    keys.extend(other or [b"  %d" % (row + i)])  # a text without other words has a key of its own, which is no word
                    times.extend(other.values() if other else [0])
                    owner.extend([i] * max(1, len(other)))
                owner, lead = np.array(owner), np.zeros(len(keys), bool)
                lead[first] = True
                at = np.where(lead, owner, len(each))
                sums, sizes = np.vstack([sums, np.zeros((1, 3))]), np.append(sizes, 0)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(row + owner), part.column("doc_id").take(take), part.column("held_out").take(take), pa.array(keys, pa.binary()), pa.array(times, pa.int64()), pa.array(sizes[at]), pa.array(sums[at, 0].astype(np.int64)), pa.array(sums[at, 1]), pa.array(sums[at, 2])], ["row", "doc_id", "held_out", "word", "times", "n", "k", "b", "m"])
                row += len(each)

    parts = plain.mapInArrow(texts, "row long, doc_id long, held_out boolean, word binary, times long, n long, k long, b double, m double")
    met = parts.join(table.filter(level < limit).select("word", "known", "base", "model"), "word", "left")
    add = lambda own, name: F.sum(F.col(own) + F.coalesce(F.col("times") * F.col(name), F.lit(0)))
    out = met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("n").alias("n_tokens"), add("k", "known").cast("long").alias("n_known"), add("b", "base").alias("base_score"), add("m", "model").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(C.table(spark, sf_dir, "documents"))


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
