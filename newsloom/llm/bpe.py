"""BPE encoding and decoding: batched numpy merge rounds.

Texts are brought to the vocabulary's form (NFC, lower case; white space only parts words), cut at white space and then into
words by its pattern, and the distinct words of a slice are encoded together. The symbols of all words lie in one flat array. In each round, the
rank of every pair of neighbours inside a word is found by binary search over the sorted pair keys, each word merges all
its pairs of its lowest rank (from the left where they overlap), and words without a known pair are done. A pair made of a merged symbol always
has a higher rank than the merge itself, which `Vocabulary` checks, so that rounds give what one merge at a time gives.

What stands between white space is kept with its ids for later slices, unless it is longer than KEPT_CHARS, up to KEPT_BYTES in all. Special tokens are found in the raw text first, as the
vocabulary file says. Decoding joins the tokens' strings by one space, since the file names no decoder.

Null and empty texts have no tokens. Repeated rows, null ids and extra columns do not matter: the rows of the result follow those of
the input. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: What is kept between slices: chunks of so many characters at most, and so many bytes in all (with some 250 for an entry).
KEPT_CHARS, KEPT_BYTES, ENTRY = 200, 96 << 20, 250
#: Python takes these for white space, the vocabulary's patterns do not.
NOT_WHITE = regex.compile(r"[\x1c-\x1f]")
WHITE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary with word ends, read from a file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.first = np.array([ids[x] for x in letters], np.int64)
        self.last = np.array([ids[x + suffix] for x in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        joined = lambda a, b: ids[a + b]
        left, right = (np.array([ids[m[i]] for m in merges], np.int64) for i in (0, 1))
        new = np.array([joined(a, b) for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.new = keys[order], order, new
        made = np.full(max(ids.values()) + 1, -1, np.int64)
        made[new[::-1]] = np.arange(len(new))[::-1]  # the first merge that makes a symbol
        if (np.maximum(made[left], made[right]) >= np.arange(len(new))).any():
            raise ValueError("a merge of this vocabulary comes before the symbols it joins")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = np.empty(max([*ids.values(), *self.special.values()]) + 1, object)
        for s, i in [*ids.items(), *self.special.items()]:
            self.strings[i] = s
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))

    def chunks(self, text: str) -> list[str]:
        """What stands between white space in a text, normalised; special tokens stand for themselves, marked by a NUL.

        No word holds white space, so that chunks can be cut into words, and kept, one by one.
        """
        parts = self.split.split(text) if self.split else [text]
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append("\0" + part)  # a chunk of the text that begins with a NUL gets another
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            found = [w for w in WHITE.split(part) if w] if NOT_WHITE.search(part) else part.split()
            out.extend("\0" + w if w[0] == "\0" else w for w in found) if "\0" in part else out.extend(found)
        return out

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each of the words, by merge rounds over all of them at once."""
        if not words:
            return []
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(b) for b in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.first[data]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        none = len(self.ranks)
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, starts)
            least = np.repeat(least, np.diff(np.append(starts, len(symbols))))
            open_ = least < none
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_owner.append(owner[~open_])
                symbols, owner, rank, least = symbols[open_], owner[open_], rank[open_], least[open_]
                if not len(symbols):
                    break
            hit = rank == least
            run_start = hit & ~np.append(False, hit[:-1])
            index = np.arange(len(hit))
            begin = np.maximum.accumulate(np.where(run_start, index, -1))
            hit &= (index - begin) % 2 == 0
            symbols = np.where(hit, self.new[np.minimum(rank, none - 1)], symbols)
            keep = ~np.append(False, hit[:-1])
            symbols, owner = symbols[keep], owner[keep]
        flat, whose = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(whose, kind="stable")
        flat, ends = flat[order], np.cumsum(np.bincount(whose, minlength=len(words))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.strings[ids])


class Coder:
    """Encodes and decodes texts; keeps the words it has met."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, np.ndarray] = {}
        self.kept, self.long = 0, []

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The chunks of each text, all of which are then in `known`."""
        v = self.vocabulary
        each = [v.chunks(t) for t in texts]
        for w in self.long:
            self.known.pop(w, None)
        if self.kept > KEPT_BYTES:
            self.known.clear()
            self.kept = 0
        new = list(set().union(*each).difference(self.known))
        words = [v.pattern.findall(w[1:] if w[0] == "\0" else w) for w in new]
        distinct = list(dict.fromkeys(w for ws in words for w in ws))
        ids = dict(zip(distinct, v.encode_words(distinct)))
        for chunk, ws in zip(new, words):
            if chunk[0] == "\0" and chunk[1:2] != "\0":
                self.known[chunk] = np.array([v.special[chunk[1:]]])
            else:
                self.known[chunk] = ids[ws[0]] if len(ws) == 1 else np.concatenate([ids[w] for w in ws] or [np.zeros(0, np.int64)])
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        self.long = [new[i] for i in np.flatnonzero(sizes > KEPT_CHARS).tolist()]
        self.kept += int((ENTRY + 9 * sizes[sizes <= KEPT_CHARS]).sum())  # an id stands for a character at least
        return each

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        known, none = self.known, [np.zeros(0, np.int64)]
        return [np.concatenate([known[w] for w in ws] or none) for ws in self.learn(texts)]


@cache
def coder(path: str) -> Coder:
    return Coder(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each document."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "text"):
                ids = coder(path).encode([x or "" for x in part.column("text").to_pylist()])
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))], ["doc_id", "ids"])

    return _plain(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids are none."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = coder(path).vocabulary
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([v.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), C.text_or_empty(f"`{text_col}`").alias("text"))


def _digests(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ids and decoded strings of words are put together once a word, then joined for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        name = [str(i) for i in range(len(c.vocabulary.strings))].__getitem__
        numbers: dict[str, str] = {}
        strings: dict[str, str] = {}
        silent: set[str] = set()  # words without ids
        kept = 0
        for batch in batches:
            for part in C.slices(batch, "text"):
                each = c.learn([x or "" for x in part.column("text").to_pylist()])
                if kept > KEPT_BYTES:
                    numbers.clear()
                    strings.clear()
                    silent.clear()
                    kept = 0
                distinct = set().union(*each)
                new = distinct.difference(numbers)
                long = []
                for w in new:
                    ids = c.known[w].tolist()
                    numbers[w] = digits = " ".join(map(name, ids)) if len(ids) != 1 else name(ids[0])
                    strings[w] = string = c.vocabulary.decode(c.known[w])
                    kept += 2 * ENTRY + len(digits) + len(string)
                    if len(w) > KEPT_CHARS:
                        long.append(w)
                silent.update(w for w in new if not numbers[w])
                if not silent.isdisjoint(distinct):
                    each = [[w for w in ws if numbers[w]] for ws in each]
                ids = [" ".join(map(numbers.__getitem__, ws)) for ws in each]
                texts = [" ".join(map(strings.__getitem__, ws)) for ws in each]
                count = [x.count(" ") + 1 if x else 0 for x in ids]
                for w in long:
                    kept -= 2 * ENTRY + len(numbers.pop(w)) + len(strings.pop(w))
                sha = lambda xs: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in xs], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), sha(ids), sha(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _plain(C.table(spark, sf_dir, "documents"), "doc_id", "text")
    return docs.mapInArrow(_digests(default_vocabulary()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op8_bpe": op8_bpe}
ORACLE_SQL: dict[str, str] = {}
