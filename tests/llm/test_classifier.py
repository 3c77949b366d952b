"""The quality classifier and packing against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from newsloom.llm import common as C
from newsloom.llm import packing
from newsloom.llm import quality_classifier as Q


def plain_statistics(text):
    """The statistics of a text by loops over its bytes, words and lines."""
    groups = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:", b"!?", b"#*$%&|<>@^~{}[]\\/=+_"]
    kind = lambda b: 8 if b >= 128 else next((k for k, g in enumerate(groups) if b in g), 7)
    counted, words = Counter(map(kind, text)), re.findall(rb"[^\x20\x09-\x0D]+", text)
    n, w = max(len(text), 1), max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = list(zip(words, words[1:]))
    lengths = [len(x) for x in words]
    mean = sum(lengths) / w
    share = lambda some: sum(some) / max(len(lines), 1)
    sentence_ends = sum(b in b".!?" for b in text)
    return [
        *(counted[k] / n for k in range(9)), text.count(b"|") / n, math.log1p(len(text)), math.log1p(len(words)), (len(text) - counted[3]) / w, math.sqrt(sum((x - mean) ** 2 for x in lengths) / w) if words else 0.0,
        len(set(words)) / w, max(Counter(words).values(), default=0) / w, sum(a == b for a, b in pairs) / w, len(set(pairs)) / max(len(pairs), 1), math.log1p(len(lines)) if words else 0.0, math.log1p(len(text) / len(lines)) if words else 0.0,
        1 - len(set(lines)) / len(lines) if words else 0.0, share(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) if words else 0.0, sum(x.isupper() for x in words) / w, math.log1p(len(words) / max(sentence_ends, 1)),
    ]


def test_statistics_by_plain_python():
    r = random.Random(4)
    alphabet = ["a", "B", "ccc", "7", " ", " ", "  ", "\n", "\n\n", "\t", ".", "!", "?", ",", "|", "#", "é", "字", "UP", "'"]
    texts = ["", " ", "\n", "a", "A B\nA B\n", "| | |"] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    assert np.allclose(Q.statistics(raw), [plain_statistics(t) for t in raw], rtol=1e-4, atol=1e-6)
    assert Q.statistics([]).shape == (0, len(Q.NAMES))


def test_trees_by_a_walk_node_by_node():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 5)).astype(np.float32)
    trees = Q.fit(x, (x[:, 0] + 0.5 * x[:, 2] > 0.3).astype(float), rounds=12)
    for row, score in zip(x[:60], trees.score(x[:60])):
        total = trees.base
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-12


def test_the_first_split_is_the_best_of_all():
    rng = np.random.default_rng(2)
    for seed in range(5):
        x = rng.integers(0, 12, (150, 4)).astype(np.float32)  # few values, so that every value is an edge
        y = (rng.random(150) < 0.2 + 0.6 * (x[:, seed % 4] > 5)).astype(float)
        trees = Q.fit(x, y, rounds=1, depth=1)
        p = (y.sum() + 1) / (len(y) + 2)
        g, h = p - y, np.full(len(y), p * (1 - p))
        gain = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1.0)  # noqa: B023, E731
        found = {}
        for j in range(4):
            for t in sorted(set(x[:, j]))[:-1]:
                left = x[:, j] <= t
                if min(h[left].sum(), h[~left].sum()) >= 5:
                    found[(j, t)] = gain(left) + gain(~left) - gain(np.ones(len(y), bool))
        j, t = int(trees.feature[0, 0]), float(trees.threshold[0, 0])
        assert abs(found[(j, t)] - max(found.values())) < 1e-9
        left = x[:, j] <= t
        want = [-0.2 * g[s].sum() / (h[s].sum() + 1.0) for s in (left, ~left)]
        assert np.allclose(trees.value[0], want)


def test_one_label_and_ties():
    x = np.zeros((50, 3), np.float32)
    assert np.allclose(Q.fit(x, np.ones(50)).score(x), 51 / 52)
    tied = Q.fit(x, np.array([0.0, 1.0] * 25)).score(x)  # equal rows with both labels
    assert np.allclose(tied, 0.5)


def test_held_out_rows_of_a_whole_table(spark):
    read = lambda name: C.table(spark, "/root/testdata/sf0.01", name)
    labels = read("labels")
    got = Q.classify(read("documents"), labels)
    held = [r for r in got.filter("held_out").join(labels, "doc_id").collect()]
    assert len(held) > 50 and sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in got.collect())
    twice = Q.classify(read("documents"), labels.unionByName(labels))  # repeated labels
    assert twice.count() == got.count()


def test_neighbours_on_the_curve(spark):
    """Near copies lie closer on the curve than other texts do, and are packed next to each other."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    families = [[r.choice(words[k * 100 : k * 100 + 100]) for _ in range(150)] for k in range(30)]
    rows = []
    for k, family in enumerate(families):
        for i in range(6):
            own = list(family)
            own[r.randrange(150)] = "changed"
            rows.append((10 * k + i, " ".join(own)))
    r.shuffle(rows)
    rows += [(None, "a text without an id"), (7000, None), (7000, None)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    place = {p["doc_id"]: p["sequence_id"] * packing.LENGTH + p["offset"] for p in pieces if p["start"] == 0 and p["doc_id"] is not None and p["doc_id"] < 7000}
    order = sorted(place, key=place.get)
    assert sum(a // 10 == b // 10 for a, b in zip(order, order[1:])) > 0.6 * len(order)  # by chance 3 in 100
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(i for i, _ in rows)
    at = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    assert all(s * packing.LENGTH + o == sum(x[2] for x in at[:k]) for k, (s, o, _) in enumerate(at))


def test_ids_that_do_not_fit_are_refused(spark, monkeypatch):

    class Wide:
        n_vocab = 70_000

    monkeypatch.setattr(packing, "encoding", lambda path: Wide())
    run = packing._encoded(packing.default_vocabulary())
    try:
        list(run(iter([spark.createDataFrame([(1, "a")], "doc_id long, text string").toArrow().to_batches()[0]])))
    except ValueError as e:
        assert "16 bits" in str(e)
    else:
        raise AssertionError("accepted")
