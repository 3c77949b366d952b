"""The pipeline: each stage on what its predecessor kept, against brute force on a small corpus."""

import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import common as C
from newsloom.llm import packing, registry

KINDS = "doc_id long, text string, lang string, source string, n_chars long, kept string, name int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 9))) for _ in range(n)]


def prose(n, seed):
    return " ".join(words(n, seed))


PASSAGE = prose(70, 7777)
HEADER = "read more on our pages every day and night"


def corpus():
    rows = [(i, prose(60 + i, i)) for i in range(20)]
    rows += [(100 + i, prose(90, 500)) for i in range(4)]  # exact copies
    near = words(120, 600)
    rows += [(200 + i, " ".join(w if k != 7 * i else "changed" for k, w in enumerate(near))) for i in range(6)]
    rows += [(300 + i, prose(30, 700 + i) + ".\n" + PASSAGE + ".\n" + prose(30, 800 + i)) for i in range(3)]
    rows += [(400 + i, HEADER + "\n" + prose(50, 900 + i)) for i in range(55)]  # one line on 55 pages of a host
    rows += [(500, None), (501, ""), (502, "too short"), (503, " ".join(["again and again it says"] * 30)), (None, prose(40, 990)), (504, prose(40, 991)), (504, prose(40, 991))]
    rows += [(505, prose(6000, 992))]
    return [(i, t, "en", None if i == 3 else "host", len(t or ""), "x", 1) for i, t in rows]


def without_line(rows, most=50):
    """Quality rules by plain Python: the lines of each document that stay, and whether it does."""
    texts = {(i, t or "") for i, t, *_ in rows}
    holders = defaultdict(set)
    for i, t in texts:
        for line in t.split("\n"):
            if WORD.search(line):
                holders[re.sub(r"\d+", "0", line.lower()).strip()].add((i is None, i or 0, t))
    out = []
    for row in rows:
        i, t = row[0], row[1] or ""
        w = WORD.findall(t)
        runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {p for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = t.split("\n")
        common = [len(h := holders.get(x.lower().strip(), ())) > most and (i is None, i or 0) > min(h)[:2] for x in lines]
        left = sum(len(x) for x, c in zip(lines, common) if not c)
        if len(w) >= 10 and 100 * len(again) <= 20 * len(w) and left >= 0.3 * sum(map(len, lines)):
            out.append((i, "\n".join(x for x, c in zip(lines, common) if not c)))
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gets and gives, written and read again as the contract says."""
    at = tmp_path_factory.mktemp("stages")
    spark.createDataFrame(corpus(), KINDS).repartition(3).write.parquet(f"{at}/in")
    docs, out = spark.read.parquet(f"{at}/in"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, "").write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        assert k == 4 or docs.columns == columns
        out.append(docs)
    return out


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_quality_stage(stages):
    got = stages[0].collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(without_line(corpus()))
    assert all(r["n_chars"] == len(r["text"]) and r["kept"] == "x" and r["name"] == 1 for r in got)
    assert sum(HEADER in r["text"] for r in got) == 1


def test_exact_stage(stages):
    best = {}
    for i, t in rows_of(stages[0]):
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    assert {(-1 if i is None else i, t) for i, t in rows_of(stages[1])} == {(i, t) for t, i in best.items()} and stages[1].count() == len(best)


def test_near_stage(stages):
    before, after = dict(rows_of(stages[1])), dict(rows_of(stages[2]))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in before.items() for w in [t.lower().split()]}
    linked = {(a, b) for a in sets for b in sets if a is not None and b is not None and a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    least = {i: i for i in sets}
    for _ in sets:
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    assert set(after) == {i for i in sets if least[i] == i} and len(after) < len(before) and all(before[i] == t for i, t in after.items())


def test_substring_stage(stages):
    before, after = dict(rows_of(stages[2])), dict(rows_of(stages[3]))
    assert set(before) == set(after)
    changed = {i for i in before if before[i] != after[i]}
    assert changed == {301, 302} and PASSAGE in after[300] and not any(len(set(PASSAGE.split()) & set(after[i].split())) > 33 for i in changed)
    assert all(prose(30, 700 + i - 300) in after[i] and prose(30, 800 + i - 300) in after[i] for i in changed)


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    pieces = defaultdict(list)
    for r in stages[4].collect():
        pieces[r["doc_id"]].append(r)
    for i, text in rows_of(stages[3]):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert set(pieces) == {i for i, _ in rows_of(stages[3])}


def test_run_leaves_no_tables_of_finished_stages(spark, data):
    assert P.run(spark, data).count() > 0
    left = P._left[spark.sparkContext.applicationId]
    assert 0 < len(left) <= 3  # the last stage's own and what it reads


def test_empty(spark):
    docs = spark.createDataFrame([], KINDS)
    for _, stage in P.STAGES[:4]:
        docs = C.materialize(stage(spark, docs, ""))
        assert docs.count() == 0
    assert P.STAGES[4][1](spark, docs, "").agg(F.count("*")).first()[0] == 0


def test_registered():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {n.split("_")[0] for n in registry.QUERIES if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
