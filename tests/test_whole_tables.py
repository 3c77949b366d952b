"""Queries work on whole texts and whole tables."""

import re

import numpy as np

from newsloom import registry
from newsloom.functions import text as T
from newsloom.operators import cluster, metrics, scoring


def test_parse_issue_keeps_whole_texts(spark, tmp_path):
    user, reply = "title of many words\n\t " * 20, "summary of many words " * 20
    rows = [(1, 0, "user", user), (1, 1, "assistant", reply), (1, 2, "system", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    (got,) = registry.QUERIES["parse_issue"](spark, str(tmp_path)).collect()
    assert got["title"] == re.sub(r"\s+", " ", user).strip() and got["summary"] == reply.strip()


def test_nearest_earlier_works_in_blocks(spark):
    rng = np.random.default_rng(4)
    v, days = rng.integers(-3, 4, (60, 4)).astype(float), rng.integers(1, 9, 60)
    v[:, 3] = 1
    issues = spark.createDataFrame([(i, f"2026-01-{days[i]:02}", v[i].tolist()) for i in range(60)], "id long, day string, e array<double>")
    near = metrics.nearest_earlier(issues.selectExpr("id", "date(day) AS d", "e"), "id", "d", "e", block=13)
    assert "NestedLoop" not in near._jdf.queryExecution().toString()
    unit = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-10)
    cos = np.where(days[None, :] < days[:, None], unit @ unit.T, -2)
    got = {r["id"]: (r["cos"], r["other"]) for r in near.collect()}
    assert set(got) == {i for i in range(60) if days[i] > days.min()}
    assert all(abs(c - cos[i].max()) < 1e-9 and abs(cos[i, o] - c) < 1e-9 for i, (c, o) in got.items())


def test_the_archive_of_rank_stories_grows(spark, data, monkeypatch):
    sizes, whole = [], cluster.max_cosine

    def counted(rows, archive, *more, **named):
        sizes.append((rows.count(), archive.count()))
        return whole(rows, archive, *more, **named)

    monkeypatch.setattr(cluster, "max_cosine", counted)
    registry.QUERIES["rank_stories"](spark, data)
    ids = [r["vec_id"] for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").collect()]
    assert sizes == [(sum(i % 12 > 0 for i in ids), sum(i % 12 == 0 for i in ids))]


def test_shared_sets_are_exact(spark):
    rng = np.random.default_rng(9)
    sets = [sorted({f"w{x}" for x in rng.zipf(1.3, rng.integers(0, 60)) if x < 90}) for _ in range(80)]
    sets += sets[:10]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sets)], "id long, items array<string>")
    got = {(r["a"], r["b"]): (r["both"], r["a_rows"], r["b_rows"]) for r in metrics.shared_sets(df, 6).collect()}
    rows = {tuple(x): [i for i, y in enumerate(sets) if y == x] for x in sets}
    first = {ids[0]: (set(x), len(ids)) for x, ids in rows.items()}
    want = {(a, b): (len(first[a][0] & first[b][0]), first[a][1], first[b][1]) for a in first for b in first if a < b and len(first[a][0] & first[b][0]) >= 6}
    assert want and got == want


def test_members_of_equal_sets_are_links(spark, tmp_path):
    """Texts that differ by stops alone have equal shingles: the query loses none of them, and a group of copies gives a row a member."""
    words = " ".join(f"word{i}" for i in range(40))
    texts = [(5, words), (2, words.replace(" ", ", ")), (9, words + " more of them"), (7, "other words"), (3, None), (4, words.upper()), *((100 + i, words) for i in range(50))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in registry.QUERIES["shingle_overlap"](spark, str(tmp_path)).select("a", "b", "both", "a_rows", "b_rows", "copy").collect())
    assert got == [(2, 4, 37, 53, 53, True), (2, 5, 37, 53, 53, True), (2, 9, 37, 53, 1, False), *((2, 100 + i, 37, 53, 53, True) for i in range(50))]


def test_copies_of_vectors_make_no_pairs(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    kinds = rng.standard_normal((12, 3)).round(1)
    v = {int(i): [0.0] * 3 if i % 17 == 0 else kinds[i % 12].tolist() for i in rng.permutation(180)}
    rows = [(i, x, "even" if i % 2 else "odd") for i, x in v.items()] + [(500, None, "odd"), (501, None, "odd"), (502, [float("nan")] * 3, "even"), (503, [float("nan")] * 3, "even")]
    df, seen, real = spark.createDataFrame(rows, "vec_id long, embedding array<double>, side string"), [], cluster.similar_pairs
    monkeypatch.setattr(cluster, "similar_pairs", lambda rows, *a, **k: (seen.append(rows.count()), real(rows, *a, **k))[1])

    def like(a, b):
        x, y = np.array(a), np.array(b)
        return x @ y / ((np.linalg.norm(x) + 1e-10) * (np.linalg.norm(y) + 1e-10)) >= 0.3

    for bucket in (None, "side"):
        leaders, lead = {}, []
        for i, x, side in sorted(rows, key=lambda r: r[0]):
            near = [j for j, y, other in lead if x and y and (bucket is None or side == other) and like(x, y)]
            leaders[i] = min(near, default=i)
            lead += [] if near else [(i, x, side)]
        assert {r["vec_id"]: r["leader"] for r in cluster.cluster(df, 0.3, "vec_id", bucket=bucket).collect()} == leaders
    zeros = sum(i % 17 == 0 for i in v)
    assert seen == [12 + zeros + 4] * 2  # kinds of either parity are their own
    df.drop("side").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["a"], r["b"]): r["copy"] for r in registry.QUERIES["cosine_pairs"](spark, str(tmp_path)).collect()}
    first = {i: min(j for j, y in v.items() if y == x) for i, x in v.items()}
    want = {(first[i], i): True for i in v if first[i] < i and i % 17}
    firsts = sorted({first[i] for i in v if i % 17})
    assert got == want | {(a, b): False for a in firsts for b in firsts if a < b and like(v[a], v[b])}


def test_max_cosine_in_blocks(spark):
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((50, 5)), rng.standard_normal((40, 5))
    rows = lambda v: spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(v)], "id int, embedding array<double>")
    got = {r["id"]: r["cos"] for r in cluster.max_cosine(rows(x), rows(y), block=7).collect()}
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    assert np.allclose([got[i] for i in range(50)], (unit(x) @ unit(y).T).max(axis=1))
    assert {r["cos"] for r in cluster.max_cosine(rows(x), rows(y).limit(0)).collect()} == {-1.0}


def test_shared_sets_count_in_blocks(spark):
    """Of common items no pairs are made, in Spark or in a table: sets meet in blocks, and the most frequent postings are added to what is found."""
    rng = np.random.default_rng(19)
    sets = [sorted({f"w{x}" for x in rng.zipf(1.4, 40) if x < 300} | {f"all{x}" for x in range(4)}) for _ in range(120)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sets)], "id long, items array<string>")
    found = metrics.shared_sets(df, 9, part=500, block=100)
    assert "SortMergeJoin [item" not in found._jdf.queryExecution().toString()
    first = {}
    for i, x in enumerate(sets):
        first.setdefault(tuple(x), i)
    want = {(i, j): len(set(a) & set(b)) for a, i in first.items() for b, j in first.items() if i < j and len(set(a) & set(b)) >= 9}
    assert want and {(r["a"], r["b"]): r["both"] for r in found.collect()} == want


def test_shingles_of_ascii_words(spark):
    rows = [(1, "One two, THREE four_five"), (2, "one TWOéthree four five"), (3, "one two three"), (4, None)]
    got = {r["id"]: r["items"] for r in T.ascii_shingles(spark.createDataFrame(rows, "n long, t string"), "n", "t").collect()}
    assert sorted(got[1]) == sorted(got[2]) and len(got[1]) == 2 and got[3] == got[4] == []


def test_blocks_grow_with_the_table():
    """What is dealt to pairs of blocks is a row for each block: their number stays, so that it grows in proportion."""
    assert cluster.block_rows(100) == 2048 and {-(-n // cluster.block_rows(n)) for n in (60_000, 300_000, 700_000)} == {24}


def test_vectors_are_dealt_as_they_are_stored(spark):
    rows = spark.createDataFrame([(i, f"2026-01-0{i % 3 + 1}", [1.0, float(i)]) for i in range(6)], "id long, day string, embedding array<float>")
    for found in (cluster.similar_pairs(rows, 0.5), metrics.nearest_earlier(rows.withColumn("d", rows["day"].cast("date")), "id", "d", "embedding")):
        assert "array<double>" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert found.count() > 0


def test_leaders_in_rounds(spark):
    rng = np.random.default_rng(18)
    v = [rng.standard_normal(4).round(1).tolist() for _ in range(120)] + [[0.0] * 4, [float("nan")] * 4, None, [0.0] * 4]
    v[50] = v[3]
    rows = [(int(i), x, "even" if i % 2 else "odd") for i, x in zip(rng.permutation(len(v)), v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, side string")
    for bucket in (None, "side"):
        want, lead = {}, []
        for i, x, side in sorted(rows, key=lambda r: r[0]):
            near = [j for j, y, z in lead if x and y and (bucket is None or side == z) and np.dot(x, y) / ((np.linalg.norm(x) + 1e-10) * (np.linalg.norm(y) + 1e-10)) >= 0.8]
            want[i] = min(near, default=i)
            lead += [] if near else [(i, x, side)]
        got = {r["id"]: r["leader"] for r in cluster.led_in_rounds(df, 0.8, "vec_id", "embedding", bucket, block=17).collect()}
        assert got == want


def test_large_tables_are_clustered_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(cluster, "similar_pairs", None)
    df = spark.createDataFrame([(i, [1.0, float(i % 5)]) for i in range(30)], "id long, embedding array<double>")
    assert cluster.cluster(df, 0.999, small=10).filter("id % 5 = leader").count() == 30


def test_ranks_hold_no_group_in_a_task(spark, tmp_path, same_rows):
    import duckdb

    rng = np.random.default_rng(6)
    rows = [(int(i), "x" * int(n) if n else None, [None, "en", "de", "alone"][3 if i == 7 else i % 3]) for i, n in zip(rng.permutation(200), rng.integers(0, 9, 200))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.QUERIES["pct_rank_ordinal"](spark, str(tmp_path))
    assert not [x for x in re.findall(r"windowspecdefinition\(([^)]*)", found._jdf.queryExecution().toString()) if "__part" not in x]  # those left go over parts, a row each
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(found.toPandas(), con.sql(registry.ORACLE_SQL["pct_rank_ordinal"]).df())


def test_pages_come_in_small_batches(spark, data):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    registry.QUERIES["page_extract"](spark, data)
    now = spark.conf.get(name)
    spark.conf.set(name, before)
    assert int(now) <= 1000


def test_lexrank_in_blocks(spark):
    """The similarity graph is taken block by block: with blocks of 7 rows the scores are those of the whole matrix."""
    rng = np.random.default_rng(12)
    v = rng.standard_normal((45, 4)).tolist() + [[0.0] * 4]
    rows = [(i, x, "alone" if i == 44 else "ab"[i % 2], [None, "", "n", "m"][i % 4]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, v array<double>, bucket string, outlet string")
    got = {r["id"]: r["lexrank"] for r in scoring.lexrank(df, "bucket", "id", "v", "outlet", block=7).collect()}
    assert set(got) == set(range(46)) and got[44] == 1
    for bucket in "ab":
        own = [r for r in rows if r[2] == bucket]
        x = np.array([r[1] for r in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-10
        s = np.maximum(x @ x.T, 0)
        s[[[a is b or bool(a[3]) and a[3] == b[3] for b in own] for a in own]] = 0
        sums = s.sum(axis=1, keepdims=True)
        s = np.where(sums > 0, s / np.where(sums > 0, sums, 1), 1 / len(own))
        p = np.full(len(own), 1 / len(own))
        for _ in range(100):
            q = 0.15 / len(own) + 0.85 * (s.T @ p)
            done = np.abs(q - p).sum() < 1e-6
            p = q
            if done:
                break
        assert np.allclose([got[r[0]] for r in own], p, atol=1e-12)


def test_candidates_are_made_once(spark, data):
    """Sentences are cut and compared in one step, whose table the scores and the choice read; equal sentences of an address come to the choice once."""
    found = registry.QUERIES["sentence_selection"](spark, data)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "array_intersect" not in plan and found.count() > 0
