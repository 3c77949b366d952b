import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates as D
from newsloom.functions import text as T
from newsloom.functions import verdicts as J
from newsloom.models import adapters
from newsloom.operators import cluster, journal, metrics, proximity, scoring, selection
from newsloom.sources import issues, pages

V2T = "GOV_LOCALGOV,2081;WB_470_EDUCATION,2081;UNGP_FORESTS_RIVERS_OCEANS,1427;TAX_ETHNICITY_IRISH,598"
V2L = "1#United Kingdom#UK#UK##54#-4#UK#105;1#United Kingdom#UK#UK##54#-4#UK#2235;1#Ireland#EI#EI##53#-8#EI#61;1#Ireland#EI#EI##53#-8#EI#261;1#Ireland#EI#EI##53#-8#EI#503"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("countries, gap, share, expect", [(["UK"], 400, None, (True, 154)), (["EI"], 400, None, (False, 1578)), (["UK"], None, 0.3, (True, 154)), (["UK"], None, 0.6, (False, None))])
def test_proximity(spark, countries, gap, share, expect):
    q = proximity.Query(["WB_470_EDUCATION"], countries, gap, share)
    v = one(spark, proximity.judge_offsets(F.lit(V2T), F.lit(V2L), q))
    assert (v["ok"], v["gap"]) == expect


def test_proximity_routes_blank_cells_and_needs_exact_themes(spark):
    assert one(spark, proximity.judge_offsets(F.lit(""), F.lit(" "), proximity.Query(["A"], ["UK"]))) is None
    assert one(spark, proximity.judge_offsets(F.lit(V2T), F.lit(V2L), proximity.Query(["WB_470"], ["UK"])))["ok"] is False
    assert one(spark, proximity.judge_names(F.lit("WB_470_EDUCATION;X"), F.lit("1#Ireland#EI#EI;1#a#b"), proximity.Query(["WB_470_EDUCATION"], ["EI"])))


@pytest.mark.parametrize("raw, expect", [
    ('{"1": {"w": "law", "r": "TR", "s": 5}}', ("TR", 5)), ('{"1": {"w": "-", "r": "NO"}}', ("NO", None)), ('{"1": {"r": "ca", "s": "3"}}', ("CA", 3)), ('{"1": {"r": "SC", "s": 4.0}}', ("SC", 4)),
    ('{"1": {"r": "SC", "s": 9}}', ("SC", 5)), ('{"1": {"r": "TR", "s": "нет"}}', ("TR", None)), ('{"1": {"r": "zz", "s": 2}}', None), ('{"1": "TR3"}', ("TR", 3)), ("не json вовсе", "nothing"),
])
def test_judge(spark, raw, expect):
    found = one(spark, J.parse_judge(F.lit(raw), 1))
    assert (found is None) if expect == "nothing" else (found[0] is None) if expect is None else tuple(found[0]) == expect


def test_judge_partial(spark):
    found = one(spark, J.parse_judge(F.lit('{"3":"TR3","1":"NO"}'), 3))
    assert [x and tuple(x) for x in found] == [("NO", None), None, ("TR", 3)]
    assert one(spark, J.parse_judge(F.lit('["NO","SC"]'), 2)) is None


def test_edits(spark):
    m = one(spark, J.parse_edits(F.lit('x [{"idx":1,"title":"a"},{"idx":1,"title":"b"},{"idx":7,"title":"c"}]'), 2))
    assert {k: v["title"] for k, v in m.items()} == {1: "b"}


@pytest.mark.parametrize("url, expect", [("https://www.a.com:80/x", "a.com"), ("http://u@m.b.org/news/279212771/x", "wire:279212771"), ("не-url", ""), ("http://blog.c.de", "blog.c.de"), (None, "")])
def test_publisher(spark, url, expect):
    assert one(spark, T.publisher(F.lit(url))) == expect


def test_text_rules(spark):
    assert one(spark, T.words(F.lit("Слово one_two İ"))) == ["слово", "one", "two", "i̇"]
    assert one(spark, T.shingles(T.words(F.lit("a b c")))) == [] and one(spark, T.shingles(T.words(F.lit("a b c d e")))) == ["a b c d", "b c d e"]
    assert one(spark, T.is_non_event(F.lit(""), F.lit("Большое ИНТЕРВЬЮ министра"), F.lit("")))
    assert not one(spark, T.is_non_event(F.lit(""), F.lit("columns of text"), F.lit("")))
    assert one(spark, T.mixed_script(F.lit("ОДTÜ и AI-платформа"))) == "ОДTÜ" and one(spark, T.mixed_script(F.lit("AI-платформа"))) is None
    assert one(spark, T.third_script(F.lit("этап نظم β"))) == "نظم"
    assert one(spark, T.numbers_not_in_source(F.lit("89 457 и 12 и 2026 и 12345"), F.lit("89.457"))) == ["12345"]
    assert one(spark, T.consonant_skeleton(F.lit("ЮК"))) == one(spark, T.consonant_skeleton(F.lit("YÖK"))) == "yk"
    assert one(spark, T.phonetic_skeleton(F.lit("kontenjan"))) == one(spark, T.phonetic_skeleton(F.lit("контенжан"))) == "kontenjan"
    assert one(spark, T.without_marks(F.lit("Görevli ﬁ ğ"))) == "Gorevli fi g"
    assert one(spark, T.strip_thinking(F.lit("<think>a</think> b"))) == "b" and one(spark, T.strip_fence(F.lit("```json\n[1]\n```"))) == "[1]"


GOOD = "Министерство образования Турции объявило о новой программе. Она начнётся осенью."


@pytest.mark.parametrize("title, summary, source, fault", [
    ("", GOOD, "", "empty"), ("В Турции", GOOD, "", "short title"), ("Турция объявила новую программу", GOOD, "", None), ("Турция объявила новую программу", GOOD[:-1], "", "cut off"), ("Turkey announced a new programme", "It starts in autumn.", "", "not Russian"),
    ("Турция объявила ОДTÜ программу", GOOD, "", "mixed script"), ("Турция объявила новую программу", GOOD[:-1] + " на 12345 мест.", "другое", "number not in source"), ("Турция объявила программу «Bahçe Görevli»", GOOD, "Bahçe Görevlisi", "quote not in source"),
    ("Увеличен контенжан стипендиальной программы", GOOD, "bu kontenjan arttı", "copied word"), ("Турция объявила новую программу", GOOD * 20, "", "too long"),
])
def test_guards(spark, title, summary, source, fault):
    known = T.frequency_of({w: 4.0 for w in GOOD.lower().replace(".", "").split()})
    assert one(spark, T.summary_fault(F.col("t"), F.col("s"), F.col("o"), known), t=title, s=summary, o=source) == fault


@pytest.mark.parametrize("text, source, copied, short, quote", [
    ("это контенжана новое", "bu kontenjan arttı", "контенжана", None, None), ("это Контенжан", "bu kontenjan arttı", None, None, None), ("слово", "", None, None, None),
    ("совет ЮК решил", "YÖK karar verdi", None, "ЮК", None), ("орган Меб", "MEB", None, "Меб", None), ("надпись «Bahçe Görevli» тут", "Bahçe  Görevlisi", None, None, "Bahçe Görevli"),
    ("надпись «Bahçe  Görevlisi» тут", "x bahçe\ngörevlisi y", None, None, None), ("«по-русски» и «a.b (c)»", "aXb (c)", None, None, "a.b (c)"), ("новый вакыф", "Vakıf ve vakıf", "вакыф", None, None),
])
def test_source_rules(spark, text, source, copied, short, quote):
    rare = T.frequency_of({w: 5.0 for w in "это новое слово совет решил орган надпись тут новый и".split()})
    got = lambda f, *a: one(spark, f(F.col("t"), F.col("s"), *a), t=text, s=source)
    assert (got(T.first_copied_word, rare), got(T.first_transliterated_abbreviation, rare), got(T.first_quote_not_in_source)) == (copied, short, quote)


GLOSSARY = [("istanbul", "Стамбул", "ru"), ("hrazdan", "Раздан", "ru"), ("ankara", "Анкара", "ru"), ("yök", "YÖK", "keep")]


@pytest.mark.parametrize("text, source, word", [
    ("в университетах Стамбула и Истанбула", "Istanbul ve Ankara", "Истанбула"), ("в Стамбуле и Анкаре", "Istanbul ve Ankara", None), ("Истанбулский совет", "istanbul", "Истанбулский"),
    ("в Храздане", "hrazdan", "Храздане"), ("в Храздане", "hrazdanli", None), ("", "istanbul", None), ("Истанбул", None, None),
])
def test_exonyms(spark, text, source, word):
    glossary = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), F.lit(m).alias("mode")) for k, n, m in GLOSSARY))
    assert one(spark, T.first_wrong_exonym(F.col("t"), F.col("s"), glossary), t=text, s=source) == word
    fault = T.summary_fault(F.concat(F.lit("Новость дня города "), F.col("t")), F.lit("Это случилось."), F.col("s"), glossary=glossary, no_predicate=lambda t: t.contains("нет"), bad_agreement=lambda t: F.lit(False))
    assert one(spark, fault, t=text, s=source) == ("wrong exonym" if word else None)
    block = one(spark, T.glossary_block(F.col("s"), glossary), s=source)
    assert block == "\n".join(f"{k} — {n}" for k, n, _ in GLOSSARY if k in (source or "").lower().split())

@pytest.mark.parametrize("text, day, expect", [("29 Temmuz'da", "2026-07-29", True), ("29 Temmuz 2025", "2026-07-29", False), ("26 июля был дождь", "2026-07-26", True), ("1 August 2026", "2026-08-01", True), ("05.08.2026", "2026-08-05", True), ("2026-08-05", "2026-08-06", False), ("3 MAYIS", "2026-05-03", True), (None, "2026-05-03", False)])
def test_mentioned(spark, text, day, expect):
    assert one(spark, D.mentioned(F.lit(text), F.lit(day).cast("date"))) is expect


@pytest.mark.parametrize("raw, pub, expect", [("2026-08-04", "2026-08-07", ("2026-08-04", "")), (None, "2026-08-07", ("2026-08-07", "")), ("вчера", "2026-08-07", ("2026-08-07", "not a date")), ("2026-08-08", "2026-08-07", ("2026-08-07", "after publication")), ("2026-08-06", "2026-08-07", ("2026-08-07", "not mentioned")), ("2026-07-01", "2026-08-07", ("2026-08-07", "outside the window")), (None, "2026-07-01", ("", ""))])
def test_choose(spark, raw, pub, expect):
    found = one(spark, D.choose(F.col("r"), F.col("p"), F.lit("4 августа прошло"), F.lit("2026-08-09").cast("date")), r=raw, p=pub) if raw else one(spark, D.choose(F.lit(None).cast("string"), F.lit(pub), F.lit(""), F.lit("2026-08-09").cast("date")))
    assert tuple(found) == expect


def test_journal_life(spark):
    empty = spark.createDataFrame([], journal.SCHEMA)
    kinds = "url string, query_index int, verdict string, embedding array<float>"
    first = journal.mark(empty, spark.createDataFrame([("a", 0, "accepted", [1.0]), ("b", 0, "rejected", [1.0]), ("c", 0, "pending", None), ("d", 1, "short", None)], kinds), "2026-08-01")
    assert {r[0] for r in journal.final_urls(first).collect()} == {"a", "b", "d"} and [r[0] for r in journal.pending(first).collect()] == ["c"]
    second = journal.mark(first, spark.createDataFrame([("c", 5, "rejected", [1.0])], kinds), "2026-08-02")
    c = second.filter("url = 'c'").first()
    assert (c["attempts"], c["first_seen"], c["last_seen"], c["query_index"]) == (2, "2026-08-01", "2026-08-02", 0)
    assert tuple(journal.label_counts(second).first()) == (1, 2)
    assert {r["url"] for r in journal.prune(second, F.lit("2027-01-01").cast("date")).collect()} == {"a", "b", "c"}
    fresh = spark.createDataFrame([("a",), ("c",), ("e",)], "url string")
    assert {(r["url"], r["fresh"]) for r in journal.candidates(fresh, first).collect()} == {("c", True), ("e", True)}


def test_clusters(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.02, 0.0]), (2, [0.0, 1.0, 0.0])], "id int, embedding array<float>")
    assert {r["id"]: r["leader"] for r in cluster.cluster(rows, 0.95).collect()} == {0: 0, 1: 0, 2: 2}
    assert {r["id"]: r["leader"] for r in cluster.cluster(rows, 0.95, planes=2).collect()} == {0: 0, 1: 0, 2: 2}
    assert cluster.cluster(rows.limit(0), 0.95).count() == 0
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    found = cluster.leaders(spark.createDataFrame([(i,) for i in range(1, 6)], "id int"), chain)
    assert {r["id"]: r["leader"] for r in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    several = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)], "id int, embedding array<float>")
    assert sorted(map(tuple, cluster.similar_pairs(several, 0.9, block=7).select("a", "b").collect())) == sorted(map(tuple, cluster.similar_pairs(several, 0.9).select("a", "b").collect()))


def test_not_repeated():
    rows = [{"id": i, "embedding": v} for i, v in enumerate([[1.0, 0], [1.0, 0.01], [0, 1.0], [0.01, 1.0], [1.0, 1.0]])]
    assert [r["id"] for r in cluster.not_repeated(rows, [], 3)] == [0, 2, 4]


def test_scoring(spark):
    rows = spark.createDataFrame([(1, 0.99), (2, 0.99), (3, 0.02)], "id int, v double").withColumn("b", F.lit(1))
    assert [r[0] for r in rows.select(scoring.pct_rank(F.col("v"), F.col("id"), ["b"]).alias("r"), "id").orderBy("id").collect()] == [0.5, 1.0, 0.0]
    assert one(spark, scoring.coverage_weight(F.lit(12), F.lit(12))) == 1 and one(spark, scoring.coverage_weight(F.lit(1), F.lit(12))) == 0
    assert [round(one(spark, scoring.novelty(F.lit(c), 0.9)), 6) for c in (1.0, 0.95, 0.89)] == [0, 0.5, 1]
    v = spark.createDataFrame([(1, "a", 1)] * 4 + [(1, "b", 5), (2, "a", None)], "story int, outlet string, grade int")
    assert [tuple(r) for r in scoring.story_scale(v, "story", "outlet", "grade").collect()] == [(1, 0.5)]


def test_metrics(spark):
    g = spark.createDataFrame([("a", i + 1, x) for i, x in enumerate((3, 2, 1))] + [("b", i + 1, x) for i, x in enumerate((1, 2, 3))] + [("c", 1, 0)], "g string, rank int, gain int")
    got = {r["g"]: r["ndcg"] for r in metrics.ndcg(g, 3, ["g"]).collect()}
    assert got["a"] == 1 and got["b"] < 1 and got["c"] is None


LEAD = "Министерство образования объявило новый набор студентов на осень."
OTHER = "Университеты Анкары получат дополнительные места для магистров в этом году."


def test_selection(spark):
    v = spark.createDataFrame([(1, f"u{i}", LEAD) for i in range(5)] + [(2, "a", LEAD), (2, "b", LEAD + " " + OTHER), (3, "x", "1 2 3 4 5 6"), (3, "y", "")], "story int, url string, text string")
    rows = selection.select_sentences(v, "story", "url", "text", 1000).collect()
    assert sum(r["story"] == 1 for r in rows) == 1 and sum(r["story"] == 2 for r in rows) == 2 and not any(r["story"] == 3 for r in rows)
    assert selection.prompts(spark.createDataFrame(rows)).count() == 2
    glossary = F.array(F.struct(F.lit("анкары").alias("key"), F.lit("Анкара").alias("name"), F.lit("ru").alias("mode")))
    with_names = {r["story"]: r["prompt"] for r in selection.prompts(spark.createDataFrame(rows), glossary).collect()}
    assert with_names[2].startswith("анкары — Анкара\n\nSource: ") and with_names[1].startswith("Source: ")


def shown(versions, budget):
    """The rounds by brute force: each turn, of all candidates that may come next, the one that the rules name."""
    words = lambda s: re.findall(r"[^\W_]+", s.lower())
    runs = lambda s: {tuple(words(s)[i : i + 4]) for i in range(len(words(s)) - 3)}
    found = []
    for url, sentences in versions:
        seen = set()
        for pos, s in enumerate(sentences):
            if not runs(s) or len(runs(s) & seen) <= 0.28 * len(runs(s)):
                seen |= runs(s)
                found.append((url, pos, s))
    n, df = len(found), {}
    for _, _, s in found:
        for w in set(words(s)):
            df[w] = df.get(w, 0) + 1
    worth = lambda f: round(sum(df[w] / n * (1 - df[w] / (n + 1)) for w in set(words(f[2]))) / len(set(words(f[2]))) ** 0.5 * {0: 1.3, 1: 1.1}.get(f[1], 1.0), 9)
    out, turn = [], 0
    while True:
        turn += 1
        before = len(out)
        for f in sorted(found, key=lambda f: (-worth(f), f[0], f[1])):
            fresh = runs(f[2]) and len(runs(f[2]) & set().union(*(runs(x[2]) for x in out))) <= 0.28 * len(runs(f[2]))
            if f not in out and sum(x[0] == f[0] for x in out) < turn and fresh and sum(len(x[2]) for x in out) + len(f[2]) <= budget:
                out.append(f)
        if len(out) == before:
            return set(out)


def test_selection_by_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "бвгдж" for b in ("аба", "орон", "имик", "елез")]
    pool = [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 12))) + "." for _ in range(30)]
    stories = {k: [(f"u{i}", [r.choice(pool) for _ in range(r.randint(1, 7))]) for i in range(r.randint(1, 6))] for k in range(12)}
    df = spark.createDataFrame([(k, u, " ".join(x)) for k, vs in stories.items() for u, x in vs], "story int, url string, text string")
    got = {k: set() for k in stories}
    for row in selection.select_sentences(df, "story", "url", "text", 300).collect():
        got[row["story"]].add((row["url"], row["pos"], row["text"]))
    assert got == {k: shown(vs, 300) for k, vs in stories.items()}


def test_pages_and_issues(spark):
    article = "<html><head><title>Big &amp; news</title></head><body><nav>menu</nav><article><p>" + "Слово за слово. " * 40 + "</p></article></body></html>"
    text, title, _ = pages.extract(article)
    assert title == "Big & news" and "menu" not in text and len(text) > 300
    body = "Слово за слово. " * 60
    for page in (f"<nav><ul><li>a<li>b</ul></nav><p>{body}</p>", f"<div class=ad><p>x<p>y</div><header>h<br></header><article><p>{body}<p></article><footer>f", f"<aside><img src=a><p>n</aside></b><main>{body}</main>"):
        assert pages.extract(f"<html><body>{page}</body></html>")[0] == body.strip()
    assert pages.extract("<title>Just a moment...</title><body>Checking your browser</body>")[0] is None
    lines = spark.createDataFrame([("i", k, x) for k, x in enumerate(["Заголовок", "1. 15.08.2026 — Первый", "", "Текст.", "URL: http://a; http://b", "2. 16.08.2026 — Второй"])], "issue string, pos int, line string")
    got = {r["number"]: (r["date"], r["title"], r["summary"], r["urls"]) for r in issues.parse_items(lines).collect()}
    assert got == {1: ("15.08.2026", "Первый", "Текст.", ["http://a", "http://b"]), 2: ("16.08.2026", "Второй", "", [])}
    names = spark.createDataFrame([("issue_2026-08-16.docx",), ("issue_2026-08-16-6.docx",), ("x",)], "name string")
    assert [tuple(r) for r in issues.latest_files(names).collect()] == [("2026-08-16", "issue_2026-08-16-6.docx")]
    assert issues.free_name(["issue_2026-01-01.txt"], "2026-01-01") == "issue_2026-01-01-2.txt"


def test_adapters(spark):
    rows = spark.createDataFrame([(i, "слово " * (i + 1)) for i in range(35)], "id int, text string")
    assert adapters.judge(rows, adapters.stub_judge).filter("region IS NOT NULL").count() == 35
    assert adapters.judge(rows, lambda _: None).filter("region IS NULL").count() == 35
    assert one(spark, F.size(F.lit([0.0] * 2))) == 2
    vectors = adapters.embed(rows.limit(3), adapters.hashing_embedder(8), size=8).collect()
    assert all(len(r["embedding"]) == 8 for r in vectors)
    items = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "idx int, title string, summary string")
    edited = adapters.apply_edits(items, '[{"idx":1,"title":"","summary":"new"}]', lambda t, s: t != "", 2)
    assert [tuple(r) for r in edited.collect()] == [(1, "a", "b")] and adapters.apply_edits(items, "?", lambda t, s: t != "", 2).count() == 2


def test_parse_dates(spark):
    assert one(spark, D.parse_iso(F.lit("2026-13-40"))) is None and one(spark, D.parse_iso(F.lit(" 2026-08-04 x"))) == date(2026, 8, 4)
    assert one(spark, D.dump_date(F.lit("20260804121500"))) == date(2026, 8, 4)
