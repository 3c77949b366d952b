"""Files, settings, logs, and operators that no query calls."""

import datetime
import logging
import zipfile

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates as D
from newsloom.functions import text as T
from newsloom.functions import vectors as V
from newsloom.functions import verdicts as J
from newsloom.models import adapters
from newsloom.operators import journal, scoring, topk
from newsloom.plans import weekly
from newsloom.sources import environment, issues
from newsloom.streaming import journal_stream

WORD = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'


def test_docx(spark, tmp_path):
    lines = ["Заголовок", "1. 15.08.2026 — Первый &amp; второй", "Текст.", "URL: http://a; http://b"]
    with zipfile.ZipFile(tmp_path / "issue_2026-08-15.docx", "w") as z:
        z.writestr("word/document.xml", WORD.format("".join(f"<w:p><w:r><w:t>{x[:4]}</w:t></w:r><w:r><w:t>{x[4:]}</w:t></w:r></w:p>" for x in lines) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"))
    (tmp_path / "broken.docx").write_bytes(b"PK no")
    read = issues.read_docx(spark, str(tmp_path))
    assert [r["line"] for r in read.orderBy("pos").collect()] == [x.replace("&amp;", "&") for x in lines] + ["a\tb"]
    (item,) = issues.parse_items(read).collect()
    assert (item["number"], item["date"], item["title"], item["summary"], item["urls"]) == (1, "15.08.2026", "Первый & второй", "Текст.", ["http://a", "http://b"])


def test_items_are_written_and_read(spark, tmp_path):
    items = spark.createDataFrame([(2, "2026-08-16", "Second", "Text two.", ["http://b", "http://c"]), (1, "2026-08-15", "First", "Text one.", ["http://a"])], "number int, day string, title string, summary string, urls array<string>")
    lines = issues.item_lines(items, F.col("number"), F.col("day"), F.col("title"), F.col("summary"), F.col("urls"))
    issues.write_issue(lines, str(tmp_path / "issue"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "issue")).collect())
    rows = spark.createDataFrame([("x", i, x) for i, x in enumerate(text.split("\n"))], "issue string, pos int, line string")
    got = {r["number"]: (r["date"], r["title"], r["summary"], r["urls"]) for r in issues.parse_items(rows).collect()}
    assert got == {1: ("15.08.2026", "First", "Text one.", ["http://a"]), 2: ("16.08.2026", "Second", "Text two.", ["http://b", "http://c"])}


def test_labels_logs_and_caches(spark, tmp_path):
    rows = spark.createDataFrame([("http://a", 3, "TR", "head one"), ("http://b", 5, "CA", "x")], "url string, grade int, bucket string, head string")
    issues.write_labels(rows, str(tmp_path / "labels"))
    (tmp_path / "labels" / "more.csv").write_text("# a comment\t\t\t\nhttp://c\t1\tSC\tz\n")
    assert {tuple(r) for r in issues.read_labels(spark, str(tmp_path / "labels")).collect()} == {tuple(r) for r in rows.collect()} | {("http://c", 1, "SC", "z")}
    log = spark.createDataFrame([("kept http://a now",), ("kept http://z now",), ("kept http://z now",), ("other",)], "value string")
    assert [r["url"] for r in issues.log_urls(log, r"kept (\S+)", rows).collect()] == ["http://z"]
    cache, files = spark.createDataFrame([("s1", 1), ("s2", 2)], "stamp string, v int"), spark.createDataFrame([("s2", 5), ("s3", 6)], "stamp string, v int")
    new = issues.to_embed(files, cache)
    assert {tuple(r) for r in new.collect()} == {("s3", 6)}
    assert {tuple(r) for r in issues.refresh(cache, files, new).collect()} == {("s2", 2), ("s3", 6)}
    kept = issues.snapshot(spark.createDataFrame([(1, None, None), (2, 4, "TR")], "id int, scale int, bucket string"), str(tmp_path / "snap"))
    assert {tuple(r) for r in kept.collect()} == {(1, -1, "MIX"), (2, 4, "TR")}


def test_settings_and_logs():
    lines = ["# comment", "", "A=1", 'B = "two words"', "no value", "C='x=y'", "A=9"]
    assert environment.settings(lines, {"A": "env", "Z": "1"}) == {"A": "env", "B": "two words", "C": "x=y"}
    record = logging.LogRecord("n", 20, "f", 1, "key %s and %s", ("secret-123456", "abc"), None)
    assert environment.Redacted(["secret-123456", "abc"]).filter(record) and record.getMessage() == "key *** and abc"


def test_ablation():
    assert adapters.ablated("Be brief. Be kind. Be brief.", {"full": [], "cut": ["Be brief."]}) == {"full": "Be brief. Be kind. Be brief.", "cut": " Be kind. "}
    with pytest.raises(ValueError, match="does not hold"):
        adapters.ablated("a", {"x": ["b"]})


def test_journal_moves(spark, tmp_path):
    models = spark.createDataFrame([("a:free", 8), ("b:free", 32), ("c", 64), ("d:free", 32)], "name string, context int")
    assert [r["name"] for r in topk.pool_order(models, 2).collect()] == ["b:free", "d:free"]
    assert [r["v"] for r in spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>").select(V.has_size(F.col("v"), 2).alias("v")).collect()] == [True, False]
    pooled = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "v array<array<double>>, m array<int>").select(V.mean_pool(F.col("v"), F.col("m")).alias("p")).collect()
    assert [r["p"] for r in pooled] == [[2.0, 4.0], [0.0, 0.0]]
    assert D.NUMBERS["ივნისი"] == 6 and D.NUMBERS["հունիսի"] == 6 and D.NUMBERS["oca"] == 1 and min(map(len, D.NUMBERS)) >= 3


def test_meaning_faults(spark):
    answer = 'x {"problems": [{"quote": "two words", "kind": "k", "why": "w"}, {"quote": "not there", "kind": "k", "why": "w"}, {"quote": "one two three four", "kind": "k", "why": "w"}]} y'
    df = spark.createDataFrame([(answer, "has two words and one two three four"), ("no json", "two words"), (None, "x")], "a string, s string")
    assert [[p["quote"] for p in r["f"]] for r in df.select(T.meaning_faults(F.col("a"), F.col("s")).alias("f")).collect()] == [["two words"], [], []]


def test_weekly_repeats(spark):
    picked = spark.createDataFrame([(1, "TR", 1), (2, "TR", 2), (3, "CA", 1)], "id long, bucket string, rank int")
    reserve = spark.createDataFrame([(4, "TR", 1), (5, "TR", 2), (6, "CA", 1)], "id long, bucket string, rank int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [0.01, 1.0]), (5, [0.7, 0.7]), (6, [0.0, -1.0])], "id long, embedding array<double>")
    assert weekly.without_repeats(picked, reserve, vectors) == [3, 1, 5]


def test_weeks(spark, tmp_path):
    at = datetime.datetime(2026, 8, 1, 5)
    spark.createDataFrame([(at,), (at + datetime.timedelta(days=3),)], "ts timestamp").write.parquet(str(tmp_path / "in"))
    got = journal_stream.complete(journal_stream.weeks(spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in"))), str(tmp_path / "out")).collect()
    assert len(got) == 10 and sorted(r["n"] for r in got) == [1] * 6 + [2] * 4
