import datetime

from pyspark.sql import functions as F

from newsloom.models import adapters, providers
from newsloom.operators import journal, proximity
from newsloom.plans import collect, weekly

ARTICLE = "<html><head><title>{0}</title></head><body><article><p>{0} is the title of an article of the day. {1}</p></article></body></html>"


def test_collect_and_rank(spark):
    cell = "1#Turkey#TU#TU##1#2#x#100"
    dump = spark.createDataFrame([("20260801000000", "s", f"http://h{i % 4}.com/{i}", "", "EDU,120", "", cell, "ali veli;ministry", "") for i in range(12)], "date string, source string, url string, v1t string, v2t string, v1l string, v2l string, v1p string, v1o string")
    body = lambda u: ARTICLE.format(f"Story {u[-1]}", f"Words of story {u[-1]} are written here. " * 20).encode() if not u.endswith("/11") else b"<p>short</p>"
    seen = spark.createDataFrame([("http://h0.com/0", 0, "2026-07-31", "2026-07-31", "accepted", 1, None)], journal.SCHEMA)
    got = collect.collect(dump, seen, proximity.Query(["EDU"], ["TU"]), 3, body, adapters.hashing_embedder(16), adapters.stub_judge, "2026-08-01", size=16)
    state = {r["url"]: r["verdict"] for r in got.journal.collect()}
    assert len(state) == 12 and state["http://h3.com/11"] == "short" and "http://h0.com/0" not in {r["url"] for r in got.decided.collect()}
    assert set(state.values()) <= {"accepted", "rejected", "pending", "short"}
    rows = got.decided.select("id", "url", "text", "embedding", F.lit("TR").alias("bucket"), "entities", "scale")
    ranked, versions = weekly.rank(rows)
    picked, reserve = weekly.choose(ranked, {"TR": 3, "CA": 2, "SC": 1}, 5)
    assert picked.count() == min(5, ranked.count()) and picked.join(reserve, "id").count() == 0
    assert weekly.prompts(picked, versions).count() == picked.count()


def test_providers(tmp_path):
    ring = providers.Ring(["a", "b", "c"])
    ring.failed("a", 0, 50)
    ring.answered("c")
    assert ring.names == ["c", "b", "a"] and ring.ready(10) == ["c", "b"] and ring.wait(0) == 30
    quota, now = providers.Quota(tmp_path / "q.json", {"x": 2}), datetime.datetime(2026, 8, 1, 12)
    quota.note("x", now)
    assert quota.may("x", now)
    quota.note("x", now)
    assert not quota.may("x", now) and quota.may("x", now + datetime.timedelta(days=1)) and quota.may("y", now)
    quota.note("y", now, retry_after=10)
    assert quota.may("y", now)
    quota.note("y", now, retry_after=900)
    assert not quota.may("y", now) and quota.may("y", now + datetime.timedelta(seconds=901))
    assert providers.is_weak("Model-Nano:free")
