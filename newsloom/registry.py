"""All queries of the engine by name, and the SQL that gives the same rows.

The roles of the news pipeline are played by the tables at hand: documents are articles (source: outlet, lang: bucket),
embeddings are their vectors, labels their verdicts and grades, pages their addresses, events the mentions and the journal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dates as D
from .functions import text as T
from .functions import vectors as V
from .functions import verdicts as J
from .models import adapters, prefilter
from .operators import cluster, journal, metrics, proximity, scoring, selection, topk
from .plans import storage
from .sources import dumps, issues, pages
from .streaming import journal_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COSINE = 0.30  # of these random vectors; news texts take the production thresholds


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def _r(c: str | object, n: int = 6) -> object:
    return F.round(c, n)


# Sources


@query("SELECT strftime(t, '%Y%m%d%H%M%S') AS tick FROM (SELECT unnest(generate_series(m - INTERVAL 24 HOUR + INTERVAL 15 MINUTE, m, INTERVAL 15 MINUTE)) AS t FROM (SELECT time_bucket(INTERVAL 15 MINUTE, max(ts)) AS m FROM events))")
def dump_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _t(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return dumps.ticks(spark, F.lit(now), 24).select("tick")


@query("SELECT event_id AS url, tick, stream FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY tick DESC, stream, event_id) AS n FROM (SELECT *, strftime(ts, '%Y%m%d%H%M%S') AS tick, CASE WHEN event_id % 2 = 1 THEN 'translation' ELSE '' END AS stream FROM events)) WHERE n = 1")
def union_first_per_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", "event_type").alias("url"), F.date_format("ts", "yyyyMMddHHmmss").alias("tick"), F.when(F.col("event_id") % 2 == 1, "translation").otherwise("").alias("stream"), F.col("event_id").alias("date"))
    return dumps.first_per_url(e).select(F.col("date").alias("url"), "tick", "stream")


@query()
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.read_pages(_t(spark, sf_dir, "pages"))


@query("SELECT doc_id, CASE WHEN length(text) >= 300 THEN 0 WHEN doc_id % 2 = 0 THEN 1 END AS rescued_by FROM documents")
def rescue_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("url"), "text")
    step = d.filter("doc_id % 2 = 0").select("url", F.repeat(F.lit("x"), F.lit(400)).alias("text"))
    return pages.rescue(d, step).select("doc_id", "rescued_by")


@query("SELECT doc_id FROM documents WHERE length(text) > 1500 ORDER BY doc_id DESC LIMIT 25")
def recent_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.recent_long(_t(spark, sf_dir, "documents"), 25, key="doc_id").select("doc_id")


@query()
def parse_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant')")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    head = F.concat(F.lit("1. 01.02.2026 — "), text)
    lines = c.select(F.col("conv_id").alias("issue"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", head).otherwise(text).alias("line"))
    return issues.parse_items(lines)


# Proximity

_MENTIONS = "SELECT user_id, CASE event_type WHEN 'error' THEN 'T' WHEN 'purchase' THEN 'C' ELSE 'O' END AS kind, CAST(floor(epoch(ts)) AS BIGINT) AS o FROM events WHERE event_type IN ('error', 'purchase', 'view')"


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "T").when(F.col("event_type") == "purchase", "C").otherwise("O")
    return _t(spark, sf_dir, "events").filter("event_type IN ('error', 'purchase', 'view')").select("user_id", kind.alias("kind"), F.unix_seconds("ts").alias("o"))


@query(f"WITH m AS ({_MENTIONS}) SELECT a.user_id, min(abs(a.o - b.o)) AS gap FROM m a JOIN m b USING (user_id) WHERE a.kind = 'T' AND b.kind = 'C' GROUP BY a.user_id")
def nearest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.nearest(_mentions(spark, sf_dir), "user_id", "kind", "o", "T", "C")


@query(f"""WITH m AS ({_MENTIONS}), g AS (SELECT a.user_id, min(abs(a.o - b.o)) AS gap FROM m a JOIN m b USING (user_id) WHERE a.kind = 'T' AND b.kind = 'C' GROUP BY a.user_id),
    s AS (SELECT user_id, CAST(count(*) FILTER (kind = 'C') AS DOUBLE) / count(*) FILTER (kind <> 'T') AS share FROM m GROUP BY user_id)
    SELECT user_id, gap, round(share, 6) AS share, share >= 0.45 AND gap <= 900 AS passed FROM g JOIN s USING (user_id)""")
def proximity_gap_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir)
    share = m.groupBy("user_id").agg((F.count_if(F.col("kind") == "C") / F.count_if(F.col("kind") != "T")).alias("s"))
    return proximity.nearest(m, "user_id", "kind", "o", "T", "C").join(share, "user_id").select("user_id", "gap", _r("s").alias("share"), ((F.col("s") >= 0.45) & (F.col("gap") <= 900)).alias("passed"))


def _dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump whose rows are users' days: events as mentions with offsets."""
    e = _t(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyyMMdd")).withColumn("o", (F.hour("ts") * 60 + F.minute("ts")).cast("string"))
    theme = F.when(F.col("event_type").isin("error", "click"), F.concat(F.upper("event_type"), F.lit(","), F.col("o")))
    place = F.when(F.col("event_type").isin("purchase", "view"), F.concat(F.lit("1#x#"), F.when(F.col("event_type") == "purchase", "TU").otherwise("UZ"), F.lit("#a#b#1#2#f#"), F.col("o")))
    rows = e.groupBy("user_id", "day").agg(F.array_join(F.array_sort(F.collect_list(theme)), ";").alias("v2t"), F.array_join(F.array_sort(F.collect_list(place)), ";").alias("v2l")).filter("v2t <> '' OR v2l <> ''")
    return rows.select(F.col("day").alias("date"), F.lit("s").alias("source"), F.concat(F.lit("http://x/"), "user_id").alias("url"), F.lit("").alias("v1t"), "v2t", F.lit("").alias("v1l"), "v2l", F.lit("").alias("v1p"), F.lit("").alias("v1o"))


_DUMP_SQL = """m AS (SELECT user_id, strftime(ts, '%Y%m%d') AS day, event_type AS k, hour(ts) * 60 + minute(ts) AS o FROM events),
    g AS (SELECT a.user_id, a.day, CAST(min(abs(a.o - b.o)) AS INTEGER) AS gap FROM m a JOIN m b USING (user_id, day) WHERE a.k = 'error' AND b.k = 'purchase' GROUP BY ALL),
    s AS (SELECT user_id, day, CAST(count(*) FILTER (k = 'purchase') AS DOUBLE) / count(*) FILTER (k IN ('purchase', 'view')) AS share FROM m GROUP BY ALL),
    j AS (SELECT * FROM g JOIN s USING (user_id, day))"""


@query(f"WITH {_DUMP_SQL} SELECT 'http://x/' || user_id AS url, strftime(strptime(day, '%Y%m%d'), '%Y-%m-%d') AS date, gap, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS n FROM j WHERE share >= 0.3 AND gap <= 400) WHERE n = 1")
def dump_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = proximity.Query(["ERROR"], ["TU"], 400, 0.3)
    return proximity.select(_dump(spark, sf_dir), q).select("url", F.col("date").cast("string").alias("date"), "gap", _r("share").alias("share"))


@query(f"WITH {_DUMP_SQL} SELECT count(*) AS rows, count(*) FILTER (share >= 0.3 AND gap <= 400) AS passed, count(*) FILTER (NOT (share >= 0.3 AND gap <= 400)) AS dropped, CAST(0 AS BIGINT) AS fallback FROM j")
def dump_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.counters(_dump(spark, sf_dir), proximity.Query(["ERROR"], ["TU"], 400, 0.3)).select("rows", "passed", "dropped", "fallback")


# Filters and text

_HOST = "regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^:/?#]*)', 1), '^(?:www|m|amp|mobile|edition|en|ru)\\.', '')"
_PUBLISHER = f"CASE WHEN regexp_extract(url, '^https?://[^/]+/news/(\\d+)/', 1) <> '' THEN 'wire:' || regexp_extract(url, '^https?://[^/]+/news/(\\d+)/', 1) ELSE {_HOST} END"


@query(f"SELECT page_id, {_PUBLISHER} AS publisher FROM pages")
def url_publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", T.publisher(F.col("url")).alias("publisher"))


@query(f"SELECT story, count(DISTINCT p) AS outlets FROM (SELECT page_id % 50 AS story, {_PUBLISHER} AS p FROM pages) WHERE p <> '' GROUP BY story")
def publisher_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.outlets(_t(spark, sf_dir, "pages").withColumn("story", F.col("page_id") % 50), "story", "url")


@query("SELECT doc_id, CASE WHEN length(text) < 300 THEN 'short' WHEN regexp_matches(lower(substr(text, 1, 2000)), '\\b(?:interview|analysis|opinion|column)\\b') THEN 'non_event' END AS verdict FROM documents")
def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("url"), F.lit("").alias("title"), "text")
    return pages.sift(d).select("doc_id", "verdict")


@query("SELECT page_id, regexp_matches(lower(substr(html, 1, 1500)), 'just a moment|attention required|checking your browser|you have been blocked') AS shield FROM pages")
def antibot_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", T.is_antibot(F.lit(""), F.col("html")).alias("shield"))


@query("SELECT doc_id, translate(substr(text, 1, 260), chr(9) || chr(10), '  ') AS head FROM documents")
def one_line_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", T.one_line_head(F.col("text")).alias("head"))


_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')"


@query(f"SELECT doc_id, len(regexp_extract_all({_ASCII}, '[A-Za-z0-9]+')) AS n, len(list_distinct(regexp_extract_all(lower({_ASCII}), '[a-z0-9]+'))) AS n_distinct FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.words(F.regexp_replace("text", r"[^\x00-\x7F]", " "))
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')), '[a-z0-9]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 4)),
    l AS (SELECT doc_id, list(s ORDER BY s) AS k FROM s GROUP BY doc_id), c AS (SELECT min(doc_id) AS id, count(*) AS n, k FROM l GROUP BY k), e AS (SELECT id, n, unnest(k) AS s FROM c)
    SELECT a.id AS a, b.id AS b, count(*) AS both, any_value(a.n) AS a_rows, any_value(b.n) AS b_rows, false AS copy FROM e a JOIN e b USING (s) WHERE a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 20
    UNION ALL SELECT c.id, l.doc_id, len(k), n, n, true FROM c JOIN l USING (k) WHERE c.id < l.doc_id AND len(k) >= 20""")
def shingle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.ascii_shingles(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return metrics.shared_sets(d, 20, members=True)


@query("SELECT doc_id, round(CASE WHEN l = 0 THEN 0.0 ELSE c::DOUBLE / l END, 6) AS cyrillic, m AS symbols FROM (SELECT doc_id, len(regexp_extract_all(text, '\\pL')) AS l, len(regexp_extract_all(text, '[а-яёА-ЯЁ]')) AS c, len(regexp_extract_all(text, '[%*#]')) AS m FROM documents)")
def script_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", _r(T.cyrillic_share(F.col("text"))).alias("cyrillic"), F.regexp_count("text", F.lit("[%*#]")).cast("long").alias("symbols"))


_FREQUENCY = {w: 6.0 for w in "и в не на что с по как это".split()}  # a caller's list is longer


@query()
def text_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"), F.max_by("text", "turn").alias("summary"), F.array_join(F.collect_list("text"), " ").alias("source"))
    return c.select("conv_id", T.summary_fault(F.col("title"), F.col("summary"), F.col("source"), T.frequency_of(_FREQUENCY)).alias("fault"))


@query("SELECT doc_id, list_filter(list_distinct(regexp_extract_all(text, '[0-9]{3,}')), lambda x: NOT regexp_matches(x, '^(19|20)..$')) = [] AS fine FROM (SELECT doc_id, regexp_replace(text, '[^0-9a-z]', 'a', 'g') AS text FROM documents)")
def numbers_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", "[^0-9a-z]", "a"))
    return d.select("doc_id", (F.size(T.numbers_not_in_source(F.col("text"), F.lit("none"))) == 0).alias("fine"))


# Dates


@query("SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' - 7 AND DATE '1997-01-01' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS kept, strftime(o_orderdate, '%d.%m.%Y') AS shown FROM orders")
def date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _t(spark, sf_dir, "orders").select("o_orderkey", D.clamp(iso, F.lit("1997-01-01").cast("date")).alias("kept"), D.display(iso).alias("shown"))


@query("""SELECT o_orderkey, CASE WHEN e > p THEN CASE WHEN p BETWEEN t - 7 AND t THEN strftime(p, '%Y-%m-%d') ELSE '' END WHEN NOT e BETWEEN t - 7 AND t THEN CASE WHEN p BETWEEN t - 7 AND t THEN strftime(p, '%Y-%m-%d') ELSE '' END ELSE strftime(e, '%Y-%m-%d') END AS date,
    CASE WHEN e > p THEN 'after publication' WHEN NOT e BETWEEN t - 7 AND t THEN 'outside the window' ELSE '' END AS reason
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS p, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 - 6 AS INTEGER) AS e, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER) AS t FROM orders)""")
def event_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("p"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 9 - 6).cast("int")).alias("e"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 4).cast("int")).alias("t"))
    named = F.concat(F.lit("It was on "), F.date_format("e", "d MMMM"), F.lit(" in the town."))
    found = D.choose(F.col("e").cast("string"), F.col("p").cast("string"), named, F.col("t"))
    return o.select("o_orderkey", found["date"].alias("date"), found["reason"].alias("reason"))


@query("SELECT event_id, strftime(to_timestamp(floor(epoch(ts))) AT TIME ZONE 'Europe/Moscow', '%d.%m.%Y %H:%M') AS shown FROM events")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", D.local_time(F.unix_seconds("ts")).alias("shown"))


# Verdicts


@query("SELECT event_id, r AS region, CASE WHEN r = 'NO' THEN NULL ELSE CAST(least(greatest(k % 7, 1), 5) AS INTEGER) END AS scale FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE CAST(json_extract(props, '$.k') AS INTEGER) % 5 WHEN 0 THEN 'NO' WHEN 1 THEN 'TR' WHEN 2 THEN 'CA' WHEN 3 THEN 'SC' ELSE 'MIX' END AS r FROM events)")
def judge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    r = F.lower(F.element_at(F.array(*map(F.lit, ("NO", "TR", "CA", "SC", "MIX"))), k % 5 + 1))
    answer = F.concat(F.lit('Here: {"1": {"w": "x", "r": "'), r, F.lit('", "s": "'), (k % 7).cast("string"), F.lit('"}}'))
    v = J.parse_judge(answer, 1)
    return _t(spark, sf_dir, "events").select("event_id", v[0]["region"].alias("region"), v[0]["scale"].alias("scale"))


@query()
def judged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.judge(_t(spark, sf_dir, "documents"), adapters.stub_judge, "doc_id")


# Journal


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are URLs, their events before the 16th are the journal."""
    e = _t(spark, sf_dir, "events").filter("ts < TIMESTAMP '2024-01-16'")
    verdict = F.element_at(F.create_map(*(F.lit(x) for p in _VERDICTS.items() for x in p)), F.col("event_type"))
    j = e.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.max_by(verdict, F.struct("ts", "event_id")).alias("verdict"), F.count("*").cast("int").alias("attempts"))
    return j.select(F.concat(F.lit("http://x/"), "user_id").alias("url"), (F.col("user_id") % 3).cast("int").alias("query_index"), F.date_format("a", "yyyy-MM-dd").alias("first_seen"), F.date_format("b", "yyyy-MM-dd").alias("last_seen"), "verdict", "attempts", F.when(F.col("user_id") % 4 == 0, F.array(F.lit(1.0))).cast("array<float>").alias("embedding"))


_VERDICTS = {"click": "accepted", "view": "pending", "purchase": "rejected", "error": "short", "signup": "non_event", "login": "prefiltered", "search": "pending", "logout": "prefiltered"}
_VERDICT_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _VERDICTS.items()) + " END"
_JOURNAL_SQL = f"""j AS (SELECT 'http://x/' || user_id AS url, CAST(user_id % 3 AS INTEGER) AS query_index, strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(max(ts), '%Y-%m-%d') AS last_seen,
    arg_max({_VERDICT_SQL}, (ts, event_id)) AS verdict, CAST(count(*) AS INTEGER) AS attempts, user_id % 4 = 0 AS emb FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id)"""
_UPDATES_SQL = f"u AS (SELECT 'http://x/' || user_id AS url, arg_max({_VERDICT_SQL}, event_id) AS v, CAST(count(*) AS INTEGER) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND user_id % 2 = 0 GROUP BY user_id)"


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").filter("ts >= TIMESTAMP '2024-01-16' AND user_id % 2 = 0")
    verdict = F.element_at(F.create_map(*(F.lit(x) for p in _VERDICTS.items() for x in p)), F.col("event_type"))
    return e.select(F.concat(F.lit("http://x/"), "user_id").alias("url"), F.lit(9).alias("query_index"), verdict.alias("verdict"), F.lit(None).cast("array<float>").alias("embedding"), F.col("event_id").alias("seq"))


@query(f"WITH {_JOURNAL_SQL}, {_UPDATES_SQL} SELECT url, CAST(coalesce(query_index, 9) AS INTEGER) AS query_index, coalesce(first_seen, '2024-02-01') AS first_seen, CASE WHEN n IS NOT NULL THEN '2024-02-01' ELSE last_seen END AS last_seen, coalesce(v, verdict) AS verdict, CAST(coalesce(attempts, 0) + coalesce(n, 0) AS INTEGER) AS attempts, coalesce(emb, false) AS has_embedding FROM j FULL JOIN u USING (url)")
def journal_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = journal.mark(_journal(spark, sf_dir), _updates(spark, sf_dir), "2024-02-01")
    return j.withColumn("has_embedding", F.col("embedding").isNotNull()).drop("embedding")


@query(f"WITH {_JOURNAL_SQL}, f AS (SELECT DISTINCT 'http://x/' || user_id AS url FROM events WHERE ts >= TIMESTAMP '2024-01-25') SELECT url, f.url IS NOT NULL AS fresh FROM (SELECT url FROM f UNION SELECT url FROM j WHERE verdict = 'pending') a LEFT JOIN (SELECT url AS u FROM f) f2 ON a.url = f2.u LEFT JOIN f USING (url) WHERE url NOT IN (SELECT url FROM j WHERE verdict <> 'pending')".replace(" LEFT JOIN (SELECT url AS u FROM f) f2 ON a.url = f2.u", ""))
def journal_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = _t(spark, sf_dir, "events").filter("ts >= TIMESTAMP '2024-01-25'").select(F.concat(F.lit("http://x/"), "user_id").alias("url"))
    return journal.candidates(fresh, _journal(spark, sf_dir)).select("url", "fresh")


@query(f"WITH {_JOURNAL_SQL} SELECT url, attempts, row_number() OVER (ORDER BY attempts, first_seen, url) AS place FROM j WHERE verdict = 'pending'")
def pending_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.pending(_journal(spark, sf_dir)).select("url", "attempts", F.col("place").cast("long").alias("place"))


@query(f"WITH {_JOURNAL_SQL} SELECT url FROM j WHERE emb OR CAST(last_seen AS DATE) >= DATE '2024-02-14' - 30")
def journal_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.prune(_journal(spark, sf_dir), F.lit("2024-02-14").cast("date")).select("url")


@query(f"WITH {_JOURNAL_SQL} SELECT verdict, count(*) AS n FROM j GROUP BY verdict")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.verdict_counts(_journal(spark, sf_dir))


@query(f"WITH {_JOURNAL_SQL} SELECT count(*) FILTER (verdict = 'accepted') AS accepted, count(*) FILTER (verdict = 'rejected') AS rejected FROM j WHERE emb")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.label_counts(_journal(spark, sf_dir))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return journal.insert_or_ignore(o.filter("o_orderkey % 3 = 0").select("o_orderkey", "o_orderstatus"), o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("new").alias("o_orderstatus")), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-06-10' - 7")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.retained(_t(spark, sf_dir, "orders").withColumn("fetch_date", F.to_date("o_orderdate")), F.lit("1997-06-10").cast("date")).select("o_orderkey")


@query("SELECT doc_id, CASE g WHEN 3 THEN 5 WHEN 2 THEN 3 ELSE g END AS scale FROM (SELECT doc_id, CAST(1 + quality + toxic AS INTEGER) AS g FROM labels)")
def recode_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.recode_scale(_t(spark, sf_dir, "labels").select("doc_id", (F.lit(1) + F.col("quality") + F.col("toxic")).cast("int").alias("scale")))


@query("SELECT max(n) AS largest FROM (SELECT count(*) AS n FROM orders GROUP BY CAST(o_orderdate AS DATE))")
def largest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.largest_day(_t(spark, sf_dir, "orders").withColumn("fetch_date", F.to_date("o_orderdate")))


@query("SELECT lang AS language, count(*) AS n FROM documents WHERE doc_id % 7 = 3 GROUP BY lang")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.col("lang").alias("language"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 7).cast("int")).alias("fetch_date"))
    return journal.language_counts(d, F.lit("2026-01-04").cast("date"))


@query("""SELECT vec_id FROM (SELECT vec_id, len(embedding) AS n, CASE vec_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE strftime(DATE '2026-01-01' + CAST(vec_id % 20 AS INTEGER), '%Y-%m-%d') END AS p, strftime(DATE '2026-01-01' + CAST(vec_id % 17 AS INTEGER), '%Y-%m-%d') AS f FROM embeddings)
    WHERE n = 64 AND ((p IS NOT NULL AND p >= '2026-01-08') OR (p IS NULL AND f >= '2026-01-08'))""")
def week_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    day = lambda n: F.date_add(F.lit("2026-01-01").cast("date"), (F.col("vec_id") % n).cast("int")).cast("string")
    e = e.withColumn("publish_date", F.when(F.col("vec_id") % 3 == 1, "").when(F.col("vec_id") % 3 == 2, day(20))).withColumn("fetch_date", day(17))
    return journal.week(e, F.lit("2026-01-15").cast("date"), size=64).select("vec_id")


# Entities and factors

_NAMES_SQL = "n AS (SELECT DISTINCT p_partkey, lower(trim(unnest(string_split(p_name, ' ')))) AS name FROM part), k AS (SELECT * FROM n WHERE length(name) >= 4)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", T.names(F.replace("p_name", F.lit(" "), F.lit(";"))).alias("names"))


@query(f"WITH {_NAMES_SQL} SELECT name, count(*) AS df FROM k GROUP BY name")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.document_frequency(_named(spark, sf_dir), "p_partkey", "names")


@query(f"WITH {_NAMES_SQL}, d AS (SELECT name FROM k GROUP BY name HAVING count(*) >= 3) SELECT p.p_partkey, count(d.name) AS prominent FROM part p LEFT JOIN k USING (p_partkey) LEFT JOIN d USING (name) GROUP BY p.p_partkey")
def prominent_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.prominent_entities(_named(spark, sf_dir), "p_partkey", "names")


_VERSIONS_SQL = "v AS (SELECT doc_id, doc_id % 40 AS story, source, lang, CAST(1 + quality * 2 + toxic * 2 AS INTEGER) AS grade FROM documents LEFT JOIN labels USING (doc_id))"
_SCALE_SQL = "s AS (SELECT story, avg(v) AS scale FROM (SELECT story, source, avg((grade - 1) / 4.0) AS v FROM v WHERE grade IS NOT NULL GROUP BY ALL) GROUP BY story)"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", (F.col("doc_id") % 40).alias("story"), "source", "lang", (F.lit(1) + F.col("quality") * 2 + F.col("toxic") * 2).cast("int").alias("grade"))


@query(f"WITH {_VERSIONS_SQL}, {_SCALE_SQL} SELECT story, round(scale, 6) AS scale FROM s")
def story_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.story_scale(_versions(spark, sf_dir), "story", "source", "grade").withColumn("scale", _r("scale"))


@query("SELECT user_id AS story, coalesce(min(CASE WHEN event_type <> 'view' THEN strftime(ts, '%Y-%m-%d') END), 'none') AS date FROM events GROUP BY user_id")
def story_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("story"), F.when(F.col("event_type") != "view", F.date_format("ts", "yyyy-MM-dd")).otherwise("").alias("date"), F.lit("none").alias("fallback"))
    return scoring.story_date(e, "story", "date", "fallback")


@query("SELECT doc_id, round(CASE WHEN count(*) OVER w > 1 THEN (row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) - 1)::DOUBLE / (count(*) OVER w - 1) ELSE 0.0 END, 6) AS rank, round(CASE WHEN max(length(text)) OVER w = min(length(text)) OVER w THEN 0.5 ELSE (length(text) - min(length(text)) OVER w)::DOUBLE / (max(length(text)) OVER w - min(length(text)) OVER w) END, 6) AS scaled FROM documents WINDOW w AS (PARTITION BY lang)")
def pct_rank_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.char_length("text").alias("n"))
    return scoring.ranks_and_scale(d, "n", "doc_id", ["lang"]).select("doc_id", _r("rank").alias("rank"), _r("scaled").alias("scaled"))


_FACTORS_SQL = f"""{_VERSIONS_SQL}, {_SCALE_SQL}, c AS (SELECT story, CAST(count(DISTINCT source) AS BIGINT) AS outlets, least(1.0, count(DISTINCT lang) / 4.0) AS prominence FROM v GROUP BY story),
    f AS (SELECT story, story % 4 AS bucket, outlets, prominence, scale FROM c LEFT JOIN s USING (story)),
    x AS (SELECT *, greatest(max(outlets) OVER w, 3) AS full_at, max(CASE WHEN prominence > 0 THEN 1 ELSE 0 END) OVER w AS we, max(CASE WHEN scale IS NOT NULL THEN 1 ELSE 0 END) OVER w AS ws FROM f WINDOW w AS (PARTITION BY bucket)),
    i AS (SELECT story AS id, bucket, (0.25 * CASE WHEN outlets <= 1 THEN 0.0 ELSE least(1.0, ln(outlets::DOUBLE) / ln(full_at::DOUBLE)) END + 0.15 * we * prominence + 0.4 * ws * coalesce(scale, 0.5)) / (0.25 + 0.15 * we + 0.4 * ws) AS importance FROM x),
    r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY round(importance, 9) DESC, id) AS rank FROM i)"""


def _scored(spark: SparkSession, sf_dir: str, one_scale: bool = False) -> DataFrame:
    v = _versions(spark, sf_dir)
    facts = v.groupBy("story").agg(F.countDistinct("source").alias("outlets"), scoring.entity_weight(F.countDistinct("lang")).alias("prominence")).join(scoring.story_scale(v, "story", "source", "grade"), "story", "left")
    facts = facts.select(F.col("story").alias("id"), (F.lit(0) if one_scale else F.col("story") % 4).alias("bucket"), "outlets", "prominence", "scale")
    s = scoring.importance(facts, ["bucket"], "id")
    return scoring.ranked(s.withColumn("importance", F.round("importance", 9)), ["bucket"], "id")


@query(f"WITH {_FACTORS_SQL} SELECT id, bucket, round(importance, 6) AS importance, rank FROM r")
def blend_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", "bucket", _r("importance").alias("importance"), F.col("rank").cast("long").alias("rank"))


def _named_buckets(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.element_at(F.array(*map(F.lit, ("TR", "CA", "SC", "MIX"))), (F.col("bucket") + 1).cast("int")))


_QUOTAS = "(VALUES (0, 'TR', 7, 2, 9), (1, 'CA', 7, 2, 4), (2, 'SC', 6, 1, 3)) q(bucket, name, quota, lo, hi)"


@query(f"WITH {_FACTORS_SQL} SELECT id, q.name AS bucket, rank FROM r JOIN {_QUOTAS} USING (bucket) WHERE rank <= quota")
def quota_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = topk.quota_topk(_named_buckets(_scored(spark, sf_dir)), {"TR": 7, "CA": 7, "SC": 6})
    return picked.select("id", "bucket", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_FACTORS_SQL}, cut AS (SELECT id, name, importance, rank <= lo AS fl FROM r JOIN {_QUOTAS} USING (bucket) WHERE rank <= hi AND (rank <= lo OR importance >= 0.4)) SELECT id, name AS bucket FROM (SELECT *, row_number() OVER (ORDER BY fl DESC, round(importance, 9) DESC, id) AS p FROM cut) WHERE fl OR p <= 10")
def soft_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.soft_quota(_named_buckets(_scored(spark, sf_dir)), {"TR": (2, 9), "CA": (2, 4), "SC": (1, 3)}, 10, 0.4).select("id", "bucket")


@query(f"WITH {_FACTORS_SQL.replace('(PARTITION BY bucket)', '()', 1)} SELECT id FROM i ORDER BY round(importance, 9) DESC, id LIMIT 12")
def global_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scale over all stories: normalisers are those of the whole, not of a bucket."""
    return topk.global_topk(_scored(spark, sf_dir, one_scale=True), 12).select("id")


@query(f"WITH {_FACTORS_SQL} SELECT id FROM r JOIN {_QUOTAS} USING (bucket) WHERE rank > quota UNION ALL SELECT id FROM r WHERE bucket = 3")
def deficit_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named_buckets(_scored(spark, sf_dir))
    return topk.deficit_pool(topk.leftovers(rows, topk.quota_topk(rows, {"TR": 7, "CA": 7, "SC": 6}))).select("id")


@query(f"WITH {_FACTORS_SQL} SELECT id, rank FROM (SELECT *, greatest(0, least(5 - 1, count(*) OVER (PARTITION BY bucket) - 4)) AS lo FROM r) WHERE rank > lo AND rank <= lo + 4")
def around_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.around_cut(_scored(spark, sf_dir), 5, 4).select("id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_FACTORS_SQL} SELECT id FROM (SELECT *, count(*) OVER (PARTITION BY bucket) AS n FROM r) WHERE rank <= ceil(n / 3.0)")
def top_third(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_third(_scored(spark, sf_dir)).select("id")


@query(f"WITH {_FACTORS_SQL} SELECT bucket, round(importance - next, 6) AS gap FROM (SELECT *, lead(importance) OVER (PARTITION BY bucket ORDER BY rank) AS next FROM r) WHERE rank = 5")
def gap_at_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gap_at_cut(_scored(spark, sf_dir), 5, ["bucket"]).withColumn("gap", _r("gap"))


@query(f"WITH {_FACTORS_SQL}, a AS (SELECT avg(importance) AS w, count(*) AS n FROM r WHERE rank <= 5), b AS (SELECT importance, row_number() OVER (ORDER BY round(importance, 9) DESC, id) AS p FROM r) SELECT round(w, 6) AS with_quota, round(avg(importance), 6) AS without_quota, round(avg(importance) - w, 6) AS cost FROM a, b WHERE p <= n GROUP BY w")
def quota_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quota_cost(_scored(spark, sf_dir), 5, ["bucket"]).select(*(_r(c).alias(c) for c in ("with_quota", "without_quota", "cost")))


@query(f"WITH {_FACTORS_SQL}, t AS (SELECT id, 0 AS x FROM r WHERE rank <= 5), u AS (SELECT id FROM r ORDER BY round(importance, 9) DESC, id LIMIT 20) SELECT id, 'left' AS change FROM t WHERE id NOT IN (SELECT id FROM u) UNION ALL SELECT id, 'entered' FROM u WHERE id NOT IN (SELECT id FROM t)")
def selection_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return metrics.selection_changes(s.filter("rank <= 5"), topk.global_topk(s, 20), "id")


@query(f"WITH {_FACTORS_SQL} SELECT count(*) AS both FROM (SELECT id FROM r WHERE rank <= 5 INTERSECT SELECT id FROM (SELECT id FROM r ORDER BY round(importance, 9) DESC, id LIMIT 20))")
def selection_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return metrics.overlap(s.filter("rank <= 5"), topk.global_topk(s, 20), "id")


@query(f"WITH {_VERSIONS_SQL}, {_SCALE_SQL} SELECT story % 4 AS bucket, count(*) AS n FROM (SELECT *, max(round(scale, 9)) OVER (PARTITION BY story % 4) AS m FROM s) WHERE round(scale, 9) = m GROUP BY ALL")
def top_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.story_scale(_versions(spark, sf_dir), "story", "source", "grade").select((F.col("story") % 4).alias("bucket"), F.round("scale", 9).alias("scale"))
    return metrics.top_scale(s, ["bucket"], "scale")


@query()
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.stratified(_t(spark, sf_dir, "labels"), "quality", 20, key="doc_id")


# Vectors and clusters

_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"""WITH c AS (SELECT min(vec_id) AS vec_id, embedding FROM embeddings GROUP BY embedding)
    SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 5) AS cos, false AS copy FROM c a, c b WHERE a.vec_id < b.vec_id AND {_COS} >= {COSINE}
    UNION ALL SELECT a.vec_id, b.vec_id, 1.0, true FROM c a JOIN embeddings b USING (embedding) WHERE a.vec_id < b.vec_id""")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.similar_classes(_t(spark, sf_dir, "embeddings"), COSINE, "vec_id").withColumn("cos", F.round("cos", 5))


@query(f"""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND {_COS} >= {COSINE}),
    n AS (SELECT e.vec_id AS id, row_number() OVER (ORDER BY e.vec_id) AS k, coalesce(list(p.a) FILTER (p.a IS NOT NULL), []) AS below FROM embeddings e LEFT JOIN p ON p.b = e.vec_id GROUP BY e.vec_id),
    w AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS leaders UNION ALL SELECT n.k, CASE WHEN list_has_any(w.leaders, n.below) THEN w.leaders ELSE list_append(w.leaders, n.id) END FROM w JOIN n ON n.k = w.k + 1)
    SELECT id AS vec_id, CASE WHEN list_contains(l, id) THEN id ELSE list_min(list_intersect(l, below)) END AS leader FROM n, (SELECT leaders AS l FROM w ORDER BY k DESC LIMIT 1)""")
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster(_t(spark, sf_dir, "embeddings"), COSINE, "vec_id").select("vec_id", "leader")


@query("SELECT label AS leader, count(*) AS n_versions, min(CASE WHEN k = 1 THEN vec_id END) AS representative, string_agg(vec_id, ' ' ORDER BY k) AS versions FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY length(coalesce(text, '')) DESC, vec_id) AS k FROM embeddings LEFT JOIN documents ON vec_id = doc_id) GROUP BY label")
def story_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").join(_t(spark, sf_dir, "documents"), F.col("vec_id") == F.col("doc_id"), "left").withColumnRenamed("label", "leader")
    return cluster.stories(e, "vec_id").select("leader", "n_versions", "representative", F.array_join(F.col("versions").cast("array<string>"), " ").alias("versions"))


@query("SELECT vec_id, coalesce(v, 'pending') AS verdict FROM embeddings LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS v FROM labels) ON label = doc_id")
def verdict_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _t(spark, sf_dir, "labels").select(F.col("doc_id").cast("int").alias("leader"), F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("verdict"))
    return cluster.fan_out(_t(spark, sf_dir, "embeddings").withColumnRenamed("label", "leader"), v).select("vec_id", "verdict")


@query(f"SELECT a.vec_id, round(greatest(0.0, least(1.0, (1 - max({_COS})) / 0.12)), 5) AS novelty, round(max({_COS}), 5) AS cos FROM embeddings a, embeddings b WHERE a.vec_id % 12 > 0 AND b.vec_id % 12 = 0 GROUP BY a.vec_id")
def novelty_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    near = cluster.max_cosine(e.filter("vec_id % 12 > 0"), e.filter("vec_id % 12 = 0"), "vec_id")
    return near.select(F.col("id").alias("vec_id"), F.round(scoring.novelty(F.col("cos")), 5).alias("novelty"), F.round("cos", 5).alias("cos"))


_ISSUES = "(SELECT vec_id, DATE '2026-01-04' + CAST(vec_id % 12 AS INTEGER) AS d, embedding FROM embeddings)"


@query(f"SELECT count(*) AS compared, round(avg(CASE WHEN cos >= {COSINE} THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT a.vec_id, max({_COS}) AS cos FROM {_ISSUES} a JOIN {_ISSUES} b ON b.d < a.d GROUP BY a.vec_id)")
def repeat_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _t(spark, sf_dir, "embeddings").withColumn("d", F.date_add(F.lit("2026-01-04").cast("date"), (F.col("vec_id") % 12).cast("int")))
    return metrics.repeat_share(i, "vec_id", "d", "embedding", COSINE).withColumn("share", _r("share"))


@query("SELECT vec_id FROM (SELECT vec_id, DATE '2026-01-04' + CAST(vec_id % 12 AS INTEGER) AS d FROM embeddings) WHERE dayofweek(d) = (SELECT dayofweek(max(DATE '2026-01-04' + CAST(vec_id % 12 AS INTEGER))) FROM embeddings)")
def weekly_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _t(spark, sf_dir, "embeddings").select("vec_id", F.date_add(F.lit("2026-01-04").cast("date"), (F.col("vec_id") % 12).cast("int")).alias("issue_date"))
    return metrics.weekly(i).select("vec_id")


@query("SELECT vec_id, len(embedding) AS size, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("size"), F.round(V.norm(F.col("embedding")), 5).alias("norm"))


@query()
def lexrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").withColumn("outlet", (F.col("vec_id") % 7).cast("string"))
    return scoring.lexrank(e, "label", "vec_id", "embedding", "outlet")


@query()
def prefilter_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.col("label") < 5).cast("int").alias("y"))
    return prefilter.gate(e, prefilter.train(e, least=100, minority=20, gain=0.0)).select("id", "dropped")


# Sentences

_WORDS = "regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')), '[a-z0-9]+')"


@query(f"""WITH t AS (SELECT conv_id, turn, list_distinct({_WORDS}) AS ws FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
    c AS (SELECT conv_id, word, count(*) AS c FROM (SELECT conv_id, unnest(ws) AS word FROM t) GROUP BY ALL) SELECT conv_id AS story, word, round(c / n::DOUBLE * (1 - c / (n + 1)::DOUBLE), 6) AS weight FROM c JOIN n USING (conv_id)""")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("story"), F.regexp_replace("text", r"[^\x00-\x7F]", " ").alias("text"))
    return selection.word_weights(c, "story", "text").withColumn("weight", _r("weight"))


@query(f"""WITH t AS (SELECT conv_id, turn, list_distinct({_WORDS}) AS ws FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), e AS (SELECT conv_id, turn, unnest(ws) AS word FROM t),
    c AS (SELECT conv_id, word, count(*) AS c FROM e GROUP BY ALL), w AS (SELECT conv_id, word, c / n::DOUBLE * (1 - c / (n + 1)::DOUBLE) AS weight FROM c JOIN n USING (conv_id))
    SELECT conv_id * 1000 + turn AS id, round(sum(weight) / sqrt(count(*)) * CASE turn WHEN 0 THEN 1.3 WHEN 1 THEN 1.1 ELSE 1.0 END, 5) AS score FROM e JOIN w USING (conv_id, word) GROUP BY conv_id, turn""")
def sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("story"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("turn").alias("pos"), F.regexp_replace("text", r"[^\x00-\x7F]", " ").alias("text"))
    return selection.sentence_scores(c, "story", "id", "pos", "text").withColumn("score", F.round("score", 5))


@query()
def sentence_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").withColumn("story", F.col("doc_id") % 50)
    return selection.select_sentences(d, "story", "source", "text", 2000)


# Metrics


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = metrics.percentiles(_t(spark, sf_dir, "events"), "value", [0.5, 0.75, 0.9, 0.95])
    return p.select(*(_r(c).alias(c) for c in p.columns))


@query("WITH a AS (SELECT user_id AS id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id AS id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), d AS (SELECT b.v - a.v AS d FROM a JOIN b USING (id)) SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d) / sqrt(count(*)), 6) AS error, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down FROM d")
def paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = lambda k: _t(spark, sf_dir, "events").filter(F.col("event_type") == k).groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("v"))
    return metrics.paired_difference(arm("view"), arm("click"), "id", "v").withColumn("mean", _r("mean")).withColumn("error", _r("error"))


@query("""WITH g AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS rank, quality + 2 * toxic AS gain FROM documents JOIN labels USING (doc_id)),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY gain DESC, rank) AS best FROM g) SELECT lang, round(sum(CASE WHEN rank <= 7 THEN gain / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN best <= 7 THEN gain / log2(best + 1) ELSE 0 END), 0), 6) AS ndcg FROM b GROUP BY lang""")
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    g = d.select("lang", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(F.char_length("text")), "doc_id")).alias("rank"), (F.col("quality") + 2 * F.col("toxic")).alias("gain"))
    return metrics.ndcg(g, 7, ["lang"]).withColumn("ndcg", _r("ndcg"))


@query("SELECT round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(abs(a - b) / 4.0), 6) AS gap FROM (SELECT 1 + event_id % 5 AS a, 1 + user_id % 5 AS b FROM events)")
def self_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select((1 + F.col("event_id") % 5).alias("a"), (1 + F.col("user_id") % 5).alias("b"))
    return metrics.self_agreement(e, "a", "b", 5).select(_r("exact").alias("exact"), _r("gap").alias("gap"))


@query("SELECT 1 + quality + toxic AS grade, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels)::DOUBLE, 6) AS share FROM labels GROUP BY 1")
def grade_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.grade_histogram(_t(spark, sf_dir, "labels").withColumn("g", 1 + F.col("quality") + F.col("toxic")), "g").withColumn("share", _r("share"))


@query("SELECT round(avg(abs(a - b)), 6) AS mae, round(corr(ra, rb), 6) AS rank_corr FROM (SELECT *, row_number() OVER (ORDER BY a, id)::DOUBLE AS ra, row_number() OVER (ORDER BY b, id)::DOUBLE AS rb FROM (SELECT c_custkey AS id, c_acctbal AS a, c_nationkey * 100.0 AS b FROM customer))")
def error_and_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"), (F.col("c_nationkey") * 100.0).alias("b"))
    return metrics.error_and_rank_correlation(c, "a", "b", "id").select(_r("mae").alias("mae"), _r("rank_corr").alias("rank_corr"))


@query("SELECT event_type AS provider, count(*) FILTER (value >= 5) AS ok, count(*) AS calls, CAST(sum(user_id % 11) AS BIGINT) AS decided, round(avg(CASE WHEN user_id % 3 = event_id % 3 THEN 1.0 ELSE 0.0 END), 6) AS region_agreement, round(avg(abs(user_id % 5 - event_id % 5)), 6) AS mae, round(median(value), 6) AS median_s, max(value) AS max_s, min(CASE WHEN event_id % 50 = 0 THEN ts END) AS first_429 FROM events GROUP BY event_type")
def provider_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    calls = e.select(F.col("event_type").alias("provider"), (F.col("value") >= 5).alias("ok"), (F.col("user_id") % 11).alias("decided"), (F.col("user_id") % 3).alias("region"), (F.col("event_id") % 3).alias("expected_region"), (F.col("user_id") % 5).alias("grade"), (F.col("event_id") % 5).alias("expected_grade"), F.col("value").alias("seconds"), F.when(F.col("event_id") % 50 == 0, 429).otherwise(200).alias("code"), F.col("ts").cast("timestamp_ntz").alias("at"))
    return metrics.scorecard(calls).withColumns({c: _r(c) for c in ("region_agreement", "mae", "median_s")}).drop("codes")


@query("SELECT lang, round(avg(len(regexp_extract_all(text, '[0-9]'))), 6) AS digits, round(avg(CASE WHEN regexp_matches(text, '[0-9]') THEN 1.0 ELSE 0.0 END), 6) AS with_digits FROM documents GROUP BY lang")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.text_features(_t(spark, sf_dir, "documents"), "lang", "text").select("lang", _r("digits").alias("digits"), _r("with_digits").alias("with_digits"))


@query("SELECT CASE WHEN o_orderpriority LIKE '1%' THEN '1' WHEN o_orderpriority LIKE '2%' THEN '2' ELSE 'other' END AS rule, count(*) AS n FROM orders GROUP BY 1")
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rejections(_t(spark, sf_dir, "orders"), "o_orderpriority", ["1", "2"])


@query("SELECT count(*) AS a_rows, count(*) FILTER (t >= 1) AS b_theme, count(*) FILTER (t >= 1 AND s >= 0.3) AS c_share, count(*) FILTER (t >= 1 AND p) AS d_top, count(*) FILTER (t >= 2 AND s >= 0.3) AS e_two_themes, count(*) FILTER (t >= 2 AND s >= 0.3 AND p) AS f_all FROM (SELECT user_id % 4 AS t, value / 20 AS s, event_type = 'view' AS p FROM events)")
def selectivity_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("themes"), (F.col("value") / 20).alias("share"), (F.col("event_type") == "view").alias("top"))
    return metrics.ladder(e)


@query("WITH i AS (SELECT vec_id, DATE '2026-01-04' + CAST(vec_id % 40 AS INTEGER) AS d FROM embeddings), m AS (SELECT max(d) AS d FROM i) SELECT vec_id FROM i, m WHERE dayofweek(i.d) = dayofweek(m.d) AND i.d < m.d")
def archive_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _t(spark, sf_dir, "embeddings").select("vec_id", F.date_add(F.lit("2026-01-04").cast("date"), (F.col("vec_id") % 40).cast("int")).alias("issue_date"))
    return metrics.archive_cut(i).select("vec_id")


@query("SELECT c_nationkey AS nation, count(*) AS n, round(median(c_acctbal), 6) AS median FROM customer GROUP BY c_nationkey")
def group_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.group_medians(_t(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation"), "nation", "c_acctbal").withColumn("median", _r("median"))


@query("SELECT d.doc_id, coalesce(1 + quality + toxic, -1) AS grade, round(CASE WHEN quality IS NOT NULL THEN (quality + toxic) / 4.0 END, 6) AS value FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def override_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = _t(spark, sf_dir, "labels").select("doc_id", (1 + F.col("quality") + F.col("toxic")).alias("grade"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.lit(3).alias("grade"))
    return metrics.override_grades(rows, other, 5, "doc_id").withColumn("value", _r("value"))


@query("SELECT lang, lang || ': n=' || count(*) || '  digits=' || CAST(sum(len(regexp_extract_all(text, '[0-9]'))) AS BIGINT) AS line FROM documents GROUP BY lang")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.regexp_count("text", F.lit("[0-9]"))).alias("digits"))
    return metrics.report_lines(d, "lang", {"n": "%d", "digits": "%d"})


@query("SELECT event_id FROM events WHERE (event_type ILIKE '%ie%' OR event_type ILIKE '%LICK%') AND user_id % 7 IN (2, 5)")
def substring_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("TAX;"), F.upper("event_type"), F.lit("_X")).alias("v1t"), F.concat(F.lit("1#n#C"), (F.col("user_id") % 7).cast("string"), F.lit("#x")).alias("v1l"))
    return proximity.by_substring(e, ["ie", "LICK"], ["C2", "C5"]).select("event_id")


@query("SELECT vec_id FROM embeddings WHERE label % 3 <> 0")
def raw_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that are no version of a picked story."""
    e = _t(spark, sf_dir, "embeddings")
    stories = cluster.stories(e.withColumn("text", F.lit("")).withColumnRenamed("label", "leader"), "vec_id")
    return topk.raw_reserve(e, stories.filter("leader % 3 = 0"), key="vec_id").select("vec_id")


@query("SELECT event_id AS name FROM events ORDER BY ts DESC, event_id LIMIT 15")
def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.newest(_t(spark, sf_dir, "events").select(F.col("event_id").alias("name"), F.col("ts").alias("changed")), 15).select("name")


@query("SELECT vec_id, i, round((embedding[i] + embedding[8 + i] + embedding[24 + i])::DOUBLE / 3, 5) AS x FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, unnest(generate_series(1, 8)) AS i FROM embeddings)")
def mean_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token vectors, here the first four eighths of each vector, one of them masked."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.array(*(F.slice("embedding", 1 + 8 * k, 8) for k in range(4))).alias("v"))
    pooled = V.mean_pool(F.col("v"), F.array(*map(F.lit, (1, 1, 0, 1))))
    return e.select("vec_id", F.posexplode(pooled).alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 5).alias("x"))


# Streams


def _stream(spark: SparkSession, sf_dir: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stream's result over all that is there, written in the shared folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return journal_stream.complete(plan(stream), storage.shared_folder(spark))


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS tick, count(*) AS n FROM events GROUP BY 1")
def stream_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, journal_stream.ticks).withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda s: journal_stream.daily_counts(s, "user_id")).withColumn("day", F.col("day").cast("string"))


# The flagship: stories of each bucket by importance, up to the quota


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with vectors are grouped into stories per language, scored by coverage, scale and novelty, and the best of each bucket are taken.

    The archive are the vectors of the first of twelve issue days, dealt by id as in the other queries; it grows with the table.
    """
    archived = F.pmod(F.col("id"), F.lit(12)) == 0
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    a = e.join(_t(spark, sf_dir, "documents"), F.col("id") == F.col("doc_id")).join(_t(spark, sf_dir, "labels"), "doc_id", "left").select("id", "embedding", "text", "source", "lang", (F.lit(1) + F.col("quality") * 2 + F.col("toxic") * 2).cast("int").alias("grade"))
    grouped = cluster.cluster(a.filter(~archived), COSINE, bucket="lang")
    archive = e.filter(archived)
    stories = cluster.stories(grouped)
    facts = grouped.filter("source <> ''").groupBy("leader").agg(F.countDistinct("source").alias("outlets"), F.first("lang").alias("bucket")).join(scoring.story_scale(grouped, "leader", "source", "grade"), "leader", "left").join(stories, "leader")
    near = cluster.max_cosine(e.filter(~archived), archive).select(F.col("id").alias("representative"), F.col("cos").alias("max_cosine"))
    scored = scoring.importance(facts.join(near, "representative").withColumnRenamed("representative", "id"), ["bucket"], "id")
    best = topk.quota_topk(scoring.ranked(scored, ["bucket"], "id"), {"en": 7, "de": 7, "fr": 6, "es": 6})
    return best.select("bucket", "id", "n_versions", "outlets", _r("importance").alias("importance"), "rank")


QUERIES["rank_stories"] = flagship
