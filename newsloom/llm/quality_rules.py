"""Quality rules: cross-document line frequency. DataFrame functions only.

Each line is normalised (trimmed, lower-cased, runs of digits to 0, runs of white space to one space) and hashed. A line
that more than `max_docs` distinct documents of one host hold is removed from all of them but the first (by doc_id);
a document is rejected if less than `min_share` of the characters of its lines are left. Copies of one text under several
ids are several documents. The first document always keeps its lines, so a group of copies is never rejected as a whole.

Beside it stand the plain rules of a single text: fewer than `min_words` words, or more than `max_repeat` percent of the
words inside five-word windows that occur twice or more.

Null and empty texts have no words and fail the plain rules; a null host is a host of its own; rows with a null doc_id come after all others.
Repeated rows (same id, text and host) count as one document and share one verdict. Empty tables give empty results; extra
columns are kept by `keep_good` and ignored by `quality` and `judged`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WIDTH = 5
SYMBOLS = r"[^#*$%&|<>]"


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+", "0"), C.SPACE, " "))


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines of these hashes; lines without words are no lines and stay."""
    left = F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(C.WORD) & F.array_contains(gone, F.xxhash64(_normal(x)))))
    return F.when(F.size(gone) > 0, F.array_join(left, "\n")).otherwise(text)


def _text_rules(docs: DataFrame) -> DataFrame:
    """Adds the counts over single texts and the line hashes with their characters."""
    words = F.filter(F.split("__text", C.SPACE), lambda w: w != "")
    d = docs.withColumn("__w", words)
    d = d.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    d = d.withColumn("__win", F.when(F.size("__h") >= WIDTH, F.expr(f"transform(sequence(0, size(__h) - {WIDTH}), i -> struct(xxhash64({', '.join(f'__h[i + {k}]' for k in range(WIDTH))}) AS h, i AS i))")).otherwise(F.expr("array(struct(xxhash64(__text) AS h, -1 AS i))")))
    d = d.withColumn("__sorted", F.sort_array("__win"))
    again = F.expr("filter(transform(__sorted, (x, k) -> if(x.i >= 0 AND ((k > 0 AND x.h = __sorted[k - 1].h) OR (k + 1 < size(__sorted) AND x.h = get(__sorted, k + 1).h)), x.i, -1)), p -> p >= 0)")
    d = d.withColumn("__again", F.sort_array(again))
    covered = F.expr(f"aggregate(__again, struct(0L AS n, -{WIDTH} AS last), (a, p) -> struct(a.n + least({WIDTH}, p - a.last) AS n, p AS last), a -> a.n)")
    d = d.withColumn("n_repeat_words", covered).drop("__win", "__sorted", "__again", "__h")
    d = d.withColumn("n_words", F.size("__w").cast("long")).withColumn("word_chars", F.char_length(F.array_join("__w", "")).cast("long")).drop("__w")
    d = d.withColumn("n_symbols", F.char_length(F.regexp_replace("__text", SYMBOLS, "")).cast("long"))
    raw = F.filter(F.split("__text", "\n"), lambda x: x.rlike(C.WORD))
    d = d.withColumn("__raw", raw).withColumn("n_dup_lines", (F.size("__raw") - F.size(F.array_distinct("__raw"))).cast("long"))
    normal = F.transform("__raw", _normal)
    d = d.withColumn("__lines", F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("h"), F.char_length(x).alias("n")))).drop("__raw", "__text")
    return d


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 50, min_share: float = 0.3, min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_removed_lines, and what finds the rows again: __doc, and the hashes of the removed lines in __gone."""
    host = F.coalesce(F.xxhash64(F.col(f"`{host_col}`").cast("string")), F.lit(0))
    text = C.text_or_empty(f"`{text_col}`")
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("__text"), F.when(F.col(f"`{host_col}`").isNull(), 0).otherwise(host).alias("__host"))
    d = d.withColumn("__doc", F.xxhash64("doc_id", "__text"))
    d = C.materialize(_text_rules(d))
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    lines = d.select("__host", "__doc", order.alias("o"), F.explode(F.array_distinct(F.transform("__lines", lambda x: x["h"]))).alias("h"))
    by_doc = lines.groupBy("__host", "h", "__doc").agg(F.min("o").alias("o"))
    common = by_doc.groupBy("__host", "h").agg(F.count("*").alias("n"), F.min("o").alias("first")).filter(F.col("n") > max_docs).select("__host", "h", "first")
    common = C.materialize(common)
    every = d.select("doc_id", "__doc", "__host", order.alias("o"), F.explode("__lines").alias("l")).select("doc_id", "__doc", "__host", "o", F.col("l.h").alias("h"))
    hit = every.join(common, ["__host", "h"]).filter(F.col("o") > F.col("first")).select("__doc", "h").distinct()
    gone = hit.groupBy("__doc").agg(F.collect_set("h").alias("gone"))  # at most the document's own lines
    d = d.join(gone, "__doc", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<bigint>")))
    removed = F.filter("__lines", lambda x: F.array_contains("gone", x["h"]))
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    depleted = chars(F.col("__lines")) - chars(removed) < min_share * chars(F.col("__lines"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.size("__lines").cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed_lines"), "__doc", F.col("gone").alias("__gone"))


def _doc(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), C.text_or_empty(f"`{text_col}`"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **params: float) -> DataFrame:
    """The rows of docs that are kept, with all their columns, and their texts without the removed lines."""
    key, kept, gone = (C.free(n, docs) for n in ("__doc", "__kept", "__gone"))
    with C.scratch(docs.sparkSession) as keep:
        touched = quality(docs, id_col, text_col, host_col, **params).filter("NOT kept OR n_removed_lines > 0")
        touched = keep(C.materialize(touched.select(F.col("__doc").alias(key), F.col("kept").alias(kept), F.col("__gone").alias(gone)).dropDuplicates([key])))
    met = docs.withColumn(key, _doc(id_col, text_col)).join(touched, key, "left").filter(F.coalesce(kept, F.lit(True)))
    text = _without(F.col(f"`{text_col}`"), F.coalesce(gone, F.array().cast("array<bigint>"))).alias(text_col)
    return met.select(*(text if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **params: float) -> DataFrame:
    """What `quality` counts, and the text without the removed lines, for all rows, the rejected ones too."""
    verdicts = quality(docs, id_col, text_col, host_col, **params).dropDuplicates(["__doc"]).drop("doc_id")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), _doc(id_col, text_col).alias("__doc"))
    counts = [c for c in verdicts.columns if not c.startswith("__")]
    return own.join(verdicts, "__doc").select("doc_id", *counts, _without(F.col("text"), F.col("__gone")).alias("text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(C.table(spark, sf_dir, "documents"))


QUERIES = {"op2_quality_rules": op2_quality_rules}
_NORMAL = r"trim(regexp_replace(regexp_replace(lower(x), '\d+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))"
ORACLE_SQL = {
    "op2_quality_rules": rf"""
        WITH t AS (SELECT doc_id, text, coalesce(source, chr(0)) AS host, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS raw FROM documents),
        v AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS v FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM t WHERE len(ws) >= 5)),
        again AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS place FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS k FROM v) WHERE k > 1) GROUP BY doc_id),
        x AS (SELECT doc_id, host, {_NORMAL} AS line FROM (SELECT doc_id, host, unnest(raw) AS x FROM t)),
        common AS (SELECT host, line, min(doc_id) AS first FROM x GROUP BY ALL HAVING count(DISTINCT doc_id) > 50),
        each AS (SELECT x.doc_id, x.line, c.first IS NOT NULL AS gone FROM x LEFT JOIN common c ON c.host = x.host AND c.line = x.line AND x.doc_id > c.first),
        l AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone, sum(length(line)) AS chars, coalesce(sum(length(line)) FILTER (NOT gone), 0) AS stay, list(DISTINCT line) FILTER (gone) AS lines FROM each GROUP BY doc_id),
        b AS (SELECT t.*, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_gone, 0) AS n_removed_lines, coalesce(stay < 0.3 * chars, false) AS depleted, lines FROM t LEFT JOIN again USING (doc_id) LEFT JOIN l USING (doc_id)),
        f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(raw) - len(list_distinct(raw)) AS BIGINT) AS n_dup_lines, n_repeat_words,
               base_failed, NOT base_failed AND NOT depleted AS kept, n_lines, n_removed_lines,
               CASE WHEN n_removed_lines > 0 THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (regexp_matches(x, '[^\x20\x09-\x0D]') AND list_contains(lines, {_NORMAL}))), chr(10)) ELSE text END AS text FROM f
    """
}
