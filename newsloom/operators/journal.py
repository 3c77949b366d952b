"""The URL journal and the article table: upserts, anti-joins, retention, migration and swap, as plain DataFrame merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S

SCHEMA = "url string, query_index int, first_seen string, last_seen string, verdict string, attempts int, embedding array<float>"


def mark(journal: DataFrame, updates: DataFrame, day: str) -> DataFrame:
    """The journal after updates (url, query_index, verdict, embedding): attempts count up by the updates of a URL, the first day and
    query stay, the last verdict holds, an embedding is kept until a new one comes. `seq` orders updates of one URL, if there."""
    seq = F.col("seq") if "seq" in updates.columns else F.lit(0)
    new = updates.groupBy("url").agg(
        F.min_by("query_index", seq).alias("q"), F.max_by("verdict", seq).alias("v"), F.max_by("embedding", F.when(F.col("embedding").isNotNull(), seq)).alias("e"), F.count("*").cast("int").alias("n")
    )
    both = journal.join(new, "url", "full_outer")
    return both.select(
        "url", F.coalesce("query_index", "q").alias("query_index"), F.coalesce("first_seen", F.lit(day)).alias("first_seen"), F.when(F.col("n").isNotNull(), day).otherwise(F.col("last_seen")).alias("last_seen"),
        F.coalesce("v", "verdict").alias("verdict"), (F.coalesce("attempts", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("attempts"), F.coalesce("e", "embedding").alias("embedding"),
    )


def final_urls(journal: DataFrame) -> DataFrame:
    return journal.filter(F.col("verdict").isin(*S.FINAL_VERDICTS)).select("url")


def pending(journal: DataFrame) -> DataFrame:
    """Pending URLs in the order of the queue, with their place."""
    place = F.row_number().over(Window.orderBy("attempts", "first_seen", "url"))  # the queue alone, not the journal
    return journal.filter(F.col("verdict") == S.PENDING).select("url", "attempts", "first_seen").withColumn("place", place)


def candidates(fresh: DataFrame, journal: DataFrame) -> DataFrame:
    """Fresh rows and the pending queue, without decided URLs, one row a URL: the fresh row where there is one."""
    queue = journal.filter(F.col("verdict") == S.PENDING).select("url")
    both = fresh.withColumn("fresh", F.lit(True)).unionByName(queue.withColumn("fresh", F.lit(False)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("fresh")))
    return both.withColumn("n", first).filter("n = 1").drop("n").join(final_urls(journal), "url", "left_anti")


def prune(journal: DataFrame, today: Column, days: int = S.SEEN_KEEP_DAYS) -> DataFrame:
    """Rows with an embedding stay for ever, others for so many days."""
    return journal.filter(F.col("embedding").isNotNull() | (F.try_to_date("last_seen") >= F.date_sub(today, days)))


def verdict_counts(journal: DataFrame) -> DataFrame:
    return journal.groupBy("verdict").agg(F.count("*").alias("n"))


def label_counts(journal: DataFrame) -> DataFrame:
    """Accepted and rejected rows that can be learned from."""
    known = journal.filter("embedding IS NOT NULL")
    return known.agg(F.count_if(F.col("verdict") == "accepted").alias("accepted"), F.count_if(F.col("verdict") == "rejected").alias("rejected"))


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """existing and the first row of each new key that it does not have."""
    fresh = new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def retained(articles: DataFrame, today: Column, days: int = 7) -> DataFrame:
    return articles.filter(F.col("fetch_date") >= F.date_sub(today, days))


def recode_scale(articles: DataFrame) -> DataFrame:
    """Three grades to five; a table that already has higher ones stays."""
    top = articles.agg(F.max("scale")).first()[0] or 0
    if top > 3:
        return articles
    return articles.withColumn("scale", F.when(F.col("scale") == 3, 5).when(F.col("scale") == 2, 3).otherwise(F.col("scale")))


def migrate(table: DataFrame, schema: DataFrame) -> DataFrame:
    """table with the columns of schema that it lacks."""
    return schema.limit(0).unionByName(table, allowMissingColumns=True)


def largest_day(articles: DataFrame) -> DataFrame:
    """The largest count of articles of one day."""
    return articles.groupBy("fetch_date").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def may_swap(new: DataFrame, live: DataFrame) -> bool:
    """Whether a rebuilt table may take the live one's place: it must hold at least as many rows as the live one's largest day."""
    return new.count() >= largest_day(live).first()[0]


def language_counts(articles: DataFrame, day: Column) -> DataFrame:
    return articles.filter(F.col("fetch_date") == day).groupBy("language").agg(F.count("*").alias("n"))


def week(articles: DataFrame, today: Column, days: int = 7, size: int = S.VECTOR_SIZE) -> DataFrame:
    """Articles of the last days by the publishing date, or by the fetching date where that is null (not where it is empty), with a whole vector."""
    since = F.date_sub(today, days).cast("string")
    recent = (F.col("publish_date").isNotNull() & (F.col("publish_date").cast("string") >= since)) | (F.col("publish_date").isNull() & (F.col("fetch_date").cast("string") >= since))
    return articles.filter(recent).filter(F.col("embedding").isNotNull() & (F.size("embedding") == size))
