"""The weekly plan: a week's articles to ranked stories, picks with reserves, and what is told of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import text as T
from ..operators import cluster, scoring, selection, topk
from .storage import materialize


def rank(articles: DataFrame, archive: DataFrame | None = None, topics: DataFrame | None = None, threshold: float = S.STORY_COSINE, weights: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Stories with importance and rank in their bucket, and their versions, of articles (id, url, text, embedding, bucket, entities, scale)."""
    known = articles.withColumn("bucket", F.when(F.col("bucket").isin(*S.QUOTA), F.col("bucket")).otherwise("MIX"))
    versions = materialize(cluster.cluster(known, threshold, bucket="bucket"))
    names = versions.select("id", F.split(F.coalesce("entities", F.lit("")), ";").alias("names")).withColumn("names", F.filter("names", lambda n: n != ""))
    prominent = scoring.prominent_entities(names, "id", "names").select("id", scoring.entity_weight(F.col("prominent")).alias("w"))
    graded = versions.withColumn("outlet", T.publisher(F.col("url")))
    facts = cluster.stories(versions).join(versions.groupBy("leader").agg(F.first("bucket").alias("bucket")), "leader")
    facts = facts.join(scoring.outlets(graded, "leader", "url"), "leader", "left").withColumn("outlets", F.coalesce("outlets", F.lit(0)))
    facts = facts.join(scoring.story_scale(graded, "leader", "outlet", "scale"), "leader", "left")
    facts = facts.join(versions.select("id", "leader").join(prominent, "id").groupBy("leader").agg(F.max("w").alias("prominence")), "leader", "left").withColumnRenamed("representative", "id")
    if archive is not None and not archive.isEmpty():
        facts = facts.join(cluster.max_cosine(versions.join(facts.select("id"), "id", "left_semi"), archive).withColumnRenamed("cos", "max_cosine"), "id", "left")
    if topics is not None:
        facts = facts.join(topics.select("id", "topic"), "id", "left")
    return scoring.ranked(scoring.importance(materialize(facts), ["bucket"], "id", weights), ["bucket"], "id"), versions


def choose(ranked: DataFrame, quota: dict[str, int] | None = None, items: int = S.ITEMS, weights: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Picks and reserves. A bucket's reserve is what the quota leaves, scored anew; that of MIX stays raw, without score or rank. If quotas give too few picks, the best of all the rest fill up."""
    picked = materialize(topk.quota_topk(ranked, quota or S.QUOTA))
    rest = topk.leftovers(ranked, picked).drop("importance", "rank")
    scored = scoring.ranked(scoring.importance(rest.filter("bucket <> 'MIX'"), ["bucket"], "id", weights), ["bucket"], "id")
    reserve = materialize(scored.unionByName(rest.filter("bucket = 'MIX'"), allowMissingColumns=True))
    missing = items - picked.count()
    if missing > 0:
        pool = topk.deficit_pool(reserve).drop("importance", "rank").withColumn("all", F.lit(1))
        more = topk.global_topk(scoring.importance(pool, ["all"], "id", weights), missing).drop("all")
        picked = picked.drop("rank").unionByName(more.select(*[c for c in picked.columns if c != "rank"]))
        reserve = topk.leftovers(reserve, more)
    return picked, reserve


def without_repeats(picked: DataFrame, reserve: DataFrame, vectors: DataFrame, threshold: float = S.DEDUP_COSINE, scan: int = S.MAX_RESERVE_SCAN) -> list[int]:
    """Ids of the picks, in which one that repeats another is replaced by the next of its bucket's reserve that repeats none.

    vectors (id, embedding) are of the stories before retelling, or of what is told afterwards. Picks are a quota, and of each bucket's reserve
    at most `scan` rows a pick are looked at, which is all that comes to the driver.
    """
    order = F.coalesce(F.col("rank").cast("long"), F.xxhash64("id"))
    places = {r["bucket"]: r["count"] for r in picked.groupBy("bucket").count().collect()}  # a row a bucket
    accepted: list[list[float]] = []
    out: list[int] = []
    for bucket, n in sorted(places.items()):
        ranked = [picked.filter(F.col("bucket") == bucket).select("id", order.alias("o"), F.lit(0).alias("k")), reserve.filter(F.col("bucket") == bucket).select("id", order.alias("o"), F.lit(1).alias("k")).orderBy("o", "id").limit(n * scan)]
        rows = ranked[0].unionByName(ranked[1]).join(vectors.select("id", "embedding"), "id").orderBy("k", "o", "id").collect()
        kept = cluster.not_repeated([r.asDict() for r in rows], accepted, n, threshold, scan)
        accepted += [r["embedding"] for r in kept]
        out += [r["id"] for r in kept]
    return out


def prompts(picked: DataFrame, versions: DataFrame, budget: int = 6000) -> DataFrame:
    """story and prompt of each pick, from at most a few of its versions, the longest first."""
    few = picked.select(F.col("id").alias("story"), F.explode(topk.first_versions(F.col("versions"))).alias("id"))
    return selection.prompts(selection.select_sentences(few.join(versions.select("id", "url", "text"), "id"), "story", "url", "text", budget))
