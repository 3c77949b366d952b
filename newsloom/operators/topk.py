"""Quotas, reserves, deficit fill and samples over scored stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S


def _limits(df: DataFrame, quota: dict[str, object], names: list[str]) -> DataFrame:
    rows = [(b, *(q if isinstance(q, tuple) else (q,))) for b, q in quota.items()]
    return df.sparkSession.createDataFrame(rows, "bucket string, " + ", ".join(f"{n} int" for n in names))


def quota_topk(ranked: DataFrame, quota: dict[str, int], bucket: str = "bucket") -> DataFrame:
    """Rows with a rank (in the bucket) up to the bucket's quota; buckets without one give none."""
    return ranked.join(F.broadcast(_limits(ranked, quota, ["quota"]).withColumnRenamed("bucket", bucket)), bucket).filter("rank <= quota").drop("quota")


def soft_quota(ranked: DataFrame, floors_and_caps: dict[str, tuple[int, int]], items: int = S.ITEMS, threshold: float | None = None, bucket: str = "bucket", score: str = "importance", key: str = "id") -> DataFrame:
    """Each bucket's floor first, whatever the scores; then by score over all buckets, up to their caps and not below the threshold, until there are `items`."""
    rows = ranked.join(F.broadcast(_limits(ranked, floors_and_caps, ["lo", "hi"]).withColumnRenamed("bucket", bucket)), bucket).filter("rank <= hi").withColumn("floor", F.col("rank") <= F.col("lo"))
    if threshold is not None:
        rows = rows.filter(F.col("floor") | (F.col(score) >= threshold))
    # At most the sum of caps is left: a few dozen rows.
    place = F.row_number().over(Window.orderBy(F.desc("floor"), F.desc(score), key))
    return rows.withColumn("place", place).filter(F.col("floor") | (F.col("place") <= items)).drop("lo", "hi", "floor", "place")


def global_topk(scored: DataFrame, items: int, score: str = "importance", key: str = "id") -> DataFrame:
    return scored.orderBy(F.desc(score), key).limit(items)


def leftovers(stories: DataFrame, picked: DataFrame, key: str = "id") -> DataFrame:
    """What is not picked; to be scored again as a bucket of its own, since normalisers change."""
    return stories.join(picked.select(key), key, "left_anti")


def raw_reserve(articles: DataFrame, picked: DataFrame, versions: str = "versions", key: str = "id") -> DataFrame:
    """Articles that are no version of a picked story, as they are: neither grouped nor scored."""
    return articles.join(picked.select(F.explode(versions).alias(key)).distinct(), key, "left_anti")


def deficit_pool(rest: DataFrame, cap: int = S.DEFICIT_POOL_CAP, key: str = "id") -> DataFrame:
    """A fixed pseudo-random choice of at most cap rows."""
    return rest.orderBy(F.xxhash64(key), key).limit(cap)


def around_cut(ranked: DataFrame, quota: int, share: int, bucket: str = "bucket") -> DataFrame:
    """`share` rows of each bucket about its quota's cut."""
    n = F.count(F.lit(1)).over(Window.partitionBy(bucket))
    low = F.greatest(F.lit(0), F.least(F.lit(quota - share // 3), n - share))
    return ranked.withColumn("lo", low).filter((F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("lo") + share)).drop("lo")


def top_third(ranked: DataFrame, bucket: str = "bucket") -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(bucket))
    return ranked.withColumn("n", n).filter(F.col("rank") <= F.ceil(F.col("n") / 3)).drop("n")


def stratified(rows: DataFrame, stratum: str, each: int, seed: int = 0, key: str = "id") -> DataFrame:
    """A fixed pseudo-random choice of `each` rows of each stratum."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(key, F.lit(seed)), key))
    return rows.withColumn("place", place).filter(F.col("place") <= each).drop("place")


def newest(files: DataFrame, n: int, changed: str = "changed", name: str = "name") -> DataFrame:
    """The n files that changed last."""
    return files.orderBy(F.desc(changed), name).limit(n)


def within_budget(requests: DataFrame, budget: int, order: list[Column]) -> DataFrame:
    """The first `budget` requests over all queries, in their order."""
    return requests.orderBy(*order).limit(budget)


def first_versions(versions: Column, most: int = S.MAX_VERSIONS) -> Column:
    return F.slice(versions, 1, most)


def recent_long(articles: DataFrame, n: int, chars: int = 1500, key: str = "id", text: str = "text") -> DataFrame:
    return articles.filter(F.char_length(text) > chars).orderBy(F.desc(key)).limit(n)


def pool_order(models: DataFrame, n: int = 5) -> DataFrame:
    """Free models, the widest context first."""
    return models.filter(F.col("name").endswith(":free")).orderBy(F.desc("context"), "name").limit(n)
