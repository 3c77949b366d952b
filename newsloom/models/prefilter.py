"""The prefilter: a balanced logistic regression over unit vectors, with a threshold for a wanted recall, calibrated out of fold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import vectors as V
from ..plans.storage import materialize


@dataclass
class Prefilter:
    weights: list[float]
    bias: float
    low: float
    rows: int
    recall: float
    dropped: float
    volume: float


def probability(vector: Column, weights: list[float], bias: float) -> Column:
    """The model's probability of a vector, as an expression."""
    return 1 / (1 + F.exp(-(V.dot(V.unit(vector), F.array(*map(F.lit, weights))) + bias)))


def _fit(rows: DataFrame) -> tuple[list[float], float]:
    """Weights and bias from y and unit vectors v; classes weigh the same. The penalty is 1 / n of the sum of losses."""
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # two rows
    n = sum(counts.values())
    weighed = rows.select("y", array_to_vector(F.col("v").cast("array<double>")).alias("features"), F.when(F.col("y") == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0])).alias("w"))
    model = LogisticRegression(labelCol="y", weightCol="w", regParam=1 / n, standardization=False, maxIter=200, tol=1e-8).fit(weighed)
    return [float(x) for x in model.coefficients], float(model.intercept)


def train(rows: DataFrame, key: str = "id", vector: str = "embedding", label: str = "y", folds: int = 5, recall: float = S.TARGET_RECALL, least: int = S.LEAST_LABELS, minority: int = S.LEAST_MINORITY, gain: float = S.LEAST_GAIN) -> Prefilter | None:
    """The fitted prefilter; None where there are too few labels, or it would drop too little."""
    base = materialize(rows.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).cast("double").alias("y"), V.unit(F.col(vector)).alias("v")))
    counts = {int(r["y"]): r["count"] for r in base.groupBy("y").count().collect()}  # two rows
    total, smaller = sum(counts.values()), min(counts.get(0, 0), counts.get(1, 0))
    folds = min(folds, smaller)
    if total < least or smaller < minority or folds < 2:
        return None
    dealt = materialize(base.withColumn("fold", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id")) % folds))
    parts = [dealt.filter(F.col("fold") == k).select("y", probability(F.col("v"), *_fit(dealt.filter(F.col("fold") != k))).alias("p")) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = materialize(out)
    low = out.filter("y = 1").agg(F.percentile("p", F.lit(1 - recall))).first()[0]
    kept = F.col("p") >= low
    got = out.agg(F.avg(F.when(F.col("y") == 1, kept.cast("double"))).alias("recall"), F.avg(F.when(F.col("y") == 0, (~kept).cast("double"))).alias("dropped"), F.avg(kept.cast("double")).alias("volume")).first()
    if got["dropped"] < gain:
        return None
    return Prefilter(*_fit(base), low, total, got["recall"], got["dropped"], got["volume"])


def score(rows: DataFrame, prefilter: Prefilter, vector: str = "embedding") -> DataFrame:
    """rows with the probability `p`."""
    return rows.withColumn("p", probability(F.col(vector), prefilter.weights, prefilter.bias))


def gate(rows: DataFrame, prefilter: Prefilter | None, vector: str = "embedding") -> DataFrame:
    """rows with `dropped`; without a prefilter nothing is."""
    if prefilter is None:
        return rows.withColumn("dropped", F.lit(False))
    return score(rows, prefilter, vector).withColumn("dropped", F.col("p") < prefilter.low)
