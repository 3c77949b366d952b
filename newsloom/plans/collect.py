"""Collection: from dumps to judged articles and the journal, in stages that each leave a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import text as T
from ..models import adapters, prefilter
from ..operators import cluster, journal, proximity
from ..sources import pages
from .storage import materialize


@dataclass
class Collected:
    articles: DataFrame
    journal: DataFrame
    decided: DataFrame


def collect(dump: DataFrame, seen: DataFrame, query: proximity.Query, index: int, get: Callable[[str], bytes | None], embed: Callable, ask: adapters.Ask, day: str, gate: prefilter.Prefilter | None = None, rescues: tuple[DataFrame, ...] = (), size: int = S.VECTOR_SIZE, threshold: float = S.DEDUP_COSINE) -> Collected:
    """One query's run. The cheapest tests come first: the dump's cells, the journal, text rules, near-duplicates, the prefilter, and the judge last.

    Each stage is materialised, since fetching, embedding and judging must not be done twice.
    """
    fresh = proximity.select(dump, query)
    todo = materialize(journal.candidates(fresh, seen).select("url", "date", "entities"))
    read = pages.read_pages(pages.fetch(todo, get))
    read = pages.rescue(read, *rescues) if rescues else read
    named = read.join(todo, "url").withColumn("entities", F.when(F.coalesce("entities", F.lit("")) != "", F.col("entities")).otherwise("")).withColumn("publish_date", F.coalesce("publish_date", F.col("date").cast("string")))
    sifted = materialize(pages.sift(named))
    vectors = materialize(adapters.embed(sifted.filter("verdict IS NULL").drop("verdict"), embed, size=size).withColumn("id", F.col("url")))
    grouped = cluster.cluster(vectors, threshold)
    heads = materialize(cluster.stories(grouped).select("leader", F.col("representative").alias("id")).join(vectors.select("id", "text", "embedding"), "id"))
    gated = materialize(prefilter.gate(heads, gate))
    judged = materialize(adapters.judge(gated.filter("NOT dropped"), ask))
    verdict = F.when(F.col("dropped"), "prefiltered").when(F.col("region").isNull(), S.PENDING).when(F.col("region") == "NO", "rejected").otherwise("accepted")
    verdicts = gated.join(judged, "id", "left").select("leader", verdict.alias("verdict"), "region", "scale")
    decided = materialize(cluster.fan_out(grouped, verdicts))
    # What the prefilter dropped is no label: its vector is not kept.
    marks = decided.select("url", F.lit(index).alias("query_index"), "verdict", F.when(F.col("verdict").isin("accepted", "rejected"), F.col("embedding")).alias("embedding"))
    marks = marks.unionByName(sifted.filter("verdict IS NOT NULL").select("url", F.lit(index).alias("query_index"), "verdict", F.lit(None).cast("array<float>").alias("embedding")))
    accepted = decided.filter("verdict = 'accepted'").select(F.lit(index).alias("query_index"), "url", F.lit(day).cast("date").alias("fetch_date"), "publish_date", "title", "text", "embedding", F.col("region").alias("region_bucket"), T.detect_language(F.col("text")).alias("language"), "entities", "scale")
    return Collected(accepted, journal.mark(seen, marks, day), decided)
