"""Selection of dump rows where a theme and a country are mentioned close together."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T


@dataclass(frozen=True)
class Query:
    """One selection: themes, countries (two letters), limits (None: not tested) and words of the source or URL."""

    themes: list[str]
    countries: list[str]
    max_gap: int | None = 400
    min_share: float | None = None
    extra_terms: list[str] = field(default_factory=list)


def theme_offsets(cell: Column) -> Column:
    """Structs (name, offset) of a cell `THEME,offset;...`."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), ";"), lambda p: F.struct(F.upper(F.trim(F.regexp_extract(p, r"^(.*),\s*\d+\s*$", 1))).alias("name"), F.regexp_extract(p, r",\s*(\d+)\s*$", 1).try_cast("int").alias("offset")))
    return F.filter(parts, lambda p: (p["name"] != "") & p["offset"].isNotNull())


def country_offsets(cell: Column) -> Column:
    """Structs (name, offset) of a cell `type#name#CC#...#offset;...` with nine fields or more."""

    def one(p: Column) -> Column:
        parts = F.split(p, "#")
        return F.when(F.size(parts) >= 9, F.struct(F.upper(F.trim(F.get(parts, F.lit(2)))).alias("name"), F.element_at(parts, -1).try_cast("int").alias("offset")))

    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ";"), one), lambda p: p.isNotNull() & (F.char_length(p["name"]) == 2) & p["offset"].isNotNull())


def plain_names(cell: Column, at: int | None = None) -> Column:
    """Names of a cell without offsets: whole parts, or the field `at` of parts split by #."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), ";"), lambda p: F.upper(F.trim(p if at is None else F.get(F.split(p, "#"), F.lit(at)))))
    return F.filter(parts, lambda p: p.isNotNull() & (p != ""))


def min_gap(a: Column, b: Column) -> Column:
    """The least distance between the numbers of two arrays; null if one is empty. For the short arrays of one row."""
    return F.array_min(F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: F.abs(x - y)))))


def judge_offsets(themes_cell: Column, countries_cell: Column, q: Query) -> Column:
    """A struct (ok, gap, share), null where both cells are blank: theme there, country's share of mentions, least gap, in this order."""
    names = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    themes, countries = theme_offsets(themes_cell), country_offsets(countries_cell)
    offsets = lambda xs, wanted: F.transform(F.filter(xs, lambda p: F.array_contains(names(wanted), p["name"])), lambda p: p["offset"])
    t, c = offsets(themes, q.themes), offsets(countries, q.countries)
    share, gap = F.size(c) / F.greatest(F.size(countries), F.lit(1)), min_gap(t, c)
    out = lambda ok, g, s: F.struct(ok.alias("ok"), g.cast("int").alias("gap"), s.cast("double").alias("share"))
    no = F.lit(None)
    verdict = F.when((F.size(t) == 0) | (F.size(c) == 0), out(F.lit(False), no, no))
    if q.min_share is not None:
        verdict = verdict.when(share < q.min_share, out(F.lit(False), no, share))
    if q.max_gap is not None:
        verdict = verdict.when(gap > q.max_gap, out(F.lit(False), gap, share))
    blank = (F.trim(F.coalesce(themes_cell, F.lit(""))) == "") & (F.trim(F.coalesce(countries_cell, F.lit(""))) == "")
    return F.when(~blank, verdict.otherwise(out(F.lit(True), gap, share)))


def judge_names(themes_cell: Column, countries_cell: Column, q: Query) -> Column:
    """The fallback without offsets: any of the themes and any of the countries."""
    names = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    return F.arrays_overlap(plain_names(themes_cell), names(q.themes)) & F.arrays_overlap(plain_names(countries_cell, 2), names(q.countries))


def cheap_filter(q: Query) -> Column:
    """What every selected row fulfils; plain patterns, so that they reach the scan before anything else is computed."""
    quoted = lambda xs, a, b: "(?i)" + "|".join(a + "\\Q" + x + "\\E" + b for x in xs)
    blank = (F.trim(F.coalesce("v2t", F.lit(""))) == "") & (F.trim(F.coalesce("v2l", F.lit(""))) == "")
    return (F.col("v2t").rlike(quoted(q.themes, "", "")) & F.col("v2l").rlike(quoted(q.countries, "#", "#"))) | blank


def judged(dump: DataFrame, q: Query) -> DataFrame:
    """Rows of the dump that pass the cheap tests, with gap, share, fallback and passed."""
    rows = dump.filter(F.col("url").startswith("http")).filter(cheap_filter(q))
    if q.extra_terms:
        hay = F.lower(F.concat_ws(" ", "source", "url"))
        rows = rows.filter(F.exists(F.array(*(F.lit(t.lower()) for t in q.extra_terms)), lambda t: F.contains(hay, t)))
    v = judge_offsets(F.col("v2t"), F.col("v2l"), q)
    rows = rows.withColumn("v", v).withColumn("fallback", F.col("v").isNull())
    return rows.withColumn("passed", F.when(F.col("fallback"), judge_names(F.col("v1t"), F.col("v1l"), q)).otherwise(F.col("v.ok"))).withColumn("gap", F.col("v.gap")).withColumn("share", F.col("v.share")).drop("v")


def select(dump: DataFrame, q: Query, order: list[Column] | None = None) -> DataFrame:
    """The first passing row of each URL (in the given order): url, date, entities, gap, share, fallback."""
    rows = judged(dump, q).filter("passed")
    rows = rows.withColumn("date", D.dump_date(F.col("date"))).withColumn("entities", F.array_join(T.names(F.col("v1p"), F.col("v1o")), ";"))
    first = F.row_number().over(Window.partitionBy("url").orderBy(*(order or [F.desc("date"), F.col("source")])))
    return rows.withColumn("n", first).filter("n = 1").select("url", "date", "entities", "gap", "share", "fallback")


def counters(dump: DataFrame, q: Query) -> DataFrame:
    """One row: rows that reach the judge, passed, dropped, judged by the fallback, and the gaps' quartiles."""
    j = judged(dump, q)
    return j.agg(F.count("*").alias("rows"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("dropped"), F.count_if("fallback").alias("fallback"), F.percentile("gap", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9), F.lit(0.95))).alias("gaps"))


def nearest(mentions: DataFrame, key: str, kind: str, offset: str, a: str, b: str) -> DataFrame:
    """For long lists: key and the least distance between offsets of kinds a and b, in one sort by (key, offset) instead of all pairs.

    Each mention looks at the last one of the other kind before it, in either direction of reading that is every neighbouring pair.
    """
    w = Window.partitionBy(key).orderBy(offset, kind).rowsBetween(Window.unboundedPreceding, -1)
    rows = mentions.filter(F.col(kind).isin(a, b))
    last = {k: F.last(F.when(F.col(kind) == k, F.col(offset)), ignorenulls=True).over(w) for k in (a, b)}
    gap = F.col(offset) - F.when(F.col(kind) == a, last[b]).otherwise(last[a])
    return rows.withColumn("gap", gap).groupBy(key).agg(F.min("gap").alias("gap")).filter("gap IS NOT NULL")


def by_substring(rows: DataFrame, themes: list[str], countries: list[str], theme: str = "v1t", place: str = "v1l") -> DataFrame:
    """Rows by the plain rule that exact selection is compared with: a theme's name anywhere, and a country's code between hashes anywhere."""
    has = lambda c, any_of: F.coalesce(F.col(c), F.lit("")).rlike("(?i)" + "|".join(any_of))
    return rows.filter(has(theme, themes) & F.coalesce(F.col(place), F.lit("")).rlike("|".join(f"#{c}#" for c in countries)))
