"""Evaluation: agreement, paired differences, gains, repeats, and comparisons of selections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize
from .cluster import CELLS, as_vectors, block_rows, unit_rows


def ndcg(gains: DataFrame, k: int, group: list[str], rank: str = "rank", gain: str = "gain") -> DataFrame:
    """nDCG at k with linear gains; null where the ideal is 0."""
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(gain), rank))
    at = lambda r: F.sum(F.when(F.col(r) <= k, F.col(gain) / F.log2(F.col(r) + 1)).otherwise(0.0))
    return gains.withColumn("best", best).groupBy(*group).agg(at(rank).alias("dcg"), at("best").alias("ideal")).select(*group, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).alias("ndcg"))


def paired_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """n, mean and standard error of b - a over keys of both, and how many went up and down."""
    d = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key).filter("x IS NOT NULL AND y IS NOT NULL").select((F.col("y") - F.col("x")).cast("double").alias("d"))
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("error"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))


def grade_gap(a: Column, b: Column, levels: int) -> Column:
    """The distance of two grades from 1 to levels, from 0 to 1."""
    return F.abs(a - b) / (levels - 1)


def self_agreement(pairs: DataFrame, a: str, b: str, levels: int) -> DataFrame:
    """Share of equal grades and mean gap of pairs that both have one."""
    both = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("exact"), F.avg(grade_gap(F.col(a), F.col(b), levels)).alias("gap"))


def grade_histogram(rows: DataFrame, grade: str) -> DataFrame:
    """grade, n and its share of graded rows."""
    counts = rows.filter(F.col(grade).isNotNull()).groupBy(F.col(grade).alias("grade")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row a grade


def error_and_rank_correlation(rows: DataFrame, a: str, b: str, tie: str) -> DataFrame:
    """Mean absolute error, and the correlation of ordinal ranks."""
    rank = lambda c: F.row_number().over(Window.orderBy(c, tie)).cast("double")  # noqa: E731  of an evaluation's rows
    return rows.withColumn("ra", rank(a)).withColumn("rb", rank(b)).agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"), F.corr("ra", "rb").alias("rank_corr"))


def gap_at_cut(ranked: DataFrame, quota: int, by: list[str], score: str = "importance") -> DataFrame:
    """Score of the last taken less that of the first left; null where nothing is left."""
    nxt = F.lead(score).over(Window.partitionBy(*by).orderBy("rank"))
    return ranked.withColumn("next", nxt).filter(F.col("rank") == quota).select(*by, (F.col(score) - F.col("next")).alias("gap"))


def top_scale(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """How many rows share the bucket's largest value."""
    top = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return top.groupBy(*by).agg(F.max_by("n", value).alias("n"))


def quota_cost(ranked: DataFrame, quota: int, by: list[str], score: str = "importance", key: str = "id") -> DataFrame:
    """Mean score with the quota in each bucket, that of as many rows without it, and the difference."""
    with_ = ranked.filter(F.col("rank") <= quota).agg(F.avg(score).alias("with_quota"), F.count("*").alias("n"))
    buckets = ranked.select(*by).distinct().count()
    free = ranked.orderBy(F.desc(score), key).limit(quota * buckets)  # as many as the quota can take
    at = F.row_number().over(Window.orderBy(F.desc(score), key))
    return with_.crossJoin(free.withColumn("at", at).select(score, "at")).filter("at <= n").groupBy("with_quota").agg(F.avg(score).alias("without_quota")).withColumn("cost", F.col("without_quota") - F.col("with_quota"))


def selection_changes(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """key and change: left or entered."""
    left = base.select(key).distinct().join(other.select(key), key, "left_anti").withColumn("change", F.lit("left"))
    return left.unionByName(other.select(key).distinct().join(base.select(key), key, "left_anti").withColumn("change", F.lit("entered")))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("both"))


def weekly(issues: DataFrame, date: str = "issue_date") -> DataFrame:
    """Items of issues on the latest issue's day of the week."""
    last = issues.agg(F.max(date).alias("last"))
    return issues.crossJoin(F.broadcast(last)).filter(F.dayofweek(date) == F.dayofweek("last")).drop("last")


def archive_cut(issues: DataFrame, date: str = "issue_date") -> DataFrame:
    """Items of earlier issues on the latest issue's day of the week."""
    last = issues.agg(F.max(date).alias("last"))
    return issues.crossJoin(F.broadcast(last)).filter((F.dayofweek(date) == F.dayofweek("last")) & (F.col(date) < F.col("last"))).drop("last")


def group_medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("median"))


def override_grades(rows: DataFrame, grades: DataFrame, levels: int, key: str = "url", grade: str = "grade") -> DataFrame:
    """rows with the grades of another judge (key, grade) in place of their own, -1 where it has none, and their value on a scale of so many levels."""
    put = F.coalesce(F.col("__other"), F.lit(-1))
    met = rows.drop(grade).join(grades.select(key, F.col(grade).alias("__other")), key, "left").withColumn(grade, put).drop("__other")
    return met.withColumn("value", F.when(F.col(grade) > 0, (F.col(grade) - 1) / (levels - 1)))


def report_lines(rows: DataFrame, arm: str, figures: dict[str, str]) -> DataFrame:
    """arm and line: each arm's figures as `name=value`, by formats."""
    cells = [F.concat(F.lit(f"{name}="), F.format_string(form, name)) for name, form in figures.items()]
    return rows.select(arm, F.concat(F.col(arm).cast("string"), F.lit(": "), F.concat_ws("  ", *cells)).alias("line"))


def nearest_earlier(issues: DataFrame, key: str, date: str, vector: str, block: int | None = None) -> DataFrame:
    """Each item's most similar item of an earlier issue: key, cos, other (the smallest of equals). Items without an earlier issue, a date or a vector are left out.

    Items are cut into blocks by a hash of the key; each pair of blocks is one matrix product in one task, whose memory is two blocks.
    """
    rows = issues.select(F.col(key).alias("id"), F.col(date).alias("date"), as_vectors(issues, vector).alias("v")).filter("date IS NOT NULL AND v IS NOT NULL")
    n = rows.count()
    size = max(1, -(-n // (block or block_rows(n))))
    own, every = F.pmod(F.xxhash64("id"), F.lit(size)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    later, earlier = rows.select("id", "date", "v", own.alias("i"), every.alias("j")), rows.select(F.col("id").alias("other"), F.col("date").alias("before"), F.col("v").alias("w"), every.alias("i"), own.alias("j"))
    kind = dict(rows.dtypes)["id"]

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"id": a.column("id").slice(0, 0), "cos": pa.array([], pa.float64()), "other": a.column("id").slice(0, 0)})
        order = np.argsort(np.array(b.column("other").to_pylist()), kind="stable")  # argmax takes the first of equals
        x, y = unit_rows(a.column("v")), unit_rows(b.column("w"))[order].T
        _, days = np.unique(np.array([*a.column("date").to_pylist(), *b.column("before").to_pylist()]), return_inverse=True)
        before, best, most = days[len(x) :][order][None, :], np.zeros(len(x), int), np.full(len(x), -np.inf)
        for k in range(0, len(x), max(1, CELLS // y.shape[1])):
            at = np.arange(k, min(k + max(1, CELLS // y.shape[1]), len(x)))
            cos = np.where(before < days[at][:, None], x[at] @ y, -np.inf)
            best[at] = cos.argmax(axis=1)
            most[at] = cos[np.arange(len(at)), best[at]]
        some = np.flatnonzero(most > -np.inf)
        return pa.table({"id": a.column("id").take(pa.array(some)), "cos": pa.array(most[some]), "other": b.column("other").take(pa.array(order[best[some]]))})

    found = later.groupBy("i", "j").cogroup(earlier.groupBy("i", "j")).applyInArrow(nearest, f"id {kind}, cos double, other {kind}")
    return found.groupBy(F.col("id").alias(key)).agg(F.max("cos").alias("cos"), F.min_by("other", F.struct(-F.col("cos"), "other")).alias("other"))


def repeat_share(issues: DataFrame, key: str, date: str, vector: str, threshold: float) -> DataFrame:
    near = nearest_earlier(issues, key, date, vector)
    return near.agg(F.count("*").alias("compared"), F.avg((F.col("cos") >= threshold).cast("double")).alias("share"))


def percentiles(rows: DataFrame, value: str, at: list[float]) -> DataFrame:
    """One row with columns p50 and so on; linear between values."""
    return rows.agg(*(F.percentile(value, F.lit(p)).alias(f"p{round(p * 100)}") for p in at))


def scorecard(calls: DataFrame) -> DataFrame:
    """Of a provider's calls (provider, ok, decided, region, expected_region, grade, expected_grade, seconds, code, at): one row a provider."""
    return calls.groupBy("provider").agg(
        F.count_if("ok").alias("ok"), F.count("*").alias("calls"), F.sum("decided").alias("decided"), F.avg((F.col("region") == F.col("expected_region")).cast("double")).alias("region_agreement"), F.avg(F.abs(F.col("grade") - F.col("expected_grade"))).alias("mae"),
        F.median("seconds").alias("median_s"), F.max("seconds").alias("max_s"), F.min(F.when(F.col("code") == 429, F.col("at"))).alias("first_429"), F.array_sort(F.collect_set("code")).alias("codes"),
    )


def text_features(texts: DataFrame, group: str, text: str) -> DataFrame:
    """Mean number of sentences and digits, and the share of texts with a digit, of each group."""
    t = F.coalesce(text, F.lit(""))
    return texts.groupBy(group).agg(F.avg(F.regexp_count(t, F.lit(r"[.!?]+(\s|$)"))).alias("sentences"), F.avg(F.regexp_count(t, F.lit(r"\d"))).alias("digits"), F.avg(t.rlike(r"\d").cast("double")).alias("with_digits"))


def rejections(reasons: DataFrame, reason: str, rules: list[str]) -> DataFrame:
    """How often each rule, known by the beginning of the reason, rejected."""
    name = F.coalesce(*(F.when(F.col(reason).startswith(r), F.lit(r)) for r in rules), F.lit("other"))
    return reasons.filter(F.col(reason).isNotNull()).groupBy(name.alias("rule")).agg(F.count("*").alias("n"))


def ladder(judged: DataFrame) -> DataFrame:
    """Selectivity of ever stricter rules over rows with themes (number), share and top (whether the country is the most mentioned)."""
    theme, share = F.col("themes") >= 1, F.col("share") >= 0.3
    return judged.agg(F.count("*").alias("a_rows"), F.count_if(theme).alias("b_theme"), F.count_if(theme & share).alias("c_share"), F.count_if(theme & F.col("top")).alias("d_top"), F.count_if((F.col("themes") >= 2) & share).alias("e_two_themes"), F.count_if((F.col("themes") >= 2) & share & F.col("top")).alias("f_all"))


def shared_sets(sets: DataFrame, least: int, key: str = "id", items: str = "items", members: bool = False, part: int = 1 << 21, block: int = 1 << 22) -> DataFrame:
    """Pairs of sets that share at least `least` items: a < b (the smallest keys of the classes of equal sets), both, a_rows and b_rows (the classes' sizes).

    Exact. Items are dealt over tasks of about `part` entries; those of one list of sets are taken together, as a posting of a weight, and items
    that one set alone has are left out. Sets with their postings are then counted against each other in blocks of about `block` entries: a pair is
    met by the first set's postings but its most frequent ones that weigh less than `least` together, and the latter are added only where that can
    still be enough. No pair is written but those found. With members, column `copy` and a row with copy = true for each further member b of the
    class of a: equal sets are links too, but members are not expanded into pairs.
    """
    base = sets.select(F.col(key).alias("id"), F.array_distinct(items).alias("items")).filter((F.size("items") >= least) & F.col("id").isNotNull())
    kinds = dict(base.dtypes)
    named = materialize(base.select("id", F.size("items").cast("long").alias("size"), F.sha2(F.concat_ws("\x00", F.sort_array("items").cast("array<string>")), 256).alias("class")))
    whole = materialize(named.groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("size").alias("size")))
    firsts = whole.select("id", "n")
    parts = max(1, -(-(named.agg(F.sum("size")).first()[0] or 0) // part))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 1000):
                batch = whole_batch.slice(at, 1000)
                lists = batch.column("items")
                flat, owner = lists.flatten(), np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                place = batch.column("place").flatten().to_numpy(zero_copy_only=False) % parts
                order = np.argsort(place, kind="stable")
                numbers, starts = np.unique(place[order], return_index=True)
                cuts = pa.array([*starts.tolist(), len(order)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.ListArray.from_arrays(cuts, flat.take(pa.array(order))), pa.ListArray.from_arrays(cuts, batch.column("id").take(pa.array(owner[order])))], ["part", "items", "ids"])

    def gather(table: pa.Table) -> pa.Table:
        flat = lambda c: table.column(c).combine_chunks().flatten()
        keys, who = np.unique(flat("ids").to_numpy(zero_copy_only=False), return_inverse=True)
        codes = flat("items").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        both = np.unique(codes.astype(np.int64) * len(keys) + who)
        codes, who = both // len(keys), (both % len(keys)).astype(np.int32)
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        ends = np.append(starts[1:], len(codes))
        found: dict[bytes, int] = {}
        for i in np.flatnonzero(ends - starts > 1):
            ids = who[starts[i] : ends[i]].tobytes()
            found[ids] = found.get(ids, 0) + 1
        lengths = np.cumsum([0, *(len(x) // 4 for x in found)])
        every = pa.array(keys[np.frombuffer(b"".join(found), np.int32)].tolist(), table.schema.field("ids").type.value_type)
        return pa.table({"ids": pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), every), "w": pa.array(list(found.values()), pa.int64())})

    place = F.transform("items", lambda x: F.shiftrightunsigned(F.xxhash64(x), 1)) if kinds["items"] != "array<bigint>" else F.transform("items", lambda x: F.shiftrightunsigned(x, 1))
    dealt = base.select("id", "items", place.alias("place")).mapInArrow(deal, f"part long, items {kinds['items']}, ids array<{kinds['id']}>")
    postings = dealt.groupBy("part").applyInArrow(gather, f"ids array<{kinds['id']}>, w long").groupBy("ids").agg(F.sum("w").alias("w"))
    postings = materialize(postings.select(F.monotonically_increasing_id().alias("pid"), "w", "ids"))
    entries = postings.select(F.struct(F.size("ids").alias("df"), "pid", "w").alias("e"), F.explode("ids").alias("id")).join(firsts.select("id"), "id", "left_semi")
    rows = materialize(entries.groupBy("id").agg(F.sum("e.w").alias("total"), F.collect_list("e").alias("e")).filter(F.col("total") >= least).select("id", *(F.col(f"e.{c}").alias(c) for c in ("df", "pid", "w"))))
    blocks = max(4, -(-(rows.agg(F.sum(F.size("pid"))).first()[0] or 0) // block))
    own = rows.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = own.select("*", F.lit(0).alias("side"), F.col("at").alias("i"), F.explode(F.sequence("at", F.lit(blocks - 1))).alias("j"))
    right = own.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), "at")).alias("i"), F.col("at").alias("j"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        sides = [table.filter(pc.equal(table.column("side"), k)) for k in (0, 1)]
        if all(t.num_rows for t in sides):
            yield from _shared(*sides, least, table.column("i")[0].as_py() == table.column("j")[0].as_py())

    found = left.unionByName(right).drop("at").groupBy("i", "j").applyInArrow(count, f"a {kinds['id']}, b {kinds['id']}, both long")
    side = lambda c: firsts.select(F.col("id").alias(c), F.col("n").alias(f"{c}_rows"))
    found = found.join(side("a"), "a").join(side("b"), "b").select("a", "b", "both", "a_rows", "b_rows")
    if not members:
        return found
    of = whole.filter("n > 1").select("class", F.col("id").alias("a"), F.col("size").alias("both"), F.col("n").alias("a_rows"))
    more = named.select("class", F.col("id").alias("b")).join(of, "class").filter("a < b").select("a", "b", "both", "a_rows", F.col("a_rows").alias("b_rows"))
    return found.withColumn("copy", F.lit(False)).unionByName(more.withColumn("copy", F.lit(True)))


def _shared(left: pa.Table, right: pa.Table, least: int, same: bool, cells: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Pairs a < b of a row of either table (id, df, pid, w) whose postings in common weigh `least` at least; of the tables of one block each pair once."""
    flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy()
    ids, other = (t.column("id").to_numpy() for t in (left, right))
    row, at = (np.repeat(np.arange(t.num_rows), pc.list_value_length(t.column("pid")).to_numpy()) for t in (left, right))
    pid, w = flat(left, "pid"), flat(left, "w")
    order = np.lexsort((pid, -flat(left, "df"), row))
    row, pid, w = row[order], pid[order], w[order]
    total = np.cumsum(w)
    begins = np.searchsorted(row, np.arange(len(ids) + 1))
    up_to = total - np.concatenate([[0], total])[begins[:-1]][row]
    used = up_to >= least  # the others are the row's most frequent ones
    rest = np.bincount(row[~used], w[~used], len(ids)).astype(np.int64)
    number = np.bincount(row[~used], minlength=len(ids))
    order = np.lexsort((at, flat(right, "pid")))
    theirs, at = flat(right, "pid")[order], at[order]
    names, firsts = np.unique(theirs, return_index=True)
    firsts = np.append(firsts, len(theirs))
    code = np.searchsorted(names, pid)
    met = (code < len(names)) & (names[np.minimum(code, len(names) - 1)] == pid)
    code = np.where(met, code, 0)
    low, size = firsts[code], np.where(met, firsts[code + 1] - firsts[code], 0)
    place = np.repeat(np.arange(len(names)), np.diff(firsts)) * len(other) + at  # sorted
    work = np.concatenate([[0], np.cumsum(np.where(used, size, 0))])[begins]
    first = 0
    while first < len(ids):
        last = max(first + 1, min(int(np.searchsorted(work, work[first] + cells, "right")) - 1, first + max(1, cells // len(other)), len(ids)))
        some = np.arange(begins[first], begins[last])
        some = some[used[some] & (size[some] > 0)]
        n, base = size[some], first
        first = last
        if not len(some):
            continue
        there = at[np.repeat(low[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        counts = np.bincount(np.repeat(row[some] - base, n) * len(other) + there, np.repeat(w[some], n), (last - base) * len(other))
        near = np.flatnonzero(counts)
        a, b, both = near // len(other) + base, near % len(other), counts[near].astype(np.int64)
        keep = both + rest[a] >= least
        if same:
            keep &= ids[a] < other[b]
        a, b, both = a[keep], b[keep], both[keep]
        for k in range(number[a].max(initial=0)):
            sub = np.flatnonzero(number[a] > k)
            e = begins[a[sub]] + k
            want = code[e] * len(other) + b[sub]
            is_in = met[e] & (place[np.minimum(np.searchsorted(place, want), len(place) - 1)] == want)
            both[sub[is_in]] += w[e[is_in]]
        keep = both >= least
        x, y, both = ids[a[keep]], other[b[keep]], both[keep]
        kind = left.schema.field("id").type
        for k in range(0, len(x), 1 << 16):
            p, q = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(p < q, p, q).tolist(), kind), pa.array(np.where(p < q, q, p).tolist(), kind), pa.array(both[k : k + (1 << 16)])], ["a", "b", "both"])
