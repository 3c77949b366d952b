"""Near-duplicate stories: similar pairs, greedy leader clustering, representatives, and fan-out of verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import vectors as V
from ..plans.storage import materialize
from .places import places

BLOCK, SIDES, LARGEST = 2048, 24, 32768
CELLS = 1 << 22


def block_rows(n: int) -> int:
    """Rows of a block for a table of n: so that there are SIDES blocks, within limits. What is dealt to pairs of blocks then grows in proportion up to SIDES x LARGEST rows."""
    return min(max(BLOCK, -(-n // SIDES)), LARGEST)


def as_vectors(rows: DataFrame, vector: str) -> Column:
    """The vector as it is stored, or as doubles: floats are widened where they are used, and take half the room until then."""
    return F.col(vector) if dict(rows.dtypes).get(vector) == "array<float>" else F.col(vector).cast("array<double>")


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as the rows of a matrix of doubles, scaled to length one; zeros stay zeros."""
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)


def similar_pairs(rows: DataFrame, threshold: float = S.DEDUP_COSINE, key: str = "id", vector: str = "embedding", bucket: str | None = None, block: int | None = None, planes: int = 0, tables: int = 16) -> DataFrame:
    """Pairs a < b of a bucket with a cosine of at least threshold: a, b, cos.

    Exact: a bucket is cut into blocks by a hash of the key, and each pair of blocks is one matrix product in one task, so that memory is
    two blocks, of `block` rows (`block_rows` of the bucket's size, if none is given). With planes > 0 a pair must share the signs of that many random planes in one of the
    tables, and only blocks of equal signs are multiplied: nearly all pairs at high thresholds, in about linear time.
    """
    base = rows.select((F.lit("") if bucket is None else F.col(bucket)).cast("string").alias("bucket"), F.col(key).alias("id"), as_vectors(rows, vector).alias("v")).filter("v IS NOT NULL")
    if planes:
        size = len(base.select("v").first()["v"]) if not base.isEmpty() else 1
        normals = np.random.default_rng(7).standard_normal((tables * planes, size))

        def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                code = ((x @ normals.T > 0).reshape(batch.num_rows, tables, planes) * (1 << np.arange(planes))).sum(axis=2)
                for t in range(tables):
                    names = pa.array([f"{b}/{t}/{c}" for b, c in zip(batch.column("bucket").to_pylist(), code[:, t])])
                    yield pa.RecordBatch.from_arrays([names, batch.column("id"), batch.column("v")], ["bucket", "id", "v"])

        base = base.mapInArrow(signed, base.schema)
    n = F.count("*")
    size = F.lit(block) if block else F.least(F.greatest(F.ceil(n / SIDES), F.lit(BLOCK)), F.lit(LARGEST))
    counts = base.groupBy("bucket").agg(F.ceil(n / size).cast("int").alias("blocks"))
    placed = base.join(counts if planes else F.broadcast(counts), "bucket").withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.withColumn("with", other).withColumn("i", F.least("at", "with")).withColumn("j", F.greatest("at", "with"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, at, kind = np.array(table.column("id").to_pylist()), table.column("at").to_numpy(), table.schema.field("id").type
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x = unit_rows(table.column("v"))
        left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
        theirs = x[right].T
        for k in range(0, len(left), max(1, CELLS // max(1, len(right)))):
            rows = left[k : k + max(1, CELLS // max(1, len(right)))]
            cos = x[rows] @ theirs
            p, q = np.nonzero(cos >= threshold)
            a, b, c = ids[rows[p]], ids[right[q]], cos[p, q]
            if i == j:
                keep = a < b
                a, b, c = a[keep], b[keep], c[keep]
            swap = a > b
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.tolist(), kind), pa.array(b.tolist(), kind), pa.array(c)], ["a", "b", "cos"])

    kind = dict(base.dtypes)["id"]
    found = dealt.select("bucket", "i", "j", "at", "id", "v").groupBy("bucket", "i", "j").applyInArrow(multiply, f"a {kind}, b {kind}, cos double")
    return found.dropDuplicates(["a", "b"]) if planes else found


def copies(rows: DataFrame, threshold: float = S.DEDUP_COSINE, key: str = "id", vector: str = "embedding", bucket: str | None = None) -> DataFrame:
    """id and first of each further row of a class of equal vectors of a bucket; first is the class's smallest id.

    Vectors that are not similar to themselves (zeros) are no copies, and ids with several rows are left out.
    """
    v, norm = as_vectors(rows, vector), V.norm(F.col("v"))
    base = rows.select((F.lit("") if bucket is None else F.col(bucket)).cast("string").alias("bucket"), F.col(key).alias("id"), v.alias("v")).filter("v IS NOT NULL")
    own = (norm / (norm + 1e-10)) ** 2
    alike = base.withColumn("own", own).filter(~F.isnan("own") & (F.col("own") > threshold + 1e-9)).drop("own")
    classes = alike.groupBy("bucket", "v").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    once = base.groupBy("id").count().filter("count = 1").select("id")
    met = alike.join(classes, ["bucket", "v"]).select("id", "first").filter("id > first")
    return met.join(once, "id", "left_semi").join(once.withColumnRenamed("id", "first"), "first", "left_semi").select("id", "first")


def similar_classes(rows: DataFrame, threshold: float = S.DEDUP_COSINE, key: str = "id", vector: str = "embedding", bucket: str | None = None, **pairs: int) -> DataFrame:
    """`similar_pairs` of the first rows of classes of equal vectors (copy = false), and a row for each further member b of the class of a (copy = true)."""
    more = materialize(copies(rows, threshold, key, vector, bucket))
    found = similar_pairs(rows.join(more.select(F.col("id").alias(key)), key, "left_anti"), threshold, key, vector, bucket, **pairs)
    return found.withColumn("copy", F.lit(False)).unionByName(more.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cos"), F.lit(True).alias("copy")))


def leaders(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Greedy leader clustering in the order of ids, from pairs a < b that are similar: id and leader of each row.

    A row is a leader if none of its smaller neighbours is one; any other row belongs to its smallest neighbouring leader. Rounds decide, all at
    once, the rows whose smaller neighbours are all decided; the number of rounds is the longest such chain.
    """
    edges = materialize(pairs.select("a", "b"))
    state = materialize(ids.select("id").distinct().join(edges.select(F.col("b").alias("id")).distinct().withColumn("open", F.lit(True)), "id", "left").select("id", F.when(F.col("open").isNull(), F.lit(True)).alias("leads")))
    while True:
        smaller = edges.join(state.withColumnRenamed("id", "a"), "a").groupBy("b").agg(F.bool_or(F.coalesce("leads", F.lit(False))).alias("beside"), F.bool_and(F.col("leads").isNotNull()).alias("known"))
        watch = Observation()
        step = state.join(smaller.withColumnRenamed("b", "id"), "id", "left")
        decided = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.col("beside"), False).when(F.col("known"), True)
        state = materialize(step.select("id", decided.alias("leads")).observe(watch, F.count_if(F.col("leads").isNull()).alias("open")))
        if not watch.get["open"]:
            break
    beside = edges.join(state.filter("leads").select(F.col("id").alias("a")), "a").groupBy("b").agg(F.min("a").alias("first"))
    return state.join(beside.withColumnRenamed("b", "id"), "id", "left").select("id", F.when(F.col("leads"), F.col("id")).otherwise(F.col("first")).alias("leader"))


def cluster(rows: DataFrame, threshold: float = S.DEDUP_COSINE, key: str = "id", vector: str = "embedding", bucket: str | None = None, small: int = 2 * BLOCK, **pairs: int) -> DataFrame:
    """rows with the id of their cluster's leader in column `leader`.

    Tables of up to `small` rows (and those for which `pairs` are asked) go by pairs: of a class of equal vectors only the first can lead, and the others
    belong to its leader, so that they make no pairs. Larger ones go by rounds, without pairs.
    """
    if not pairs and rows.count() > small:
        return rows.join(led_in_rounds(rows, threshold, key, vector, bucket).withColumnRenamed("id", key), key)
    more = materialize(copies(rows, threshold, key, vector, bucket))
    firsts = rows.join(more.select(F.col("id").alias(key)), key, "left_anti")
    led = materialize(leaders(firsts.select(F.col(key).alias("id")), similar_pairs(firsts, threshold, key, vector, bucket, **pairs)))
    found = led.unionByName(more.join(led.withColumnRenamed("id", "first"), "first").select("id", "leader"))
    return rows.join(found.withColumnRenamed("id", key), key)


def led_in_rounds(rows: DataFrame, threshold: float, key: str, vector: str, bucket: str | None = None, block: int | None = None) -> DataFrame:
    """id and leader of each row, as by `leaders` over all pairs, none of which is made.

    In each round a bucket's smallest open rows, a block of them, are decided in order in one task, and the other open rows are held against the
    block's leaders: those near one belong to the smallest, and the rest stays open. Memory is a block and its leaders.
    """
    base = rows.select((F.lit("") if bucket is None else F.col(bucket)).cast("string").alias("bucket"), F.col(key).alias("id"), as_vectors(rows, vector).alias("v")).filter(F.col("id").isNotNull())
    left = places(base.filter("v IS NOT NULL"), ["bucket"], [F.col("id")])
    left = materialize(left)
    total = left.count()
    size = block or block_rows(total)
    left = left.select("bucket", "id", "v", F.floor(F.col("place") / size).cast("int").alias("block"))
    kind, vectors, parts = dict(base.dtypes)["id"], dict(base.dtypes)["v"], max(1, -(-total // size))
    done = [base.filter("v IS NULL").select("id", F.col("id").alias("leader"))]

    def decide(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x, who, leads = unit_rows(table.column("v")), np.full(table.num_rows, -1), np.zeros(0, int)
        for k in range(0, len(x), 512):
            own = np.arange(k, min(k + 512, len(x)))
            for at in range(0, len(leads), BLOCK):
                near = x[own] @ x[leads[at : at + BLOCK]].T >= threshold
                met = near.any(axis=1) & (who[own] < 0)
                who[own[met]] = leads[at : at + BLOCK][near[met].argmax(axis=1)]
            own, new = own[who[own] < 0], []
            near = x[own] @ x[own].T >= threshold
            for p, at in enumerate(own):
                if who[at] < 0:
                    who[at] = at
                    new.append(at)
                    after = own[p + 1 :][near[p, p + 1 :]]
                    who[after[who[after] < 0]] = at
            leads = np.concatenate([leads, np.array(new, int)])
        return pa.table({"bucket": table.column("bucket"), "id": table.column("id"), "leader": table.column("id").take(pa.array(who)), "v": table.column("v")})

    def attach(table: pa.Table, leads: pa.Table) -> pa.Table:
        none = pa.nulls(table.num_rows, table.schema.field("id").type)
        if not table.num_rows or not leads.num_rows:
            return table.drop_columns(["part"]).append_column("leader", none)
        leads = leads.sort_by("id")
        x, y, first = unit_rows(table.column("v")), unit_rows(leads.column("v")), np.full(table.num_rows, -1)
        for k in range(0, len(x), BLOCK):
            for at in range(0, len(y), BLOCK):
                near = x[k : k + BLOCK] @ y[at : at + BLOCK].T >= threshold
                met = near.any(axis=1) & (first[k : k + BLOCK] < 0)
                first[k : k + BLOCK][met] = at + near[met].argmax(axis=1)
        some = pa.array(np.where(first < 0, 0, first), mask=first < 0)
        return table.drop_columns(["part"]).append_column("leader", leads.column("id").take(some))

    while True:
        limits: dict[str | None, tuple[int, int]] = {}
        for r in left.groupBy("bucket", "block").count().orderBy("bucket", "block").collect():  # a row a block
            last, n = limits.get(r["bucket"], (r["block"], 0))
            limits[r["bucket"]] = (r["block"], n + r["count"]) if not n or n + r["count"] <= size else (last, size + 1)  # full
        if not limits:
            break
        upto = F.broadcast(left.sparkSession.createDataFrame([(b, last) for b, (last, _) in limits.items()], "name string, last int"))
        marked = left.join(upto, F.col("bucket").eqNullSafe(F.col("name"))).drop("name")
        decided = materialize(marked.filter("block <= last").select("bucket", "id", "v").groupBy("bucket").applyInArrow(decide, f"bucket string, id {kind}, leader {kind}, v {vectors}"))
        done.append(decided.select("id", "leader"))
        leads = decided.filter("id = leader").select("bucket", "id", "v").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        rest = marked.filter("block > last").drop("last").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
        rest = rest.select("bucket", "id", "v", "block", "part").groupBy("bucket", "part").cogroup(leads.groupBy("bucket", "part"))
        held = materialize(rest.applyInArrow(attach, f"bucket string, id {kind}, v {vectors}, block int, leader {kind}"))
        done.append(held.filter("leader IS NOT NULL").select("id", "leader"))
        left = held.filter("leader IS NULL").drop("leader")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def stories(clustered: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row per cluster: leader, n_versions, representative (the longest text, the first of equals) and versions, longest first."""
    length = F.char_length(F.coalesce(text, F.lit("")))
    return clustered.groupBy("leader").agg(F.count("*").alias("n_versions"), F.min_by(key, F.struct(-length, key)).alias("representative"), F.array_sort(F.collect_list(F.struct((-length).alias("order"), F.col(key).alias("id")))).alias("versions")).withColumn("versions", F.transform("versions", lambda v: v["id"]))


def fan_out(clustered: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each row with its representative's verdict; an undecided one is pending, never rejected."""
    return clustered.join(verdicts, "leader", "left").withColumn("verdict", F.coalesce("verdict", F.lit(S.PENDING)))


def max_cosine(rows: DataFrame, archive: DataFrame, key: str = "id", vector: str = "embedding", archive_vector: str = "embedding", block: int | None = None) -> DataFrame:
    """Each row's largest cosine to the archive (-1 for an empty one): id, cos. Each pair of a block of rows and one of the archive is one matrix product in one task."""
    size, parts = (max(1, -(-n // (block or block_rows(n)))) for n in (archive.count(), rows.count()))
    left = rows.select(F.col(key).alias("id"), as_vectors(rows, vector).alias("v"))
    right = archive.select(as_vectors(archive, archive_vector).alias("w"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = right.withColumn("at", F.pmod(F.xxhash64("w"), F.lit(size)).cast("int")).withColumn("part", every(parts))
    dealt = left.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("at", every(size))

    def most(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"id": a.column("id").slice(0, 0), "cos": pa.array([], pa.float64())})
        x, y = unit_rows(a.column("v")), unit_rows(b.column("w")).T
        step = max(1, CELLS // y.shape[1])
        return pa.table({"id": a.column("id"), "cos": pa.array(np.concatenate([(x[k : k + step] @ y).max(axis=1) for k in range(0, len(x), step)]))})

    kind = dict(left.dtypes)["id"]
    best = dealt.groupBy("part", "at").cogroup(blocks.groupBy("part", "at")).applyInArrow(most, f"id {kind}, cos double").groupBy("id").agg(F.max("cos").alias("cos"))
    return left.select("id").join(best, "id", "left").select("id", F.coalesce("cos", F.lit(-1.0)).alias("cos"))


def not_repeated(ranked: list[dict], accepted: list[list[float]], take: int, threshold: float = S.DEDUP_COSINE, scan: int = S.MAX_RESERVE_SCAN) -> list[dict]:
    """Of a ranked list on the driver (a quota and its reserve, some hundred rows), the first `take` rows whose cosine to all taken so far stays below the threshold; at most `scan` rows are looked at for each place."""
    taken, vectors, at = [], [np.asarray(v, float) for v in accepted], 0
    unit = lambda v: v / (np.linalg.norm(v) + 1e-10)
    for _ in range(take):
        for row in ranked[at : at + scan]:
            at += 1
            v = np.asarray(row["embedding"], float)
            if not vectors or max(float(unit(v) @ unit(w)) for w in vectors) < threshold:
                taken.append(row)
                vectors.append(v)
                break
    return taken
