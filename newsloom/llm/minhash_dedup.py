"""MinHash near-deduplication with HyperMinHash registers.

A document is the set of its distinct word shingles. Each set is hashed once: the shingle's bucket is its hash modulo
the number of registers, and a register keeps, of the smallest second hash that fell into it, the count of leading
zeros (6 bits) and the 10 mantissa bits behind them: 2 bytes instead of 8. Empty registers borrow the value of a
filled one (the same probing order everywhere), so that small sets match with the probability of their similarity too.

1. Documents with equal sets form a class; from here on classes alone are compared, whatever a class's size.
2. Bands of `rows` registers put classes into buckets. Buckets of up to four give all their pairs, larger ones each
   member with the bucket's hub, the member with the most copies: pairs in proportion to the bucket's size.
3. Pairs whose Jaccard estimate, corrected for chance collisions of compressed registers, is far below the threshold go.
4. The rest are confirmed on their full sets, computed again from the whole texts of the documents concerned alone
   (a bounded Bloom filter of their ids finds them in the second scan, so that texts do not shuffle).
5. Components of confirmed links spread the smallest label by rounds of joins, materialised in the shared folder.
6. In a larger bucket that still holds several components, the members outside the largest are stragglers. The stragglers
   of one component, from all its buckets, are held once against all its members in these buckets and against each other,
   block by block: estimates first, then full sets. Only links that join two components leave a task, a spanning forest
   of what it saw, so that the output follows the members and not the pairs; no bucket is capped or left out.

Null and empty texts have empty sets and are linked with nothing. With fewer words than a shingle the whole sequence is
the one shingle. Repeated rows are copies like others. A null doc_id counts as larger than any other; a component of
only such rows has a null id. Rows with the same doc_id are kept or dropped alike (exact dedup comes first). Words are hashed to 64 bits and sets named by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import exact_dedup

BANDS, ROWS, MANTISSA = 30, 6, 10
#: Pairs whose estimate is so far below the threshold are not confirmed: over six standard errors with 180 registers.
MARGIN = 0.2
#: Buckets of up to so many members give all pairs. Of larger ones, blocks hold so many members and shingles (8 MB) at most.
SMALL, BLOCK, BLOCK_SHINGLES = 4, 2048, 1 << 20


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted within it, one after another; and how many each text has."""
    words, counts = C.word_hashes(texts)
    hashes, owner = C.window_hashes(words, counts, width)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def set_names(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """16 bytes that name each set; None for empty ones."""
    some = np.flatnonzero(sizes)
    if not len(some):
        return [None] * len(sizes)
    at = (np.cumsum(sizes) - sizes)[some]
    a = C.mix(np.add.reduceat(C.mix(hashes), at) + sizes[some].astype(np.uint64))
    b = C.mix(np.add.reduceat(C.mix(hashes ^ np.uint64(0xA0761D6478BD642F)), at))
    names = np.stack([a, b], axis=1)
    out: list[bytes | None] = [None] * len(sizes)
    for i, x in zip(some.tolist(), names):
        out[i] = x.tobytes()
    return out


def registers(hashes: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """HyperMinHash registers of each set, as a matrix of uint16; zeros for empty sets."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    least = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, owner * m + (hashes % np.uint64(m)).astype(np.int64), C.mix(hashes ^ np.uint64(0xE7037ED1A0B428DB)))
    least = least.reshape(n, m)
    filled = least != np.iinfo(np.uint64).max
    top = (least >> np.uint64(11)).astype(np.float64)  # 53 bits, exact
    exponent = np.frexp(np.maximum(top, 1))[1]
    zeros = np.clip(53 - exponent, 0, 62).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = np.where(filled, (zeros << np.uint64(MANTISSA)) | mantissa, 0).astype(np.uint16)
    has = np.flatnonzero(filled.any(axis=1))
    row, col = np.nonzero(~filled[has])
    row = has[row]
    attempt = 1
    while len(row):
        source = (C.mix((col.astype(np.uint64) << np.uint64(32)) + np.uint64(attempt)) % np.uint64(m)).astype(np.int64)
        found = filled[row, source]
        out[row[found], col[found]] = out[row[found], source[found]]
        row, col, attempt = row[~found], col[~found], attempt + 1
    return out


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band; bands differ in their keys."""
    parts = regs.reshape(len(regs), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(rows):
        key = C.mix(key + parts[:, :, i])
    return key.view(np.int64)


def chance_matches(n: int | np.ndarray, k: int | np.ndarray, m: int) -> np.ndarray:
    """Registers of m that two disjoint sets of n and k shingles are expected to share by chance of the compression.

    A register's smallest hash is, for n/m shingles, exponential; two of them share leading zeros and mantissa with
    about the density of their common values times the cell's width: sum over zeros z of p(z) q(z) / 2**MANTISSA.
    """
    a, b = np.maximum(1.0, np.asarray(n) / m), np.maximum(1.0, np.asarray(k) / m)
    total = 0.0
    for z in range(0, 40):
        hi, lo = 2.0**-z, 2.0 ** -(z + 1)
        total = total + (np.power(1 - lo, a) - np.power(1 - hi, a)) * (np.power(1 - lo, b) - np.power(1 - hi, b))
    return total * m / 2**MANTISSA


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of register rows, corrected for chance collisions."""
    m = a.shape[1]
    chance = chance_matches(n, k, m)
    return np.clip(((a == b).sum(axis=1) - chance) / np.maximum(m - chance, 1), 0, 1)


def _sketch(width: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "text"):
                hashes, sizes = shingle_sets(C.text_bytes(part.column("text")), width)
                regs = registers(hashes, sizes, bands * rows)
                keys = pa.array(band_keys(regs, bands, rows).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, bands, dtype=np.int32)), keys)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(set_names(hashes, sizes), pa.binary()), pa.array([x.tobytes() for x in regs], pa.binary()), lists], ["doc_id", "n_shingles", "name", "regs", "bands"])

    return run


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "text"):
                hashes, sizes = shingle_sets(C.text_bytes(part.column("text")), width)
                ends = np.cumsum(sizes)
                sets = [hashes[e - s : e].tobytes() for e, s in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(set_names(hashes, sizes), pa.binary()), pa.array(sets, pa.binary())], ["name", "shingles"])

    return run


def _first_pairs(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes that share a bucket, in proportion to the buckets' sizes; and the members of buckets of more than four."""
    members = classes.select("name", F.explode("bands").alias("bucket"), "size")
    place = F.struct((-F.col("size")).alias("s"), F.xxhash64("name").alias("o"), "name")
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select("bucket", "n", F.col("first.name").alias("hub"))
    with C.scratch(classes.sparkSession) as keep:
        here = keep(C.materialize(members.drop("size").join(C.materialize(buckets), "bucket")))  # with both sides from tables, a hot bucket can be split
    pairs = here.select(F.col("name").alias("a"), F.col("hub").alias("b"))
    few = here.filter((F.col("n") > 2) & (F.col("n") <= SMALL)).groupBy("bucket").agg(F.array_sort(F.collect_list("name")).alias("names"))
    rest = few.select(F.explode(F.expr("flatten(transform(names, (x, i) -> transform(slice(names, i + 2, size(names)), y -> struct(x AS a, y AS b))))")).alias("p"))
    both = pairs.unionByName(rest.select("p.a", "p.b")).filter("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), here.filter(F.col("n") > SMALL).select("bucket", "name")


def _sets_of(names: DataFrame, classes: DataFrame, docs: DataFrame, width: int, bloom_size: dict) -> DataFrame:
    """name and shingles of the classes named, from a scan of the texts of one document each."""
    watch = Observation()
    with C.scratch(docs.sparkSession) as keep:
        wanted = C.materialize(names.distinct().join(classes.select("name", "doc_id"), "name").observe(watch, F.count("*").alias("n")))
        bloom = exact_dedup.build(wanted.select(F.xxhash64("doc_id").alias("key")), watch.get["n"], repeated=False, **bloom_size)
        sets = docs.filter(bloom.probe(F.xxhash64("doc_id"))).select("text").mapInArrow(_sets(width), "name binary, shingles binary")
        sets = sets.join(wanted.select("name"), "name", "left_semi")
        return keep(C.materialize(sets.groupBy("name").agg(F.first("shingles").alias("shingles")), "none"))


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, threshold: int, bloom_size: dict) -> DataFrame | None:
    """Those of the pairs that are confirmed on their full sets; None where there is none to confirm."""
    low = threshold / 100 - MARGIN

    def near(a: pd.Series, b: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        left, right = (np.frombuffer(b"".join(x), np.uint16).reshape(len(x), -1) for x in (a, b))
        return pd.Series(estimates(left, right, n.to_numpy(), k.to_numpy()) >= low)

    sides = [classes.select(F.col("name").alias(c), F.col("regs").alias(f"regs_{c}"), F.col("n_shingles").alias(f"n_{c}")) for c in "ab"]
    likely = pairs.join(sides[0], "a").join(sides[1], "b").filter(F.expr(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)"))
    watch = Observation()
    likely = C.materialize(likely.filter(F.pandas_udf(near, "boolean")("regs_a", "regs_b", "n_a", "n_b")).select("a", "b").observe(watch, F.count("*").alias("n")))
    if not watch.get["n"]:
        return None
    sets = _sets_of(likely.select(F.explode(F.array("a", "b")).alias("name")), classes, docs, width, bloom_size)

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= threshold * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"], ["a", "b"])

    joined = likely.join(sets.select(F.col("name").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("name").alias("b"), F.col("shingles").alias("right")), "b")
    return C.materialize(joined.select("a", "b", "left", "right").mapInArrow(confirmed, "a binary, b binary"))


def overlaps(left: np.ndarray, left_sizes: np.ndarray, right: np.ndarray, right_sizes: np.ndarray) -> np.ndarray:
    """How many shingles each set on the left shares with each on the right, exactly; sets one after another, distinct within each."""
    n, k = len(left_sizes), len(right_sizes)
    counts = np.zeros((n, k), np.float32)
    distinct, code = np.unique(np.concatenate([left, right]), return_inverse=True)
    row, col = np.repeat(np.arange(n), left_sizes), np.repeat(np.arange(k), right_sizes)
    lcode, rcode = code[: len(left)], code[len(left) :]
    nl, nr = np.bincount(lcode, minlength=len(distinct)), np.bincount(rcode, minlength=len(distinct))
    frequent = nl * nr * 32 >= n * k  # these by products of matrices, the others pair by pair
    number = np.flatnonzero(frequent)
    place = np.full(len(distinct), -1)
    place[number] = np.arange(len(number))
    for at in range(0, len(number), 512):
        a, b = np.zeros((n, 512), np.float32), np.zeros((k, 512), np.float32)
        for matrix, codes, owner in ((a, lcode, row), (b, rcode, col)):
            p = place[codes] - at
            here = (p >= 0) & (p < 512)
            matrix[owner[here], p[here]] = 1
        counts += a @ b.T
    l, r = ~frequent[lcode] & (nr[lcode] > 0), ~frequent[rcode]
    lcode, row, order = lcode[l], row[l], np.argsort(rcode[r], kind="stable")
    col, first = col[r][order], np.searchsorted(rcode[r][order], lcode)
    many, flat = nr[lcode], counts.ravel()
    for part in np.split(np.arange(len(lcode)), np.flatnonzero(np.diff(np.cumsum(many) >> 21)) + 1):
        each = many[part]
        inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        np.add.at(flat, np.repeat(row[part], each) * k + col[np.repeat(first[part], each) + inside], 1)
    return counts


def joining(links: np.ndarray, row_labels: np.ndarray, col_labels: np.ndarray) -> list[tuple[int, int]]:
    """Of a matrix of links between rows and columns, pairs of labels that span what the links join."""
    label, at = np.unique(np.concatenate([row_labels, col_labels]), return_inverse=True)
    root, out = label.copy(), []
    rows, cols = at[: len(row_labels)], at[len(row_labels) :]
    for i in np.flatnonzero(links.any(axis=1)).tolist():
        met = np.unique(np.append(root[cols[links[i]]], root[rows[i]]))
        if len(met) > 1:
            out.extend((int(met[0]), int(x)) for x in met[1:])
            root[np.isin(root, met)] = met[0]
    return out


def _straggler_links(busy: DataFrame, labels: DataFrame | None, classes: DataFrame, docs: DataFrame, width: int, threshold: int, registers_of: int, bloom_size: dict) -> DataFrame | None:
    """Pairs of labels (a, b) that confirmed links join, for members of large buckets outside the largest component there; None if there are no such members."""
    members = busy.withColumn("label", F.col("name")) if labels is None else busy.join(labels, "name", "left").withColumn("label", F.coalesce("label", "name"))
    sizes = members.groupBy("bucket", "label").agg(F.count("*").alias("k"))
    watch = Observation()
    tops = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("k", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1").select("bucket", "top")
    tops = C.materialize(tops.observe(watch, F.count("*").alias("n")))
    if not watch.get["n"]:
        return None
    rows = C.materialize(members.join(tops, "bucket").select("top", "name", "label").distinct())
    sets = _sets_of(rows.select("name"), classes, docs, width, bloom_size)
    rows = C.materialize(rows.join(sets, "name"), "none")
    shingles, straggler = (F.octet_length("shingles") / 8).cast("long"), F.col("label") != F.col("top")
    blocks = lambda sum, n: F.ceil(F.greatest(sum / BLOCK_SHINGLES, n / BLOCK)).cast("int")
    total = rows.groupBy("top").agg(blocks(F.sum(shingles), F.count("*")).alias("right"), blocks(F.sum(F.when(straggler, shingles)), F.count_if(straggler)).alias("left")).filter("left > 0")
    here = rows.join(C.materialize(total), "top")
    every, own = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)), lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    cols = ["top", "name", "label", "shingles"]
    one = here.select(*cols, every("left").alias("i"), own("right").alias("j"), F.lit(False).alias("straggler"))
    other = here.filter(straggler).select(*cols, own("left").alias("i"), every("right").alias("j"), F.lit(True).alias("straggler"))

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("straggler").to_numpy()
        names, codes = np.unique(np.array(table.column("label").to_pylist(), object), return_inverse=True)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        parts = []
        for at in (np.flatnonzero(side), np.flatnonzero(~side)):
            n = np.array([len(sets[i]) for i in at.tolist()], np.int64)
            flat = np.concatenate([sets[i] for i in at.tolist()]) if len(at) else np.zeros(0, np.uint64)
            parts.append((at, n, flat))
        (left, n, a), (right, k, b) = parts
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            p, q = registers(a, n, registers_of), registers(b, k, registers_of)
            likely = np.zeros((len(left), len(right)), bool)
            for i in range(len(left)):
                other = np.flatnonzero((codes[right] != codes[left[i]]) & (100 * np.minimum(n[i], k) >= threshold * np.maximum(n[i], k)))
                if len(other):
                    likely[i, other] = estimates(p[i : i + 1], q[other], n[i], k[other]) >= threshold / 100 - MARGIN
            some, cols = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
            if len(some):
                shared = overlaps(a[np.repeat(np.isin(np.arange(len(n)), some), n)], n[some], b[np.repeat(np.isin(np.arange(len(k)), cols), k)], k[cols])
                union = n[some][:, None] + k[cols][None, :] - shared
                found = joining(likely[np.ix_(some, cols)] & (100 * shared.astype(np.float64) >= threshold * union), codes[left[some]], codes[right[cols]])
        return pa.table({c: pa.array([names[x[i]] for x in found], pa.binary()) for i, c in enumerate("ab")})

    return C.materialize(one.unionByName(other).groupBy("top", "i", "j").applyInArrow(compare, "a binary, b binary"))


def components(links: DataFrame) -> DataFrame:
    """name, label of every name in links (a, b): the smallest name that links reach. Rounds of two joins until nothing changes."""
    spark = links.sparkSession
    with C.scratch(spark) as keep:
        both = C.materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        labels = C.materialize(both.groupBy(F.col("a").alias("name")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
        while True:
            before = labels
            seen = both.join(labels.withColumnRenamed("name", "b"), "b").groupBy(F.col("a").alias("name")).agg(F.min("label").alias("near"))
            step = labels.join(seen, "name").select("name", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            jump = step.join(step.select(F.col("name").alias("label"), F.col("label").alias("far")), "label")
            watch = Observation()
            moved = F.least("label", "far") < F.col("old")
            labels = C.materialize(jump.select("name", F.least("label", "far").alias("label"), moved.alias("moved")).observe(watch, F.count_if("moved").alias("moved")))
            if not watch.get["moved"]:
                return keep(before).select("name", "label")


def _alone(spark: SparkSession, f: Callable[[], DataFrame | None]) -> DataFrame | None:
    """The table that f writes last; those before it are deleted."""
    with C.scratch(spark) as keep:
        found = f()
        return found if found is None else keep(found)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS, **bloom_size: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and `name` (of its set; null: empty), `size` (rows of its component)."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), C.text_or_empty(f"`{text_col}`").alias("text"))
    spark = docs.sparkSession
    with C.scratch(spark) as keep:
        sketched = keep(C.materialize(docs.mapInArrow(_sketch(width, bands, rows), "doc_id long, n_shingles long, name binary, regs binary, bands array<long>")))
        some = sketched.filter("name IS NOT NULL")
        classes = C.materialize(some.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("size"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"), F.first("bands").alias("bands")))
        least = int(np.ceil(threshold / max(1, 100 - threshold)))  # a smaller set is linked with equal ones alone
        able = classes.filter(F.col("n_shingles") >= least)
        first, busy = _first_pairs(able)
        links = _alone(spark, lambda: _linked(first, able, docs, width, threshold, bloom_size))
        labels = None if links is None else components(links)
        more = _alone(spark, lambda: _straggler_links(busy, labels, able, docs, width, threshold, bands * rows, bloom_size))
        node = classes.select("name", "doc_id", "size")
        node = node.withColumn("label", F.col("name")) if labels is None else node.join(labels, "name", "left").withColumn("label", F.coalesce("label", "name"))
        if more is not None and not more.isEmpty():
            joined = components(more).select(F.col("name").alias("label"), F.col("label").alias("root"))
            node = node.join(joined, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
        label_ids = C.materialize(node.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.sum("size").alias("rows")))
        named = keep(C.materialize(node.join(label_ids, "label").select("name", "component_id", F.col("rows").alias("size"))))
    out = some.select("doc_id", "n_shingles", "name").join(named, "name")
    empty = sketched.filter("name IS NULL").select("doc_id", "n_shingles", "name", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("size"))
    cols = ["doc_id", "n_shingles", "component_id", "name", "size"]
    return out.select(cols).unionByName(empty.select(cols)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params: int) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group those with the smallest id. Rows without an id stay, and rows of an id that stays anywhere."""
    key, maybe = C.free("__id", docs), C.free("__maybe", docs)
    with C.scratch(docs.sparkSession) as keep:
        gone = near_groups(docs, id_col, text_col, **params).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(key)).agg(F.max("kept").alias("stays")).filter("NOT stays").select(key)
        gone = keep(C.materialize(gone))
    bloom = exact_dedup.build(gone.select(F.xxhash64(key).alias("key")), gone.count(), repeated=False)
    flagged = docs.withColumn(maybe, bloom.probe(F.xxhash64(F.col(f"`{id_col}`").cast("long"))))
    met = flagged.filter(F.col(maybe)).join(gone, F.col(f"`{id_col}`") == F.col(key), "left_anti")
    return flagged.filter(~F.col(maybe)).union(met).drop(maybe)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(C.table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op10_minhash_near_dedup": op10_minhash_near_dedup}
ORACLE_SQL = {
    "op10_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach),
        c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """
}
