"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import bpe, chat_format, exact_dedup, lattice_lm, minhash_dedup, packing, quality_classifier, quality_rules, sharding, substring_dedup
from newsloom.llm import common as C
from newsloom.llm import registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(5)
VOCABULARY = ["".join(random.choice("abcdefghiklmnoprstu") for _ in range(random.randint(2, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + ("." if r.random() < 0.12 else "") for _ in range(n))


def edited(text, n, seed):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(VOCABULARY) + "x"
    return " ".join(words)


PASSAGE = "This passage was copied around. It has several sentences of its own, and more than fifty words in all. " * 2 + prose(40, 99) + "."


def hard_rows():
    base, other = prose(120, 1), prose(150, 2)
    rows = [(i, base if i % 2 else other) for i in range(6)]  # exact copies
    rows += [(10 + i, edited(base, 3, i)) for i in range(30)]  # near copies
    rows += [(50 + i, prose(80, 200 + i) + "\n" + PASSAGE + "\n" + prose(50, 300 + i)) for i in range(5)]
    rows += [(60, None), (61, ""), (62, "   \n\t"), (63, "a"), (64, "a b c"), (65, "a b c"), (66, "A B C"), (67, "one two three four five"), (68, "\x00 <|endoftext|> İΣ é é ￿ \x1c 字")]
    rows += [(70, prose(20000, 7)), (71, "x" * 30000), (72, " ".join(["same words again and"] * 60)), (73, "\n".join(["one line of text"] * 20)), (None, base), (None, None), (74, "###### $$$ ||| &&&")]
    rows += [(80, "repeated row of this very text here")] * 3
    rows += [(100 + i, prose(60, 400 + i)) for i in range(60)]
    return [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(hard_rows(), KINDS).withColumn("__doc", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("name", F.lit(2)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KINDS)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_word_hashes():
    texts = [b"", b"a b", b"B  a\tb\x0bc", b" "]
    hashes, counts = C.word_hashes(texts)
    assert counts.tolist() == [0, 2, 4, 0]
    a, b, b2, a2, b3, c = hashes.tolist()
    assert a == a2 and b == b2 == b3 and len({a, b, c}) == 3
    r = random.Random(3)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    found = defaultdict(set)
    for w, h in zip(words, C.word_hashes([" ".join(words).encode()])[0].tolist()):
        found[w].add(h)
    assert all(len(x) == 1 for x in found.values()) and len(set.union(*found.values())) == len(found)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n)), "".join("ba"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_in_polynomials_stay_apart(spark):
    """The Thue-Morse word and its complement agree under any polynomial over bytes modulo 2**64."""
    a, b = thue_morse(2048)
    assert len(set(C.word_hashes([f"{a} {b}".encode()])[0].tolist())) == 2
    rows = [(1, f"{a} {a} x {a} {a}", "en", "s", 0), (2, f"{b} {b} x {b} {b}", "en", "s", 0)]
    assert all(r["kept"] for r in minhash_dedup.near_groups(spark.createDataFrame(rows, KINDS), width=4).collect())


def test_exact_dedup(docs, none):
    want = Counter()
    groups = defaultdict(list)
    for i, t in rows_of(docs):
        groups[t or ""].append(i)
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    got = exact_dedup.duplicate_groups(docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    alone = {r["text_sha256"] for r in got if not r["possibly_repeated"]}
    assert not any(hashlib.sha256(t.encode()).hexdigest() in alone for t, ids in groups.items() if len(ids) > 1)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and Counter((t or "") for _, t in rows_of(kept)) == Counter(list(groups))
    assert all(i == max((x for x in groups[t or ""] if x is not None), default=None) for i, t in rows_of(kept))
    assert exact_dedup.duplicate_groups(none).count() == 0 and exact_dedup.drop_exact_copies(none).count() == 0
    tiny = exact_dedup.duplicate_groups(docs, bits_per_row=1, max_bits=1 << 16)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in tiny.collect()) == want


def text_rules(t):
    t = t or ""
    w = WORD.findall(t)
    runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {p for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, none):
    got = quality_rules.quality(docs, max_docs=3).collect()
    want = Counter((i, *text_rules(t)) for i, t in rows_of(docs))
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got)
    # lines, by brute force
    per_line, info = defaultdict(dict), []
    for r in docs.select("doc_id", "text", "source").collect():
        t = r["text"] or ""
        w = [x for x in re.split(C.SPACE, t) if x]
        marks = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {t}
        lines = [re.sub(C.SPACE, " ", re.sub(r"[0-9]+", "0", x.lower())).strip(" ") for x in t.split("\n") if WORD.search(x)]
        info.append((r["doc_id"], t, r["source"], lines))
        for x in set(lines):
            per_line[(r["source"], x)].setdefault(frozenset(marks), []).append(r["doc_id"] if r["doc_id"] is not None else math.inf)
    verdicts = Counter()
    for i, t, s, lines in info:
        order = math.inf if i is None else i
        gone = [x for x in lines if len(per_line[(s, x)]) > 3 and order > min(min(v) for v in per_line[(s, x)].values())]
        failed = text_rules(t)[0] < 10 or 100 * text_rules(t)[4] > 20 * text_rules(t)[0]
        whole = sum(map(len, lines))
        verdicts[(i, not failed and not whole - sum(map(len, gone)) < 0.3 * whole)] += 1
    assert Counter((r["doc_id"], r["kept"]) for r in got) == verdicts
    kept = quality_rules.keep_good(docs.drop("__doc"), max_docs=3)
    assert kept.count() == sum(r["kept"] for r in got) and quality_rules.quality(none).count() == 0


def test_boilerplate_is_removed_and_depletes(spark):
    line = "This very line stands in all of the documents here"
    rows = [(i, line + "\n" + (prose(40, i) if i % 2 else f"word number {VOCABULARY[i]} and some nine more like it so"), "en", "h", 0) for i in range(30)]
    got = {r["doc_id"]: r for r in quality_rules.quality(spark.createDataFrame(rows, KINDS), max_docs=10, min_share=0.6).collect()}
    assert got[0]["n_removed_lines"] == 0 and got[0]["kept"]
    assert all(got[i]["n_removed_lines"] == 1 and got[i]["kept"] == (i % 2 == 1) for i in range(1, 30))


def test_pages_with_much_navigation_are_each_counted(spark):
    navigation = "\n".join(prose(10, 900 + k) for k in range(20))
    rows = [(i, navigation + "\n" + prose(10, 5000 + i), "en", "h", 0) for i in range(120)]
    rows += [(1000 + i, prose(60, 2000 + i), "en", "h", 0) for i in range(5)]
    rows += [(1000, prose(60, 2000), "en", "h", 0)] * 60  # repeated rows are one document
    got = quality_rules.quality(spark.createDataFrame(rows, KINDS)).collect()
    pages = {r["doc_id"]: r for r in got if r["doc_id"] < 120}
    assert pages[0]["n_removed_lines"] == 0 and pages[0]["kept"]
    assert all(pages[i]["n_removed_lines"] == 20 and not pages[i]["kept"] for i in range(1, 120))
    assert all(r["kept"] and not r["n_removed_lines"] for r in got if r["doc_id"] >= 1000)


def test_removed_lines_leave_the_texts(spark):
    lines = ["Home | News   | Sport", "Page 12 of 40, read on"]
    own = [prose(30, 7000 + i) for i in range(60)]
    rows = [(i, f"{lines[0]}\n\n{own[i]}\n{lines[1].replace('12', str(i))}\n", "en", "h", 0) for i in range(60)]
    rows += [(100, f"{lines[0]}\n{own[0]}", "en", "other", 0), (101, None, "en", "h", 0), (5, rows[5][1], "en", "h", 0), (102, "\n".join(lines * 6), "en", "h", 0)]
    d = spark.createDataFrame(rows, KINDS).withColumn("extra", F.lit("x"))
    want = Counter((i, t if i in (0, 100) else f"\n{own[i]}\n") for i, t, *_ in rows if i < 101)
    kept = quality_rules.keep_good(d)
    assert kept.columns == d.columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    every = quality_rules.judged(d).collect()
    assert Counter((r["doc_id"], r["text"]) for r in every) == want + Counter([(101, None), (102, "")])
    assert {r["n_removed_lines"] for r in every if 0 < r["doc_id"] < 100} == {2} and not any(r["kept"] for r in every if r["doc_id"] > 100)
    import corpus_pipeline

    assert all(r["n_chars"] == len(r["text"]) for r in corpus_pipeline.quality(spark, d, "").collect())


def components(rows, width, threshold):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[n] = frozenset([tuple(w[k : k + width]) for k in range(len(w) - width + 1)] or ([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return Counter((i, len(sets[n]), least.get(find(n), i)) for n, (i, _) in enumerate(rows))


@pytest.mark.parametrize("width", [4, 5])
def test_minhash_dedup(docs, width):
    got = minhash_dedup.near_groups(docs, width=width).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components(rows_of(docs), width, 80)


def test_minhash_large_group_and_empty(spark, none):
    base = prose(200, 11)
    rows = [(i, edited(base, i % 9, i), "en", "s", 0) for i in range(150)]
    got = minhash_dedup.near_groups(spark.createDataFrame(rows, KINDS), width=4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components([r[:2] for r in rows], 4, 80)
    assert minhash_dedup.near_groups(none).count() == 0 and minhash_dedup.drop_near_copies(none).count() == 0


def test_minhash_stragglers(spark, monkeypatch):
    """A template too far from most of its copies: links run between copies, across blocks."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 7)
    base, rows = prose(160, 21), []
    for k in range(12):
        own = edited(base, 6, 100 + k)  # families around the template, linked within and partly across
        rows += [(100 * k + i, edited(own, i % 6, 1000 + 50 * k + i), "en", "s", 0) for i in range(12)]
    got = minhash_dedup.near_groups(spark.createDataFrame(rows, KINDS), width=4).collect()
    want = components([r[:2] for r in rows], 4, 80)
    assert 1 < len({c for _, _, c in want}) < len(rows)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_overlaps_are_exact_and_forests_span():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(common, rng.integers(0, 60)), rng.integers(0, 400, rng.integers(1, 80)).astype(np.uint64)])) for _ in range(70)]
    left, right = sets[:30], sets[30:]
    flat = lambda x: (np.concatenate(x), np.array(list(map(len, x))))
    got = minhash_dedup.overlaps(*flat(left), *flat(right))
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
    links, rows, cols = rng.random((30, 40)) < 0.03, rng.integers(0, 25, 30), rng.integers(0, 25, 40)

    def classes(pairs):
        at = list(range(25))
        for a, b in pairs:
            x, y = at[a], at[b]
            at = [x if z == y else z for z in at]
        return [[at[i] == at[j] for j in range(25)] for i in range(25)]

    spanning = minhash_dedup.joining(links, rows, cols)
    assert len(spanning) < 25 and classes(spanning) == classes([(rows[i], cols[j]) for i, j in zip(*np.nonzero(links))])


def test_minhash_recall_on_a_whole_table(spark):
    """Ids divisible by 20 against all rows of sf0.01, by brute force: what is linked shares a component."""
    table = C.table(spark, "/root/testdata/sf0.01", "documents")
    component = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_groups(table, width=4).collect()}
    sets, holders = {}, defaultdict(list)
    for i, t in rows_of(table):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
        for x in sets[i]:
            holders[x].append(i)
    linked = []
    for i in (i for i in sets if i % 20 == 0):
        shared = Counter(j for x in sets[i] for j in holders[x] if j != i)
        linked += [(i, j) for j, n in shared.items() if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n)]
    assert linked and all(component[i] == component[j] for i, j in linked)


def test_drop_near_copies(docs):
    groups = minhash_dedup.near_groups(docs).filter("doc_id IS NOT NULL").collect()
    kept = minhash_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {i for i, _ in rows_of(kept)} == {r["doc_id"] for r in groups if r["kept"]} | {None}


def test_estimates_are_corrected():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(30):
            n = 400
            both = rng.integers(0, 2**63, int(n * 2 * share / (1 + share))).astype(np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, n - len(both)).astype(np.uint64)])) for _ in range(2))
            regs = minhash_dedup.registers(np.concatenate([a, b]), np.array([len(a), len(b)]), 180)
            errors.append(minhash_dedup.estimates(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))[0] - share)
        assert abs(np.mean(errors)) < 0.03


def test_substring_dedup(docs, none):
    got = substring_dedup.remove_repeats(docs)
    assert set(docs.columns) <= set(got.columns)
    texts = {r["doc_id"]: r["text"] for r in got.collect() if r["doc_id"] is not None}
    assert sum("copied around" in (t or "") for t in texts.values()) == 1 and "copied around" in texts[50]
    before = dict(rows_of(docs))
    assert texts[60] is None and texts[61] == "" and all(texts[i] == before[i] for i in (70, 71, 63, *range(100, 160)))
    assert all(prose(80, 200 + i) in texts[50 + i] for i in range(5))
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_runs_by_brute_force(spark):
    r = random.Random(3)
    pool = [" ".join(r.choice(VOCABULARY) for _ in range(r.randint(1, 25))) + "." for _ in range(40)]
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 12))), "en", "s", 0) for i in range(40)]
    got = {x["doc_id"]: x["text"] for x in substring_dedup.remove_repeats(spark.createDataFrame(rows, KINDS)).collect()}
    seen, gone = {}, defaultdict(set)
    for i, t, *_ in rows:
        cut = [t[a:b] for a, b, _ in substring_dedup.sentences(t)]
        n = [len(WORD.findall(s)) for s in cut]
        enough = lambda a, b: (b - a + 1 >= 2 and sum(n[a : b + 1]) >= 16) or sum(n[a : b + 1]) >= 30
        spans = set()
        for a in range(len(cut)):
            spans |= {(a, b) for b in range(a, len(cut)) if enough(a, b) and not any(enough(a, c) for c in range(a, b))}
            spans |= {(b, a) for b in range(a + 1) if enough(b, a) and not any(enough(c, a) for c in range(b + 1, a + 1))}
        for a, b in sorted(spans):
            k = tuple(cut[a : b + 1])
            if seen.setdefault(k, (i, a)) != (i, a):
                gone[i] |= set(range(a, b + 1))
    for i, t, *_ in rows:
        parts = substring_dedup.sentences(t)
        assert got[i] == ("".join(t[a:c] for k, (a, _, c) in enumerate(parts) if k not in gone[i]) if gone[i] else t)


def units(t):
    return len(re.findall(r"[\u3400-\u9fff]|[^\s\u3400-\u9fff。！？，、；：．｡､]+", t))


def test_parts_by_plain_python():
    """Cuts, lengths and hashes of parts against a loop over characters."""
    r = random.Random(8)
    alphabet = ["a", "Bc", "def", "x" * 20, "é", "字", "𠀀", "😀", "。", "，", ".", ",", ";", "…", " ", " ", " ", "  ", "\n", "\t", "\u00a0", "ท"]
    texts = ["", " ", "\n\n", "a", " a. b\n", "𠀀𠀀a😀b。。c ，d"] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 120))) for _ in range(300)]
    p = substring_dedup.parts_of(texts)
    assert p.number.tolist() == [len(substring_dedup.sentences(t)) for t in texts]
    single = re.compile(r"[\u0e00-\u0eff\u3400-\u9fff\U00020000-\U0002ffff]")
    unit = re.compile(r"(?:[\u0e00-\u0eff\u3400-\u9fff\U00020000-\U0002ffff]|[^\x20\x09-\x0D\u0e00-\u0eff\u3400-\u9fff\U00020000-\U0002ffff。，]+|[。，])[。，]*")
    named = defaultdict(set)
    at = 0
    for t in texts:
        cut = substring_dedup.sentences(t)
        assert t[: cut[0][0]].strip(" \t\n") + "".join(t[a:c] for a, _, c in cut) == t.lstrip(" \t\n") if cut else not t.strip(" \t\n")
        ends = {b for _, b, _ in cut}
        found = list(unit.finditer(t))
        must = {m.end() for m, k in zip(found, found[1:]) if m[0][-1] in "。，" or k.start() > m.end() and (m[0][-1] in ".,;…" or "\n" in t[m.end() : k.start()])}
        assert must <= ends and ends <= {m.end() for m in found}
        for a, b, _ in cut:
            words = [m[0] for m in unit.finditer(t, a, b)]
            n = sum(bool(single.match(w)) for w in words)
            assert len(words) <= 16 and p.words[at] == len(words) - n + (n + 1) // 2
            named[tuple(w.replace("B", "b") for w in words)].add((int(p.hashes[at]), int(p.seconds[at])))
            at += 1
    assert all(len(x) == 1 for x in named.values()) and len(set.union(*named.values())) == len(named)


@pytest.mark.parametrize("kind", ["stops", "no stops", "full-width"])
def test_any_fifty_repeated_words_are_found(spark, kind):
    r = random.Random(11)

    def text(n):
        if kind == "full-width":
            return "".join(chr(r.randrange(0x4E00, 0x9FA0)) + ("，" if r.random() < 0.06 else "") for _ in range(2 * n))
        words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
        return " ".join(w + ("," if kind == "stops" and r.random() < 0.06 else "") for w in words)

    gap, rows = "" if kind == "full-width" else " ", []
    for i in range(300):
        passage = text(50)
        rows += [(2 * i + k, gap.join([text(r.randint(5, 60)), passage, text(r.randint(5, 60))]), "en", "s", 0) for k in range(2)]
    got = {x["doc_id"]: x for x in substring_dedup.remove_repeats(spark.createDataFrame(rows, KINDS)).collect()}
    assert all(got[i]["text"] == t if i % 2 == 0 else got[i]["n_removed"] >= 2 and len(got[i]["text"]) < len(t) for i, t, *_ in rows)
    for i, t, *_ in rows:
        cut = substring_dedup.sentences(t)
        assert "".join(t[a:c] for a, _, c in cut) == t and all(units(t[a:b]) <= 16 and t[b:c].strip() == "" for a, b, c in cut)


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.crc32_of(packing.pack(docs.filter("doc_id IS NOT NULL AND doc_id <> 80"))).collect()
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in rows_of(docs)}
    assert all(zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and len(want[r["doc_id"]]) == r["doc_tokens"] for r in got)
    at = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    assert all(s * 2048 + o == sum(x[2] for x in at[:k]) for k, (s, o, _) in enumerate(at)) and sum(x[2] for x in at) == sum(len(want[i]) for i, _ in rows_of(docs.filter("doc_id IS NOT NULL AND doc_id <> 80")))
    assert packing.pack(docs).agg(F.sum("length")).first()[0] == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows_of(docs))
    assert packing.pack(none).count() == 0


def test_hilbert_curve():
    grid = np.array([(i, j) for i in range(16) for j in range(16)])
    order = grid[np.argsort(packing.hilbert(grid, 4))]
    assert len(set(packing.hilbert(grid, 4).tolist())) == 256 and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_bpe(spark, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    plain = docs.filter("doc_id IS NOT NULL")
    encoded = bpe.encode(plain)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    decoded = {r["doc_id"]: r["text"] for r in bpe.decode(encoded).collect()}
    for i, x in rows_of(plain):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert ids[i] == want and decoded[i] == t.decode(want, skip_special_tokens=False)
    assert bpe.encode(none).count() == 0


def test_bpe_keeps_a_bounded_number_of_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 20_000)
    c, r = bpe.Coder(bpe.default_vocabulary()), random.Random(6)
    fresh = bpe.Coder(bpe.default_vocabulary())
    for k in range(12):
        texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.choice([3, 9, 400]))) for _ in range(30)) for _ in range(3)]
        assert [x.tolist() for x in c.encode(texts)] == [x.tolist() for x in fresh.encode(texts)]
        assert sum(len(w) for w in c.known if w not in c.long) < 60_000 and c.kept < 80_000
        fresh.known.clear()


def test_lattice_walks_long_words_in_blocks(monkeypatch):
    v = lattice_lm.pieces(lattice_lm.default_vocabulary())
    log_p, r = np.append(v.start, lattice_lm.LOW), random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n)).encode() for n in (1, 5, 30, 31, 100, 100, 150, 400)]
    times = np.array([1, 2, 3, 1, 1, 2, 1, 4])
    whole = [float(lattice_lm._forward(log_p[v.lattice(rows)])[k, -1]) for w in words for rows in [np.frombuffer(b" " + w, np.uint8).reshape(1, -1)] for k in [0]]
    counts = lattice_lm.expected_counts(words, times, v, log_p)
    monkeypatch.setattr(lattice_lm, "WALK", 40)
    assert np.allclose(lattice_lm.word_scores(words, v, log_p), whole, rtol=1e-12)
    assert np.allclose(lattice_lm.expected_counts(words, times, v, log_p), counts, rtol=1e-9, atol=1e-12)
    monkeypatch.undo()
    big = ("".join(r.choice("abcdefgh0123") for _ in range(60_000))).encode()
    tracemalloc.start()
    score = lattice_lm.word_scores([big], v, log_p)[0]
    assert tracemalloc.get_traced_memory()[1] < 60e6 and -6 * len(big) < score < 0
    tracemalloc.stop()


def test_lattice_gathers_small_batches(spark, monkeypatch):
    """What the query's tasks do with batches of a thousand words and less: few walks over many words, with the same results."""
    import pyarrow as pa

    def cut(words, most):
        whole = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([3] * len(words), pa.int64()), pa.array([2] * len(words), pa.int64())], ["word", "total", "trained"])
        return [whole.slice(i, most) for i in range(0, len(words), most)]

    docs, tasks, walked = spark.createDataFrame([(i, prose(40, i)) for i in range(20)], "doc_id long, text string"), [], []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **k: (tasks.append(f), real(self, f, *a, **k))[1])
    lattice_lm.score_texts(docs, rounds=1)
    expect, scored = (next(f for f in tasks if f.__name__ == name) for name in ("expect", "scored"))
    for name in ("expected_counts", "word_scores"):
        monkeypatch.setattr(lattice_lm, name, lambda words, *a, f=getattr(lattice_lm, name): (walked.append(len(words)), f(words, *a))[1])
    words = [b"%x" % (i * 2654435761) for i in range(lattice_lm.GATHER + 5000)]
    for task in (expect, scored):
        whole = pa.Table.from_batches(task(iter(cut(words, len(words)))))
        walked.clear()
        small = pa.Table.from_batches(task(iter(cut(words, 1000))))
        assert len(walked) == 2 and sum(walked) == len(words) and max(walked) < lattice_lm.GATHER + 1000
        assert small.column(0).equals(whole.column(0)) and all(np.allclose(small.column(c), whole.column(c), rtol=1e-9) for c in range(1, whole.num_columns))
        assert not list(task(iter([])))
    big = [b"x" * 300_000] * 40 + [b"y"]
    got = list(lattice_lm._gathered(iter(cut(big, 1))))
    assert [w for b in got for w in b.column("word").to_pylist()] == big and max(b.column("word").nbytes for b in got) < lattice_lm.GATHER_BYTES + 400_000


def test_lm_scores_by_brute_force(spark, monkeypatch):
    """The query's score: the log of the sum over all segmentations of each word, by plain recursion, with the fitted pieces."""
    texts = [(i, prose(25, 70 + i), "en", "s", 0) for i in range(14)] + [(20, None, "en", "s", 0), (21, "x" * 300 + " Ünïcode 字字", "en", "s", 0)]
    fitted, real = [], lattice_lm.fit

    def spy(*a):
        fitted.append(real(*a))
        return fitted[-1]

    monkeypatch.setattr(lattice_lm, "fit", spy)
    got = {r["doc_id"]: r["score"] for r in lattice_lm.score_texts(spark.createDataFrame(texts, KINDS), rounds=2).collect()}
    (log_p, log_end), v = fitted[0], lattice_lm.pieces(lattice_lm.default_vocabulary())

    def word(w):
        w, alpha = b" " + w, [0.0]
        for e in range(1, len(w) + 1):
            terms = []
            for b in range(max(0, e - v.longest), e):
                p = int(v.find(np.array([lattice_lm._roll(np.frombuffer(w[b:e], np.uint8).reshape(1, -1))[0, -1] + np.uint64(e - b)], np.uint64))[0])
                if p < v.n:
                    terms.append(alpha[b] + log_p[p])
            most = max(terms)
            alpha.append(most + math.log(sum(math.exp(t - most) for t in terms)))
        return alpha[-1]

    for i, t, *_ in texts:
        want = (sum(word(w) for w in (t or "").encode().lower().split()) + log_end) / math.log(10)
        assert abs(got[i] - want) < 1e-6 * abs(want)


def test_equal_rows_are_dealt_over_many_parts(spark):
    rows = spark.range(0, 20_000, 1, 8).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    got = sharding.assign(rows)
    assert sorted(r["slot"] for r in got.collect()) == list(range(20_000))
    assert got.select("shard").distinct().count() == 1


def test_bpe_fuzz():
    from tokenizers import Tokenizer

    t, c, r = Tokenizer.from_file(bpe.default_vocabulary()), bpe.Coder(bpe.default_vocabulary()), random.Random(2)
    pool = "abcdeABCΣσςİıßÀé'sS'T re llVE'd 019½²٣ \t\n\x0b\x1c\x1f\x85\xa0 　!?<|>_-中日हि̧́😀\x00ﬁǅẞᄒ"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) + ("<|startoftext|>" if k % 7 == 0 else "") for k in range(800)]
    assert [x.tolist() for x in c.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_lattice(spark, docs, none):
    small = 5
    for frequent in (lattice_lm.FREQUENT, small):
        got = lattice_lm.score_texts(docs, frequent=frequent, rounds=1).collect()
        tokens = [(i, [*(t or "").encode().lower().split(), b" "]) for i, t in rows_of(docs)]
        held = {i: zlib.crc32(("null" if i is None else str(i)).encode()) % 10 == 0 for i, _ in tokens}
        c = Counter(w for i, ws in tokens if not held[i] for w in ws)
        n, v = sum(c.values()), len(c)
        base = lambda ws: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        want = Counter((i, held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(base(ws), 3)) for i, ws in tokens)
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == want
        assert all(r["score"] < 0 for r in got)
    assert lattice_lm.score_texts(none).count() == 0


def test_lattice_recursion():
    v = lattice_lm.pieces(lattice_lm.default_vocabulary())
    log_p = np.append(v.start, lattice_lm.LOW)
    words = [b"the", b"lattice", "naïve".encode(), b"zz%%q", b"a" * 40]

    def brute(w):
        w = b" " + w
        total = [1.0] + [0.0] * len(w)
        for e in range(1, len(w) + 1):
            for k in range(1, min(e, lattice_lm.LONGEST) + 1):
                rows = np.frombuffer(w[e - k : e], np.uint8).reshape(1, k)
                piece = v.lattice(rows)[0, k - 1, k - 1]
                if piece < v.n:
                    total[e] += total[e - k] * math.exp(log_p[piece])
        return math.log(total[-1])

    assert np.allclose(lattice_lm.word_scores(words, v, log_p), [brute(w) for w in words])
    counts = lattice_lm.expected_counts(words, np.array([1.0, 2, 3, 4, 5]), v, log_p)
    better = np.append(np.log((counts + 1e-3) / (counts + 1e-3).sum()), lattice_lm.LOW)
    assert (lattice_lm.word_scores(words, v, better) * [1, 2, 3, 4, 5]).sum() > (lattice_lm.word_scores(words, v, log_p) * [1, 2, 3, 4, 5]).sum()


def test_lattice_holds_every_piece_of_the_vocabulary():
    import base64
    from inspect import signature

    v = lattice_lm.pieces(lattice_lm.default_vocabulary())
    with open(lattice_lm.default_vocabulary(), "rb") as f:
        usable = {p for p in (base64.b64decode(line.split()[0]) for line in f) if len(p) == 1 or p == p.lower() and not any(c in b" \t\n\x0b\x0c\r" for c in p[1:])}
    assert v.n == len(usable) and v.longest == lattice_lm.LONGEST == max(map(len, usable)) and signature(lattice_lm.score_texts).parameters["rounds"].default == 4
    rng = np.random.default_rng(3)
    log_p = np.append(np.log(rng.random(v.n) / v.n), lattice_lm.LOW)
    number = {p: int(v.lattice(np.frombuffer(p, np.uint8).reshape(1, -1))[0, -1, -1]) for p in usable}
    assert sorted(number.values()) == list(range(v.n))
    words = ["relationship", "institutions", "возможность", "использовать", "ありがとうございました", "ありがとうございますありがとうございました", "a"]
    words = [w.encode() for w in words] + [p.strip(b" ") for p in sorted(usable, key=len)[-40:]]

    def sums(w):
        total = [1.0] + [0.0] * len(w)
        for e in range(1, len(w) + 1):
            total[e] = sum(total[b] * math.exp(log_p[number[w[b:e]]]) for b in range(e) if w[b:e] in number)
        return total

    assert np.allclose(lattice_lm.word_scores(words, v, log_p), [math.log(sums(b" " + w)[-1]) for w in words])
    counts, want = lattice_lm.expected_counts(words, np.arange(1.0, len(words) + 1), v, log_p), np.zeros(v.n)
    for k, w in enumerate(b" " + w for w in words):
        ahead = sums(w)
        back = [0.0] * len(w) + [1.0]
        for b in range(len(w) - 1, -1, -1):
            back[b] = sum(back[e] * math.exp(log_p[number[w[b:e]]]) for e in range(b + 1, len(w) + 1) if w[b:e] in number)
            for e in range(b + 1, len(w) + 1):
                if w[b:e] in number:
                    want[number[w[b:e]]] += (k + 1) * ahead[b] * math.exp(log_p[number[w[b:e]]]) * back[e] / ahead[-1]
    assert np.allclose(counts, want)


def test_classifier(spark, docs, none):
    rows = [(i, prose(60, i) if i % 3 else " ".join([VOCABULARY[i % 50]] * 50), "en", "s", 0) for i in range(600)]
    d = spark.createDataFrame(rows, KINDS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_classifier.classify(d, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 600 and sum(r["predicted"] == (r["doc_id"] % 3 > 0) for r in held) > 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.classify(docs, labels).count() == docs.count() and quality_classifier.classify(none, labels).count() == 0
    assert {r["score"] for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_jump(spark):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * sharding.MULTIPLIER + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    ids = spark.range(2000).withColumn("s", sharding.key_hash(F.col("id")))
    for n in (1, 2, 24, 25):
        assert all(r["j"] == jump(int(r["s"]), n) for r in ids.withColumn("j", sharding.jump(F.col("s"), n)).collect())


def test_sharding(docs, none, tmp_path):
    got = sharding.assign(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows_of(docs))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sharding.assign(none).count() == 0
    sharding.write_shards(docs, str(tmp_path / "s"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "s")).count() == docs.count()


def test_sharding_and_chat_queries(spark, data, duck, same_rows):
    same_rows(sharding.op7_sharding(spark, data).select("doc_id", "shard", "grown_shard").toPandas(), duck.sql(sharding.SHARD_SQL).df())
    for name, sql in registry.ORACLE_SQL.items():
        same_rows(registry.QUERIES[name](spark, data).toPandas(), duck.sql(sql).df())


def fold(events):
    out, kinds = {}, ["delta", "edit", "regenerate"]
    for c, s, t, op, role, text in sorted(set(events), key=lambda e: (e[1], kinds.index(e[3]), e[4] or "", e[5] or "")):
        turns = out.setdefault(c, {})
        if op == "regenerate":
            for u in [u for u in turns if u > t]:
                del turns[u]
        if op != "delta" or t not in turns:
            turns[t] = [turns.get(t, [None])[0] if op == "edit" else None, ""]
        turns[t][0] = turns[t][0] or role
        turns[t][1] += text or ""
    return {(c, t, role or "", text) for c, turns in out.items() for t, (role, text) in turns.items()}


def test_the_log_ends_in_its_messages(spark):
    """Several events a message, replaced and repeated ones among them; two rows of a turn stay two messages; nulls are empty."""
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t} </s> & <|x|>") for t in range(30)] + [(2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", None), (2, 1, None, "b"), (None, 0, "user", "")]
    log = chat_format.as_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    events = log.collect()
    assert {e["op"] for e in events} == {"delta", "edit", "regenerate"} and len(events) > 2 * len(rows) and len(set(events)) < len(events)
    shuffled = log.orderBy(F.xxhash64("seq", "text"))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.read_back(chat_format.render(chat_format.fold_events(shuffled))).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert got == want


def test_chat_events(spark):
    r, events = random.Random(8), []
    for c in range(12):
        for s in range(r.randint(1, 40)):
            t = r.randint(0, 90 if c == 3 else 6)
            events.append((c, s, t, r.choices(["delta", "edit", "regenerate"], [6, 1, 1])[0], "assistant" if t % 2 else "user", r.choice(["a", "</s>", "<|x|>", "&lt;", "", "[INST]"])))
    kinds = "conv_id long, seq long, turn long, op string, role string, text string"
    df = spark.createDataFrame(events + events[:20], kinds).withColumn("block", F.lit(1))
    messages = chat_format.fold_events(df)
    want = fold(events)
    assert {(x["conv_id"], x["turn"], x["role"], x["text"]) for x in messages.collect()} == want
    for x in chat_format.read_back(chat_format.render(messages)).collect():
        own = sorted((m[1:] for m in want if m[0] == x["conv_id"]))
        assert [(t["role"], t["text"]) for t in x["turns"]] == [(b, c) for _, b, c in own]
        assert x["loss_text"] == "".join(c for _, b, c in own if b == "assistant") and "[INST]" not in x["formatted"]
    odd = spark.createDataFrame([(None, None, None, None, None, None), (1, 0, 0, "delta", None, None)], kinds)
    assert {(x["conv_id"], x["role"], x["text"]) for x in chat_format.fold_events(odd).collect()} == {(None, "", ""), (1, "", "")}
    assert chat_format.render(chat_format.fold_events(df.limit(0))).count() == 0
