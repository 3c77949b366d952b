"""Adapters of language models: batches of texts go to a function of the caller; stubs serve tests."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import verdicts as J

Ask = Callable[[list[str]], str | None]


def judge(rows: DataFrame, ask: Ask, key: str = "id", text: str = "text", size: int = S.JUDGE_BATCH, chunks: int = 64) -> DataFrame:
    """key, region and scale of each text; null where the answer says nothing of it, or a batch has none.

    Texts are numbered in a hashed order inside hashed parts (a judge favours the first ones), asked in batches of `size` and given back to their keys.
    """
    part = F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("key", F.lit(1)), "key")) - 1
    head = F.translate(F.substring(text, 1, S.JUDGE_TEXT_CHARS), "\n", " ")
    rows = rows.select(F.col(key).alias("key"), head.alias("head"), part.alias("part")).withColumn("place", place)
    rows = rows.withColumn("batch", F.floor(F.col("place") / size)).withColumn("i", F.col("place") % size + 1)
    batches = rows.groupBy("part", "batch").agg(F.array_sort(F.collect_list(F.struct("i", "key", "head"))).alias("rows"))  # of `size` rows

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"keys": p["keys"], "answer": [ask(list(heads)) for heads in p["heads"]]})

    kind = dict(rows.dtypes)["key"]
    asked = batches.select(F.transform("rows", lambda r: r["key"]).alias("keys"), F.transform("rows", lambda r: r["head"]).alias("heads")).mapInPandas(run, f"keys array<{kind}>, answer string")
    verdicts = asked.withColumn("v", J.parse_judge(F.col("answer"), F.size("keys")))
    each = verdicts.select(F.posexplode("keys").alias("i", "key"), "v")
    return each.select(F.col("key").alias(key), F.get("v", F.col("i"))["region"].alias("region"), F.get("v", F.col("i"))["scale"].alias("scale"))


def stub_judge(texts: list[str]) -> str:
    """A judge by rule for tests: the region by the text's length, the grade by its words."""
    return json.dumps({str(i): {"r": S.REGIONS[len(t) % len(S.REGIONS)], "s": 1 + len(t.split()) % 5} for i, t in enumerate(texts, 1)})


def embed(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "text", size: int = S.VECTOR_SIZE) -> DataFrame:
    """rows with `embedding`; a text that the model fails on has the zero vector."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for start in range(0, len(texts), 16):
            some = ["passage: " + (t or "") for t in texts.iloc[start : start + 16]]
            try:
                out += model(some)
            except Exception:  # noqa: BLE001  one bad text must not lose its batch
                for t in some:
                    try:
                        out += model([t])
                    except Exception:  # noqa: BLE001
                        out.append([0.0] * size)
        return pd.Series(out, index=texts.index)

    return rows.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text)))


def hashing_embedder(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for a model: signed counts of hashed words."""
    import zlib

    def model(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * size
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % size] += 1.0 if h >> 31 else -1.0
            out.append(v)
        return out

    return model


def retell(stories: DataFrame, ask: Callable[[str, str], str | None], check: Callable[[str, str, str], str | None], tries: int = 3) -> DataFrame:
    """story, title, summary, reason of stories with (story, prompt): up to so many tries, each told why the last one failed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for story, prompt in zip(p["story"], p["prompt"]):
                reason, title, summary = "", None, None
                for _ in range(tries):
                    try:
                        answer = json.loads(ask(prompt, reason) or "{}")
                        title, summary = answer.get("title"), answer.get("summary")
                    except (ValueError, AttributeError):
                        title = summary = None
                    reason = check(title or "", summary or "", prompt) or ""
                    if not reason:
                        break
                rows.append((story, title, summary, reason))
            yield pd.DataFrame(rows, columns=["story", "title", "summary", "reason"])

    return stories.select("story", "prompt").mapInPandas(run, f"story {dict(stories.dtypes)['story']}, title string, summary string, reason string")


def apply_edits(items: DataFrame, answer: str | None, is_fine: Callable, n: int) -> DataFrame:
    """Items (idx, title, summary) after an editor's answer: items it leaves out are deleted, changed ones that is_fine (a column of title and summary) rejects keep their text; an unreadable answer changes nothing."""
    spark = items.sparkSession
    edits = spark.createDataFrame([(answer,)], "answer string").select(J.parse_edits(F.col("answer"), n).alias("m"))
    rows = edits.select(F.explode("m").alias("idx", "new")).filter("idx IS NOT NULL")
    if rows.isEmpty():
        return items
    met = items.join(F.broadcast(rows), "idx")  # an editor's twenty rows
    title, summary = F.coalesce("new.title", "title"), F.coalesce("new.summary", "summary")
    fine = is_fine(title, summary)
    return met.select("idx", F.when(fine, title).otherwise(F.col("title")).alias("title"), F.when(fine, summary).otherwise(F.col("summary")).alias("summary"))


def ablated(prompt: str, arms: dict[str, list[str]]) -> dict[str, str]:
    """The prompt of each arm, without the arm's fragments; a fragment that the prompt does not hold is an error, since two arms would be the same."""
    out = {}
    for arm, fragments in arms.items():
        text = prompt
        for fragment in fragments:
            before, found, after = text.partition(fragment)
            if not found:
                raise ValueError(f"{arm}: the prompt does not hold {fragment[:60]!r}")
            text = before + after.replace(fragment, "")
        out[arm] = text
    return out
