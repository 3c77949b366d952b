"""Issue archives: documents of numbered items, label files, logs, snapshots, and what is written back."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D


def parse_items(lines: DataFrame, issue: str = "issue", pos: str = "pos", line: str = "line") -> DataFrame:
    """Items of issues given line by line: a header `N. dd.mm.yyyy — title`, the first other line as summary, and a line of addresses."""
    t = F.trim(line)
    head = t.rlike(r"^\d+\.\s+\d{2}\.\d{2}\.\d{4}\s+—\s+.+$")
    w = Window.partitionBy(issue).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select(issue, pos, t.alias("t"), head.alias("head")).withColumn("item", F.sum(F.col("head").cast("int")).over(w)).filter("item > 0 AND t <> ''")
    kind = F.when(F.col("head"), "head").when(F.col("t").startswith("URL:"), "urls").otherwise("text")
    rows = rows.withColumn("kind", kind)
    first = lambda k: F.min_by("t", F.when(F.col("kind") == k, F.col(pos)))
    urls = F.filter(F.transform(F.split(F.substring(first("urls"), 5, 1_000_000), ";"), lambda u: F.trim(u)), lambda u: u != "")
    items = rows.groupBy(issue, "item").agg(first("head").alias("h"), F.coalesce(first("text"), F.lit("")).alias("summary"), F.coalesce(urls, F.array().cast("array<string>")).alias("urls"))
    part = lambda k: F.regexp_extract("h", r"^(\d+)\.\s+(\d{2}\.\d{2}\.\d{4})\s+—\s+(.+)$", k)
    return items.select(issue, part(1).cast("int").alias("number"), part(2).alias("date"), part(3).alias("title"), "summary", "urls")


def read_docx(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """issue (the file), pos and line of each paragraph of .docx files; unreadable files give none."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file, content in ((f, c) for part in parts for f, c in zip(part["path"], part["content"])):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    body = ElementTree.fromstring(z.read("word/document.xml"))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                continue
            said = {f"{word}t": lambda x: x.text or "", f"{word}tab": lambda _: "\t", f"{word}br": lambda _: "\n"}
            lines = ["".join(said[x.tag](x) for x in p.iter() if x.tag in said) for p in body.iter(f"{word}p")]
            yield pd.DataFrame({"issue": file, "pos": range(len(lines)), "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "issue string, pos int, line string")


def latest_files(names: DataFrame, name: str = "name", prefix: str = "issue", suffix: str = ".docx") -> DataFrame:
    """date and name of the last file of each date: <prefix>_<date><suffix>, or the one with the largest -n."""
    pattern = rf"^{re.escape(prefix)}_(\d{{4}}-\d{{2}}-\d{{2}})(?:-(\d+))?{re.escape(suffix)}$"
    rank = F.coalesce(F.regexp_extract(name, pattern, 2).try_cast("int"), F.lit(0))
    return names.filter(F.col(name).rlike(pattern)).groupBy(F.regexp_extract(name, pattern, 1).alias("date")).agg(F.max_by(name, rank).alias("name"))


def to_embed(items: DataFrame, cache: DataFrame, stamp: str = "stamp") -> DataFrame:
    """Items of files whose stamp the cache does not have."""
    return items.join(cache.select(stamp).distinct(), stamp, "left_anti")


def refresh(cache: DataFrame, current: DataFrame, new: DataFrame, stamp: str = "stamp") -> DataFrame:
    """The cache without files that are gone, and with the new ones."""
    return cache.join(current.select(stamp).distinct(), stamp, "left_semi").unionByName(new)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """url, grade, bucket, head of a tab-separated file; lines without a number for a grade are comments."""
    rows = spark.read.csv(path, sep="\t", schema="url string, grade string, bucket string, head string", quote="")
    return rows.filter(F.col("grade").rlike(r"^\d+$")).withColumn("grade", F.col("grade").cast("int"))


def log_urls(lines: DataFrame, pattern: str, known: DataFrame, line: str = "value") -> DataFrame:
    """Distinct URLs of log lines that are not known."""
    return lines.select(F.regexp_extract(line, pattern, 1).alias("url")).filter("url <> ''").distinct().join(known.select("url"), "url", "left_anti")


def item_lines(items: DataFrame, number: Column, date: Column, title: Column, summary: Column, urls: Column) -> DataFrame:
    """number and text of each item as it is written: header, summary, and all addresses in one line."""
    head = F.concat(number.cast("string"), F.lit(". "), D.display(date), F.lit(" — "), title)
    return items.select(number.alias("number"), F.concat_ws("\n", head, summary, F.concat(F.lit("URL: "), F.array_join(urls, "; "))).alias("text"))


def free_name(taken: list[str], date: str, prefix: str = "issue") -> str:
    """A file name for the date that is not taken."""
    name, n = f"{prefix}_{date}.txt", 1
    while name in taken:
        n += 1
        name = f"{prefix}_{date}-{n}.txt"
    return name


def write_issue(lines: DataFrame, path: str) -> None:
    """The items in order, as one text file (an issue has some twenty items)."""
    lines.orderBy("number").select("text").coalesce(1).write.text(path)


def write_labels(rows: DataFrame, path: str) -> None:
    rows.select("url", "grade", "bucket", "head").write.csv(path, sep="\t", quote="")


def snapshot(rows: DataFrame, path: str) -> DataFrame:
    """Freezes rows for an evaluation: no grade is -1, no bucket is MIX."""
    frozen = rows.withColumns({c: v for c, v in {"scale": F.coalesce(F.col("scale"), F.lit(-1)).cast("tinyint"), "bucket": F.coalesce(F.col("bucket"), F.lit("MIX"))}.items() if c in rows.columns})
    frozen.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)
