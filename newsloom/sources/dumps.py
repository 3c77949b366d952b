"""Event dumps: quarter-hour ticks, tab-separated files (also zipped), and their union over streams."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The dump's columns by position, and the two streams' file names.
COLUMNS = {1: "date", 3: "source", 4: "url", 7: "v1t", 8: "v2t", 9: "v1l", 10: "v2l", 11: "v1p", 13: "v1o"}
WIDTH = 27
STREAMS = {"": "{tick}.gkg.csv.zip", "translation": "{tick}.translation.gkg.csv.zip"}
#: Files are handed to Python in batches of about so many bytes.
ZIPPED_BYTES = 16 << 20
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS.values())


def ticks(spark: SparkSession, now: Column, hours: int = 24) -> DataFrame:
    """Ticks up to now, floored to a quarter of an hour, the newest first: tick (yyyyMMddHHmmss) and at."""
    floor = F.timestamp_seconds((F.unix_timestamp(now) / 900).cast("long") * 900)
    every = F.sequence(floor - F.make_dt_interval(hours=F.lit(hours)) + F.expr("INTERVAL 15 MINUTES"), floor, F.expr("INTERVAL 15 MINUTES"))
    return spark.range(1).select(F.explode(every).alias("at")).select(F.date_format("at", "yyyyMMddHHmmss").alias("tick"), "at").orderBy(F.desc("at"))


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Unpacked dumps; lines with too many fields are dropped, missing and empty ones are null. `tick` and `stream` come from the file's name."""
    lines = spark.read.text(path).select(F.split(F.regexp_replace("value", r"\r$", ""), "\t", -1).alias("c"), F.input_file_name().alias("file"))
    cell = lambda i: F.nullif(F.get("c", F.lit(i)), F.lit(""))
    return _named(lines.filter(F.size("c") <= WIDTH).select(*(cell(i).alias(n) for i, n in COLUMNS.items()), "file"))


def read_zipped(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Zipped dumps, a file at a time (batches of files are bounded by bytes, which lowers the session's limit); unreadable files and lines with too many fields give no rows, missing and empty fields are null."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(limit).rstrip("bB")
    if not now.isdigit() or int(now) > ZIPPED_BYTES:
        spark.conf.set(limit, str(ZIPPED_BYTES))

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["path"], part["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
                        while lines := list(itertools.islice(f, 20_000)):
                            rows = [line.decode("utf-8", "replace").rstrip("\r\n").split("\t") for line in lines]
                            rows = [[*(r[i] or None if i < len(r) else None for i in COLUMNS), file] for r in rows if len(r) <= WIDTH]
                            yield pd.DataFrame(rows, columns=[*COLUMNS.values(), "file"], dtype=object)
                except (zipfile.BadZipFile, IndexError):
                    continue

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _named(files.mapInPandas(unpack, f"{SCHEMA}, file string"))


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tick", F.regexp_extract("file", r"(\d{14})[^/]*$", 1)).withColumn("stream", F.when(F.col("file").contains("translation"), "translation").otherwise("")).drop("file")


def first_per_url(rows: DataFrame) -> DataFrame:
    """One row a URL: of the newest tick, the plain stream before the translated one."""
    order = Window.partitionBy("url").orderBy(F.desc("tick"), "stream", "date")
    return rows.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
