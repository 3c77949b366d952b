"""Structured Streaming over the collection: late ticks, one row a URL, the journal as state, and windows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators import journal as Journal


def once_per_key(stream: DataFrame, key: str = "url", time: str = "ts", late: str = "24 hours") -> DataFrame:
    """The first row of each key, within the watermark: ticks that come late are taken, and state is bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def ticks(stream: DataFrame, time: str = "ts", late: str = "24 hours") -> DataFrame:
    """Rows of each quarter of an hour."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "15 minutes")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("tick"), "n")


def weeks(stream: DataFrame, time: str = "ts", late: str = "24 hours") -> DataFrame:
    """Rows of the seven days that end on each day."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "7 days", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("since"), "n")


def daily_counts(stream: DataFrame, key: str, time: str = "ts", late: str = "24 hours") -> DataFrame:
    """Counters that begin anew on each UTC day."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day"), key).agg(F.count("*").alias("n")).select(F.col("window.start").cast("date").alias("day"), key, "n")


def complete(stream: DataFrame, path: str) -> DataFrame:
    """The whole result of an aggregated stream over all that is there, as a table under path; nothing is gathered on the driver."""

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/result")

    spark = stream.sparkSession
    stream.writeStream.foreachBatch(batch).outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/result")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the journal's versions under path that were written to the end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath() for x in fs.listStatus(at)] if fs.exists(at) else []
    done = [p.getName() for p in names if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def collect(stream: DataFrame, path: str, checkpoint: str, decide: Callable[[DataFrame], DataFrame], today: str | None = None, keep_days: int | None = None) -> StreamingQuery:
    """Upserts each micro-batch into the journal under path: one version a batch (path/v=<n>), so that a repeated batch writes the same again.

    Of a batch, URLs that are decided are left out, pending ones come again; decide gives (url, query_index, verdict, embedding).
    A new checkpoint goes on from the last version there is: the first version's number is kept under the checkpoint's own id
    (path/_first/id=<id>). A version that should be there and is not ends the query. With keep_days, URLs last seen longer before a batch's day are dropped.
    """

    def first(spark: SparkSession) -> int:
        own = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        known = f"{path}/_first/id={own}"
        try:
            return spark.read.schema("n int").parquet(known).first()[0]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        n = max(_versions(spark, path), default=-1) + 1
        spark.createDataFrame([(n,)], "n int").coalesce(1).write.parquet(known)
        return n

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        at = first(spark) + n
        if at and at - 1 not in _versions(spark, path):
            raise FileNotFoundError(f"{path}/v={at - 1}: the journal's last version is missing")
        journal = spark.read.schema(Journal.SCHEMA).parquet(f"{path}/v={at - 1}") if at else spark.createDataFrame([], Journal.SCHEMA)
        day = today or df.agg(F.max("ts").cast("date").cast("string")).first()[0] or ""
        todo = Journal.candidates(df.select("url", "query_index"), journal)
        marked = Journal.mark(journal, decide(todo), day)
        if keep_days is not None:
            marked = marked.filter(F.date_diff(F.lit(day).try_cast("date"), F.col("last_seen").try_cast("date")) <= keep_days)
        marked.write.mode("overwrite").parquet(f"{path}/v={at}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Tells a function the rows of each batch."""

    def __init__(self, tell: Callable[[str], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.tell("STAGE=started")

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.tell(f"ARTICLES={event.progress.numInputRows}")

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.tell("STAGE=ended")
