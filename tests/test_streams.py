import shutil

import pytest
from pyspark.sql import functions as F

from newsloom.sources import dumps
from newsloom.streaming import journal_stream


def test_journal_stream(spark, tmp_path):
    source, kinds = str(tmp_path / "in"), "url string, query_index int, ts timestamp"
    row = lambda url, day: (url, 1, __import__("datetime").datetime(2026, 8, day))
    decide = lambda df: df.select("url", "query_index", F.when(F.col("url") == "p", "pending").otherwise("accepted").alias("verdict"), F.lit(None).cast("array<float>").alias("embedding"))
    for rows in ([row("a", 1), row("p", 1)], [row("a", 2), row("b", 2)]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(source)
        journal_stream.collect(spark.readStream.schema(kinds).parquet(source), str(tmp_path / "out"), str(tmp_path / "cp"), decide).awaitTermination()
    got = {r["url"]: (r["verdict"], r["attempts"]) for r in spark.read.parquet(str(tmp_path / "out" / "v=1")).collect()}
    assert got == {"a": ("accepted", 1), "p": ("pending", 2), "b": ("accepted", 1)}
    # a new checkpoint goes on from the last version
    journal_stream.collect(spark.readStream.schema(kinds).parquet(source), str(tmp_path / "out"), str(tmp_path / "cp2"), decide, keep_days=400).awaitTermination()
    got = {r["url"]: (r["verdict"], r["attempts"]) for r in spark.read.parquet(str(tmp_path / "out" / "v=2")).collect()}
    assert got["a"] == ("accepted", 1) and got["p"] == ("pending", 3)
    # state ends: what was last seen too long ago goes
    spark.createDataFrame([row("z", 28)], kinds).coalesce(1).write.mode("append").parquet(source)
    journal_stream.collect(spark.readStream.schema(kinds).parquet(source), str(tmp_path / "out"), str(tmp_path / "cp2"), decide, keep_days=3).awaitTermination()
    assert {r["url"] for r in spark.read.parquet(str(tmp_path / "out" / "v=3")).collect()} == {"p", "z"}  # p is pending and was tried again
    # a lost version is not taken for a first start
    shutil.rmtree(tmp_path / "out" / "v=3")
    spark.createDataFrame([row("y", 28)], kinds).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="missing"):
        journal_stream.collect(spark.readStream.schema(kinds).parquet(source), str(tmp_path / "out"), str(tmp_path / "cp2"), decide).awaitTermination()


def test_once_per_key(spark, tmp_path):
    source, kinds = str(tmp_path / "in"), "url string, ts timestamp"
    at = __import__("datetime").datetime(2026, 8, 1)
    spark.createDataFrame([("a", at), ("a", at), ("b", at)], kinds).write.parquet(source)
    run = journal_stream.once_per_key(spark.readStream.schema(kinds).parquet(source)).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("once").count() == 2


def test_dumps(spark, tmp_path):
    import zipfile

    line = "\t".join(f"c{i}" if i != 4 else "http://a" for i in range(dumps.WIDTH))
    with zipfile.ZipFile(tmp_path / "20260801000000.translation.gkg.csv.zip", "w") as z:
        z.writestr("x.csv", line + "\n" + line + "\ttoo\tmany\n")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    (tmp_path / "short").mkdir()
    text = line + "\n" + "\t".join(line.split("\t")[:9]) + "\r\n" + line + "\tmore\n" + line.replace("c8", "") + "\n"
    (tmp_path / "short" / "20260801001500.gkg.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "short" / "20260801001500.gkg.csv.zip", "w") as z:
        z.writestr("x.csv", text)
    plain, zipped = dumps.read_text(spark, str(tmp_path / "short" / "*.csv")).collect(), dumps.read_zipped(spark, str(tmp_path / "short" / "*.zip")).collect()
    assert sorted(plain, key=str) == sorted(zipped, key=str) and len(plain) == 3
    assert {(r["v2t"], r["v1o"]) for r in plain} == {("c8", "c13"), ("c8", None), (None, "c13")} and {r["tick"] for r in plain} == {"20260801001500"}
    rows = dumps.read_zipped(spark, str(tmp_path / "*.zip")).collect()
    assert [(r["url"], r["v2t"], r["tick"], r["stream"]) for r in rows] == [("http://a", "c8", "20260801000000", "translation")]
