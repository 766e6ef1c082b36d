import datetime as dt

import pyarrow as pa

from lamina.streaming import incremental as I


def test_new_files_are_adapted_once(spark, tmp_path):
    folder, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    source = pa.schema([("id", pa.int64()), ("p", pa.struct([("a", pa.int32())]))])
    target = pa.schema([("id", pa.int64()), ("p", pa.struct([("a", pa.float64()), ("b", pa.string())]))])
    for k in range(2):
        spark.createDataFrame([(k, (k,))], "id long, p struct<a:int>").write.mode("append").parquet(folder)
        I.append_adapted(I.read_folder(spark, folder, source), target, out, check).awaitTermination()
    rows = I.read_appended(spark, out).orderBy("id").collect()
    assert [(r["id"], tuple(r["p"])) for r in rows] == [(0, (0.0, None)), (1, (1.0, None))]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "in")
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(t, "a"), (t + dt.timedelta(minutes=5), "a"), (t + dt.timedelta(days=5), "b")], "t timestamp, k string").write.parquet(folder)
    counts = I.windowed_counts(spark.readStream.schema("t timestamp, k string").parquet(folder), "t", "k")
    query = counts.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["k"], r["n"]) for r in spark.sql("SELECT * FROM w").collect()] == [("a", 2)]
