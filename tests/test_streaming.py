import shutil

import pytest
from pyspark.sql import functions as F

from brackwater.operators import sessions as batch
from brackwater.shared import DAY_US, epoch_us, table
from brackwater.streaming import live


@pytest.fixture
def stream(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/sensor_rows.parquet", tmp_path / "in" / "part.parquet")
    return live.read(spark, str(tmp_path / "in"), table(spark, sf, "sensor_rows").schema)


def test_stream_like_batch(spark, sf, tmp_path, stream):
    rows = table(spark, sf, "sensor_rows")
    live.write(live.flagged(stream), str(tmp_path / "flags"), str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "flags")).count() == rows.count()
    live.write(live.sessions(stream, late="3650 days"), str(tmp_path / "s"), str(tmp_path / "c2"), "append").awaitTermination(120)
    q = live.sessions(stream).writeStream.format("memory").queryName("sessions_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("select subject_id, device_id, start_s, end_s from sessions_out").collect()}
    dated = rows.where("ts is not null").select("subject_id", "device_id", epoch_us(F.col("ts")).alias("s"))
    want = {(r[0], r[1], r[2] // 1_000_000, r[3] // 1_000_000) for r in batch.sessions(dated, ["subject_id", "device_id"], "s", 1_800_000_000, DAY_US).collect()}
    assert got == want


def test_bins_and_copies(spark, stream):
    q = live.binned(live.without_copies(stream, "3650 days"), 60).writeStream.format("memory").queryName("bins_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select * from bins_out").columns == ["subject_id", "device_id", "bin_start_s", "n_rows", "temp", "humid"]
