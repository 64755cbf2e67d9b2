import pandas as pd
import pytest
from pyspark.sql import functions as F

from brackwater.operators import compare, fits, splits, stats
from brackwater.sources.sinks import Guard, Ledger


def test_ridge_is_the_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "y": y}))
    z = lambda a: (a - a.mean(0)) / a.std(0)
    want = np.linalg.solve(z(x).T @ z(x) + 5 * np.eye(3), z(x).T @ z(y))
    assert np.allclose(stats.ridge(df, ["k"], ["x0", "x1", "x2"], "y", 5.0).first()["weights"], want, atol=1e-8)


def test_boosting_and_black_box(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("x")).withColumn("y", F.col("x") * 2)
    e = fits.boosted(df, df, ["x"], "y", rounds=5).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert e < 0.5
    assert fits.predict(df, 3.0, lambda m, p: p["x"] * m, ["x"]).where("prediction <> x * 3").count() == 0


def test_run_and_release(spark, tmp_path):
    guard, ledger = Guard([]), Ledger(str(tmp_path / "runs"))
    good = splits.gate({"none": lambda: spark.range(0)})
    bad = splits.gate({"some": lambda: spark.range(2)})
    work = lambda: spark.createDataFrame([(1, 2.5)], "a int, b double")
    with pytest.raises(ValueError, match="some: 2"):
        fits.run(ledger, guard, "r", {}, bad, work, str(tmp_path / "r.csv"))
    assert ledger.status("r") == "failed"
    assert fits.run(ledger, guard, "r", {}, good, work, str(tmp_path / "r.csv")) == "complete" and fits.run(ledger, guard, "r", {}, good, work, str(tmp_path / "r.csv")) == "kept"
    assert set(fits.release({"t": work()}, str(tmp_path), guard, good)) == {"t"}
    assert fits.sources_only({"a", "b"}, {"a"}, "b") and not fits.sources_only({"a"}, {"a"}, "b")
    assert fits.features_allowed(["p1", "p1_target"], {"p1"}, ("target",)) == ["p1_target"] and fits.traceable({"x": 1.234, "y": 9.0}, {"c": 1.2301}) == ["y"]
    assert compare.one_cell(work(), F.col("a") == 1, "b") == 2.5
    with pytest.raises(ValueError, match="no rows"):
        compare.one_cell(work(), F.col("a") == 5, "b")
