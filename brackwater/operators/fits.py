"""Fit and predict: constants, boosting, black boxes, and the run that ties gate, fit, metrics and ledger together."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.operators.splits import require
from brackwater.sources.sinks import Guard, Ledger, write_csv


def boosted(train: DataFrame, test: DataFrame, features: list[str], target: str, rounds: int = 20, depth: int = 4, seed: int = 0) -> DataFrame:
    """Predictions of gradient-boosted trees (depth-wise, binned features): test rows with `prediction`."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    pack = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
    model = GBTRegressor(featuresCol="_x", labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed).fit(pack.transform(train))
    return model.transform(pack.transform(test)).drop("_x")


MODEL_BYTES = 64 << 20


def predict(rows: DataFrame, model: object, call: Callable[[object, pd.DataFrame], pd.Series], features: list[str], most_bytes: int = MODEL_BYTES) -> DataFrame:
    """Any fitted model over Arrow batches; the model is broadcast once, and refused if its pickle is larger than allowed."""
    size = len(cloudpickle.dumps(model))
    if size > most_bytes:
        raise ValueError(f"a model of {size} bytes is not broadcast; {most_bytes} are allowed")
    held = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for pdf in batches:
            yield pdf.assign(prediction=call(held.value, pdf[features]).astype("float64"))

    return rows.mapInPandas(work, rows.withColumn("prediction", F.lit(0.0)).schema)


def selection(scores: DataFrame, keys: list[str], config: str, score: str) -> DataFrame:
    """Lowest score of each key; of equal ones the first configuration."""
    return scores.groupBy(*keys).agg(F.min_by(config, F.struct(F.round(score, 9), config)).alias(config))


def sources_only(fitted_on: set[str], sources: set[str], held_out: str) -> list[str]:
    """What speaks against a fit: subjects outside its sources, or the held-out subject among them."""
    out = [f"fitted on {s}, which is no source" for s in sorted(fitted_on - sources)]
    return out + ([f"the held-out subject {held_out} is among the sources"] if held_out in sources | fitted_on else [])


def features_allowed(names: list[str], allowed: set[str], forbidden: tuple[str, ...]) -> list[str]:
    return [n for n in names if n not in allowed or any(t in n for t in forbidden)]


def run(ledger: Ledger, guard: Guard, name: str, settings: dict, gate: DataFrame, work: Callable[[], DataFrame], path: str) -> str:
    """One run: the gate must pass before any fit, the result table is written with its digest, and a failure is kept.

    A run that is complete and intact is not repeated.
    """
    if ledger.status(name) == "complete":
        return "kept"
    ledger.begin(name, settings)
    try:
        require(gate)
        result = work()
        write_csv(result, path, guard, result.columns)
    except Exception as e:
        ledger.fail(name, str(e))
        raise
    ledger.complete(name, [path])
    return "complete"


def release(tables: dict[str, DataFrame], folder: str, guard: Guard, checks: DataFrame) -> dict[str, str]:
    """Write small result tables with a manifest of digests, once all checks are empty."""
    from brackwater.sources.sinks import write_json

    require(checks)
    manifest = {n: write_csv(df, f"{folder}/{n}.csv", guard, df.columns) for n, df in sorted(tables.items())}
    write_json(f"{folder}/manifest.json", manifest, guard)
    return manifest


def traceable(printed: dict[str, float], cells: dict[str, float], digits: int = 2) -> list[str]:
    """Printed numbers that no declared cell gives at the printed precision."""
    known = {round(v, digits) for v in cells.values()}
    return [k for k, v in printed.items() if round(v, digits) not in known]
