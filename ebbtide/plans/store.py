"""Fitted jobs on shared storage: models in Spark ML's own format, and beside them one JSON line with all else they need.

Loading gives objects that score as those saved did. Paths are URIs that Spark reads and writes; a folder that exists is not
written over.
"""

from __future__ import annotations

import importlib
import json

from pyspark.sql import SparkSession

from ebbtide.operators.isotonic import Curves
from ebbtide.plans.calibration import Calibrator, SegmentCalibrator, SegmentCurves
from ebbtide.plans.newton import NewtonModel
from ebbtide.plans.oof import Learner, OofResult, TwoStage


NEWTON = "newton"


def _write_note(spark: SparkSession, path: str, note: dict) -> None:
    spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.text(f"{path}/note")


def _read_note(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/note").first().value)


def _save_model(model, path: str) -> str:
    """Save and return the name of the class that reads it."""
    if isinstance(model, NewtonModel):
        spark = SparkSession.active()
        model.table(spark).coalesce(1).write.parquet(f"{path}/trees")
        _write_note(spark, path, {"base": model.base, "n_features": model.n_features, "history": model.history})
        return NEWTON
    model.write().save(path)
    return f"{type(model).__module__}.{type(model).__name__}"


def _load_model(kind: str, path: str):
    if kind == NEWTON:
        spark = SparkSession.active()
        note = _read_note(spark, path)
        return NewtonModel.of(note["base"], note["n_features"], spark.read.parquet(f"{path}/trees"), note["history"])
    module, _, name = kind.rpartition(".")
    if not module.startswith("pyspark.ml."):
        raise ValueError(f"{kind} is not a Spark ML model")
    return getattr(importlib.import_module(module), name).load(path)


def save_result(result: OofResult, path: str) -> None:
    """An out-of-fold result: its scores, every (fold, seed) model, the feature list in order, the learner."""
    models = [{"fold": f, "seed": s, "kind": _save_model(m, f"{path}/models/{i}")} for i, (f, s, m) in enumerate(result.models)]
    result.oof.write.parquet(f"{path}/oof")
    learner = {"kind": result.learner.kind, "params": result.learner.params, "early_stop": result.learner.early_stop}
    _write_note(result.oof.sparkSession, path, {"features": result.features, "learner": learner, "models": models})


def load_result(spark: SparkSession, path: str) -> OofResult:
    note = _read_note(spark, path)
    models = [(m["fold"], m["seed"], _load_model(m["kind"], f"{path}/models/{i}")) for i, m in enumerate(note["models"])]
    return OofResult(spark.read.parquet(f"{path}/oof"), models, note["features"], Learner(**note["learner"]))


def save_two_stage(two: TwoStage, path: str) -> None:
    save_result(two.stage_a, f"{path}/stage_a")
    save_result(two.stage_b, f"{path}/stage_b")


def load_two_stage(spark: SparkSession, path: str) -> TwoStage:
    return TwoStage(load_result(spark, f"{path}/stage_a"), load_result(spark, f"{path}/stage_b"))


def save_calibrator(spark: SparkSession, calibrator: Calibrator, path: str) -> None:
    kind = _save_model(calibrator.model, f"{path}/model")
    _write_note(spark, path, {"method": calibrator.method, "kind": kind})


def load_calibrator(spark: SparkSession, path: str) -> Calibrator:
    note = _read_note(spark, path)
    return Calibrator(note["method"], _load_model(note["kind"], f"{path}/model"))


def save_segments(spark: SparkSession, calibrator: SegmentCalibrator | SegmentCurves, path: str) -> None:
    if isinstance(calibrator, SegmentCurves):
        calibrator.curves.table(spark).write.parquet(f"{path}/curves")
        _write_note(spark, path, {"curves": True})
        return
    save_calibrator(spark, calibrator.whole, f"{path}/whole")
    for s, c in calibrator.own.items():
        save_calibrator(spark, c, f"{path}/segment_{s}")
    _write_note(spark, path, {"segments": sorted(calibrator.own)})


def load_segments(spark: SparkSession, path: str) -> SegmentCalibrator | SegmentCurves:
    note = _read_note(spark, path)
    if note.get("curves"):
        return SegmentCurves(Curves.of(spark.read.parquet(f"{path}/curves")))
    own = {s: load_calibrator(spark, f"{path}/segment_{s}") for s in note["segments"]}
    return SegmentCalibrator(load_calibrator(spark, f"{path}/whole"), own)
