"""Pipelines of stages, features by name, and modules that extend the library."""

from __future__ import annotations

import sys
import types

import pytest
from pyspark.sql import functions as F

from lexweave.plans import stages
from lexweave.plans.stages import Pipeline, Stage


def test_stages_are_placed_run_saved_and_taken_up_again(spark, tmp_path):
    def times(n):
        return lambda df: df.withColumn("x", F.col("x") * n)

    p = Pipeline().add("two", times(2), saved=True).add("five", times(5)).after("two", Stage("plus", lambda df: df.withColumn("x", F.col("x") + 1)))
    rows = spark.createDataFrame([(1,), (2,)], "x int")
    assert sorted(r.x for r in p.run(rows, str(tmp_path)).collect()) == [15, 25]
    assert sorted(r.x for r in p.run(None, str(tmp_path), after="two", spark=spark).collect()) == [15, 25]
    assert sorted(r.x for r in p.run(rows, last="plus").collect()) == [3, 5]
    assert [s.name for s in p.moved("five", before="two").without("plus").stages] == ["five", "two"]
    assert sorted(r.x for r in p.replaced("plus", lambda df: df).run(rows).collect()) == [10, 20]
    for wrong in (lambda: p.add("two", times(1)), lambda: p.without("none"), lambda: p.before("none", Stage("x", times(1)))):
        with pytest.raises(ValueError):
            wrong()


def test_features_and_modules(spark):
    rows = stages.features(spark.createDataFrame([("Paris",), ("a1",), (None,)], "w string"), "w", ["word", "suffix3", "shape"])
    assert [r.features for r in rows.collect()] == [["word=paris", "suffix3=ris", "shape=initCap"], ["word=a1", "suffix3=a1", "shape=containsDigitAndAlpha"], ["shape=other"]]
    module = types.ModuleType("own_module")
    module.register = lambda r: r.features.update(first=lambda w: F.substring(w, 1, 1))
    sys.modules["own_module"] = module
    stages.load_module("own_module")
    assert stages.features(spark.createDataFrame([("xyz",)], "w string"), "w", ["first"]).first().features == ["first=x"]
    with pytest.raises(ValueError):
        stages.load_module("json")
