"""Percentiles through a sketch against numpy: heavy tails, ties, small, empty and null groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wheelwork.operators import statistics as S

AT = [0, 1, 25, 50, 75, 95, 99.9, 100]


@pytest.mark.parametrize("least", [10_000, 1_000])
def test_described(spark, least, monkeypatch):
    monkeypatch.setattr(S, "ACCURACY", least)
    rng = np.random.default_rng(1)
    groups = {"tail": np.r_[rng.random(30_000) * 0.02, [1e9] * 2], "ties": rng.integers(0, 4, 25_000).astype(float), "one": np.array([3.5]), "few": rng.normal(size=7), "equal": np.full(20_000, 2.0), None: rng.normal(size=15_000)}
    rows = [(g, float(x)) for g, values in groups.items() for x in values] + [("none", None), ("few", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {r["g"]: r for r in S.described(df, "x", AT, ["g"], std=F.stddev_pop("x")).collect()}
    assert set(got) == {*groups, "none"}
    for g, values in groups.items():
        assert got[g]["_c"] == pytest.approx(list(np.percentile(values, AT)), rel=1e-12, abs=1e-15)
        assert (got[g]["n"], got[g]["least"], got[g]["most"]) == (len(values), values.min(), values.max()) and got[g]["std"] == pytest.approx(values.std())
    assert got["none"]["n"] == 0 and got["none"]["_c"] is None
    whole = S.described(df, "x", AT).first()
    assert whole["_c"] == pytest.approx(list(np.percentile(np.concatenate(list(groups.values())), AT)))
    assert S.described(df.limit(0), "x", AT).first()["_c"] == [None] * len(AT)
    assert S.quartile(df.where("g = 'few'"), "x").where("quartile IS NULL").count() == 1
