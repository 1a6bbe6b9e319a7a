"""Histogram boosting against sums in SQL, brute force and known functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwatch.models import boosting

SPEC = dict(depth=1, share=1.0, rounds=1, rate=1.0, rows=1.0, least=1.0, l1=0.0, l2=0.0)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 2, (3000, 6)), 2)
    y = 5 * (x[:, 1] > 0.3) - 4 * (x[:, 4] > 1.0) * (x[:, 0] < 0) + 0.5 * x[:, 2] + rng.normal(0, 0.3, 3000)
    rows = [(i, [float(v) for v in x[i]], float(y[i]), float(1 + i % 3), i % 5 == 0) for i in range(3000)]
    return spark.createDataFrame(rows, "i int, x array<double>, y double, w double, held boolean").repartition(4).cache()


def fit(df, **spec):
    return boosting.fit(df, "x", "y", [boosting.Spec(range(6), **{**SPEC, **spec})], F.col("held"), F.col("w"))[0]


def test_one_round_equals_sums_in_sql(spark, table):
    """The first split has the largest gain of all that SQL finds on the same thresholds, its leaves are means."""
    model, _ = fit(table, l1=3.0, l2=10.0)
    tree = model.trees[0]
    table.filter("not held").createOrReplaceTempView("boosting_rows")
    base, = spark.sql("select sum(w * y) / sum(w) from boosting_rows").first()
    assert model.base == pytest.approx(base)
    edges = boosting.bin_edges(table.filter("not held"), "x", 6, 64)
    cuts = [(c, float(t)) for c, e in enumerate(edges) for t in e]
    spark.createDataFrame(cuts, "c int, t double").createOrReplaceTempView("boosting_cuts")
    best = spark.sql(f"""
        with g as (select x, w, w * ({base!r} - y) as g from boosting_rows),
        sums as (select c, t, sum(if(x[c] <= t, g, 0)) as gl, sum(if(x[c] <= t, w, 0)) as hl, sum(g) as gt, sum(w) as ht from g join boosting_cuts group by c, t)
        select *, pow(greatest(abs(gl) - 3, 0), 2) / (hl + 10) + pow(greatest(abs(gt - gl) - 3, 0), 2) / (ht - hl + 10)
                  - pow(greatest(abs(gt) - 3, 0), 2) / (ht + 10) as gain from sums where hl >= 1 and ht - hl >= 1 order by gain desc, c, t limit 1""").first()
    assert (tree.feature[0], tree.threshold[0]) == (best["c"], best["t"])
    leaf = lambda g, h: -np.sign(g) * max(abs(g) - 3, 0) / (h + 10)
    assert [tree.value[tree.left[0]], tree.value[tree.right[0]]] == pytest.approx(
        [leaf(best["gl"], best["hl"]), leaf(best["gt"] - best["gl"], best["ht"] - best["hl"])], abs=1e-6)


def test_many_trees_learn_and_stop(table):
    model, report = fit(table, depth=3, rounds=300, rate=0.1, patience=15, share=0.7, rows=0.8)
    assert len(model.trees) == report.best_round > 10 and report.rounds - report.best_round in (0, 15)
    assert report.validation_mae[report.best_round] == min(report.validation_mae) < 0.4 * report.validation_mae[0]
    rows = table.filter("held").select("y", "x", model.column(F.col("x")).alias("p")).collect()
    assert np.mean([abs(r["y"] - r["p"]) for r in rows]) == pytest.approx(report.validation_mae[report.best_round], rel=1e-9)
    assert np.argmax(model.importance) in (1, 4) and sum(model.importance) == pytest.approx(1)
    again = boosting.Boosted.from_json(model.as_json())
    x = np.array([r["x"] for r in rows])
    assert (again.predict(x) == model.predict(x)).all()
    one_by_one = [sum([model.base] + [walk(t, v) for t in model.trees]) for v in x[:50]]
    assert model.predict(x[:50]) == pytest.approx(one_by_one)


def walk(tree, x):
    node = 0
    while tree.feature[node] >= 0:
        node = tree.left[node] if x[tree.feature[node]] <= tree.threshold[node] else tree.right[node]
    return tree.value[node]


def test_models_grown_together_and_snapshots_change_nothing(table):
    specs = [boosting.Spec([1, 4], 2, 1.0, 12, 0.2, rows=0.8), boosting.Spec(range(6), 3, 0.7, 8, 0.2, rows=0.8)]
    both = boosting.fit(table, "x", "y", specs, F.col("held"), F.col("w"))
    often = boosting.fit(table, "x", "y", specs, F.col("held"), F.col("w"), snapshot=3)
    for spec, a, b in zip(specs, both, often, strict=True):
        alone = boosting.fit(table, "x", "y", [spec], F.col("held"), F.col("w"))[0]
        assert a[0].as_json() == b[0].as_json() == alone[0].as_json()
        assert {f for t in a[0].trees for f in t.feature} - {-1} <= set(spec.columns)


def test_models_grown_alone_are_those_of_shared_passes(table):
    specs = [boosting.Spec([1, 4], 2, 1.0, 12, 0.2, rows=0.8), boosting.Spec(range(6), 3, 0.7, 40, 0.3, 5, rows=0.8)]
    passes = boosting.fit(table, "x", "y", specs, F.col("held"), F.col("w"), alone=0)
    often = boosting.fit(table, "x", "y", specs, F.col("held"), F.col("w"), snapshot=3, alone=0)
    own = boosting.fit(table, "x", "y", specs, F.col("held"), F.col("w"))
    for a, b, c in zip(passes, often, own, strict=True):
        assert a[0].as_json() == b[0].as_json() == c[0].as_json()
        assert (a[1].best_round, a[1].rounds) == (c[1].best_round, c[1].rounds) and a[1].validation_mae == pytest.approx(c[1].validation_mae)


def test_odd_tables(spark, table):
    kinds = "x array<double>, y double, w double, held boolean"
    with pytest.raises(ValueError, match="no training rows"):
        fit(spark.createDataFrame([], kinds))
    constant = spark.createDataFrame([([1.0] * 6, 2.0, 1.0, False)] * 40, kinds)
    model, report = fit(constant, rounds=3)
    assert model.predict(np.ones((2, 6))) == pytest.approx([2.0, 2.0]) and report.validation_mae == []
    with pytest.raises(ValueError, match="byte"):
        boosting.fit(table, "x", "y", [], F.col("held"), bins=300)
