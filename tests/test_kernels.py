"""Hand-computed cases of the stateful kernels."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldwatch.functions.numeric import present
from fieldwatch.operators import cleaning as C
from fieldwatch.operators import episodes as E
from fieldwatch.operators import hourgrid as H
from fieldwatch.operators import maintenance as M
from fieldwatch.operators import quantiles as Q
from fieldwatch.operators import scoring as S
from fieldwatch.operators import segments as G
from fieldwatch.operators import windows as W

KEY = ["site_id"]


def series(spark, values, step=120, start="2026-01-01 00:00:00", schema="value double"):
    at = pd.Timestamp(start)
    rows = [("a", (at + pd.Timedelta(seconds=step * i)).to_pydatetime(), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"site_id string, ts timestamp_ntz, {schema}")


def column(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_decayed_sum_halves(spark):
    out = W.decayed_sums(series(spark, [1.0, 0.0, 0.0, 0.0], 3600), KEY, "ts", {"s": "value"}, 1)
    assert column(out, "s") == pytest.approx([1, 0.5, 0.25, 0.125])


def test_decayed_sum_equals_loop_over_blocks(spark):
    rng = random.Random(3)
    values = [float(rng.choice([0, 0, 0, 1, 4])) for _ in range(1100)]
    out = column(W.decayed_sums(series(spark, values, 3600), KEY, "ts", {"s": "value"}, 8), "s")
    running, d = 0.0, 0.5 ** (1 / 8)
    for got, v in zip(out, values):
        running = running * d + v
        assert got == pytest.approx(running, abs=1e-9)


@pytest.mark.parametrize("half_life", [1, 8, 240])
def test_decayed_sum_reaches_back_over_the_whole_history(spark, half_life):
    values = [1.0 if i % 7 else 5.0 for i in range(3000)]
    out = column(W.decayed_sums(series(spark, values, 3600), KEY, "ts", {"s": "value"}, half_life), "s")
    running, d = 0.0, 0.5 ** (1 / half_life)
    for got, v in zip(out, values):
        running = running * d + v
        assert got == pytest.approx(running, rel=1e-9)


def test_one_key_is_ordered_by_many_tasks(spark):
    from fieldwatch.operators.ranks import running_totals
    df = spark.range(20_000).select(F.lit("a").alias("k"), ((F.col("id") * 7919) % 20_000).alias("v"), F.lit(2).alias("c"))
    out = running_totals(df, ["k"], ["v"], "c", parts=20)
    assert out.filter("_before <> 2 * v or _total <> 40000").count() == 0 and out.count() == 20_000
    held = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0]
    ranged = df.repartitionByRange(20, "k", "v").withColumn("p", F.spark_partition_id()).groupBy("p").count()
    assert ranged.agg(F.max("count")).first()[0] <= 3_000 and held <= 20_000


def test_run_length(spark):
    out = G.run_length(series(spark, [1, 1, 1, 0, 1, 1], schema="value int"), KEY, "ts", "value")
    assert column(out, "run_length") == [1, 2, 3, 0, 1, 2]


def test_interpolation_fills_three_per_gap(spark):
    gaps = [1.0] + [None] * 5 + [7.0] + [None] * 4 + [8.0] + [None] * 4
    out = column(H.interpolate(series(spark, gaps, 3600), KEY, "ts", ["value"]), "value")
    want = [1, 2, 3, 4, None, None, 7, 7.2, 7.4, 7.6, None, 8, 8, 8, 8, None]
    assert [None if v is None else round(v, 6) for v in out] == want


def test_pm_risk_and_saturation(spark):
    df = series(spark, [0.0, 1.0, 5.0, 50.0])
    sat = column(S.saturate(df, KEY, {"s": "value"}, 6), "s")
    assert sat[0] == 0 and sat == sorted(sat) and sat[-1] < 1
    days = spark.createDataFrame([("2026-01-01",), ("2026-02-15",), ("2026-06-01",)], "d string").select(
        S.pm_risk(F.col("d").cast("timestamp_ntz"), F.lit("2026-01-01").cast("timestamp_ntz"), 90).alias("r"))
    a, b, c = [r["r"] for r in days.collect()]
    assert a == 0 and 0 < b < 1 and c == 1


def test_labels(spark):
    got = spark.createDataFrame([(12.0,), (-12.0,), (1.0,), (None,)], "c double").select(S.api_trend(F.col("c")).alias("t"))
    assert [r["t"] for r in got.collect()] == ["up", "down", "stable", "stable"]
    got = spark.createDataFrame([(95.0,), (70.0,), (35.0,)], "c double").select(S.api_status(F.col("c")).alias("t"))
    assert [r["t"] for r in got.collect()] == ["healthy", "watch", "critical"]


def test_presentation_rounds_half_to_even(spark):
    got = spark.createDataFrame([(0.125,), (0.375,)], "c double").select(present(F.col("c"), 2).alias("r"))
    assert [r["r"] for r in got.collect()] == [0.12, 0.38]


def test_word_boundary_and_substring(spark):
    df = spark.createDataFrame([("ATS TRANSFER",), ("STATS COLLECTION",), ("Défaut BATTERIE",), (None,)], "message string")
    flags = C.keyword_flags(df, "message").collect()
    assert [r["is_backup_transfer"] for r in flags] == [1, 0, 0, 0]
    assert [r["is_check_battery"] for r in flags] == [0, 0, 1, 0]
    assert [r["category"] for r in C.categorise(df, "message").collect()] == ["OTHER", "OTHER", "OTHER", "OTHER"]


@pytest.mark.parametrize("temps,want", [
    ([26.0, 27.5, 29.0], ("high", "critical", 29.0)), ([23.5, 22.0, 22.5], ("low", "alert", 22.0)),
    ([24.0, 25.0, 25.7], None)])
def test_episode_rules(spark, temps, want):
    bounds = {"mild_lower": 22.95, "mild_upper": 26.75, "extreme_lower": 21.05, "extreme_upper": 28.65}
    rows = E.characterise_runs(series(spark, temps), KEY, "ts", "value", bounds).collect()
    if want is None:
        assert rows == []
    else:
        assert (rows[0]["direction"], rows[0]["severity"], rows[0]["peak_value"]) == want
        assert rows[0]["duration_min"] == 4.0


def test_segments_two_blocks_across_time_blocks(spark):
    first = series(spark, [1.0] * 20, start="2026-01-01 23:50:00")
    df = first.unionByName(series(spark, [1.0] * 20, start="2026-01-02 02:00:00"))
    out = G.add_segments(df, KEY, "ts", block_seconds=600)
    assert column(out, "segment_id") == [1] * 20 + [2] * 20
    assert column(out, "segment_position") == [*range(20), *range(20)]
    assert sum(column(out, "is_discontinuity")) == 2


def test_gap_of_exactly_the_limit_continues(spark):
    out = G.add_segments(series(spark, [1.0, 2.0, 3.0], step=125), KEY, "ts")
    assert column(out, "segment_id") == [1, 1, 1]


def hysteresis_loop(values, segs, enter, leave, exits=5):
    ids, active, k, n, last = [], False, 0, 0, None
    for v, s in zip(values, segs):
        if s != last:
            active, k, last = False, 0, s
        if v is None:
            active, k = False, 0
            ids.append(0)
            continue
        if not active and v >= enter:
            n, active, k = n + 1, True, 0
        ids.append(n if active else 0)
        if active:
            k = k + 1 if v <= leave else 0
            if k >= exits:
                active, k = False, 0
    return ids


@pytest.mark.parametrize("block", [300, 3600, 86_400])
def test_hysteresis_equals_state_machine(spark, block):
    rng = random.Random(7)
    values = [None if rng.random() < 0.03 else 25 + rng.gauss(0, 1.2) for _ in range(1500)]
    at, rows = pd.Timestamp("2026-01-01"), []
    for v in values:
        at += pd.Timedelta(seconds=120 if rng.random() > 0.01 else 4000)
        rows.append(("a", at.to_pydatetime(), v))
    df = spark.createDataFrame(rows, "site_id string, ts timestamp_ntz, value double")
    seg = G.add_segments(df, KEY, "ts", block_seconds=block)
    out = G.hysteresis(seg, KEY, "ts", "value", 26.5, 26.0, block_seconds=block)
    got = out.orderBy("ts").collect()
    assert [r["episode_id"] for r in got] == hysteresis_loop(values, [r["segment_id"] for r in got], 26.5, 26.0)


def test_hysteresis_needs_a_margin(spark):
    with pytest.raises(ValueError):
        G.hysteresis(series(spark, [1.0]), KEY, "ts", "value", 5.0, 5.0)


def test_quantiles_exact_with_one_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.lognormvariate(0, 2)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "site_id string, v double").repartition(8)
    got = {(r["site_id"], r["prob"]): r["quantile"] for r in
           Q.exact_quantiles(df, KEY, "v", [0.05, 0.25, 0.75, 0.95], parts=16).collect()}
    want = pd.DataFrame(rows, columns=["k", "v"]).groupby("k")["v"].quantile([0.05, 0.25, 0.75, 0.95])
    assert len(got) == len(want)
    for key, q in want.items():
        assert got[key] == pytest.approx(q, rel=1e-12)


def test_tukey_of_nothing_fails(spark):
    with pytest.raises(ValueError):
        Q.tukey(series(spark, [None]), KEY, "value", require=True)


def test_asof_tie_takes_the_later_row(spark):
    left = series(spark, [0.0], start="2026-01-01 12:00:00").drop("value")
    right = series(spark, [1.0, 2.0], step=7200, start="2026-01-01 11:00:00")
    hit = H.asof_nearest(left, right, KEY, "ts", 3600, ["value"]).first()
    assert hit["value"] == 2.0
    assert H.asof_nearest(left, right, KEY, "ts", 3599, ["value"]).first()["value"] is None


def test_next_pm_clamps_month_end(spark):
    rows = [("2026-07-01", 3, "months", "2026-10-01"), ("2026-07-20", 10, "days", "2026-07-30"), ("2026-07-20", 2, "weeks", "2026-08-03"),
            ("2026-01-31", 1, "months", "2026-02-28"), ("2026-10-31", 2, "months", "2026-12-31")]
    df = spark.createDataFrame(rows, "d string, v int, u string, want string").withColumn("d", F.to_date("d"))
    assert all(str(r["got"]) == r["want"] for r in df.withColumn("got", M.next_pm("d", "v", "u")).collect())


def test_weights_are_checked():
    from fieldwatch import constants as K
    S.check_weights(K.WEIGHTS)
    for bad in ({**K.WEIGHTS, "overall": {"environmental": 0.3, "energy": 0.3, "battery": 0.3}},
                {**K.WEIGHTS, "overall": {"environmental": True, "energy": 0.0, "battery": 0.0}},
                {**K.WEIGHTS, "overall": {"environmental": math.inf, "energy": 0.0, "battery": 0.0}},
                {k: v for k, v in K.WEIGHTS.items() if k != "energy"}):
        with pytest.raises(ValueError):
            S.check_weights(bad)


def test_window_stats_anchor_on_data(spark):
    end = pd.Timestamp("2026-05-18 19:00:00")
    rows = [("a", "U1", (end - pd.Timedelta(hours=h)).to_pydatetime(), 10.0, "environment", "cooling") for h in (2, 10, 100)]
    eps = spark.createDataFrame(rows, "site_id string, equipment string, start timestamp_ntz, duration_min double, dimension string, family string")
    ref = lambda t: spark.createDataFrame([("a", t.to_pydatetime())], "site_id string, last_ts timestamp_ntz")
    now = E.window_stats(eps, 24, ref(end), None, KEY).first()
    assert (now["total"], now["top_family"], now["dimension_environment"]) == (2, "cooling", 2)
    later = E.window_stats(eps, 24, ref(end + pd.Timedelta(days=60)), None, KEY).first()
    assert (later["total"], later["top_family"]) == (0, None)


def test_dense_readings_take_narrower_blocks(spark):
    """A block holds a bounded number of rows however dense a series is; sparse ones keep the width; results stay."""
    from fieldwatch.operators.timeblocks import Width, fitting_width
    at = "timestamp_ntz'1969-12-31 00:00:00' + make_dt_interval(0, 0, 0, CAST(id % 4000 * 43.2 AS DECIMAL(18, 6)))"   # two days
    dense = spark.range(8000).select((F.col("id") >= 4000).cast("int").alias("site_id"), F.expr(at).alias("ts"))
    dense = dense.union(spark.createDataFrame([(0, None)], dense.schema))
    day = 86_400.0
    assert fitting_width(dense, ["site_id"], "ts", 4 * day, rows=2_000) == 4 * day
    assert fitting_width(dense, ["site_id"], "ts", 4 * day, rows=1_999) == day / 2
    assert fitting_width(dense, ["site_id"], "ts", 4 * day, rows=500) == day / 4
    assert fitting_width(dense, ["site_id"], "ts", 4 * day, least=day / 2, rows=500) == day / 2
    assert fitting_width(dense, ["site_id"], "ts", 4 * day, rows=0) == 4 * day / 4096
    assert [fitting_width(dense, ["site_id"], "ts", 4 * day, rows=n).tasks for n in (2_000, 500)] == [0, 33]
    assert fitting_width(dense.limit(0), ["site_id"], "ts", 4 * day) == 4 * day
    rows = dense.filter("ts IS NOT NULL").withColumn("t", F.pmod(F.xxhash64("site_id", "ts"), 100).cast("double"))
    got = [{tuple(r) for r in G.hysteresis(G.add_segments(rows, ["site_id"], "ts", 60.0, w), ["site_id"], "ts", "t", 70.0, 60.0, max_gap=60.0, block_seconds=w)
            .select("site_id", "ts", "segment_position", "episode_id").collect()} for w in (4 * day, Width(4 * day / 64, 5))]
    assert got[0] == got[1] and len(got[0]) == 8000
