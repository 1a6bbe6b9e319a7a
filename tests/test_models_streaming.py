"""Learned models and streams against brute force on small fixtures."""

import functools
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldwatch import constants as K
from fieldwatch.models import hmm, iforest
from fieldwatch.operators import segments as G
from fieldwatch.operators import windows as W
from fieldwatch.streaming import stateful as ST

KEY = ["site_id"]


@pytest.fixture(scope="module")
def two_states(spark):
    rng = np.random.default_rng(2)
    state, rows = 0, []
    for i in range(600):
        if rng.random() < 0.05:
            state = 1 - state
        rows.append(("a", 1 if i < 400 else 2, i if i < 400 else i - 400, float(rng.normal(4 * state, 0.6)), float(rng.normal(-3 * state, 0.6)), state))
    return spark.createDataFrame(rows, "site_id string, sequence_id bigint, sequence_position bigint, x double, y double, truth int")


def whole_viterbi(p, x):
    la, score, back = np.log(p.trans), np.log(p.start) + p.log_emission(x)[0], []
    for b in p.log_emission(x)[1:]:
        back.append((score[:, None] + la).argmax(0))
        score = (score[:, None] + la).max(0) + b
    path = [int(score.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


PARAMS = hmm.Params(np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.0, 0.0], [4.0, -3.0]]), np.full((2, 2), 0.5))


def whole_expectations(p, sequences):
    """Forward-backward of whole sequences, one row at a time, in the plain definition."""
    out = 0
    for x in sequences:
        b, n = np.exp(p.log_emission(x)), len(x)
        alpha, beta = np.zeros((n, p.k)), np.ones((n, p.k))
        alpha[0] = p.start * b[0]
        for t in range(1, n):
            alpha[t] = alpha[t - 1] @ p.trans * b[t]
        for t in range(n - 2, -1, -1):
            beta[t] = p.trans @ (b[t + 1] * beta[t + 1])
        z = alpha[-1].sum()
        gamma = alpha * beta / z
        xi = sum(np.outer(alpha[t], b[t + 1] * beta[t + 1]) * p.trans for t in range(n - 1)) / z
        out = out + np.concatenate([gamma[0], xi.ravel(), gamma.sum(0), (gamma.T @ x).ravel(), (gamma.T @ x ** 2).ravel(), [np.log(z)]])
    return out


def test_chunked_recursions_equal_whole_ones(spark, two_states, monkeypatch):
    three = hmm.Params(np.array([0.2, 0.5, 0.3]), np.array([[0.8, 0.1, 0.1], [0.1, 0.7, 0.2], [0.3, 0.3, 0.4]]),
                       np.array([[0.0, 0.0], [4.0, -3.0], [2.0, -1.0]]), np.full((3, 2), 0.9))
    models, pdf = {0: PARAMS, 5: three}, two_states.toPandas().sort_values(["sequence_id", "sequence_position"])
    parts = {s: part[["x", "y"]].to_numpy() for s, part in pdf.groupby("sequence_id")}
    short = [x[:60] for x in parts.values()]     # short enough not to underflow in the plain definition
    few = two_states.filter("sequence_position < 60")
    for chunk, fan in ((512, 512), (16, 512), (7, 2), (1, 3)):
        got = hmm._expectations(hmm.chunk_table(few, KEY, ["x", "y"], chunk=chunk), KEY, models, 2, fan)
        for m, p in models.items():
            assert got[m] == pytest.approx(whole_expectations(p, short), rel=1e-8, abs=1e-8)
    cut = functools.partial(hmm.chunk_table, chunk=16)
    monkeypatch.setattr(hmm, "chunk_table", cut)
    for fan in (512, 3):
        got = hmm.decode(two_states, KEY, ["x", "y"], models, fan).toPandas().sort_values(["sequence_id", "sequence_position"])
        for m, p in models.items():
            for s, x in parts.items():
                assert got[(got.sequence_id == s) & (got.model == m)]["state"].tolist() == whole_viterbi(p, x)


def test_models_of_one_state_count_step_together(spark, two_states):
    """Ten models of one count are worked on as one, whatever the lengths of the chunks, and stacks are bounded by rows."""
    rng = np.random.default_rng(4)
    models = {m: hmm.Params(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), rng.normal(size=(2, 2)), np.full((2, 2), 0.7)) for m in range(10)}
    names, together = hmm._alike({**models, 10: hmm.Params(np.ones(1), np.ones((1, 1)), np.zeros((1, 2)), np.ones((1, 2)))})[0]
    assert names == list(range(10)) and together.size == 10
    few = two_states.filter("sequence_position < 12")   # short enough not to underflow in the plain definition
    parts = [part[["x", "y"]].to_numpy() for _, part in few.toPandas().sort_values(["sequence_id", "sequence_position"]).groupby("sequence_id")]
    got = hmm._expectations(hmm.chunk_table(few, KEY, ["x", "y"], chunk=5), KEY, models, 2)
    for m, p in models.items():
        assert got[m] == pytest.approx(whole_expectations(p, parts), rel=1e-8, abs=1e-8)
    short = list(hmm.R.stacks([np.zeros(4)] * 3000, 2))
    assert len(short) == 1 and all(len(at) * n[0] <= hmm.R.TOGETHER for at, n, _ in short)


def test_rows_of_chunks_do_not_move_when_borders_are_joined(spark, two_states):
    """Each of up to 61 steps would shuffle the whole table otherwise."""
    import re
    chunks = hmm.dealt_checkpoint(hmm.chunk_table(two_states, KEY, ["x", "y"], chunk=16, parts=3))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and chunks.rdd.getNumPartitions() == 3
    plan = hmm._with_borders(chunks, KEY, {0: PARAMS}, 2, False, 512)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Exchange" in plan
    assert not re.search(r"Exchange[^\n]*\n[^\n]*Scan ExistingRDD\[[^\]]*\bx#", plan), plan
    whole = hmm._expectations(chunks, KEY, {0: PARAMS}, 2)[0]
    assert whole == pytest.approx(hmm._expectations(hmm.chunk_table(two_states, KEY, ["x", "y"]), KEY, {0: PARAMS}, 2)[0], rel=1e-8, abs=1e-8)


def test_centres_move_to_the_mean_of_their_nearest_rows(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 2, (700, 2)))   # many ties
    seqs = spark.createDataFrame([("a", 1, i, float(u), float(v)) for i, (u, v) in enumerate(x)], "site_id string, sequence_id bigint, sequence_position bigint, x double, y double")
    chunks, pairs = hmm.chunk_table(seqs, KEY, ["x", "y"], chunk=100), {0: (2, 1), 1: (5, 1), 2: (3, 9)}
    begun, moved = (hmm._centres(chunks, seqs, ["x", "y"], pairs, rounds) for rounds in (0, 2))
    for m, c in begun.items():
        for _ in range(2):
            near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        assert moved[m] == pytest.approx(c)


def test_unsettled_models_are_never_chosen(spark, two_states):
    with pytest.raises(hmm.NotSettled):
        hmm.fit_hmm(two_states, KEY, ["x", "y"], 2, seeds=[0], iters=1)
    with pytest.raises(hmm.NotSettled):
        hmm.fit_hmm(two_states.limit(0), KEY, ["x", "y"], 2, seeds=[0])


def test_fit_recovers_known_states(spark, two_states):
    params, loglik = hmm.fit_hmm(two_states, KEY, ["x", "y"], 2, seeds=[0, 7], iters=60, tol=1e-3)
    assert sorted(np.round(params.mean[:, 0])) == [0.0, 4.0] and np.isfinite(loglik)
    states = hmm.decode(two_states, KEY, ["x", "y"], {0: params}).join(two_states, [*KEY, "sequence_id", "sequence_position"])
    agree = states.agg(F.avg((F.col("state") == F.col("truth")).cast("int"))).first()[0]
    assert max(agree, 1 - agree) > 0.97


def test_forest_finds_the_outliers_whatever_the_partitioning(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(0, 1, 3))) for i in range(1500)] + [(9000 + i, 12.0 + i, 12.0, -12.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double")
    cols = ["a", "b", "c"]
    forest = iforest.fit_isolation(df, cols, ["id"], trees=50, contamination=0.01)
    flagged = {r["id"] for r in iforest.score_isolation(df, forest).filter("is_anomaly").collect()}
    assert {9000 + i for i in range(5)} <= flagged and len(flagged) <= 16
    again = iforest.fit_isolation(df.repartition(7), cols, ["id"], trees=50, contamination=0.01)
    assert again.offset == pytest.approx(forest.offset)


def feed(spark, tmp_path, pdf, parts):
    folder = tmp_path / f"in-{uuid.uuid4().hex}"
    for piece in np.array_split(np.arange(len(pdf)), parts):
        df = spark.createDataFrame(pdf.iloc[piece]).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(spark, tmp_path, stream, mode="append"):
    at = tmp_path / f"out-{uuid.uuid4().hex}"
    keep = lambda b, n: b.write.mode("overwrite").parquet(f"{at}/rows/b={n}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows").drop("b")


def test_detection_stream_predicts_only_on_full_features(spark, tmp_path):
    rng = np.random.default_rng(4)
    ts = pd.date_range("2026-01-01", periods=160, freq="2min").append(pd.date_range("2026-01-01 09:00", periods=60, freq="2min"))
    pdf = pd.DataFrame({"site_id": "a", "ts": ts, "temperature": rng.normal(25, 1, 220), "humidity": rng.normal(45, 2, 220)})
    d = len(K.STATE_FEATURES)
    params = hmm.Params(np.array([0.5, 0.5]), np.full((2, 2), 0.5), rng.normal(0, 1, (2, d)), np.ones((2, d)))
    model = hmm.HmmModel(params, hmm.Scaler([0.0] * d, [1.0] * d), K.STATE_FEATURES, 0.0, True, [1])
    got = drain(spark, tmp_path, ST.detect_stream(feed(spark, tmp_path, pdf, 3), KEY, "ts", model)).toPandas()
    # batch features decide which readings are complete; the stream may not predict any other
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    full = W.state_features(G.add_segments(df, KEY, "ts"), KEY, "ts").na.drop(subset=K.STATE_FEATURES).toPandas()
    assert sorted(pd.to_datetime(got["ts"])) == sorted(full["ts"])
    assert got["history_size"].max() == 100
    # the newest reading's features equal the batch ones, and its state is that of the best path over its buffer
    us = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy()
    x = ST.window_features(us, pdf["temperature"].to_numpy(), pdf["humidity"].to_numpy(), np.arange(220), 100, 125)
    state = got.set_index("ts")["state"]
    for i in (38, 60, 100, 159, 198, 199, 219):
        if ts[i] in state.index:
            assert x[i, -1] == pytest.approx(full[full.ts == ts[i]][K.STATE_FEATURES].to_numpy()[0], abs=1e-8)
            # the buffer's own rows, and nothing before them
            alone = df.orderBy("ts").limit(i + 1).orderBy(F.col("ts").desc()).limit(100)
            rows = W.state_features(G.add_segments(alone, KEY, "ts"), KEY, "ts").na.drop(subset=K.STATE_FEATURES).orderBy("ts").toPandas()[K.STATE_FEATURES]
            assert x[i][np.isfinite(x[i]).all(1)] == pytest.approx(rows.to_numpy(), abs=1e-8)
            assert whole_viterbi(params, rows.to_numpy())[-1] == state[ts[i]]


def test_a_late_reading_gets_no_second_prediction(spark, tmp_path):
    rng = np.random.default_rng(5)
    ts = pd.date_range("2026-01-01", periods=120, freq="2min")
    pdf = pd.DataFrame({"site_id": "a", "ts": ts, "temperature": rng.normal(25, 1, 120), "humidity": rng.normal(45, 2, 120)})
    late = pd.concat([pdf.drop(index=90), pdf.loc[[90]]], ignore_index=True)
    d = len(K.STATE_FEATURES)
    params = hmm.Params(np.array([0.5, 0.5]), np.full((2, 2), 0.5), rng.normal(0, 1, (2, d)), np.ones((2, d)))
    model = hmm.HmmModel(params, hmm.Scaler([0.0] * d, [1.0] * d), K.STATE_FEATURES, 0.0, True, [1])
    got = drain(spark, tmp_path, ST.detect_stream(feed(spark, tmp_path, late, 6), KEY, "ts", model)).toPandas()
    assert got["ts"].is_unique and pd.Timestamp(ts[90]) not in set(got["ts"])


def test_stretches_of_a_delivery_are_predicted_apart_with_the_buffer_before_them(spark, tmp_path, monkeypatch):
    """Three deliveries, longer than a stretch: what is worked on together stays small, and predictions are those of one go."""
    rng = np.random.default_rng(6)
    n, d = 400, len(K.STATE_FEATURES)
    ts = pd.date_range("2026-01-01", periods=n, freq="2min") + pd.to_timedelta(np.where(np.arange(n) >= 150, 3600, 0), unit="s")
    pdf = pd.DataFrame({"site_id": "a", "ts": ts, "temperature": rng.normal(25, 1, n), "humidity": rng.normal(45, 2, n)})
    params = hmm.Params(np.array([0.5, 0.5]), np.full((2, 2), 0.5), rng.normal(0, 1, (2, d)), np.ones((2, d)))
    model = hmm.HmmModel(params, hmm.Scaler([0.0] * d, [1.0] * d), K.STATE_FEATURES, 0.0, True, [1])
    monkeypatch.setattr(ST, "STRETCH", 16)
    monkeypatch.setattr(ST, "AT_ONCE", 3)
    moved = ST.detect_stream(feed(spark, tmp_path, pdf, 3), KEY, "ts", model)
    assert "Repartition" in moved._jdf.queryExecution().analyzed().toString()   # not all in the task of the series
    got = drain(spark, tmp_path, moved).toPandas().sort_values("ts")
    us = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy()
    x = ST.window_features(us, pdf["temperature"].to_numpy(), pdf["humidity"].to_numpy(), np.arange(n), 100, 125)
    whole = [i for i in range(38, n) if np.isfinite(x[i, -1]).all()]
    assert got["ts"].tolist() == [ts[i] for i in whole]
    state, score = ST.last_states(params, x[whole])
    assert got["state"].tolist() == state.tolist() and got["score"].to_numpy() == pytest.approx(score, abs=1e-8)
    assert got["history_size"].tolist() == [min(i + 1, 100) for i in whole]
    # the rows left out of a buffer are those that cannot be complete
    assert not np.isfinite(x[:, :38]).all(2).any()


def brute_episodes(pdf, enter, exit, max_gap, min_exit=5):
    closed, is_open, last = [], False, None
    for r in pdf.sort_values("ts").itertuples():
        if is_open and (np.isnan(r.temperature) or (r.ts - last).total_seconds() > max_gap):
            closed.append(rows)
            is_open = False
        last = r.ts
        if np.isnan(r.temperature):
            continue
        if not is_open and r.temperature >= enter:
            is_open, rows, left = True, [], 0
        if is_open:
            rows.append(r)
            left = left + 1 if r.temperature <= exit else 0
            if left >= min_exit:
                closed.append(rows)
                is_open = False
    return sorted((r[0].site_id, r[0].ts, r[-1].ts, max(x.temperature for x in r), len(r)) for r in closed)


def series(site, n, seed):
    rng = np.random.default_rng(seed)
    ts = pd.date_range("2026-01-01", periods=n, freq="2min") + pd.to_timedelta(np.where(np.arange(n) >= n // 2, 3600, 0), unit="s")
    temperature = np.where((np.arange(n) // 15) % 3 == 1, 30.0, 20.0) + rng.normal(0, 1, n)
    temperature[n // 3] = np.nan
    return pd.DataFrame({"site_id": site, "ts": ts, "temperature": temperature})


def shuffled_feed(spark, tmp_path, batches):
    import os
    folder = tmp_path / f"in-{uuid.uuid4().hex}"
    for k, piece in enumerate(batches):
        at = folder / f"{k}.parquet"
        folder.mkdir(exist_ok=True)
        piece.astype({"ts": "datetime64[us]"}).to_parquet(at, index=False)
        os.utime(at, (1_700_000_000 + 60 * k,) * 2)   # files come in this order
    schema = "site_id string, ts timestamp, temperature double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_readings_late_within_the_delay_change_no_episode(spark, tmp_path):
    """Five micro-batches, shuffled, overlapping in time; one series ends early and is released by a timer."""
    a, b = series("a", 240, 1), series("b", 90, 2)
    pdf = pd.concat([a, b]).reset_index(drop=True)
    rng = np.random.default_rng(3)
    arrives = (pdf["ts"] - pdf["ts"].min()).dt.total_seconds() + rng.uniform(0, 3500, len(pdf))
    order = np.argsort(arrives.to_numpy())
    batches = [pdf.iloc[rng.permutation(p)] for p in np.array_split(order, 5)]
    end = pd.DataFrame({"site_id": ["clock"], "ts": [pdf["ts"].max() + pd.Timedelta(hours=3)], "temperature": [0.0]})
    stream = shuffled_feed(spark, tmp_path, [*batches, end])
    got = drain(spark, tmp_path, ST.episodes_stream(stream, KEY, "ts", "temperature", 28.0, 25.0, 125.0, delay=3600.0))
    assert ST.rejected_readings(got, KEY, "ts", "temperature").count() == 0
    rows = sorted((r["site_id"], r["start"], r["end"], r["peak_value"], r["n_rows"]) for r in ST.closed_episodes(got).collect())
    want = brute_episodes(a, 28.0, 25.0, 125.0) + brute_episodes(b, 28.0, 25.0, 125.0)
    assert len(want) > 5 and [(s, pd.Timestamp(x), pd.Timestamp(y), p, n) for s, x, y, p, n in rows] == want


def test_episodes_of_arrays_are_those_of_one_reading_after_the_other():
    """Random series with ties of levels, gaps and missing values, cut anywhere, against the plain machine."""
    rng = np.random.default_rng(8)
    for _ in range(300):
        n, exit_rows = int(rng.integers(1, 60)), int(rng.integers(1, 4))
        t, v = np.cumsum(rng.choice([1, 2, 5, 50], n)) * 1_000_000, np.round(rng.normal(0, 2, n))
        v[rng.random(n) < 0.05] = np.nan
        enter = float(rng.integers(-1, 3))
        level = enter - float(rng.integers(-1, 3))
        want, now, last, left = [], None, None, 0
        for at, x in zip(t.tolist(), v.tolist()):
            if now and (np.isnan(x) or at - last > 10e6):
                want.append(tuple(now))
                now = None
            last = at
            if np.isnan(x):
                continue
            if not now and x >= enter:
                now, left = [at, at, x, 0], 0
            if now:
                now[1:], left = [at, max(now[2], x), now[3] + 1], left + 1 if x <= level else 0
                if left >= exit_rows:
                    want.append(tuple(now))
                    now = None
        tracker, got, cuts = ST.Tracker(), [], np.sort(rng.integers(0, n + 1, 3))
        for a, b in zip([0, *cuts], [*cuts, n]):
            got += list(zip(*(c.tolist() for c in tracker.take(t[a:b], v[a:b], enter, level, 10.0, exit_rows))))
        assert got == want and tracker.is_open == bool(now) and tracker.last == last
        assert not now or (tracker.start, tracker.end, tracker.peak, tracker.n, tracker.left) == (*now, left)


def test_readings_too_late_are_counted_and_change_no_episode(spark, tmp_path):
    a = series("a", 240, 1)
    late, kept = a.iloc[[16, 20, 21, 50]], a.drop(index=[16, 20, 21, 50])
    end = pd.DataFrame({"site_id": ["clock"], "ts": [a["ts"].max() + pd.Timedelta(hours=3)], "temperature": [0.0]})
    stream = shuffled_feed(spark, tmp_path, [kept.iloc[:120], kept.iloc[120:], late, end])
    got = drain(spark, tmp_path, ST.episodes_stream(stream, KEY, "ts", "temperature", -28.0, -25.0, 125.0, delay=600.0, direction="low"))
    rejected = ST.rejected_readings(got, KEY, "ts", "temperature").collect()
    assert sorted((pd.Timestamp(r["ts"]), r["temperature"]) for r in rejected) == sorted(zip(late["ts"], late["temperature"]))
    mirrored = kept.assign(temperature=-kept["temperature"])
    rows = sorted((r["site_id"], pd.Timestamp(r["start"]), pd.Timestamp(r["end"]), -r["peak_value"], r["n_rows"]) for r in ST.closed_episodes(got).collect())
    assert rows == brute_episodes(mirrored, 28.0, 25.0, 125.0)


def test_ingest_stream_is_idempotent(spark, tmp_path):
    ts = pd.date_range("2026-01-01", periods=50, freq="2min")
    pdf = pd.DataFrame({"site_id": "a", "ts": ts, "temperature": 1.0})
    twice = pd.concat([pdf, pdf], ignore_index=True)
    out = drain(spark, tmp_path, ST.ingest_stream(feed(spark, tmp_path, twice, 2), KEY, "ts", "3 hours"))
    assert out.count() == 50
