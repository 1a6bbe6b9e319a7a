"""A17, I3, M1-M18 on the driver's tables.

Learned models have no SQL counterpart (their random draws and fits are their own); the
protocol around them (splits, medians, metrics, thresholds) has.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as K
from ...models import hmm, iforest
from ...operators import aggregates as A
from ...operators import episodes as E
from ...operators import forecasting as FC
from ...operators import hourgrid as H
from ...operators import quantiles as Q
from ...operators import segments as G
from ...operators import windows as W
from ...operators.cleaning import categorise
from ...session import durable_checkpoint
from .alarms_scoring import EVENT_KEYS, alarm_events, events, scored
from .base import GAP, KEYS, block, cte, query, readings, table
from .episodes import _AGE, _CHARACTER
from .grid import filled
from .segments import segmented
from .windows import features, trajectory_sql

cte("train_hours", "filled", """
SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY timestamp) <= floor(count(*) OVER (PARTITION BY site_id) * 0.7::DOUBLE)""")
cte("medians", "train_hours", """
SELECT site_id, quantile_cont(temperature, 0.5) AS temperature, quantile_cont(humidity, 0.5) AS humidity FROM train_hours GROUP BY site_id""")


def _medians(spark, sf):
    train = W.chrono_split(filled(spark, sf), KEYS, "timestamp").filter("split = 'train'")
    return A.feature_medians(train, KEYS, ["temperature", "humidity"])


@query("a17_feature_medians", "medians", "SELECT * FROM medians", "temperature humidity")
def a17(spark, sf):
    return _medians(spark, sf)


@query("i3_impute_median", "filled medians", """
SELECT f.site_id, timestamp, coalesce(f.temperature, m.temperature) AS temperature, coalesce(f.humidity, m.humidity) AS humidity
FROM filled f JOIN medians m USING (site_id)""", "temperature humidity")
def i3(spark, sf):
    rows = filled(spark, sf).select("site_id", "timestamp", "temperature", "humidity")
    return A.impute_median(rows, _medians(spark, sf), KEYS, ["temperature", "humidity"])


@query("m1_standardise", "readings", """
SELECT event_id, (temperature - avg(temperature) OVER ()) / stddev_pop(temperature) OVER () AS temperature,
       (humidity - avg(humidity) OVER ()) / stddev_pop(humidity) OVER () AS humidity FROM readings""", "temperature humidity")
def m1(spark, sf):
    r = readings(spark, sf).select("event_id", "temperature", "humidity")
    cols = ["temperature", "humidity"]
    return hmm.apply_scaler(r, cols, hmm.fit_scaler(r, cols))


EMBEDDED = 64   # dimensions of the test vectors
_DIMS = [f"e{i}" for i in range(EMBEDDED)]


def _embeddings(spark, sf):
    """Every dimension as a column of its own."""
    return table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_DIMS)])


@query("m1_standardise_embeddings", None, f"""
SELECT vec_id, {", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in _DIMS)}
FROM (SELECT vec_id, {", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(_DIMS))} FROM embeddings)""", " ".join(_DIMS))
def m1_embeddings(spark, sf):
    rows = _embeddings(spark, sf)
    return hmm.apply_scaler(rows, _DIMS, hmm.fit_scaler(rows, _DIMS))


# --- hidden states: all 19 features, state counts and seeds, whole tables -----------------
_STATE = list(K.STATE_FEATURES)
_BOUNDS = {"temperature": (5.0, 96.0), "humidity": (10.0, 90.0)}
#: The only cut against the operators' defaults (500 steps, a gain below 1e-4): where these runs stop.
STEPS, TOLERANCE = 60, 5.0


def _sequences(spark, sf):
    rows = features(spark, sf).withColumn("label", (F.col("temperature") >= 96).cast("int"))
    seqs = G.add_sequences(rows, KEYS, "ts", _STATE, GAP, block_seconds=block(spark, sf, 2 * GAP))
    return durable_checkpoint(seqs.select(*KEYS, "event_id", "ts", "segment_id", "sequence_id", "sequence_position",
                                          "label", *_STATE))


def _decoded(seqs, model):
    return hmm.decode_rows(seqs, KEYS, model)


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in K.STATE_FEATURES)
cte("complete_rows", "features", f"SELECT * FROM features WHERE {_COMPLETE}")
cte("complete_open", "complete_rows", """
SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000
                 OR lag(segment_id) OVER w <> segment_id THEN 1 ELSE 0 END AS opens
FROM complete_rows WINDOW w AS (PARTITION BY site_id ORDER BY ts)""")
cte("complete_seq", "complete_open", """
SELECT * FROM (SELECT *, sum(opens) OVER (PARTITION BY site_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS seq FROM complete_open)
QUALIFY count(*) OVER (PARTITION BY site_id, seq) >= 2""")


@query("m2_fit_hmm", "complete_seq", f"""
SELECT k::INT AS n_states, {len(K.HMM_SEEDS)}::BIGINT AS candidates, true AS gained, 1.0::DOUBLE AS start_total, k::DOUBLE AS transition_total,
       (SELECT count(*) FROM complete_seq)::DOUBLE AS weight_total
FROM (SELECT unnest({K.HMM_STATE_COUNTS}) AS k) WHERE (SELECT count(*) FROM complete_seq) > 0""", "start_total transition_total weight_total")
def m2(spark, sf):
    """What holds for every fit: probabilities add up, every row has its weight, and no candidate ends below where it began."""
    seqs = _sequences(spark, sf)
    kinds = "n_states int, candidates bigint, gained boolean, start_total double, transition_total double, weight_total double"
    scaled = hmm.apply_scaler(seqs, _STATE, hmm.fit_scaler(seqs, _STATE))
    try:
        begun = hmm.fit_candidates(scaled, KEYS, _STATE, K.HMM_STATE_COUNTS, K.HMM_SEEDS, 0, TOLERANCE)
        ended = hmm.fit_candidates(scaled, KEYS, _STATE, K.HMM_STATE_COUNTS, K.HMM_SEEDS, STEPS, TOLERANCE)
    except hmm.NotSettled:   # no complete rows
        return spark.createDataFrame([], kinds)
    rows = []
    for k in K.HMM_STATE_COUNTS:
        own = {s: fit for (n, s), fit in ended.items() if n == k}
        best = max(own.values(), key=lambda f: f[1])[0]
        weight = hmm.expected_counts(scaled, KEYS, _STATE, best)["weight"].sum()
        rows.append((k, len(own), all(f[1] > begun[k, s][1] for s, f in own.items()), float(best.start.sum()), float(best.trans.sum()), float(weight)))
    return spark.createDataFrame(rows, kinds)


# --- decoding with fixed parameters: every step has its SQL ---------------------------------
_PAIR = ["temperature", "humidity"]
FIXED = hmm.HmmModel(
    hmm.Params(hmm.np.array([0.7, 0.3]), hmm.np.array([[0.9, 0.1], [0.2, 0.8]]), hmm.np.array([[30.0, 35.0], [90.0, 65.0]]),
               hmm.np.array([[400.0, 600.0], [900.0, 500.0]])),
    hmm.Scaler([0.0, 0.0], [1.0, 1.0]), _PAIR, 0.0, True, [1])


def _emission(state):
    (m1, m2), (v1, v2) = FIXED.params.mean[state].tolist(), FIXED.params.var[state].tolist()
    return (f"-0.5 * ((temperature - {m1}) * (temperature - {m1}) / {v1} + (humidity - {m2}) * (humidity - {m2}) / {v2}"
            f" + ln(2 * pi() * {v1}) + ln(2 * pi() * {v2}))")


cte("vit_rows", "seg", "SELECT * FROM seg WHERE temperature IS NOT NULL AND humidity IS NOT NULL")
cte("vit_open", "vit_rows", """
SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000
                 OR lag(segment_id) OVER w <> segment_id THEN 1 ELSE 0 END AS opens
FROM vit_rows WINDOW w AS (PARTITION BY site_id ORDER BY ts)""")
cte("vit_seq", "vit_open", "SELECT *, sum(opens) OVER (PARTITION BY site_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS seq FROM vit_open")
cte("vit_in", "vit_seq", f"""
SELECT event_id, site_id, ts, segment_id, temperature, humidity, seq, row_number() OVER (PARTITION BY site_id, seq ORDER BY ts) AS rn,
       count(*) OVER (PARTITION BY site_id, seq) AS n, {_emission(0)} AS e0, {_emission(1)} AS e1 FROM vit_seq""")
cte("rec_vit", "vit_in", """
SELECT site_id, seq, rn, ln(0.7::DOUBLE) + e0 AS s0, ln(0.3::DOUBLE) + e1 AS s1, 0 AS b0, 0 AS b1 FROM vit_in WHERE rn = 1 AND n >= 2
UNION ALL
SELECT v.site_id, v.seq, v.rn, greatest(s0 + ln(0.9::DOUBLE), s1 + ln(0.2::DOUBLE)) + v.e0, greatest(s0 + ln(0.1::DOUBLE), s1 + ln(0.8::DOUBLE)) + v.e1,
       CASE WHEN s1 + ln(0.2::DOUBLE) > s0 + ln(0.9::DOUBLE) THEN 1 ELSE 0 END, CASE WHEN s1 + ln(0.8::DOUBLE) > s0 + ln(0.1::DOUBLE) THEN 1 ELSE 0 END
FROM rec_vit r JOIN vit_in v ON v.site_id = r.site_id AND v.seq = r.seq AND v.rn = r.rn + 1""")
cte("vit_scores", "rec_vit", "SELECT r.*, v.event_id, v.ts, v.segment_id, v.temperature, v.humidity, v.n FROM rec_vit r JOIN vit_in v USING (site_id, seq, rn)")
cte("rec_path", "vit_scores", """
SELECT site_id, seq, rn, CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS state FROM vit_scores WHERE rn = n
UNION ALL
SELECT v.site_id, v.seq, v.rn - 1, CASE WHEN p.state = 0 THEN v.b0 ELSE v.b1 END
FROM rec_path p JOIN vit_scores v ON v.site_id = p.site_id AND v.seq = p.seq AND v.rn = p.rn WHERE p.rn > 1""")
cte("decoded", "rec_path vit_scores", "SELECT v.*, p.state FROM rec_path p JOIN vit_scores v USING (site_id, seq, rn)")


def _fixed_sequences(spark, sf):
    seqs = G.add_sequences(segmented(spark, sf), KEYS, "ts", _PAIR, GAP, block_seconds=block(spark, sf, 2 * GAP))
    return durable_checkpoint(seqs.select(*KEYS, "event_id", "ts", "segment_id", "sequence_id", "sequence_position", *_PAIR))


@query("m3_decode_states", "decoded", "SELECT site_id, event_id, CAST(state AS INTEGER) AS state FROM decoded")
def m3(spark, sf):
    return _decoded(_fixed_sequences(spark, sf), FIXED).select("site_id", "event_id", "state")


# one EM step under the fixed parameters: scaled forward and backward recursions
cte("em_in", "vit_in", "SELECT *, greatest(e0, e1) AS top, exp(e0 - greatest(e0, e1)) AS x0, exp(e1 - greatest(e0, e1)) AS x1 FROM vit_in WHERE n >= 2")
cte("rec_fwd", "em_in", """
SELECT site_id, seq, rn, 0.7::DOUBLE * x0 / (0.7::DOUBLE * x0 + 0.3::DOUBLE * x1) AS a0, 0.3::DOUBLE * x1 / (0.7::DOUBLE * x0 + 0.3::DOUBLE * x1) AS a1, 0.0::DOUBLE AS p0, 0.0::DOUBLE AS p1,
       ln(0.7::DOUBLE * x0 + 0.3::DOUBLE * x1) + top AS ll FROM em_in WHERE rn = 1
UNION ALL
SELECT site_id, seq, rn, u0 / (u0 + u1), u1 / (u0 + u1), a0, a1, ln(u0 + u1) + top
FROM (SELECT v.site_id, v.seq, v.rn, v.top, r.a0, r.a1, (r.a0 * 0.9::DOUBLE + r.a1 * 0.2::DOUBLE) * v.x0 AS u0, (r.a0 * 0.1::DOUBLE + r.a1 * 0.8::DOUBLE) * v.x1 AS u1
      FROM rec_fwd r JOIN em_in v ON v.site_id = r.site_id AND v.seq = r.seq AND v.rn = r.rn + 1)""")
cte("rec_bwd", "em_in", """
SELECT site_id, seq, rn, 0.5::DOUBLE AS b0, 0.5::DOUBLE AS b1 FROM em_in WHERE rn = n
UNION ALL
SELECT site_id, seq, rn, w0 / (w0 + w1), w1 / (w0 + w1)
FROM (SELECT v.site_id, v.seq, v.rn - 1 AS rn, 0.9::DOUBLE * v.x0 * r.b0 + 0.1::DOUBLE * v.x1 * r.b1 AS w0, 0.2::DOUBLE * v.x0 * r.b0 + 0.8::DOUBLE * v.x1 * r.b1 AS w1
      FROM rec_bwd r JOIN em_in v ON v.site_id = r.site_id AND v.seq = r.seq AND v.rn = r.rn WHERE r.rn > 1)""")
cte("posteriors", "rec_fwd rec_bwd em_in", """
SELECT *, a0 * b0 / (a0 * b0 + a1 * b1) AS g0, a1 * b1 / (a0 * b0 + a1 * b1) AS g1,
       p0 * 0.9::DOUBLE * x0 * b0 AS t00, p0 * 0.1::DOUBLE * x1 * b1 AS t01, p1 * 0.2::DOUBLE * x0 * b0 AS t10, p1 * 0.8::DOUBLE * x1 * b1 AS t11
FROM rec_fwd JOIN rec_bwd USING (site_id, seq, rn) JOIN em_in USING (site_id, seq, rn)""")
_EM = "start_weight to_0 to_1 weight temperature humidity temperature_sq humidity_sq log_likelihood"


def _em_state(k):
    moves = ", ".join(f"sum(CASE WHEN rn > 1 THEN t{k}{j} / (t00 + t01 + t10 + t11) ELSE 0 END) AS to_{j}" for j in (0, 1))
    return (f"SELECT {k}::INT AS state, sum(CASE WHEN rn = 1 THEN g{k} ELSE 0 END) AS start_weight, {moves}, sum(g{k}) AS weight, sum(g{k} * temperature) AS temperature, "
            f"sum(g{k} * humidity) AS humidity, sum(g{k} * temperature * temperature) AS temperature_sq, sum(g{k} * humidity * humidity) AS humidity_sq, sum(ll) AS log_likelihood "
            "FROM posteriors HAVING count(*) > 0")


@query("m2_em_step", "posteriors", f"{_em_state(0)} UNION ALL {_em_state(1)}", _EM)
def m2_step(spark, sf):
    """Expected counts of one EM step from fixed parameters."""
    found = hmm.expected_counts(_fixed_sequences(spark, sf), KEYS, _PAIR, FIXED.params)
    rows = [(k, float(found["start"][k]), *map(float, found["trans"][k]), float(found["weight"][k]), *map(float, found["sums"][k]),
             *map(float, found["squares"][k]), float(found["log_likelihood"])) for k in range(2)] if found["weight"].sum() else []
    return spark.createDataFrame(rows, "state int, " + ", ".join(f"{c} double" for c in _EM.split()))


_SHARES = ", ".join(f"avg(CASE WHEN {c} {op} {b} THEN 1 ELSE 0 END) AS prop_{c}_{side}" for c, (low, high) in _BOUNDS.items()
                    for side, op, b in (("high", ">=", high), ("low", "<=", low)))
_PROPS = [f"prop_{c}_{side}" for c in _BOUNDS for side in ("high", "low")]


@query("m4_anomalous_states", "decoded", f"""
SELECT *, greatest({", ".join(_PROPS)}) >= 0.10 AS anomalous FROM (
  SELECT CAST(state AS INTEGER) AS state, count(*) AS n_points, {_SHARES} FROM decoded GROUP BY state)""", " ".join(_PROPS))
def m4(spark, sf):
    stats = A.state_stats(_decoded(_fixed_sequences(spark, sf), FIXED), "state", [], _BOUNDS)
    worst = F.greatest(*[F.col(c) for c in stats.columns if c.startswith("prop_")])
    return stats.withColumn("anomalous", worst >= 0.10)


@query("m3_decode_fitted", "complete_seq", "SELECT site_id, event_id, true AS in_range FROM complete_seq")
def m3_fitted(spark, sf):
    """Every complete row gets one state of the fitted model."""
    seqs = _sequences(spark, sf)
    kinds = seqs.select("site_id", "event_id").schema.add("in_range", "boolean")
    scaler = hmm.fit_scaler(seqs, _STATE)
    try:
        fits = hmm.fit_candidates(hmm.apply_scaler(seqs, _STATE, scaler), KEYS, _STATE, [3], K.HMM_SEEDS, STEPS, TOLERANCE)
    except hmm.NotSettled:   # no complete rows
        return spark.createDataFrame([], kinds)
    params, loglik, settled = max(fits.values(), key=lambda f: (f[2], f[1]))
    states = _decoded(seqs, hmm.HmmModel(params, scaler, _STATE, loglik, settled, []))
    return states.select("site_id", "event_id", F.col("state").between(0, 2).alias("in_range"))


@query("m5_select_hmm")
def m5(spark, sf):
    """One row at every scale: nulls where no candidate settles or none has enough rows in every state."""
    kinds = "n_states int, cutoff double, validation_f1 double, test_f1 double, n_anomalous int"
    try:
        model, report = hmm.select_hmm(_sequences(spark, sf), KEYS, "ts", _STATE, "label", _BOUNDS, iters=STEPS, tol=TOLERANCE)
    except hmm.NotSettled:
        return spark.createDataFrame([(None, None, None, None, None)], kinds)
    return spark.createDataFrame([(int(report["n_states"]), float(report["cutoff"]), float(report["validation_f1"]),
                                   float(report["test_f1"]), len(model.anomalous))], kinds)


# bounds of the training days only, as a stored model carries them
cte("train_readings", "readings", """
SELECT r.* FROM readings r JOIN (
  SELECT * FROM (SELECT DISTINCT site_id, CAST(ts AS DATE) AS day FROM readings)
  QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY day) <= floor(count(*) OVER (PARTITION BY site_id) * 0.7::DOUBLE)) d
ON d.site_id = r.site_id AND d.day = CAST(r.ts AS DATE)""")
cte("tukey_train", "train_readings", """
SELECT site_id, q1 - 0.5 * (q3 - q1) AS mild_lower, q3 + 0.5 * (q3 - q1) AS mild_upper, q1 - 1.5 * (q3 - q1) AS extreme_lower, q3 + 1.5 * (q3 - q1) AS extreme_upper
FROM (SELECT site_id, quantile_cont(temperature, 0.25) AS q1, quantile_cont(temperature, 0.75) AS q3 FROM train_readings GROUP BY site_id)""")
cte("state_runs", "decoded tukey_train", """
SELECT d.*, mild_lower, mild_upper, extreme_lower, extreme_upper, sum(opens) OVER (PARTITION BY site_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run_id
FROM (SELECT *, CASE WHEN lag(state) OVER w IS NULL OR lag(state) OVER w <> state OR lag(segment_id) OVER w <> segment_id THEN 1 ELSE 0 END AS opens
      FROM decoded WINDOW w AS (PARTITION BY site_id ORDER BY ts)) d JOIN tukey_train USING (site_id)""")


@query("e3_detect", "state_runs bounds", f"""
SELECT printf('EP-%04d', row_number() OVER (PARTITION BY site_id ORDER BY start)) AS id, site_id,
       'U' || CAST(site_id AS VARCHAR) AS equipment, 'collective' AS type, severity, direction, start,
       round_even(duration_min * 10, 0) / 10 AS duration_min, round_even(peak_value * 100, 0) / 100 AS peak_value,
       {_AGE.format(ref='last_ts', at='start')} AS status, 'environment' AS dimension
FROM ({_CHARACTER.format(keys="site_id, run_id", src="(SELECT * FROM state_runs WHERE state = 1)")}) JOIN bounds USING (site_id)""", "duration_min peak_value")
def e3(spark, sf):
    """Readings -> sequences -> states -> runs -> episodes, past the bounds of the training days."""
    r = readings(spark, sf)
    train = W.chrono_split(r, KEYS, "ts", by="day").filter("split = 'train'")
    names = {n: n for n in ("mild_lower", "mild_upper", "extreme_lower", "extreme_upper")}
    rows = _decoded(_fixed_sequences(spark, sf), FIXED).join(Q.tukey(train, KEYS, "temperature").select(*KEYS, *names), KEYS)
    return E.state_episodes(rows, KEYS, "ts", "temperature", names, H.observation_bounds(r, KEYS, "ts"),
                            F.concat(F.lit("U"), F.col("site_id")), block_seconds=block(spark, sf))


@query("t4_top_features", "", """
SELECT event_type AS feature, CAST(row_number() OVER (ORDER BY m DESC, event_type) AS INTEGER) AS place
FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) QUALIFY place <= 3""")
def t4(spark, sf):
    """The importance vector is the mean value of each event type: one entry a type."""
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("m")).orderBy("event_type").collect()
    top = FC.top_features([r["m"] for r in rows], [r["event_type"] for r in rows], 3)
    return spark.createDataFrame([(f, i) for i, f in enumerate(top, 1)], "feature string, place int")


@query("m6_isolation_forest")
def m6(spark, sf):
    """Scores and the dominant category of every alarm event."""
    kinds = A.dominant(categorise(alarm_events(spark, sf), "message"), EVENT_KEYS, "category")
    ev = durable_checkpoint(events(spark, sf).join(kinds, EVENT_KEYS))
    forest = iforest.fit_isolation(ev, row_id=["site_id", "alarm_event"])
    return iforest.score_isolation(ev, forest).select("site_id", "alarm_event", "is_anomaly", "score", "dominant_category")


#: Two small trees over (total_alarms, duration_sec), so that scores have a SQL counterpart.
FIXED_FOREST = iforest.Forest(
    ["total_alarms", "duration_sec"], hmm.Scaler([0.0, 0.0], [1.0, 1.0]),
    [tuple(hmm.np.array(x) for x in ([0, -1, 1, -1, -1], [3.0, 0.0, 600.0, 0.0, 0.0], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0.0, 2.0, 0.0, 2.5, 1.0])),
     tuple(hmm.np.array(x) for x in ([1, -1, -1], [60.0, 0.0, 0.0], [1, -1, -1], [2, -1, -1], [0.0, 3.0, 1.5]))], 8, -0.5)
FOREST_SQL = """
SELECT site_id, alarm_event, score < 0 AS is_anomaly, score FROM (
  SELECT site_id, alarm_event, 0.5 - pow(2.0::DOUBLE, -((CASE WHEN total_alarms <= 3 THEN 2.0 WHEN duration_sec <= 600 THEN 2.5 ELSE 1.0 END
         + CASE WHEN duration_sec <= 60 THEN 3.0 ELSE 1.5 END) / 2)::DOUBLE / (2 * (ln(7.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 14.0::DOUBLE / 8)) AS score
  FROM event_features)"""


@query("m6_score_fixed_forest", "event_features", FOREST_SQL, "score")
def m6_fixed(spark, sf):
    return iforest.score_isolation(events(spark, sf), FIXED_FOREST).select("site_id", "alarm_event", "is_anomaly", "score")


@query("m6_isolation_embeddings")
def m6_embeddings(spark, sf):
    rows = durable_checkpoint(_embeddings(spark, sf))
    forest = iforest.fit_isolation(rows, _DIMS, row_id=["vec_id"])
    return iforest.score_isolation(rows, forest).select("vec_id", "is_anomaly", "score")


# --- forecast protocol ---------------------------------------------------------------------
_M10 = ("mae rmse r2 delta_mae major_drop_mae severe_drop_mae high_risk_precision high_risk_recall predicted_min predicted_max residual_std")


@query("m10_eval_persistence", "scored", """
SELECT site_id, count(*) AS n, avg(abs(a - c)) AS mae, sqrt(avg((a - c) * (a - c))) AS rmse, 1 - sum((a - c) * (a - c)) / (var_pop(a) * count(*)) AS r2,
       avg(abs(a - c)) AS delta_mae, avg(abs(a - c)) FILTER (WHERE a - c <= -10) AS major_drop_mae, avg(abs(a - c)) FILTER (WHERE a - c <= -20) AS severe_drop_mae,
       count(*) FILTER (WHERE a < 60 AND c < 60) / nullif(count(*) FILTER (WHERE c < 60), 0) AS high_risk_precision,
       count(*) FILTER (WHERE a < 60 AND c < 60) / nullif(count(*) FILTER (WHERE a < 60), 0) AS high_risk_recall,
       min(c) AS predicted_min, max(c) AS predicted_max, stddev_pop(a - c) AS residual_std
FROM (SELECT site_id, overall_site_health AS c, lead(overall_site_health, 6) OVER (PARTITION BY site_id ORDER BY timestamp) AS a FROM scored)
WHERE a IS NOT NULL GROUP BY site_id""", _M10)
def m10(spark, sf):
    rows = W.targets(scored(spark, sf), KEYS, "timestamp").filter("target_health_6h IS NOT NULL")
    return FC.eval_delta(rows, "overall_site_health", "target_health_6h", F.lit(0.0), KEYS)


cte("probs", "", """
SELECT CASE WHEN value >= 80 THEN 1 ELSE 0 END AS y, round((0.3 * (value / 500) + 0.7 * (user_id % 50) / 50.0)::DOUBLE, 3) AS p FROM events""")


def _probs(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select((v >= 80).cast("int").alias("y"), F.round(
        0.3 * (v / 500) + 0.7 * (F.col("user_id") % 50) / 50.0, 3).alias("p"))


@query("m11_eval_classifier", "probs", """
SELECT 0.4::DOUBLE AS threshold, coalesce(tp / nullif(said, 0), 0) AS precision, tp / real AS recall, 2.0 * tp / (said + real) AS f1, CAST(said AS BIGINT) AS predicted_alerts,
       CAST(real AS BIGINT) AS actual_events, roc_auc, pr_auc
FROM (SELECT count(*) FILTER (WHERE p >= 0.4 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.4) AS said, count(*) FILTER (WHERE y = 1) AS real FROM probs)
CROSS JOIN (SELECT (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
                   / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS roc_auc
            FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM probs))
CROSS JOIN (SELECT sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc FROM (SELECT pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
            FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM probs GROUP BY p) WINDOW w AS (ORDER BY p DESC)))""",
       "threshold precision recall f1 roc_auc pr_auc")
def m11(spark, sf):
    return FC.eval_classifier(_probs(spark, sf), "y", "p", 0.4)


@query("m9_threshold_sweep", "probs", """
SELECT t::DOUBLE AS threshold, coalesce(tp / nullif(said, 0), 0) AS precision, tp / real AS recall, 2.0 * tp / (said + real) AS f1,
       CAST(said AS BIGINT) AS predicted_alerts, CAST(real AS BIGINT) AS actual_events
FROM (SELECT t, count(*) FILTER (WHERE p >= t AND y = 1) AS tp, count(*) FILTER (WHERE p >= t) AS said, count(*) FILTER (WHERE y = 1) AS real
      FROM probs CROSS JOIN (SELECT unnest([%s]::DOUBLE[]) AS t) GROUP BY t)""" % ", ".join(map(str, K.DROP_THRESHOLDS)),
       "threshold precision recall f1")
def m9_sweep(spark, sf):
    return FC.threshold_metrics(_probs(spark, sf), "y", "p", K.DROP_THRESHOLDS)


@query("m8_drop_weights", "scored", """
SELECT site_id, timestamp, CASE WHEN d <= -20 THEN 2.5 WHEN d <= -10 THEN 1.75 WHEN d <= -5 THEN 1.25 ELSE 1.0 END::DOUBLE AS weight
FROM (SELECT site_id, timestamp, lead(overall_site_health, 6) OVER (PARTITION BY site_id ORDER BY timestamp) - overall_site_health AS d FROM scored)
WHERE d IS NOT NULL""", "weight")
def m8_weights(spark, sf):
    rows = W.targets(scored(spark, sf), KEYS, "timestamp").filter("target_health_change_6h IS NOT NULL")
    return rows.select("site_id", "timestamp", FC.drop_weight().alias("weight"))


_SOURCES = ["overall_site_health", "energy_risk_score"]


def frame_hourly(spark, sf):
    keep = [c for c in dict.fromkeys([*K.CURRENT_FEATURES, *K.TRAJECTORY_SOURCES])]
    return durable_checkpoint(scored(spark, sf).select("site_id", "timestamp", *keep))


cte("scored_index", "scored", "SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY timestamp) AS DOUBLE) AS i FROM scored")


def _frame_sql():
    """Expression by feature name, in no particular order; only whether it is null matters for its count."""
    o = "OVER (PARTITION BY site_id ORDER BY timestamp"
    full = lambda c, n: f"CASE WHEN count({c}) {o} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n} THEN 1 END"
    health, out = "overall_site_health", {c: c for c in K.CURRENT_FEATURES}
    base = {f"overall_health_lag_{n}h": f"lag({health}, {n}) {o})" for n in K.HEALTH_LAGS}
    base |= {f"health_{k}_{n}h": full(health, n) for n in K.HEALTH_WINDOWS for k in ("mean", "std", "min")}
    base |= {f"{c}_lag_{n}h": f"lag({c}, {n}) {o})" for c in K.SUBSYSTEM_HEALTH for n in K.SUBSYSTEM_LAGS}
    base |= {f"overall_health_change_{n}h": f"{health} - lag({health}, {n}) {o})" for n in K.HEALTH_CHANGES}
    hourly_columns = {*K.CURRENT_FEATURES, *K.TRAJECTORY_SOURCES}
    for c in K.TRAJECTORY_SOURCES:
        out |= {n: e for n, e in trajectory_sql(c).items() if n not in base and n not in hourly_columns}
    products = {"energy_battery_risk": ("energy_risk_score", "battery_risk_score"), "environmental_energy_risk": ("environmental_risk_score", "energy_risk_score"),
                "environmental_battery_risk": ("environmental_risk_score", "battery_risk_score"),
                "energy_battery_anomaly_burden": ("energy_anomaly_burden", "battery_anomaly_burden")}
    cross = {f"interaction_{n}": f"{x} * {y}" for n, (x, y) in products.items()}
    cross |= {"max_subsystem_risk": f"coalesce({', '.join(K.SUBSYSTEM_RISK)})"}
    cross |= {n: f"coalesce({', '.join(K.SUBSYSTEM_HEALTH)})" for n in ("min_subsystem_health", "subsystem_health_spread")}
    never_null = [*FC.STREAKS, "subsystems_below_80", "subsystems_below_60", *FC.CALENDAR]
    return out | base | cross | {n: "1" for n in never_null}


_FRAME = _frame_sql()


@query("m12_model_frame", "scored_index", f"""
SELECT site_id, unnest([{", ".join(f"{{'feature': '{n}', 'filled': count(x{i})}}" for i, n in enumerate(_FRAME))}], recursive := true)
FROM (SELECT site_id, {", ".join(f"{e} AS x{i}" for i, e in enumerate(_FRAME.values()))}
      FROM (SELECT *, overall_site_health_smoothed AS overall_site_health_smoothed_6h, energy_risk_score AS energy_risk_score_calibrated FROM scored_index)) GROUP BY site_id""")
def m12(spark, sf):
    """Every feature of every source (about 1,100 columns), reduced to its filled-in count."""
    frame, names = FC.model_frame(frame_hourly(spark, sf), KEYS)
    wide = frame.groupBy(*KEYS).agg(*[F.count(n).alias(n) for n in names])
    return wide.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("filled")) for n in names])
                                        ).alias("r")).select(*KEYS, "r.*")


@query("m13_pruned_frame", "scored_index", f"""
SELECT site_id, timestamp, {trajectory_sql('overall_site_health')['overall_site_health_slope_6h']} AS overall_site_health_slope_6h,
       {trajectory_sql('energy_risk_score')['energy_risk_score_rollmean_12h']} AS energy_risk_score_rollmean_12h FROM scored_index""",
       "overall_site_health_slope_6h energy_risk_score_rollmean_12h")
def m13(spark, sf):
    wanted = ["overall_site_health_slope_6h", "energy_risk_score_rollmean_12h"]
    assert FC.required_sources(wanted) == _SOURCES
    frame, _ = FC.model_frame(frame_hourly(spark, sf), KEYS, FC.required_sources(wanted))
    return frame.select("site_id", "timestamp", *wanted)


#: Cuts of m8 against the operator's defaults (2,000 rounds, patience 100).
ROUNDS, PATIENCE = 30, 15

cte("usable", "scored", f"""
SELECT *, CASE WHEN rk <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rk <= floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT site_id, timestamp, c, a, row_number() OVER (PARTITION BY site_id ORDER BY timestamp) AS rk, count(*) OVER (PARTITION BY site_id) AS n
      FROM (SELECT site_id, timestamp, overall_site_health AS c, lead(overall_site_health, 6) OVER w AS a, lag(overall_site_health, 1) OVER w AS l1,
                   lag(overall_site_health, 6) OVER w AS l6, lag(overall_site_health, 24) OVER w AS l24 FROM scored WINDOW w AS (PARTITION BY site_id ORDER BY timestamp))
      WHERE a IS NOT NULL AND c IS NOT NULL AND l1 IS NOT NULL AND l6 IS NOT NULL AND l24 IS NOT NULL)""")
_PROTOCOL = """
SELECT 'rows ' || split AS metric, count(*)::DOUBLE AS value FROM usable GROUP BY split
UNION ALL SELECT 'persistence mae', avg(abs(a - c)) FROM usable WHERE split = 'test'"""


#: What the selection of m7 tends to keep; the refits of m8 and m9 begin with a selection.
_SELECTED = ["overall_site_health", "overall_health_lag_1h", "overall_health_lag_6h", "overall_health_lag_24h", "health_mean_6h", "health_mean_24h",
             "health_std_24h", "health_min_24h", "overall_health_change_1h", "overall_health_change_6h", "energy_risk_score", "battery_risk_score",
             "environmental_risk_score", "energy_risk_score_rollmean_12h", "energy_risk_score_rollstd_12h", "overall_site_health_slope_6h",
             "max_subsystem_risk", "min_subsystem_health", "hour_sin", "hour_cos"]


def _selected(spark, sf):
    frame, names = FC.model_frame(frame_hourly(spark, sf), KEYS, FC.required_sources(_SELECTED))
    assert set(_SELECTED) <= set(names), set(_SELECTED) - set(names)
    keep = [*KEYS, "timestamp", *K.REQUIRED_FEATURES, "target_health_6h", FC.TARGET, "major_drop_6h", *_SELECTED]
    return durable_checkpoint(frame.select(*dict.fromkeys(keep)))


def _fit(frame, names, **options):
    return FC.fit_delta(frame, names, KEYS, rounds=ROUNDS, patience=PATIENCE, **options)


def _protocol_rows(model):
    by, trees = model.metrics["validation_mae_by_count"], model.metrics["trees_by_count"]
    return [*[(f"rows {k}", float(n)) for k, n in model.n_rows.items()], ("persistence mae", float(model.metrics["persistence"]["mae"])),
            ("the chosen count has the least validation error", float(by[len(model.features)] == min(by.values()))),
            ("every model has more than one tree", float(min(trees.values()) > 1))]


@query("m7_fit_delta", "usable", _PROTOCOL + """
UNION ALL SELECT 'the chosen count has the least validation error', 1.0 UNION ALL SELECT 'every model has more than one tree', 1.0""", "value")
def m7(spark, sf):
    """Ranking over all sources, all feature counts, choice. Returned are the protocol's facts; the fitted errors are the model's own."""
    frame, names = FC.model_frame(frame_hourly(spark, sf), KEYS)
    return spark.createDataFrame(_protocol_rows(FC.fit_delta(frame, names, KEYS)), "metric string, value double")


@query("m8_fit_delta_weighted", "usable", _PROTOCOL + " UNION ALL SELECT 'the weights change the model', 1.0", "value")
def m8(spark, sf):
    frame = _selected(spark, sf)
    model = _fit(frame, _SELECTED, counts=(len(_SELECTED),))
    weighted, _ = FC.fit_weighted(frame, model, rounds=ROUNDS, patience=PATIENCE)
    facts = [r for r in _protocol_rows(weighted) if not r[0].startswith(("the ", "every "))]
    changed = weighted.model.as_json() != model.model.as_json() and set(weighted.features) == set(model.features)
    return spark.createDataFrame([*facts, ("the weights change the model", float(changed))], "metric string, value double")


@query("m9_fit_drop", "usable", """
SELECT 'drops in the test hours' AS metric, (count(*) FILTER (WHERE a - c <= -10))::DOUBLE AS value FROM usable WHERE split = 'test'
UNION ALL SELECT 'the threshold is a candidate', 1.0""", "value")
def m9(spark, sf):
    frame = _selected(spark, sf)
    train = W.chrono_split(FC.usable_rows(frame), KEYS, "timestamp").filter("split = 'train'")
    model = FC.DeltaModel(FIXED_DELTA, _SELECTED, A.feature_medians(train, KEYS, _SELECTED), list(KEYS), SIGMA)
    _, threshold, report = FC.fit_drop(frame, model)
    return spark.createDataFrame([("drops in the test hours", float(report.get("actual_events", 0))),   # none without test hours
                                  ("the threshold is a candidate", float(threshold in K.DROP_THRESHOLDS))], "metric string, value double")


# --- serving a fixed model: every step has its SQL ------------------------------------------
_T = FC.boosting.Tree
FIXED_DELTA = FC.boosting.Boosted(0.1, [
    _T([0, -1, 1, -1, -1], [80.0, 0.0, 85.0, 0.0, 0.0], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0.0, 1.5, 0.0, -2.0, -0.5]),
    _T([2, -1, -1], [0.3, 0.0, 0.0], [1, -1, -1], [2, -1, -1], [0.0, 0.25, -1.0])], [0.4, 0.3, 0.3])
_FIXED_FEATURES = {"overall_site_health": 80.0, "overall_health_lag_6h": 82.0, "energy_risk_score": 0.2}
_DELTA = ("(0.1 + CASE WHEN coalesce({h}, 80) <= 80 THEN 1.5 WHEN coalesce({l}, 82) <= 85 THEN -2.0 ELSE -0.5 END"
          " + CASE WHEN coalesce({r}, 0.2) <= 0.3 THEN 0.25 ELSE -1.0 END)::DOUBLE")
SIGMA = 4.0


def served_model(spark, sf):
    """Hourly table and the fixed model, with medians for every site."""
    hourly = frame_hourly(spark, sf)
    medians = hourly.select(*KEYS).distinct().withColumns({c: F.lit(v) for c, v in _FIXED_FEATURES.items()})
    return hourly, FC.DeltaModel(FIXED_DELTA, list(_FIXED_FEATURES), medians, list(KEYS), SIGMA)


cte("newest", "scored", """
SELECT site_id, timestamp, overall_site_health AS h, energy_risk_score AS r, xs[-7] AS l, list_slice(xs, -7, -1) AS xs FROM (
  SELECT *, list(overall_site_health) OVER (PARTITION BY site_id ORDER BY timestamp ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS xs FROM scored)
QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY timestamp DESC) = 1""")
PREDICTED = f"""
SELECT site_id, timestamp, d AS predicted_delta, greatest(0, least(100, h + d))::DOUBLE AS predicted_health
FROM (SELECT *, {_DELTA.format(h="h", l="l", r="r")} AS d FROM newest)"""


@query("m14_predict_next", "newest", PREDICTED, "predicted_delta predicted_health")
def m14(spark, sf):
    hourly, model = served_model(spark, sf)
    return FC.predict_next(hourly, model)


cte("rec_unrolled", "newest", f"""
SELECT site_id, 0 AS i, timestamp, xs, r, h AS value FROM newest
UNION ALL
SELECT site_id, i + 1, timestamp + INTERVAL 6 HOUR, list_append(xs[2:], v), r, v
FROM (SELECT *, greatest(0, least(100, xs[-1] + {_DELTA.format(h="xs[-1]", l="xs[-7]", r="r")} * pow(0.5::DOUBLE, i)))::DOUBLE AS v FROM rec_unrolled WHERE i < 120)""")
cte("unrolled", "rec_unrolled", f"""
SELECT site_id, i, timestamp, value, CASE WHEN i = 0 THEN value ELSE greatest(0, value - {SIGMA} * sqrt(i)) END::DOUBLE AS lower,
       CASE WHEN i = 0 THEN value ELSE least(100, value + {SIGMA} * sqrt(i)) END::DOUBLE AS upper FROM rec_unrolled""")


@query("m15_forecast_recursive", "unrolled", "SELECT site_id, timestamp, value, lower, upper FROM unrolled WHERE i > 0", "value lower upper")
def m15(spark, sf):
    hourly, model = served_model(spark, sf)
    return FC.forecast_recursive(hourly, model, 720)


def _unrolled_points(name, hours, step, count):
    past = f"""
SELECT site_id, '{name}' AS horizon, last - to_hours({step} * behind) AS timestamp, avg(x) AS value, avg(x) AS lower, avg(x) AS upper, false AS is_forecast
FROM (SELECT s.site_id, overall_site_health AS x, n.timestamp AS last, CAST(floor(date_diff('hour', s.timestamp, n.timestamp) / {step}.0) AS BIGINT) AS behind
      FROM scored s JOIN newest n USING (site_id)) WHERE behind < {count} GROUP BY site_id, last, behind"""
    if step == 1:
        mix = lambda c: f"a.{c} + (coalesce(b.{c}, a.{c}) - a.{c}) * (k % 6) / 6.0"
        return past + f"""
UNION ALL SELECT a.site_id, '{name}', n.timestamp + to_hours(k), {mix('value')}, {mix('lower')}, {mix('upper')}, true
FROM unrolled a JOIN newest n USING (site_id) JOIN (SELECT unnest(generate_series(1, {hours})) AS k) ON a.i = k // 6
     LEFT JOIN unrolled b ON b.site_id = a.site_id AND b.i = a.i + 1"""
    return past + f"""
UNION ALL SELECT site_id, '{name}', last + to_hours(k * {step}), avg(value), avg(lower), avg(upper), true
FROM (SELECT u.*, n.timestamp AS last, (u.i * 6) // {step} AS k FROM unrolled u JOIN newest n USING (site_id) WHERE u.i * 6 <= {hours})
WHERE k >= 1 GROUP BY site_id, last, k"""


@query("m16_model_forecast_points", "scored newest unrolled", f"""
SELECT site_id, horizon, timestamp, round_even(value * 100, 0) / 100 AS value, round_even(lower * 100, 0) / 100 AS lower,
       round_even(upper * 100, 0) / 100 AS upper, is_forecast FROM ({" UNION ALL ".join(_unrolled_points(n, *h) for n, h in K.HORIZONS.items())})""",
       "value lower upper")
def m16(spark, sf):
    hourly, model = served_model(spark, sf)
    slim = hourly.select("site_id", "timestamp", "overall_site_health")
    return FC.forecast_points(slim, durable_checkpoint(FC.forecast_recursive(hourly, model, 720)), KEYS)
