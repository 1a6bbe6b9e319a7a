"""Segments, sequences, alarm events, runs and hysteresis episodes.

All of them order a raw series, so all of them work on ``(key, time block)`` tasks; see
:mod:`fieldwatch.operators.timeblocks`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import flag
from .timeblocks import (DAY, HALO, SCAN_COLUMNS, US, block_window, carry, dealt, drop_helpers,
                         scan_breaks, with_blocks, with_halo)


def _micros(seconds: float) -> Column:
    return F.lit(int(round(seconds * 1e6)))


def _gap_break(max_gap: float):
    return lambda prev, cur: prev.isNull() | (cur - prev > _micros(max_gap))


def add_segments(df: DataFrame, keys: Sequence[str], ts: str,
                 max_gap: float = K.READING_GAP_SECONDS, block_seconds: float = DAY,
                 ties: Sequence[str] = ()) -> DataFrame:
    """Continuous segments: a gap above ``max_gap`` seconds (or the first row) opens one.

    Adds ``segment_id`` (from 1), ``segment_position`` (from 0), ``is_discontinuity`` and
    ``segment_start``, which with the key is the identity that survives late data.
    """
    rows = scan_breaks(dealt(with_blocks(df, ts, block_seconds), keys, block_seconds), keys, F.col(US),
                       _gap_break(max_gap), order=(US, *ties))
    out = rows.withColumns({
        "segment_id": F.col("_number").cast("bigint"),
        "segment_position": F.col("_since").cast("bigint"),
        "is_discontinuity": F.col("_break"),
        "segment_start": F.timestamp_micros("_head_us").cast("timestamp_ntz")})
    return drop_helpers(out, *SCAN_COLUMNS)


def add_events(df: DataFrame, keys: Sequence[str], ts: str, gap: float = K.ALARM_GAP_SECONDS,
               block_seconds: float = DAY, ties: Sequence[str] = ()) -> DataFrame:
    """Alarm events: a gap above ``gap`` seconds starts the next one; ids count from 0."""
    rows = scan_breaks(dealt(with_blocks(df, ts, block_seconds), keys, block_seconds), keys, F.col(US), _gap_break(gap),
                       order=(US, *ties))
    out = rows.withColumn("event_id", (F.col("_number") - 1).cast("bigint"))
    return drop_helpers(out, *SCAN_COLUMNS)


def add_sequences(df: DataFrame, keys: Sequence[str], ts: str, required: Sequence[str],
                  max_gap: float = K.READING_GAP_SECONDS, min_len: int = 2,
                  segment: str = "segment_id", block_seconds: float = DAY) -> DataFrame:
    """Model sequences over complete rows; sequences below ``min_len`` rows are dropped."""
    complete = df.na.drop(subset=list(required)) if required else df

    def is_break(prev: Column, cur: Column) -> Column:
        return (prev.isNull() | (cur["us"] - prev["us"] > _micros(max_gap))
                | (cur["segment"] != prev["segment"]))

    # a short sequence fits into the halo, so its true length is visible locally
    reach = max_gap * min_len
    framed = dealt(with_halo(complete, ts, reach, block_seconds, look_ahead=reach), keys, block_seconds)
    w = block_window(keys)
    previous = F.struct(F.lag(US).over(w).alias("us"), F.lag(segment).over(w).alias("segment"))
    now = F.struct(F.col(US).alias("us"), F.col(segment).alias("segment"))
    starts = F.lag(US).over(w).isNull() | is_break(previous, now)
    framed = framed.withColumn("_local", F.sum(flag(starts)).over(
        w.rowsBetween(W.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(W.partitionBy(*keys, "_block", "_local"))
    kept = (framed.withColumn("_size", size)
                  .filter(~F.col(HALO) & (F.col("_size") >= min_len)).drop("_local", "_size"))
    rows = scan_breaks(kept, keys, now, is_break)
    out = rows.withColumns({"sequence_id": F.col("_number").cast("bigint"),
                            "sequence_position": F.col("_since").cast("bigint"),
                            "sequence_start": F.timestamp_micros("_head_us").cast("timestamp_ntz")})
    return drop_helpers(out, *SCAN_COLUMNS)


def add_runs(df: DataFrame, keys: Sequence[str], ts: str, flag_col: str,
             segment: str = "segment_id", block_seconds: float = DAY) -> DataFrame:
    """Contiguous rows with the same flag in the same segment share a ``run_id``."""
    state = F.struct(F.col(flag_col).alias("flag"), F.col(segment).alias("segment"))
    rows = scan_breaks(dealt(with_blocks(df, ts, block_seconds), keys, block_seconds), keys, state,
                       lambda p, c: p.isNull() | ~p.eqNullSafe(c))
    out = rows.withColumns({"run_id": F.col("_number").cast("bigint"),
                            "run_start": F.timestamp_micros("_head_us").cast("timestamp_ntz")})
    return drop_helpers(out, *SCAN_COLUMNS)


def run_length(df: DataFrame, keys: Sequence[str], ts: str, flag_col: str,
               out: str = "run_length") -> DataFrame:
    """Consecutive 1s up to this row, 0 on a 0.  For gridded series (bounded per key)."""
    w = W.partitionBy(*keys).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    number = F.row_number().over(W.partitionBy(*keys).orderBy(ts))
    last_zero = F.max(F.when(F.coalesce(F.col(flag_col), F.lit(0)) == 0, F.col("_rn"))).over(w)
    return (df.withColumn("_rn", number)
              .withColumn(out, (F.col("_rn") - F.coalesce(last_zero, F.lit(0))).cast("bigint"))
              .drop("_rn"))


def streaks(df: DataFrame, keys: Sequence[str], ts: str, falling: Sequence[str],
            rising: Sequence[str]) -> DataFrame:
    """Hours each ``falling`` column has kept falling and each ``rising`` one kept rising."""
    order = W.partitionBy(*keys).orderBy(ts)
    named = [(c, f"{c}_consecutive_decline_hours", lambda d: d < 0) for c in falling]
    named += [(c, f"{c}_consecutive_increase_hours", lambda d: d > 0) for c in rising]
    df = df.withColumns({f"_m_{out}": flag(F.coalesce(test(F.col(c) - F.lag(c).over(order)),
                                                      F.lit(False)))
                         for c, out, test in named})
    for _, out, _ in named:
        df = run_length(df, keys, ts, f"_m_{out}", out)
    return df.drop(*[f"_m_{out}" for _, out, _ in named])


def hysteresis(df: DataFrame, keys: Sequence[str], ts: str, value: str, enter: str | float,
               exit: str | float, direction: str = "high",
               min_exit: int = K.HYSTERESIS_EXIT_ROWS, segment: str = "segment_id",
               position: str = "segment_position", max_gap: float = K.READING_GAP_SECONDS,
               out: str = "episode_id", block_seconds: float = DAY) -> DataFrame:
    """Episodes that open at ``enter`` and close after ``min_exit`` rows back past ``exit``.

    The closing rows still belong; a missing value closes at once; each segment starts
    closed; ids run over the whole series (0 = outside).  ``enter`` / ``exit`` are numbers
    or column names; they must not overlap.
    """
    if not isinstance(enter, str) and not isinstance(exit, str):
        if (exit >= enter) if direction == "high" else (exit <= enter):
            raise ValueError("the exit threshold must lie strictly inside the enter threshold")
    at = lambda c: F.col(c) if isinstance(c, str) else F.lit(float(c))
    v = F.col(value)
    enters = (v >= at(enter)) if direction == "high" else (v <= at(enter))
    leaves = (v <= at(exit)) if direction == "high" else (v >= at(exit))
    framed = dealt(with_halo(df, ts, max_gap * (min_exit - 1), block_seconds), keys, block_seconds)
    recent = block_window(keys, segment).rowsBetween(-(min_exit - 1), 0)
    left = F.sum(flag(F.coalesce(leaves, F.lit(False)))).over(recent) >= min_exit
    rows = framed.withColumn("_left", left).filter(~F.col(HALO))
    first = F.col(position) == 0
    mode = F.when(v.isNull(), 0).when(enters, 1).when(F.col("_left"), 0).when(first, 0)
    rows = rows.withColumn("_enter", F.coalesce(enters, F.lit(False))).withColumn("_mode", mode)
    # NULL mode = undecided row: it keeps the state of the row before it
    state = F.when(F.col("_mode").isNotNull(), F.struct(F.col("_mode").alias("mode"),
                                                        first.alias("first")))
    rows = scan_breaks(rows, keys, state, lambda p, c: (c["mode"] == 1) & (
        c["first"] | p.isNull() | (p["mode"] == 0)))
    was_open = ~first & (F.coalesce(F.col("_prev.mode"), F.lit(0)) == 1)
    inside = v.isNotNull() & (F.col("_enter") | was_open)
    out_df = rows.withColumn(out, F.when(inside, F.col("_number")).otherwise(0).cast("bigint"))
    return drop_helpers(out_df, *SCAN_COLUMNS, "_left", "_enter", "_mode")


def threshold_labels(df: DataFrame, keys: Sequence[str], ts: str,
                     thresholds: Mapping[str, Mapping[str, str | float]],
                     margins: Mapping[str, float] = K.HYSTERESIS_MARGIN,
                     min_exit: int = K.HYSTERESIS_EXIT_ROWS, segment: str = "segment_id",
                     position: str = "segment_position",
                     max_gap: float = K.READING_GAP_SECONDS,
                     block_seconds: float = DAY) -> DataFrame:
    """0/1 ``target_<variable>_<side>`` labels and their maximum ``target_any``.

    ``thresholds``: variable -> {"mild_upper": column or number, "mild_lower": ...}.
    Labels need membership only, not episode ids, so all of them share one pass.
    """
    at = lambda c: F.col(c) if isinstance(c, str) else F.lit(float(c))
    framed = dealt(with_halo(df, ts, max_gap * (min_exit - 1), block_seconds), keys, block_seconds)
    recent = block_window(keys, segment).rowsBetween(-(min_exit - 1), 0)
    first = F.col(position) == 0
    names, enters, modes = [], {}, {}
    for variable, bound in thresholds.items():
        v, margin = F.col(variable), F.lit(float(margins[variable]))
        upper, lower = at(bound["mild_upper"]), at(bound["mild_lower"])
        for side, enter, leave in (("high", v >= upper, v <= upper - margin),
                                   ("low", v <= lower, v >= lower + margin)):
            name = f"target_{variable}_{side}"
            names.append(name)
            enters[f"_e_{name}"] = F.coalesce(enter, F.lit(False))
            left = F.sum(flag(F.coalesce(leave, F.lit(False)))).over(recent) >= min_exit
            modes[f"_m_{name}"] = F.when(v.isNull(), 0).when(enter, 1).when(left, 0).when(first, 0)
    rows = framed.withColumns({**enters, **modes}).filter(~F.col(HALO))
    w = block_window(keys)
    rows = rows.withColumns({f"_p_{n}": F.last(f"_m_{n}", ignorenulls=True).over(
        w.rowsBetween(W.unboundedPreceding, -1)) for n in names})
    rows = carry(rows, keys, US, lasts={f"_c_{n}": F.col(f"_m_{n}") for n in names})
    for variable in thresholds:
        for name in (f"target_{variable}_high", f"target_{variable}_low"):
            was_open = ~first & (F.coalesce(f"_p_{name}", f"_c_{name}", F.lit(0)) == 1)
            rows = rows.withColumn(name, flag(F.col(variable).isNotNull()
                                              & (F.col(f"_e_{name}") | was_open)))
    rows = rows.withColumn("target_any", F.greatest(*names))
    return drop_helpers(rows, *[f"_{k}_{n}" for k in "empc" for n in names])
