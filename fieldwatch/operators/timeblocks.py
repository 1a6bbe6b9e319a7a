"""Sequential work on long series without a per-series task.

One sensor may hold a third of all readings, so nothing here partitions a raw series by
its key alone.  A series is cut into fixed time blocks and tasks work on ``(key, block)``:

* look-back of bounded time  -> ``with_halo``: rows near a block's end are copied into the
  following blocks they can influence, and dropped again after the window ran;
* unbounded look-back (running counts, last known state) -> ``carry``: every block is
  reduced to one summary row, a prefix over these summary rows (one per key and block)
  yields what each block must know from earlier ones, and it is joined back on
  ``(key, block)``.

Only the summaries are ever ordered by key alone: their number is the series' time span
divided by the block width.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import flag
from ..functions.time import epoch_us, floor_div
from ..session import durable_checkpoint

BLOCK, HALO, US = "_block", "_halo", "_us"
DAY = 86_400.0
BLOCK_ROWS = 100_000   # rows of a block that a task takes easily
GRID_ROWS = 1024       # gridded rows of a block that hundreds of windows run over


def with_blocks(df: DataFrame, ts: str, block_seconds: float = DAY) -> DataFrame:
    us = epoch_us(ts)
    return df.withColumn(US, us).withColumn(BLOCK, floor_div(us, int(block_seconds * 1e6)))


class Width(float):
    """Seconds of a block, and how many tasks dense blocks are dealt to (0: as many as Spark sees fit)."""

    def __new__(cls, seconds: float, tasks: int = 0) -> Width:
        width = super().__new__(cls, seconds)
        width.tasks = tasks
        return width


def dealt(df: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Blocks of a dense series by their id: sizes after compression say little about the rows that a task must sort."""
    tasks = getattr(width, "tasks", 0)
    return df.repartition(tasks, *keys, BLOCK) if tasks else df


def fitting_width(df: DataFrame, keys: Sequence[str], ts: str, widest: float, least: float = 0.0,
                  rows: int = BLOCK_ROWS, halvings: int = 12) -> Width:
    """The widest of ``widest``, its half, its quarter, ... seconds whose densest ``(key, block)`` holds at most ``rows`` rows.

    Not below ``least`` (the look-back that is copied into each block) nor after ``halvings``. One pass counts the rows
    of the narrowest blocks; only the largest count of each width comes back.
    """
    us = int(widest * 1e6)
    while halvings and (us % (1 << halvings) or us >> halvings < least * 1e6):
        halvings -= 1
    narrow = df.groupBy(*keys, floor_div(epoch_us(ts), us >> halvings).alias(BLOCK)).agg(F.count(F.lit(1)).alias("_n"))
    level = F.explode(F.sequence(F.lit(0), F.lit(halvings))).alias("_level")
    wider = narrow.select(*keys, BLOCK, "_n", level).groupBy(*keys, "_level", F.expr(f"shiftright({BLOCK}, _level)").alias(BLOCK)).agg(F.sum("_n").alias("_n"))
    wider = wider.filter(F.col(BLOCK).isNotNull())   # rows without a time have no block to be cut
    found = wider.groupBy("_level").agg(F.max("_n").alias("most"), F.sum("_n").alias("all")).collect()
    if not found:
        return Width(widest)
    level = max((r["_level"] for r in found if r["most"] <= rows), default=0)
    return Width((us >> halvings << level) / 1e6, 0 if level == halvings else 2 * found[0]["all"] // max(rows, 1) + 1)


def with_halo(df: DataFrame, ts: str, look_back: float, block_seconds: float = DAY,
              look_ahead: float = 0.0) -> DataFrame:
    """Rows in their own block plus copies in each block they can influence."""
    width = int(block_seconds * 1e6)
    us = F.col(US)
    first = floor_div(us - F.lit(int(look_ahead * 1e6)), width)
    last = floor_div(us + F.lit(int(look_back * 1e6)), width)
    return (df.withColumn(US, epoch_us(ts))
              .withColumn(BLOCK, F.explode(F.sequence(first, last)))
              .withColumn(HALO, F.col(BLOCK) != floor_div(us, width)))


def row_blocks(df: DataFrame, keys: Sequence[str], number: str, look_back: int, look_ahead: int, rows: int = GRID_ROWS) -> DataFrame:
    """``rows`` rows of a key by their ``number`` (from 1), plus copies in each block they can influence.

    For windows that are wide rather than long: blocks are dealt to tasks by their id, as in `dealt`.
    """
    at = F.col(number) - 1
    first = F.greatest(floor_div(at - look_ahead, rows), F.lit(0))
    df = df.withColumn(BLOCK, F.explode(F.sequence(first, floor_div(at + look_back, rows))))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn(HALO, F.col(BLOCK) != floor_div(at, rows)).repartition(tasks, *keys, BLOCK)


def block_window(keys: Sequence[str], *extra: str, order: Sequence[str | Column] = (US,)) -> W:
    return W.partitionBy(*keys, BLOCK, *extra).orderBy(*order)


def carry(df: DataFrame, keys: Sequence[str], order: Column | str,
          sums: Mapping[str, Column] | None = None,
          lasts: Mapping[str, Column] | None = None) -> DataFrame:
    """Attach to each row what earlier blocks of its series hold.

    ``sums``: total of the expression over all earlier blocks (0 when none).
    ``lasts``: its last non-null value in earlier blocks (NULL when none).
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    order = F.col(order) if isinstance(order, str) else order
    df = durable_checkpoint(df)   # read by the summary and by the join back, as in `scan_breaks`
    summary = df.groupBy(*keys, BLOCK).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), order)).alias(n) for n, c in lasts.items()])
    before = (W.partitionBy(*keys).orderBy(BLOCK)
               .rowsBetween(W.unboundedPreceding, -1))
    prefix = summary.select(
        *keys, BLOCK,
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums],
        *[F.last(n, ignorenulls=True).over(before).alias(n) for n in lasts])
    return df.join(prefix, [*keys, BLOCK])


def drop_helpers(df: DataFrame, *extra: str) -> DataFrame:
    return df.drop(BLOCK, HALO, US, *extra)


def running_number(df: DataFrame, keys: Sequence[str], ts: str, out: str,
                   ties: Sequence[str] = (), block_seconds: float = 30 * DAY) -> DataFrame:
    """Row number of each row in its series (from 1), counted block by block."""
    w = block_window(keys, order=(US, *ties))
    local = with_blocks(df, ts, block_seconds).withColumn("_rn", F.row_number().over(w))
    numbered = carry(local, keys, "_rn", sums={"_before": F.lit(1)})
    return drop_helpers(numbered.withColumn(out, (F.col("_before") + F.col("_rn")).cast("bigint")),
                        "_rn", "_before")


def scan_breaks(rows: DataFrame, keys: Sequence[str], state: Column, is_break,
                order: Sequence[str] = (US,)) -> DataFrame:
    """Number the breaks of a state sequence over a whole series, block by block.

    ``state`` is NULL on rows that neither break nor change what later rows compare with;
    ``is_break(previous, current)`` is a boolean Column (``previous`` is NULL at the start
    of the series).  Input carries ``_block`` and ``_us``.  Adds

    ``_prev``    last non-null state of the series before this row,
    ``_break``   whether this row breaks,
    ``_number``  breaks so far in the series, this row included,
    ``_since``   rows since the latest break (0 on the break itself, NULL before any),
    ``_head_us`` time of the latest break.

    One shuffle of the rows on ``(key, block)`` plus one summary row per block. The rows are stored
    once after that shuffle: the summary and the join back both read them there, already dealt by
    ``(key, block)``, so neither the scan beneath nor the shuffle is repeated, however deep scans nest.
    """
    w = block_window(keys, order=order)
    past, here = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    cur = F.col("_state")
    rows = rows.withColumn("_state", state).withColumns({
        "_rn": F.row_number().over(w).cast("bigint"),
        "_near": F.last("_state", ignorenulls=True).over(past)})
    inner = F.when(cur.isNotNull() & F.col("_near").isNotNull()
                   & F.coalesce(is_break(F.col("_near"), cur), F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("_inner", inner)
    marked = F.col("_inner") == 1
    known = F.when(cur.isNotNull(), F.col("_rn"))
    rows = rows.withColumns({"_opened": F.sum("_inner").over(here),
                             "_mark": F.max(F.when(marked, F.col("_rn"))).over(here),
                             "_mark_us": F.max(F.when(marked, F.col(US))).over(here)})
    rows = durable_checkpoint(rows)

    block = rows.groupBy(*keys, BLOCK).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_inner").alias("_n_inner"),
        F.min(known).alias("_first_rn"),
        F.min_by(F.struct(cur.alias("state"), F.col(US).alias("us")), known).alias("_first"),
        F.max_by("_state", known).alias("_last"),
        F.max("_mark").alias("_last_mark"), F.max("_mark_us").alias("_last_mark_us"))
    series = W.partitionBy(*keys).orderBy(BLOCK)
    before = series.rowsBetween(W.unboundedPreceding, -1)
    block = block.withColumns({"_far": F.last("_last", ignorenulls=True).over(before),
                               "_rows_before": F.coalesce(F.sum("_n").over(before), F.lit(0))})
    opens = F.col("_first_rn").isNotNull() & F.coalesce(
        is_break(F.col("_far"), F.col("_first.state")), F.lit(False))
    block = block.withColumn("_opens", flag(opens))
    head = F.coalesce(F.col("_rows_before") + F.col("_last_mark"),
                      F.when(F.col("_opens") == 1, F.col("_rows_before") + F.col("_first_rn")))
    head_us = F.coalesce("_last_mark_us", F.when(F.col("_opens") == 1, F.col("_first.us")))
    block = block.withColumn("_h", head).withColumn("_h_us", head_us).select(
        *keys, BLOCK, "_far", "_rows_before", "_opens", "_first_rn",
        F.col("_first.us").alias("_first_us"),
        F.coalesce(F.sum(F.col("_n_inner") + F.col("_opens")).over(before),
                   F.lit(0)).alias("_before"),
        F.last("_h", ignorenulls=True).over(before).alias("_h_before"),
        F.last("_h_us", ignorenulls=True).over(before).alias("_h_us_before"))

    rows = rows.join(block, [*keys, BLOCK])
    reached = (F.col("_opens") == 1) & (F.col("_rn") >= F.col("_first_rn"))
    head = F.coalesce(F.col("_rows_before") + F.col("_mark"),
                      F.when(reached, F.col("_rows_before") + F.col("_first_rn")),
                      F.col("_h_before"))
    head_us = F.coalesce("_mark_us", F.when(reached, F.col("_first_us")), "_h_us_before")
    return (rows.withColumns({
        "_prev": F.coalesce("_near", "_far"),
        "_break": marked | (reached & (F.col("_rn") == F.col("_first_rn"))),
        "_number": F.col("_before") + F.col("_opened") + F.when(reached, 1).otherwise(0),
        "_since": F.col("_rows_before") + F.col("_rn") - head,
        "_head_us": head_us})
                .drop("_state", "_rn", "_near", "_inner", "_opened", "_mark", "_mark_us", "_far",
                      "_rows_before", "_opens", "_first_rn", "_first_us", "_before", "_h_before",
                      "_h_us_before"))


SCAN_COLUMNS = ("_prev", "_break", "_number", "_since", "_head_us")
