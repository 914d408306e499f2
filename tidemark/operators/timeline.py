"""Keyed event timelines: statistics of the last events, gathered strictly before each row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: Rows of one task where an entity has fewer; the windows' sorters hold about 2 kB for each.
TASK_ROWS = 200_000


@dataclass(frozen=True)
class Timeline:
    """key: the entity. time: a bigint of microseconds. ties: columns that order rows of equal time. event: boolean."""

    key: tuple[str, ...]
    time: str
    ties: tuple[str, ...]
    event: str

    @property
    def order(self) -> tuple[str, ...]:
        return (self.time, *self.ties)

    def events(self) -> WindowSpec:
        """All events of the entity in order (rows that are no events have a window of their own)."""
        return Window.partitionBy(*self.key, self.event).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        return self.events().rowsBetween(-(n - 1), 0)

    def to_date(self, *more: str) -> WindowSpec:
        """Events so far, of equal more (a season, a run)."""
        return Window.partitionBy(*self.key, self.event, *more).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)

    def rows(self) -> WindowSpec:
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def before(self) -> WindowSpec:
        """Rows of strictly earlier time: rows of equal time never see each other."""
        return Window.partitionBy(*self.key).orderBy(self.time).rangeBetween(Window.unboundedPreceding, -1)

    def spread(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """One shuffle by the entity that all windows of this timeline share; where the number of rows is told, into so
        many partitions that each gets about TASK_ROWS, however small they compress."""
        if rows is None:
            return df.repartition(*self.key)
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(max(least, -(-rows // TASK_ROWS)), *self.key)


def micros(column: str | Column) -> Column:
    """A date, timestamp or timestamp without zone (UTC) as microseconds."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def effective_time(tipoff: str, date: str) -> Column:
    """The start of the game; where it is unknown, the last second of its day."""
    return F.coalesce(F.col(tipoff).cast("timestamp"), F.col(date).cast("timestamp") + F.expr("interval 1 day") - F.expr("interval 1 second"))


def gather_prior(df: DataFrame, tl: Timeline, post: Column, out: str = "prior") -> DataFrame:
    """Add out: post as it was after the last event strictly before the row; of events of equal time, the last in order.

    Of each time only the last event's post is offered, so the last one offered before the row is the one wanted."""
    closes = F.col(tl.event) & ~F.coalesce(F.lead(tl.time).over(tl.events()) == F.col(tl.time), F.lit(False))
    offered = df.withColumn("_offered", F.when(closes, F.struct(post.alias("v"))))
    return offered.withColumn(out, F.last("_offered", ignorenulls=True).over(tl.before())["v"]).drop("_offered")


def rolling_slope(value: str, number: str, tl: Timeline, n: int, least: int = 3) -> Column:
    """Least-squares slope of value against the event number over the last n events, null under least."""
    frame = tl.last(n)
    return F.when(F.count(value).over(frame) >= least, F.regr_slope(F.col(value).cast("double"), F.col(number).cast("double")).over(frame))


def weighted_mean(value: str, tl: Timeline, length: int = 12, half_life: float = 3.0) -> Column:
    """Mean of the last length events with weights 0.5 ** (age / half_life), over the weights of those there are."""
    lags = [F.lag(value, j).over(tl.events()) for j in range(length)]
    weights = [0.5 ** (j / half_life) for j in range(length)]
    total = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for x, w in zip(lags[1:], weights[1:])), F.when(lags[0].isNotNull(), F.lit(weights[0])).otherwise(0.0))
    summed = sum((F.coalesce(x * F.lit(w), F.lit(0.0)) for x, w in zip(lags[1:], weights[1:])), F.coalesce(lags[0] * F.lit(weights[0]), F.lit(0.0)))
    return F.try_divide(summed, F.when(total > 0, total))


def ratio_of_sums(top: str, bottom: str, tl: Timeline, n: int, floor: float) -> Column:
    below = F.sum(bottom).over(tl.last(n))
    return F.when(below >= floor, F.try_divide(F.sum(top).over(tl.last(n)).cast("double"), below.cast("double")))


def run_ids(df: DataFrame, tl: Timeline, change_of: str, out: str = "run") -> DataFrame:
    """Number the entity's contiguous runs of equal change_of."""
    moved = F.coalesce((~F.col(change_of).eqNullSafe(F.lag(change_of).over(tl.rows()))).cast("int"), F.lit(1))
    flagged = df.withColumn("_moved", F.when(F.row_number().over(tl.rows()) == 1, 1).otherwise(moved))
    return flagged.withColumn(out, F.sum("_moved").over(tl.rows().rowsBetween(Window.unboundedPreceding, 0))).drop("_moved")


def run_ids_of_events(df: DataFrame, tl: Timeline, change_of: str, out: str = "run") -> DataFrame:
    """As run_ids, over the events alone: a row between two events does not end a run."""
    events = tl.events()
    moved = F.when(F.row_number().over(events) == 1, 1).otherwise((~F.col(change_of).eqNullSafe(F.lag(change_of).over(events))).cast("int"))
    return df.withColumn("_moved", moved).withColumn(out, F.sum("_moved").over(events.rowsBetween(Window.unboundedPreceding, 0))).drop("_moved")


def miss_streak(df: DataFrame, tl: Timeline, out: str = "streak") -> DataFrame:
    """Rows without an event in a row, as known strictly before each row; 0 before the first row."""
    so_far = tl.rows().rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_island", F.sum(F.col(tl.event).cast("int")).over(so_far))
    island = Window.partitionBy(*tl.key, "_island").orderBy(*tl.order).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_misses", F.sum((~F.col(tl.event)).cast("int")).over(island))
    return marked.withColumn(out, F.coalesce(F.max_by("_misses", F.struct(*tl.order)).over(tl.before()), F.lit(0))).drop("_island", "_misses")


def capped_days_since(day: str | Column, prior_day: Column, cap: int) -> Column:
    """Days from prior_day (days since the epoch) to day, cap at most; null where there is no prior (least() skips nulls)."""
    date = F.col(day) if isinstance(day, str) else day
    return F.when(prior_day.isNotNull(), F.least(F.unix_date(date.cast("date")) - prior_day, F.lit(cap)))
