"""Per-period counts that late events correct, with a cut-off (problem 1).

Rows are placed in a triangle of event period by arrival period. Cell 0 is what
had arrived when the period was first published; cells 1 up to the cut-off are
later arrival periods, each of which publishes a corrected revision; later cells
are closed. The triangle is aggregated per cell first (partial counts before the
shuffle, so one hot hour costs no more than its few cells) and a window then sums
the cells of a period over arrivals. Rows are traced to the revisions they make by
joining them with the triangle, which is small beside them: it is written once and
broadcast while its count allows, else joined by a shuffle whose hot cells adaptive
execution splits.

Defined cases: a row whose event or arrival time is missing or unreadable is in
no cell; copies count each by itself; an arrival before its own period lies in
cell 0; other columns of the input are ignored whatever their names; an empty
input gives an empty triangle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import epoch_seconds, hour_label
from ..session import stored

PERIOD_S = 3600
PUBLISH_AFTER_S = 15 * 60
CUT_OFF_S = 48 * 3600
#: Revisions up to this many are broadcast, at some 20 bytes each.
BROADCAST_REVISIONS = 500_000


def arrival_cell(event: Column, arrival: Column, publish_after: int = PUBLISH_AFTER_S, arrival_period: int = PUBLISH_AFTER_S) -> Column:
    """Number of the arrival period: 0 up to first publication, then one per ``arrival_period`` seconds."""
    end = (F.floor(event / PERIOD_S) + 1) * PERIOD_S
    return F.greatest(F.floor((arrival - end - publish_after) / arrival_period) + 1, F.lit(0))


def closed_from(publish_after: int = PUBLISH_AFTER_S, cut_off: int = CUT_OFF_S, arrival_period: int = PUBLISH_AFTER_S) -> int:
    """First cell beyond the cut-off; the cut-off must end an arrival period."""
    cells, rest = divmod(cut_off - publish_after, arrival_period)
    if rest:
        raise ValueError("the cut-off must end an arrival period")
    return cells + 1


def _placed(df: DataFrame, event: str, arrival: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``place`` with the period as its number of hours since 1970: (*keep, hour, cell)."""
    return (
        df.select(*keep, epoch_seconds(F.col(event)).alias("__event"), epoch_seconds(F.col(arrival)).alias("__arrival"))
        .filter(F.col("__event").isNotNull() & F.col("__arrival").isNotNull())
        .select(*keep, F.floor(F.col("__event") / PERIOD_S).alias("hour"), arrival_cell(F.col("__event"), F.col("__arrival")).alias("cell"))
        .filter(F.col("cell") < closed_from())
    )


def _label() -> Column:
    return hour_label(F.col("hour") * PERIOD_S).alias("period")


def place(df: DataFrame, event: str = "tidpunkt", arrival: str = "signal_tidpunkt", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each readable row with its period and cell, beyond-cut-off rows left out: (*keep, period, cell)."""
    return _placed(df, event, arrival, keep).select(*keep, _label(), "cell")


def _cells(df: DataFrame, event: str, arrival: str) -> DataFrame:
    """(hour, cell, arrived, total): the triangle, counted per cell and summed over arrivals."""
    cells = _placed(df, event, arrival).groupBy("hour", "cell").agg(F.count(F.lit(1)).alias("arrived"))
    so_far = Window.partitionBy("hour").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("total", F.sum("arrived").over(so_far))


def triangle(df: DataFrame, event: str = "tidpunkt", arrival: str = "signal_tidpunkt") -> DataFrame:
    """Every revision of every period: (period, cell, arrived, total), total being the count published then."""
    return _cells(df, event, arrival).select(_label(), "cell", "arrived", "total")


def revisions(cells: DataFrame, period: str = "period") -> DataFrame:
    """The corrected publications of a ``triangle``: (period, cell, total, was) where the count published before was another."""
    before = F.lag("total", 1, 0).over(Window.partitionBy(period).orderBy("cell"))
    return cells.withColumn("was", before).filter((F.col("cell") >= 1) & (F.col("total") != F.col("was"))).select(period, "cell", "total", "was")


def corrections(df: DataFrame, key: str = "file", event: str = "tidpunkt", arrival: str = "signal_tidpunkt") -> DataFrame:
    """The rows that make a revision after the first publication: (period, key)."""
    # One number stands for period and cell: half the size of both to broadcast.
    publication = (F.col("hour") * closed_from() + F.col("cell")).alias("publication")
    made = stored(revisions(_cells(df, event, arrival), "hour").select(publication))
    if made.count() <= BROADCAST_REVISIONS:
        made = F.broadcast(made)
    return _placed(df, event, arrival, (key,)).select(key, "hour", publication).join(made, "publication", "left_semi").select(_label(), key)
