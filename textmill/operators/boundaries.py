"""Groups of consecutive rows whose ends depend on where the group before them ended.

A shard that closes when it holds a budget, or a packed row that closes when the next document
doesn't fit, starts where its predecessor ends.  Read one after the other that is a loop over
all rows of a lane.  Here the recurrence is a table of successors instead: for *every* row, where
the next group would start if one started here, found by an as-of lookup on prefix sums.  The
rows that do start groups are those that lead on from the first one; tables of 1, 4, 16, ...
steps, each joined from the one before, reach all of them in a logarithmic number of joins.

Everything is a DataFrame plan on narrow rows: no lane has to fit one task, and the result
doesn't depend on the number of partitions.  Tables that grow with the rows are joined by sorting:
Spark would send each that is below its limit through the driver, and there are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import running_sum
from ..session import materialised

STEPS = 4  # of the table before, in one step of the next table


def prefixed(rows: DataFrame, order: list[str], length: str = "len") -> DataFrame:
    """Add ``idx`` (from 0), ``p`` and ``c``, the sums before and after the row, within ``lane``; written."""
    got = running_sum(rows, length, order, by=["lane"], out="c", also={"idx": F.lit(1).cast("long")})
    return materialised(got.withColumn("idx", F.col("idx") - 1).withColumn("p", F.col("c") - F.col(length)), "prefixed")


def first_at_least(items: DataFrame, value: Column, inclusive: bool = True) -> DataFrame:
    """(lane, idx, at): of each row the number of rows of its lane with ``c`` below ``value`` (not above it, unless ``inclusive``).

    That is the place of the first row whose ``c`` is at least (above) the value, or the
    number of rows if there is none.
    """
    asked = items.select("lane", value.alias("v"), F.lit(0 if inclusive else 2).alias("kind"), "idx", F.lit(0).cast("long").alias("one"))
    given = items.select("lane", F.col("c").alias("v"), F.lit(1).alias("kind"), "idx", F.lit(1).cast("long").alias("one"))
    met = running_sum(asked.unionByName(given), "one", ["v", "kind", "idx"], by=["lane"], out="at")
    return met.filter(F.col("kind") != 1).select("lane", "idx", "at")


def budget_successors(items: DataFrame, budget: int, multiple: int = 1) -> DataFrame:
    """(lane, idx, to): a group closes at the first row where it holds ``budget``, crossing row
    included, and its number of rows is a multiple of ``multiple``.  Open groups have no line."""
    size = items.groupBy("lane").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("lane", "l")
    found = first_at_least(items, F.col("p") + F.lit(budget).cast("long"))
    rows = F.col("at") - F.col("idx") + 1
    to = F.when(F.col("at") < F.col("n"), F.col("idx") + F.ceil(rows / multiple) * multiple)
    return found.join(size, F.col("lane") == F.col("l")).select("lane", "idx", to.alias("to"), "n").filter(F.col("to") <= F.col("n"))


def pad_successors(items: DataFrame, cap: int) -> DataFrame:
    """(lane, idx, to): a group ends before the row that would exceed ``cap``, or when it is full.

    Lengths are at most ``cap``."""
    limit = F.col("p") + F.lit(cap).cast("long")
    size = items.groupBy("lane").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("lane", "l")
    below = first_at_least(items, limit)
    upto = first_at_least(items, limit, inclusive=False).select(F.col("lane").alias("l2"), F.col("idx").alias("i2"), F.col("at").alias("upto"))
    met = below.hint("merge").join(upto.hint("merge"), (F.col("lane") == F.col("l2")) & (F.col("idx") == F.col("i2"))).join(size, F.col("lane") == F.col("l"))
    to = F.when(F.col("upto") > F.col("at"), F.col("at") + 1).otherwise(F.col("at"))
    return met.select("lane", "idx", to.alias("to"), "n").filter(F.col("at") < F.col("n"))


def _onward(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (lane, idx, to) led on by a table; those that it doesn't lead on are dropped."""
    step = table.select(F.col("lane").alias("l"), F.col("idx").alias("i"), F.col("to").alias("further"))
    return rows.hint("merge").join(step.hint("merge"), (F.col("lane") == F.col("l")) & (F.col("to") == F.col("i"))).select("lane", "idx", F.col("further").alias("to"))


def group_starts(items: DataFrame, successors: DataFrame, most: int) -> DataFrame:
    """(lane, idx) of the rows that start groups, of which a lane has at most ``most``."""
    tables = [successors.select("lane", "idx", "to")]
    reach = STEPS
    while reach < most:
        table = tables[-1]
        for _ in range(STEPS - 1):
            table = _onward(table, tables[-1])
        tables.append(materialised(table, "boundary-steps"))
        reach *= STEPS
    found = items.filter(F.col("idx") == 0).select("lane", "idx", F.col("idx").alias("to"))
    for table in reversed(tables):
        ways = [found]
        for _ in range(STEPS - 1):
            ways.append(_onward(ways[-1], table))
        for way in ways[1:]:
            found = found.unionByName(way)
        found = materialised(found, "boundary-starts")
    return found.select("lane", F.col("to").alias("idx"))


def grouped(items: DataFrame, successors: DataFrame, most: int) -> DataFrame:
    """Add ``group`` (from 0 within the lane), ``base`` (``p`` of its first row) and ``closed`` to ``items``.

    ``most`` is a bound on the groups of a lane.
    """
    successors = materialised(successors.select("lane", "idx", "to"), "boundary-successors")
    starts = group_starts(items, successors, most)
    closes = successors.select(F.col("lane").alias("cl"), F.col("idx").alias("ci"))
    starts = starts.hint("merge").join(closes.hint("merge"), (F.col("lane") == F.col("cl")) & (F.col("idx") == F.col("ci")), "left").select(
        F.col("lane").alias("sl"), F.col("idx").alias("si"), F.col("ci").isNotNull().alias("closes"))
    marked = items.hint("merge").join(starts.hint("merge"), (F.col("lane") == F.col("sl")) & (F.col("idx") == F.col("si")), "left")
    marked = marked.withColumn("start", F.col("si").isNotNull().cast("long")).drop("sl", "si")
    numbered = running_sum(marked, "start", ["idx"], by=["lane"], out="group").withColumn("group", F.col("group") - 1)
    numbered = materialised(numbered, "boundary-groups")
    heads = numbered.filter(F.col("start") == 1).select(F.col("lane").alias("hl"), F.col("group").alias("hg"), F.col("p").alias("base"), F.col("closes").alias("closed"))
    return numbered.drop("closes", "start").hint("merge").join(heads.hint("merge"), (F.col("lane") == F.col("hl")) & (F.col("group") == F.col("hg"))).drop("hl", "hg")
