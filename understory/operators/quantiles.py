"""Exact quantiles of groups too large for one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. A
box plot has two or three groups, so at scale each buffer would hold a third of
all plots. Here a bounded sketch brackets the wanted ranks, read only as far from
each as its error reaches; the values in a bracket are ordered, 40 in a million of
a large group and at most a few dozen of a small one. The sketch's rank error has
a proven bound and the bracket is wider, so the wanted ranks lie inside.

Should one not, because a merged sketch is worse than its bound or a group's values are
unlike any other, the rank is selected without a sketch: doubles are
ordered like their bits, so counts of the rows by 16 bits at a time narrow the value down in
four rounds. A round keeps at most 65,536 counts for a rank, whatever the group
holds. What the brackets give is stored, a row for each group, so only where a rank
was missed are these rounds planned at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from understory.operators.joins import join_group_statistics, null_safe_join
from understory.sources.shared import cut_lineage

# Rank error of the sketch is at most rows / ACCURACY.
ACCURACY = 100_000
# The sketch is read at these distances from each probability; a group takes the
# smallest that covers the error and two rows, or all its rows if none does.
REACH = (2 / ACCURACY, 2e-4, 2e-3, 2e-2, 0.2)

STATS = ("n", "min", "max", "sd")

# Bits of an ordered double that a round of selection counts by.
DIGIT_BITS = 16


def _readings(probabilities: Sequence[float]) -> list[float]:
    """Where the sketch is read: below and above each probability, by distance."""
    return [min(1.0, max(0.0, p + side * d)) for p in probabilities for d in REACH for side in (-1, 1)]


def _sketch(rows: DataFrame, by: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("_v").alias("n"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
        F.stddev_samp("_v").alias("sd"),
        F.percentile_approx("_v", _readings(probabilities), ACCURACY).alias("_read"),
    )


def _bracket(place: int, probability: float) -> Column:
    """Wanted ranks of one probability and values that enclose them.

    Linear interpolation needs the two ranks next to ``p * (n - 1)``. Where no
    distance reaches far enough, or the range ends, the bracket is open (null).
    """
    position = (F.col("n") - 1) * probability
    low_rank, high_rank = F.floor(position), F.ceil(position)
    needed = 1.0 / ACCURACY + F.lit(2.0) / F.col("n")
    low = high = F.lit(None).cast("double")
    for i, distance in reversed(list(enumerate(REACH))):
        at = 2 * (place * len(REACH) + i)
        enough = needed <= distance
        low = F.when(enough, F.get("_read", F.lit(at)) if probability > distance else F.lit(None)).otherwise(low)
        high = F.when(enough, F.get("_read", F.lit(at + 1)) if probability < 1 - distance else F.lit(None)).otherwise(high)
    return F.struct(
        F.lit(probability).alias("p"),
        low_rank.alias("low_rank"),
        high_rank.alias("high_rank"),
        (position - low_rank).alias("weight"),
        low.alias("low"),
        high.alias("high"),
    )


def group_statistics(
    frame: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    closed: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Count, minimum, maximum, standard deviation and exact quantiles by group.

    ``quantiles`` maps output names to probabilities; nulls in ``value`` are
    skipped. ``closed`` has the values of the group columns where they are few and
    known (see :func:`join_group_statistics`).
    """
    rows = frame.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    probabilities = sorted(set(quantiles.values()))
    wanted = [_bracket(i, p) for i, p in enumerate(probabilities)]
    brackets = _sketch(rows, by, probabilities).where("n > 0").select(
        *by, F.struct(*STATS, F.array(*wanted).alias("brackets")).alias("_s")
    )
    if by:
        bracketed = join_group_statistics(rows, brackets, by, "_v", closed, F.col("_s.n"))
    else:
        bracketed = rows.select("*", F.lit(1).alias("_n"), brackets.scalar().alias("_s"))

    # Rows under a bracket collapse to one null value with a count, rows over
    # it go, rows inside collapse by value: all before the shuffle.
    wanted = F.filter("_s.brackets", lambda b: b.high.isNull() | (F.col("_v") <= b.high))
    inside = F.transform(
        wanted,
        lambda b: F.struct(
            b.p.alias("p"), b.low_rank.alias("low_rank"), b.high_rank.alias("high_rank"),
            b.weight.alias("weight"),
            F.when(b.low.isNull() | (F.col("_v") >= b.low), F.col("_v")).alias("v"),
        ),
    )
    stats = [F.col(f"_s.{name}").alias(name) for name in STATS]
    counted = (
        bracketed.select(*by, "_n", *stats, F.inline(inside))
        .groupBy(*by, "p", "v")
        .agg(F.sum("_n").alias("_rows"), *[F.max(c).alias(c) for c in ("low_rank", "high_rank", "weight", *STATS)])
    )
    upto = F.sum("_rows").over(
        Window.partitionBy(*by, "p").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = counted.withColumn("_upto", upto)

    def value_at(rank: str) -> Column:
        hit = (F.col(rank) < F.col("_upto")) & (F.col(rank) >= F.col("_upto") - F.col("_rows"))
        return F.max(F.when(hit, F.col("v")))

    carried = ["low_rank", "high_rank", "weight", *STATS]
    found = ranked.groupBy(*by, "p").agg(
        value_at("low_rank").alias("low"), value_at("high_rank").alias("high"), *[F.max(c).alias(c) for c in carried])
    found = cut_lineage(found)
    missed = found.where((F.col("low").isNull() | F.col("high").isNull()) & (F.col("n") > 0))
    if missed.isEmpty():
        found = found.withColumns({"_low": F.lit(None).cast("double"), "_high": F.lit(None).cast("double")})
    else:
        asked = missed.select(*by, "p", F.explode(F.array_distinct(F.array("low_rank", "high_rank"))).alias("rank"))
        values = select_ranks(rows, asked, by).groupBy(*by, "p").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
        found = null_safe_join(found, cut_lineage(values), [*by, "p"])
    low, high = F.coalesce("_low", "low"), F.coalesce("_high", "high")
    picked = found.withColumn("value", low + (high - low) * F.col("weight"))
    outputs = [F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for name, p in quantiles.items()]
    return picked.groupBy(*by).agg(*[F.max(c).alias(c) for c in STATS], *outputs)


def ordered_bits(value: Column) -> Column:
    """A long in the order of doubles: null first, then numbers, then not-a-number."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(value.isNotNull(), F.when(bits >= 0, bits).otherwise(F.bitwise_not(bits.bitwiseAND(F.lit((1 << 63) - 1)))))


def select_ranks(rows: DataFrame, wanted: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, p, rank, value): the values of rank ``rank``, from 0, among the ``_v`` of each group, exactly.

    ``rows`` are (*by, _v) without nulls, ``wanted`` (*by, p, rank), each once and few to a group.
    In each round the rows that agree with what is known of a wanted value are counted by its
    next bits; the counts say which bits come next and how many rows lie below. Groups that
    are not wanted drop out in the first join.
    """
    by = list(by)
    counted = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_bits", ordered_bits(F.col("_v")))
    none = F.lit(0).cast("long")
    state = wanted.select(*by, "p", "rank", F.col("rank").cast("long").alias("left"), none.alias("prefix"))
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        known = shift + DIGIT_BITS
        asked = state.groupBy(*by).agg(F.collect_list(F.struct("p", "rank", "left", "prefix")).alias("_s"))
        met = null_safe_join(counted, asked, by, "inner") if by else counted.crossJoin(F.broadcast(asked))  # one row
        here = F.filter("_s", lambda r: F.lit(True) if known == 64 else F.shiftright("_bits", known) == r.prefix)
        digits = met.select(*by, "_v", "_n", F.shiftright("_bits", shift).alias("next"), F.inline(here)).groupBy(
            *by, "p", "rank", "left", "next").agg(F.sum("_n").alias("_rows"), F.min("_v").alias("value"))
        upto = F.sum("_rows").over(Window.partitionBy(*by, "p", "rank").orderBy("next").rowsBetween(Window.unboundedPreceding, 0))
        ranked = digits.withColumn("_below", upto - F.col("_rows"))
        hit = (F.col("left") >= F.col("_below")) & (F.col("left") < F.col("_below") + F.col("_rows"))
        state = ranked.where(hit).select(
            *by, "p", "rank", (F.col("left") - F.col("_below")).alias("left"), F.col("next").alias("prefix"), "value")
    return state.drop("left", "prefix")


def exact_quantiles(
    frame: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    closed: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value`` by group."""
    return group_statistics(frame, by, value, quantiles, closed).select(*by, *quantiles)
