"""Exact quantiles in every group by radix selection: all columns, groups and shares at once, in four passes at any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.session import staged
from panelweave.spec import q

# Bits that one pass settles; a histogram has at most 2 ** DIGIT_BITS rows for each searched prefix.
DIGIT_BITS = 16
# A hot group's rows meet their prefixes in this many parts when the prefixes are too many to broadcast.
SALTS = 16


def with_ordered_bits(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``keys`` and, for column i, ``__k<i>``: its double's bit pattern as a long that sorts like the number.

    NaN is NULL, both zeros are 0. Every step is a projection of its own, so that each value is computed once.
    """
    n = range(len(cols))
    out = df.select(*[q(c) for c in keys], *[q(c).cast("double").alias(f"__x{i}") for i, c in enumerate(cols)])
    out = out.withColumns({f"__a{i}": F.abs(F.when(~F.isnan(f"__x{i}"), F.col(f"__x{i}"))) for i in n})
    # Zero has no logarithm; greatest and least would pass over its NULL.
    log = lambda i: F.greatest(F.least(F.coalesce(F.log2(f"__a{i}"), F.lit(-1022.0)), F.lit(1023.0)), F.lit(-1022.0))
    out = out.withColumns({f"__g{i}": F.floor(log(i)) for i in n})
    out = out.withColumns({f"__s{i}": F.col(f"__a{i}") / F.pow(F.lit(2.0), F.col(f"__g{i}")) for i in n})
    # The logarithm is rounded: next to a power of two it may be one off.
    out = out.withColumns(
        {f"__e{i}": F.col(f"__g{i}") + F.expr(f"CASE WHEN __s{i} < 1 AND __g{i} > -1022 THEN -1 WHEN __s{i} >= 2 AND __g{i} < 1023 THEN 1 ELSE 0 END") for i in n}
    )
    fraction = lambda i: F.least(F.col(f"__a{i}") / F.pow(F.lit(2.0), F.col(f"__e{i}")), F.lit(2.0))
    sign = lambda i: F.when(F.col(f"__x{i}") < 0, -1).otherwise(1)
    bits = lambda i: (F.col(f"__e{i}") + 1022) * F.lit(1 << 52) + (fraction(i) * F.lit(float(1 << 52))).cast("long")
    # Without a magnitude there is no pattern: least would give 2 for NULL.
    return out.select(*[q(c) for c in keys], *[F.when(F.col(f"__a{i}").isNotNull(), sign(i) * bits(i)).alias(f"__k{i}") for i in n])


def from_ordered_bits(k: Column) -> Column:
    """The double with the ordered bit pattern ``k``."""
    bits = F.abs(k)
    e = F.shiftright(bits, 52)
    low = bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    size = (
        F.when(e == 2047, F.lit(float("inf")))
        .when(e == 0, low * F.lit(2.0**-1074))
        .otherwise((F.lit(1.0) + low / F.lit(float(1 << 52))) * F.pow(F.lit(2.0), e - 1023))
    )
    return F.when(k < 0, -size).otherwise(size)


def grouped_quantiles(df: DataFrame, keys: Sequence[str], probs: Mapping[str, Sequence[float]], stage: bool = True) -> DataFrame:
    """Linearly interpolated quantiles per group: one row (``keys``, ``column``, ``prob``, ``value``) each.

    A rank is sought digit by digit in the ordered bit pattern. The first pass counts the leading 16 bits of all
    values; every later one counts the next 16 bits of the values that share a sought prefix. Counts are added up
    in each task before they are shuffled, so hot groups and hot values cost one row for each task and digit.
    NULL and NaN are ignored, infinities count, NULL keys are a group; groups without a value have no row.
    The bit patterns are staged once; ``stage=False`` computes them from ``df`` in each pass instead.
    """
    keys, cols = list(keys), list(probs)
    wide = with_ordered_bits(df, keys, cols)
    wide = staged(wide, "quantile-bits") if stage else wide
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"__k{i}").alias("k")) for i in range(len(cols))])
    rows = wide.select(*[q(c) for c in keys], F.explode(entries).alias("__e")).select(*[q(c) for c in keys], F.col("__e.i").alias("__i"), F.col("__e.k").alias("__k"))
    rows = rows.filter("__k IS NOT NULL")
    held = [*keys, "__i"]

    top = 64 - DIGIT_BITS
    first = _cumulated(rows.groupBy(*[q(c) for c in held], F.shiftright("__k", top).alias("__digit")).agg(F.count("*").alias("__n")), held)
    total = F.sum("__n").over(Window.partitionBy(*[q(c) for c in held]))
    wanted = F.lit(None)
    for i, c in enumerate(cols):
        wanted = F.when(F.col("__i") == i, F.array(*[F.lit(float(p)) for p in dict.fromkeys(probs[c])])).otherwise(wanted)
    sought = (
        first.withColumn("__total", total)
        .withColumn("__prob", F.explode(wanted))
        .withColumn("__at", (F.col("__total") - 1) * F.col("__prob"))
        .select("*", F.posexplode(F.array(F.floor("__at"), F.ceil("__at"))).alias("__upper", "__rank"))
        .filter("__rank >= __upto - __n AND __rank < __upto")
    )
    ident = [*held, "__prob", "__at", "__upper"]
    sought = sought.select(*[q(c) for c in ident], F.col("__digit").alias("__prefix"), (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__rank"))
    for shift in range(top - DIGIT_BITS, -1, -DIGIT_BITS):
        sought = _next_digit(rows, staged(sought, "quantile-ranks"), held, ident, shift)

    value = from_ordered_bits(F.col("__prefix"))
    ends = sought.groupBy(*[q(c) for c in held], "__prob", "__at").agg(F.max(F.when(F.col("__upper") == 0, value)).alias("__a"), F.max(F.when(F.col("__upper") == 1, value)).alias("__b"))
    # Equal ends need no interpolation (and the difference of two infinities is no number).
    between = F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__at") - F.floor("__at")))
    names = F.array(*[F.lit(c) for c in cols])
    return ends.select(*[q(c) for c in keys], F.get(names, F.col("__i")).alias("column"), F.col("__prob").alias("prob"), between.alias("value"))


def _cumulated(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``__upto``: values up to and with the row's digit. A window holds one histogram."""
    order = Window.partitionBy(*[q(c) for c in by]).orderBy("__digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("__upto", F.sum("__n").over(order))


def _next_digit(rows: DataFrame, sought: DataFrame, held: Sequence[str], ident: Sequence[str], shift: int) -> DataFrame:
    """Ranks within a prefix become ranks within the prefix that is one digit longer."""
    by = [*held, "__prefix"]
    digit = F.shiftright("__k", shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
    salted = rows.select("*", F.shiftright("__k", shift + DIGIT_BITS).alias("__prefix"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("__salt"))
    prefixes = sought.select(*[q(c) for c in by]).distinct().withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    inside = _matched(salted, prefixes, [*by, "__salt"])
    counts = inside.groupBy(*[q(c) for c in by], digit.alias("__digit")).agg(F.count("*").alias("__n"))
    found = _matched(_cumulated(counts, by), sought, by).filter("__rank >= __upto - __n AND __rank < __upto")
    longer = F.shiftleft("__prefix", DIGIT_BITS).bitwiseOR(F.col("__digit"))
    return found.select(*[q(c) for c in ident], longer.alias("__prefix"), (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__rank"))


def _matched(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inner join where NULL keys meet; the columns of both, the keys once."""
    other = right.select(*[q(c).alias(f"__r_{c}" if c in by else c) for c in right.columns])
    same = F.lit(True)
    for c in by:
        same = same & q(c).eqNullSafe(q(f"__r_{c}"))
    return left.join(other, same).drop(*[f"__r_{c}" for c in by])
