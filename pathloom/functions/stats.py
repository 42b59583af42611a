"""Tests of enrichment as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The published Chebyshev fit of the complementary error function.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it: without
    that, formulas that nest would be written out many times over."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, to about seven digits."""

    def poly(t: Column) -> Column:
        out = F.lit(ERFC[-1])
        for c in reversed(ERFC[:-1]):
            out = F.lit(c) + t * out
        return out

    def upper(x: Column) -> Column:
        return let(1.0 / (1.0 + 0.5 * x), lambda t: 0.5 * t * F.exp(-x * x + poly(t)))

    def tail(z: Column) -> Column:
        return let(upper(F.abs(z) / F.sqrt(F.lit(2.0))), lambda u: F.when(z >= 0, u).otherwise(1.0 - u))

    return let(z, tail)


def normal_tail_sql(z: str) -> str:
    """The same as SQL text."""
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.5 * {x}))"
    poly = f"({ERFC[-1]})"
    for c in reversed(ERFC[:-1]):
        poly = f"(({c}) + {t} * {poly})"
    return f"(CASE WHEN ({z}) >= 0 THEN 0.5 * {t} * exp(-{x} * {x} + {poly}) ELSE 1.0 - 0.5 * {t} * exp(-{x} * {x} + {poly}) END)"


def fisher(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Odds ratio (infinite if b * c is 0) and one-sided p by the normal approximation of the
    hypergeometric distribution with a continuity correction of one half."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    odds = F.when(b * c != 0, a * d / (b * c)).otherwise(F.lit(float("inf")))
    expected = F.when(n != 0, (a + b) * (a + c) / n).otherwise(0.0)
    variance = F.when(n > 1, (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))).otherwise(1.0)
    z = (a - expected - 0.5) / F.sqrt(F.greatest(variance, F.lit(1e-10)))
    return odds, normal_tail(z)


def fisher_sql(a: str, b: str, c: str, d: str) -> tuple[str, str]:
    a, b, c, d = (f"CAST({x} AS DOUBLE)" for x in (a, b, c, d))
    n = f"({a} + {b} + {c} + {d})"
    odds = f"CASE WHEN {b} * {c} <> 0 THEN {a} * {d} / ({b} * {c}) ELSE CAST('inf' AS DOUBLE) END"
    expected = f"(CASE WHEN {n} <> 0 THEN ({a} + {b}) * ({a} + {c}) / {n} ELSE 0.0 END)"
    variance = f"(CASE WHEN {n} > 1 THEN ({a} + {b}) * ({c} + {d}) * ({a} + {c}) * ({b} + {d}) / ({n} * {n} * ({n} - 1)) ELSE 1.0 END)"
    return odds, normal_tail_sql(f"({a} - {expected} - 0.5) / sqrt(greatest({variance}, 1e-10))")


def proportion(k: Column, n: Column, big_k: Column, big_n: Column) -> tuple[Column, Column, Column]:
    """Expected successes, odds ratio and one-sided p of k of n against big_k of big_n."""
    k, n, big_k, big_n = (x.cast("double") for x in (k, n, big_k, big_n))
    inf = F.lit(float("inf"))
    p = big_k / big_n
    se = F.greatest(F.sqrt(p * (1 - p) / n), F.lit(1e-10))
    tail = F.when((k == 0) | (big_k == 0), 1.0).otherwise(normal_tail((k / n - p) / se))
    ours = F.when(k < n, k / (n - k)).otherwise(inf)
    theirs = F.when(big_k < big_n, big_k / (big_n - big_k)).otherwise(inf)
    return n * p, F.when(theirs > 0, ours / theirs).otherwise(inf), tail


def binomial(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) of the binomial distribution, exactly: a fold over the terms, each made from
    the one before it; the first from logarithms of factorials."""
    k, n = k.cast("long"), n.cast("long")
    p = p.cast("double")

    def log_factorial(m: Column) -> Column:
        return F.aggregate(F.when(m >= 1, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))

    first = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(p) + (n - k) * F.log1p(-p))
    zero = F.struct(F.lit(0.0).alias("sum"), first.alias("term"))
    terms = F.when(k <= n, F.sequence(k, n)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(
        terms,
        zero,
        lambda s, i: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * (n - i) / (i + 1) * p / (1 - p)).alias("term")),
        lambda s: F.least(F.lit(1.0), s["sum"]),
    )
    return F.when((p <= 0) | (k <= 0), 1.0).when(p >= 1, 1.0).otherwise(total)


def benjamini_hochberg(df: DataFrame, p: str, q: str = "q_value") -> DataFrame:
    """``df`` with false discovery rates.  A row's rank counts rows with its p or less; the
    rate is the least p * n / rank from there on.

    The rank needs an order over all rows; ties and ranks are first counted per distinct p,
    so that what is ordered in one place is the table of distinct p, not the rows."""
    per = df.groupBy(p).agg(F.count(F.lit(1)).alias("__c"))
    up = Window.orderBy(F.col(p)).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = per.where(F.col(p).isNotNull()).withColumn("__r", F.sum("__c").over(up)).withColumn("__n", F.max(F.col("__r")).over(Window.partitionBy(F.lit(1))))
    rates = ranked.withColumn(q, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__n") / F.col("__r")).over(down))).select(p, q)
    return df.join(rates, p, "left").select(*df.columns, q)


def midrank_quantile(observed: DataFrame, null: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Per key: the share of null values below the observed one, ties counted half, in
    single precision; null if all null values equal it."""
    o, z = F.col("o.value").cast("float"), F.col("z.value").cast("float")
    joined = observed.select(*keys, F.col(value).alias("value")).alias("o").join(null.select(*keys, F.col(value).alias("value")).alias("z"), keys)
    share = F.avg(F.when(z < o, 1.0).when(z == o, 0.5).otherwise(0.0))
    return joined.groupBy(*keys).agg(F.when(F.min((z == o).cast("int")) == 1, F.lit(None).cast("double")).otherwise(share).alias("quantile"))
