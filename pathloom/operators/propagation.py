"""Personalised PageRank over many resets at once, and its null distributions."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import midrank_quantile
from ..runtime import drop, materialise, small_or_shuffled


def pagerank(edges: DataFrame, vertices: DataFrame, resets: DataFrame, damping: float = 0.85, iterations: int | None = None, tolerance: float = 1e-10, directed: bool = True) -> DataFrame:
    """run, name, value.  ``resets`` (run, name, value) holds the positive reset weights of any
    number of runs; they are normalised per run.  Every run has a row for every
    vertex.  Mass at vertices without edges out goes back by the reset weights.  Rounds go on
    until no value changes by ``tolerance``, or as many as ``iterations`` says.

    Each round is one join of the values to the edges and one aggregation by (run, vertex),
    for all runs together; the sums that a run needs as a whole are one row a run."""
    e = edges.select("src", "dst")
    if not directed:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    e = materialise(e.join(out, "src").select("src", "dst", (1.0 / F.col("n")).alias("share")), "pr-edges")
    total = Window.partitionBy("run")
    reset = resets.where("value > 0").join(vertices.select("name").distinct(), "name", "left_semi")
    reset = materialise(reset.select("run", "name", (F.col("value") / F.sum("value").over(total)).alias("reset")), "pr-reset")
    sinks = materialise(vertices.select("name").distinct().join(out.select(F.col("src").alias("name")), "name", "left_anti"), "pr-sinks")
    p = reset.select("run", "name", F.col("reset").alias("value"))
    if iterations is None and not tolerance:
        raise ValueError("a number of rounds or a tolerance is needed")
    for k in itertools.count() if iterations is None else range(iterations):
        moved = p.join(e, F.col("name") == F.col("src")).groupBy("run", F.col("dst").alias("name")).agg(F.sum(F.col("value") * F.col("share")).alias("moved"))
        lost = p.join(sinks, "name", "left_semi").groupBy("run").agg(F.sum("value").alias("lost"))
        back = reset.join(lost, "run", "left").select("run", "name", (F.col("reset") * (1 - damping + damping * F.coalesce("lost", F.lit(0.0)))).alias("back"))
        nxt = moved.join(back, ["run", "name"], "full").select("run", "name", (damping * F.coalesce("moved", F.lit(0.0)) + F.coalesce("back", F.lit(0.0))).alias("value"))
        nxt = materialise(nxt, "pr")
        if tolerance and k % 5 == 4:
            change = nxt.alias("a").join(p.alias("b"), ["run", "name"], "full").agg(F.max(F.abs(F.coalesce("a.value", F.lit(0.0)) - F.coalesce("b.value", F.lit(0.0))))).first()[0]
            drop(p)
            p = nxt
            if change is None or change < tolerance:
                break
        else:
            drop(p)
            p = nxt
    runs = reset.select("run").distinct()
    # the runs go to the vertices where they lie, whatever their number
    every = vertices.select("name").distinct().crossJoin(small_or_shuffled(runs))
    return every.join(p, ["run", "name"], "left").select("run", "name", F.coalesce("value", F.lit(0.0)).alias("value"))


#: Propagation methods by name.
METHODS: dict[str, Callable[..., DataFrame]] = {"personalized_pagerank": pagerank}


# --- null resets: (attribute, sample, name, value) -------------------------------


def uniform(attributes: DataFrame) -> DataFrame:
    """One sample: equal values on the vertices that count (value > 0)."""
    return attributes.where("value > 0").select("attribute", F.lit(0).alias("sample"), "name", F.lit(1.0).alias("value"))


def permuted(attributes: DataFrame, samples: int, seed: int = 0, replace: bool = False) -> DataFrame:
    """Values dealt anew among an attribute's vertices: the k-th vertex by name gets the k-th
    value in an order by hash (or, with replacement, a value at a hashed place)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("attribute"))
    by_name = attributes.withColumn("k", F.row_number().over(Window.partitionBy("attribute").orderBy("name"))).withColumn("n", n)
    dealt = by_name.select("attribute", "name", "k", "n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    if replace:
        dealt = dealt.withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "sample", "name", "attribute"), F.col("n")) + 1)
        values = by_name.select("attribute", F.col("k").alias("at"), "value")
        return dealt.join(values, ["attribute", "at"]).select("attribute", "sample", "name", "value")
    w = Window.partitionBy("attribute", "sample").orderBy(F.xxhash64(F.lit(seed), "sample", "name"), "name")
    order = dealt.withColumn("at", F.row_number().over(w)).select("attribute", "sample", "name", "at")
    values = by_name.select("attribute", F.col("k").alias("at"), "value")
    return order.join(values, ["attribute", "at"]).select("attribute", "sample", "name", "value")


def pooled(attributes: DataFrame, samples: int, seed: int = 0) -> DataFrame:
    """Samples drawn with replacement from the values of all attributes together; the same
    for every attribute."""
    names = attributes.select("attribute").distinct()
    from ..runtime import numbered

    pool = numbered(attributes.withColumn("attribute", F.lit("pool")), ["value", "name"], "at")
    ranked = pool.withColumn("at", F.col("at") + 1)
    n = ranked.groupBy("attribute").agg(F.max("at").alias("n"))
    drawn = attributes.select("name").distinct().withColumn("attribute", F.lit("pool")).join(F.broadcast(n), "attribute")
    drawn = drawn.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "sample", "name"), F.col("n")) + 1)
    one = drawn.join(ranked.select("attribute", "at", "value"), ["attribute", "at"]).select("sample", "name", "value")
    return one.withColumn("k", F.lit(1)).join(F.broadcast(names.withColumn("k", F.lit(1))), "k").select("attribute", "sample", "name", "value")


def parametric(attributes: DataFrame, samples: int, seed: int = 0) -> DataFrame:
    """Values of a normal distribution with the attribute's mean and deviation; those below 0
    count as 0."""
    fit = attributes.groupBy("attribute").agg(F.avg("value").alias("m"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("s"))
    rows = attributes.join(fit, "attribute").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    u = (F.pmod(F.xxhash64(F.lit(seed), "attribute", "sample", "name"), F.lit(1 << 53)) + 1) / float((1 << 53) + 2)
    v = (F.pmod(F.xxhash64(F.lit(seed + 1), "attribute", "sample", "name"), F.lit(1 << 53)) + 1) / float((1 << 53) + 2)
    z = F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * F.pi() * v)
    return rows.select("attribute", "sample", "name", F.greatest(F.lit(0.0), F.col("m") + F.col("s") * z).alias("value"))


def rewired(edges: DataFrame, samples: int, swaps: float = 10.0, seed: int = 0) -> DataFrame:
    """sample, src, dst: edges with their ends swapped in pairs, ``swaps`` tries an edge, which
    leaves every vertex its degrees.  Swaps follow each other, so a sample is one group."""
    import numpy as np
    import pandas as pd

    rows = edges.select("src", "dst").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["src", "dst"], kind="stable").reset_index(drop=True)
        src, dst = frame["src"].tolist(), frame["dst"].tolist()
        have = set(zip(src, dst, strict=True))
        rng = np.random.default_rng(seed + int(key[0]))
        for i, j in rng.integers(0, max(1, len(src)), (int(swaps * len(src)), 2)).tolist():
            a, b = (src[i], dst[j]), (src[j], dst[i])
            if a in have or b in have or a[0] == a[1] or b[0] == b[1] or i == j:
                continue
            have -= {(src[i], dst[i]), (src[j], dst[j])}
            have |= {a, b}
            dst[i], dst[j] = dst[j], dst[i]
        return pd.DataFrame({"sample": key[0], "src": src, "dst": dst})

    kind = dict(edges.dtypes)
    return rows.groupBy("sample").applyInPandas(work, f"sample int, src {kind['src']}, dst {kind['dst']}")


NULLS: dict[str, Callable[..., DataFrame]] = {
    "uniform": lambda attributes, samples, seed: uniform(attributes),
    "vertex_permutation": permuted,
    "pooled_vertex_permutation": pooled,
    "parametric": parametric,
}


def log2_enrichment(observed: DataFrame, null: DataFrame, keys: list[str], epsilon: float = 1e-10) -> DataFrame:
    """log2 of the observed value over the mean null value plus epsilon."""
    mean = null.groupBy(*keys).agg(F.avg("value").alias("__m"))
    return observed.join(mean, keys).select(*keys, F.log2(F.col("value") / (F.col("__m") + epsilon)).alias("log2_enrichment"))


def with_null(edges: DataFrame, vertices: DataFrame, attributes: DataFrame, strategy: str = "vertex_permutation", samples: int = 100, seed: int = 0, epsilon: float = 1e-10, **more: object) -> DataFrame:
    """attribute, name, observed, quantile, log2_enrichment: propagated attributes against the
    propagated null samples, all runs in one job."""
    run = F.to_json(F.struct("attribute", "sample"))
    observed = pagerank(edges, vertices, attributes.select(F.col("attribute").alias("run"), "name", "value"), **more)
    observed = materialise(observed.select(F.col("run").alias("attribute"), "name", "value"), "observed")
    resets = NULLS[strategy](attributes, samples, seed)
    null = pagerank(edges, vertices, resets.withColumn("run", run).select("run", "name", "value"), **more)
    null = materialise(null.select(F.get_json_object("run", "$.attribute").alias("attribute"), "name", "value"), "null")
    keys = ["attribute", "name"]
    out = observed.select(*keys, F.col("value").alias("observed"))
    if strategy != "uniform":
        out = out.join(midrank_quantile(observed, null, keys), keys, "left")
    return out.join(log2_enrichment(observed, null, keys, epsilon), keys, "left")


def merge_runs(runs: list[DataFrame], epsilon: float = 1e-10) -> DataFrame:
    """Several runs as one: mean quantiles, and the enrichment over the mean of the null means
    that the runs' enrichments stand for."""
    out = None
    for k, df in enumerate(runs):
        if "quantile" not in df.columns:
            raise ValueError("runs without quantiles can't be merged")
        part = df.withColumn("run", F.lit(k))
        out = part if out is None else out.unionByName(part)
    mean = F.col("observed") / F.pow(F.lit(2.0), F.col("log2_enrichment")) - epsilon
    merged = out.withColumn("__m", mean).groupBy("attribute", "name").agg(F.avg("observed").alias("observed"), F.avg("quantile").alias("quantile"), F.avg("__m").alias("__m"))
    return merged.withColumn("log2_enrichment", F.log2(F.col("observed") / (F.col("__m") + epsilon))).drop("__m")


def allocate(samples: int, attributes: list[str]) -> dict[str, int]:
    """Samples dealt evenly, the first attributes taking what is left over."""
    each, more = divmod(samples, len(attributes))
    return {a: each + (k < more) for k, a in enumerate(attributes)}
