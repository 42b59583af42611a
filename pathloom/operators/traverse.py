"""Iterative operators over networks: components, distances, paths, closure.

Every round is a join and an aggregation; between rounds the state is written to the
shared folder, so that lineage stays short and a lost executor costs one round."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import drop, materialise


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """name and component (its smallest name) of all ends of the edges, directions aside.

    Rounds of large-star and small-star: each ties nodes to the smallest neighbour known, in
    a number of rounds that grows with the logarithm of a component's size."""
    ends = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
    every = ends.select(F.col("a").alias("name")).union(ends.select(F.col("b").alias("name"))).distinct()
    e = materialise(ends.where("a < b").distinct(), "components")
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").where("m < a").select(F.col("m").alias("x"), F.col("a").alias("y"))
        nxt = materialise(small.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b")).distinct(), "components")
        chained = not nxt.select("a").distinct().join(nxt.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
        twice = not nxt.groupBy("b").count().where("count > 1").isEmpty()
        drop(e)
        e = nxt
        if not chained and not twice:
            break
    return every.join(e.select(F.col("b").alias("name"), F.col("a").alias("component")), "name", "left").select("name", F.coalesce("component", "name").alias("component"))


def largest_components(edges: DataFrame, k: int = 1) -> DataFrame:
    """component and size of the k largest, ties to the smaller name."""
    return components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component").limit(k)


def distances(edges: DataFrame, sources: DataFrame | None = None, weight: str | None = None, max_steps: int | None = 10, src: str = "src", dst: str = "dst") -> DataFrame:
    """origin, dest, distance of the shortest paths of at most ``max_steps`` edges (None: of any
    number); a weight column, or one a step without.  Self-pairs are left out.

    Frontier relaxation: a round joins only the pairs that got shorter in the last one to the
    edges, so its work is that of the pairs still changing.  A pair is kept once, at its
    least distance (partial aggregation first)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = materialise(edges.select(F.col(src).alias("u"), F.col(dst).alias("v"), w.alias("w")).groupBy("u", "v").agg(F.min("w").alias("w")), "edges")
    starts = sources.select(F.col("name").alias("u")).distinct() if sources is not None else None
    first = e.join(starts, "u", "left_semi") if starts is not None else e
    known = materialise(first.where("u <> v").select(F.col("u").alias("origin"), F.col("v").alias("dest"), F.col("w").alias("distance")), "distances")
    frontier = state = known
    if max_steps is None:  # a shortest path passes a vertex once, unless a cycle gets shorter with every turn
        most = max(2, e.select("u").union(e.select("v")).distinct().count() + 1)
    else:
        most = max_steps
    for _ in range(1, most):
        step = frontier.join(e, F.col("dest") == F.col("u")).where("origin <> v").groupBy("origin", F.col("v").alias("dest")).agg(F.min(F.col("distance") + F.col("w")).alias("new"))
        merged = known.join(step, ["origin", "dest"], "full")
        merged = merged.select("origin", "dest", F.least("distance", "new").alias("distance"), (F.col("distance").isNull() | (F.col("new") < F.col("distance") - 1e-12)).alias("changed"))
        both = materialise(merged, "distances")
        frontier = both.where("changed").select("origin", "dest", "distance")
        known = both.select("origin", "dest", "distance")
        drop(state)
        state = both
        if frontier.isEmpty():
            break
    else:
        if max_steps is None and not frontier.isEmpty():
            raise ValueError("a cycle of negative weight has no shortest path")
    return known


def hop_and_weight(edges: DataFrame, weights: list[str], max_steps: int = -1, sources: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """sc_id_origin, sc_id_dest, path_length and a shortest weighted distance for each weight.
    The hop limit (none below 1) holds for the hop counts; a weighted path may take more hops,
    any number unless there is a ``limit``."""
    hops = distances(edges, sources, None, max_steps if max_steps > 0 else limit)
    out = hops.select(F.col("origin").alias("sc_id_origin"), F.col("dest").alias("sc_id_dest"), F.col("distance").alias("path_length"))
    for w in weights:
        d = distances(edges, sources, w, limit).select(F.col("origin").alias("sc_id_origin"), F.col("dest").alias("sc_id_dest"), F.col("distance").alias(f"path_{w}"))
        out = out.join(d, ["sc_id_origin", "sc_id_dest"], "left")
    return out


def quantile_filter(table: DataFrame, columns: list[str], q: float) -> DataFrame:
    """Rows at or below the q-quantile (linear interpolation) in any of the columns."""
    limits = table.agg(*[F.percentile(c, q).alias(f"__{c}") for c in columns]).withColumn("__k", F.lit(1))
    keep = None
    for c in columns:
        one = F.coalesce(F.col(c) <= F.col(f"__{c}"), F.lit(False))
        keep = one if keep is None else keep | one
    return table.withColumn("__k", F.lit(1)).join(F.broadcast(limits), "__k").where(keep).select(*table.columns)


def top_n_pairs(table: DataFrame, column: str, n: int, ascending: bool = False) -> DataFrame:
    """Pairs among the ``n`` extreme rows of their origin or of their destination.  The default
    takes the greatest values."""
    order = F.col(column).asc() if ascending else F.col(column).desc()
    a = F.row_number().over(Window.partitionBy("sc_id_origin").orderBy(order, "sc_id_dest"))
    b = F.row_number().over(Window.partitionBy("sc_id_dest").orderBy(order, "sc_id_origin"))
    return table.withColumn("__a", a).withColumn("__b", b).where((F.col("__a") <= n) | (F.col("__b") <= n)).drop("__a", "__b")


def neighbours(edges: DataFrame, focal: DataFrame, order: int, direction: str = "downstream", src: str = "src", dst: str = "dst") -> DataFrame:
    """focal, name, hops of what is reached within ``order`` steps (``upstream``,
    ``downstream`` or ``hourglass``, both), the focal vertex itself at 0."""
    if direction == "hourglass":
        both = neighbours(edges, focal, order, "downstream", src, dst).unionByName(neighbours(edges, focal, order, "upstream", src, dst))
        return both.groupBy("focal", "name").agg(F.min("hops").alias("hops"))
    a, b = (src, dst) if direction == "downstream" else (dst, src)
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).distinct()
    seen = focal.select(F.col("name").alias("focal"), "name", F.lit(0).alias("hops"))
    frontier = seen
    for k in range(1, order + 1):
        nxt = frontier.join(e, F.col("name") == F.col("u")).select("focal", F.col("v").alias("name")).distinct().join(seen, ["focal", "name"], "left_anti")
        frontier = materialise(nxt.withColumn("hops", F.lit(k)), "neighbours")
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def prune_neighbours(table: DataFrame, n: int, column: str = "weight", by: str = "focal") -> DataFrame:
    """The n nearest of each focal vertex; ties with the n-th stay."""
    return table.withColumn("__r", F.rank().over(Window.partitionBy(by).orderBy(column))).where(F.col("__r") <= n).drop("__r")


def shortest_paths(edges: DataFrame, origin: str, targets: DataFrame, weight: str, max_steps: int | None = None) -> DataFrame:
    """All tied shortest paths from ``origin`` to the targets (column ``name``), of at most
    ``max_steps`` edges if it is given: dest, path (array of names, each once) and distance.
    Paths are followed back along tight edges only."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(origin,)], "name string")
    d = materialise(distances(edges, start, weight, max_steps).select(F.col("dest").alias("name"), "distance").unionByName(start.select("name", F.lit(0.0).alias("distance"))), "paths")
    tight = edges.join(d.select(F.col("name").alias("src"), F.col("distance").alias("__a")), "src").join(d.select(F.col("name").alias("dst"), F.col("distance").alias("__b")), "dst")
    tight = materialise(tight.where(F.abs(F.col("__a") + F.col(weight) - F.col("__b")) < 1e-9).select("src", "dst").distinct(), "tight")
    open_ = targets.select("name").distinct().join(d, "name").where(F.col("name") != F.lit(origin)).select(F.col("name").alias("dest"), F.col("name").alias("at"), F.array("name").alias("path"), "distance")
    done = None
    for _ in itertools.count() if max_steps is None else range(max_steps):
        open_ = materialise(open_.join(tight, (F.col("at") == F.col("dst")) & ~F.array_contains("path", F.col("src"))).select("dest", F.col("src").alias("at"), F.concat(F.array("src"), "path").alias("path"), "distance"), "paths")
        end = open_.where(F.col("at") == F.lit(origin)).select("dest", "path", "distance")
        done = end if done is None else done.unionByName(end)
        open_ = open_.where(F.col("at") != F.lit(origin))
        if open_.isEmpty():
            break
    return done


def net_polarity(links: DataFrame, path: str = "path_id", step: str = "step", polarity: str = "link_polarity") -> DataFrame:
    """The running sign along each path: an inhibition turns it, a bystander keeps it, and
    from an ambiguous link on it is marked ambiguous; paths of ambiguous links only are
    ambiguous."""
    run = Window.partitionBy(path).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    p = F.col(polarity)
    turns = F.sum((p == "inhibition").cast("int")).over(run)
    seen = F.max((p == "ambiguous").cast("int")).over(run)
    only = F.min((p == "ambiguous").cast("int")).over(Window.partitionBy(path))
    sign = F.when(turns % 2 == 0, "activation").otherwise("inhibition")
    return links.withColumn("net_polarity", F.when(only == 1, "ambiguous").otherwise(F.concat(F.when(seen == 1, "ambiguous ").otherwise(""), sign)))


def closure(parents: DataFrame, child: str = "child", parent: str = "parent", max_depth: int | None = None) -> DataFrame:
    """(child, ancestor, depth) of a hierarchy, the least depth of each pair; an error if it has
    a cycle.  Paths double in length each round, until nothing is added or, if it is given,
    ``max_depth`` is passed."""
    known = materialise(parents.select(F.col(child).alias("child"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).distinct(), "closure")
    n, reach = known.count(), 1
    while max_depth is None or reach < max_depth:
        far = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.child")).select(F.col("a.child").alias("child"), F.col("b.ancestor").alias("ancestor"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        nxt = materialise(known.unionByName(far).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")), "closure")
        m = nxt.count()
        drop(known)
        known, reach = nxt, 2 * reach
        if m == n:
            break
        n = m
    if not known.where("child = ancestor").isEmpty():
        raise ValueError("the hierarchy has a cycle")
    return known


def best_ancestor(closed: DataFrame, scored: DataFrame) -> DataFrame:
    """For every term the scored term (itself or an ancestor) with the highest score, the
    nearest of equals."""
    own = scored.select(F.col("term").alias("child"), F.col("term").alias("ancestor"), F.lit(0).alias("depth"))
    every = closed.unionByName(own).join(scored.select(F.col("term").alias("ancestor"), "score"), "ancestor")
    return every.groupBy(F.col("child").alias("term")).agg(F.max_by(F.struct("ancestor", "score"), F.struct("score", -F.col("depth"), "ancestor")).alias("x")).select("term", "x.ancestor", "x.score")
