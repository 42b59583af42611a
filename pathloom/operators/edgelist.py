"""Edge lists: de-duplication, reciprocity, subsets and joins with a checked cardinality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def remove_duplicates(edges: DataFrame, order: list[str | Column], src: str = "src", dst: str = "dst") -> DataFrame:
    """One row per (src, dst): the first in the given order."""
    w = Window.partitionBy(src, dst).orderBy(*order)
    return edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def remove_reciprocal(edges: DataFrame, order: list[str | Column] | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """One of A-B and B-A: the first in the given order, or without one the row with src <
    dst; self-loops stay."""
    if order is None:
        return edges.where(F.col(src) <= F.col(dst))
    w = Window.partitionBy(F.least(src, dst), F.greatest(src, dst)).orderBy(*order)
    ranked = edges.withColumn("__n", F.row_number().over(w))
    return ranked.where((F.col("__n") == 1) | (F.col(src) == F.col(dst))).drop("__n")


def reciprocal_share(edges: DataFrame, extra: list[str] | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row: the share of rows whose reverse (with equal extra columns) exists."""
    extra = extra or []
    back = edges.select(F.col(src).alias("__d"), F.col(dst).alias("__s"), *[F.col(c).alias(f"__{c}") for c in extra]).distinct()
    on = (F.col(src) == F.col("__s")) & (F.col(dst) == F.col("__d"))
    for c in extra:
        on &= F.col(c) == F.col(f"__{c}")
    marked = edges.join(back, on, "left").select(F.col("__s").isNotNull().cast("int").alias("hit"))
    return marked.agg(F.sum("hit").cast("long").alias("n_reciprocal"), F.count(F.lit(1)).alias("n_edges"), F.avg("hit").alias("share"))


def has_duplicates(edges: DataFrame, src: str = "src", dst: str = "dst") -> bool:
    return not edges.groupBy(src, dst).count().where("count > 1").isEmpty()


def has_reciprocal(edges: DataFrame, src: str = "src", dst: str = "dst") -> bool:
    """Whether some edge other than a self-loop has its reverse."""
    e = edges.where(F.col(src) != F.col(dst)).select(F.col(src).alias("s"), F.col(dst).alias("d"))
    return not e.join(e.select(F.col("s").alias("d"), F.col("d").alias("s")), ["s", "d"], "left_semi").isEmpty()


def missing_edges(edges: DataFrame, graph: DataFrame, directed: bool = True, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges that the graph doesn't have (in either direction, if undirected)."""
    have = graph.select(src, dst)
    if not directed:
        have = have.unionByName(graph.select(F.col(dst).alias(src), F.col(src).alias(dst)))
    return edges.join(have.distinct(), [src, dst], "left_anti")


def check_cardinality(left: DataFrame, right: DataFrame, keys: list[str], relationship: str) -> None:
    """Raise unless the keys relate as ``1:1``, ``1:m``, ``m:1``, ``1:0`` or ``0:1``."""

    def repeated(df: DataFrame) -> bool:
        return not df.groupBy(*keys).count().where("count > 1").isEmpty()

    if relationship not in ("1:1", "1:m", "m:1", "1:0", "0:1"):
        raise ValueError(f"unknown relationship {relationship!r}")
    a, b = relationship.split(":")
    if a in "01" and repeated(left):
        raise ValueError(f"{keys} repeat on the left of a {relationship} join")
    if b in "01" and repeated(right):
        raise ValueError(f"{keys} repeat on the right of a {relationship} join")
    if "0" not in (a, b):
        if not left.join(right, keys, "left_anti").isEmpty():
            raise ValueError(f"left rows without a match in a {relationship} join")
        if not right.join(left, keys, "left_anti").isEmpty():
            raise ValueError(f"right rows without a match in a {relationship} join")


def merge(left: DataFrame, right: DataFrame, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), relationship: str | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """Join two edge lists on their endpoints; other shared columns get suffixes."""
    keys = [src, dst]
    if relationship:
        check_cardinality(left, right, keys, relationship)
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, keys, how)


def overwrite_merge(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join in which columns of the right replace equally named ones of the left."""
    lost = [c for c in left.columns if c in right.columns and c not in keys]
    return left.drop(*lost).join(right, keys, how)


# --- universes -------------------------------------------------------------------


def universe(filters: list[DataFrame], logic: str, vertices: DataFrame, directed: bool = True, loops: bool = False) -> DataFrame:
    """Distinct (src, dst) pairs that a search may find: those of all (``and``) or any (``or``)
    of the edge filters, between the given vertices.  Without filters it is the complete
    graph, whose pairs are made per vertex rather than by a cross join of rows: every vertex
    is dealt the (checked, broadcast) list of all vertices."""
    if filters:
        out = filters[0].select("src", "dst").distinct()
        for f in filters[1:]:
            f = f.select("src", "dst")
            out = out.intersect(f) if logic == "and" else out.union(f).distinct()
        known = vertices.select(F.col("name"))
        out = out.join(known.withColumnRenamed("name", "src"), "src", "left_semi").join(known.withColumnRenamed("name", "dst"), "dst", "left_semi").select("src", "dst")
    else:
        n = vertices.count()
        if n > 20_000:
            raise ValueError("the complete graph of this many vertices has to be filtered by edges")
        names = vertices.agg(F.array_sort(F.collect_set("name")).alias("all"))
        out = vertices.select(F.col("name").alias("src")).distinct().withColumn("one", F.lit(1)).join(F.broadcast(names.withColumn("one", F.lit(1))), "one").select("src", F.explode("all").alias("dst"))
    if not loops:
        out = out.where(F.col("src") != F.col("dst"))
    if not directed:
        out = out.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return out


# --- vertices --------------------------------------------------------------------


def without_isolated(vertices: DataFrame, edges: DataFrame, node_types: list[str] | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """Vertices without those (of the given types) that no edge touches."""
    used = edges.select(F.col(src).alias("name")).union(edges.select(F.col(dst).alias("name"))).distinct()
    kept = vertices.join(used, "name", "left_semi")
    if node_types is None:
        return kept
    rest = vertices.where(~F.col("node_type").isin(node_types)).join(used, "name", "left_anti")
    return kept.unionByName(rest)


def induced(edges: DataFrame, names: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges between the vertices named in ``names`` (column ``name``)."""
    return edges.join(names.select(F.col("name").alias(src)), src, "left_semi").join(names.select(F.col("name").alias(dst)), dst, "left_semi")


def endpoint_attributes(edges: DataFrame, vertices: DataFrame, attributes: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with the attributes of both endpoints (``source_*`` and ``target_*``)."""
    a = vertices.select(F.col("name").alias(src), *[F.col(c).alias(f"source_{c}") for c in attributes])
    b = vertices.select(F.col("name").alias(dst), *[F.col(c).alias(f"target_{c}") for c in attributes])
    return edges.join(a, src, "left").join(b, dst, "left")


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """name, n_parents, n_children and degree over distinct edges: every edge gives a row to
    each endpoint, counted in one aggregation."""
    e = edges.select(src, dst).distinct()
    ends = e.select(F.col(src).alias("name"), F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(e.select(F.col(dst).alias("name"), F.lit(0).alias("c"), F.lit(1).alias("p")))
    return ends.groupBy("name").agg(F.sum("p").cast("long").alias("n_parents"), F.sum("c").cast("long").alias("n_children"), F.sum(F.col("p") + F.col("c")).cast("long").alias("degree"))
