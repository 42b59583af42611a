"""Line dedup by distinct-site spread (operator 10).

A line (a text is cut at ``\\n``) is boilerplate if it stands in documents of at least
``min_sites`` distinct sites (``source``).  Per line hash a HyperLogLog sketch of the
sites is merged by aggregation, first inside the tasks of the input.  An estimate off
the threshold by more than the sketch's error settles a line; the lines in between get
exact distinct counts; an estimate further off is off by over four of its standard errors
if it is wrong.  Boilerplate lines are then taken out of every document that keeps a line
of its own, however short.  A document of nothing but boilerplate (and blank lines) is a
copy of something widespread rather than a carrier of it, and is left whole: such copies
are near-duplicates' business.

Defined results: a null text is empty; a null source is no site; blank lines (of spaces
or nothing) are never boilerplate; rows that repeat are treated alike; a row with a null
doc_id counts for the spread and keeps its text; an empty table gives an empty result;
other columns are passed through by :func:`remove_boilerplate` (one that is named like an
added column is called ``NAME_input``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, keep_clear, light_or_shuffled, materialise, small_or_shuffled

MIN_SITES = 10
#: log2 of the registers of a sketch, and its relative standard error (1.04 / sqrt(registers)).
LG_K = 10
ERROR = 0.0325


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column) -> Column:
    """128 bits of a line, as a binary value."""
    return F.substring(F.unhex(F.sha2(line, 256)), 1, 16)


def boilerplate(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The hashes (``line_id``) of the lines that at least ``min_sites`` sites share.

    Two sites or more need as many occurrences, so lines that occur less often than
    ``min_sites`` times are gone after a plain count; what is left gets sketches."""
    occurrence = (
        documents.where(F.col("source").isNotNull())
        .select(F.col("source").alias("site"), F.explode(lines_of(F.col("text"))).alias("line"))
        .where(F.trim("line") != "")
        .select("site", F.xxhash64("line").alias("short"), "line")
    )
    # map-side partial counts by a short hash; at most as many rows leave as the task has distinct lines
    often = occurrence.groupBy("short").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("short")
    often = materialise(often, "lines-often")
    found = occurrence.join(small_or_shuffled(often), "short", "left_semi").select("site", line_hash(F.col("line")).alias("line_id"))
    # a line and site once per task and line: rows shrink before the sketches are built
    spread = materialise(
        found.groupBy("line_id").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).select("line_id", F.hll_sketch_estimate("sketch").alias("sites")),
        "lines-spread",
    )
    margin = 4 * ERROR * min_sites + 1
    sure = spread.where(F.col("sites") > min_sites + margin).select("line_id")
    near = spread.where(F.abs(F.col("sites") - min_sites) <= margin).select("line_id")
    exact = (
        found.join(small_or_shuffled(near), "line_id", "left_semi")
        .distinct()
        .groupBy("line_id")
        .agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("line_id")
    )
    out = materialise(sure.unionByName(exact), "lines-boilerplate")
    drop(often)
    drop(spread)
    return out


def remove_boilerplate(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``documents`` with ``text`` without its boilerplate lines, and ``__n_lines`` and
    ``__n_removed``."""
    documents = keep_clear(documents, "__at", "__hits", "__lines", "__own", "__row", "__n_lines", "__n_removed")
    common = boilerplate(documents, min_sites)
    # rows that repeat a doc_id may have different texts: a row is known by 128 bits of both
    text = F.coalesce("text", F.lit(""))
    row = F.when(F.col("doc_id").isNotNull(), F.struct(F.xxhash64("doc_id", text).alias("a"), F.xxhash64(F.lit("row"), text, "doc_id").alias("b")))
    keyed = documents.withColumn("__row", row)
    hits = (
        keyed.where(F.col("doc_id").isNotNull())
        .select("__row", F.posexplode(lines_of(F.col("text"))).alias("__at", "line"))
        .where(F.trim("line") != "")
        .select("__row", "__at", line_hash(F.col("line")).alias("line_id"))
        .join(small_or_shuffled(common), "line_id", "left_semi")
    )
    per_row = materialise(hits.groupBy("__row").agg(F.collect_set("__at").alias("__hits")), "lines-hits")
    drop(common)
    joined = keyed.join(light_or_shuffled(per_row, 8 * F.size("__hits")), "__row", "left").withColumn("__lines", lines_of(F.col("text")))
    # set operations over places and a look-up by place: linear in the lines of a document
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__hits"))
    own = joined.withColumn("__own", F.transform(places, lambda i: F.get(F.col("__lines"), i)))
    cut = F.coalesce(F.exists("__own", lambda line: F.trim(line) != ""), F.lit(False))
    return own.select(
        *[F.when(cut, F.array_join("__own", "\n")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in documents.columns],
        F.size("__lines").cast("long").alias("__n_lines"),
        F.when(cut, F.size("__lines") - F.size("__own")).otherwise(0).cast("long").alias("__n_removed"),
    )
