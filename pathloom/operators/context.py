"""Context of a model: attribute filters, co-occurrence in samples, expression calls."""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matching_attribute(df: DataFrame, column: str, value: object, negate: bool = False) -> DataFrame:
    """Rows whose attribute is the value, or one of a list (or not); a null never matches."""
    values = list(value) if isinstance(value, (list, tuple, set)) else [value]
    hit = F.col(column).isin(values)
    return df.where(F.col(column).isNotNull() & (~hit if negate else hit))


def binary_columns(df: DataFrame, key: str) -> DataFrame:
    """The key and the columns that hold only true/false or 0/1, as integers."""
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType) and f.name != key]
    if numbers:
        seen = df.agg(*[F.bool_and(F.col(c).isin(0, 1)).alias(c) for c in numbers]).first()
        numbers = [c for c in numbers if seen[c]]
    return df.select(key, *[F.col(c).cast("int").alias(c) for c in df.columns if c in flags or c in numbers])


def disconnected_reactions(participants: DataFrame, located: DataFrame, threshold: int = 0) -> DataFrame:
    """Reactions with two different defining participants that occur together in at most
    ``threshold`` samples.  ``participants``: r_id, member; ``located``: member, sample.

    Pairs come from the reactions alone, and their common samples are counted by joins, so
    pairs that never meet need no product of all members."""
    p = participants.select("r_id", "member").distinct()
    a, b = p.select("r_id", F.col("member").alias("a")), p.select("r_id", F.col("member").alias("b"))
    pairs = a.join(b, "r_id").where("a < b")
    apart = pairs.select("a", "b").distinct()
    l = located.select("member", "sample").distinct()  # noqa: E741
    both = apart.join(l.select(F.col("member").alias("a"), "sample"), "a").join(l.select(F.col("member").alias("b"), "sample"), ["b", "sample"])
    counted = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    together = apart.join(counted, ["a", "b"], "left").where(F.coalesce("n", F.lit(0)) <= threshold)
    return pairs.join(together.select("a", "b"), ["a", "b"], "left_semi").select("r_id").distinct()


# --- expression ------------------------------------------------------------------


def peak_mean(x: np.ndarray, y: np.ndarray, height: float = 0.02, distance: float = 1.0) -> float:
    """The right-most local maximum of a density that is high enough and, of those closer than
    ``distance``, the highest; the highest point if there is none."""
    top = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:])) + 1
    top = top[y[top] >= height]
    kept: list[int] = []
    for i in top[np.argsort(-y[top], kind="stable")].tolist():
        if all(abs(x[i] - x[j]) >= distance for j in kept):
            kept.append(i)
    return float(x[max(kept)] if kept else x[int(np.argmax(y))])


def zfpkm_of(values: np.ndarray, points: int = 512) -> np.ndarray:
    """z-scores of log2 expression against the active genes: mean at the right-most density
    peak, deviation from the mean of what lies above it."""
    with np.errstate(divide="ignore"):
        logs = np.log2(values)
    fine = logs[np.isfinite(logs)]
    if len(fine) < 2 or float(fine.std(ddof=1)) == 0.0:
        return np.full(len(values), np.nan)
    width = float(fine.std(ddof=1)) * len(fine) ** -0.2
    low, high = fine.min() - 3 * width, fine.max() + 3 * width
    x = np.linspace(low, high, points)
    # the density of binned values: exact to the bin width, linear in the number of values
    bins = np.clip(((fine - low) / (high - low) * (points - 1)).round().astype(int), 0, points - 1)
    count = np.bincount(bins, minlength=points)
    kernel = np.exp(-0.5 * ((x[:, None] - x[None, :]) / width) ** 2) / (width * np.sqrt(2 * np.pi))
    mu = peak_mean(x, kernel @ count / len(fine))
    above = fine[fine > mu]
    sd = (above.mean() - mu) * np.sqrt(np.pi / 2) if len(above) else float(fine.std(ddof=1))
    return (logs - mu) / (sd if sd > 0 else float(fine.std(ddof=1)))


def zfpkm(long: DataFrame) -> DataFrame:
    """sample, gene, value, zfpkm; a sample's values are one group (as many rows as genes)."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.copy()
        frame["zfpkm"] = zfpkm_of(frame["value"].to_numpy(float))
        return frame

    kinds = dict(long.dtypes)
    rows = long.select("sample", "gene", F.col("value").cast("double").alias("value"))
    return rows.groupBy("sample").applyInPandas(work, f"sample {kinds['sample']}, gene {kinds['gene']}, value double, zfpkm double")


def discretise(long: DataFrame, least_sum: float = 50.0, threshold: float = -3.0) -> DataFrame:
    """sample, gene, active (0/1): genes with enough expression in all, called by z-score."""
    known = long.groupBy("gene").agg(F.sum("value").alias("s")).where(F.col("s") >= least_sum).select("gene")
    scored = zfpkm(long.join(known, "gene", "left_semi"))
    return scored.select("sample", "gene", F.coalesce((F.col("zfpkm") > threshold) & ~F.isnan("zfpkm"), F.lit(False)).cast("int").alias("active"))


