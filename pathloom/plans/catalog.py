"""Queries over the driver's tables, each with the SQL that says what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import wiring
from . import models, networks, results, sources, tables  # noqa: F401  (they register their queries)
from .adapters import Tables
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "entry"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model, regulatory wiring, degrees: the edges of the network with what they carry."""
    t = Tables(spark, sf_dir)
    return wiring.add_degrees(wiring.deduplicate(wiring.add_reverse(wiring.wire(t.participants()), t.reactions())))
