"""The driver's tables seen as a pathway model, as a network and as sets.

| model | table |
|---|---|
| compartments | region |
| species | part: brand (is), type (has part) and size (homolog) are its identifiers |
| compartmentalized species | parts by the regions of their suppliers |
| reactions | orders, reversible if open; pathways are their customers' segments |
| participants | lineitem: R is consumed, A is made, N acts (O: catalyst, F: inhibitor) |
| network | suppliers to parts; nations to each other by trade |
| sets | brands and types over parts |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as V


class Tables:
    """The tables of one folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # --- the model ---------------------------------------------------------------

    def compartments(self) -> DataFrame:
        return self.region.select(F.concat(F.lit("C"), F.lpad(F.col("r_regionkey").cast("string"), 8, "0")).alias("c_id"), F.col("r_name").alias("c_name"))

    def species(self) -> DataFrame:
        def one(ontology: str, column: str, bqb: str):  # noqa: ANN202
            return F.struct(F.lit(ontology).alias("ontology"), F.col(column).cast("string").alias("identifier"), F.when(F.lit(ontology == "size"), F.lit(None).cast("string")).otherwise(F.concat(F.lit("https://parts.example/"), F.lit(f"{ontology}/"), F.col(column).cast("string"))).alias("url"), F.lit(bqb).alias("bqb"))

        ids = F.array(one("brand", "p_brand", "BQB_IS"), one("type", "p_type", "BQB_HAS_PART"), one("size", "p_size", "BQB_IS_HOMOLOG_TO"))
        return self.part.select(F.col("p_partkey").alias("s_id"), F.col("p_name").alias("s_name"), ids.alias("identifiers"))

    def supplier_region(self) -> DataFrame:
        return self.supplier.join(F.broadcast(self.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("c_id"))

    def participants(self) -> DataFrame:
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        code = F.when(flag == "R", V.ROLE_CODES["reactant"]).when(flag == "A", V.ROLE_CODES["product"]).when(status == "O", V.ROLE_CODES["catalyst"]).otherwise(V.ROLE_CODES["inhibitor"])
        s = F.when(flag == "R", -1.0).when(flag == "A", 1.0).otherwise(0.0)
        j = self.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").join(self.supplier_region(), "l_suppkey")
        return j.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rsc_id"),
            F.concat(F.lit("R"), F.col("l_orderkey").cast("string")).alias("r_id"),
            F.concat_ws("_", F.lit("P"), "l_partkey", "c_id").alias("sc_id"),
            F.col("l_partkey").alias("s_id"),
            "c_id",
            s.alias("stoichiometry"),
            code.alias("sbo_term"),
        )

    def cspecies(self) -> DataFrame:
        return self.participants().select("sc_id", "s_id", "c_id").distinct()

    def reactions(self) -> DataFrame:
        return self.orders.join(self.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select(
            F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("r_id"), F.col("o_orderpriority").alias("r_name"), (F.col("o_orderstatus") == "O").alias("r_isreversible"), F.col("c_mktsegment").alias("pathway_id")
        )

    def identifiers(self) -> DataFrame:
        return self.species().select("s_id", "s_name", F.inline("identifiers"))

    # --- the network -------------------------------------------------------------

    def supplies(self) -> DataFrame:
        """Suppliers to parts, a row a line."""
        return self.lineitem.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")

    def trade(self) -> DataFrame:
        """Nations (of customers) to nations (of suppliers), with a weight that is the smaller
        the more is bought; only what is bought more than on average."""
        o = self.orders.select("o_orderkey", "o_custkey").join(self.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        j = self.lineitem.select("l_orderkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(F.broadcast(self.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")), "l_suppkey")
        n = j.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
        mean = n.agg(F.avg("n").alias("m")).withColumn("k", F.lit(1))
        kept = n.withColumn("k", F.lit(1)).join(F.broadcast(mean), "k").where((F.col("n") > F.col("m")) & (F.col("src") != F.col("dst")))
        return kept.select("src", "dst", "n", (1000.0 / F.col("n")).alias("weight"))

    def brand_sets(self) -> DataFrame:
        return self.part.select(F.col("p_brand").alias("geneset"), F.col("p_partkey").alias("member"))


#: The same views as SQL, for the oracle.
VIEWS = {
    "supplier_region": "SELECT s_suppkey AS l_suppkey, n_regionkey AS c_id FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "participants": """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS rsc_id, 'R' || l_orderkey AS r_id, 'P_' || l_partkey || '_' || c_id AS sc_id,
        l_partkey AS s_id, c_id, CASE l_returnflag WHEN 'R' THEN -1.0 WHEN 'A' THEN 1.0 ELSE 0.0 END::DOUBLE AS stoichiometry,
        CASE WHEN l_returnflag = 'R' THEN 'SBO:0000010' WHEN l_returnflag = 'A' THEN 'SBO:0000011' WHEN l_linestatus = 'O' THEN 'SBO:0000013' ELSE 'SBO:0000020' END AS sbo_term
        FROM lineitem JOIN supplier_region USING (l_suppkey)""",
    "cspecies": "SELECT DISTINCT sc_id, s_id, c_id FROM participants",
    "reactions": "SELECT 'R' || o_orderkey AS r_id, o_orderpriority AS r_name, o_orderstatus = 'O' AS r_isreversible, c_mktsegment AS pathway_id FROM orders JOIN customer ON o_custkey = c_custkey",
    "identifiers": """SELECT p_partkey AS s_id, p_name AS s_name, 'brand' AS ontology, p_brand AS identifier, 'https://parts.example/brand/' || p_brand AS url, 'BQB_IS' AS bqb FROM part
        UNION ALL SELECT p_partkey, p_name, 'type', p_type, 'https://parts.example/type/' || p_type, 'BQB_HAS_PART' FROM part
        UNION ALL SELECT p_partkey, p_name, 'size', CAST(p_size AS VARCHAR), NULL, 'BQB_IS_HOMOLOG_TO' FROM part""",
    "supplies": "SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem",
    "trade_all": """SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "trade": "SELECT src, dst, n, 1000.0::DOUBLE / n AS weight FROM trade_all WHERE n > (SELECT avg(n) FROM trade_all) AND src <> dst",
    "brand_sets": "SELECT p_brand AS geneset, p_partkey AS member FROM part",
}
_NEEDS = {"participants": ["supplier_region"], "cspecies": ["participants"], "trade": ["trade_all"]}


def with_views(names: list[str], body: str, recursive: bool = False) -> str:
    """``body`` with the named views (and what they need) as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + ("\n" if body.lstrip().upper().startswith("SELECT") else ",\n") + body
