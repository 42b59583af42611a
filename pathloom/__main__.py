"""python -m pathloom COMMAND ...: jobs over models that are stored as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .model import PathwayModel
from .operators import consensus, context, integrity, traverse, wiring
from .sources import readers


def integrate(spark: SparkSession, a: argparse.Namespace) -> None:
    """SBML files to a model."""
    t = readers.read(spark, "sbml", a.input)
    sc = t["compartmentalized_species"]
    name = F.regexp_replace("sc_name", r"\s*\[.*\]$", "")
    species = sc.select(name.alias("s_name")).distinct()
    species = integrity.next_ids(species, spark.createDataFrame([(-1,)], "m long"), "S", ["s_name"], "s_id")
    sc = sc.withColumn("s_name", name).join(species, "s_name").select("sc_id", "sc_name", "s_id", "c_id")
    p = t["reaction_species"].withColumn("rsc_id", F.concat_ws("-", "r_id", "sc_id", "sbo_term"))
    PathwayModel({"compartments": t["compartments"].drop("file", "urls"), "species": species, "compartmentalized_species": sc, "reactions": t["reactions"].drop("file"), "reaction_species": p.drop("file")}).save(a.output, a.overwrite)


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    """Several models to one."""
    models = {}
    for path in a.models:
        m = PathwayModel.load(spark, path)
        models[path] = consensus.Model(m["compartments"], m["species"], m["compartmentalized_species"], m["reactions"], m["reaction_species"])
    out = consensus.merge_models(models)
    p = out.participants.withColumn("rsc_id", F.concat_ws("-", "r_id", "sc_id", "sbo_term"))
    PathwayModel({"compartments": out.compartments, "species": out.species, "compartmentalized_species": out.cspecies, "reactions": out.reactions, "reaction_species": p}).save(a.output, a.overwrite)


def graph(spark: SparkSession, a: argparse.Namespace) -> None:
    """A model to the edges of its network."""
    m = PathwayModel.load(spark, a.model)
    edges = wiring.wire(m["reaction_species"], a.wiring, a.drop_reactions)
    edges = wiring.add_degrees(wiring.deduplicate(wiring.add_reverse(edges, m["reactions"])))
    (wiring.reverse(edges) if a.reverse else edges).write.mode("overwrite" if a.overwrite else "error").parquet(a.output)


def distances(spark: SparkSession, a: argparse.Namespace) -> None:
    """A network to its table of distances."""
    out = traverse.hop_and_weight(spark.read.parquet(a.graph), a.weights, a.max_steps)
    if a.quantile < 1:
        out = traverse.quantile_filter(out, [c for c in out.columns if c.startswith("path_")], a.quantile)
    out.write.mode("overwrite" if a.overwrite else "error").parquet(a.output)


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    print("\n".join(PathwayModel.load(spark, a.model).faults()) or "valid")


def summarise(spark: SparkSession, a: argparse.Namespace) -> None:
    PathwayModel.load(spark, a.model).profile().show(truncate=False)


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    PathwayModel.load(spark, a.model).export_tsv(a.output)


def locate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Give compartments to species that have none."""
    m = PathwayModel.load(spark, a.model)
    sc = integrity.infer_compartments(m["compartmentalized_species"], m["reaction_species"])
    PathwayModel(m.tables | {"compartmentalized_species": sc}, m.species_data, m.reactions_data).save(a.output, a.overwrite)


def name_species(spark: SparkSession, a: argparse.Namespace) -> None:
    m = PathwayModel.load(spark, a.model)
    sc = integrity.name_cspecies(m["compartmentalized_species"], m["species"], m["compartments"])
    PathwayModel(m.tables | {"compartmentalized_species": sc}, m.species_data, m.reactions_data).save(a.output, a.overwrite)


def drop_cofactors(spark: SparkSession, a: argparse.Namespace) -> None:
    m = PathwayModel.load(spark, a.model)
    found = integrity.find_cofactors(m["species"].select("s_id", F.inline("identifiers")))
    forms = m["compartmentalized_species"].join(found, "s_id").select("sc_id", "cofactor")
    hits = integrity.cofactor_hits(m["reaction_species"], forms)
    PathwayModel(m.tables | {"reaction_species": m["reaction_species"].join(hits, "rsc_id", "left_anti")}, m.species_data, m.reactions_data).save(a.output, a.overwrite)


def filter_species(spark: SparkSession, a: argparse.Namespace) -> None:
    """Remove the species whose attribute in a side table is one of the values."""
    m = PathwayModel.load(spark, a.model)
    data = spark.read.parquet(a.table)
    gone = context.matching_attribute(data, a.attribute, a.values, a.negate).select("s_id").distinct()
    m.remove_species(gone).save(a.output, a.overwrite)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, f, *args: str, **more: object) -> argparse.ArgumentParser:  # noqa: ANN001
        c = sub.add_parser(name, help=(f.__doc__ or "").strip())
        for x in args:
            c.add_argument(x)
        c.add_argument("--overwrite", action="store_true")
        c.set_defaults(run=f)
        return c

    add("integrate", integrate, "input", "output")
    add("consensus", merge, "output").add_argument("models", nargs="+")
    c = add("graph", graph, "model", "output")
    c.add_argument("--wiring", default="regulatory", choices=["bipartite", "regulatory", "surrogate"])
    c.add_argument("--drop-reactions", default="same_tier", choices=["always", "edgelist", "same_tier"])
    c.add_argument("--reverse", action="store_true")
    c = add("distances", distances, "graph", "output")
    c.add_argument("--weights", nargs="*", default=[])
    c.add_argument("--max-steps", type=int, default=-1)
    c.add_argument("--quantile", type=float, default=1.0)
    add("validate", validate, "model")
    add("summarise", summarise, "model")
    add("export", export, "model", "output")
    add("locate", locate, "model", "output")
    add("name", name_species, "model", "output")
    add("drop-cofactors", drop_cofactors, "model", "output")
    c = add("filter", filter_species, "model", "table", "output", "attribute")
    c.add_argument("values", nargs="+")
    c.add_argument("--negate", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"pathloom {a.command}").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
