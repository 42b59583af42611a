"""A pathway model as five tables in a folder of Parquet files, with side tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import integrity, summaries

#: table: (primary key, foreign keys with their tables, columns it must have)
SCHEMA: dict[str, tuple[str, dict[str, str], tuple[str, ...]]] = {
    "compartments": ("c_id", {}, ("c_name",)),
    "species": ("s_id", {}, ("s_name",)),
    "compartmentalized_species": ("sc_id", {"s_id": "species", "c_id": "compartments"}, ()),
    "reactions": ("r_id", {}, ("r_isreversible",)),
    "reaction_species": ("rsc_id", {"r_id": "reactions", "sc_id": "compartmentalized_species"}, ("stoichiometry", "sbo_term")),
}


@dataclass(frozen=True)
class PathwayModel:
    """Immutable: every change gives a new model."""

    tables: dict[str, DataFrame]
    species_data: dict[str, DataFrame] = field(default_factory=dict)
    reactions_data: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @classmethod
    def load(cls, spark: SparkSession, path: str, species_data: tuple[str, ...] = (), reactions_data: tuple[str, ...] = ()) -> PathwayModel:
        read = lambda part: spark.read.parquet(f"{path}/{part}")
        return cls({t: read(t) for t in SCHEMA}, {n: read(f"species_data/{n}") for n in species_data}, {n: read(f"reactions_data/{n}") for n in reactions_data})

    def save(self, path: str, overwrite: bool = False) -> None:
        mode = "overwrite" if overwrite else "error"
        for name, df in self.tables.items():
            df.write.mode(mode).parquet(f"{path}/{name}")
        for kind, data in (("species_data", self.species_data), ("reactions_data", self.reactions_data)):
            for name, df in data.items():
                df.write.mode(mode).parquet(f"{path}/{kind}/{name}")

    def faults(self) -> list[str]:
        """What is wrong with the keys and references, in words; empty for a valid model."""
        out = []
        for name, (pk, fks, required) in SCHEMA.items():
            row = integrity.table_faults(self[name], pk, list(required)).first().asDict()
            out += [f"{name}: {k} {n}" for k, n in row.items() if n]
            for fk, target in fks.items():
                lost, idle = integrity.orphans(self[name], fk, self[target], SCHEMA[target][0])
                if not lost.isEmpty():
                    out.append(f"{name}: {fk} that {target} lacks")
                if not idle.isEmpty():
                    out.append(f"{target}: rows that no {name} row refers to")
        return out

    def validate(self) -> None:
        found = self.faults()
        if found:
            raise ValueError("; ".join(found))

    def with_data(self, kind: str, name: str, df: DataFrame) -> PathwayModel:
        """The model with a side table; its key has to be unique and known."""
        key, table = {"species": ("s_id", "species"), "reactions": ("r_id", "reactions")}[kind]
        if not df.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} repeats in {name}")
        if not df.join(self[table], key, "left_anti").isEmpty():
            raise ValueError(f"{name} has {key} that the model lacks")
        data = dict(getattr(self, f"{kind}_data")) | {name: df}
        return PathwayModel(self.tables, data if kind == "species" else self.species_data, data if kind == "reactions" else self.reactions_data)

    def remove_species(self, gone: DataFrame) -> PathwayModel:
        """The model without species (``s_id``) and all that goes with them."""
        t = self.tables
        lost = integrity.cascade(gone, t["compartmentalized_species"], t["reaction_species"])
        sc = t["compartmentalized_species"].join(lost["compartmentalized_species"], "sc_id", "left_anti")
        return PathwayModel(
            {
                "compartments": t["compartments"].join(sc.select("c_id"), "c_id", "left_semi"),
                "species": t["species"].join(gone, "s_id", "left_anti").join(sc.select("s_id"), "s_id", "left_semi"),
                "compartmentalized_species": sc,
                "reactions": t["reactions"].join(lost["reactions"], "r_id", "left_anti"),
                "reaction_species": t["reaction_species"].join(lost["reaction_species"], "rsc_id", "left_anti"),
            },
            {n: df.join(gone, "s_id", "left_anti") for n, df in self.species_data.items()},
            {n: df.join(lost["reactions"], "r_id", "left_anti") for n, df in self.reactions_data.items()},
        )

    def search_names(self, table: str, column: str, text: str, partial: bool = True) -> DataFrame:
        hit = F.col(column).rlike(f"(?i){text}") if partial else F.lower(column) == text.lower()
        return self[table].where(hit)

    def export_tsv(self, path: str) -> None:
        """Tables without nested columns, as TSV."""
        for name, df in self.tables.items():
            flat = [c for c, kind in df.dtypes if not kind.startswith(("array", "struct", "map"))]
            df.select(*flat).write.option("sep", "\t").option("header", True).csv(f"{path}/{name}")

    def profile(self) -> DataFrame:
        return summaries.profile(self.tables)
