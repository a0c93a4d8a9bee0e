"""Readers of mutation tables and their normal form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ALIASES, MUTATION_COLUMNS

DEFAULTS = {"chain": "A", "wild_type": "X", "mutation": "A", "pH": 7.0, "temperature": 25.0, "protein_name": ""}


def named(df: DataFrame, aliases: dict[str, list[str]], spaces: str = " ") -> dict[str, str]:
    """standard name -> the column that gives it; headers are compared trimmed and in lower case."""
    have = {c.strip().lower().replace(" ", spaces): c for c in reversed(df.columns)}
    found = {std: next((have[a.replace(" ", spaces)] for a in names if a.replace(" ", spaces) in have), None) for std, names in aliases.items()}
    return {k: v for k, v in found.items() if v is not None}


def _standard(df: DataFrame, have: dict[str, str], sound: Column) -> DataFrame:
    """The nine columns; defaults stand in for columns that are absent, never for values."""
    missing = [c for c in ("pdb_id", "position", "ddG") if c not in have]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} in {df.columns}")
    raw = lambda c: F.col(f"`{have[c]}`").cast("string") if c in have else F.lit(DEFAULTS[c]).cast("string")
    letter = lambda c: F.nullif(F.substring(F.upper(F.trim(raw(c))), 1, 1), F.lit(""))
    number = lambda c: F.trim(raw(c)).try_cast("double")
    code = r"^([A-Z])([A-Z])?(\d+)([A-Z])$"
    full = F.upper(F.trim(raw("mutation")))
    written = F.lit("wild_type" not in have) & full.rlike(code)  # a whole code such as V42G tells both
    out = df.select(
        F.substring(F.upper(F.trim(raw("pdb_id"))), 1, 4).alias("pdb_id"),
        F.trim(raw("chain")).alias("chain"),
        F.floor(number("position")).cast("int").alias("position") if "position" in have else F.lit(None),
        F.when(written, F.regexp_extract(full, code, 1)).otherwise(letter("wild_type")).alias("wild_type"),
        F.when(written, F.regexp_extract(full, code, 4)).otherwise(letter("mutation")).alias("mutation"),
        number("ddG").alias("ddG"),
        number("pH").alias("pH"),
        number("temperature").alias("temperature"),
        raw("protein_name").alias("protein_name"),
    )
    return out.dropna(subset=["pdb_id", "position", "wild_type", "mutation", "ddG"]).where(sound).select(*MUTATION_COLUMNS)


def normalize_mutations(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Any table of mutations in standard form; rows without an id of four characters, a position, amino acids or a value go."""
    return _standard(df, named(df, aliases), F.length("pdb_id") == 4)


def normalize_fireprot(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """As normalize_mutations, for headers with spaces and tables that hold a residue next to a whole mutation string."""
    extra = {**aliases, "mutation": ["mut_residue", "mutant_residue", *aliases["mutation"]], "wild_type": ["wild_residue", "wild_type_residue", "wt_residue", *aliases["wild_type"]]}
    return _standard(df, named(df, extra, "_"), F.col("pdb_id").rlike("^[A-Z0-9]{4}$"))


def normalize_api_records(df: DataFrame) -> DataFrame:
    """Records of a REST service; of two fields that may hold a value the first that is set counts. A value of 0 is a value."""
    fields = {f.name: f.dataType for f in df.schema}

    def first(*names: str) -> Column:
        cols = []
        for n in names:
            top, _, sub = n.partition(".")
            if top in fields and (not sub or sub in getattr(fields[top], "names", [])):
                cols.append(F.nullif(F.trim(F.col(n).cast("string")), F.lit("")))
        return F.coalesce(*cols) if cols else F.lit(None).cast("string")

    letter = lambda c: F.substring(F.upper(c), 1, 1)
    out = df.select(
        F.substring(F.upper(first("pdb_id", "protein.pdb_id")), 1, 4).alias("pdb_id"),
        F.coalesce(first("chain"), F.lit("A")).alias("chain"),
        F.floor(first("position", "residue_number").try_cast("double")).cast("int").alias("position"),
        letter(first("wild_type", "wild_type_residue")).alias("wild_type"),
        letter(first("mutation", "mutant_residue")).alias("mutation"),
        first("ddG", "delta_delta_G").try_cast("double").alias("ddG"),
        F.coalesce(first("pH").try_cast("double"), F.lit(7.0)).alias("pH"),
        F.coalesce(first("temperature").try_cast("double"), F.lit(25.0)).alias("temperature"),
        F.coalesce(first("protein_name", "protein.name"), F.lit("")).alias("protein_name"),
    )
    return out.dropna(subset=["pdb_id", "position", "wild_type", "mutation", "ddG"]).where(F.length("pdb_id") == 4)


def read_mutations_csv(spark: SparkSession, path: str) -> DataFrame:
    return normalize_mutations(spark.read.option("header", True).csv(path))


def read_mutations_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalize_fireprot(spark.read.parquet(path))


def read_mutations_json(spark: SparkSession, path: str) -> DataFrame:
    """An object with results, or an array of records."""
    raw = spark.read.option("multiLine", True).json(path)
    return normalize_api_records(raw.select(F.explode("results").alias("r")).select("r.*") if "results" in raw.columns else raw)


def union_datasets(sets: dict[str, DataFrame | None]) -> DataFrame:
    """All datasets in one table, tagged by name; those that could not be read (None) are left out."""
    have = [df.withColumn("dataset", F.lit(name)) for name, df in sets.items() if df is not None]
    if not have:
        raise ValueError("no dataset could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), have)
