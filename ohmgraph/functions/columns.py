"""Column expressions: pure functions of columns, no joins and no shuffles."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AMINO_ACIDS, UNKNOWN


def lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def normalize_aa(col: Column) -> Column:
    """One letter becomes three, upper-cased; unknown letters and longer names are only upper-cased."""
    up = F.upper(col)
    return F.when(F.length(col) == 1, F.coalesce(F.try_element_at(lookup({a: b for a, b, *_ in AMINO_ACIDS}), up), up)).otherwise(up)


def aa3_to_aa1(col: Column) -> Column:
    """Three letters become one; unknown names become X."""
    return F.coalesce(F.try_element_at(lookup({b: a for a, b, *_ in AMINO_ACIDS}), F.upper(col)), F.lit("X"))


def scale(col: Column, which: int) -> Column:
    """Hydrophobicity (0), charge (1) or volume (2) of an amino acid under either name."""
    values = {b: x[which] for _, b, *x in AMINO_ACIDS}
    return F.coalesce(F.try_element_at(lookup(values), normalize_aa(col)), F.lit(UNKNOWN[which]))


def perturbation_factor(from_: Column, to: Column, alpha: float = 0.1, beta: float = 0.3, gamma: float = 0.002) -> Column:
    """By what a substitution multiplies the conductances at its site: signed in hydrophobicity, by amount in charge and volume."""
    change = lambda i: scale(to, i) - scale(from_, i)
    return 1 + alpha * change(0) + beta * F.abs(change(1)) + gamma * F.abs(change(2))


def conductance(distance: Column, method: str = "exponential", tau: float = 5.0) -> Column:
    """Conductance of a contact; an inverse square at distance 0 is null."""
    if method == "exponential":
        return F.exp(-distance / tau)
    if method == "inverse_square":
        return F.when(distance > 0, 1 / (distance * distance))
    if method == "binary":
        return F.when(distance.isNotNull(), F.lit(1.0))
    raise ValueError(f"unknown conductance: {method}")


def parse_mutation_code(col: Column) -> Column:
    """POSITION:FROM:TO as a struct; null unless it has three parts and a whole number."""
    parts = F.split(col, ":")
    position = F.trim(F.get(parts, F.lit(0))).try_cast("int")
    sound = (F.size(parts) == 3) & position.isNotNull()
    at = lambda i: F.upper(F.trim(F.get(parts, F.lit(i))))
    return F.when(sound, F.struct(position.alias("position"), at(1).alias("wild_type"), at(2).alias("mutation")))


def parse_site_list(col: Column) -> Column:
    """Comma-separated residue numbers as integers, in order; what is no number is left out."""
    return F.filter(F.transform(F.split(col, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def finite(col: Column) -> Column:
    """The value, or 0 where it is null, NaN or infinite."""
    x = col.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def clean_features(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in cols})


# Lower bounds of a correlation's tier.
TIERS = [(0.70, "EXCELLENT"), (0.60, "GOOD"), (0.50, "MODERATE"), (0.35, "FAIR")]
TARGET = 0.65


def performance_tier(r: Column) -> Column:
    out = F.lit("LOW")
    for least, name in reversed(TIERS):
        out = F.when(r >= least, name).otherwise(out)
    return out


def meets_target(r: Column, target: float = TARGET) -> Column:
    return F.coalesce(r >= target, F.lit(False))


def feature_source(name: Column) -> Column:
    """Which set a feature comes from, told by its name."""
    return F.when(name.startswith("cc_"), "amino_acid").when(name.startswith("scale_"), "cross_scale").when(name.endswith("_6A"), "6A").otherwise("8A")


def ratio(a: Column, b: Column, eps: float = 0.0) -> Column:
    """a / b, 0 where b is (nearly) 0."""
    return F.when(F.abs(b) > eps, a / b).otherwise(0.0)


def correlation(a: str, b: str, eps: float = 0.0) -> Column:
    """Pearson's correlation as an aggregate; 0 where a side does not vary."""
    spread = F.stddev_pop(a), F.stddev_pop(b)
    r = F.try_divide(F.covar_pop(a, b), spread[0] * spread[1])
    return F.when((spread[0] > eps) & (spread[1] > eps), F.coalesce(r, F.lit(0.0))).otherwise(0.0)
