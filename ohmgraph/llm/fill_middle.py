"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put together in another order.

A text is a run of units. regexp_count says how many there are; two numbers below that, from a hash of the document's
id, are the cuts. The row's own pattern counts units with possessive quantifiers, unit{a}+ and unit{b - a}+, so one
match captures prefix, middle and suffix, and its replacement is the finished example. Possessive counts neither go
back nor call themselves, so long texts need no deep stack. DataFrame functions only; rows are cut one by one and nothing
is shuffled.

Defined results: a null text is an empty one. Empty texts and those that hold one of the marks stay plain, so restored()
is exact for every row. A null id hashes as an empty one; equal ids with equal texts give equal rows. Other columns, of
any name, travel in _row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Recipe:
    """What is counted, the marks, and the shares of 100: rows that are cut at all, and cut rows with the suffix first."""

    unit: str = "[A-Za-z]+|[^A-Za-z]"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "1:"
    cut: int = 90
    suffix_first: int = 20

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def hashed(id_col: Column, seed: str, k: int) -> Column:
    """The k-th group of 8 digits of the sha256 of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, recipe: Recipe = Recipe(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: _row (its other columns), n (units), form (plain, psm or spm), prefix_chars and middle_chars, output."""
    p, s, m = recipe.marks
    counted = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_row"),
        F.coalesce(text_col, F.lit("")).alias("_text"),
        *[hashed(F.col(id_col), recipe.seed, k).alias(f"_h{k + 1}") for k in range(4)],
    ).withColumn("n", F.regexp_count("_text", F.lit(recipe.unit)).cast("long"))
    marked = F.col("_text").contains(p) | F.col("_text").contains(s) | F.col("_text").contains(m)
    stays = (F.col("_text") == "") | marked | (F.col("_h3") % 100 >= recipe.cut)
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("_h1", "_h2")]
    shaped = counted.select(
        "_row", "_text", "n",
        F.when(stays, "plain").when(F.col("_h4") % 100 < recipe.suffix_first, "spm").otherwise("psm").alias("form"),
        F.least(*cuts).alias("_a"),
        (F.greatest(*cuts) - F.least(*cuts)).alias("_b"),
    )
    units = lambda n: F.concat(F.lit(f"((?:{recipe.unit}){{"), n.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), units(F.col("_a")), units(F.col("_b")), F.lit(r"(.*)\z"))
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    output = F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, order))
    made = shaped.select("_row", "n", "form", F.explode(F.array(output)).alias("output"))  # a generator: later filters are not moved below the match
    before, _, middle = parts(F.col("output"), F.col("form"), recipe)
    return made.select("_row", "n", "form", F.char_length(before).cast("long").alias("prefix_chars"), F.char_length(middle).cast("long").alias("middle_chars"), "output")


def parts(output: Column, form: Column, recipe: Recipe = Recipe()) -> tuple[Column, Column, Column]:
    """Prefix, suffix and middle of an output by its marks, which occur once each; null for plain rows."""
    p, s, m = recipe.marks
    at = lambda mark: F.locate(mark, output)
    between = lambda a, b: F.substring(output, at(a) + len(a), at(b) - at(a) - len(a))
    rest = F.substring(output, at(m) + len(m), F.char_length(output))
    psm, spm = form == "psm", form == "spm"
    return F.when(psm, between(p, s)).when(spm, between(p, m)), F.when(psm, between(s, m)).when(spm, between(s, p)), F.when(psm | spm, rest)


def restored(output: Column, form: Column, recipe: Recipe = Recipe()) -> Column:
    """The text that an output was made from."""
    prefix, suffix, middle = parts(output, form, recipe)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))
