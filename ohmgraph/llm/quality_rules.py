"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document; the ledger keeps its measurements and a mask with a bit for each rule that
failed. It is written once: a policy is a versioned mask of the rules that count, applied to the ledger without reading a
text again, and ablations are bitwise counts over the ledger. DataFrame functions only; nothing is shuffled but the
counts of masks.

Defined results: a null text has no words, lines or symbols and fails the rules that ask for words. Rows are judged one
by one, so null or repeated doc_ids change nothing. Ratios are compared without dividing, so an empty text is no error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, UPPER, blank_words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 3
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def rules() -> dict[str, Column]:
    """name -> whether it fails, over the measurements; a rule's bit is its place here, so only append."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "few_words": words < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * words,
        "symbols": 100 * F.col("n_symbols") > 30 * words,
        "duplicate_lines": 100 * F.col("n_dup_lines") > 60 * F.col("n_lines"),
        "long_words": chars > 25 * words,
        "short_words": chars < 2 * words,
        "shouting": 100 * F.col("n_upper") > 60 * chars,
    }


BASE = ("few_words", "repeated_windows")
#: version -> the rules that count
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "long_words", "short_words", "shouting"),
    "v2": (*BASE, "symbols", "duplicate_lines", "long_words", "short_words", "shouting"),
}


def mask_of(names) -> int:
    bits = {name: 1 << i for i, name in enumerate(rules())}
    return sum(bits[n] for n in names)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, failed (the mask of failing rules), written."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    deleted = lambda chars: F.char_length(F.translate(text, chars, ""))
    measured = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
        .select("doc_id", "_text", blank_words(F.col("_text")).alias("_words"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
        .select(
            "doc_id",
            "_words",
            F.size("_words").cast("long").alias("n_words"),
            deleted(BLANKS).cast("long").alias("word_chars"),
            (F.char_length(text) - deleted(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.char_length(text) - deleted(UPPER)).cast("long").alias("n_upper"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        )
    )
    gram = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    starts = F.sequence(F.lit(0), F.size("_words") - WINDOW)
    grams = measured.withColumn("_grams", F.when(F.size("_words") >= WINDOW, F.transform(starts, gram))).drop("_words")
    # a window that occurs again stands beside its equal once sorted
    paired = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    ordered = grams.withColumn("_sorted", F.when(F.size("_grams") > F.size(F.array_distinct("_grams")), paired)).drop("_grams")
    near = lambda i: F.get(F.col("_sorted"), i)["h"]
    again = F.filter("_sorted", lambda x, i: F.coalesce(near(i - 1) == x["h"], F.lit(False)) | F.coalesce(near(i + 1) == x["h"], F.lit(False)))
    at = ordered.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["p"]))).drop("_sorted")
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n")),
        lambda a: a["n"],
    )
    counted = at.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_at")
    failed = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(rules().values())), F.lit(0))
    return written(counted.withColumn("failed", failed.cast("long")), "ledger")


def judged(led: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    hit = lambda names: F.col("failed").bitwiseAND(F.lit(mask_of(names)).cast("long")) != 0
    return led.withColumn("base_failed", hit(BASE)).withColumn("kept", ~hit({*BASE, *POLICIES[policy]}))


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """rule, n_failed, n_only (documents that this rule alone rejects, so those won back without it), over counts of masks."""
    total, names = mask_of(POLICIES[policy]), list(rules())
    masks = led.groupBy(F.col("failed").bitwiseAND(F.lit(total).cast("long")).alias("mask")).count()
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).cast("long").alias("bit")) for n in POLICIES[policy]])
    flat = masks.select("mask", "count", F.inline(each))
    return flat.groupBy("rule").agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("mask") == F.col("bit"), F.col("count")).otherwise(0)).alias("n_only"),
    )
