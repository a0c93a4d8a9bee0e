"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary texts and one on windows of toxic texts. A window is a
word; where the toxic dictionary makes it shorter than the ordinary one does, it says what toxic texts say. Characters are
widened to four bytes first, so that a compressed length counts the pieces that a word is put together from and a match of
three letters is worth as much as one of ten.

A toxic text is toxic in a few words only, so its windows must be found. The training texts are dealt to sides, and each
side's windows are measured by dictionaries trained on the other sides. Windows beyond a threshold for their length, where
they are some times as frequent in toxic texts, and the best of each toxic text train the next toxic dictionaries, and
windows of ordinary texts beyond the threshold go to the ordinary ones again. After some rounds the dictionaries of all
sides together are the model's.

Thresholds by length are calibrated at several ratios on labelled texts that no dictionary has seen. How many windows of a
text pass them, and how far, goes through a logistic curve fitted on the same texts.

The fit takes a bounded sample of labelled rows (Limits), each with its whole text; windows are counted, measured and
picked in tasks, and the driver sees counts by length, dictionaries and a few numbers of each text. Scoring reads every
window of every text, in tasks that share nothing.

Defined results: a null text is empty and has one empty window. Without any label, or with labels of one kind, each score
is the share of toxic labels (0 without labels). Labels that are null or neither 0 nor 1 are not used; of repeated labels
of a document the larger one counts, of texts with one doc_id the smallest is learnt from. Rows are scored one by one.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_fold, logistic, table_of
from .compression import compressor, labelled, trained

LEVEL = 12
#: Bytes of a segment and of the runs that the trainer counts: two words, two letters.
TRAINER = {"k": 64, "d": 8}
#: What is stripped from words at both ends.
EDGES = " .,;:!?*$#%&|\"'()[]{}<>"
#: Zstandard does not search the last bytes of its input.
TAIL = b"\0" * 12
#: Windows of so many characters or more share their thresholds.
LONGEST = 14
#: How many times as frequent in toxic texts windows beyond a threshold are: one threshold for each.
TIERS = (1.5, 2.5, 4.0, 8.0)
#: Toxic texts that must hold such a window, at least.
FEWEST = 5
#: How many sides the training texts are dealt to.
SIDES = 2
ALL = -1  # the dictionaries of all sides
#: Measured windows that a task remembers.
REMEMBERED = 100_000


@dataclass(frozen=True)
class Limits:
    """Bounds of the fit: labelled texts of each kind, windows of each kind for the trainer, bytes of the dictionaries; and how the search for windows goes."""

    toxic: int = 2500
    ordinary: int = 6000
    windows: int = 60_000
    size: int = 250_000
    toxic_size: int = 65_536
    rounds: int = 5
    best: int = 8
    again: int = 5
    ratio: float = 4.0


def windows(text: str | None) -> list[str]:
    return [v for w in (text or "").lower().split() if (v := w.strip(EDGES))] or [""]


@lru_cache(maxsize=None)  # an entry a character
def wide(char: str) -> bytes:
    return hashlib.md5(char.encode("utf-8", "surrogatepass")).digest()[:4]


def widened(word: str) -> bytes:
    return b"".join(map(wide, f" {word} "))


def length_of(word: str) -> int:
    return min(len(word), LONGEST)


class Pair:
    """An ordinary and a toxic dictionary: how many bytes shorter the toxic one makes a window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self._known: dict[str, int] = {}
        self._two = None

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "_known": {}, "_two": None}

    def gain(self, word: str) -> int:
        found = self._known.get(word)
        if found is None:
            if self._two is None:
                self._two = compressor(self.ordinary, LEVEL, raw=True), compressor(self.toxic, LEVEL, raw=True)
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            body = widened(word) + TAIL
            found = self._known[word] = len(self._two[0](body)) - len(self._two[1](body))
        return found


def thresholds(counts: Iterable[tuple[int, int, int, int]], ratio: float) -> dict[int, int]:
    """From (length, gain, in toxic texts, in ordinary ones): the least gain of each length from which on windows are `ratio` times as frequent in toxic texts."""
    counts = list(counts)
    toxic, ordinary = (max(1, sum(c[i] for c in counts)) for i in (2, 3))
    out: dict[int, int] = {}
    for length in {c[0] for c in counts}:
        a = b = 0
        for _, gain, x, y in sorted((c for c in counts if c[0] == length), key=lambda c: -c[1]):
            if gain < 1:
                break
            a, b = a + x, b + y
            if a >= FEWEST and a / toxic >= ratio * (b + 1) / ordinary:
                out[length] = gain
    return out


class Model:
    """Dictionaries, thresholds and the curve; travels to the tasks by pickle."""

    def __init__(self, pair: Pair, tiers: list[dict[int, int]] | None = None, weights: np.ndarray | None = None, mean=0.0, scale=1.0, prior: float = 0.0):
        self.pair, self.tiers, self.weights, self.mean, self.scale, self.prior = pair, tiers or [], weights, mean, scale, prior

    def measures(self, text: str | None) -> list[float]:
        """Of each tier: whether a window passes, how many do, how many different ones, their share, how far at most, how often one does; and how many windows there are."""
        own = [(self.pair.gain(w), length_of(w), n) for w, n in Counter(windows(text)).items()]
        total = sum(n for _, _, n in own)
        out = [math.log1p(total)]
        for tier in self.tiers:
            over = [(g - tier[k], n) for g, k, n in own if k in tier and g >= tier[k]]
            hits = sum(n for _, n in over)
            out += [hits > 0, math.log1p(hits), math.log1p(len(over)), hits / total, max((g for g, _ in over), default=-1), math.log1p(max((n for _, n in over), default=0))]
        return [float(x) for x in out]

    def score(self, texts) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        x = (np.array([self.measures(t) for t in texts], float).reshape(len(texts), -1) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


# ---------------------------------------------------------------- the fit


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5: 0 is held out."""
    return id_fold(doc_id, 5)


def side_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("side"), key), F.lit(SIDES)).cast("int")


def counted(rows: DataFrame) -> DataFrame:
    """(side, _y, _id, word, n): the windows of labelled texts, dealt to sides by document."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for side, y, key, text in f.itertuples(index=False):
                c = Counter(windows(text))
                yield pd.DataFrame({"side": side, "_y": y, "_id": key, "word": list(c), "n": list(c.values())})

    named = rows.select(side_of(F.col("_id")).alias("side"), "_y", F.col("_id").cast("string"), "_t")
    return named.mapInPandas(count, "side int, _y int, _id string, word string, n long")


def samples(words: DataFrame, times: str, totals: dict[int, int], limit: int) -> DataFrame:
    """(side, word, weight): some `limit` windows of each side, as often as they stand there; hashes decide fractions."""
    share = F.create_map(*[x for s, n in totals.items() for x in (F.lit(s), F.lit(min(1.0, limit / n) if n else 0.0))])[F.col("side")]
    chance = F.pmod(F.xxhash64(F.lit("sample"), "word"), F.lit(1_000_003)) / 1_000_003
    return words.select("side", "word", F.floor(F.col(times) * share + chance).cast("long").alias("weight")).where("weight > 0")


def trained_pairs(ordinary: DataFrame, toxic: DataFrame, size: int, toxic_size: int) -> dict[int, Pair]:
    """For each side the pair trained, in tasks, on the windows (side, word, weight) of the other sides; and that of all."""

    def train(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.groupby("word", sort=True)["weight"].sum()
        some = [widened(w) for w, n in own.items() for _ in range(n)]
        order = np.random.default_rng(1).permutation(len(some))
        made = trained([some[i] for i in order], toxic_size if key[1] else size, LEVEL, **TRAINER)
        return pd.DataFrame({"for": [key[0]], "_y": [key[1]], "d": [made]})

    both = ordinary.withColumn("_y", F.lit(0)).unionByName(toxic.withColumn("_y", F.lit(1)))
    dealt = both.withColumn("for", F.explode(F.array_remove(F.array(*[F.lit(s) for s in (ALL, *range(SIDES))]), F.col("side"))))
    made = {(r["for"], r["_y"]): bytes(r["d"]) for r in dealt.groupBy("for", "_y").applyInPandas(train, "for int, _y int, d binary").collect()}
    return {s: Pair(made.get((s, 0), b" " * 8), made.get((s, 1), b" " * 8)) for s in (ALL, *range(SIDES))}


def measured(words: DataFrame, pairs: dict[int, Pair]) -> DataFrame:
    """The words (side, word, …) with their length and their gain under the pair for their side."""
    names = words.columns

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(gain=[pairs[s].gain(w) for s, w in zip(f["side"], f["word"], strict=True)], length=[length_of(w) for w in f["word"]])

    kinds = dict(words.dtypes)
    return words.mapInPandas(measure, ", ".join(f"{c} {kinds[c]}" for c in names) + ", gain int, length int")


def found_pairs(each: DataFrame, words: DataFrame, limits: Limits) -> dict[int, Pair]:
    """The pairs, for each side and of all, of the windows that the sides find in each other."""
    sums = {r.side: r for r in words.groupBy("side").agg(F.sum("times1").alias("a"), F.sum("times0").alias("b")).collect()}
    ordinary = samples(words, "times0", {s: r.b for s, r in sums.items()}, limits.windows // SIDES)
    toxic = samples(words, "times1", {s: r.a for s, r in sums.items()}, limits.windows // SIDES)
    pairs = trained_pairs(ordinary, toxic, limits.size, limits.size)
    several = all(sum(bool(r[k]) for r in sums.values()) >= 2 for k in ("a", "b"))
    for _ in range(limits.rounds if several else 0):
        with table_of(measured(words, pairs), "toxicity-gains") as gains:
            # the windows that are left, bounded by the limits, travel with the plan
            toxic, hard = (words.sparkSession.createDataFrame([tuple(r) for r in p.collect()], "side int, word string, weight long") for p in picks(each, gains, limits))
        pairs = trained_pairs(ordinary.unionByName(hard), toxic, limits.size, limits.toxic_size)
    return pairs


def picks(each: DataFrame, gains: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """(side, word, weight) for the next toxic and ordinary dictionaries; at most limits.windows of each."""
    counts = gains.groupBy("side", "length", "gain").agg(F.sum("docs1").alias("a"), F.sum("docs0").alias("b")).collect()  # a row a length and gain
    least = [(s, k, g) for s in range(SIDES) for k, g in thresholds([(r.length, r.gain, r.a, r.b) for r in counts if r.side == s], limits.ratio).items()]
    passes = F.exists(
        F.array(*[F.struct(F.lit(s).alias("s"), F.lit(k).alias("k"), F.lit(g).alias("g")) for s, k, g in [*least, (ALL, -1, 0)]]),
        lambda t: (t["s"] == F.col("side")) & (t["k"] == F.col("length")) & (F.col("gain") >= t["g"]),
    )
    over = gains.where(passes)
    ranked = W.partitionBy("side", "_id").orderBy(F.desc("gain"), F.desc("word"))
    best = each.where("_y = 1").join(gains.where("gain > 0").select("side", "word", "gain"), ["side", "word"]).withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= limits.best)
    told = over.where("docs1 > 0").select("side", "word", F.col("docs1").alias("weight")).unionByName(best.select("side", "word", F.lit(1).cast("long").alias("weight")))
    picked = told.groupBy("side", "word").agg(F.sum("weight").alias("weight"))
    missed = over.where("docs0 > 0").select("side", "word", (F.col("docs0") * limits.again).alias("weight"))
    first = lambda df: df.orderBy(F.desc("weight"), "side", "word").limit(limits.windows)
    return first(picked), first(missed)


def fit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled documents for which learn, a condition on _id, holds (those not held out)."""
    chosen = labelled(docs, labels, fold(F.col("_id")) != 0 if learn is None else learn, {1: limits.toxic, 0: limits.ordinary}, id_col, text_col, label_col)
    with table_of(chosen, "labelled") as rows:
        counts = {(r._y, r._half): r["count"] for r in rows.groupBy("_y", "_half").count().collect()}
        total = sum(counts.values())
        prior = sum(n for (y, _), n in counts.items() if y) / total if total else 0.0
        if len({y for y, _ in counts}) < 2:
            return Model(Pair(b" " * 8, b" " * 8), prior=prior)
        first, rest = (rows.where(F.col("_half") == h) if len(counts) == 4 else rows for h in (0, 1))  # with very few labels both are all of them
        with table_of(counted(first), "toxicity-windows") as each:
            by = lambda y, c: F.sum(F.when(F.col("_y") == y, c).otherwise(0))
            grouped = each.groupBy("side", "word").agg(by(1, F.col("n")).alias("times1"), by(0, F.col("n")).alias("times0"), by(1, 1).alias("docs1"), by(0, 1).alias("docs0"))
            with table_of(grouped, "toxicity-words") as words:
                model = Model(found_pairs(each, words, limits)[ALL], prior=prior)
        own = lambda y: F.count_if(F.col("_y") == y)
        seen = counted(rest).groupBy(F.lit(ALL).alias("side"), "word").agg(own(1).alias("docs1"), own(0).alias("docs0"))
        tally = measured(seen, {ALL: model.pair}).groupBy("length", "gain").agg(F.sum("docs1").alias("a"), F.sum("docs0").alias("b")).collect()  # a row a length and gain
        model.tiers = [thresholds([(r.length, r.gain, r.a, r.b) for r in tally], ratio) for ratio in TIERS]

        def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"_id": f["_id"], "_y": f["_y"], "m": [model.measures(t) for t in f["_t"]]})

        known = rest.select(F.col("_id").cast("string"), "_y", "_t").mapInPandas(measure, "_id string, _y int, m array<double>").collect()  # a few numbers a row of the sample
    known.sort(key=lambda r: (r._id is None, r._id))
    x, y = np.array([r.m for r in known]), np.array([r._y for r in known], float)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = logistic((x - model.mean) / model.scale, y)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1."""

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    return docs.withColumn(out, toxicity(F.col(text_col)))


def without_toxic(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), least: float = 0.5) -> DataFrame:
    """The documents, with their columns, whose score is below `least`."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_text"))
    kept = score(rows, fit(docs, labels, limits), "_text", "_score").where(F.col("_score") < least)
    return kept.select(*[F.col(f"_doc.`{c}`") for c in docs.columns])
