"""Quality by compression: zstandard dictionaries trained on good and on bad labelled texts.

A text is compressed whole with both dictionaries. The difference of the two sizes, normalised by the larger one and by
the text's own size, says which kind it is nearer to; with the normalised size itself (a text that repeats itself gets
short under both) it goes through a logistic curve fitted on labelled texts that the dictionaries have not seen.

The fit takes a bounded sample of labelled rows (Limits.good, Limits.bad), each with its whole text cut into windows, of
which Limits.windows of each kind go to the trainer. Only those windows and three numbers of each other row come to the
driver. Scoring reads every text whole, in tasks that share nothing.

Defined results: a null text is empty, and an empty text has a score like any other. Without any label, or with labels of
one kind, every score is the share of good labels (0 without labels). Labels that are null or neither 0 nor 1 are not
used; of repeated labels of a document the larger one counts, of texts with one doc_id the smallest is learnt from.
Texts of any length are scored whole, rows one by one; columns of any name are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import logistic, table_of
from .compression import compressor, labelled, trained

#: Bytes that every text counts besides its own, so that short texts do not decide by a byte.
FLOOR = 16


@dataclass(frozen=True)
class Limits:
    """Bounds of the fit: labelled rows of each kind, windows of each kind for the trainer, characters of a window, bytes of a dictionary."""

    good: int = 6000
    bad: int = 4000
    windows: int = 8000
    window: int = 1024
    size: int = 32_768
    level: int = 3


class Model:
    """Both dictionaries and the curve; travels to the tasks by pickle."""

    def __init__(self, good: bytes, bad: bytes, level: int, weights: np.ndarray | None = None, mean=0.0, scale=1.0, prior: float = 0.0):
        self.good, self.bad, self.level, self.weights, self.mean, self.scale, self.prior = good, bad, level, weights, mean, scale, prior
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def measures(self, text: str | None) -> tuple[float, float, float]:
        """The difference of the compressed sizes by the larger of them and by the text's size, and the size under the good dictionary by the text's."""
        if self._pair is None:
            self._pair = compressor(self.good, self.level), compressor(self.bad, self.level)
        body = (text or "").encode()
        good, bad = (len(c(body)) for c in self._pair)
        return (good - bad) / max(good, bad), (good - bad) / (len(body) + FLOOR), good / (len(body) + FLOOR)

    def score(self, texts) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        x = (np.array([self.measures(t) for t in texts], float).reshape(len(texts), -1) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Model:
    """A model from the labelled documents for which learn, a condition on _id, holds: dictionaries from one half of them, the curve from the other."""
    with table_of(labelled(docs, labels, learn, {1: limits.good, 0: limits.bad}, id_col, text_col, label_col), "labelled") as rows:
        counts = {(r._y, r._half): r["count"] for r in rows.groupBy("_y", "_half").count().collect()}
        total = sum(counts.values())
        prior = sum(n for (y, _), n in counts.items() if y) / total if total else 0.0
        if len({y for y, _ in counts}) < 2:
            return Model(b" " * 8, b" " * 8, limits.level, prior=prior)
        first = (F.col("_half") == 0) if len(counts) == 4 else F.lit(True)  # with very few labels both halves are all of them
        rest = (F.col("_half") == 1) if len(counts) == 4 else F.lit(True)
        cut = rows.where(first).select("_y", F.explode(F.regexp_extract_all("_t", F.lit(rf"(?s).{{1,{limits.window}}}"), F.lit(0))).alias("_w"))
        windows = lambda y: [r._w.encode() for r in cut.where(F.col("_y") == y).orderBy(F.xxhash64("_w"), "_w").limit(limits.windows).collect()]
        model = Model(trained(windows(1), limits.size, limits.level), trained(windows(0), limits.size, limits.level), limits.level, prior=prior)

        def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"_id": f["_id"], "_y": f["_y"], "m": [list(model.measures(t)) for t in f["_t"]]})

        known = rows.where(rest).select("_id", "_y", "_t")
        seen = known.mapInPandas(measured, f"_id {dict(rows.dtypes)['_id']}, _y int, m array<double>").collect()  # three numbers a row of the sample
    seen.sort(key=lambda r: str(r._id))
    x, y = np.array([r.m for r in seen]), np.array([r._y for r in seen], float)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = logistic((x - model.mean) / model.scale, y)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """The documents with a score from 0 (bad) to 1 (good)."""

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    return docs.withColumn(out, quality(F.col(text_col)))
