"""Expressions and helpers that the operators share."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, saved_at

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space: \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\f\r"
BLANKS_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only, unlike lower(), which also maps other letters."""
    return F.translate(col, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """The words between ASCII white space, as an array; null counts as empty."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, BLANKS_RE))


def row_key(*cols: Column) -> list[Column]:
    """128 bits that stand for a row's values, never null, as columns _k1 and _k2."""
    parts = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(i), *parts).alias(f"_k{i}") for i in (1, 2)]


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of an id as text, modulo the number of folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic curve, the constant last, by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(a.shape[1]), np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@contextmanager
def table_of(df: DataFrame, what: str) -> Iterator[DataFrame]:
    """df written once and read back, for the length of a block; deleted at its end."""
    back, path = saved_at(df, what)
    try:
        yield back
    finally:
        delete(df.sparkSession, path)


_own = threading.local()


def _made() -> list[str]:
    """The tables of this thread: queries that run at once in other threads keep their own lists."""
    if not hasattr(_own, "made"):
        _own.made = []
    return _own.made


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: lineage ends there, and lost executors lose nothing."""
    back, path = saved_at(df, what)
    back._written_to = path
    _made().append(path)
    return back


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    delete(df.sparkSession, df._written_to)
    _made().remove(df._written_to)


def made() -> int:
    """How many tables written() has written in this thread and nobody deleted."""
    return len(_made())


def keep_only(since: int, *kept: DataFrame) -> None:
    """Deletes what written() wrote in this thread since there were so many tables, but for those kept; nothing else may read them any more."""
    names = [df._written_to for df in kept]
    mine = _made()
    for path in mine[since:]:
        if path not in names:
            delete(kept[0].sparkSession, path)
    mine[since:] = [path for path in mine[since:] if path in names]
