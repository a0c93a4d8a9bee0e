"""Zstandard dictionaries trained on texts of a kind, the labelled texts to train on, and lengths under dictionaries."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples that the trainer asks for at least.
FEWEST = 10


def trained(samples: Iterable[bytes], size: int, level: int, **how: int) -> bytes:
    """A dictionary of up to `size` bytes; how: the trainer's k and d, which it else tries out. Too few or too short samples cannot be trained on: then their own last bytes are the dictionary."""
    some = [s for s in samples if s]
    try:
        if len(some) < FEWEST:
            raise zstandard.ZstdError("too few samples")
        return zstandard.train_dictionary(size, some, level=level, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(some)[-size:] or b" " * 8


def compressor(dictionary: bytes, level: int, raw: bool = False) -> Callable[[bytes], bytes]:
    """Compresses with a dictionary. raw: by its content alone, without the tables of codes that training adds."""
    kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_AUTO
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    return zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, limits: dict[int, int], id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(_id, _y, _t, _half): a bounded sample of labelled documents of each kind, where learn (a condition on _id) holds; _half deals them in two."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y")).where(learn)
    some = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in limits.items()]
    chosen = some[0].unionByName(some[1])  # as many rows as the limits say, so it may be broadcast
    return (
        docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_t"))
        .join(F.broadcast(chosen), "_id")
        .groupBy("_id", "_y")
        .agg(F.min("_t").alias("_t"))
        .withColumn("_half", F.pmod(F.xxhash64(F.lit("half"), "_id"), F.lit(2)).cast("int"))
    )
