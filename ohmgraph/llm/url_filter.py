"""URL filters over a sorted digest array.

The index of a rule list is a file: sorted 64-bit xxhash keys, verdicts, and the rules' full strings in the same order.
Spark ships it to each executor as a file of the job (a lost executor's successor fetches it again), where tasks
memory-map it. A page probes with every host suffix joined to every path prefix that the list could hold; one
vectorised binary search serves a batch, and the stored strings confirm what it finds, so colliding keys do no harm.

Suffixes are limited to the label counts, prefixes to the lengths that occur in the list: what a url probes grows with
the list's shapes, not with the url. Neighbouring equal keys are walked, so rules whose keys collide are all found.

Defined results: a null url or one without :// has an empty host and path, fits no rule and is allowed, as is every page
without a rule (the method's verdict). If rules of one length fit, the smaller string wins. An empty list allows all.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

HEAD = 3  # counts of rules, of label counts and of path lengths


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def index_bytes(rules: Iterable[tuple[str, str]]) -> bytes:
    """The index of (rule, verdict) pairs; a rule is a host joined to the start of a path."""
    known = {r: v for r, v in rules}
    keyed = sorted((xxhash.xxh64_intdigest(r), r, v) for r, v in known.items())
    labels = sorted({split_rule(r)[0].count(".") + 1 for r in known})
    lengths = sorted({len(split_rule(r)[1]) for r in known})
    texts = [r.encode() for _, r, _ in keyed]
    parts = [
        np.array([len(keyed), len(labels), len(lengths)], "<u8"),
        np.array(labels, "<u8"),
        np.array(lengths, "<u8"),
        np.array([k for k, _, _ in keyed], "<u8"),
        np.array([v == "block" for _, _, v in keyed], "<u8"),
        np.cumsum([0, *map(len, texts)], dtype="<u8"),
    ]
    return b"".join(p.tobytes() for p in parts) + b"".join(texts)


class Index:
    """A memory-mapped index."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, labels, lengths = map(int, raw[: 8 * HEAD].view("<u8"))
        words = raw[: 8 * (HEAD + labels + lengths + 3 * n + 1)].view("<u8")
        cut = np.cumsum([HEAD, labels, lengths, n, n, n + 1])
        self.labels, self.lengths, self.keys, self.block, self.ends = (words[a:b] for a, b in zip(cut, cut[1:], strict=False))
        self.texts = raw[8 * cut[-1] :]

    def text(self, i: int) -> str:
        return self.texts[self.ends[i] : self.ends[i + 1]].tobytes().decode()

    def best(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """The longest rule of each page and its verdict."""
        who: list[int] = []
        probes: list[str] = []
        labels, lengths = self.labels.tolist(), self.lengths.tolist()
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            parts = host.split(".") if host else []
            for k in labels:
                if k <= len(parts):
                    suffix = ".".join(parts[len(parts) - k :])
                    for n in lengths:
                        if n <= len(path):
                            who.append(i)
                            probes.append(suffix + path[:n])
        keys = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, keys)
        rules: list[str | None] = [None] * len(hosts)
        verdicts: list[str | None] = [None] * len(hosts)
        found = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)) if len(self.keys) else []
        for j in found:
            k, i, probe = int(at[j]), who[j], probes[j]
            while k < len(self.keys) and self.keys[k] == keys[j]:
                if self.text(k) == probe and (rules[i] is None or (-len(probe), probe) < (-len(rules[i]), rules[i])):
                    rules[i], verdicts[i] = probe, "block" if self.block[k] else "allow"
                k += 1
        return rules, verdicts


_open: dict[str, Index] = {}


def _index(name: str) -> Index:
    if name not in _open:
        _open[name] = Index(SparkFiles.get(name))
    return _open[name]


def ship_index(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Sends the index to all executors; its name there tells its content."""
    data = index_bytes(rules)
    name = f"urls-{hashlib.sha256(data).hexdigest()[:24]}.idx"
    path = os.path.join(tempfile.mkdtemp(prefix="urls-"), name)
    with open(path, "wb") as f:
        f.write(data)
    if not any(x.endswith(f"/{name}") for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return name


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict."""
    name = ship_index(pages.sparkSession, rules)

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        rule, verdict = _index(name).best(host.tolist(), path.tolist())
        return pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": pd.Series(verdict, dtype=object)})

    host, path = host_and_path(F.col(url_col))
    return (
        pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
        .withColumn("_j", judge("host", "path"))
        .select("page_id", "host", "path", F.col("_j.rule").alias("rule"), F.coalesce("_j.verdict", F.lit("allow")).alias("verdict"))
    )
