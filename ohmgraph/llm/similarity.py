"""MinHash near-dedup by fast similarity sketching.

A sketch has T coordinates. In round i < T each shingle is hashed to one coordinate, and only coordinates that earlier
rounds left empty take the smallest value; rounds T to 2T-1 put every shingle into one coordinate each, so all get a
value. Two sketches agree at a coordinate with the sets' Jaccard similarity as probability, with concentration as for
independent hashes, at a cost of few rounds. Bands of ROWS coordinates give bucket keys. At a similarity of 0.8 the
default bands miss a pair with a probability near one in a million; links are confirmed on the full sets, 64-bit hashes
of all shingles.

Documents with equal sets are one class, whose smallest doc_id stands for it, so copies cost one row each. Classes that
buckets connect form a family: a bucket adds one edge a member, never pairs. All links lie within families. A family is
cut into blocks of bounded size; each task links what a block holds by intersecting sets through an inverted list, and
walks only what is not yet linked. In families of several blocks, the members with the most links first visit all
blocks; then whoever is still outside the family's largest component visits all of them, so every pair of a family has
been compared or was already joined. Visits carry sets in chunks and give links between components, not pairs. Only a
family of very many mutually unlike members costs much, since nothing cheaper tells that they are not linked.
Components come from contracting links with Spark joins. Tables between steps are written to the shared folder.

Defined results: null or empty texts, and texts without words, have an empty set, link with nothing and stand alone.
A text of fewer than N words has one shingle, all its words. Rows with equal doc_id and different texts are one document
that links with all that one of its texts links with; a null doc_id is linked with nothing and is its own component
(null), kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, keep_only, made, written

WORDS = 4
SIMILARITY = (80, 100)
T = 270
ROWS = 6
#: Bounds of a block: members, and hashes of all their sets together.
MEMBERS, HASHES = 1024, 1 << 21
#: Hashes of small families that a task takes together.
BUNDLE = 1 << 17
#: Members of a family of several blocks that visit all of them first.
PIVOTS = 16

_M = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of 64 (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words, A-Z lower-cased."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII white space and letters only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for j in range(k):
        out = mixed(out * _M + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """A row of t coordinates for each set; sets must not be empty."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    items = np.concatenate(sets) if n else np.empty(0, np.uint64)
    out, full = np.full((n, t), np.iinfo(np.uint64).max, np.uint64), np.zeros((n, t), bool)
    for i in range(2 * t):
        with np.errstate(over="ignore"):
            h = mixed(items ^ mixed(np.uint64(i + 1) * _M))
        at = (h >> np.uint64(40)).astype(np.int64) % t if i < t else np.full(len(h), i - t)
        flat = owner * t + at
        free = ~full.ravel()[flat]
        np.minimum.at(out.ravel(), flat[free], h[free])
        full.ravel()[flat[free]] = True
        done = full.all(1)
        if done.all():
            break
        keep = ~done[owner]
        owner, items = owner[keep], items[keep]
    return out


def band_keys(sk: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band of coordinates, different between bands."""
    n, t = sk.shape
    bands = sk.reshape(n, t // rows, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mixed(np.arange(1, t // rows + 1, dtype=np.uint64) * _M), bands.shape[:2]).copy()
        for j in range(rows):
            key = mixed(key * _M + bands[:, :, j])
    return key.view(np.int64)


def parts(frame: pd.DataFrame, text_col: str, most: int = 256, chars: int = 1 << 19) -> Iterator[pd.DataFrame]:
    """A frame's rows, some at a time: at most so many, and no more characters unless one text has them."""
    size = frame[text_col].str.len().fillna(0).to_numpy()
    at = held = 0
    for i, n in enumerate(size.tolist()):
        if i > at and (i - at >= most or held + n > chars):
            yield frame.iloc[at:i]
            at, held = i, 0
        held += n
    if at < len(frame):
        yield frame.iloc[at:]


def described(docs: DataFrame, n: int, t: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (shingles), s1 and s2 (128 bits of the set, 0 if empty), bands."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in parts(frame, "text"):
                sets = [shingles(x, n) for x in part["text"]]
                size = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(size)
                keys = band_keys(sketches([sets[i] for i in some], t), rows) if len(some) else np.empty((0, t // rows), np.int64)
                bands: list = [[] for _ in sets]
                sums = np.zeros((len(sets), 2), np.int64)
                for i, b in zip(some, keys, strict=True):
                    bands[i] = b
                    raw = sets[i].tobytes()
                    sums[i] = np.array([xxhash.xxh3_64_intdigest(raw), xxhash.xxh64_intdigest(raw, 1)], np.uint64).view(np.int64)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "n": size, "s1": sums[:, 0], "s2": sums[:, 1], "bands": bands})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, "doc_id long, n long, s1 long, s2 long, bands array<long>")


def full_sets(docs: DataFrame, n: int, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """c, set: the full sets of the wanted documents, computed only for those; a doc_id of several texts has several."""

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in parts(frame, "_t"):
                yield pd.DataFrame({"c": part["c"], "set": [shingles(x, n).view(np.int64) for x in part["_t"]]})

    slim = docs.select(F.col(id_col).cast("long").alias("c"), F.col(text_col).alias("_t")).join(wanted, "c", "left_semi")
    once = slim.withColumns({"_h": F.xxhash64("_t"), "_g": F.xxhash64(F.lit(1), "_t")}).dropDuplicates(["c", "_h", "_g"])
    return once.select("c", "_t").mapInPandas(hashed, "c long, set array<long>").where(F.size("set") > 0)


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component for every node of links (a, b) that is not that node itself.

    Each round hangs the larger neighbours of a node under its smallest one (large star), then all it hangs under, and
    itself, under the smallest of those (small star), until all hang under a root. Nodes of many links are aggregated
    and joined, never gathered.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        twice = edges.groupBy("u").count().where("count > 1").select("u")
        if edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").unionByName(twice).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        met = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        new = written(small.distinct(), "edges")
        discard(edges)
        discard(large)
        edges = new


class Lists:
    """Inverted lists of some sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.values, self.start = np.unique(flat[order], return_index=True)
        self.start = np.append(self.start, len(flat))
        self.owner = owner[order]

    def alike(self, x: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
        """Which of the sets are similar to x."""
        num, den = similarity
        at = np.searchsorted(self.values, x)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == x)]
        lo, n = self.start[at], self.start[at + 1] - self.start[at]
        spot = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(at) else np.empty(0, np.int64)
        common = np.bincount(self.owner[spot], minlength=len(self.size))
        return den * common >= num * (len(x) + self.size - common)


def linked_within(sets: list[np.ndarray], similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each set the first of its component, and how many it was found to link with. What is linked leaves the lists."""
    first, links = np.full(len(sets), -1), np.zeros(len(sets), np.int64)
    left = np.arange(len(sets))
    lists = Lists(sets)
    for s in range(len(sets)):
        queue = [s] if first[s] < 0 else []
        first[s] = s if first[s] < 0 else first[s]
        while queue:
            x = queue.pop()
            here = left[lists.alike(sets[x], similarity)]
            links[x] = max(links[x], len(here) - 1)
            new = here[first[here] < 0]
            first[new] = s
            queue += new.tolist()
            still = np.flatnonzero(first < 0)
            if not len(still):
                return first, links
            if len(still) <= len(left) // 2:
                left, lists = still, Lists([sets[i] for i in still])
    return first, links


def within_blocks(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(family, block, c, root, links) of rows (bundle, family, block, c, set)."""

    def run(held: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (family, block), part in held.groupby(["family", "block"], sort=False):
            part = part.sort_values("c")
            first, links = linked_within([np.asarray(x, np.int64) for x in part["set"]], similarity)
            c = part["c"].to_numpy()
            out.append(pd.DataFrame({"family": family, "block": block, "c": c, "root": c[first], "links": links}))
        return pd.concat(out)

    slim = rows.select("bundle", "family", "block", "c", "set")
    return slim.groupBy("bundle").applyInPandas(run, "family long, block long, c long, root long, links long")


def visits(guests: DataFrame, hosts: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) between roots of guests and of the members of all blocks of their family; both: family, block, c, root, set.

    Guests come to a block in chunks, so a group holds a block and a chunk of guests.
    """
    blocks = hosts.select("family", "block").distinct()
    chunks = guests.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum(F.size("set")) / HASHES)).alias("_chunks"))
    to = blocks.join(chunks, "family")
    own = lambda df: df.select(*[F.col(x).alias(x) for x in ("family", "block", "_chunk", "c", "root", "set")]).groupBy("family", "block", "_chunk")
    coming = guests.drop("block").join(to, "family").withColumn("_chunk", F.pmod(F.xxhash64("c"), F.col("_chunks")).cast("long"))
    there = hosts.join(chunks, "family").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks").cast("long") - 1)))

    def run(some: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[int, int]] = set()
        if len(some) and len(held):
            lists, roots = Lists([np.asarray(x, np.int64) for x in held["set"]]), held["root"].to_numpy()
            for root, x in zip(some["root"], some["set"], strict=True):
                for other in np.unique(roots[lists.alike(np.asarray(x, np.int64), similarity)]).tolist():
                    if other != root:
                        found.add((root, other))
        return pd.DataFrame(sorted(found), columns=["a", "b"])

    return own(coming).cogroup(own(there)).applyInPandas(run, "a long, b long").distinct()


def moved(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with their roots after more links between roots."""
    new = components(links).select(F.col("node").alias("root"), F.col("root").alias("_new"))
    return rows.join(new, "root", "left").withColumn("root", F.coalesce("_new", "root")).drop("_new")


def bucket_edges(members: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket hangs under the smallest; members: key, c.

    The join has a row a bucket on its small side, so where one bucket holds a third of all classes Spark may split the
    other side of it between tasks (spark.sql.adaptive.skewJoin).
    """
    heads = members.groupBy("key").agg(F.min("c").alias("head"), F.count("*").alias("k")).where("k > 1").drop("k")
    return members.join(heads, "key").where("c <> head").select(F.col("c").alias("a"), F.col("head").alias("b")).distinct()


def one_root(rows: DataFrame) -> DataFrame:
    """(c, root) with one root for each c: what several roots of a c hold is joined."""
    several = rows.groupBy("c").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    if several.isEmpty():
        return rows.distinct()
    links = rows.join(several.select("c", "a"), "c").select("a", F.col("root").alias("b"))
    return moved(rows, written(links, "links")).distinct()


def joined_classes(docs: DataFrame, members: DataFrame, n: int, similarity: tuple[int, int], id_col: str, text_col: str) -> DataFrame | None:
    """c, root for all classes that share a bucket with another; members: key, c."""
    edges = written(bucket_edges(members), "edges")
    if edges.isEmpty():
        return None
    hung = components(edges).select(F.col("node").alias("c"), F.col("root").alias("family"))
    named = written(hung.unionByName(hung.select(F.col("family").alias("c"), "family").distinct()), "families")
    sets = written(full_sets(docs, n, id_col, text_col, named.select("c")).join(named, "c"), "sets")
    size = F.size("set")
    mass = sets.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum(size) / HASHES)).cast("long").alias("blocks"))
    mass = written(mass, "masses")
    bundles = max(1, math.ceil((sets.agg(F.sum(size)).first()[0] or 0) / BUNDLE))
    block = F.pmod(F.xxhash64("c", F.size("set"), F.get("set", F.lit(0))), F.col("blocks"))
    bundle = F.when(F.col("blocks") > 1, F.xxhash64("family", "block")).otherwise(F.pmod(F.xxhash64("family"), F.lit(bundles)))
    rows = sets.join(mass, "family").withColumn("block", block).withColumn("bundle", bundle).drop("blocks")
    roots = written(within_blocks(rows, similarity), "roots")
    large = mass.where("blocks > 1")
    if large.isEmpty():
        return one_root(roots.select("c", "root"))
    in_block = roots.groupBy("family", "block", "c").agg(F.min("root").alias("root"), F.max("links").alias("links"))
    held = written(in_block.join(large, "family").join(rows.drop("bundle"), ["family", "block", "c"]), "large")
    # the best-linked of each block first, a bounded number of a family
    order = W.partitionBy("family", "block").orderBy(F.desc("links"), "c")
    few = held.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.ceil(PIVOTS / F.col("blocks"))).drop("_k", "links", "blocks")
    now = written(moved(held.drop("links", "blocks"), visits(few, held, similarity)), "large")
    most = now.groupBy("family", "root").count().groupBy("family").agg(F.max_by("root", F.struct("count", "root")).alias("_most"))
    outside = now.join(most, "family").where("root <> _most").drop("_most")
    more = visits(outside, now, similarity)
    several = roots.join(large.select("family"), "family", "left_semi").select("c", "root")
    linked = now.select("c", "root").unionByName(several).unionByName(more.select(F.col("a").alias("c"), F.col("b").alias("root")))
    inside = one_root(roots.join(large, "family", "left_anti").select("c", "root"))
    ends = components(linked.select(F.col("c").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("c"), "root")
    return inside.unionByName(ends)


def components_of(docs: DataFrame, n: int = WORDS, similarity: tuple[int, int] = SIMILARITY, t: int = T, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    since = made()
    about = written(described(docs, n, t, rows, id_col, text_col), "sketches")
    one = about.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("c"), F.first("bands").alias("bands"))
    classes = written(one, "classes")
    members = classes.select("c", F.explode_outer("bands").alias("key"))
    roots = joined_classes(docs, members, n, similarity, id_col, text_col)
    named = classes.select("s1", "s2", "n", "c")
    if roots is not None:
        named = named.join(roots, "c", "left").select("s1", "s2", "n", F.coalesce("root", "c").alias("c"))
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    slim = about.select("doc_id", "n", F.when(alone, F.xxhash64("doc_id")).otherwise(F.col("s1")).alias("s1"), "s2")
    found = slim.join(named, ["s1", "s2", "n"], "left").select("doc_id", "n", F.when(~alone, F.col("c")).alias("c"))
    found = written(found, "components")
    # texts of one document join their components
    linked = found.where("c IS NOT NULL").groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b")
    if not linked.isEmpty():
        links = found.where("c IS NOT NULL").join(linked.select("doc_id", "a"), "doc_id").select("a", F.col("c").alias("b")).distinct()
        found = written(moved(found.withColumnRenamed("c", "root"), written(links, "links")).withColumnRenamed("root", "c"), "components")
    keep_only(since, found)
    component = F.coalesce("c", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents, with their columns, one of each component; of rows with one doc_id and text one stays, of rows without doc_id all."""
    text_col = how.get("text_col", "text")
    kept = components_of(docs, id_col=id_col, **how).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct()
    named = docs.join(kept, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return named.unionByName(docs.where(F.col(id_col).isNull()))
