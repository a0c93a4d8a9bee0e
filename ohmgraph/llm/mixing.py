"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of equal token counts. Slot i lies at the fractional part of i times the golden ratio, a
point that cumulative target shares map to a source, so that every stretch of the mix holds the sources in proportion.
Slots are ranked within their source, and rank k takes block k of the source's shuffled stream of documents, cut into
blocks of equal token counts, from its start again once it has been used up. The schedule runs on a little longer than
the mix, and a source's slots stop at its target, so what it gives meets the target exactly. Nothing is ranked in one
task: order keys are cut into ranges, ranked within each and offset by the counts before. Texts are read once, for their
sizes. The driver holds a row a source. DataFrame functions only.

Defined results: null text has size 0 and is never taken; a null source is a source of its own, last. Documents are
ordered by md5 of doc_id (null as empty), size and the carried columns, so reruns agree; repeated rows are separate
documents, each with its own row. If all sizes are 0, nothing is taken. What is never taken has no slot.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blank_words, row_key, written

GOLDEN = 0.6180339887498949
BLOCK = 256
SPARE = 32
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> dict[str | None, float]:
    """Tokens that each source is to give: the sum's share dealt by weight, none above limit times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, heavy, full = share * sum(sizes.values()), sum(weight.values()), {}
    # those that reach their limit at the lowest level are full first; the rest share one level
    for s in sorted(names, key=lambda s: limit * sizes[s] / weight[s]):
        if left / heavy * weight[s] <= limit * sizes[s]:
            break
        full[s] = limit * sizes[s]
        left, heavy = left - full[s], heavy - weight[s]
    return {s: full[s] if s in full else left / heavy * weight[s] for s in names}


def running(df: DataFrame, by: list[str], bucket: str, order: list[str], amount: Column, out: str) -> DataFrame:
    """Adds out, the sum of amount over the rows before, by `by`, ordered by bucket and then order, and _nth, a row's place in its bucket. No task gets more than a bucket."""
    inside = W.partitionBy(*by, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = df.groupBy(*by, bucket).agg(F.sum(amount).alias("_n"))
    before = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_{c}") for c in (*by, bucket)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, bucket)]
    return (
        df.withColumn("_nth", F.row_number().over(inside))
        .withColumn(out, F.sum(amount).over(inside) - amount)
        .join(offsets, same)
        .withColumn(out, (F.col(out) + F.col("_offset")).cast("long"))
        .drop("_offset", *[f"_{c}" for c in (*by, bucket)])
    )


def _buckets(rows: int) -> int:
    """Hex digits of the order key that cut a source into ranges of some thousand rows."""
    digits = 1
    while rows > 4096 * 16**digits and digits < 8:
        digits += 1
    return digits


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[Column] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot, uses and the carried columns, which should be few and short.

    uses: for each pass through the source that takes words of the document, how many and the slot where they begin.
    """
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(blank_words(F.col(text_col))).cast("long").alias("size"), *(carry or [])), "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row a source
    goal = targets({r.source: r["size"] for r in found}, weights, share, limit)
    known = [(r.source, r["size"], float(goal[r.source]), int(goal[r.source] + 0.5)) for r in found]
    plan = docs.sparkSession.createDataFrame(known, "_source string, source_size long, target double, wanted long")
    digits = _buckets(max((r.n for r in found), default=0))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    ordered = sized.withColumn("_order", order).withColumn("_range", F.substring("_order", 1, digits))
    streams = running(ordered, ["source"], "_range", ["_order", "size", *sized.columns[3:]], F.col("size"), "start").drop("_order")
    placed = streams.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    # _range and _nth tell a row of a source from all others
    cut = placed.select(F.struct(*placed.columns).alias("_row"), "source", "start", "size", F.explode_outer(F.when(F.col("size") > 0, whole)).alias("b"))
    taking = blocks_used(schedule(docs.sparkSession, goal, block), plan, block)
    meet = cut.join(taking, F.col("source").eqNullSafe(F.col("_source")) & (F.col("b") == F.col("_b")), "left")
    from_ = F.col("b") * block
    here = F.least(F.col("start") + F.col("size"), from_ + F.col("tokens")) - F.greatest(F.col("start"), from_)
    passes = [F.when((F.col("turn") == i) & (here > 0), F.struct("slot", here.alias("n"))) for i in range(math.ceil(limit))]
    use = lambda x: F.struct(F.sum(x["n"]).alias("n"), F.min(x["slot"]).alias("slot"))
    uses = F.filter(F.array(*map(use, passes)), lambda x: x["n"] > 0)
    return (
        meet.groupBy("_row")
        .agg(uses.alias("uses"))
        .select(*[F.col(f"_row.`{c}`") for c in placed.columns if c not in ("_range", "_nth")], "uses")
        .withColumns({"taken": F.aggregate("uses", F.lit(0).cast("long"), lambda a, x: a + x["n"]), "first_slot": F.get("uses", F.lit(0))["slot"]})
    )


def schedule(spark: SparkSession, goal: dict[str | None, float], block: int = BLOCK) -> DataFrame:
    """slot, source: the mix in its order. SPARE slots for each source follow, for what the points fall short of."""
    names, total = [s for s, t in goal.items() if t > 0], sum(goal.values())
    if not names:
        return spark.createDataFrame([], "slot long, source string")
    n, slots = len(names), math.ceil(total / block)
    ends = list(itertools.accumulate(goal[s] / total for s in names))
    shares = spark.createDataFrame(list(zip(names, [0.0, *ends[:-1]], [*ends[:-1], 2.0], range(n), strict=True)), "source string, lo double, hi double, nth long")
    # a share lies in the cells that it touches; a point looks its own cell up
    last = F.lit(n - 1)
    cells = shares.withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("lo") * n), last), F.least(F.floor(F.col("hi") * n), last))))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"pmod(CAST(id AS DOUBLE) * {GOLDEN!r}D, 1.0D)").alias("point"))
    inside = (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))
    mixed = points.withColumn("cell", F.floor(F.col("point") * n)).join(cells, "cell").where(inside).select("slot", "source")
    more = shares.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SPARE - 1))))
    spare = more.select((slots + F.col("k") * n + F.col("nth")).alias("slot"), "source")
    return mixed.unionByName(spare)


def blocks_used(slots: DataFrame, plan: DataFrame, block: int = BLOCK, run: int = 65536) -> DataFrame:
    """_source, _b, turn, tokens, slot: for each use of a source's block how many tokens it takes from the block's start, and where."""
    ranked = running(slots.withColumn("_run", F.floor(F.col("slot") / run)), ["source"], "_run", ["slot"], F.lit(1), "rank")
    n, blocks = F.col("source_size"), F.ceil(F.col("source_size") / block)
    turn, b = F.floor(F.col("rank") / blocks), F.pmod(F.col("rank"), blocks)
    tokens = F.least(F.lit(block), n - b * block, F.col("wanted") - turn * n - b * block)
    at = ranked.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    return at.select("_source", b.alias("_b"), turn.alias("turn"), tokens.cast("long").alias("tokens"), "slot").where(F.col("tokens") > 0)


def mixed_documents(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents of the mix, with their columns: a row for each use, its text whole or, where a target ends, its first words.

    Each partition is a random part of the mix, in the mix's order.
    """
    cols = docs.columns
    keys = row_key(*[F.col(f"`{c}`") for c in cols])
    # equal rows are one document with the uses of all
    uses = mix(docs, text_col=text_col, carry=keys, **how).select("_k1", "_k2", "size", F.explode("uses").alias("use"))
    listed = uses.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("use.n", "use.slot", "size")).alias("_uses"))
    once = docs.select(*keys, F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_doc")).dropDuplicates(["_k1", "_k2"])
    each = once.join(listed, ["_k1", "_k2"]).select("_doc", F.inline("_uses")).sortWithinPartitions("slot")
    text = F.col(f"_doc.`{text_col}`")
    first = F.array_join(F.slice(blank_words(text), F.lit(1), F.col("n").cast("int")), " ")
    cut = each.select("_doc", F.when(F.col("n") == F.col("size"), text).otherwise(first).alias("_text"))
    new = {text_col: F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return cut.select(*[(new[c] if c in new else F.col(f"_doc.`{c}`")).alias(c) for c in cols])
