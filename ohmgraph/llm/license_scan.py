"""License scans by diagonal voting.

Every rolling window of k words is hashed and joined with the templates' window positions. A match of document position
i with template position j votes for diagonal i - j: it compares the window's words themselves, so equal hashes of other
words do not vote. Votes are added by diagonal, and neighbouring diagonals (small insertions and deletions) are merged
into one place. A place is verified by its span: its share is the template's words that its windows cover, over the
template's words or, if more, the words that the span holds, so words that are put in count against it.

Licenses of a family differ by few words. A place counts only if it covers the telling words of its template, and if no
telling word that the template lacks stands in it or in a gap of it. Where places of several labels overlap, those that
overlap the best one (by share, then covered words, then the template's place in the list) give way to it. A short base
phrase counts where one diagonal holds all its windows, that is where its words stand consecutively; it gives way to none.

DataFrame functions only. (Outer explodes keep Spark from testing the size of an array that it would build twice.)
Templates are a stated list; their windows are broadcast, and templates() refuses a list of more than MAX_WINDOWS. Only
windows that match and one row a document leave the scan, keyed by document, so no license and no hot passage meets in
one task.

Defined results: null text is empty. Without words or matches: counts 0, places empty, labels '' and score 0. A row is
keyed by its doc_id and text, so a task that runs again deals it the same way; equal rows are scanned once and returned
as often as they came. Null or repeated doc_ids are as good as others.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, row_key

K = 3
MAX_WINDOWS = 200_000
#: Diagonals at most so far apart belong to one place.
NEAR = 3
#: Share of a template's words that a place must cover for its label.
COVERED = 0.75
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: phrase -> label
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Words that tell licenses of a family apart.
TELLING = ("affero", "lesser", "library", "noncommercial", "noderivatives", "sharealike")
#: Notices that the method looks for besides: (label, text, further words that the place must cover)
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ""),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("gpl", "licensed under the GNU General Public License", "gnu general"),
    ("gpl", "under the terms of the GNU General Public License", "gnu general"),
    ("lgpl", "licensed under the GNU Lesser General Public License", "gnu general"),
    ("lgpl", "under the terms of the GNU Lesser General Public License", "gnu general"),
    ("agpl", "licensed under the GNU Affero General Public License", "gnu general"),
    ("agpl", "under the terms of the GNU Affero General Public License", "gnu general"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", "attribution"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "attribution"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "attribution"),
    ("cc-by-nd", "licensed under a Creative Commons Attribution NoDerivatives 4.0 International License", "attribution"),
    ("cc-by-nc-sa", "licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License", "attribution"),
    ("cc-by-nc-nd", "licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License", "attribution"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "fee"),
    ("proprietary", "may not be reproduced, distributed or transmitted in any form without the prior written permission of the publisher", "reproduced permission"),
    ("proprietary", "All rights reserved", "all rights reserved"),
    ("mit", "SPDX-License-Identifier: MIT", "mit"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0", "apache 2 0"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause", "bsd"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-only", "gpl"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-only", "gpl"),
    ("lgpl", "SPDX-License-Identifier: LGPL-3.0-only", "lgpl"),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-only", "agpl"),
    ("mpl-2", "SPDX-License-Identifier: MPL-2.0", "mpl"),
]


def template_words(text: str) -> list[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(SEPARATORS, lowered) if w]


def templates(spark: SparkSession, base: dict[str, str] = BASE, notices=tuple(NOTICES)) -> DataFrame:
    """A row a template window: _t, base, label, windows (of its template), words, own (its telling words), must (places of the words to cover), at (its position), gram."""
    rows = []
    for t, (is_base, label, text, more) in enumerate([(True, v, k, "") for k, v in base.items()] + [(False, *n) for n in notices]):
        words = template_words(text)
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        n = len(words) - K + 1
        own = [w for w in words if w in TELLING]
        must = [i for i, w in enumerate(words) if w in TELLING or w in more.split()]
        rows += [(t, is_base, label, n, len(words), own, must, i, words[i : i + K]) for i in range(n)]
    if len(rows) > MAX_WINDOWS:
        raise ValueError(f"{len(rows)} template windows are too many to broadcast")
    schema = "_t int, base boolean, label string, windows int, words int, own array<string>, must array<int>, at int, gram array<string>"
    return spark.createDataFrame(rows, schema).withColumn("_h", F.xxhash64(*[F.col("gram")[i] for i in range(K)]))


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices=tuple(NOTICES), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places (label, start, end in words, covered)."""
    spans = windows(docs, templates(docs.sparkSession, base, notices), id_col, text_col)
    key = ["_k1", "_k2"]
    by_doc, by_template = [*key, "doc_id", "n_words"], [*key, "doc_id", "n_words", "_t", "base", "label", "windows", "words", "own", "must"]
    diagonals = spans.groupBy(*by_template, (F.col("i") - F.col("at")).alias("diag")).agg(
        F.collect_set("at").alias("at"), F.min("i").alias("first"), F.max("i").alias("last"),
        F.flatten(F.collect_set("near")).alias("near"), F.count_if(F.col("at").isNull()).alias("copies"),
    )
    order = W.partitionBy(*key, "_t").orderBy("diag")
    gap = F.col("diag") - F.lag("diag").over(order)
    joined = diagonals.withColumn("place", F.sum(F.when(F.col("base") | F.coalesce(gap > NEAR, F.lit(True)), 1).otherwise(0)).over(order))
    merged = joined.groupBy(*by_template, "place").agg(
        F.min("first").alias("start"), (F.max("last") + K).alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"),
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.sum("copies").alias("copies"),
    )
    covered = F.aggregate(
        "at", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + K).alias("end"), (a["n"] + p + K - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"],
    )
    told = F.forall("must", lambda m: F.exists("at", lambda p: (p <= m) & (m < p + K)))
    foreign = F.exists("near", lambda x: (x["at"] >= F.col("start")) & (x["at"] < F.col("end")) & ~F.array_contains("own", x["word"]))
    full = F.col("base") & (F.size("at") == F.col("windows"))
    shared = (
        merged.withColumn("n", covered)
        .withColumn("share", F.when(~F.col("base") & told & ~foreign, F.col("n") / F.greatest("words", F.col("end") - F.col("start"))))
        .withColumn("full", F.coalesce(full, F.lit(False)))
        .withColumn("_found", F.coalesce(F.col("share") >= COVERED, F.lit(False)))
    )
    # overlapping places of notices form a run; what overlaps its best one gives way to it unless it has the same label
    along = W.partitionBy(*key, "_found").orderBy("start", "end", "_t")
    apart = F.coalesce(F.col("start") >= F.max("end").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    runs = shared.withColumn("_apart", apart.cast("int")).withColumn("_run", F.sum("_apart").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rank = F.struct("share", "n", (-F.col("_t")).alias("t"), "label", "start", "end")
    best = F.max(F.when(F.col("_found"), rank)).over(W.partitionBy(*key, "_found", "_run"))
    judged = runs.withColumn("_best", best)
    stays = F.col("_found") & ((F.col("label") == F.col("_best.label")) | (F.col("start") >= F.col("_best.end")) | (F.col("end") <= F.col("_best.start")))
    places = judged.withColumn("stays", F.coalesce(stays, F.lit(False)))
    set_of = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    kept = F.col("full") | F.col("stays")
    place = F.struct("start", "end", "label", F.when(F.col("full"), 1.0).otherwise(F.col("share")).alias("covered"))
    counts = places.groupBy(*by_doc).agg(
        F.count_if("full").alias("n_base"),
        F.min(F.when(F.col("full"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("full"), F.col("start"))).cast("long").alias("last_word"),
        set_of(F.col("full")).alias("base_labels"),
        set_of(kept).alias("labels"),
        F.coalesce(F.max(F.when(F.col("full"), 1.0).otherwise(F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(kept, place))).alias("places"),
        F.sum("copies").alias("_copies"),
    )
    each = counts.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return each.drop(*key, "_copy", "_copies")


def windows(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The windows that match a template, with the telling words near them, and a row without one for each document, dealt by document."""
    cut = docs.select(
        *row_key(F.col(id_col), F.col(text_col)),
        F.col(id_col).alias("doc_id"),
        F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS, -1).alias("_w"),
    )
    # only the first and the last can be empty
    head, tail = F.when(F.get("_w", F.lit(0)) == "", 1).otherwise(0), F.when((F.size("_w") > 1) & (F.element_at("_w", -1) == ""), 1).otherwise(0)
    key = ["_k1", "_k2", "doc_id"]
    split = cut.select(*key, F.slice("_w", head + 1, F.size("_w") - head - tail).alias("_w"))
    grams = F.transform(F.sequence(F.lit(0), F.size("_w") - K), lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(K)]))
    none = F.array().cast("array<bigint>")
    hashed = split.withColumn("_grams", F.concat(F.when(F.size("_w") >= K, grams).otherwise(none), F.array(F.lit(None).cast("bigint"))))
    rolling = hashed.select(*key, F.size("_w").cast("long").alias("n_words"), "_w", F.posexplode_outer("_grams").alias("i", "_g"))
    same = [F.get("_w", F.col("i") + j) == F.get("gram", F.lit(j)) for j in range(K)]
    met = rolling.join(F.broadcast(known), F.col("_g") == F.col("_h"), "left")
    hit = F.col("_t").isNotNull() & same[0] & same[1] & same[2]
    around = F.transform(F.sequence(F.col("i") - NEAR, F.col("i") + K + NEAR - 1), lambda p: F.struct(p.alias("at"), F.when(p >= 0, F.get("_w", p)).alias("word")))
    near = F.filter(around, lambda x: x["word"].isin(*TELLING))
    found = met.where(F.col("_g").isNull() | hit).withColumn("near", F.when(F.col("_t").isNotNull(), near))
    return found.drop("_w", "_g", "_h", "gram").repartition("_k1")
