"""Vector codes, the compression classifier of quality and fill-in-the-middle: against brute force, held-out labels and round trips."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmgraph.llm import compression, fill_middle, queries, quality_classifier, vector_codes

from ..conftest import DATA, against_sql

VECS = "vec_id long, embedding array<float>, label int, code string, error int, _x int"


def vecs(spark, rows):
    return spark.createDataFrame([(i, v, y, "zz", -1, -1) for i, v, y in rows], VECS)


def lloyd(rows, entries, rounds, parts=4):
    """Codes, errors and codebooks by plain loops."""
    width = -(-max(len(v) for _, v, _ in rows) // parts)
    whole = lambda v: [math.floor(1024 * float(np.float32(x))) for x in v] + [0] * (width * parts - len(v))
    rows = sorted(((i, whole(v), y) for i, v, y in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in rows]).reshape(len(rows), parts, width)
    books = x[:entries].transpose(1, 0, 2).copy()

    def near(p):
        d = ((x[:, None, p] - books[p][None]) ** 2).sum(-1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p in range(parts):
            at, _ = near(p)
            for e in set(at.tolist()):
                mine = x[at == e, p]
                books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    codes, errors = zip(*(near(p) for p in range(parts)), strict=True)
    made = [(i, "".join(f"{c[k]:02x}" for c in codes), int(sum(e[k] for e in errors)), y) for k, (i, _, y) in enumerate(rows)]
    return made, books


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_vector_codes_against_plain_lloyd(spark, spread):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, spread, 8).astype(np.float32)], int(i) % 3) for i in rng.permutation(700)]
    rows += [(1000 + i, [0.25] * 8, None) for i in range(300)]  # a group of copies
    settings = vector_codes.Settings(entries=16, rounds=3)
    codes, books = vector_codes.compress(vecs(spark, rows).repartition(3), settings)
    made, expected = lloyd(rows, 16, 3)
    assert (books == expected).all()
    assert order(tuple(r) for r in codes.select("vec_id", "code", "error", "label").collect()) == order(made)
    total = {y: sum(e for _, _, e, z in made if z == y) for y in (0, 1, 2, None)}
    assert all(r.label_error == total[r.label] for r in vector_codes.with_label_error(codes).collect())
    text = ",".join(str(v) for p in expected for e in p for v in e)
    assert vector_codes.digest(books) == hashlib.sha256(text.encode()).hexdigest()
    back = vector_codes.decoded(codes.where("vec_id >= 1000"), books).first()
    assert np.allclose(back.vector, np.concatenate([books[p, int(back.code[2 * p : 2 * p + 2], 16)] for p in range(4)]) / 1024 + 0.5 / 1024)


def test_vector_codes_odd_rows(spark):
    bad = [(1, None, 0), (2, [1.0, None], 0), (3, [math.nan, 1.0], 0), (4, [math.inf, 0.0], None)]
    good = [(5, [0.5, -0.5], 1), (5, [0.5, -0.5], 1), (5, [0.25, 1.0], 1), (None, [0.1] * 6, None), (7, [], 2), (8, [3.0e38, -3.0e38], 2), (-9, [0.0] * 5, 2)]
    codes, books = vector_codes.compress(vecs(spark, bad + good), vector_codes.Settings(entries=3, rounds=2))
    limit = int((2**62 / 8) ** 0.5) // 2  # whole numbers stay within it
    cut = [(i, [max(-limit, min(limit, x * 1024)) / 1024 for x in v] if v else v, y) for i, v, y in good]
    made, expected = lloyd_of_doubles(cut, 3, 2)
    assert (books == expected).all() and order(tuple(r) for r in codes.select("vec_id", "code", "error", "label").collect()) == order(made)
    none, books = vector_codes.compress(vecs(spark, bad))
    assert none.count() == 0 and books.shape[1] == 0
    assert vector_codes.with_label_error(vector_codes.compress(vecs(spark, []))[0]).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(vecs(spark, good), vector_codes.Settings(entries=257))


def lloyd_of_doubles(rows, entries, rounds):
    kept = np.float32
    try:
        np.float32 = float  # bounds are no single-precision numbers
        return lloyd(rows, entries, rounds)
    finally:
        np.float32 = kept


def test_dual_tree_equals_every_distance():
    rng = np.random.default_rng(1)
    for n, k, low, high in ((1, 1, 0, 1), (500, 37, -5, 6), (1500, 256, -40_000_000, 40_000_000), (900, 256, -900, 900)):
        x = rng.integers(low, high, (n, 6)) if high > 1 else np.zeros((n, 6), np.int64)
        entries = x[rng.integers(0, n, k)] + rng.integers(0, 2, (k, 6))
        order_ = vector_codes.split_order(x, vector_codes.LEAF)
        tree = vector_codes.Tree(x[order_], vector_codes.LEAF)
        assert (tree.sum[0] == x.sum(0)).all() and sorted(order_.tolist()) == list(range(n))
        whole, byrow = vector_codes.assign(tree, vector_codes.Book(entries))
        got = np.full(n, -1)
        for node, e in whole:
            got[tree.start[node] : tree.end[node]] = e
        for a, b, e, _ in byrow:
            got[a:b] = e
        assert (got == ((x[order_][:, None] - entries[None]) ** 2).sum(-1).argmin(1)).all()
    clusters = np.repeat(rng.integers(-(10**6), 10**6, (4, 6)), 200, axis=0) + rng.integers(0, 9, (800, 6))
    order_ = vector_codes.split_order(clusters, vector_codes.LEAF)
    whole, byrow = vector_codes.assign(vector_codes.Tree(clusters[order_], vector_codes.LEAF), vector_codes.Book(clusters[[0, 200, 400, 600]]))
    assert whole and not byrow  # far clusters are assigned by nodes alone


def test_vector_codes_against_sql(spark):
    made, expected = against_sql(spark, queries.QUERIES["op11_vector_codes"], queries.ORACLES["op11_vector_codes"])
    assert made == expected


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, output string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, 0, -1.0, "x", -1) for i, t in rows], DOCS)


ODD = [(None, None), (None, ""), (1, " \n\n"), (1, " \n\n"), (1, "other"), (2, "<P>a<S>"), (3, "ab<M>"), (4, "é😀É a1b2\tcd"), (5, "a" * 300_000), (6, "a b\n." * 60_000), (7, "<S"), (8, "$1 \\ ${x}")]


def fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_middle_odd_rows_and_round_trip(spark):
    rows = ODD + [(i, f"word {i}, w{i % 7}!\n" * (i % 5)) for i in range(10, 200)]
    out = fill_middle.transform(docs(spark, rows))
    back = out.select("_row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    made = sorted(((r.doc_id is None, r.doc_id or 0), r.text, tuple(r)[1:6]) for r in back)
    assert made == sorted(((i is None, i or 0), t or "", fim(i, t)) for i, t in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert set(out.select("_row.*").columns) == set(docs(spark, []).columns) - {"text"}
    assert fill_middle.transform(docs(spark, [])).count() == 0
    assert out.where("prefix_chars > 3 AND form = 'psm'").count() == sum(fim(i, t)[1] == "psm" and fim(i, t)[2] > 3 for i, t in rows)


def test_fill_middle_plan_shuffles_nothing_and_matches_once(spark):
    plan = queries.QUERIES["op13_fill_middle"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("regexp_replace") == 1 and plan.count("regexp_extract_all") == 1
    assert "struct<doc_id:bigint,text:string>" in plan


def test_fill_middle_against_sql(spark):
    made, expected = against_sql(spark, queries.QUERIES["op13_fill_middle"], queries.ORACLES["op13_fill_middle"])
    assert made == expected


def test_quality_classifier_on_held_out_labels(spark):
    folder = f"{DATA}/sf0.1"
    out = queries.QUERIES["op12_quality_classifier"](spark, folder)
    known = out.where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    found = {(r.quality, r.predicted): r["count"] for r in known.groupBy("quality", "predicted").count().collect()}
    get = lambda *k: found.get(k, 0)
    assert get(1, 1) / (get(1, 1) + get(1, 0)) > 0.99  # good ones stay
    assert get(0, 0) / (get(0, 0) + get(0, 1)) > 0.84  # labels are noisy: some bad ones read like good ones
    scores = out.agg(F.min("score"), F.max("score"), F.count("score")).first()
    assert 0 <= scores[0] and scores[1] <= 1 and scores[2] == 10_000


def toy(spark, n=120):
    rows = [(i, f"plain words number {i} stand in this line of quiet prose and {i % 13} more" if i % 3 else f"BUY!! {i}## NOW$$ %%% {i % 13} ###") for i in range(n)]
    return docs(spark, rows), spark.createDataFrame([(i, int(i % 3 > 0), 5) for i in range(n)], "doc_id long, quality int, score int")


def test_quality_classifier_scores_by_hand(spark):
    texts, labels = toy(spark)
    model = quality_classifier.fit(texts, labels, F.lit(True))
    good, bad = (compression.compressor(d, model.level) for d in (model.good, model.bad))
    assert model.good != model.bad
    for text in ("plain words", "NOW$$ ###", "", None, "x" * 100_000):
        body = (text or "").encode()
        g, b = len(good(body)), len(bad(body))
        x = [(g - b) / max(g, b), (g - b) / (len(body) + 16), g / (len(body) + 16)]
        z = sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights, strict=False)) + model.weights[-1]
        assert abs(model.score([text])[0] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-12
    out = {r.doc_id: r.score for r in quality_classifier.score(texts.drop("score"), model).collect()}
    assert all((s > 0.5) == (i % 3 > 0) for i, s in out.items())
    again = quality_classifier.fit(texts.repartition(5), labels.repartition(3), F.lit(True))
    assert again.good == model.good and again.bad == model.bad and np.allclose(again.weights, model.weights)


def test_quality_classifier_odd_rows(spark):
    texts, labels = toy(spark)
    odd = docs(spark, ODD)
    extra = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0), (3, 1, 0), (3, 0, 0), (5, 0, 0), (999, 1, 0)], "doc_id long, quality int, score int")
    model = quality_classifier.fit(texts.unionByName(odd), labels.unionByName(extra), F.lit(True))
    out = quality_classifier.score(odd, model, out="q")
    assert out.count() == len(ODD) and out.columns == [*odd.columns, "q"] and all(0 <= r.q <= 1 for r in out.collect())
    assert quality_classifier.score(docs(spark, []), model, out="q").count() == 0
    only = quality_classifier.fit(texts, labels.where("quality = 1"), F.lit(True))
    assert only.score(["x", None]).tolist() == [1.0, 1.0]
    none = quality_classifier.fit(docs(spark, []), labels.limit(0), F.lit(True))
    assert none.score(["x"]).tolist() == [0.0]
    two = quality_classifier.fit(texts, labels.where("doc_id < 2"), F.lit(True))
    assert np.isfinite(two.score(["x", ""])).all()
    held = quality_classifier.fit(texts, labels, F.col("_id") < 30)
    assert abs(held.prior - 20 / 30) < 1e-9
