"""Contracts that SQL does not show: dirty input, structure files, models, errors."""

import pytest
from pyspark.sql import functions as F

from ohmgraph.functions import columns as C
from ohmgraph.operators import contacts, folds, models
from ohmgraph.sources import mutations as M
from ohmgraph.sources import structures as S

ATOM = "{rec:<6}{no:>5}  {atom:<3}{alt}{res:<3} {ch}{seq:>4}{ic}   {x:8.3f}{y:8.3f}{z:8.3f}{occ:6.2f}  0.00"


def line(no, seq, x, rec="ATOM", atom="CA", alt=" ", res="ALA", ch="A", ic=" ", occ=1.0):
    return ATOM.format(rec=rec, no=no, atom=atom, alt=alt, res=res, ch=ch, seq=seq, ic=ic, x=x, y=0.0, z=0.0, occ=occ)


def test_structure_files(spark, tmp_path):
    first = [line(1, 1, 0.0), line(2, 2, 3.0, alt="A", occ=0.4), line(3, 2, 4.0, alt="B", occ=0.6), line(4, 2, 7.0, ic="A", res="XYZ"), line(5, 3, 9.0, atom="N"), line(6, 9, 5.0, rec="HETATM"), line(7, 1, 50.0, ch="B")]
    (tmp_path / "1abc.pdb").write_text("\n".join(["HEADER", "MODEL        1", *first, "ENDMDL", "MODEL        2", *first, "ENDMDL"]))
    atoms = S.read_structures(spark, str(tmp_path / "*.pdb"))
    assert atoms.count() == 14
    nodes = contacts.residue_nodes(atoms).orderBy("node").collect()
    assert [(r.graph_id, r.node, r.chain, r.resseq, r.aa1, r.x) for r in nodes] == [("1ABC", 0, "A", 1, "A", 0.0), ("1ABC", 1, "A", 2, "A", 4.0), ("1ABC", 2, "A", 2, "X", 7.0), ("1ABC", 3, "B", 1, "A", 50.0)]
    assert contacts.residue_nodes(atoms, "B").count() == 1


def test_dirty_mutations(spark):
    rows = [(" 1abc ", "12.0", "v", "A ", "1.5"), ("1abcd", "3", "V", "G", "2"), ("12", "3", "V", "G", "2"), ("1abc", "x", "V", "G", "2"), ("1abc", "3", "V", None, "2"), ("1abc", "3", "V", "G", "high")]
    got = M.normalize_mutations(spark.createDataFrame(rows, "`PDB` string, `Pos` string, `WT` string, `Mutant` string, `DDG` string")).collect()
    assert [(r.pdb_id, r.position, r.wild_type, r.mutation, r.ddG, r.chain, r.pH) for r in got] == [("1ABC", 12, "V", "A", 1.5, "A", 7.0), ("1ABC", 3, "V", "G", 2.0, "A", 7.0)]
    code = M.normalize_mutations(spark.createDataFrame([("1abc", 42, "V42G", 1.0)], "pdb string, pos int, mutation string, ddg double")).first()
    assert (code.wild_type, code.mutation) == ("V", "G")
    with pytest.raises(ValueError, match="ddG"):
        M.normalize_mutations(spark.createDataFrame([("1abc", 1)], "pdb string, pos int"))
    with pytest.raises(ValueError):
        M.union_datasets({"a": None})


def test_empty_tables(spark):
    nodes = spark.createDataFrame([], "graph_id string, node int, chain string, resseq int, aa1 string, x double, y double, z double")
    assert contacts.contact_edges(nodes).count() == 0
    assert contacts.graph_size_guard(nodes).count() == 0


def test_unknown_choices():
    with pytest.raises(ValueError):
        C.conductance(F.lit(1.0), "nope")
    with pytest.raises(ValueError):
        folds.folds_by("nope", None)


def test_group_folds_are_even_and_whole(spark):
    df = spark.createDataFrame([(i, "abcdefg"[min(i // 7, 6)]) for i in range(60)], "mutation_id long, g string")
    rows = folds.group_folds(df, "g", 3).join(df, "mutation_id").collect()
    assert all(len({r.fold for r in rows if r.g == g}) == 1 for g in "abcdefg")
    assert len(rows) == 60 and len({r.fold for r in rows}) == 3


@pytest.fixture(scope="module")
def table(spark):
    import numpy as np

    rng = np.random.default_rng(42)
    x = rng.normal(size=(50, 3))
    y = 2 * x[:, 0] - 1.5 * x[:, 1] + 0.5 * x[:, 2] + rng.normal(0, 0.5, 50)
    groups = ["P1"] * 15 + ["P2"] * 15 + ["P3"] * 10 + ["P4"] * 10
    return spark.createDataFrame([(i, groups[i], *map(float, x[i]), float(y[i])) for i in range(50)], "mutation_id long, pdb_id string, f1 double, f2 double, f3 double, ddG double").cache()


COLS = ["f1", "f2", "f3"]


def test_linear_models_agree(table):
    settings = {"ridge": {"alpha": 1e-6}, "elastic_net": {"alpha": 1e-6}, "lasso": {"alpha": 1e-6}}
    rows = models.compare_models(table, COLS, settings).collect()
    assert all(r.pearson_r > 0.9 and r.n_folds == 5 and r.n_features == 3 for r in rows)
    assert max(r.cv_r2_mean for r in rows) - min(r.cv_r2_mean for r in rows) < 1e-3


def test_ridge_is_the_closed_form(table):
    import numpy as np

    t = table.toPandas().sort_values("mutation_id")
    held = table.withColumn("fold", (F.col("mutation_id") % 5).cast("int"))
    got = models.ridge_predictions(held, COLS, "ddG", 1.0).toPandas().sort_values("mutation_id")
    for k in range(5):
        tr, te = t[t.mutation_id % 5 != k], t[t.mutation_id % 5 == k]
        m, s = tr[COLS].mean().to_numpy(), tr[COLS].std(ddof=0).to_numpy()
        z = (tr[COLS].to_numpy() - m) / s
        b = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (tr.ddG.to_numpy() - tr.ddG.mean()))
        assert np.allclose(got[got.fold == k].yhat, (te[COLS].to_numpy() - m) / s @ b + tr.ddG.mean())


def test_trees_and_few_rows(table):
    tree = models.train_and_evaluate(table, COLS, "rf", k=2, settings={"n": 5, "depth": 3}).first()
    assert tree.n_samples == 50 and tree.pearson_r > 0.3
    few = models.train_and_evaluate(table.limit(3), COLS).first()
    assert few.n_samples == 3 and few.cv_r2_mean != few.cv_r2_mean
    with pytest.raises(ValueError):
        models.train_and_evaluate(table, COLS, how="nope")


def model_rows(spark, target, n=240):
    rows = [(i, (i * 37 % 101) / 10.0, (i * 53 % 97) / 7.0, float(target(i, (i * 37 % 101) / 10.0))) for i in range(n)]
    return spark.createDataFrame(rows, "mutation_id long, a double, b double, ddG double")


SMALL = {"gbt": {"n": 40, "depth": 2, "rate": 0.3, "subsample": 1.0, "leaf": 1}, "rf": {"n": 12, "depth": 4, "leaf": 1}}


def test_trees_learn_a_split_and_repeat(spark):
    x = model_rows(spark, lambda i, a: 3.0 if a > 5 else -1.0)
    train, test = x.where("mutation_id % 4 > 0"), x.where("mutation_id % 4 = 0")
    for kind, settings in SMALL.items():
        runs = [{r.mutation_id: (r.y, r.yhat) for r in models.fit_predict(train, test, ["a", "b"], "ddG", kind, settings).collect()} for _ in range(2)]
        assert runs[0] == runs[1] and len(runs[0]) == 60
        assert max(abs(y - yhat) for y, yhat in runs[0].values()) < (0.01 if kind == "gbt" else 1.5)
        i = {r.feature: r.importance for r in models.feature_importances(x, ["a", "b"], kind, "ddG", settings).collect()}
        assert i["a"] > 0.9 and sum(i.values()) == pytest.approx(1)


def test_models_of_a_constant_target(spark):
    x = model_rows(spark, lambda i, a: 2.5, 60)
    for kind in ("gbt", "rf", "ridge", "elastic_net", "lasso"):
        got = models.fit_predict(x, x, ["a", "b"], "ddG", kind, SMALL.get(kind, {})).collect()
        assert all(r.yhat == pytest.approx(2.5, abs=1e-6) for r in got), kind


def test_penalised_models_of_one_column(spark):
    import numpy as np

    x = model_rows(spark, lambda i, a: 1.3 * a + (i % 7) / 3)
    p = x.toPandas()
    a, y = p.a.to_numpy(), p.ddG.to_numpy()
    z = (a - a.mean()) / a.std()
    cov = (z * (y - y.mean())).mean()
    for kind, alpha, l1 in (("lasso", 0.1, 1.0), ("elastic_net", 0.1, 0.5), ("lasso", 1.5, 1.0), ("elastic_net", 2.0, 0.3), ("lasso", 99.0, 1.0)):
        slope = np.sign(cov) * max(0.0, abs(cov) - alpha * l1) / (1 + alpha * (1 - l1))
        want = dict(zip(p.mutation_id, y.mean() + slope * z, strict=True))
        got = models.fit_predict(x, x, ["a"], "ddG", kind, {"alpha": alpha, "l1": l1}).collect()
        assert all(r.yhat == pytest.approx(want[r.mutation_id], abs=1e-4) for r in got), (kind, alpha)


def test_stacking_joins_its_bases(spark):
    x = model_rows(spark, lambda i, a: 3.0 if a > 5 else -1.0, 120)
    settings = {"gbt": SMALL["gbt"] | {"n": 8}, "rf": SMALL["rf"]}
    got = models.fit_predict(x, x, ["a", "b"], "ddG", "stacking", settings).collect()
    assert len(got) == 120 and sum(abs(r.y - r.yhat) for r in got) / 120 < 0.2
    m = models.train_and_evaluate(x, ["a", "b"], "ridge")
    r = models.with_importances(m, x, ["a", "b"], "ridge").first()
    assert set(r.feature_importances) == {"a", "b"} and r.feature_importances["a"] > abs(r.feature_importances["b"])
    assert models.with_importances(m, x, ["a", "b"], "stacking").first().feature_importances is None


def test_mean_ranks_and_percentiles(spark, monkeypatch):
    import numpy as np

    values = [None, 1.0, 2.0, 2.0, 2.0, 5.0, 7.0, 7.0, -3.0] + [float(i % 11) for i in range(60)]
    df = spark.createDataFrame([(i, "g" if i % 3 else None, v) for i, v in enumerate(values)], "id long, k string, v double")
    want = {}
    for k in ("g", None):
        own = [(i, v) for i, v in enumerate(values) if (i % 3 != 0) == (k == "g")]
        for i, v in own:
            less = lambda x: (x is not None and v is not None and x < v) or (x is None and v is not None)
            want[i] = sum(less(x) for _, x in own) + (sum(x == v for _, x in own) + 1) / 2
    for size in (50_000, 3):
        full = folds.counted_values
        monkeypatch.setattr(folds, "counted_values", lambda d, c, by, size=size, full=full: full(d, c, by, size))
        assert {r.id: r.rank for r in models.average_rank(df, "v", ["k"], "rank").collect()} == want
        at = [0.2, 0.4, 0.5, 0.99]
        assert folds.percentiles(df, "v", at) == pytest.approx(np.quantile([v for v in values if v is not None], at).tolist())
        monkeypatch.undo()
    assert folds.percentiles(df.where("v > 99"), "v", [0.5]) == []
    r = models.spearman(spark.createDataFrame([(1.0, float(i)) for i in range(9)], "a double, b double"), "a", "b").first()
    assert r.spearman_r == 0.0


def test_samples_are_topped_up_from_large_groups(spark):
    from ohmgraph.operators import sampling

    rows = [(i, "big" if i < 80 else f"s{i % 7}") for i in range(100)]
    df = spark.createDataFrame(rows, "mutation_id long, pdb_id string")
    got = sampling.diverse_sample(df, 40).collect()
    assert len({r.mutation_id for r in got}) == 40 and sum(r.pdb_id == "big" for r in got) > 5
    assert len(sampling.stratified_sample(df, 40).collect()) == sum(min(5, n) for n in [80, 3, 3, 3, 3, 3, 3, 2])


def test_hop_shells_by_hand(spark):
    from ohmgraph.operators import graphmetrics as G

    rng = __import__("random").Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(18)})
    e = spark.createDataFrame([("g", u, v, 1.0) for u, v in pairs], "graph_id string, u int, v int, weight double")
    seeds = spark.createDataFrame([("g", i) for i in range(14)], "graph_id string, node int")
    got = {(r.site, r.node): r.hop for r in G.hop_shells(e, seeds, 3).collect()}
    want = {}
    for s in range(14):
        seen, ring = {s}, {s}
        for hop in (1, 2, 3):
            ring = {b for a, b in [*pairs, *[(v, u) for u, v in pairs]] if a in ring} - seen
            seen |= ring
            want |= {(s, x): hop for x in ring}
    assert got == want


def test_sinks_and_stored_steps(spark, tmp_path):
    from ohmgraph.storage import reuse

    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b"), (3, -1.0, "a")], "mutation_id long, x double, dataset string")
    for fmt in ("parquet", "json"):
        S.write_features(df, str(tmp_path / fmt), fmt)
        back = spark.read.format(fmt).load(str(tmp_path / fmt))
        assert sorted((r.mutation_id, r.x, r.dataset) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    S.write_features(df.drop("dataset"), str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    made = []
    build = lambda: made.append(1) or df
    for _ in range(3):
        assert reuse(spark, str(tmp_path / "step"), build).count() == 3
    assert made == [1]


def test_jobs_compare_and_ablate(spark):
    from ohmgraph.plans import jobs

    x = model_rows(spark, lambda i, a: 1.3 * a + (i % 7) / 3, 80).withColumn("pdb_id", F.col("mutation_id") % 9)
    published = spark.createDataFrame([("theirs", "other", "own", 0.5, 1.0, 0.4)], "method string, category string, eval_protocol string, pearson_r double, rmse double, spearman_r double")
    out = jobs.compare(x, {"ridge": {}}, "pdb_id", published, cols=["a", "b"])
    assert {r.cv_strategy for r in out["metrics"].collect()} == set(folds.STRATEGIES) and out["best"].count() == 4
    assert out["ranking"].count() == 5 and out["ranking"].orderBy("rank").collect()[-1].method == "theirs"
    single, groups = jobs.ablate(x, cols=["a", "b"])
    assert single.orderBy("importance_rank").first().feature_dropped == "a" and groups.count() == 0
