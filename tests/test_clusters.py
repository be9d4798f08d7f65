"""Cluster geometry and quality metrics against NumPy."""

import numpy as np

from lineagelab.operators import clusters as C
from lineagelab.operators import evaluate as EV


def _points(spark, seed=1, n=60, d=4, noise=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = i % 3
        v = (rng.normal(size=d) + 4 * c).tolist()
        rows.append((i, v, -1 if i < noise else c))
    return rows, spark.createDataFrame(rows, "sample_key long, vec array<double>, cluster_id int")


def np_silhouette(X, lab):
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return np.array(s)


def np_db(X, lab):
    cs = sorted(set(lab))
    cent = {c: X[lab == c].mean(0) for c in cs}
    spread = {c: np.linalg.norm(X[lab == c] - cent[c], axis=1).mean() for c in cs}
    out = []
    for i in cs:
        out.append(max((spread[i] + spread[j]) / np.linalg.norm(cent[i] - cent[j]) for j in cs if j != i))
    return float(np.mean(out))


def test_silhouette_and_db(spark):
    rows, df = _points(spark)
    X = np.array([r[1] for r in rows if r[2] >= 0])
    lab = np.array([r[2] for r in rows if r[2] >= 0])
    got = EV.silhouette(df, block_rows=16)
    assert abs(got - np_silhouette(X, lab).mean()) < 1e-9
    assert abs(EV.davies_bouldin(df) - np_db(X, lab)) < 1e-9
    single = df.withColumn("cluster_id", df.cluster_id * 0)
    assert EV.silhouette(single) is None and EV.davies_bouldin(single) is None


def test_silhouettes_of_several_labellings_share_the_distances(spark, monkeypatch):
    from lineagelab.operators import pairs
    rows, df = _points(spark)
    other = df.selectExpr("sample_key", "vec", "CAST(CASE WHEN sample_key % 7 = 0 THEN -1 ELSE sample_key % 4 END AS INT) AS cluster_id")
    X = np.array([r[1] for r in rows])
    want = {}
    for name, frame in (("one", df), ("two", other)):
        lab = dict(frame.select("sample_key", "cluster_id").collect())
        lab = np.array([lab[r[0]] for r in rows])
        want[name] = np_silhouette(X[lab >= 0], lab[lab >= 0]).mean()
    calls = []
    plain = pairs.cluster_distance_sums
    monkeypatch.setattr(EV, "cluster_distance_sums", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = {r["method"]: r for r in EV.evaluate_methods({"one": df, "two": other}, block_rows=16, together=("one", "two")).collect()}
    assert len(calls) == 1
    assert all(abs(got[m]["silhouette"] - want[m]) < 1e-6 for m in want)
    apart = {r["method"]: r for r in EV.evaluate_methods({"one": df, "two": other}, block_rows=16).collect()}
    assert len(calls) == 3 and apart == got


def test_novelty_rules(spark):
    rows, df = _points(spark)
    nov = {r["sample_key"]: r for r in C.novelty(df).collect()}
    assert all(nov[i]["novelty_score"] == 1.0 for i in range(5))
    assert all(0.0 <= r["novelty_score"] <= 1.0 for r in nov.values())
    for c in range(3):
        scores = [nov[r[0]]["novelty_score"] for r in rows if r[2] == c]
        assert min(scores) == 0.0 and abs(max(scores) - 1.0) < 1e-12
    flat = spark.createDataFrame([(1, [0.0, 1.0], 0), (2, [0.0, -1.0], 0)],
                                 "sample_key long, vec array<double>, cluster_id int")
    assert {r["novelty_score"] for r in C.novelty(flat).collect()} == {0.0}


def test_nearest_centroid_ties(spark):
    cents = spark.createDataFrame([(3, [1.0, 0.0]), (1, [-1.0, 0.0])], "cluster_id int, centroid array<double>")
    pts = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0])], "sample_key long, vec array<double>")
    got = {r["sample_key"]: r["assigned_cluster"] for r in C.nearest_centroid(pts, cents).collect()}
    assert got == {1: 1, 2: 3}


def test_rank_average_ties(spark):
    ev = spark.createDataFrame([("a", 2, 0, 0.5, 1.0, "exact"), ("b", 2, 0, 0.5, 2.0, "exact"),
                                ("c", 2, 0, 0.1, 0.5, "exact"), ("d", 1, 0, None, None, "exact")],
                               EV.EVAL_SCHEMA)
    r = {x["method"]: x for x in EV.rank_methods(ev).collect()}
    assert (r["a"]["rank_sil"], r["b"]["rank_sil"], r["c"]["rank_sil"], r["d"]["rank_sil"]) == (1.5, 1.5, 3.0, 4.0)
    assert r["c"]["rank_db"] == 1.0 and r["d"]["rank_db"] == 4.0
    assert [m for m, x in r.items() if x["selected"]] == ["a"]


def test_kmeans_restarts_recover_planted(spark):
    from lineagelab.operators.models import fit_kmeans
    rng = np.random.default_rng(5)
    X = np.vstack([rng.normal(c, 0.3, size=(40, 3)) for c in ([0, 0, 0], [5, 0, 0], [0, 5, 0], [0, 0, 5])])
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "sample_key long, pca array<double>")
    labels, info = fit_kmeans(df, "pca", k=4, n_init=5, engine="shared")
    lab = {r["sample_key"]: r["cluster_id"] for r in labels.collect()}
    for g in range(4):
        assert len({lab[i] for i in range(40 * g, 40 * (g + 1))}) == 1
    assert len(set(lab.values())) == 4
    cent = np.array(info["centers"])
    inertia = sum(((X[i] - cent[lab[i]]) ** 2).sum() for i in range(len(X)))
    assert abs(inertia - info["cost"]) < 1e-6 * max(1.0, inertia)


def test_silhouette_singleton_cluster(spark):
    rows = [(1, [0.0, 0.0], 0), (2, [0.1, 0.0], 0), (3, [5.0, 5.0], 1)]
    df = spark.createDataFrame(rows, "sample_key long, vec array<double>, cluster_id int")
    X = np.array([r[1] for r in rows])
    lab = np.array([r[2] for r in rows])
    assert abs(EV.silhouette(df) - np_silhouette(X, lab).mean()) < 1e-12


def test_silhouette_sampled_mode(spark):
    rows, df = _points(spark, n=120)
    exact = EV.silhouette_values(df, block_rows=32).collect()
    full = {r["sample_key"]: r["silhouette"] for r in exact}
    from pyspark.sql import functions as F
    u = F.xxhash64(F.lit(42), F.col("sample_key")).cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)
    chosen = [r["sample_key"] for r in df.where("cluster_id >= 0").where(u < 0.3).collect()]
    got = EV.silhouette(df, mode="sampled", fraction=0.3, block_rows=32)
    # each sampled row gets its exact value against all rows
    assert abs(got - np.mean([full[k] for k in chosen])) < 1e-12


def test_store_roundtrip(spark, tmp_path):
    import pytest as _pytest
    from lineagelab.sources import store
    from lineagelab.plans.scoring import ScoringModel
    m = ScoringModel(lineages=["k__A|p__B"], leaf_names=["B"], phyla=["B"], mean=[0.5], scale=[1.0],
                     centroids=[(0, [0.1]), (2, [0.9])], ranges={0: (0.0, 1.0), 2: (0.5, 0.5)})
    p = str(tmp_path / "model")
    store.save_scoring_model(spark, m, p)
    back = store.load_scoring_model(spark, p)
    assert back.centroids == m.centroids and back.ranges == m.ranges and back.atlas_dims == m.atlas_dims
    store.save_selected(spark, "pca_gmm", str(tmp_path / "sel"))
    assert store.load_selected(spark, str(tmp_path / "sel")) == "pca_gmm"
    with _pytest.raises(FileNotFoundError):
        store.load_table(spark, str(tmp_path / "nothing"))


def test_restarts_share_their_passes_and_keep_the_lowest_cost(spark):
    from lineagelab.operators.models import fit_kmeans
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(c, 0.3, size=(40, 3)) for c in ([0, 0, 0], [5, 0, 0], [0, 5, 0])])
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "sample_key long, pca array<double>")
    labels, info = fit_kmeans(df, "pca", k=3, n_init=4)
    assert len(info["inertia_by_restart"]) == 4 and info["cost"] == min(info["inertia_by_restart"])      # the default engine shares its passes
    got = {r.sample_key: r.cluster_id for r in labels.collect()}
    c = np.array(info["centers"])
    d2 = ((X[:, None] - c[None]) ** 2).sum(-1)
    assert all(got[i] == d2[i].argmin() for i in range(len(X)))
    assert abs(d2.min(axis=1).sum() - info["cost"]) < 1e-6


def test_sums_that_leave_a_task_do_not_grow_with_the_clusters(spark):
    from lineagelab.operators.evaluate import silhouette_values
    from lineagelab.operators.pairs import cluster_distance_sums
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 3))
    label = rng.integers(-1, 60, 600)
    pts = spark.createDataFrame([(i, [float(x) for x in v[i]], int(label[i])) for i in range(600)], "sample_key long, vec array<double>, cluster_id int")
    some = cluster_distance_sums(pts, block_rows=100, nearest_only=True).collect()
    every = {(r.sample_key, r.other_cluster): r for r in cluster_distance_sums(pts, block_rows=100).collect()}
    n = int((label >= 0).sum())
    assert len(every) == n * 60 and len(some) < n * 30
    for r in some:
        assert r.n_other == every[r.sample_key, r.other_cluster].n_other and abs(r.dist_sum - every[r.sample_key, r.other_cluster].dist_sum) < 1e-8
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    got = {r.sample_key: r.silhouette for r in silhouette_values(pts, block_rows=100).collect()}
    assert len(got) == n
    for i in np.flatnonzero(label >= 0):
        means = {c: d[i, (label == c) & (np.arange(600) != i)].mean() for c in range(60) if ((label == c) & (np.arange(600) != i)).any()}
        b = min(m for c, m in means.items() if c != label[i])
        a = means.get(label[i])
        assert abs(got[i] - (0.0 if a is None else (b - a) / max(a, b))) < 1e-9


def test_packed_rows_and_both_ways_of_adding_up(spark, monkeypatch):
    from lineagelab.operators import kmeans
    x = np.random.default_rng(5).normal(size=(5000, 3)) + 1e3
    pts, d = kmeans.packed(spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "sample_key long, pca array<double>").repartition(3), "pca")
    assert d == 3 and sum(r.n for r in pts.collect()) == 5000 and max(r.n for r in pts.collect()) <= kmeans._CHUNK
    assert abs(kmeans._mean_variance(pts, 3) - x.var(axis=0).mean()) < 1e-9
    start = np.stack([x[:4], x[4:8]])
    one = kmeans.lloyd(pts, start, 5)
    monkeypatch.setattr(kmeans, "_DIRECT", 0)
    other = kmeans.lloyd(pts, start, 5)
    assert np.allclose(one[0], other[0], rtol=0, atol=1e-9) and np.allclose(one[1], other[1]) and one[2] == other[2]
    near = ((x[:, None] - one[0][0][None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert abs(near - one[1][0]) < 1e-3
