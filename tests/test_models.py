import math
import random

import pytest
from pyspark.sql import functions as F

from ringwarden.constants import FEATURES
from ringwarden.operators import audit, calibration, drift, learn, metrics, propagate, snapshots


@pytest.fixture(scope="module")
def eight(spark):
    y, p = [1, 0, 1, 0, 0, 1, 0, 0], [0.9, 0.8, 0.7, 0.7, 0.4, 0.35, 0.2, 0.1]
    return spark.createDataFrame([(i, a, b, 10.0) for i, (a, b) in enumerate(zip(y, p))], "id long, y_true int, y_prob double, amount double").cache()


def test_ranking_metrics(eight):
    assert metrics.average_precision(eight).first()[0] == pytest.approx(0.666667, abs=1e-6)
    assert metrics.roc_auc(eight).first()[0] == pytest.approx(0.7)
    assert calibration.brier_score(eight).first()[0] == pytest.approx(0.232813, abs=1e-6)
    assert calibration.ece(eight).first()[0] == pytest.approx(0.331250, abs=1e-6)
    assert metrics.recall_at_fpr(eight, 0.0).first()[0] == pytest.approx(1 / 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_metrics_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, int(rng.random() < 0.3), round(rng.random(), 2), 1.0) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, y_true int, y_prob double, amount double")
    pos = [p for _, y, p, _ in rows if y]
    neg = [p for _, y, p, _ in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    ap, caught = 0.0, 0
    for t in sorted({p for _, _, p, _ in rows}, reverse=True):
        tp = sum(p >= t for p in pos)
        ap += (tp - caught) / len(pos) * tp / (tp + sum(p >= t for p in neg))
        caught = tp
    row = metrics.evaluate_model(df, k_values=(10,)).first()
    assert (row.pr_auc, row.roc_auc) == pytest.approx((ap, auc))


def test_grid_steps_are_exact(spark):
    points = metrics.F1_GRID
    values = points + [p - 1e-12 for p in points] + [0.0, 1.0, 0.005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", metrics.steps_reached(F.col("v"), points).alias("n")).collect()
    assert all(r.n == sum(p <= r.v for p in points) for r in got)


def test_threshold_tables(eight):
    counts = metrics.confusion_matrix(eight, 0.42).first()
    assert tuple(counts) == (2, 2, 1, 3)
    best = metrics.best_f1_threshold(eight).first()
    scan = {}
    for t in metrics.F1_GRID:
        rows = eight.collect() if not scan else scan["rows"]
        scan["rows"] = rows
        tp = sum(r.y_prob >= t and r.y_true == 1 for r in rows)
        fp = sum(r.y_prob >= t and r.y_true == 0 for r in rows)
        f1 = 2 * tp / (2 * tp + fp + 3 - tp) if tp else 0.0
        if f1 > scan.get("f1", -1):
            scan["f1"], scan["t"] = f1, t
    assert (best.threshold, best.f1) == pytest.approx((scan["t"], scan["f1"]))
    assert metrics.cost_curve(eight).count() == 80


def test_top_k_skips_large_k(eight):
    got = {r.k: (r.precision_at_k, r.recall_at_k) for r in metrics.precision_recall_at_k(eight, (1, 4, 100)).collect()}
    assert set(got) == {1, 4}
    assert got[4] == pytest.approx((0.5, 2 / (3 + 1e-6)))


def test_published_cost_table(spark):
    rows = [("Logistic Regression", 0.7485, 0.010), ("XGBoost", 0.8343, 0.920), ("GCN", 0.0, 0.0), ("Hybrid", 0.8607, 0.750)]
    df = spark.createDataFrame(rows, "model string, recall double, precision_at_100 double")
    summary = metrics.batch_cost_summary(df)
    got = {r.model: r.total_expected_cost for r in summary.collect()}
    assert got["Logistic Regression"] == pytest.approx(474369.0)
    assert got["XGBoost"] == pytest.approx(91172.2, abs=0.05)
    assert got["GCN"] == pytest.approx(546000.0)
    assert got["Hybrid"] == pytest.approx(77107.8, abs=0.05)
    saved = {r.model: r.savings for r in metrics.cost_savings(summary, "Logistic Regression").collect()}
    assert saved["Logistic Regression"] == 0.0 and saved["GCN"] < 0


def test_psi(spark):
    ref = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    cur = spark.createDataFrame([(float(i),) for i in (1, 1, 2, 2, 3, 3, 4, 4, 5, 10)], "v double")
    assert drift.psi_single(ref, cur, "v").first()[0] == pytest.approx(3.040561, abs=1e-6)
    assert drift.psi_single(ref, ref, "v").first()[0] == pytest.approx(0.0)
    constant = ref.withColumn("v", F.lit(4.0))
    assert drift.psi_single(constant, constant, "v").first()[0] == pytest.approx(0.0)
    report = drift.drift_report(ref.withColumn("w", F.lit(1.0)), cur.withColumn("w", F.lit(1.0)), score="w", features=["v"])
    assert {r.feature: (r.status, r.has_drift) for r in report.collect()} == {"w": ("STABLE", True), "v": ("DRIFTED", True)}


@pytest.fixture(scope="module")
def noisy(spark):
    rows = [(i, int((i * 7919) % 1000 < 10 * (i % 100)), round((i % 100) ** 2 / 10_000 + 0.001, 6)) for i in range(2000)]
    return spark.createDataFrame(rows, "id long, y_true int, y_prob double").cache()


def plain_isotonic(rows):
    """Mean label of each score's block: the largest, over the starts before it, of the smallest mean of a stretch that holds it."""
    points = {}
    for x, y in rows:
        n, pos = points.get(x, (0, 0))
        points[x] = (n + 1, pos + y)
    xs = sorted(points)
    mean = lambda j, k: sum(points[x][1] for x in xs[j : k + 1]) / sum(points[x][0] for x in xs[j : k + 1])
    return {x: max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("together", [2, 16])
def test_isotonic_is_exact(spark, monkeypatch, together):
    monkeypatch.setattr(calibration, "SLICES_TOGETHER", together)
    rng = random.Random(together)
    rows = [(rng.randrange(60) / 60 + 1e-9 * rng.randrange(2), int(rng.random() < 0.5)) for _ in range(400)]
    rows += [(0.25, 1)] * 200  # a score with a third of all rows
    frame = spark.createDataFrame([(k, y, x) for k, (x, y) in enumerate(rows)], "id long, y_true int, y_prob double")
    want = plain_isotonic(rows)
    got = calibration.isotonic_calibrator(frame)(frame).select("y_prob", "y_cal").distinct().collect()
    assert {r.y_prob: r.y_cal for r in got} == pytest.approx(want)
    blocks = calibration.isotonic_blocks(frame).orderBy("lo").collect()
    assert sum(b.n for b in blocks) == len(rows) and all(a.pos * b.n < b.pos * a.n for a, b in zip(blocks, blocks[1:]))


def test_isotonic_between_and_outside(spark, monkeypatch):
    fit = spark.createDataFrame([(1, 0, 0.2), (2, 0, 0.4), (3, 1, 0.6), (4, 0, None), (5, 1, float("nan")), (6, None, 0.9)], "id long, y_true int, y_prob double")
    asked = spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 0.2, 0.3, 0.45, 0.5, 0.6, 1.0, None, float("nan"), 0.5])], "id long, y_prob double")
    want = [0.0, 0.0, 0.0, 0.25, 0.5, 1.0, 1.0, None, None, 0.5]
    for blocks in (calibration.BROADCAST_BLOCKS, 0):
        monkeypatch.setattr(calibration, "BROADCAST_BLOCKS", blocks)
        got = calibration.isotonic_calibrator(fit)(asked).orderBy("id").collect()
        assert [None if r.y_cal is None else round(r.y_cal, 9) for r in got] == want
    nothing = calibration.isotonic_calibrator(fit.limit(0))(asked)
    assert nothing.columns == ["id", "y_prob", "y_cal"] and nothing.where("y_cal is not null").count() == 0


def test_platt_has_no_gradient_left(noisy):
    a, b = calibration.fit_platt(noisy)
    rows = [(r.y_prob, r.y_true) for r in noisy.collect()]
    p = [1 / (1 + math.exp(-(a * x + b))) for x, _ in rows]
    assert sum((q - y) * x for q, (x, y) in zip(p, rows)) + a == pytest.approx(0, abs=1e-6)
    assert sum(q - y for q, (_, y) in zip(p, rows)) == pytest.approx(0, abs=1e-6)
    assert calibration.fit_platt(noisy.limit(0)) == (0.0, 0.0)


def test_halves_hold_both_labels(noisy):
    counts = {(r.y_true, r.part): r["count"] for r in calibration.stratified_halves(noisy).groupBy("y_true", "part").count().collect()}
    for label in (0, 1):
        assert 0 <= counts[label, "fit"] - counts[label, "test"] <= 1


def test_calibrators(noisy):
    iso = calibration.isotonic_calibrator(noisy)(noisy).select("y_prob", "y_cal").distinct().orderBy("y_prob").collect()
    values = [r.y_cal for r in iso]
    assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1
    table = {r.method: r for r in calibration.calibration_compare(noisy, noisy).collect()}
    assert set(table) == {"Uncalibrated", "Platt", "Temperature", "Isotonic"}
    assert table["Isotonic"].ece < table["Uncalibrated"].ece
    assert all(0 <= r.ece <= 1 for r in table.values())
    lift = calibration.calibration_lift(noisy, noisy).first()
    assert lift.ece_reduction_pct > 0 and lift.bayes_optimal_threshold == pytest.approx(0.008264)


def test_temperature_is_the_minimum(noisy):
    t = calibration.fit_temperature(noisy)
    rows = [(r.y_true, math.log(r.y_prob / (1 - r.y_prob))) for r in noisy.collect()]

    def loss(temp):
        return -sum(math.log(1 / (1 + math.exp(-z / temp))) if y else math.log(1 - 1 / (1 + math.exp(-z / temp))) for y, z in rows)

    assert loss(t) <= loss(t * 1.001) and loss(t) <= loss(t * 0.999)


# --- propagation ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def cycle(spark):
    nodes = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [4.0])], "id long, vec array<double>")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    return nodes, edges


def vectors_of(df, name="vec"):
    return {r.id: r[name] for r in df.collect()}


def test_chebyshev(cycle, spark):
    nodes, edges = cycle
    assert vectors_of(propagate.chebyshev_filter(nodes, edges, dim=1)) == {0: [0.0], 1: [7.0], 2: [0.0]}
    none = spark.createDataFrame([], edges.schema)
    assert vectors_of(propagate.chebyshev_filter(nodes, none, dim=1)) == {0: [0.0], 1: [0.0], 2: [0.0]}
    given = propagate.chebyshev_filter(nodes, edges, dim=1, weights=[[[1.0]], [[0.0]], [[0.0]]], bias=[0.5])
    assert vectors_of(given) == {0: [1.5], 1: [2.5], 2: [4.5]}


def test_mean_gcn_and_attention(cycle):
    nodes, edges = cycle
    assert vectors_of(propagate.sage_mean_propagate(nodes, edges, dim=1), "neighbor_mean") == {0: [4.0], 1: [1.0], 2: [2.0]}
    got = vectors_of(propagate.gcn_propagate(nodes, edges, dim=1))
    assert {k: v[0] for k, v in got.items()} == pytest.approx({0: 2.5, 1: 1.5, 2: 3.0})
    weights = propagate.attention_weights(nodes, edges, score=propagate.attention_score([1.0]))
    sums = {r.dst: r.s for r in weights.groupBy("dst").agg(F.sum("alpha").alias("s")).collect()}
    assert sums == pytest.approx({0: 1.0, 1: 1.0, 2: 1.0})


def test_filter_fallback_keeps_at_least_one(cycle):
    nodes, edges = cycle
    assert propagate.similarity_edge_filter(nodes, edges, threshold=0.45).count() == 3
    assert propagate.similarity_edge_filter(nodes, edges, threshold=2.0).count() == 1
    assert propagate.policy_edge_filter(nodes, edges, weights=[0.0] * 16, bias=-5.0).count() == 1
    assert vectors_of(propagate.care_aggregate(nodes, edges, dim=1))[0] == [1.0, 4.0]


def test_balanced_sample_counts(spark):
    edges = spark.createDataFrame([(i, i % 10) for i in range(100)], "src long, dst long")
    labels = spark.createDataFrame([(i, int(i == 0)) for i in range(10)], "id long, label int")
    got = propagate.balanced_edge_sample(edges, labels, fraud_ratio=2.0, clean_ratio=0.5)
    assert {r.into_fraud: r["count"] for r in got.groupBy("into_fraud").count().collect()} == {True: 20, False: 45}


def test_infonce(spark):
    rows = [(1, [1.0, 0.0], [1.0, 0.0], True), (1, [1.0, 0.0], [0.0, 1.0], False)]
    df = spark.createDataFrame(rows, "anchor_id long, anchor array<double>, other array<double>, is_positive boolean")
    assert propagate.infonce_loss(df, temperature=1.0).first()[0] == pytest.approx(math.log(math.e + 1) - 1)


# --- training ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(f"a{i:04d}", int(i % 10 == 0), *[float((i * (j + 3)) % 17) + (4.0 if i % 10 == 0 and j < 3 else 0.0) for j in range(22)]) for i in range(600)]
    ddl = "account_id string, label int, " + ", ".join(f"{c} double" for c in FEATURES)
    return spark.createDataFrame(rows, ddl).cache()


def test_logistic_beats_chance(labelled):
    scored = learn.predict(learn.train_logistic(labelled), labelled)
    assert metrics.roc_auc(scored).first()[0] > 0.8


def test_class_weights(labelled):
    w = learn.class_weights(labelled).first()
    assert (w.pos, w.neg, w.scale_pos_weight, w.weight_pos) == (60, 540, 9.0, 5.0)


def test_boosted_trees(labelled):
    model = learn.train_gbt(labelled, trees=3, depth=3)
    assert learn.predict(model, labelled).count() == 600
    assert learn.feature_importances(model, FEATURES, labelled.sparkSession).count() == 20
    early = learn.train_gbt_leafwise(labelled, labelled, trees=3, depth=3)
    assert learn.predict(early, labelled).count() == 600


def test_shards_and_averaging(labelled):
    shards = learn.shard_stratified(labelled, id_column="account_id", label="label").cache()
    got = shards.groupBy("shard", "label").count().collect()
    assert {(r.shard, r.label): r["count"] for r in got} == {(s, y): (20 if y else 180) for s in range(3) for y in (0, 1)}
    weights = learn.federated_average(shards, features=FEATURES[:3], rounds=8)
    assert len(weights) == 4 and all(w > 0 for w in weights[:3])


def test_cascade_needs_both_stages(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.1), ("d", 0.9)], "account_id string, s double")
    near = spark.createDataFrame([("a", 0.9), ("b", 0.2), ("c", 0.9)], "account_id string, score double")
    got = learn.two_stage_cascade(df, near, stage1=F.col("s"), stage1_threshold=0.5, stage2_threshold=0.5)
    assert {r.account_id: r.is_alert for r in got.collect()} == {"a": True, "b": False, "d": False}


# --- snapshots and audit ------------------------------------------------------------------


def test_snapshot_ttl(spark):
    new = spark.createDataFrame([("a", 1_000_000, 0.1), ("a", 2_000_000, 0.7), ("b", 1_000_000, 0.3)], "k string, at long, v double")
    snap = snapshots.snapshot_upsert(None, new, key="k", written_us="at", value="v", ttl_sec=10)
    assert {r.k: (r.v, r.expire_us) for r in snap.collect()} == {"a": (0.7, 12_000_000), "b": (0.3, 11_000_000)}
    asks = spark.createDataFrame([("a", 11_999_999), ("a", 12_000_000), ("z", 0)], "k string, now long")
    got = snapshots.lookup_ttl(asks, snap, key="k", value="v", now_us=F.col("now"))
    assert {(r.k, r.now): r.v for r in got.collect()} == {("a", 11_999_999): 0.7, ("a", 12_000_000): None, ("z", 0): None}
    forever = snapshots.snapshot_upsert(None, new, key="k", written_us="at", value="v", ttl_sec=0)
    assert snapshots.lookup_ttl(asks, forever, key="k", value="v", now_us=F.col("now")).where("cache_hit").count() == 2


def test_audit_round_trip(spark, tmp_path):
    ddl = "account_id string, decision string, analyst_id string, risk_score double, notes string, action_taken string, requested_at timestamp"
    import datetime as dt

    rows = [("a", "CONFIRMED_FLAG", "x", 0.9, None, "Hold", dt.datetime(2024, 1, 1, 10)), ("b", "OVERRIDDEN_CLEAN", "y", 0.2, "ok", "None", dt.datetime(2024, 1, 2, 10))]
    records = audit.audit_records(spark.createDataFrame(rows, ddl))
    audit.audit_append(records.limit(1), str(tmp_path / "log"))
    for _ in range(2):  # the second run finds all of it there
        audit.audit_append(records.union(records), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    listed = audit.audit_list(spark.read.parquet(str(tmp_path / "log"))).collect()
    assert [r.account_id for r in listed] == ["b", "a"] and listed[0].total_records == 2
    assert listed[1].notes == "No note was left by the analyst."
    audit.audit_export_csv(records, str(tmp_path / "csv"))
    header = next(p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv").read_text().splitlines()[0]
    assert header == "audit_id,account_id,decision,analyst_id,risk_score,action_taken,notes,timestamp"


def test_ablation_fits_run_side_by_side(spark, monkeypatch):
    import threading

    at_once, both, train = set(), threading.Barrier(2, timeout=120), learn.train_logistic

    def watched(*args, **kw):
        at_once.add(threading.get_ident())
        both.wait()
        return train(*args, **kw)

    monkeypatch.setattr(learn, "train_logistic", watched)
    made = spark.createDataFrame([(f"a{i:03d}", float(i % 7), float((i * 5) % 11), int(i % 7 > 3)) for i in range(120)], "account_id string, x double, y double, label int")
    got = learn.ablation_subsets(made, made, {"one": ("x",), "two": ("x", "y")})
    assert [(r.model, r.n_features) for r in got.collect()] == [("one", 1), ("two", 2)]
    assert len(at_once) == 2


def test_stress_edges_are_dealt_to_levels_as_sums(spark):
    scores = spark.createDataFrame([("f", 0.9), ("a", 0.1), ("b", 0.2)], "id string, y_prob double")
    edges = spark.createDataFrame([("f", "a"), ("a", "b"), ("a", "b")], "src string, dst string")
    decoys = spark.createDataFrame([(2, "f", 1, "b"), (2, "f", 2, "b")], "k int, src string, copy int, dst string")
    got = learn.stress_curve(scores.where("id = 'f'"), scores.where("id <> 'f'"), edges, scores, decoys, k_values=(0, 2), threshold=0.4)
    rows = {r.k: r for r in got.collect()}
    assert rows[0].mean_fraud_score == pytest.approx(0.5) and rows[2].mean_fraud_score == pytest.approx(0.35)
    assert (rows[0].recall, rows[0].precision, rows[2].recall, rows[2].precision) == (1.0, 1.0, 0.0, None)
    # the edges meet the scores once, not once for each level
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode") < plan.index("Join Inner, (dst")


def test_training_rows_are_computed_once(spark, labelled, monkeypatch):
    """the joined rows are written before the fit reads them."""
    written, cut = [], learn.cut_lineage
    monkeypatch.setattr(learn, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    rows = labelled.withColumn("split", F.when(F.col("account_id") < "a0400", "train").otherwise("test"))
    score = labelled.select(F.col("account_id").alias("id"), (F.col(FEATURES[0]) / 30).alias("y_prob"))
    assert learn.hybrid_stack(rows, score, trees=2).count() == 200
    edges = spark.createDataFrame([("a0000", "a0001"), ("a0401", "a0001")], "src string, dst string")
    assert learn.propagated_classifier(rows, edges).count() == 200
    assert len(written) == 2


def test_stress_curve_ranks_every_level(spark):
    """there was no PR-AUC before."""
    own = {"f": 0.9, "g": 0.3, "a": 0.1, "b": 0.5, "c": 0.5}
    base, more = [("f", "a"), ("g", "b"), ("b", "c")], {0: [], 2: [("f", "a"), ("f", "c"), ("g", "a"), ("g", "a")]}
    scores = spark.createDataFrame(list(own.items()), "id string, y_prob double")
    decoys = spark.createDataFrame([(k, s, i, d) for k, pairs in more.items() for i, (s, d) in enumerate(pairs)], "k int, src string, copy int, dst string")
    fraud, clean = scores.where("id IN ('f', 'g')"), scores.where("id NOT IN ('f', 'g')")
    got = learn.stress_curve(fraud, clean, spark.createDataFrame(base, "src string, dst string"), scores, decoys, k_values=(0, 2), threshold=0.4)
    for row in got.collect():
        reached = {n: [own[n], *[own[d] for s, d in base + more[row.k] if s == n]] for n in own}
        mean = {n: round(sum(v) / len(v), 12) for n, v in reached.items()}
        area = 0.0
        for n in "fg":
            above = [m for m in own if mean[m] >= mean[n]]
            area += len([m for m in above if m in "fg"]) / len(above) / 2
        assert row.pr_auc == pytest.approx(area)
