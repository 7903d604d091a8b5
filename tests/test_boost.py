"""Boosted trees against a plain booster, and the sizes the training queries run at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwarden.constants import FEATURES
from ringwarden.operators import boost, learn
from ringwarden.plans import rings_and_models as plans

NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 40, 400), rng.integers(0, 9, 400), rng.normal(size=400).round(2)]).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] / 8 - 3 + x[:, 2] * (x[:, 1] > 4))))).astype(int)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, drawn):
    x, y = drawn
    made = [(f"a{i}", int(y[i]), 3.0 if y[i] else 1.0, bool(i % 4 == 0), *map(float, x[i])) for i in range(len(y))]
    ddl = "account_id string, label int, weight double, held boolean, a double, b double, c double"
    return spark.createDataFrame(made, ddl).cache()


@pytest.fixture(scope="module")
def labelled(spark):
    made = [(f"a{i:04d}", int(i % 10 == 0), "train" if i % 3 else "test", *[float((i * (j + 3)) % 17) + (4.0 if i % 10 == 0 and j < 3 else 0.0) for j in range(22)]) for i in range(300)]
    return spark.createDataFrame(made, "account_id string, label int, split string, " + ", ".join(f"{c} double" for c in FEATURES)).cache()


def plain(x, y, w, trees, depth, leaves, rate, min_rows, l2):
    """Splits the leaf of the highest gain, one after another, trying every border."""
    margin = np.zeros(len(y))

    def split(rows):
        best = (1e-6, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + l2)
        for f in range(x.shape[1]):
            for v in np.unique(x[rows, f])[:-1]:
                low, high = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                if min(len(low), len(high)) >= min_rows:
                    won = g[low].sum() ** 2 / (h[low].sum() + l2) + g[high].sum() ** 2 / (h[high].sum() + l2) - whole
                    best = max(best, (won, (low, high)), key=lambda b: b[0])
        return best

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        grown = [(*split(np.arange(len(y))), np.arange(len(y)), 0)]
        while len(grown) < leaves:
            at = max((i for i, leaf in enumerate(grown) if leaf[1] and leaf[3] < depth), key=lambda i: grown[i][0], default=None)
            if at is None:
                break
            _, parts, _, level = grown.pop(at)
            grown += [(*split(part), part, level + 1) for part in parts]
        for _, _, part, _ in grown:
            margin[part] -= rate * g[part].sum() / (h[part].sum() + l2)
    return 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("depth, leaves", [(4, 6), (3, None)])
def test_trees_are_those_of_a_plain_booster(drawn, rows, depth, leaves):
    x, y = drawn
    size = {"trees": 4, "depth": depth, "min_rows": 7, "l2": 0.5}
    model = boost.fit(rows, NAMES, label="label", leaves=leaves, learning_rate=0.3, subsample=1.0, **size)
    got = np.array([r.probability for r in model.transform(rows).orderBy(F.substring("account_id", 2, 9).cast("int")).collect()])
    assert got == pytest.approx(plain(x, y, np.where(y, 3.0, 1.0), rate=0.3, leaves=leaves or 999, **size), abs=1e-6)
    splits = [(t["feature"] >= 0).sum() for t in model.trees]
    assert max(splits) == 5 if leaves else 5 < max(splits) <= 7


def test_dealt_rows_give_the_same_trees(rows, monkeypatch):
    size = {"label": "label", "held": "held", "trees": 30, "depth": 4, "leaves": 9, "learning_rate": 0.3, "subsample": 0.8, "min_rows": 5, "l2": 0.0, "patience": 3}
    whole = boost.fit(rows, NAMES, **size)
    monkeypatch.setattr(boost, "BLOCK_ROWS", 100)
    monkeypatch.setattr(boost, "FLAT_SUM", 2)
    dealt = boost.fit(rows.repartition(7), NAMES, **size)
    assert len(whole.trees) == len(dealt.trees)
    assert all((a[k] == b[k]).all() for a, b in zip(whole.trees, dealt.trees) for k in ("feature", "cut", "left", "value"))


def test_fit_ends_after_so_many_trees_without_a_lower_loss(rows):
    size = {"label": "label", "held": "held", "trees": 60, "depth": 3, "learning_rate": 0.3, "subsample": 1.0, "min_rows": 2, "l2": 0.0}
    held = rows.where("held")

    def loss(model):
        p = F.col("probability")
        return model.transform(held).agg(F.avg(-F.log(F.when(F.col("label") == 1, p).otherwise(1 - p)))).first()[0]

    model, whole = boost.fit(rows, NAMES, patience=5, **size), boost.fit(rows, NAMES, **size)
    n = len(model.trees)
    assert 1 <= n < 55 and len(whole.trees) == 60
    losses = [loss(boost.BoostedTrees(NAMES, whole.cuts, whole.trees[:k])) for k in range(n, n + 6)]
    assert min(losses) == losses[0]


def test_common_and_many_values_are_cut_apart(spark):
    made = spark.createDataFrame([(0.0, float(i)) for i in range(90)] + [(float(i), 90.0) for i in range(1, 11)], "few double, many double")
    few, many = boost.cut_points(made, ["few", "many"], 11)
    assert list(few) == [i + 0.5 for i in range(10)]
    counts = np.bincount(np.searchsorted(many, [r.many for r in made.collect()]))
    assert len(counts) == 11 and counts.max() <= 19


def test_what_cannot_be_trained_on_is_an_error(spark, rows):
    size = {"label": "label", "trees": 1, "depth": 2, "learning_rate": 0.3, "subsample": 1.0, "min_rows": 2, "l2": 0.0}
    with pytest.raises(ValueError):
        boost.fit(rows.limit(0), NAMES, **size)
    for broken in (rows.withColumn("b", F.when(F.col("b") > 3, F.col("b"))), rows.withColumn("label", F.lit(2))):
        with pytest.raises(Exception, match="null|must be 0 or 1"):
            boost.fit(broken, NAMES, **size)
    alike = spark.createDataFrame([(1, 1.0, 2.0), (0, 1.0, 2.0)] * 20, "label int, weight double, a double")
    model = boost.fit(alike, ["a"], **size)
    assert {r.probability for r in model.transform(alike).collect()} == {0.5} and model.importances().sum() == 0


def _run(monkeypatch, labelled, name):
    """Rows of a query and, for every model it fits, (trees, their depths, what was asked of the fit)."""
    sizes, fit = [], boost.fit

    def seen(*args, **kw):
        model = fit(*args, **kw)
        sizes.append((len(model.trees), {t["depth"] for t in model.trees}, kw))
        return model

    monkeypatch.setattr(plans, "labelled_matrix", lambda spark, folder: labelled)
    monkeypatch.setattr(boost, "fit", seen)
    return getattr(plans, name)(labelled.sparkSession, "").collect(), sizes


def test_importances_are_of_all_500_trees(monkeypatch, labelled):
    """five trees of depth 5 before."""
    got, [(trees, _, asked)] = _run(monkeypatch, labelled, "feature_importance_topn")
    assert (trees, asked["depth"], len(got)) == (500, 7, 20)


def test_the_stack_has_all_500_trees(monkeypatch, labelled):
    """ten trees before."""
    got, [(trees, _, asked)] = _run(monkeypatch, labelled, "hybrid_stack")
    assert (trees, asked["depth"], len(got)) == (500, 7, 100)


def test_boosting_makes_all_500_trees(monkeypatch, labelled):
    """ten trees of depth 5 before."""
    got, [(trees, _, asked)] = _run(monkeypatch, labelled, "train_gbt")
    assert (trees, asked["depth"], len(got)) == (500, 7, 100)


def test_leafwise_trees_go_on_until_the_loss_stays(monkeypatch, labelled):
    """ten trees of depth 5, grown by levels, before."""
    got, [(trees, _, asked)] = _run(monkeypatch, labelled, "train_gbt_leafwise")
    assert {k: asked[k] for k in ("trees", "depth", "leaves", "patience")} == {"trees": 600, "depth": 7, "leaves": 63, "patience": 30}
    assert 10 < trees <= 600 and len(got) == 100
