import math

import pytest
from pyspark.sql import functions as F

from ringwarden.constants import FEATURES, TABULAR_FEATURES
from ringwarden.operators import features, graph, ordered, temporal
from ringwarden.operators.ordered import Ascending, Descending


def test_tabular_values(txn6):
    want = {
        "C001": [8.0067, 7.3139, 2, 1, 2, 1, 7.3139, 7.3139, 0.35, 1, 1],
        "C002": [6.2166, 7.4961, 1, 2, 1, 2, 6.2166, 6.8035, 0.5, 1, 0],
        "C003": [8.0067, 7.6014, 1, 1, 1, 1, 8.0067, 7.6014, 0.5, 1, 1],
        "C004": [7.3139, 6.2166, 1, 1, 1, 1, 7.3139, 6.2166, 0.5, 1, 1],
        "C005": [6.6859, 8.0067, 1, 1, 1, 1, 6.6859, 8.0067, 0.4, 1, 1],
    }
    got = {r.account_id: [r[c] for c in TABULAR_FEATURES] for r in features.tabular_features(txn6).collect()}
    assert set(got) == set(want)
    for account, values in want.items():
        assert got[account] == pytest.approx(values, abs=1e-4)


def test_temporal_values(txn10):
    row = {r.account_id: r for r in features.temporal_features(txn10).collect()}["C000"]
    assert row.tx_velocity_24h == 4
    assert row.amount_velocity_24h == pytest.approx(9.998843, abs=1e-6)
    assert row.amount_spike_ratio == pytest.approx(0.9999999, abs=1e-7)


def test_feature_matrix_has_22_zero_filled_columns(txn6):
    edges = graph.edge_collapse(features.fraud_type_filter(txn6))
    nodes = graph.edge_nodes(edges).withColumnRenamed("id", "account_id")
    full = features.feature_matrix(nodes, features.tabular_features(txn6), graph.structural_features(edges), features.temporal_features(txn6))
    rows = full.collect()
    assert full.columns == ["account_id", *FEATURES] and len(rows) == 5
    assert all(value is not None and not math.isnan(value) for row in rows for value in row[1:])
    assert all(r.tx_velocity_7d >= r.tx_velocity_24h for r in rows)


def test_min_tx_filter_is_off_by_default(txn6):
    assert features.active_accounts_only(txn6).count() == 6
    assert features.active_accounts_only(txn6, 2).count() == 2


def test_future_rows_change_no_train_feature(txn100):
    cutoff = 7

    def build(df):
        known = features.snapshot(df, cutoff)
        edges = graph.edge_collapse(known)
        nodes = graph.edge_nodes(edges).withColumnRenamed("id", "account_id")
        full = features.feature_matrix(
            nodes, features.tabular_features(known), graph.structural_features(edges), features.temporal_features(known)
        )
        return full.select("account_id", *[F.round(c, 9).alias(c) for c in FEATURES])

    before, after = build(txn100.where(F.col("step") <= cutoff)), build(txn100)
    assert features.changed_features(before, after).count() == 0
    leaky = features.temporal_features(txn100)
    assert features.changed_features(features.temporal_features(features.snapshot(txn100, cutoff)), leaky).count() > 0


def test_guard_reports_a_planted_leak(txn100):
    clean = features.account_pairs(features.snapshot(txn100, 7))
    assert features.leakage_guard(clean, txn100, 7, FEATURES).first()["is_clean"]
    only_later = features.exclusive_test_edges(txn100, 7)
    assert only_later.count() > 0
    leaky = clean.union(only_later.limit(1))
    row = features.leakage_guard(leaky, txn100, 7, [*FEATURES, "isFraud"]).first()
    assert (row.leaked_edges, row.label_columns, row.is_clean) == (1, 1, False)


def test_hour_of_day_option(spark):
    from conftest import transactions

    df = transactions(spark, [(30, "TRANSFER", 10, "A", 100, 90, "B", 0)])
    assert features.out_account_features(df).first()["night_tx_fraction"] == 0.0
    assert features.out_account_features(df, hour_of_day=True).first()["night_tx_fraction"] == 1.0


# --- sliced windows -------------------------------------------------------------------


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_totals_equal_a_window(spark, keys):
    rows = [("hot" if i % 3 else f"k{i % 7}", (i * 37) % 211, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, v long")
    got = ordered.running_totals(
        df, keys=keys, order=[Ascending("t"), Ascending("v")], sums={"total": "v"}, lasts={"prev": "t"}, slices=7, exclude_current=True
    )
    want = []
    for k, t, v in rows:
        before = [r for r in rows if (not keys or r[0] == k) and (r[1], r[2]) < (t, v)]
        want.append((k, t, v, sum(r[2] for r in before), max(before, key=lambda r: (r[1], r[2]))[1] if before else None))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_running_totals_descending(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(50)], "p double, n long")
    got = ordered.running_totals(df, order=[Descending("p")], sums={"seen": "n"}, slices=5)
    assert {r.p: r.seen for r in got.collect()} == {float(i): 50 - i for i in range(50)}


def test_linear_quantiles(spark):
    values = [((i * 7919) % 1000) / 7.0 for i in range(501)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = df.selectExpr("percentile(v, 0.37) a", "percentile(v, 0.99) b").first()
    got = ordered.linear_quantiles(df, "v", {"a": 0.37, "b": 0.99}).first()
    assert (got.a, got.b) == pytest.approx((want.a, want.b))


@pytest.fixture(scope="module")
def feed(spark):
    rows = []
    for i in range(300):
        user = 1 if i % 3 == 0 else i % 11
        rows.append((i, user, (i * 7919) % 100_000 * 1_000_000, (i * 31 % 97) / 4))
    rows += [(300 + i, 1, 50_000 * 1_000_000, 2.5) for i in range(5)]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts_us long, value double").cache()


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)


def test_hot_key_velocity_equals_the_window(feed):
    cold = temporal.multi_velocity(feed, key="user_id", ts_us="ts_us")
    hot = temporal.multi_velocity(feed, key="user_id", ts_us="ts_us", hot_limit=40)
    same(cold, hot)
    same(
        temporal.rolling_velocity(feed, key="user_id", ts_us="ts_us", amount="value", window_sec=3600),
        temporal.rolling_velocity(feed, key="user_id", ts_us="ts_us", amount="value", window_sec=3600, hot_limit=1),
    )


def test_velocity_is_open_on_the_left(spark):
    df = spark.createDataFrame([(1, 1, 0, 1.0), (2, 1, 86_400_000_000, 2.0), (3, 1, 86_399_999_999, 4.0)], "event_id long, user_id long, ts_us long, value double")
    for limit in (10, 1):
        got = temporal.rolling_velocity(df, key="user_id", ts_us="ts_us", amount="value", hot_limit=limit)
        assert {r.event_id: (r.tx_velocity, float(r.amount_velocity)) for r in got.collect()} == {1: (1, 1.0), 2: (2, 6.0), 3: (2, 5.0)}


def test_dedupe_same_amount(spark):
    df = spark.createDataFrame([(1, 1, 5, 1.0), (2, 1, 5, 1.0), (3, 1, 5, 2.0)], "event_id long, user_id long, ts_us long, value double")
    got = temporal.rolling_velocity(df, key="user_id", ts_us="ts_us", amount="value", dedupe_same_amount=True)
    assert [r.tx_velocity for r in got.collect()] == [2, 2]


def test_hot_key_gap_asof_and_sessions(feed):
    same(
        temporal.delta_t_from_prev(feed, key="user_id", ts_us="ts_us", tie="event_id"),
        temporal.delta_t_from_prev(feed, key="user_id", ts_us="ts_us", tie="event_id", hot_limit=1),
    )
    scores = feed.where("event_id % 5 = 0").select(F.col("user_id").alias("a"), F.col("ts_us").alias("w"), F.col("value").alias("s"))
    options = dict(key="user_id", event_id="event_id", event_us="ts_us", score_key="a", written_us="w", score="s", ttl_sec=3000)
    same(temporal.asof_score(feed, scores, **options), temporal.asof_score(feed, scores, hot_limit=1, **options))
    same(
        temporal.session_bursts(feed, key="user_id", ts_us="ts_us", gap_sec=900, min_events=2),
        temporal.session_bursts(feed, key="user_id", ts_us="ts_us", gap_sec=900, min_events=2, hot_limit=1),
    )


def test_asof_ttl_and_never(spark):
    events = spark.createDataFrame([(1, 7, 10_000_000), (2, 7, 200_000_000), (3, 8, 5)], "event_id long, user_id long, ts_us long")
    scores = spark.createDataFrame([(7, 10_000_000, 0.5), (7, 190_000_000, 0.9)], "a long, w long, s double")
    options = dict(key="user_id", event_id="event_id", event_us="ts_us", score_key="a", written_us="w", score="s")
    got = {r.event_id: r.nearline_score for r in temporal.asof_score(events, scores, ttl_sec=10, **options).collect()}
    assert got == {1: 0.5, 2: None, 3: None}
    got = {r.event_id: r.nearline_score for r in temporal.asof_score(events, scores, ttl_sec=0, **options).collect()}
    assert got == {1: 0.5, 2: 0.9, 3: None}


def test_account_index_is_dense(txn6):
    got = {r.account_id: r.node_idx for r in features.account_index(txn6).collect()}
    assert got == {f"C00{i + 1}": i for i in range(5)}
