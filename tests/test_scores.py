import hashlib

import pytest
from pyspark.sql import functions as F

from ringwarden.constants import FEATURES
from ringwarden.functions import explain, probability, scoring, transaction, vectors
from ringwarden.functions.scoring import feature_columns
from ringwarden.operators import review

EXAMPLE = dict(
    account_id="acc_promo_8841", total_sent_log=12.5, total_received_log=10.2, tx_count_out=45.0, tx_count_in=3.0, unique_dest_count=40.0,
    unique_src_count=3.0, avg_sent_log=8.3, avg_received_log=9.1, balance_drain_ratio=0.95, night_tx_fraction=0.80, fraud_type_fraction=1.0,
    in_degree=3.0, out_degree=45.0, degree_ratio=15.0, pagerank=0.0023, k_core_number=5.0, local_clustering_coefficient=0.02,
    tx_velocity_24h=12.0, tx_velocity_7d=45.0, amount_velocity_24h=10.5, amount_velocity_7d=12.5, amount_spike_ratio=2.3,
)
CLEAN = dict(
    EXAMPLE, account_id="clean", balance_drain_ratio=0.12, degree_ratio=1.0, night_tx_fraction=0.05, local_clustering_coefficient=0.18,
    amount_spike_ratio=1.0, fraud_type_fraction=0.0, pagerank=0.0003, k_core_number=2.0, tx_velocity_24h=3.0,
)


@pytest.fixture(scope="module")
def accounts(spark):
    ddl = "account_id string, " + ", ".join(f"{c} double" for c in FEATURES)
    rows = [tuple(a[c] for c in ("account_id", *FEATURES)) for a in (EXAMPLE, CLEAN)]
    return spark.createDataFrame(rows, ddl).withColumn("p", scoring.champion_score(feature_columns())).cache()


def rows(df):
    return {r.account_id: r for r in df.collect()}


def test_champion_score(accounts):
    f = feature_columns()
    got = rows(accounts.select("account_id", "p", scoring.tabular_logit(f).alias("t"), scoring.graph_logit(f).alias("g"), scoring.risk_tier(F.col("p")).alias("tier"), scoring.is_flagged(F.col("p")).alias("flag"), scoring.ring_type(f, F.col("p")).alias("ring")))
    bad, good = got["acc_promo_8841"], got["clean"]
    assert (bad.t, bad.g, bad.p) == pytest.approx((2.72, -0.252420, 0.784695), abs=1e-6)
    assert (bad.tier, bad.flag, bad.ring) == ("HIGH", True, "Promo-Abuse Ring")
    assert good.p == pytest.approx(0.01) and (good.tier, good.flag, good.ring) == ("LOW", False, "Clean Baseline")


def test_sub_risks_and_cost(accounts):
    heads = scoring.sub_risks(feature_columns())
    bad = rows(accounts.select("account_id", *[c.alias(n) for n, c in heads.items()], scoring.expected_review_cost(scoring.is_flagged(F.col("p"))).alias("cost")))["acc_promo_8841"]
    assert list(bad)[1:5] == pytest.approx([0.9309, 0.6660, 0.6593, 0.1736])
    assert bad.cost == 350.0


def test_counterfactual(accounts):
    got = rows(review.with_counterfactual(accounts, prob="p", name="c"))
    bad = got["acc_promo_8841"].c
    assert bad.is_flagged and bad.reaches_target
    assert bad.counterfactual_probability == pytest.approx(0.3467)
    assert [(c.feature, c.current_value, c.counterfactual_value) for c in bad.changes_required] == [("balance_drain_ratio", 0.95, 0.25)]
    good = got["clean"].c
    assert not good.is_flagged and good.changes_required == []


def test_attribution_and_top(accounts):
    f = feature_columns()
    bad = rows(accounts.select("account_id", explain.attribution(f).alias("a"), explain.top_contributors(f, 4).alias("t")))["acc_promo_8841"]
    values = {e.feature: e.value for e in bad.a}
    total = 1.27
    assert values["degree_ratio"] == pytest.approx(13.8 * 0.15 / total * 0.4, abs=1e-4)
    assert [e.feature for e in bad.t] == sorted(values, key=lambda k: -abs(values[k]))[:4]


def test_briefing_text(accounts):
    f = feature_columns()
    text = explain.briefing(F.col("account_id"), F.col("p"), scoring.risk_tier(F.col("p")), f, scoring.ring_type(f, F.col("p")))
    got = rows(accounts.select("account_id", text.alias("t")))
    bad = got["acc_promo_8841"].t
    assert bad.startswith("**HIGH risk (78.5%)**: `acc_promo_8841` waits for review. It pays out")
    assert "**15.0** accounts" in bad and "**95%** leaves again at once" in bad and "**80%** of its payments" in bad
    assert "the week before" not in bad and "(clustering 0.02)" in bad
    assert bad.endswith("before anything is released.")
    assert got["clean"].t.startswith("**Low risk (") and "keeps 88% of what" in got["clean"].t


def test_action_text(accounts):
    f = feature_columns()
    action = scoring.recommended_action(F.col("p"), scoring.ring_type(f, F.col("p")))
    got = rows(accounts.select("account_id", action.alias("a")))
    assert got["acc_promo_8841"].a == "Queue for Secondary Review (Elevated Risk: 78%)"
    assert got["clean"].a == "Allow Transaction (Standard Clearance)"


def test_range_rules(accounts):
    broken = accounts.withColumn("in_degree", F.lit(-1.0)).withColumn("night_tx_fraction", F.lit(1.5)).withColumn("balance_drain_ratio", F.lit(-9.0))
    assert broken.select(scoring.violated_rules(feature_columns()).alias("v")).first().v == ["night_tx_fraction:max", "in_degree:min"]
    assert accounts.select(scoring.violated_rules(feature_columns()).alias("v")).first().v == []


def test_console_score(accounts):
    f = feature_columns()
    p = F.col("q")
    got = rows(accounts.withColumn("q", scoring.console_score(f)).select("account_id", "q", scoring.console_tier(p).alias("tier"), scoring.console_ring_type(f, p).alias("ring")))
    # -3.8 + 3.0 + 2.5 + 1.5
    assert got["acc_promo_8841"].q == pytest.approx(1 / (1 + 2.718281828459045 ** -3.2))
    assert got["acc_promo_8841"].ring == "Promo-Abuse Ring" and got["clean"].tier == "LOW"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens_and_ids(spark):
    assert one(spark, transaction.tokenize_identifier(F.lit("card_4111_1234_5678"))) == "tok_2f692cfa080be257"
    assert one(spark, transaction.tokenize_identifier(F.lit(""))) == "tok_empty"
    assert one(spark, transaction.tokenize_identifier(F.lit(None).cast("string"))) == "tok_empty"
    assert one(spark, transaction.entity_id("pay", F.lit("a"), F.lit(1))) == "pay_" + hashlib.sha256(b"a|1").hexdigest()[:14]


def test_edge_payload(spark):
    got = one(spark, transaction.edge_payload_vector({"delta_t_from_prev": F.lit(12.5), "amount": F.lit(4500.0), "velocity_5m": F.lit(3)}))
    assert got == [12.5, 4500.0, 0, 0, 0, 0, 0, 0, 0, 3, 1, 1]


def test_method_detail_and_batch_size(spark):
    df = spark.createDataFrame([("upi", 1), ("card", 2), ("netbanking", 3)], "m string, k int")
    got = [r[0] for r in df.select(transaction.method_detail(F.col("m"), F.col("k"))).collect()]
    assert "(user_" in got[0] and "@" in got[0] and " •••• " in got[1] and got[2].startswith("NetBanking (")
    assert [one(spark, scoring.batch_size_ok(F.lit(n))) for n in (0, 1, 10_000, 10_001)] == [False, True, True, False]


def test_type_codes(spark):
    df = spark.createDataFrame([("PAYMENT",), ("TRANSFER",), ("CASH_OUT",), ("DEBIT",), ("CASH_IN",), ("odd",)], "t string")
    assert [r[0] for r in df.select(transaction.type_code(F.col("t"))).collect()] == [0, 1, 2, 3, 4, None]


@pytest.mark.parametrize("p, want", [(0.9, 0.01157957), (0.5, 0.0013), (0.1, 0.00014461)])
def test_prior_correction(spark, p, want):
    assert one(spark, probability.prior_correction(F.lit(p), 0.5)) == pytest.approx(want, abs=1e-8)


def test_bayes_and_focal(spark):
    assert one(spark, probability.bayes_threshold()) == pytest.approx(0.008264, abs=1e-6)
    # alpha 0.5, gamma 2, logit 0: 0.5 * 0.25 * ln 2
    assert one(spark, probability.focal_loss(F.lit(0.0), F.lit(1))) == pytest.approx(0.5 * 0.25 * 0.6931471805599453)
    assert one(spark, probability.focal_loss(F.lit(-800.0), F.lit(1))) == pytest.approx(400.0)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, vectors.l2_normalize(a)) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.l2_normalize(vectors.zeros(2))) == [0.0, 0.0]
    assert one(spark, vectors.cosine_similarity(a, b)) == pytest.approx(0.96)


def test_review_record(spark, accounts):
    near = spark.createDataFrame([("clean", 0.9)], "account_id string, score double")
    got = rows(review.review_accounts(accounts.drop("p"), near))
    bad, good = got["acc_promo_8841"], got["clean"]
    assert (bad.fraud_probability, bad.risk_tier, bad.cache_hit, bad.expected_cost) == (pytest.approx(0.784695), "HIGH", False, 350.0)
    assert good.cache_hit and good.fraud_probability == pytest.approx(0.455) and good.recommended_action.startswith("Queue for")
    assert bad.human_confirmation_required and len(bad.top_contributing_features) == 4
    assert bad.theoretical_bayes_threshold == 0.0083 and bad.counterfactual.reaches_target


def test_counterfactual_takes_any_score(accounts):
    stubborn = rows(review.with_counterfactual(accounts, prob="p", score=lambda f: F.lit(0.9), name="c"))["acc_promo_8841"].c
    assert len(stubborn.changes_required) == 5 and not stubborn.reaches_target and stubborn.counterfactual_probability == 0.9
