import pytest
from pyspark.sql import functions as F

from ringwarden.operators import temporal
from ringwarden.sources import files, views
from ringwarden.streaming import jobs


@pytest.fixture(scope="module")
def late_feed(spark, folder, tmp_path_factory):
    """Events in four files by time, every 97th row moved to the last file."""
    base = tmp_path_factory.mktemp("feed")
    raw = views.table(spark, folder, "events")
    part = F.when(F.col("event_id") % 97 == 0, 3).otherwise(F.floor(F.dayofmonth("ts") / 8).cast("int"))
    tagged = raw.withColumn("part", part).cache()
    for i in range(4):
        tagged.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(base))
    return str(base)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_exact_velocity_equals_batch_when_in_order(spark, folder, late_feed):
    stream = jobs.event_stream(spark, late_feed, files="*.parquet")
    got = jobs.exact_velocity(stream).select("event_id", "tx_velocity", "amount_velocity")
    want = temporal.rolling_velocity(views.events(spark, folder), key="user_id", ts_us="ts_us", amount="value")
    assert rows(got) == rows(want.select("event_id", "tx_velocity", "amount_velocity"))


def test_batches_see_earlier_batches(spark, late_feed):
    stream = jobs.event_stream(spark, late_feed, files="*.parquet", max_files=1)
    got = jobs.exact_velocity(stream)
    assert got.count() == got.select("event_id").distinct().count()
    assert got.agg(F.max("tx_velocity")).first()[0] > 1


def test_rate_limit_counts_over_batches(spark, late_feed):
    stream = jobs.event_stream(spark, late_feed, files="*.parquet", max_files=2)
    got = jobs.stream_rate_limit(stream, max_requests=2, window_sec=7200)
    assert got.where("is_limited != (requests > 2)").count() == 0


def test_ring_alerts_forget_old_payments(spark, tmp_path):
    from test_rings import payment

    from ringwarden.schemas import PAYMENT

    day = 86_400
    first = [payment("a1", "c1", 1, 0, device_id="x"), payment("a2", "c2", 1, 5, device_id="x")]
    second = [payment("b1", "c3", 1, 10 * day, ip_id="y"), payment("b2", "c4", 1, 10 * day + 5, ip_id="y"), payment("b3", "c1", 1, 10 * day, device_id="x")]
    for i, rows_ in enumerate((first, second)):
        spark.createDataFrame(rows_, PAYMENT).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(PAYMENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    scores = spark.createDataFrame([("c1", 0.9)], "customer_id string, score double")
    got = jobs.ring_alerts(stream, scores, window_sec=day).select("batch", "component", "transaction_count")
    assert {tuple(r) for r in got.collect()} == {(0, "a1", 2), (1, "b1", 2)}


def test_score_and_nearline_streams(spark, folder, late_feed):
    stream = jobs.event_stream(spark, late_feed, files="*.parquet", max_files=1)
    writes = stream.select(F.col("user_id").alias("account_id"), F.col("ts").alias("written_at"), (F.col("value") / 1000).alias("score"))
    table = jobs.nearline_table(writes)
    newest = views.events(spark, folder).groupBy("user_id").agg(F.max("ts_us").alias("t"))
    day = 86_400_000_000
    end = newest.agg(F.max("t")).first()[0]
    # writes that came later than the watermark allows have expired
    live = table.where(F.col("expire_us") > end)
    assert rows(live.select("account_id", "written_us")) == rows(newest.where(F.col("t") + day > end))


def feed_of(spark, path, batches):
    """One file per batch of (account_id, day)."""
    for batch in batches:
        stamped = spark.createDataFrame(batch, "account_id long, day double").select(
            "account_id", F.timestamp_micros((F.lit(1_700_006_400_000_000) + F.col("day") * 86_400_000_000).cast("long")).alias("written_at"), (F.col("day") / 100).alias("score")
        )
        stamped.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("account_id long, written_at timestamp, score double").option("maxFilesPerTrigger", 1).parquet(path)


def test_nearline_state_falls_after_the_ttl(spark, tmp_path):
    stream = feed_of(spark, str(tmp_path / "in"), [[(i, 0.5) for i in range(200)], [(1, 4.5)], [(2, 8.5)], [(2, 8.6)]])
    query = (
        jobs.nearline_scores(stream).writeStream.outputMode("update").foreachBatch(lambda b, i: b.count())
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[0] == 200 and held[-1] <= 2


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    batches = [[(i % 7, i / 40) for i in range(k, 80, 4)] for k in range(4)]
    feed, own = str(tmp_path / "in"), str(tmp_path / "own")
    first = jobs.nearline_table(feed_of(spark, feed, batches[:2]), into=own)
    assert first.count() == 7
    both = jobs.nearline_table(feed_of(spark, feed, batches[2:]), into=own)
    whole = jobs.nearline_table(feed_of(spark, str(tmp_path / "all"), batches))
    assert rows(both) == rows(whole) and rows(both) != rows(first)
    ev = lambda path: spark.readStream.schema("account_id long, written_at timestamp, score double").parquet(path).select(
        F.col("account_id").alias("user_id"), F.unix_micros("written_at").alias("ts_us"), F.col("score").alias("value"))
    later, at = str(tmp_path / "later"), str(tmp_path / "velocity")
    feed_of(spark, later, batches[:2])
    jobs.exact_velocity(ev(later), into=at)
    feed_of(spark, later, batches[2:])
    got = jobs.exact_velocity(ev(later), into=at)
    assert got.count() == 80 and got.agg(F.max("tx_velocity")).first()[0] > 1


def test_updates_cover_open_windows_and_need_the_stream(spark, tmp_path):
    minute = lambda path: jobs.merchant_minute(
        spark.readStream.schema("account_id long, written_at timestamp, score double").option("maxFilesPerTrigger", 1).parquet(path).withColumnRenamed("written_at", "ts"),
        merchant="account_id", flagged=F.col("score") > 0.01)
    feed = str(tmp_path / "in")
    feed_of(spark, feed, [[(1, 0.0), (1, 0.0001)], [(1, 0.0002), (2, 2.0)]])
    got = jobs.run_updates(minute(feed), ["account_id", "minute_us"], label="minutes").select("account_id", "total", "flagged")
    assert rows(got) == [(1, 3, 0), (2, 1, 1)]
    feed_of(spark, str(tmp_path / "none"), [[]])
    assert jobs.run_updates(minute(str(tmp_path / "none")), ["account_id", "minute_us"], label="minutes").count() == 0


def test_dedupe(spark, late_feed):
    stream = jobs.event_stream(spark, late_feed, files="*.parquet").union(jobs.event_stream(spark, late_feed, files="*.parquet"))
    kept = jobs.run_to_table(jobs.dedupe(stream, keys=["user_id", "ts_us", "value"]))
    assert kept.count() == kept.select("user_id", "ts_us", "value").distinct().count() > 0


def test_feature_cache_is_keyed_by_input_and_cutoff(spark, tmp_path):
    built = []

    def build(n):
        def make():
            built.append(n)
            return spark.range(n)
        return make

    folder = str(tmp_path)
    assert files.feature_cache(spark, folder, {"input": "a", "cutoff": 1}, build(3)).count() == 3
    assert files.feature_cache(spark, folder, {"input": "a", "cutoff": 1}, build(4)).count() == 3
    assert files.feature_cache(spark, folder, {"input": "a", "cutoff": 2}, build(5)).count() == 5
    assert built == [3, 5]


def test_edge_table_round_trip(spark, txn6, tmp_path):
    from ringwarden.operators import features

    path = str(tmp_path / "edges")
    files.write_edges(features.prepare_edges(txn6), path)
    assert files.read_edges(spark, path).count() == 5
    assert files.read_edges(spark, path, until_step=4).count() == 3


def test_transactions_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud\n"
        "1,TRANSFER,10.5,C1,20,9.5,C2,0,10.5,1,0\n"
    )
    row = files.read_transactions_csv(spark, str(path)).first()
    assert (row.step, row.type, row.amount, row.isFraud) == (1, "TRANSFER", 10.5, 1)


EVENTS_DDL = "event_id bigint, user_id bigint, ts timestamp, event_type string, value double, props string"


@pytest.fixture()
def own_feed(spark, tmp_path):
    """Bursts of six users over four days, in one file and in two by time; the last one runs to the end of the feed."""
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    made = [(u * 100 + i, u, start + timedelta(hours=20 * u, minutes=17 * i), "view", 1.25 * i, "{}") for u in range(6) for i in range(9)]
    cut = start + timedelta(hours=50)
    for name, part in (("first", [r for r in made if r[2] < cut]), ("second", [r for r in made if r[2] >= cut]), ("events", made)):
        spark.createDataFrame(part, EVENTS_DDL).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        # one file, as the query names it
        (written,) = (tmp_path / name).glob("part-*")
        (tmp_path / f"{name}.parquet").write_bytes(written.read_bytes())
    return str(tmp_path), len(made)


def test_session_burst_query_holds_sessions_still_open(spark, own_feed):
    from ringwarden.plans.catalog import CATALOG

    got, want = [CATALOG[q].run(spark, own_feed[0]).select("user_id", "start_us", "end_us", "events") for q in ("stream_session_burst", "session_bursts")]
    assert rows(got) == rows(want)
    assert got.where("user_id = 5").first()["events"] == 9


def test_open_sessions_grow_over_batches(spark, own_feed):
    stream = jobs.event_stream(spark, own_feed[0], files="{first,second}.parquet", max_files=1)
    got = jobs.all_session_bursts(stream, gap="4 hours", min_events=4)
    assert {(r.user_id, r.events) for r in got.collect()} == {(u, 9) for u in range(6)}


def test_sliding_totals_keep_one_row_per_tile(spark, own_feed, monkeypatch):
    kept, run = [], jobs.run_updates
    monkeypatch.setattr(jobs, "run_updates", lambda *args, **kw: kept.append(run(*args, **kw)) or kept[-1])
    from ringwarden.plans.catalog import CATALOG

    got = CATALOG["stream_velocity_sliding"].run(spark, own_feed[0])
    want = jobs.sliding_velocity(views.events(spark, own_feed[0])).select(
        "user_id", F.unix_micros("window_start").alias("start_us"), "tx_velocity", F.col("amount_velocity").cast("double").alias("amount_velocity")
    )
    assert rows(got) == rows(want)
    # 54 events lie in 24 windows each
    assert kept[0].count() <= own_feed[1]
