"""Streams whose games arrive shuffled give what the batch gives."""

import random

import pytest

from plyworks.streaming import late_games, ratings

SCHEMA = "player string, game_no long, played_at timestamp, opponent_rating double, opponent_rd double, score double"


def made(spark, n=40, players="abc"):
    from datetime import datetime, timedelta, timezone

    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    return [(p, k, at + timedelta(minutes=10 * k), 1400.0 + 37 * (k % 9), 60.0, (k % 3) / 2) for k in range(n) for p in players]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, df, tmp_path, deliveries, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    try:
        for k, rows in enumerate(deliveries):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query.processAllAvailable()
        return spark.table(name).collect(), query.recentProgress
    finally:
        query.stop()


def test_shuffled_deliveries_give_the_batch_result(spark, tmp_path, rocks):
    from datetime import timedelta

    rows = made(spark)
    rated = ratings.rate_games(spark.createDataFrame(rows, SCHEMA).drop("played_at"))
    want = {(r.player, r.game_no): (r.rating, r.rd, r.volatility, r.listed) for r in rated.collect()}
    mixed = [[r for r in rows if 8 * k <= r[1] < 8 * k + 8] for k in range(5)]
    deal = random.Random(1)
    deliveries = []
    for k, part in enumerate(mixed):  # within the delay, games come late, twice and in any order
        held = part + (mixed[k - 1][::5] if k else [])
        deal.shuffle(held)
        deliveries += [held[::2], held[1::2]]
    end = rows[-1][2] + timedelta(days=2)
    deliveries += [[("z", 0, end, 1500.0, 50.0, 1.0)], [("z", 1, end, 1500.0, 50.0, 1.0)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got, _ = run(spark, ratings.rate_late_stream(stream, delay="3 hours"), tmp_path, deliveries, "late_rated")
    found = {(r.player, r.game_no): (r.rating, r.rd, r.volatility, r.listed) for r in got if r.player != "z"}
    assert found == want and len(found) == len([r for r in got if r.player != "z"])


def test_a_stream_goes_on_from_the_batch_and_counts_what_is_late(spark, tmp_path, rocks):
    from datetime import timedelta

    rows = made(spark, 20, "ab")
    batch = ratings.rate_games(spark.createDataFrame(rows, SCHEMA).drop("played_at")).collect()
    rated = spark.createDataFrame([tuple(r) for r in batch if r.game_no < 12], "player string, game_no long, rating double, rd double, volatility double, listed long")
    end = rows[-1][2] + timedelta(days=2)
    deliveries = [[r for r in rows if r[1] >= 10][::-1], [("z", 0, end, 1500.0, 50.0, 1.0)], [("z", 1, end, 1500.0, 50.0, 1.0)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got, _ = run(spark, ratings.rate_late_stream(stream, rated=rated, delay="10 hours"), tmp_path, deliveries, "late_going_on")
    mine = [r for r in got if r.player != "z"]
    assert {(r.player, r.game_no): r.rating for r in mine} == {(r.player, r.game_no): r.rating for r in batch if r.game_no >= 12}
    assert {r.late for r in mine} == {2}  # games 10 and 11 were in the batch


def test_states_are_told_by_their_schemas(spark):
    p = late_games.Replay(ratings._fold, (1.0,), "score double", "player string", "rating double, last long")
    assert p._state.__self__ is p and late_games._plain(float("nan")) is None and late_games._plain(3) == 3
