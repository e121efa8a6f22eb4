"""The driver contract."""

from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_names_and_sql_agree(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 100
    got = entry.entry(spark)
    assert got.count() == 25 and got.columns[0] == "sym"


def test_streaming_matches_the_batch(spark):
    sf = "/root/testdata/sf0.001"
    stream = {(r.day, r.event_type): (r.n, round(r.total, 4)) for r in entry.queries()["events_daily_stream"](spark, sf).collect()}
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("to_date(ts) as day", "event_type", "(value - 50) / 10 as tone")
    batch = {(r.day, r.event_type): (r.n, round(r.total, 4)) for r in e.groupBy("day", "event_type").agg(F.count("tone").alias("n"), F.sum("tone").alias("total")).collect()}
    assert stream == batch


def test_round_trips_keep_rows(spark):
    sf, q = "/root/testdata/sf0.001", entry.queries()
    daily = q["news_daily_per_ticker"](spark, sf)
    assert sorted(map(tuple, q["csv_roundtrip"](spark, sf).collect())) == sorted(map(tuple, daily.collect()))
    assert q["json_append_log"](spark, sf).where("day is not null").count() == 2 * q["news_daily_market"](spark, sf).count()


def test_lsh_finds_near_vectors(spark):
    sf, q = "/root/testdata/sf0.01", entry.queries()
    exact = {(r.query_id, r.vec_id) for r in q["cosine_topk"](spark, sf).collect()}
    found = {(r.query_id, r.vec_id) for r in q["cosine_lsh"](spark, sf).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and len(exact) == 25


def test_probed_cells_find_nine_in_ten(spark):
    for sf in ("sf0.001", "sf0.01"):
        got = [r.recall for r in entry.queries()["dense_probe_recall"](spark, f"/root/testdata/{sf}").collect()]
        assert len(got) == 5 and sum(got) / len(got) > 0.9
