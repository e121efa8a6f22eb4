"""Stores that are filled step by step, drawn questions, and opt-in features."""

import datetime
import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from quern.operators import questions as qs
from quern.plans import stores
from quern.sources import ingest

DAY = datetime.date(2024, 1, 1)
TOPICS = {"war": ("ARMED", "UNREST"), "money": ("ECON_",)}


def test_news_of_a_day_replace_that_day_alone(spark, tmp_path):
    rows = [
        (DAY, 1.0, "ECON_TAX;armed_conflict", ["A", "B"]), (DAY, 3.0, "econ_debt", ["A"]), (DAY, -1.0, "sport", []), (DAY, 5.0, None, None),
        (DAY + datetime.timedelta(1), 2.0, "UNREST", ["B"]), (DAY + datetime.timedelta(2), 2.0, "UNREST", ["B"]),
    ]
    records = spark.createDataFrame(rows, "day date, tone double, themes string, tickers array<string>")
    path = str(tmp_path / "news")
    ingest.ingest_news(records, path, "2024-01-01", "2024-01-03", TOPICS)
    read = lambda: {(r.stream, str(r.day), r.key): (r.article_count, r.tone_mean, r.tone_std) for r in ingest.news_table(spark, path).collect()}
    first = read()
    assert first == {
        ("market", "2024-01-01", ""): (2, 2.0, 1.414214), ("topics", "2024-01-01", "war"): (1, 1.0, 0.0), ("topics", "2024-01-01", "money"): (2, 2.0, 1.414214),
        ("per_ticker", "2024-01-01", "A"): (2, 2.0, 1.414214), ("per_ticker", "2024-01-01", "B"): (1, 1.0, 0.0),
        ("market", "2024-01-02", ""): (1, 2.0, 0.0), ("topics", "2024-01-02", "war"): (1, 2.0, 0.0), ("per_ticker", "2024-01-02", "B"): (1, 2.0, 0.0),
    }
    ingest.ingest_news(records.withColumn("tone", F.col("tone") + 10), path, "2024-01-02", "2024-01-03", TOPICS)
    again = read()
    assert {k: v for k, v in again.items() if k[1] == "2024-01-01"} == {k: v for k, v in first.items() if k[1] == "2024-01-01"}
    assert again["topics", "2024-01-02", "war"] == (1, 12.0, 0.0) and len(again) == len(first)
    plan = ingest.news_table(spark, path).where("day = date'2024-01-02' and stream = 'topics'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    stored = str(tmp_path / "records")
    records.write.partitionBy("day").parquet(stored)
    plan = ingest.news_streams(spark.read.parquet(stored).where("day >= date'2024-01-01' and day < date'2024-01-02'"), TOPICS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "2024" not in plan.split("PushedFilters: [")[1].split("]")[0]


def test_filings_are_taken_in_once_across_restarts(spark, tmp_path):
    base, path = tmp_path / "docs", str(tmp_path / "store")

    def put(ticker, form, day, text, name="filing.html"):
        folder = base / "sec" / ticker / form / day
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)

    put("AAA", "10-K", "2024-01-01", "<head><title>t</title></head><p>one</p>")
    put("AAA", "10-Q", "2024-02-01", "<p>two</p>")
    (base / "sec" / "AAA" / "10-Q" / "2024-02-01" / "notes.txt").write_text("not a filing")
    ingest.FilingStore(spark, path).ingest(str(base / "sec"), per_batch=1)
    rows = lambda: {r.accession: (r.ticker, r.form, r.day, r.text) for r in ingest.FilingStore(spark, path).filings().collect()}
    first = rows()
    assert first == {"AAA-10-K-2024-01-01": ("AAA", "10-K", "2024-01-01", "one"), "AAA-10-Q-2024-02-01": ("AAA", "10-Q", "2024-02-01", "two")}
    put("BBB", "10-K", "2024-03-01", "<p>three</p>")
    put("AAA", "10-K", "2024-01-01", "<p>again</p>", "copy-filing.html")  # the same filing by another name
    store = ingest.FilingStore(spark, path)  # a restart
    store.ingest(str(base / "sec"), "*filing.html")
    assert rows() == first | {"BBB-10-K-2024-03-01": ("BBB", "10-K", "2024-03-01", "three")}
    store.ingest(str(base / "sec"), "*filing.html")
    assert len(rows()) == 3 and store.filings().count() == 3


def test_bundled_filings_are_taken_in_once_across_restarts(spark, tmp_path):
    path, folder = str(tmp_path / "store"), str(tmp_path / "bundles")
    pack = lambda *rows: ingest.bundle(spark.createDataFrame([(p, bytearray(c, "utf-8")) for p, c in rows], "path string, content binary"), folder)
    rows = lambda: {r.accession: (r.ticker, r.form, r.day, r.text, r.sha256) for r in ingest.FilingStore(spark, path).filings().collect()}
    row = lambda t, f, d, text, html: (t, f, d, text, hashlib.sha256(html.encode()).hexdigest())
    pack(("sec/AAA/10-K/1/filing.html", "<p>öne</p>"), ("sec/AAA/10-Q/2/filing.html", "<p>two</p>"), ("sec/AAA/10-Q/2/again.html", "<p>2</p>"))
    ingest.FilingStore(spark, path).ingest_bundles(folder, per_batch=1)
    first = rows()
    assert set(first) == {"AAA-10-K-1", "AAA-10-Q-2"} and first["AAA-10-K-1"] == row("AAA", "10-K", "1", "öne", "<p>öne</p>")
    pack(("other/AAA/10-K/1/filing.html", "<p>late</p>"), ("sec/BBB/10-K/3/filing.html", "<p>three</p>"))
    loose = tmp_path / "sec" / "CCC" / "10-K" / "4"
    loose.mkdir(parents=True)
    (loose / "filing.html").write_text("<p>four</p>")
    store = ingest.FilingStore(spark, path)  # a restart
    store.ingest_bundles(folder)
    store.ingest(str(tmp_path / "sec"))  # files of their own go into the same store and replace no batch of bundles
    store.ingest_bundles(folder)
    assert rows() == first | {"BBB-10-K-3": row("BBB", "10-K", "3", "three", "<p>three</p>"), "CCC-10-K-4": row("CCC", "10-K", "4", "four", "<p>four</p>")}
    assert store.filings().count() == 4


def test_the_manifest_is_not_broadcast(spark, tmp_path, monkeypatch):
    """A manifest of short, alike accessions is small as a file and large in memory."""
    seen, texts = [], ingest.with_texts
    monkeypatch.setattr(ingest, "with_texts", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or texts(df))
    ingest.bundle(spark.createDataFrame([("sec/AAA/10-K/1/filing.html", bytearray(b"<p>one</p>"))], "path string, content binary"), str(tmp_path / "bundles"))
    ingest.FilingStore(spark, str(tmp_path / "store")).ingest_bundles(str(tmp_path / "bundles"))
    assert seen and "SortMergeJoin" in seen[0] and "Broadcast" not in seen[0]


def test_filing_ingest_writes_no_file_for_each_page(spark, tmp_path, monkeypatch):
    """400 pages gave 400 files in as many folders."""
    pages = [(k, "u", f"<p>page {k}</p>\n" if k % 10 else None) for k in range(-3, 397)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2).write.parquet(str(tmp_path / "in" / "pages.parquet"))
    monkeypatch.setattr(stores, "scratch", lambda spark, tag: str(tmp_path / tag))
    got = {tuple(r) for r in stores.filing_ingest(spark, str(tmp_path / "in")).collect()}
    ticker = lambda k: f"T{int(math.fmod(k, 7))}"
    assert got == {(f"{ticker(k)}-10-K-{k}", ticker(k), "10-K", str(k), hashlib.sha256((h + "\n").encode()).hexdigest()) for k, _, h in pages if h}
    assert len([*(tmp_path / "filings").rglob("part-*")]) <= 8


def test_questions_are_the_same_under_any_partitioning(spark):
    r = np.random.default_rng(4)
    bridges = [(f"s{r.integers(12)}", str(r.choice(["depends_on", "competes_with"])), f"s{r.integers(12)}") for _ in range(60)]
    topics = [(f"s{r.integers(12)}", str(r.choice(["Chips", " chips ", "tax", "risk", "ai", "stopword"]))) for _ in range(50)]
    b, t = spark.createDataFrame(bridges, "subject string, relation string, object string"), spark.createDataFrame(topics, "entity string, topic string")
    ask = lambda b, t: sorted(map(tuple, qs.multihop_questions(b, t, 20, stop=("stopword",)).collect()))
    got = ask(b, t)
    assert got == ask(b.repartition(7), t.repartition(5).union(t)) and got
    own = {}
    for e, x in topics:
        if len(x) >= 3 and x.strip().lower() != "stopword":
            own.setdefault(e, set()).add(x.strip().lower())
    for stratum, _, seed, relation, target, topic, _, _ in got:
        assert topic in own[target]
        if stratum == "CTRL":
            assert seed == target and relation == ""
        else:
            assert (seed, relation, target) in bridges and seed != target and (topic in own.get(seed, ())) == (stratum == "MED")
    counts = {s: sum(g[0] == s for g in got) for s in qs.SHARES}
    assert all(counts[s] <= round(share * 20) for s, share in qs.SHARES.items()) and counts["HARD"] == 10
    assert max(sum(g[2:4] == x[2:4] for g in got) for x in got) <= qs.PER_SEED


def test_opt_in_groups_against_pandas(spark):
    r = np.random.default_rng(8)
    n = 120
    c, x = np.exp(np.cumsum(r.normal(0, 0.03, n))), np.exp(np.cumsum(r.normal(0, 0.02, n)))
    day = [DAY + datetime.timedelta(k) for k in range(n)]
    bars = spark.createDataFrame([("a", d, float(v)) for d, v in zip(day, c)], "sym string, d date, c double")
    index = spark.createDataFrame([(d, float(v)) for k, (d, v) in enumerate(zip(day, x)) if k % 3], "d date, x double")
    activity = spark.createDataFrame([("a", day[k], 1.0, 2.0, 0.5) for k in (5, 40, 41, 100)] + [("a", DAY - datetime.timedelta(9), 9.0, 9.0, 9.0)], "sym string, filing_date date, buy_conviction double, senior_buy_n double, sell_pressure double")
    got = {g.d: g for g in stores.with_groups(bars.select("sym", "d"), bars, index, activity).collect()}
    own = [k for k in range(n) if k % 3]
    k = 110
    assert abs(got[day[k]].pct_from_52w_high - (c[k] / c[: k + 1].max() - 1)) < 1e-9 and got[day[10]].pct_from_52w_high is None
    at = max(i for i, o in enumerate(own) if o <= k)
    assert abs(got[day[k]].rel_strength_20d - (c[k] / c[k - 20] - x[own[at]] / x[own[at - 20]])) < 1e-9
    assert abs(got[day[k]].rel_strength_60d - (c[k] / c[k - 60] - x[own[at]] / x[own[at - 60]])) < 1e-9
    assert (got[day[k]].insider_buy_conviction_63d, got[day[50]].insider_senior_buy_63d, got[day[45]].insider_sell_pressure_63d) == (1.0, 6.0, 1.5) and got[day[10]].insider_senior_buy_63d is None
    assert stores.with_groups(bars.select("sym", "d"), bars, index, activity, ("high52w",)).columns == ["sym", "d", "pct_from_52w_high"]
