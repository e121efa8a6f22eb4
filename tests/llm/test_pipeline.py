"""The corpus pipeline's stages on the smallest driver tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import registry, simhash, similar

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, at = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF).cache()
        assert at.columns == docs.columns
        counts[name] = at.count()
    assert counts["toxicity"] <= docs.count() and counts["simhash_near_dedup"] <= counts["toxicity"]
    assert counts["pii_pseudonyms"] == counts["simhash_near_dedup"] < counts["source_mixing"]
    mails = lambda df: {m for r in df.selectExpr("regexp_extract_all(text, '[a-z.0-9]+@[a-z0-9.]+', 0) as m").collect() for m in r.m or ()}
    assert mails(docs) and not mails(docs) & mails(at)
    assert simhash.simhash_components(at.dropDuplicates(["doc_id"])).where("doc_id <> component_id").count() == 0
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in at.select("doc_id").distinct().collect()}


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_one_query_for_each_operator():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{k}" for k in range(1, 14)), "pipeline"]
    assert set(registry.oracle_sql()) <= set(names)


def test_near_duplicate_stage_keeps_one_row_of_every_group(spark):
    rows = [(3, "a b c d", "x"), (1, "A  b c d", "y"), (None, "other words here", "z"), (None, "other words here", "y"), (7, "not like the rest of them", "w"), (7, "not like the rest of them", "w"), (7, "one id but another text", "w"), (None, "a b c d", "x"), (9, None, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, docs, SF).select("doc_id", "text").collect()))
    want = [(1, "A  b c d"), (None, "other words here"), (7, "not like the rest of them"), (7, "one id but another text"), (9, None)]
    assert got == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in want)


def test_stages_keep_columns_of_any_names(spark):
    """Columns whose names an operator might use come through as they were."""
    own = ["__rank", "__row", "__epochs", "__copy", "__last", "__source", "row_number", "row_rank", "cut_source", "cut_epochs", "cut_last", "cut_copy", "pii_spans", "score", "node"]
    rows = [(k, f"some words of text number {k} that differ {k * 7} from others {k * k}", "s", *[k] * len(own)) for k in range(6)] + [(9, "some words of text number 0 that differ 0 from others 0", "s", *[9] * len(own))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in own))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        got = got.collect()
        assert got and all(r[c] == r.doc_id for r in got for c in own), name
    assert len(corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == 6 and len(simhash.keep_one(docs).collect()) == 6


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def alike(x, y):
    return 5 * len(x & y) >= 4 * len(x | y) > 0


def test_near_duplicate_stage_leaves_no_similar_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    r, words = random.Random(5), [f"w{k}" for k in range(500)]
    for k in range(30):  # copies with one to five words changed
        text = [r.choice(words) for _ in range(120)]
        rows.append((10**6 + 2 * k, " ".join(text)))
        for _ in range(k % 5 + 1):
            text[r.randrange(120)] = "changed"
        rows.append((10**6 + 2 * k + 1, " ".join(text)))
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    sets = [shingle_set(x.text) for x in got]
    assert not [1 for i, x in enumerate(sets) for y in sets[:i] if alike(x, y)]
    first = {t: shingle_set(t) for _, t in rows}
    kept = {x.text for x in got}
    pairs = [(first[rows[k][1]], first[rows[k + 1][1]]) for k in range(len(rows) - 60, len(rows), 2)]
    assert sum((rows[len(rows) - 60 + 2 * k][1] in kept) + (rows[len(rows) - 59 + 2 * k][1] in kept) for k in range(30)) == sum(1 if alike(*p) else 2 for p in pairs)


@pytest.mark.parametrize("bucket, rounds", [(2, 1), (2, 3), (32, 5)])
def test_similar_links_leave_nothing_alike(spark, bucket, rounds, monkeypatch):
    """A cloud around one text, texts with a common line, and chains; hot shingles take the rounds."""
    monkeypatch.setattr(similar, "PAIRS", 0 if bucket < 32 else similar.PAIRS)
    r, words = random.Random(3), [f"w{k}" for k in range(300)]
    base, line = [r.choice(words) for _ in range(80)], [r.choice(words) for _ in range(12)]
    texts = ["", "one two"]
    for _ in range(40):
        t = list(base)
        for _ in range(r.randrange(4)):
            t[r.randrange(80)] = r.choice(words)
        texts += [" ".join(t), " ".join(line + [r.choice(words) for _ in range(r.randrange(1, 30))])]
    for k in range(30):
        base[k] = "next"
        texts.append(" ".join(base))
    texts = sorted(set(texts))
    sets = [shingle_set(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "__row long, text string").withColumn("__rank", F.struct("__row"))
    kept = df.select("__row", F.col("__row").alias("node"))
    links = {(x.a, x.b) for x in similar.similar_links(df, similar.sketched(df), kept, bucket, rounds).collect()}
    assert links and all(a < b and alike(sets[a], sets[b]) for a, b in links)
    kept = set(range(len(texts))) - {b for _, b in links}
    assert {b for _, b in links} <= {j for i in range(len(texts)) for j in range(i + 1, len(texts)) if alike(sets[i], sets[j])}
    assert not [1 for i in kept for j in kept if i < j and alike(sets[i], sets[j])]


def test_shingle_sets_are_those_of_the_words():
    texts = ["A b c d e f", "a  B\tc d e f", "a b c d e f a b c d e", "a b", "a  b", "b a", "", None, " \n", "x", "a b c d e", "É b c d e", "é b c d e"]
    sets = [x.tolist() for x in similar.shingle_sets(pa.array(texts))]
    assert [len(x) for x in sets] == [len(shingle_set("".join(c.lower() if c < "\x80" else c for c in t or ""))) if t != "É b c d e" else 1 for t in texts]
    assert sets[0] == sets[1] and set(sets[0]) < set(sets[2]) and sets[3] == sets[4] != sets[5] and sets[11] != sets[12]
    assert all(x == sorted(set(x)) for x in sets) and [x.tolist() for x in similar.shingle_sets(pa.array(texts[3:]))] == sets[3:]


def test_prefixes_and_maps_miss_nothing():
    """Pairs at just the similarity share a prefix shingle; maps differ in no more bits than sets in shingles."""
    assert [similar.prefix_length(n, n) for n in (0, 1, 4, 5, 40)] == [0, 1, 1, 2, 9] and similar.prefix_length(10_000, 10_000) == 22
    assert similar.prefix_length(1000, 150) == 201 and 22 < similar.prefix_length(10_000, 5_000) < 50
    r = np.random.default_rng(3)
    for n in (5, 30, 200, 3000):
        for _ in range(50):
            all_ = r.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)
            x, y = np.sort(all_[: n - n // 10]), np.sort(all_[n // 10 :])
            k, m = similar.prefix_length(len(x), len(x)), similar.prefix_length(len(y), len(y))
            assert set(x[:k].tolist()) & set(y[:m].tolist())
            assert np.bitwise_count((similar.parity_map(x) ^ similar.parity_map(y)).view(np.uint64)).sum() <= len(np.setxor1d(x, y))
