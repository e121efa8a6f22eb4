"""Requests, scoped questions and checked triples on small fixed inputs."""

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation as ev
from quern.operators import requests as rq


def one(spark, ddl, row, column):
    return spark.createDataFrame([row], ddl).select(column.alias("x")).first().x


def test_symbol_lists_keep_first_occurrences(spark):
    assert one(spark, "s string", (" nvda,amd,,NVDA , mu",), rq.symbol_list(F.col("s"))) == ["NVDA", "AMD", "MU"]
    assert one(spark, "s string", (" , ",), rq.symbol_list(F.col("s"))) == []


@pytest.mark.parametrize("terms, want", [(["rates"], "rates"), (["interest rates", "fed"], '("interest rates" OR fed)'), ([], "")])
def test_terms_are_joined(spark, terms, want):
    assert one(spark, "t array<string>", (terms,), rq.any_of(F.col("t"))) == want


def test_alias_patterns_escape_and_match_whole_names(spark):
    p = one(spark, "a array<string>", (["AMD", "A.M.D", "Advanced Micro"],), rq.alias_pattern(F.col("a")))
    assert p == r"\b(advanced micro|a\.m\.d|amd)\b"


@pytest.mark.parametrize("label, want", [("Item 1A. Risk Factors", "1a"), ("ITEM 7", "7"), ("Item 5.02 Departure", None), ("Preamble", None), (None, None)])
def test_section_codes(spark, label, want):
    assert one(spark, "l string", (label,), rq.section_code(F.col("l"))) == want


def test_topics_of_bridging_questions(spark):
    ask = lambda q, bridge=True: one(spark, "q string, b boolean", (q, bridge), rq.topic_query(F.col("q"), F.col("b"), F.lit("Acme")))
    assert ask("Of its suppliers, which one discloses customer concentration in its own filings?") == "Acme customer concentration"
    assert ask("Which supplier warns about delays?") == "Acme delays"
    assert ask("What does it disclose about delays?", False) == "Acme What does it disclose about delays?"
    assert ask("Which supplier grows?") == "Acme Which supplier grows?"


def test_triples_are_checked_and_the_last_wins(spark):
    rows = [
        (1, "amd", "competes_with", "Intel Corp", "It competes with Intel.", 0.7), (2, "amd", "competes_with", "INTEL", "Intel again", None), (3, "amd", "competes_with", "Nvidia", "no such name", 0.9),
        (4, "amd", "competes_with", "AMD Inc", "AMD itself", 0.9), (5, "amd", "likes", "Intel", "Intel", 0.9), (6, "amd", "mentions_risk", "Supply Capacity!", "any", 1.7),
        (7, "amd", "mentions_risk", "Late", "any", 0.4), (8, "amd", "mentions_risk", "Gone", None, 0.9), (9, "amd", "exposed_to", "  ", "any", 0.9),
    ]
    df = spark.createDataFrame(rows, "seq int, subject string, relation string, object string, chunk_text string, confidence double")
    got = {(r.relation, r.object_id): (r.confidence, r.n) for r in rq.checked_triples(df).collect()}
    assert got == {("competes_with", "intel"): (1.0, 2), ("mentions_risk", "supply-capacity"): (1.0, 1)}
    assert rq.checked_triples(df.limit(0)).count() == 0


def test_masked_softmax(spark):
    p = one(spark, "x array<double>, ok array<boolean>", ([0.0, 0.0, 500.0], [True, True, False]), rq.masked_softmax(F.col("x"), F.col("ok")))
    assert p == [0.5, 0.5, 0.0]
    assert one(spark, "x array<double>, ok array<boolean>", ([1.0], [False]), rq.masked_softmax(F.col("x"), F.col("ok"))) is None


@pytest.mark.parametrize("rule, want", [("breadth_first", 25), ("pooled_rerank", 14), ("top_branches", 14)])
def test_caps(spark, rule, want):
    assert one(spark, "r string, u int, b int", (rule, 6, 19), rq.evidence_cap(F.col("r"), F.col("u"), F.col("b"))) == want


def test_failover_takes_one_provider(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 3, "w")], "k string, p int, v string")
    assert sorted(r.v for r in rq.merged_by_priority(df, ["k"], F.col("p")).collect()) == ["w", "y", "z"]


@pytest.mark.parametrize("alpha", [0.1, 0.5, 0.0001])
def test_pooled_ranks_equal_the_plain_ones(spark, alpha):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 4 == 0, 0.5).otherwise(F.round(F.abs(F.xxhash64("id")) % 997 / 997, 2)).alias("s"))
    df = df.union(spark.createDataFrame([(9, 1.0)], "k long, s double"))
    answers = [{r.k: (r.n, r.q) for r in f(df, ["k"], alpha).collect()} for f in (ev.conformal_q, ev.pooled_conformal_q)]
    assert answers[0] == answers[1] and len(answers[0]) == 4
    assert ev.pooled_conformal_q(df.limit(0), ["k"], alpha).count() == 0


def test_empty_answers_fall_through(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "sym string")
    table = lambda rows: spark.createDataFrame(rows, "sym string, v int")
    got = rq.first_with_rows(wanted, {"one": table([("a", 1), ("a", 2), ("z", 9)]), "two": table([("a", 3), ("b", 4)])}, "sym").collect()
    assert sorted((r.sym, r.provider or "", r.v or 0) for r in got) == [("a", "one", 1), ("a", "one", 2), ("b", "two", 4), ("c", "", 0)]
    assert rq.first_with_rows(wanted.limit(0), {"one": table([])}, "sym").count() == 0
