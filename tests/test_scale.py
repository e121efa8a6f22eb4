"""Steps whose cost must follow the input: what moves, what is paired, and that results are whole."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import chunking, dedupe
from quern.operators import retrieval as rt


@pytest.fixture
def no_small_sides(spark):
    """Plans as of tables that are too large to be told to all tasks unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_meet_queries_without_rows_of_pairs(spark):
    rows = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(50)] + [(90, None), (91, [0.0, 0.0, 0.0]), (92, [1.0]), (93, [float("nan"), 1.0, 1.0])], "vec_id long, embedding array<float>")
    good = rows.where("vec_id < 92 and vec_id <> 90")
    asked = rows.where("vec_id in (7, 21, 91)").selectExpr("vec_id as query_id", "embedding as q")
    plan = _plan(rt.nearest(good, asked, 4))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    each = rt.best(rows.crossJoin(asked).select("query_id", "vec_id", F.round(rt.cosine(F.col("embedding"), F.col("q")), 6).alias("score")), ["query_id"], 9, F.desc("score"), F.col("vec_id"))
    answers = lambda df: sorted(map(repr, (tuple(x) for x in df.select("query_id", "vec_id", "score", "rank").collect())))
    assert answers(rt.nearest(rows, asked, 9)) == answers(each)  # odd vectors too


def test_a_search_moves_no_postings(spark, tmp_path, no_small_sides):
    from quern.operators.inverted import InvertedIndex

    r = random.Random(5)
    docs = spark.createDataFrame([(k, " ".join(f"w{r.randrange(20)}" for _ in range(12)), "en" if k % 2 else "de") for k in range(90)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w3")], "query_id long, text string")
    ix = InvertedIndex.create(docs, str(tmp_path / "ix"), ("lang",), 16)
    for where in (None, "lang = 'en'"):
        plan = _plan(ix.search(asked, 5, where))
        assert "Generate" not in plan and "SortMergeJoin" not in plan
        want = rt.bm25(docs if where is None else docs.where(where), asked, 5)
        assert sorted(map(tuple, ix.search(asked, 5, where).collect())) == sorted(map(tuple, want.select("query_id", "doc_id", "score", "rank").collect()))


def test_spans_are_looked_for_where_the_texts_lie(spark, no_small_sides):
    texts = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    passages = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    grades = chunking.span_grades(texts, passages, 40)
    assert "SortMergeJoin" not in _plan(grades) and [tuple(x) for x in grades.collect()] == [(9, 1, 2)]


@pytest.mark.parametrize("at_least", [0.85, 0.6, 0.34])
def test_sets_of_few_and_of_many_tokens_against_all_pairs(spark, at_least):
    r = random.Random(6)
    base = [frozenset(r.sample(range(24), n)) for n in range(1, 21) for _ in range(3)]
    near = [b - {r.choice(sorted(b))} for b in base if len(b) > 1] + [b | {30 + k % 3} for k, b in enumerate(base)] + [(b - {min(b)}) | {40} for b in base]
    sets = sorted({*base, *near}, key=sorted)
    got = dedupe.similar_sets(spark.createDataFrame([(k, [str(w) for w in s]) for k, s in enumerate(sets)], "id long, x array<string>"), at_least)
    want = {(a, b): len(x & y) / len(x | y) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and len(x & y) / len(x | y) >= at_least}
    rows = got.collect()
    assert {(x.a, x.b): x.jaccard for x in rows} == want and len(rows) == len(want)


def test_sets_of_few_tokens_do_not_meet_by_frequent_ones(spark):
    """All of 1,000 titles share most of their words: by the prefix filter hundreds of thousands of pairs met."""
    r = random.Random(7)
    sets = sorted({tuple(sorted(r.sample(range(16), 8))) for _ in range(1000)})
    df = spark.createDataFrame([(k, [str(w) for w in s]) for k, s in enumerate(sets)], "id long, x array<string>")
    assert "array_remove" in dedupe.similar_sets(df, 0.85)._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_titles_are_not_sent_through_the_driver(spark):
    """Stored sets are small as files and large in memory: the rows with a token left out were broadcast, 495 MB of them for 0.5 GB of documents."""
    r = random.Random(9)
    rows = [(k, " ".join(f"w{r.randrange(40)}" for _ in range(3 + 12 * (k % 2)))) for k in range(200)] + [(k + 200, f"w{k} " * 20) for k in range(5)]
    plan = _plan(dedupe.similar_titles(spark.createDataFrame(rows, "doc_id long, title string"), 0.85))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_tasks_give_memory_back(monkeypatch):
    from quern.llm import common

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.sliced(lambda batches: batches)(iter([]))) == [] and calls == [1]


def test_a_batch_of_filings_is_read_once(spark):
    """Rows go through the parser as they are: no join of a batch with its own texts."""
    from quern.sources import payloads

    out = payloads.with_texts(spark.createDataFrame([("a", "<p>one</p><p>two</p>"), ("b", None)], "accession string, html string"))
    assert sorted(map(tuple, out.collect())) == [("a", "one\ntwo", 2), ("b", "", 0)] and "Join" not in _plan(out)


@pytest.mark.parametrize(("direction", "light"), [("both", 0), ("both", 6), ("both", 40), ("out", 6), ("in", 6)])
def test_ids_of_walks_are_placed_by_lists_of_nodes(spark, monkeypatch, direction, light):
    r = random.Random(8)
    rows = sorted({(f"n{r.randrange(30)}", f"r{r.randrange(2)}", f"n{r.randrange(30)}") for _ in range(30)} | {("n1", "r0", "n1")} | {(f"n{k}", "r0", f"n{k % 2}") for k in range(30)})
    made = lambda: [r.choice([None, *map(str, range(40))]) for _ in range(r.randrange(4))]
    edges = spark.createDataFrame([(*x, made()) for x in rows] + [(*rows[0], ["5", "7"])], "subject string, relation string, object string, provenance array<string>")
    seeds = spark.createDataFrame([(f"n{k}",) for k in (*range(30), 3, 99)], "seed string")
    monkeypatch.setattr(rt, "LIGHT", light)
    monkeypatch.setattr(rt, "PART", 4)
    answers = lambda df: sorted(map(repr, df.select("seed", "place", "id").collect()))
    each = rt.provenance(rt.neighbours(edges, seeds, 2, direction), edges)
    assert answers(rt.walk_provenance(edges, seeds, direction)) == answers(each) != []


def test_edges_of_two_steps_are_met_once_and_not_grouped(spark, monkeypatch):
    r = random.Random(9)
    rows = sorted({(f"n{r.randrange(25)}", f"r{r.randrange(2)}", f"n{r.randrange(25)}") for _ in range(70)} | {("n1", "r0", "n1"), ("n2", "r0", "n1"), ("n1", "r0", "n2")} | {(f"n{k}", "r1", "n0") for k in range(25)})
    edges = spark.createDataFrame([*rows, *rows[:9]], "subject string, relation string, object string")
    seeds = spark.createDataFrame([(f"n{k}",) for k in (*range(25), 3, 99)], "seed string")
    monkeypatch.setattr(rt, "PART", 4)
    for direction in ("both", "out", "in"):
        want = {}
        for seed in (f"n{k}" for k in range(25)):
            ends = lambda s, o: {"out": {s}, "in": {o}, "both": {s, o}}[direction]  # noqa: E731, B023
            near = {n for s, _, o in rows for a, n in ((s, o), (o, s)) if a == seed and a in ends(s, o) and (direction == "both" or (a, n) == ((s, o) if direction == "out" else (o, s)))}
            for s, rel, o in rows:
                if ends(s, o) & ({seed} | near):
                    want[seed, s, rel, o] = 1 if seed in ends(s, o) else 2
        walk = rt.neighbours(edges, seeds, 2, direction)
        got = [tuple(x) for x in walk.collect()]
        assert {x[:4]: x[4] for x in got} == want and len(got) == len(want)
        assert walk._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_ownership_documents_are_parsed_once_and_not_copied_for_each_row(spark):
    """A document stays in its batch: no row of a transaction carries it.  A bad field spoils neither its row's table nor the query."""
    from quern.sources import payloads

    tx = "<nonDerivativeTransaction><transactionDate><value>{}</value></transactionDate><transactionCoding><transactionCode> P </transactionCode><footnoteId id='F1'/></transactionCoding><transactionAmounts><transactionShares><value>{}</value></transactionShares><transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>"
    body = "<issuer><issuerTradingSymbol>A&amp;B</issuerTradingSymbol></issuer><nonDerivativeTable>" + tx.format("soon", "7") + tx.format("2024-01-05-05:00", "many") + tx.format("2024-01-05-05:00", "8") + "</nonDerivativeTable><footnotes><footnote id='F1'><![CDATA[a 10B5 1 plan]]></footnote></footnotes>"
    docs = [(1, f"<ownershipDocument>{body}</ownershipDocument>"), (2, f"<ownershipDocument xmlns='urn:x'>{body}</ownershipDocument>"), (3, f"<ownershipDocument>{body}"), (4, None), (5, "<ownershipDocument/>")]
    out = payloads.ownership_transactions(spark.createDataFrame(docs, "filing_date int, xml string"))
    got = sorted((x.filing_date, x.shares, x.ticker, str(x.transaction_date), x.code, x.price, x.planned) for x in out.collect())
    assert got == [(k, n, "A&B", day, "P", None, True) for k in (1, 2) for n, day in ((7.0, "None"), (8.0, "2024-01-05"))]
    assert "Generate" not in _plan(out) and "from_xml" not in _plan(out)
    assert payloads.ownership_transactions(spark.createDataFrame(docs[2:], "filing_date int, xml string")).count() == 0
