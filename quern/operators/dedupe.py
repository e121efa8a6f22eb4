"""Similar titles and the merge of articles in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.sources.payloads import scratch


#: Tokens of a set that counts as one of few, at most.
MOST_FEW = 64


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def met(rows: DataFrame, others: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """A join that deals both sides by their keys.

    Both grow with the titles and are stored tables or made of them.  Spark takes such a side for as small as its compressed files, and left to itself
    would send rows of many times that size through the driver to all tasks.
    """
    return rows.join(others.hint("merge"), on, how)


def _token_sets(titles: DataFrame) -> DataFrame:
    return titles.select("doc_id", F.array_sort(F.array_distinct(tokens(F.col("title")))).alias("x")).where(F.size("x") > 0)


def similar_sets(sets: DataFrame, at_least: float) -> DataFrame:
    """(a, b, jaccard) pairs of distinct token sets (id, x) with similarity of at least ``at_least``.

    Of few tokens, two such sets are alike only if one is the other without one token (one replaced would be too many), so a set meets by an equi-join those
    that one of its tokens is left out of: as many keys as tokens, and no key with two owners.  Where one has more, they meet by the prefix filter.
    """
    few = 1
    while few < MOST_FEW and few / (few + 2) < at_least and (few - 1) / (few + 1) < at_least:  # of n = few + 1 tokens: (n - 1) / (n + 1) and (n - 2) / n
        few += 1
    sets = sets.withColumn("x", F.array_sort("x"))
    small = sets.where(F.size("x") <= few)
    less = small.select("id", F.size("x").alias("n"), F.explode(F.transform("x", lambda w: F.array_remove("x", w))).alias("x")).where((F.col("n") - 1) / F.col("n") >= at_least)
    pairs = met(less, small.select(F.col("id").alias("other"), "x"), "x").where("n > 1")
    near = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), ((F.col("n") - 1) / F.col("n")).alias("jaccard"))
    large = sets.where(F.size("x") >= F.ceil(F.lit(at_least * (few + 1) - 1e-9)))
    return near.unionByName(_by_prefixes(large, at_least, few))


def _by_prefixes(sets: DataFrame, at_least: float, few: int) -> DataFrame:
    """The pairs of which one set has more than ``few`` tokens.

    Prefix filter: with tokens in order of rarity, two such sets share one of their first
    n - ceil(at_least n) + 1 tokens, so only rows that share a rare token meet.
    """
    freq = sets.select(F.explode("x").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ranked = met(sets.select("id", F.explode("x").alias("w")), freq, "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("r"))
    ranked = stored(ranked.select("id", F.col("r.w").alias("x")), "ranked")
    prefix = F.slice("x", 1, F.size("x") - F.ceil(F.lit(at_least) * F.size("x") - 1e-9).cast("int") + 1)
    rare = ranked.select("id", F.size("x").alias("n"), F.explode(prefix).alias("w"))
    shared = F.expr(f"p.w = q.w and p.id < q.id and greatest(p.n, q.n) > {few}")
    pairs = met(rare.alias("p"), rare.alias("q"), shared).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    both = met(met(pairs, ranked.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a"), ranked.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")
    n = F.size(F.array_intersect("xa", "xb"))
    return both.withColumn("jaccard", n / (F.size("xa") + F.size("xb") - n)).where(F.col("jaccard") >= at_least).select("a", "b", "jaccard")


def similar_titles(titles: DataFrame, at_least: float) -> DataFrame:
    """(a, b, jaccard) of titles (doc_id, title), a < b: a row for each title after the first of its token set, and one for each pair of sets alike.

    A set is named by its first title, so n equal titles give n - 1 rows and no link between different sets is lost.
    Sets and their orders are stored once, and the joins read these.
    """
    member = stored(_token_sets(titles).select("doc_id", "x"), "sets")
    groups = stored(member.groupBy("x").agg(F.min("doc_id").alias("id")).select("id", "x"), "groups")
    inside = met(member, groups, "x").where("doc_id > id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("jaccard"))
    near = similar_sets(groups, at_least)
    return inside.union(near.select("a", "b", F.round("jaccard", 6)))


def merge_articles(articles: DataFrame, at_least: float = 0.85, rounds: int = 200) -> DataFrame:
    """(doc_id, url, title, summary, sentiment, merged): articles in doc_id order, each merged into the first kept one with its URL or a title alike; a keeper takes what it lacks.

    Two articles of one URL, or of one set of title words, are alike, so each URL and each set has one keeper at most.  An article is kept once all earlier
    ones of its URL, its set and the sets alike are decided and none of them is kept; it is merged once one is.  Rounds
    decide all articles of which this is known, so a round is some groupings and joins over one row for each URL, set and pair of sets alike, and no group meets in
    one task.  Articles of one URL and set go with the first of them.  Rounds follow chains of articles that wait for each other; more than
    ``rounds`` are an error.  A null URL is a URL, titles without words are alike to none, and of repeated doc_ids the rows count as one article more.
    """
    a = stored(articles.withColumn("x", F.array_sort(F.array_distinct(tokens(F.col("title"))))), "articles")
    urls = stored(a.groupBy("url").agg(F.min("doc_id").alias("u")), "urls")
    sets = stored(a.where(F.size("x") > 0).groupBy("x").agg(F.min("doc_id").alias("s")).select("s", "x"), "sets")
    tagged = a.join(urls, a["url"].eqNullSafe(urls["url"])).select(a["*"], "u").join(sets, "x", "left")
    tagged = stored(tagged.drop("x"), "tagged")
    near = similar_sets(sets.withColumnRenamed("s", "id"), at_least)
    near = stored(near.select(F.col("a").alias("s"), F.col("b").alias("t")).union(near.select("b", "a")).union(sets.select("s", F.col("s").alias("t"))), "near")
    # one node for each URL and set, named by its first article; state: null undecided, true kept, false merged
    nodes = stored(tagged.groupBy("u", "s").agg(F.min("doc_id").alias("id")).withColumn("kept", F.lit(None).cast("boolean")), "nodes")
    facts = lambda key: nodes.groupBy(key).agg(F.min(F.when(F.col("kept"), F.col("id"))).alias("keeper"), F.min(F.when(F.col("kept").isNull(), F.col("id"))).alias("open"))
    while not nodes.where("kept IS NULL").isEmpty():
        if (rounds := rounds - 1) < 0:
            raise RuntimeError("articles wait for each other in too long a chain")
        by_url, by_set = facts("u"), facts("s").where("s IS NOT NULL").withColumnRenamed("s", "t")
        alike = near.join(by_set, "t").groupBy("s").agg(F.min("keeper").alias("set_keeper"), F.min("open").alias("set_open"))
        seen = nodes.join(by_url, "u").join(alike, "s", "left").withColumns({"first": F.least("keeper", "set_keeper"), "waits": F.least("open", "set_open")})
        kept = F.when(F.col("first") < F.col("id"), False).when(F.col("waits") >= F.col("id"), True)
        nodes = stored(seen.select("u", "s", "id", F.coalesce("kept", kept).alias("kept")), "nodes")
    by_set = facts("s").where("s IS NOT NULL").select(F.col("s").alias("t"), "keeper")
    alike = near.join(by_set, "t").groupBy("s").agg(F.min("keeper").alias("set_keeper"))
    owner = facts("u").select("u", "keeper")
    owned = tagged.join(owner, "u").join(alike, "s", "left").withColumn("owner", F.least("keeper", "set_keeper"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("doc_id"))).alias(c)
    own = lambda c: F.min_by(c, "doc_id").alias(c)
    return owned.groupBy("owner").agg(own("url"), own("title"), first("summary"), first("sentiment"), F.count(F.lit(1)).alias("merged")).withColumnRenamed("owner", "doc_id")
