"""Requests and their parts: symbol lists, query expressions, scoped questions, caps, checked triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import core_name, slug

#: Symbols that one comparison takes.
MOST_SYMBOLS = 6
#: Words that open the topic of a bridging question, in order of precedence (fixed values).
TOPIC_CUES = ("discloses", "disclose", "warns about", "warns of", "warn about", "mentions", "reports", "describes", "flags")
#: What closes a question and says nothing of its topic (fixed value: which words are cut decides the scoped query).
TOPIC_TAIL = r"\s+in (?:its|their) own (?:sec )?filings\b.*$|\s*[?.]+\s*$"
#: Kind of object that each relation has (fixed values).
OBJECT_KINDS = {"depends_on": "company", "competes_with": "company", "mentions_risk": "risk", "exposed_to": "regulatory_topic"}


def symbol_list(raw: Column) -> Column:
    """array<string> of a comma list: upper case, no blanks, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(F.split(raw, ","), lambda x: F.upper(F.trim(x))), lambda x: x != ""))


def any_of(terms: Column) -> Column:
    """Terms joined by OR; those with a space are quoted, two or more are put in brackets.  No terms: an empty text."""
    joined = F.array_join(F.transform(terms, lambda t: F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)), " OR ")
    return F.when(F.size(terms) > 1, F.concat(F.lit("("), joined, F.lit(")"))).otherwise(joined)


def alias_pattern(aliases: Column) -> Column:
    """One pattern with word bounds for an array of names: the longest first, ties by name, special characters escaped."""
    names = F.array_sort(F.transform(F.array_distinct(aliases), lambda a: F.struct((-F.char_length(a)).alias("n"), F.lower(a).alias("a"))))
    escaped = F.transform(names, lambda x: F.regexp_replace(x["a"], r"([\\.^$*+?()\[\]{}|])", r"\\$1"))
    return F.concat(F.lit(r"\b("), F.array_join(escaped, "|"), F.lit(r")\b"))


def section_code(label: Column) -> Column:
    """The item code of a section's label in lower case; codes with decimals belong to another form and give NULL."""
    code = F.regexp_extract(label, r"(?i)\bitem\s+(\d{1,2}[a-z]?)\b(?!\.\d)", 1)
    return F.lower(F.when(code != "", code))


def topic_query(question: Column, bridging: Column, name: Column) -> Column:
    """What to ask of a company that was met on the way: its name and the topic of a bridging question, or the whole question."""
    low = F.lower(question)
    found = []
    for cue in TOPIC_CUES:
        at = F.locate(f" {cue} ", low)
        topic = F.trim(F.regexp_replace(F.substring(question, at + len(cue) + 2, F.char_length(question)), f"(?i){TOPIC_TAIL}", ""))
        found.append(F.when(bridging & (at > 0) & (topic != ""), topic))
    return F.concat(name, F.lit(" "), F.coalesce(*found, question))


def evidence_cap(rule: Column, n_union: Column, n_branches: Column, most: int = 14, top: int = 3, each: int = 3) -> Column:
    """Chunks that a step may hold: a seat for each branch, or the best branches' share, or the flat cap."""
    wide, narrow = F.greatest(F.lit(most), n_union + n_branches), F.least(F.lit(most), n_union + top * each)
    return F.when(rule == "breadth_first", wide).when(rule == "top_branches", narrow).otherwise(F.lit(most))


def checked_triples(triples: DataFrame, least: float = 0.5) -> DataFrame:
    """Edges of raw triples (seq, subject, relation, object, chunk_text, confidence) that hold up.

    The relation is known, the chunk is there (its text is not NULL), the confidence, clipped to [0, 1] and 1
    where it is missing, reaches ``least``, and a company is not its own subject and is
    named in the chunk by its core name of three letters or more.  The last of equal edges wins.
    """
    kinds = F.create_map(*(F.lit(x) for kv in OBJECT_KINDS.items() for x in kv))
    core = core_name(F.col("object"))
    t = triples.withColumn("kind", kinds[F.col("relation")]).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0)))))
    text = F.concat(F.lit(" "), F.regexp_replace(F.lower("chunk_text"), "[^a-z0-9]+", " "), F.lit(" "))
    named = (F.char_length(core) >= 3) & F.contains(text, F.concat(F.lit(" "), core, F.lit(" "))) & (core != core_name(F.col("subject")))
    t = t.where(F.col("kind").isNotNull() & F.col("chunk_text").isNotNull() & (F.trim("object") != "") & (F.col("confidence") >= least) & ((F.col("kind") != "company") | named))
    t = t.withColumn("object_id", F.when(F.col("kind") == "company", slug(core)).otherwise(slug(F.col("object")))).where("object_id <> ''")
    last = F.max_by(F.struct("seq", "confidence"), "seq")
    return t.groupBy("subject", "relation", "object_id").agg(last.alias("x"), F.count(F.lit(1)).alias("n")).select("subject", "relation", "object_id", F.col("x.confidence").alias("confidence"), "n", F.col("x.seq").alias("seq"))


def masked_softmax(logits: Column, legal: Column) -> Column:
    """Probabilities of an array of logits; illegal places have 0.  No legal place: NULL."""
    kept = F.zip_with(logits, legal, lambda x, ok: F.when(ok, x))
    top = F.array_max(kept)
    e = F.transform(kept, lambda x: F.coalesce(F.exp(x - top), F.lit(0.0)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.when(top.isNotNull(), F.transform(e, lambda x: x / total))


def first_with_rows(wanted: DataFrame, sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Each of the ``wanted`` keys (unique) with all rows, ``provider`` beside them, of the first of ``sources`` that has any for it.

    Sources are asked in their order and share their columns; an empty answer falls through to the next, and no two are mixed.  A key that
    none answers is one row of NULLs.  Sources are scanned once, and only keys with their first source's number are joined to the rows.
    """
    rows = None
    for rank, (name, source) in enumerate(sources.items()):
        one = source.withColumns({"provider": F.lit(name), "provider_rank": F.lit(rank)})
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy(key).agg(F.min("provider_rank").alias("provider_rank"))
    asked = wanted.select(key).join(first, key, "left")
    return asked.join(rows, [key, "provider_rank"], "left").drop("provider_rank")


def merged_by_priority(rows: DataFrame, keys: list[str], provider: Column) -> DataFrame:
    """For each key the rows of its first provider that has any."""
    first = Window.partitionBy(*keys)
    return rows.withColumn("provider_rank", provider).withColumn("__first", F.min("provider_rank").over(first)).where("provider_rank = __first").drop("__first")
