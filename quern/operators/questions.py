"""Questions that need two hops in a graph, drawn under quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.retrieval import best

#: Questions of each stratum, of so many asked for (fixed values), and questions of one seed and relation at most.
SHARES = {"HARD": 0.5, "MED": 0.3, "CTRL": 0.2}
PER_SEED = 3


def draw_key(seed: int, *parts: Column) -> Column:
    """A question's place in the draw: MD5 of its parts and the seed, so that no order or partition of rows matters."""
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def multihop_questions(bridges: DataFrame, topics: DataFrame, wanted: int, seed: int = 7, stop: tuple[str, ...] = (), least_chars: int = 3, per_seed: int = PER_SEED) -> DataFrame:
    """(stratum, place, seed_id, relation, target, topic, question, key): questions over ``bridges`` (subject, relation, object) and ``topics`` (entity, topic).

    A bridge leads from a seed to a target, and the question asks for a topic of the target's.  It is HARD if the seed has not this topic itself, MED if it has; questions for a seed's own
    topics are CTRL.  Topics that are short or stop words give none, and topics that differ in case or outer blanks are one.  Of a seed's
    relation the first ``per_seed`` by key are kept, and of a stratum its share of ``wanted``: a topic that very many entities have meets bridges by joins on
    the entity alone, and ranks drop rows before the shuffle.
    """
    topic = F.lower(F.trim("topic"))
    own = topics.where((F.length(topic) >= least_chars) & ~topic.isin(*stop) if stop else F.length(topic) >= least_chars).select("entity", topic.alias("topic")).distinct()
    paths = bridges.where("subject <> object").select(F.col("subject").alias("seed_id"), "relation", F.col("object").alias("target")).distinct()
    asked = paths.join(own.withColumnRenamed("entity", "target"), "target")
    has = own.select(F.col("entity").alias("seed_id"), "topic", F.lit(True).alias("has"))
    asked = asked.join(has, ["seed_id", "topic"], "left").withColumn("stratum", F.when(F.col("has"), "MED").otherwise("HARD"))
    text = F.concat(F.lit("What does the company that "), "seed_id", F.lit(" "), F.translate("relation", "_", " "), F.lit(" disclose about "), "topic", F.lit(" in its own filings?"))
    asked = asked.select("seed_id", "relation", "target", "topic", "stratum", text.alias("question"))
    control = own.select(F.col("entity").alias("seed_id"), F.lit("").alias("relation"), F.col("entity").alias("target"), "topic", F.lit("CTRL").alias("stratum"))
    control = control.withColumn("question", F.concat(F.lit("What does "), "seed_id", F.lit(" disclose about "), "topic", F.lit("?")))
    everything = asked.unionByName(control).withColumn("key", draw_key(seed, F.col("seed_id"), F.col("relation"), F.col("target"), F.col("topic")))
    capped = best(everything, ["seed_id", "relation"], per_seed, F.col("key")).drop("rank")
    quota = F.coalesce(*(F.when(F.col("stratum") == s, F.lit(round(share * wanted))) for s, share in SHARES.items()))
    drawn = best(capped, ["stratum"], max(round(share * wanted) for share in SHARES.values()), F.col("key")).where(F.col("rank") <= quota)
    return drawn.select("stratum", F.col("rank").alias("place"), "seed_id", "relation", "target", "topic", "question", "key")
