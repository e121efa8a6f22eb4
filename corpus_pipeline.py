"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs.  Toxic documents go, one document of each
near-duplicate group stays, personal data gets pseudonyms, sources are mixed to their
target weights (rows repeat with their epochs), and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import mixing, packing, pii, similar, toxicity
from quern.llm.common import fresh_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the toxicity model scores below 0.5; all their columns stay.

    Null and empty texts get the model's bias alone.  Rows with a null or a repeated doc_id are scored like
    all others; labels of such ids count as ``toxicity.train`` says.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group, then none that shares 0.8 or more of its five-word shingles with another.

    Of a group the row with the least doc_id stays (null ids last, then by a hash of the text), so a row
    without an id, or one that shares its id with another text, is lost only to a copy.  All empty and null
    texts are one group.  All columns stay, and the choice does not depend on the order of rows.
    """
    return similar.keep_dissimilar(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with pseudonyms in ``text``, under the session's key; where it has none, under a secret one that nobody keeps.

    Row for row: nulls, empty texts and repeats stay what they are.  Without a key of the session equal values are linked within
    this run alone and cannot be restored.
    """
    return pii.pseudonymise(docs, pii.session_key(spark) or pii.fresh_key(), spans=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as their source's target takes them, whole; rows without words never.

    Null sources are one source; rows with null ids are ordered by their texts.
    """
    return mixing.mix_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows; null and empty texts are their end id alone, repeated and null ids documents of their own."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii_pseudonyms", replace_personal_data),
    ("source_mixing", mix_sources),
    ("packing", pack),
]

#: No SQL says what the classifier, the fingerprints and the tokenizer do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
