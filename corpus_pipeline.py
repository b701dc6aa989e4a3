"""A training corpus from `documents`: five stages, each over all that the one before kept.

Language identification drops documents without a language; line dedup removes repeated passages
of two or more lines; of near-duplicates one stays; mixing drops and repeats documents to meet the sources'
targets; what is left is encoded, and decoded as a record of the round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import bpe, langid, line_dedup, mixing, simhash
from attesta.llm import common as c


#: Rows of texts or shingles that go to Python at a time, where the session says nothing: at Spark's 10,000 the batches of a task hold 100 MB and more, in its worker and beside the heap.
BATCH_ROWS = "1000"


def _in_small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(name) and spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from a bounded sample of the labels; keeps what has a language, whatever its label says."""
    _in_small_batches(spark)
    model = langid.learn(docs, F.lit(True))
    judged = langid.identify(docs, model)
    # Without any labels nothing can be told, and nothing is dropped.
    keep = F.col(f"{c.OWN}lang") != langid.UNKNOWN if model.languages else F.lit(True)
    return judged.where(keep).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(docs, anywhere=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that operator 4 links by its fingerprints; texts of similarity 0.8 that these miss are linked too."""
    _in_small_batches(spark)
    return simhash.one_of_each(docs, words=5, most_bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, range-sorted by the finish times of their copies."""
    size, key = mixing.sized_documents(docs)
    return mixing.in_order(mixing.mix(docs, size, key)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    _in_small_batches(spark)
    definition = bpe.definition_of(public_tokenizers.path("word_bpe_49k.json"))
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), definition, bpe.word_table(docs, definition), decoded="decoded").drop("text")
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("BPE", encode),
]

#: SQL has no suffix automata, XXH64 or BPE: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, c.written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
        c.drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
