"""The training-data pipeline: stages over documents, each written and reread as the next one's input.

Toxic documents go, one document of each group of near duplicates stays (the one
with the smallest doc_id), documents that hold a benchmark item go, sources are
mixed to target weights (documents repeated or left out), and what remains is
written as token ids, of which the last stage returns a digest per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import toxicity
from strataline.llm.decontam import remove_contaminated
from strataline.llm.mixing import mix_documents
from strataline.llm.ngramjoin import ngram_components
from strataline.llm.queries import byte_bpe
from strataline.llm.runtime import durable, table
from strataline.llm.tokens import read_digests, tokenise


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled rows of the input; documents scored 0.5 or more go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), folds=None)
    return toxicity.reject_toxic(docs, model)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked rows one stays: the one with the smallest doc_id, null last.

    Rows are told apart by doc_id and text; of rows that repeat both, one stays.  Texts
    without words link with nothing, so that those with a null doc_id all stay.
    """
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    found = ngram_components(rows.select(F.col("__row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "__row")
    named = durable(found.join(rows.groupBy("__row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "__row").distinct(), "pipeline-rows")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__row")).alias("best"))
    gone = durable(named.filter("n_shingles > 0").join(best, "component_id").filter("__row <> best.__row").select("__row"), "pipeline-gone")
    kept = rows.join(gone, "__row", "left_anti")
    again = durable(named.filter("copies > 1 and (n_shingles > 0 or doc_id is not null)").select("__row"), "pipeline-again")
    if not again.isEmpty():
        kept = kept.join(again, "__row", "left_anti").unionByName(kept.join(again, "__row", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(docs.columns)


def remove_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold an item of ``benchmark`` go, each by its own text; null and empty texts stay, whatever their doc_id."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated (at most 3 times) or left out, so that sources come near their targets; a null source is one of
    them, rows with a null doc_id are mixed like others, and texts without words weigh nothing."""
    return mix_documents(docs, weights=(1, 2, 3), most=3)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A digest per row, read back from the files; null texts have the end id only, null doc_ids come first."""
    stored, _ = tokenise(docs, byte_bpe(), end=0, label="pipeline-tokens")
    return read_digests(stored)


#: (name, function(spark, docs, sf_dir) -> DataFrame), in order.
STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", keep_one_of_near_duplicates),
    ("decontamination", remove_benchmark_documents),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: The stages learn, embed and write files, for which there is no SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
