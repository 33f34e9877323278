"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents. SQL cannot express the
learned grammar, XXH64 fingerprints or the tokenizer, so there is no SQL; the
tests hold the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.line_dedup import line_dedup
from millrace.llm.mixing import mix
from millrace.llm.packing import pack_documents
from millrace.llm.simhash import near_dedup
from millrace.llm.toxicity import fit_grammar, score_toxicity
from millrace.runtime import materialize, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the grammar is fitted to the labelled ones among them."""
    grammar = fit_grammar(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, grammar).where("toxic_score < 0.5").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those that lose all their words that way go."""
    left = line_dedup(docs)
    left = left.where("n_dropped = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each SimHash group."""
    return near_dedup(docs)


#: Target weights of a domain, language or source among its siblings: its tokens to this power (1: as they are, 0: equal).
TEMPER = 0.9
#: Epochs a source may be read.
EPOCHS = 2


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Target weights tempered towards small sources, with the least budget that cuts no source's first epoch.

    Clean documents stay: under any smaller budget the target weights would cut
    large sources. So small sources come again, in part, in a second epoch.
    """
    tempered = F.ceil(F.pow(F.col("tokens"), F.lit(TEMPER)))
    return mix(docs, {"domain": tempered, "lang": tempered, "source": tempered}, F.col("cover"), max_epochs=EPOCHS).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a row for each piece, with its ids."""
    return pack_documents(docs, TOKENIZER)


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("simhash near-dedup", near_copies), ("mixing", mixture), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
