"""A corpus pipeline of the training-data operators.

``STAGES`` names the stages in order; each takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``:

1. quality rules: documents that the rules reject go;
2. language: documents without a letter, or whose best language scores lower
   than nearly every labelled text does under the other half's fit, go (other scripts,
   random letters; a related language may stay);
3. near-duplicates: of each SimHash group the document with the smallest id
   stays, with one row (of several texts under that id the one with the least
   hash; rows without an id cannot be named and all stay);
4. substrings: words under repeated 35-word windows are cut from the texts
   (n_chars follows; documents stay, even if nothing is left of them);
5. packing: token sequences of at most 4096, one row a piece.

Null texts count as empty (stage 1 drops them); an empty table passes through
every stage as an empty table; extra columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from multisvm.llm.common import DOCUMENT_COLUMNS, table, written
from multisvm.llm.language import identify
from multisvm.llm.packing import pack_documents
from multisvm.llm.quality_rules import quality_rules
from multisvm.llm.queries import tokenizer_file
from multisvm.llm.simhash import simhash_groups
from multisvm.llm.substrings import dedup_substrings

def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs.select(DOCUMENT_COLUMNS), out="_quality").where("_quality.kept").select(DOCUMENT_COLUMNS)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = identify(docs.select(DOCUMENT_COLUMNS), out="_language")
    return named.where("_language.accepted").select(DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(DOCUMENT_COLUMNS)
    # a text under an id is in one group, so the least pair names the group and its survivor
    named = docs.where("doc_id is not null").withColumn("_hash", F.xxhash64("text"))
    groups = simhash_groups(named.select(F.struct("doc_id", "_hash").alias("pair"), "text"), id_col="pair")
    first = groups.where("pair = component_id").select("pair.*").distinct()
    kept = named.join(first, ["doc_id", "_hash"], "left_semi").dropDuplicates(["doc_id", "_hash"])
    return kept.select(DOCUMENT_COLUMNS).unionByName(docs.where("doc_id is null"))


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = dedup_substrings(docs.select(DOCUMENT_COLUMNS), out="_removed")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs.select("doc_id", "text"), tokenizer_file())


STAGES = [
    ("quality_rules", keep_quality),
    ("language_id", keep_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_substrings),
    ("best_fit_packing", pack),
]

# Learned languages, fingerprints and token ids are beyond SQL; the tests hold
# the pipeline against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
