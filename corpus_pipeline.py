"""A corpus pipeline of five operators: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.language import fit_profiles, held_out, keep_identified
from loomgraph.llm.mixing import mix_documents
from loomgraph.llm.ngram_join import ngram_jaccard_components
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.pii import redact_personal_data
from loomgraph.llm.prefilter import without_ids
from loomgraph.llm.queries import TREE_WEIGHTS, source_tree, tokenizer_path
from loomgraph.llm.scratch import Scratch

#: Documents whose best language cosine is below this are rejected, unless they are too short to tell.
LEAST_SCORE = 0.1
#: Share of the tokens left that the mixture may take, as a fraction.
MIX_BUDGET = (4, 5)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts that no learned language resembles."""
    return keep_identified(docs, fit_profiles(docs.where(~held_out())), LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest id.

    Five-word shingles and a similarity of 0.8 or more.  Rows that repeat a kept id stay.  The list of
    dropped ids has no bound, so it is never broadcast: a bitmap of fixed size tells which documents
    cannot be in it, and only the others are shuffled.
    """
    linked = ngram_jaccard_components(docs, words=5, percent=80)
    gone = Scratch(spark, "pipeline").write("gone", linked.where("component_id <> doc_id").select("doc_id").distinct())
    return without_ids(docs, gone, "doc_id")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by their kind."""
    done = redact_personal_data(docs)
    return done.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the budget of each source takes in one epoch."""
    return mix_documents(docs, source_tree(), TREE_WEIGHTS, budget=MIX_BUDGET, seed=17)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 2048 ids."""
    packed = pack_documents(docs, tokenizer_path(), capacity=2048, end_id=0, keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", redact),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: SQL cannot express the language, PII and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again for the next."""
    scratch = Scratch(spark, "run")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(f"stage-{k}", docs)
            scratch.keep(f"stage-{k}")
    return docs
