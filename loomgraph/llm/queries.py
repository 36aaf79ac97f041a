"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import ann, chat, language, media, pii, secrets, sql, warc
from loomgraph.llm.mixing import mix_sources
from loomgraph.llm.ngram_join import ngram_jaccard_components
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.scratch import Scratch
from loomgraph.llm.spans import base_of, count_of, listed

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the tokenizer of the packing query is installed."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0, keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def span_digests(found: DataFrame, base_kinds: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """Counts of base spans, their digest, and all spans listed."""
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[count_of(spans, k).alias(f"n_{k}") for k in base_kinds],
        F.sha2(listed(base_of(spans), kinds), 256).alias("base_sha256"),
        listed(spans, kinds).alias("spans"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.BASE_KINDS, secrets.KINDS)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(pii.find_personal_data(table(spark, sf_dir, "documents")), pii.KINDS, pii.KINDS)


#: A conversation whose texts are control strings of common templates.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    done = chat.format_conversations(rows.unionByName(extra))
    read = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def source_tree() -> dict:
    """The tree of the mixing queries: four domains, by the number in a source's name."""
    number = F.regexp_extract("source", "[0-9]+", 0).try_cast("int")
    return {"domain": F.concat(F.lit("domain"), (F.coalesce(number, F.lit(0)) % 4).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


#: Weights of the three levels, as SQL over the tree's columns.
TREE_WEIGHTS = [
    "1 + CAST(substring(domain, 7) AS INT)",
    "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END",
    "1 + length(source) % 3",
]


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), source_tree(), TREE_WEIGHTS, budget=(3, 5), epochs=3, seed=17)


def op6_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").root + "/archives"
    warc.write_archives(table(spark, sf_dir, "pages"), path, least_bytes=0)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    profiles = language.fit_profiles(documents.where(~language.held_out()))
    return language.predict_language(documents, profiles).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_payloads(table(spark, sf_dir, "documents"))
    return media.media_features(stored).select("doc_id", "n_bytes", *[c for c in media.FEATURES if c != "tile"])


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_secret_scan, op3_personal_data, op4_chat_format, op5_source_mixing, op6_anisotropic_ann, op7_warc_revisits, op8_language_id, op9_media_columns, op10_ngram_jaccard)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
