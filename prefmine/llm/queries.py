"""The registered queries of the operators: ``opN_<name>(spark, sf_dir)``.

Each applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmine.llm import alignment, chat, collocations, kd_shards, maxscore, mixing, packing, pii, quality, simhash, token_counts, url_templates, vectors
from prefmine.llm.common import Scratch
from prefmine.llm.oracle import ORACLE_SQL as ORACLE_SQL, URL_RULES

# Maximum sequence length of a document, in tokens.
TOKEN_LIMIT = 2048
SHARDS = 8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def pii_key(spark: SparkSession) -> str:
    """The pseudonyms' key, a setting of the session; the default is for tests."""
    return spark.conf.get("spark.prefmine.pii.key", "not-a-secret")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                          "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    out = kd_shards.shard_documents(docs, ["n_chars", "lang", "source"], n_shards=SHARDS, keep=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii_key(spark), count="n_found")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies (SimHash components) are one duplicate cluster: they do not share a bin."""
    scratch = Scratch(spark, "op4")
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    prints = scratch.write(simhash.with_fingerprint(docs).select("doc_id", "source", "fingerprint", mixing.word_count("text").alias("n_words")))
    groups = simhash.near_duplicates(prints, k=2).select("fingerprint", "component")
    return packing.pack(prints.join(groups, "fingerprint"), cluster="component", words="n_words")


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.line_first_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                   "n_repeat_words", "base_failed", "kept", "lost_words")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(read(spark, sf_dir, "documents"), keep=["doc_id"])
    p = p.select("kept.doc_id", "size", "source_size", "target", "taken", "copies",
                 F.get("positions", F.lit(0)).alias("at"), "place_in_source")
    # In training order; documents that are not taken come after, by their place.
    order = F.coalesce("at", 1 + F.col("place_in_source"))
    return (p.repartitionByRange(order).sortWithinPartitions(order)
            .withColumn("first_position", F.round("at", 9)).drop("at", "place_in_source"))


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, a quarter of the speakers (by a hash of conversation and turn) hidden from the
    operator: ``hidden`` marks them, ``given`` is the table's role, ``accuracy`` the share of hidden rows
    whose role came back."""
    turns = read(spark, sf_dir, "conversations")
    hidden = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0
    asked = turns.select("conv_id", "turn", F.when(~hidden, F.col("role")).alias("speaker"), "text", F.col("role").alias("given"), hidden.alias("hidden"))
    out = Scratch(spark, "op8").write(chat.format_chat(asked, speaker="speaker", keep=("given", "hidden")))
    right = out.where("hidden AND part = 0").agg(F.avg((F.col("role") == F.col("given")).cast("double"))).first()[0]
    return out.withColumn("accuracy", F.round(F.lit(right).cast("double"), 6))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op9")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    prints = scratch.write(simhash.with_fingerprint(docs).select("doc_id", "fingerprint"))
    groups = simhash.near_duplicates(prints, k=2)
    return prints.join(groups, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's path names its document by number; the page is bad if the document is
    labelled as of low quality or toxic, and unlabelled if the document is."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    named = pages.withColumn("names", F.regexp_extract(url_templates.path_of(F.col("url")), r"/(\d{1,18})(?:\.[A-Za-z]+)?/?$", 1))
    named = named.withColumn("names", F.when(F.col("names") != "", F.col("names").cast("long")))
    labelled = named.join(labels, named.names == labels.doc_id, "left").select("page_id", "url", "bad")
    return url_templates.filter_urls(Scratch(spark, "op10").write(labelled), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "template", F.round("bad_share", 9).alias("bad_share"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), min_count=30, top=2000)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    aligned, _ = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.near_vectors(table, threshold=0.95).select("vec_id", "n_links", "component_id", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_kd_shards": op2_kd_shards,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_packing": op4_packing,
    "op5_line_quality": op5_line_quality,
    "op6_mixing": op6_mixing,
    "op7_maxscore": op7_maxscore,
    "op8_chat": op8_chat,
    "op9_simhash": op9_simhash,
    "op10_url_templates": op10_url_templates,
    "op11_collocations": op11_collocations,
    "op12_alignment": op12_alignment,
    "op13_vector_dedup": op13_vector_dedup,
}
