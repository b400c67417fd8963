"""Queries of the training-data operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.llm import chat, collocations, decontaminate, hosts, jaccard, lines, merkle, mixing, pii, quality, repeats, secret_scan
from corpusgauge.llm import toxicity as tox
from corpusgauge.llm.oracles import ORACLES
from corpusgauge.session import read_table

#: (host, path, verdict), as the contract of the query states them.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: A made-up key for the query; users pass their own secret.
EXAMPLE_KEY = b"example key of the registered query"


def op1_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    made = chat.format_flat(rows.unionByName(more))
    digests = F.pandas_udf(chat.digests, chat.DIGESTS)
    read = made.select(F.col("tree").alias("conv_id"), digests("formatted", "loss_spans").alias("d"))
    return read.select("conv_id", "d.n_turns", "d.turns_sha256", "d.loss_chars", "d.loss_sha256", "d.formatted_chars")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = repeats.remove_repeats(docs)
    kept = F.length("kept").cast("long")
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - kept).alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op4_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_components(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    left = lines.drop_recurring_lines(docs)
    return left.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), "emptied", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op7_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = tox.toxicity(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.quality_filter(docs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = pii.pseudonymise_table(docs, EXAMPLE_KEY)
    return made.select("doc_id", *[f"n_{k}" for k in pii.KINDS], "text")


def op11_phrase_quicksort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op12_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_model")


def op13_octopus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    cut = F.when(merkle.tampered(F.col("doc_id")), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proved = merkle.verify_copy(docs, ["doc_id", "source", "lang", "n_chars", "text"], copy={"text": cut})
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {f.__name__: f for f in (op1_host_trust, op2_reply_trees, op3_suffix_dedup, op4_parity_jaccard, op5_decontamination, op6_template_lines, op7_factorization_toxicity, op8_adaptive_quality, op9_source_mixing, op10_feistel_pseudonyms, op11_phrase_quicksort, op12_secret_network, op13_octopus_manifest)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
