"""The numbered operators as queries over their whole tables, and their SQL twins where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.llm import chat, licenses, line_dedup, mixing, repair
from pulsegrid.llm.common import read
from pulsegrid.llm.decontaminate import contaminated
from pulsegrid.llm.minhash import near_duplicates
from pulsegrid.llm.packing import pack
from pulsegrid.llm.pii import surrogates
from pulsegrid.llm.quality import quality_rules
from pulsegrid.llm.tokens import token_counts
from pulsegrid.llm.toxicity import toxicity
from pulsegrid.llm.whitening import whiten


def op1_line_dedup(spark, sf_dir):
    done = line_dedup.line_dedup(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op2_decontamination(spark, sf_dir):
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_pii_surrogates(spark, sf_dir):
    done = surrogates(read(spark, sf_dir, "documents"), key="pulsegrid")
    return done.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.transform("entities", lambda e: e["k"]), " ").alias("kinds"), "text")


def op4_quality_rules(spark, sf_dir):
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_license_scan(spark, sf_dir):
    found = licenses.license_scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("licences", F.array_join("licences", " ")).withColumn("best_dice", F.round("best_dice", 6))


def op6_mixing(spark, sf_dir):
    labels = mixing.label_domains(read(spark, sf_dir, "labels"))
    return mixing.mix(read(spark, sf_dir, "documents"), labels, {"clean": 0.93, "toxic": 0.02, "junk": 0.05})


def op7_tool_calls(spark, sf_dir):
    calls, results = chat.dialogue_calls(read(spark, sf_dir, "conversations"))
    return chat.link_calls(calls, results, {"respond": chat.RESPOND})


def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op9_toxicity(spark, sf_dir):
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op12_structure_repair(spark, sf_dir):
    conversations = read(spark, sf_dir, "conversations")
    return repair.report(conversations, repair.damaged(conversations))


def op13_whitening(spark, sf_dir):
    return whiten(read(spark, sf_dir, "embeddings"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql():
    return {"op1_line_dedup": line_dedup.ORACLE, "op5_license_scan": licenses.oracle()}
