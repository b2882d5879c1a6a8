"""A corpus pipeline over documents: quality rules, line dedup, near dedup, decontamination and mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
what a stage returns and reads it again as the next one's docs.  All stages but
the last return the columns of documents; the last adds each document's domain
and rate.  Where a stage rejects documents by id, all rows of the id go, and
rows with a null id, which no id tells apart, stay.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.llm.common import by_ids, materialise, read
from pulsegrid.llm.decontaminate import decontaminate
from pulsegrid.llm.line_dedup import line_dedup
from pulsegrid.llm.minhash import near_duplicates
from pulsegrid.llm.mixing import label_domains, mix
from pulsegrid.llm.quality import quality_rules

#: Shares of tokens that the rates aim at.
TARGETS = {"clean": 0.93, "toxic": 0.02, "junk": 0.05}


def quality(spark, docs, sf_dir):
    """Documents that the quality rules reject go (4)."""
    judged = quality_rules(docs, read(spark, sf_dir, "labels"))
    return by_ids(docs, judged.where("not kept"), "left_anti").select(docs.columns)


def lines(spark, docs, sf_dir):
    """Later occurrences of repeated three-line windows go, and n_chars follows (1)."""
    done = line_dedup(docs).select(docs.columns)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def near(spark, docs, sf_dir):
    """One document of each group of near duplicates stays, that with the smallest id (10)."""
    return by_ids(docs, near_duplicates(docs).where("not kept"), "left_anti").select(docs.columns)


def benchmark(spark, docs, sf_dir):
    """Documents that contain a test item go (2)."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark")).select(docs.columns)


def mixture(spark, docs, sf_dir):
    """Every document gets its domain and the rate that meets the target weights (6)."""
    return mix(docs, label_domains(read(spark, sf_dir, "labels")), TARGETS, keep=docs.columns).drop("n_tokens", "posteriors")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", near),
    ("decontamination", benchmark),
    ("mixing", mixture),
]
#: Calibrated bounds, components and fitted weights have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages applied to the documents table, one after the other."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
