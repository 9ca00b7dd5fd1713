"""A corpus pipeline made of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the last returns token
ids and the digest of what they decode to, the others rows with the columns of ``documents``. Labels come from ``sf_dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from snapledger.llm import bpe, jaccard, linededup, mixing, toxicity
from snapledger.llm.common import shared_folder, table


def drop_toxic(spark, docs, sf_dir):
    """Documents scored toxic go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def dedup_lines(spark, docs, sf_dir):
    """Passages that repeat go, but for their first place; documents made of nothing else go with them."""
    return linededup.cleaned(docs)


def join_similar(spark, docs, sf_dir):
    """One document of each group of similar ones stays."""
    return jaccard.representatives(docs)


def mix_sources(spark, docs, sf_dir):
    """Sources are brought to their targets: a document comes as often as the mix takes it."""
    mixed = mixing.mix(docs).filter("mix_copies > 0")
    copies = F.explode(F.array_repeat(F.lit(1), F.col("mix_copies").cast("int")))
    return mixed.select(*docs.columns, copies.alias("mix_copy")).drop("mix_copy")


def encode_bytes(spark, docs, sf_dir):
    """Token ids of every document, and the SHA-256 of the bytes decoded from them."""
    coded = bpe.encode(docs, decoded=True)
    return coded.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_similar),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: Language models and content-defined chunks have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; what a stage keeps is written to the shared folder as Parquet before the next one reads it."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
