"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

toxicity rejects documents; line dedup cuts repeated chunks out of texts; near dedup keeps one document of each
group; mixing takes words of each source near its target; packing cuts what is left into pieces with
bucket, batch and slot. All but the last return the columns of ``documents``.
"""

import os
import uuid

from pyspark.sql import functions as F

from loomwork.llm import _shared as S
from loomwork.llm import line_chunks, lsh_forest, mixing, packing, toxicity


def _documents(docs):
    return docs.select(*[c for c in S.DOCUMENT_COLUMNS if c in docs.columns])


def reject_toxic(spark, docs, sf_dir):
    return toxicity.reject_toxic(_documents(docs), S.table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark, docs, sf_dir):
    """Texts less their repeated chunks; ``n_chars`` is renewed. Documents stay, also with an empty text."""
    out = line_chunks.drop_repeated_chunks(_documents(docs)).drop("n_lines", "n_removed")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def drop_near_duplicates(spark, docs, sf_dir):
    """Links are pairs of five-word shingle sets at a similarity of 0.8 and over; the query op1 has a threshold of its own."""
    return lsh_forest.keep_one(_documents(docs), share=80)


def mix_sources(spark, docs, sf_dir):
    return mixing.take(_documents(docs))


def pack(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Fitting a classifier and dynamic programming aren't SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, each one's result written under the checkpoint folder and read back as the next one's documents."""
    S.ensure_checkpoint_dir(spark)
    base = os.path.join(spark.sparkContext.getCheckpointDir(), f"pipeline-{uuid.uuid4().hex}")
    docs = S.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
