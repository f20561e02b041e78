"""Training-corpus pipeline: from raw documents to packed sequences.

    toxicity          documents that the model calls toxic go
    near_duplicates   one document of each group of near copies stays
    decontamination   documents that hold a benchmark item, or a paraphrase of one, go
    secrets           secrets in the texts are masked
    packing           the rest is tokenized and packed into sequences

Each stage reads all that the one before kept, as a stored table.  All but the last
return the columns of ``documents``.  Documents with NULL or empty text are neither toxic
nor copies nor contaminated and are packed as one closing token; other columns may
be NULL and further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.llm import decontamination as D
from tillstar.llm import jaccard_join, packing, secrets
from tillstar.llm import toxicity as X
from tillstar.llm.common import stored, table


def _numbered(docs: DataFrame) -> DataFrame:
    """The columns under numbers, and the text as ``text``, so that no other column's name can clash."""
    return docs.select(*[F.col(c).alias("text" if c == "text" else f"column_{k}") for k, c in enumerate(docs.columns)])


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("text" if c == "text" else f"column_{k}").alias(c) for k, c in enumerate(docs.columns)])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = X.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return _named(X.score(_numbered(docs), model).where("predicted = 0"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = D.find_contamination(_numbered(docs), table(spark, sf_dir, "benchmark"))
    return _named(found.where(F.size("contamination") == 0), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.mask_secrets(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, *packing.vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", mask_secrets),
    ("packing", pack),
]

# The learned lexicon, the latent search and the tokenizer are beyond SQL; tests/llm/test_pipeline.py
# compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
