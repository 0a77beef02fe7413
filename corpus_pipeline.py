"""A pipeline over documents: STAGES in order, each written as Parquet and read again as the next one's input.

All stages take texts of any length whole, columns beside those of documents along, and empty tables; rows with null or
repeated ids are rows of their own. What each does with null texts, ties and repeated rows its docstring says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamga.llm import blocks, bpe, decontam, langid, ngram_join, secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; others go, also null and empty texts. lang labels the texts that the model
    is fitted on and is no evidence; a row without it is judged like the others. Repeated rows share their fate."""
    model = langid.fit_text_model(docs, "lang", "text")
    found = langid.identify(docs, model, "text", host="source")
    return found.where("accepted").select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: of the least id, not null; of rows of one id, or none, the first
    by place. Texts without words are alike to none and stay."""
    return ngram_join.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Null and empty texts hold none; an empty benchmark takes none."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked, n_chars follows; rows without secrets, null texts included, stay as they are.
    Overlapping secrets become one mask."""
    clean = secrets.redact(secrets.scan_secrets(docs))
    return clean.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text; none of a null or empty one."""
    import public_tokenizers as tokenizers

    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", byte_bpe),
]

#: Language models, joins by shingles and tokenizers can't be put in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of documents. Stages are kept in the shared folder."""
    blocks.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            blocks.drop(spark, f"{folder}/{number - 1}")
    return docs
