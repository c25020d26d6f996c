"""From raw documents to a training mixture: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents. All but the last return the columns of ``documents``; the last
returns (doc_id, source, tokens, pass, place).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontaminate, mixture, neardup, quality, spans
from cairn.session import delete, mark, release, shared_dir

STAGES = [
    ("quality", quality.stage),
    ("neardup", neardup.stage),
    ("spans", spans.stage),
    ("decontaminate", decontaminate.stage),
    ("mixture", mixture.stage),
]

#: The language model and the graph search can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents. Checkpoints of a stage and the documents it read are deleted once it is
    written; the last stage's folder stays, as the result is read from it.

    Defined results: a document of null or empty text goes in the first stage; null doc_ids pass all stages
    but the last; columns of any other name pass all but the last; an empty table gives no rows."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path, start = f"{folder}/{k}-{name}", mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, start)
        if before:
            delete(spark, before)
        before = path
    return docs
