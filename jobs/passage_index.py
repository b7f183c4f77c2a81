"""Job 1: the passages of all source documents, kept up to date as documents arrive.

    python -m jobs.passage_index --documents PATH --output PATH --checkpoint PATH [--config FILE]

A file stream takes the document files that its checkpoint doesn't know yet, and ends when it has taken them. Each batch's documents are
cut into passages as retrieval wants them, and written under the batch's number, by language; a batch that is repeated after a failure
replaces its own folder. A document that is delivered again with the same text isn't cut again; with another text, it is a version of its own,
known by the text's digest. A document without text leaves one row without a passage, so that it is known too. Checkpoint and
output belong together: who starts anew starts both anew.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, settings
from quillspark.operators import retrieve

NAME = "passage_index"
COLUMNS = ["doc_id", "lang", "source", "text_sha256", "chunk_ord", "chunk", "n_chars"]


def passages(docs: DataFrame, chunk_chars: int) -> DataFrame:
    """COLUMNS of each document (doc_id, text, lang, source, text_sha256); one row with a null chunk where there is no text."""
    own = F.struct("doc_id", "lang", "source", "text_sha256")
    cut = retrieve.chunks(docs.select(own.alias("own"), "text"), chunk_chars, "own", "text").withColumnRenamed("source_id", "own")
    bare = docs.where("coalesce(length(text), 0) = 0").select(own.alias("own"), F.lit(None).cast("int").alias("chunk_ord"), F.lit(None).cast("string").alias("chunk"))
    return cut.unionByName(bare).select("own.*", F.col("chunk_ord").cast("long").alias("chunk_ord"), "chunk", F.coalesce(F.length("chunk"), F.lit(0)).cast("long").alias("n_chars"))


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> dict:
    """Adds the passages of new documents to the index; returns what it read and wrote."""
    config = config or settings(NAME)
    done = {"batches": 0, "documents": 0, "new_documents": 0, "passages": 0}
    columns = [f"{expression} AS {name}" for name, expression in config["columns"].items()]

    def write(batch: DataFrame, epoch: int) -> None:
        read, fresh, wrote = Observation(), Observation(), Observation()
        docs = batch.selectExpr(*columns).observe(read, F.count(F.lit(1)).alias("n"))
        docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["doc_id", "text_sha256"])
        if epoch:  # the first batch finds no index
            known = batch.sparkSession.read.parquet(output).where((F.col("epoch") < epoch) & (F.coalesce("chunk_ord", F.lit(0)) == 0)).select(F.col("doc_id").alias("known_id"), F.col("text_sha256").alias("known_sha256"))
            docs = docs.join(known, F.col("doc_id").eqNullSafe(F.col("known_id")) & (F.col("text_sha256") == F.col("known_sha256")), "left_anti")
        out = passages(docs, config["chunk_chars"]).observe(wrote, F.count("chunk").alias("n"), F.count_if(F.coalesce("chunk_ord", F.lit(0)) == 0).alias("docs"))
        language = F.coalesce(F.nullif("lang", F.lit("")), F.lit("und"))
        out.withColumn("language", language).write.mode("overwrite").partitionBy("language").parquet(f"{output}/epoch={epoch}")
        counts = wrote.get
        log.info("batch %d: %d documents read, %d of them new, %d passages written to %s/epoch=%d", epoch, read.get["n"], counts["docs"], counts["n"], output, epoch)
        for name, n in (("batches", 1), ("documents", read.get["n"]), ("new_documents", counts["docs"]), ("passages", counts["n"])):
            done[name] += n

    schema = spark.read.parquet(documents).schema
    either = re.sub(r"([^/])/*$", r"[\1]", documents)  # as a pattern, the path may be that of a folder or of one file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(either)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("read %s: %s", documents, done)
    return done


def index(spark: SparkSession, output: str) -> DataFrame:
    """The whole index as it stands, without the columns that only lay it out."""
    return spark.read.parquet(output).select(*COLUMNS)


if __name__ == "__main__":
    main(NAME, run, {"documents": "folder of Parquet files of documents", "output": "folder of the index", "checkpoint": "folder of the stream's progress"})
