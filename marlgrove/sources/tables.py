"""The tables that queries read, under the names of the document model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Section labels dealt to test documents by their number.
LABELS = "abstract introduction methodology results discussion conclusion related_work experiments appendix references".split()


#: Tables of texts, whose rows take time each, and the column that deals them.
TEXTS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One of texts that is scanned in fewer tasks than the cluster runs at once (a small one of one file) is dealt over all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    if name in TEXTS and df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores, TEXTS[name])
    return df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: chunk_id, paper_id (its source), chunk_index, chunk_text, label."""
    docs = table(spark, sf_dir, "documents")
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.pmod("doc_id", F.lit(len(LABELS))) + 1).cast("int"))
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("paper_id"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("chunk_text"), label.alias("label"), "lang")


#: The same as SQL, for use as a common table expression named chunks.
CHUNKS_SQL = "chunks AS (SELECT doc_id AS chunk_id, source AS paper_id, doc_id AS chunk_index, text AS chunk_text, (['" + "','".join(LABELS) + f"'])[(doc_id % {len(LABELS)}) + 1] AS label, lang FROM documents)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents cut at line ends: paper_id (its doc_id), ord from 0, line."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("ord", "line"))


LINES_SQL = "lines AS (SELECT doc_id AS paper_id, unnest(range(len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS line FROM documents)"
