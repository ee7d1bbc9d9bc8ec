"""Hash embeddings: a fallback encoder that is the same in every process."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

DIMS = 768


def hash_vectors(chunks: DataFrame, dims: int = DIMS, prefix: str = "") -> DataFrame:
    """chunk_id, idx, raw, weight (raw over the vector's norm) of each coordinate that a token falls on."""
    plain = F.lower(F.concat(F.lit(prefix), F.regexp_replace("chunk_text", r"\s+", " ")))
    toks = chunks.select("chunk_id", F.explode(t.found(plain, t.EMBED_TOKEN)).alias("tok"))
    counted = toks.groupBy("chunk_id", "tok").agg(F.count("*").alias("n"))  # each distinct token is hashed once a chunk
    h = t.stable_hash(F.col("tok"))
    sign = F.when(F.floor(h / F.lit(dims)) % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    part = sign * (1 + F.least(F.length("tok"), F.lit(12)) / F.lit(12.0)) * F.col("n")
    cells = counted.select("chunk_id", F.pmod(h, F.lit(dims)).alias("idx"), part.alias("part")).groupBy("chunk_id", "idx").agg(F.sum("part").alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("chunk_id")))
    return cells.withColumn("weight", F.col("raw") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))
