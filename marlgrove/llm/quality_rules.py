"""Quality rules whose thresholds come from quantile sketches per language and source.

One pass measures every whole text. The measures are counted on a logarithmic grid (each step 2 %
wide) per language, source and measure; such counts are a quantile sketch that merges by addition,
whose quantiles are right to within 1 % of the value at any size, and that doesn't depend on the order
of rows. A group's cut for a measure lies ``SPREAD`` times the group's spread above its median. The
spread is read below the median (from there down to the quantile ``LOWER``), which junk of up to four
tenths of a group can't move. A measure of which half the group has nothing has no spread there; it takes
that from the median to the quantile ``UPPER``, of the middle one of the language's groups (each with the
same say, so that junk in some sources, however large, doesn't set it), or, if that is 0, of all groups. Nothing is
fixed beforehand but what counts can't tell from chance: a document fails a measure if its count is
over cut * size + ``CHANCE``.

Groups of fewer than ``LEAST`` documents take their language's cut, and languages of fewer the whole
corpus's, from sums of the same counts. A group's cut goes to ``LOOSEST`` times its language's at
most, so a group that is mostly junk is judged by its language.

Defined results: null text counts as empty and fails the base rule, as does any text of under 10
words; null languages and sources are groups of their own; repeated rows are kept alike; texts of any
length are measured whole; an empty table gives no rows; other columns are carried by ``filter_docs``
and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _SPACE, boxed, flat, gram_hashes, mix, powers, scratch, slices, unboxed, word_hashes, words

#: Width of the grid's steps.
GAMMA = 1.02
#: Documents that a group needs for cuts of its own.
LEAST = 200
LOWER, UPPER = 0.1, 0.9
SPREAD = 8.0
LOOSEST = 2.0
#: Measures: count, what it is a share of, and by how much chance may raise the count.
MEASURES = {
    "symbol_rate": ("n_symbols", "n_words", 4),
    "word_length": ("word_chars", "n_words", 4),
    "dup_line_rate": ("n_dup_lines", "n_lines", 4),
    "repeat_rate": ("n_repeat_words", "n_words", 10),
    "echo_rate": ("n_echo_words", "n_words", 4),
}

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _per_row(hit: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(hit)))
    return (total[at[1:]] - total[at[:-1]]).astype(np.int64)


def _by_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(h + row.astype(np.uint64) * powers(3)[2])


def measure(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each row's text."""
    rows = at.size - 1
    space = _SPACE[data]
    starts, ends, row = words(data, at)
    out = {"n_words": np.bincount(row, minlength=rows).astype(np.int64), "word_chars": _per_row(~space & ((data & 0xC0) != 0x80), at), "n_symbols": _per_row(_SYMBOLS[data], at)}
    # Lines with a word.
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate((at[:-1], breaks + 1)), kind="stable")
    owner = np.searchsorted(at, begin, side="right") - 1
    inside = begin < data.size
    begin, owner = begin[inside], owner[inside]
    begin, first = np.unique(begin, return_index=True)
    owner = owner[first]
    stop = np.append(begin[1:], data.size)
    stop = stop - (data[np.maximum(stop - 1, 0)] == 10)
    letters = np.concatenate(([0], np.cumsum(~space)))
    full = letters[stop] > letters[begin] if begin.size else np.zeros(0, bool)
    begin, stop, owner = begin[full], stop[full], owner[full]
    lines = np.bincount(owner, minlength=rows)
    _, kept = np.unique(_by_row(word_hashes(data, begin, stop), owner), return_index=True)
    out["n_lines"] = lines.astype(np.int64)
    out["n_dup_lines"] = (lines - np.bincount(owner[kept], minlength=rows)).astype(np.int64)
    # Words in five-word windows that the text has twice or more.
    h = word_hashes(data, starts, ends)
    grams = gram_hashes(h, 5)
    hit = np.zeros(row.size, dtype=bool)
    if grams.size:
        whole = np.flatnonzero(row[: grams.size] == row[4:])
        key = _by_row(grams[whole], row[whole])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(whole.size, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(5):
            hit[whole[twice] + k] = True
    out["n_repeat_words"] = np.bincount(row[hit], minlength=rows).astype(np.int64)
    # Words that say the word before again.
    out["n_echo_words"] = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=rows).astype(np.int64)
    return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_echo_words")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = measure(*flat(batch.column("text")))
            yield pa.record_batch({k: batch.column(k) for k in ("doc_id", "lang", "source")} | {k: pa.array(got[k], pa.int64()) for k in _COUNTS})

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{k} long" for k in _COUNTS))


def _rates() -> dict[str, Column]:
    return {k: F.when(F.col(n) > 0, F.col(c) / F.col(n)).otherwise(0.0) for k, (c, n, _) in MEASURES.items()}


def sketches(measured: DataFrame) -> DataFrame:
    """Counts on the grid per language, source and measure; step null stands for 0."""
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in _rates().items()])).alias("m")
    step = F.when(F.col("m.value") > 0, F.ceil(F.log(F.col("m.value")) / float(np.log(GAMMA))))
    return measured.filter("n_words > 0").select("lang", "source", value).groupBy("lang", "source", F.col("m.measure").alias("measure"), step.alias("step")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Median, upper and lower quantile of each measure in each group of keys, from merged sketches."""
    merged = sketch.groupBy(*keys, "measure", "step").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    running = merged.withColumn("upto", F.sum("n").over(group.orderBy(F.col("step").asc_nulls_first()))).withColumn("size", F.sum("n").over(group))
    value = F.when(F.col("step").isNull(), 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("step").cast("double")) * (2 / (GAMMA + 1)))
    reach = lambda q: F.min(F.when(F.col("upto") >= F.lit(q) * F.col("size"), value))
    return running.groupBy(*keys, "measure").agg(reach(0.5).alias("mid"), reach(UPPER).alias("high"), reach(LOWER).alias("low"), F.max("size").alias("size"))


def cuts(sketch: DataFrame) -> DataFrame:
    """The cut of each measure for each language and source, and where it is from."""
    fine, coarse, whole = (quantiles(sketch, keys) for keys in (["lang", "source"], ["lang"], []))
    rename = lambda df, tag: df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns])
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN f_size >= %d THEN f_high - f_mid END)" % LEAST).alias("wide")
    fine = rename(fine, "f")
    coarse = rename(coarse, "c").join(rename(fine.groupBy(F.col("f_lang").alias("lang"), F.col("f_measure").alias("measure")).agg(middle), "cw"), F.col("c_lang").eqNullSafe(F.col("cw_lang")) & (F.col("c_measure") == F.col("cw_measure")), "left")
    whole = rename(whole, "a").join(rename(fine.groupBy(F.col("f_measure").alias("measure")).agg(middle), "aw"), F.col("a_measure") == F.col("aw_measure"), "left")
    # whole is one row a measure.
    rows = fine.join(coarse, F.col("f_lang").eqNullSafe(F.col("c_lang")) & (F.col("f_measure") == F.col("c_measure"))).join(F.broadcast(whole), F.col("f_measure") == F.col("a_measure"))
    wide = F.coalesce(F.nullif("cw_wide", F.lit(0.0)), "aw_wide", F.col("a_high") - F.col("a_mid"))
    cut = lambda tag: F.col(f"{tag}_mid") + SPREAD * F.when(F.col(f"{tag}_mid") > F.col(f"{tag}_low"), F.col(f"{tag}_mid") - F.col(f"{tag}_low")).otherwise(wide)
    own, lang = F.col("f_size") >= LEAST, F.col("c_size") >= LEAST
    bound = F.when(lang & (cut("c") > 0), F.least(cut("f"), LOOSEST * cut("c"))).otherwise(cut("f"))
    level = F.when(own, "source").when(lang, "language").otherwise("corpus")
    return rows.select("f_lang", "f_source", F.col("f_measure").alias("measure"), F.when(own, bound).when(lang, cut("c")).otherwise(cut("a")).alias("cut"), level.alias("level"))


def limits(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The counts of all documents, and one row of cuts per language and source.

    Both are written to the shared folder: the measures are taken once, and Spark knows the size of the
    cuts, which it broadcasts or, beyond its limit for that, joins by a shuffle whose skew it splits."""
    spark, at = docs.sparkSession, scratch(docs.sparkSession)
    measures(docs).write.parquet(f"{at}/measures")
    measured = spark.read.parquet(f"{at}/measures")
    sketches(measured).write.parquet(f"{at}/sketches")
    rows = cuts(spark.read.parquet(f"{at}/sketches")).groupBy("f_lang", "f_source").agg(*[F.max(F.when(F.col("measure") == k, F.col("cut"))).alias(f"max_{k}") for k in MEASURES])
    rows.write.parquet(f"{at}/limits")
    return measured, spark.read.parquet(f"{at}/limits")


def _verdict(measured: DataFrame, rows: DataFrame) -> DataFrame:
    joined = measured.join(rows, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    failed = (F.col("__n_words") < 10) | (100 * F.col("__n_repeat_words") > 20 * F.col("__n_words"))
    within = F.lit(True)
    for k, (count, size, chance) in MEASURES.items():
        within = within & (F.col(f"__{count}") <= F.col(f"max_{k}") * F.col(f"__{size}") + F.lit(float(chance)))
    return joined.withColumn("__failed", failed).withColumn("__kept", ~failed & F.coalesce(within, F.lit(False)))


def judge(docs: DataFrame) -> DataFrame:
    """Every document with its counts, base_failed and kept."""
    measured, rows = limits(docs)
    judged = _verdict(measured.select("doc_id", "lang", "source", *[F.col(k).alias(f"__{k}") for k in _COUNTS]), rows)
    return judged.select("doc_id", *[F.col(f"__{k}").alias(k) for k in _COUNTS[:3] + _COUNTS[4:6]], F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"))


def filter_docs(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns. Texts aren't shuffled: they are measured again beside their thresholds."""
    _, rows = limits(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "doc.text"):
            got = measure(*flat(batch.column("doc").field("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(got[k], pa.int64()) for k in _COUNTS]], [*batch.schema.names, *[f"__{k}" for k in _COUNTS]])

    held = docs.select(boxed(docs), "lang", "source")
    schema = T.StructType([*held.schema.fields, *[T.StructField(f"__{k}", T.LongType()) for k in _COUNTS]])
    return unboxed(_verdict(held.mapInArrow(run, schema), rows).filter("__kept"), docs.columns)
