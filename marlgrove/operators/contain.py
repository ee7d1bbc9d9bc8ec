"""Which texts contain which passages, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import let


def containing(texts: DataFrame, passages: DataFrame, gram: int = 6) -> DataFrame:
    """id, item of each text (id, text) that contains a passage (item, passage) as it stands.

    Candidates share the passage's inner words: its second to seventh, which the text must hold with the
    same single spaces. Passages too short for that, or with other white space there, are tried on all texts."""
    inner = F.regexp_extract("passage", rf"^\S*\s(\S+(?: \S+){{{gram - 1}}})\s", 1)
    keyed = passages.withColumn("gram", inner)

    def grams(words):
        all_ = F.transform(F.sequence(F.lit(1), F.size(words) - gram + 1), lambda k: F.array_join(F.slice(words, k, gram), " "))
        return F.when(F.size(words) >= gram, F.array_distinct(all_)).otherwise(F.array().cast("array<string>"))

    listed = texts.withColumn("gram", F.explode(let(F.split("text", r"[ \n\t\r]"), grams)))
    long_ = listed.join(keyed.filter("gram <> ''"), "gram").filter(F.col("text").contains(F.col("passage"))).select("id", "item")
    short = texts.join(keyed.filter("gram = ''").drop("gram"), F.col("text").contains(F.col("passage"))).select("id", "item")
    return long_.union(short).distinct()
