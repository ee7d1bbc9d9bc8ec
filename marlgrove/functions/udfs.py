"""What column expressions can't say, as vectorised functions, and a registry of named functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as t

#: Names to builders of columns from columns.
REGISTRY: dict[str, Callable[..., Column]] = {
    "token_estimate": t.token_estimate, "text_hash": t.text_hash, "slug": t.slug, "density_chunker": t.density_chunker, "density_quality": t.density_quality,
    "language_entropy": t.language_entropy, "average_sentence_length": t.average_sentence_length, "numeric_ratio": t.numeric_ratio, "alphabetic_ratio": t.alphabetic_ratio,
    "duplicate_line_ratio": t.duplicate_line_ratio, "table_probability": t.table_probability, "benchmark_probability": t.benchmark_probability, "malformed_structure": t.malformed_structure,
    "section_label": t.section_label, "fingerprint": t.fingerprint, "jaccard": t.jaccard, "dot": t.dot, "norm": t.norm,
}


def register(name: str, builder: Callable[..., Column]) -> None:
    if name in REGISTRY:
        raise ValueError(f"{name} is registered")
    REGISTRY[name] = builder


def call(name: str, *columns: Column) -> Column:
    return REGISTRY[name](*columns)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalisation, which Spark has no function for."""
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


# What citations look like, in the order in which they are looked for.
_NAME = r"[A-Z][A-Za-z'`\-]+(?:\s+et al\.)?"
CITATIONS = (
    ("numeric", re.compile(r"\[(?:\d+(?:\s*[-,]\s*\d+)*)\]")),
    ("author_year", re.compile(rf"\((?:{_NAME}(?:,\s*{_NAME})*)\s*,\s*(?:19|20)\d{{2}}[a-z]?\)")),
    ("author_year", re.compile(rf"\[(?:{_NAME}(?:,\s*{_NAME})*)\s*,\s*(?:19|20)\d{{2}}[a-z]?\]")),
    ("author_year_inline", re.compile(rf"\b{_NAME}\s+\((?:19|20)\d{{2}}[a-z]?\)")),
)
SPAN = "array<struct<start:int,end:int,kind:string,text:string,year:int,entities:array<string>>>"


def citation_spans(text: str) -> list[tuple]:
    """Spans in order of place; a place that two patterns find is the first one's."""
    found: dict[tuple[int, int], tuple] = {}
    for kind, pattern in CITATIONS:
        for m in pattern.finditer(text):
            year = re.search(r"(?:19|20)\d{2}", m[0])
            found.setdefault(m.span(), (*m.span(), kind, m[0], int(year[0]) if year else None, list(dict.fromkeys(re.findall(_NAME, m[0])))))
    return [found[k] for k in sorted(found)]


def with_citations(df: DataFrame, column: str = "text") -> DataFrame:
    """df with spans, citation_entities, citation_density. Offsets need a matcher that reports them, so one Arrow pass runs Python."""
    fields = ("start", "end", "kind", "text", "year", "entities")

    @F.pandas_udf(SPAN)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: [dict(zip(fields, v)) for v in citation_spans(x or "")])

    out = df.withColumn("spans", spans(F.col(column)))
    return out.withColumn("citation_entities", F.array_distinct(F.flatten("spans.entities"))).withColumn("citation_density", F.round(F.size("spans") / t.token_estimate(F.col(column)), 4))
