"""Text measures as column expressions: none runs Python, all fold into one projection.

Scores are rounded where later scores read them, so that sums of them agree whatever the engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content, for the chunk measure and for the quality measure.
STOP_CHUNK = "the a an and or of to in for on with is are by we this that our be as from at can it using used into than such".split()
STOP_QUALITY = "the a an and or of to in on for with by is are was were be this that these those".split()
# Terms that mark a line as reporting a benchmark.
BENCHMARK_TERMS = "accuracy f1 score scores benchmark leaderboard winrate success pass@1 metric results".split()
# Weights, cut-offs and patterns of the quality model.
ROW = r"^\s*(?:[\p{L}\p{N}_\-\+/\.]+\s+){2,}[\d\.%]+(?:\s+[\d\.%]+){2,}\s*$"
CITATION_MARK = r"\[[^\]]+\]|\([A-Z][A-Za-z]+ et al\., \d{4}[a-z]?\)"
EQUATION_MARK = r"[=<>±∑∏λμσ]|\\begin\{equation\}|\\frac|\bO\([^)]+\)"
WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_\-\./%]*"
LONG_WORD = r"[A-Za-z][A-Za-z0-9_\-]{1,}"
SPACES = " \t\n\r\x0b\x0c"


def found(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def rounded(c: Column, digits: int) -> Column:
    """Half up on the binary value, by arithmetic that every engine does alike."""
    return F.floor(c * F.lit(float(10**digits)) + F.lit(0.5)) / F.lit(float(10**digits))


def unit(c: Column, digits: int = 6) -> Column:
    """Held between 0 and 1, and rounded."""
    return rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), digits)


def let(value: Column, body) -> Column:
    """body of value, which is computed once, however often body or its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(count(c, r"\S+") * F.lit(1.25))).cast("long")


def text_hash(c: Column) -> Column:
    return F.sha2(strip(c), 256)


def slug(c: Column, fallback: str = "section") -> Column:
    s = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def safe_id(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("_"))


def density_chunker(c: Column) -> Column:
    digits = F.least(F.lit(1.0), count(c, r"\d") / F.lit(20.0)) * 0.15

    def score(content: Column) -> Column:
        n = F.greatest(F.size(content), F.lit(1))
        return unit(F.size(F.array_distinct(content)) / n * 0.5 + F.size(F.filter(content, lambda t: F.length(t) >= 6)) / n * 0.35 + digits, 4)

    def body(tokens: Column) -> Column:
        return F.when(F.size(tokens) == 0, F.lit(0.0)).otherwise(let(F.filter(F.transform(tokens, F.lower), lambda t: ~t.isin(STOP_CHUNK)), score))

    return let(found(c, LONG_WORD), body)


def density_quality(c: Column) -> Column:
    sentences = F.greatest(count(c, r"[.!?]+"), F.lit(1))

    def score(lexical: Column) -> Column:
        n = F.size(lexical)
        total = F.size(F.filter(lexical, lambda t: ~t.isin(STOP_QUALITY))) / n * 0.35 + F.size(F.array_distinct(lexical)) / n * 0.25 + F.size(F.filter(lexical, lambda t: F.length(t) >= 6)) / n * 0.20 + F.least(n / (sentences * F.lit(18)), F.lit(1.0)) * 0.20
        return F.when(n == 0, F.lit(0.0)).otherwise(unit(total))

    return let(F.transform(F.filter(found(c, TOKEN), lambda t: t.rlike(r"[A-Za-z]")), F.lower), score)


def language_entropy(c: Column) -> Column:
    """Entropy of letters over its most; 0 if there is one letter only. Common letters are taken out one after the other, the most frequent first, and only what is left is listed."""

    def score(letters: Column) -> Column:
        n = F.length(letters)
        state = "struct<rest:string,counts:array<int>>"

        def take(s: Column, x: Column) -> Column:
            return let(F.replace(s["rest"], x, F.lit("")), lambda r: F.struct(r.alias("rest"), F.concat(s["counts"], F.array(F.length(s["rest"]) - F.length(r))).alias("counts")).cast(state))

        def others(s: Column) -> Column:
            kinds = F.filter(F.array_distinct(F.split(s["rest"], "")), lambda x: x != "")
            return F.concat(s["counts"], F.transform(kinds, lambda x: F.length(s["rest"]) - F.length(F.replace(s["rest"], x, F.lit("")))))

        def body(counts: Column) -> Column:
            total = F.aggregate(counts, F.lit(0.0), lambda s, k: s - k / n * F.log2(k / n))
            return F.when(F.size(counts) <= 1, F.lit(0.0)).otherwise(unit(total / F.log2(F.least(F.lit(26), F.size(counts)).cast("double"))))

        start = F.struct(letters.alias("rest"), F.array().cast("array<int>").alias("counts")).cast(state)
        return let(F.filter(F.aggregate(F.array(*[F.lit(x) for x in "etaoinshrdlucmfwypvbgkjqxz"]), start, take, others), lambda k: k > 0), body)

    return let(F.regexp_replace(F.lower(c), r"[^\p{L}]+", ""), score)


def average_sentence_length(c: Column) -> Column:
    def score(sentences: Column) -> Column:
        words = F.aggregate(F.transform(sentences, lambda s: count(s, TOKEN)), F.lit(0), lambda a, x: a + x)
        return F.round(share(words, F.size(sentences)), 6)

    return let(F.filter(F.transform(F.split(c, r"[.!?]+\s+"), strip), lambda s: s != ""), score)


def numeric_ratio(c: Column) -> Column:
    return F.round(share(count(c, r"\p{Nd}"), F.length(c)), 6)


def alphabetic_ratio(c: Column) -> Column:
    return F.round(share(F.length(F.regexp_replace(c, r"[^\p{L}]+", "")), F.length(c)), 6)  # runs of others are fewer than letters


def lines(c: Column, stripped: bool = True) -> Column:
    """Lines that aren't blank."""
    if stripped:
        return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    return F.filter(F.split(c, "\n"), lambda x: strip(x) != "")


def duplicate_line_ratio(c: Column) -> Column:
    return let(lines(c), lambda all_: F.round(share(F.size(all_) - F.size(F.array_distinct(all_)), F.size(all_)), 6))


def citation_density_quality(c: Column) -> Column:
    return F.round(count(c, CITATION_MARK) / F.greatest(count(c, WORD), F.lit(1)), 6)


def equation_density_quality(c: Column) -> Column:
    return F.round(count(c, EQUATION_MARK) / F.greatest(count(c, WORD), F.lit(1)), 6)


def _lines_with(all_: Column, test) -> Column:
    return share(F.size(F.filter(all_, test)), F.size(all_))


def table_row(line: Column) -> Column:
    """Whether a stripped line matches ``ROW``.

    Tokens are classed first (w: word, n: number, b: either), for a repeated group over a long line
    overflows the stack of Java's matcher, while classes of characters don't."""
    kind = lambda x: F.when(x.rlike(r"^[\d\.%]+$"), F.when(x.contains("%"), F.lit("n")).otherwise(F.lit("b"))).when(x.rlike(r"^[\p{L}\p{N}_\-\+/\.]+$"), F.lit("w")).otherwise(F.lit("x"))
    classes = F.array_join(F.transform(F.split(line, r"\s+"), kind), "")
    return F.when(line.rlike(r"[\d\.%]+\s+[\d\.%]+\s+[\d\.%]+$"), classes.rlike("^[wb]{2,}[bn]{3,}$")).otherwise(F.lit(False))


def table_probability(c: Column) -> Column:
    def score(all_: Column) -> Column:
        row = _lines_with(all_, table_row)
        bar = _lines_with(all_, lambda x: (count(x, r"\|") >= 2) | (count(x, "\t") >= 2))
        dense = _lines_with(all_, lambda x: count(x, r"\p{Nd}") / F.greatest(F.length(x), F.lit(1)) > 0.22)
        return unit(row * 0.5 + bar * 0.25 + dense * 0.25)

    return let(lines(c), score)


def benchmark_probability(c: Column) -> Column:
    def score(all_: Column) -> Column:
        term = _lines_with(all_, lambda x: reduce(lambda a, b: a | b, (x.contains(k) for k in BENCHMARK_TERMS)))
        rate = _lines_with(all_, lambda x: x.contains("%") | x.rlike(r"\b\d+\.\d+\b"))
        return unit(term * 0.55 + rate * 0.45)

    return let(F.transform(lines(c), F.lower), score)


def malformed_structure(c: Column) -> Column:
    def score(all_: Column) -> Column:
        short = _lines_with(all_, lambda x: count(x, r"\S+") <= 3)
        case = _lines_with(all_, lambda x: x.rlike(r"^[a-z].*[A-Z]"))
        odd = _lines_with(all_, lambda x: (count(x, r"\(") != count(x, r"\)")) | (count(x, r"\[") != count(x, r"\]")))
        return unit(short * 0.45 + case * 0.25 + odd * 0.30)

    return let(lines(c, stripped=False), score)


def quality_columns(c: Column) -> dict[str, Column]:
    return {
        "semantic_density": density_quality(c),
        "table_probability": table_probability(c),
        "benchmark_probability": benchmark_probability(c),
        "duplicate_line_ratio": duplicate_line_ratio(c),
        "numeric_ratio": numeric_ratio(c),
        "alphabetic_ratio": alphabetic_ratio(c),
        "malformed_structure_score": malformed_structure(c),
        "language_entropy": language_entropy(c),
        "average_sentence_length": average_sentence_length(c),
    }


def noise_score() -> Column:
    """From the columns of ``quality_columns``."""
    col = F.col
    return unit((1 - col("semantic_density")) * 0.25 + col("table_probability") * 0.20 + col("benchmark_probability") * 0.15 + col("duplicate_line_ratio") * 0.15 + F.least(col("numeric_ratio") / 0.35, F.lit(1.0)) * 0.10 + col("malformed_structure_score") * 0.15)


# Labels and the cut-offs beyond which they hold.
NOISE_LABELS = (
    ("table_like", "table_probability >= 0.55D"),
    ("benchmark_heavy", "benchmark_probability >= 0.55D"),
    ("low_semantic_density", "semantic_density < 0.35D"),
    ("duplicate_lines", "duplicate_line_ratio > 0.20D"),
    ("numeric_wall", "numeric_ratio > 0.18D"),
    ("malformed_structure", "malformed_structure_score > 0.35D"),
)


def noise_labels() -> Column:
    return F.array_compact(F.array(*[F.when(F.expr(test), F.lit(label)) for label, test in NOISE_LABELS]))


def chunk_quality() -> Column:
    col = F.col
    score = (
        col("semantic_density") * 0.30
        + col("alphabetic_ratio") * 0.12
        + (1 - col("table_probability")) * 0.15
        + (1 - col("benchmark_probability")) * 0.10
        + (1 - col("duplicate_line_ratio")) * 0.08
        + (1 - col("malformed_structure_score")) * 0.10
        + F.least(col("language_entropy"), F.lit(1.0)) * 0.05
        + F.least(col("average_sentence_length") / 24.0, F.lit(1.0)) * 0.05
        + (1 - F.least(col("numeric_ratio") / 0.25, F.lit(1.0))) * 0.05
    )
    return unit(score)


def retrieval_excluded() -> Column:
    return (F.col("semantic_density") < 0.35) | (F.col("table_probability") > 0.55) | (F.col("noise_score") > 0.60) | (F.col("retrieval_quality_score") < 0.45)


# Hash-embedding tokens.
EMBED_TOKEN = r"[a-z0-9_\-.()\[\]\\/%=:+*]+"


def stable_hash(c: Column) -> Column:
    """The first 32 bits of SHA-256 as a long; the same in every process and engine."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def fingerprint(c: Column) -> Column:
    """SHA-1 of the first twelve 48-character shingles, 16 apart, of the text without punctuation."""
    plain = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " ")
    plain = F.btrim(plain)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(plain) - 47), F.lit(16))
    pieces = F.transform(F.slice(at, 1, 12), lambda k: F.substring(plain, k, F.lit(48)))
    return F.sha1(F.array_join(pieces, "|"))


# Canonical section labels, and what a heading must be for each.
SECTIONS = (
    ("abstract", r"abstract"),
    ("introduction", r"intro(duction)?"),
    ("related_work", r"related work|literature review"),
    ("preliminaries", r"preliminar(y|ies)|background|problem setup"),
    ("methodology", r"methods?|methodology|approach"),
    ("experiments", r"experimental setup|evaluation|benchmark|implementation details|experiments?"),
    ("results", r"results?|findings|ablation( studies)?"),
    ("discussion", r"discussion"),
    ("limitations", r"limitations?|future work"),
    ("conclusion", r"conclusions?"),
    ("appendix", r"appendix( [a-z])?|supplementary material|supplemental material"),
    ("references", r"references|bibliography"),
)


def section_label(c: Column) -> Column:
    heading = F.btrim(F.lower(c), F.lit(" .:"))
    label = None
    for name, pattern in SECTIONS:
        test = heading.rlike(f"^({pattern})$")
        label = F.when(test, F.lit(name)) if label is None else label.when(test, F.lit(name))
    return label.otherwise(F.lit("body"))


# What makes a line an artefact of its page.
ARTEFACTS = (
    ("caption", r"(?i)^(figure|fig\.|table)\s+\d+[\.:|\s-]"),
    ("appendix_marker", r"(?i)^(appendix|supplementary material|supplemental material)\b"),
    ("email", r"\b[A-Za-z0-9_\.-]+@[A-Za-z0-9_\.-]+\.[A-Za-z0-9_]+\b"),
    ("link", r"(?i)(https?://\S+|www\.\S+|github\.com/\S+)"),
)
WATERMARK = r"(?i)(preprint|under review|copyright|arxiv:|accepted at)"
AFFILIATION = r"university|institute|department"


def artefact_type(line: Column, front: Column) -> Column:
    """front: whether the line is one of the first 25 of its paper."""
    kind = None
    for name, pattern in ARTEFACTS:
        kind = F.when(line.rlike(pattern), F.lit(name)) if kind is None else kind.when(line.rlike(pattern), F.lit(name))
    return kind.when(line.rlike(WATERMARK) & (F.length(line) < 120), F.lit("watermark")).when(front & F.lower(line).rlike(AFFILIATION), F.lit("affiliation"))


PAGE_NUMBER = r"(?i)^(page\s+)?\d+(\s*/\s*\d+)?$"


def noise_line(line: Column, repeated: Column) -> Column:
    return (line == "") | repeated | line.rlike(PAGE_NUMBER) | line.rlike(r"^[^\p{L}\p{N}]+$")


def normal_line(c: Column) -> Column:
    """Without soft hyphens and ligatures, blanks joined; Spark has no compatibility normalisation (see ``functions.udfs``)."""
    c = F.replace(F.replace(F.replace(c, F.lit("­"), F.lit("")), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return strip(F.regexp_replace(c, r"[ \t]+", " "))
