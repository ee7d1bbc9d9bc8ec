"""Search, answers and reports over a corpus, for batches of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .operators import agentic as g
from .operators import answer as a
from .operators import search as s
from .operators import writer as w

MODES = ("hybrid", "dense", "sparse")


class Engine:
    """chunks: chunk_id, paper_id, chunk_index, chunk_text, label; vectors: chunk_id, v. Queries bring query_id, text and v."""

    def __init__(self, chunks: DataFrame, vectors: DataFrame):
        self.chunks, self.vectors = chunks, vectors

    def search(self, queries: DataFrame, k: int = s.FINAL, mode: str = "hybrid", section: str | None = None, rerank: bool = False, context: bool = False) -> DataFrame:
        """The ranked chunks of each query, with the texts; ``context`` adds their neighbours' texts too.

        The modes dense and sparse rank by that list's own score; sections and reranking are of hybrid search."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        if mode == "hybrid":
            out = s.hybrid(self.chunks, self.vectors, queries, k, section, rerank, texts=True)
        else:
            hits = s.exact_dense(self.vectors, queries.select("query_id", "v"), k) if mode == "dense" else s.bm25(self.chunks, queries.select("query_id", "text"), k)
            out = hits.join(self.chunks.select("chunk_id", "paper_id", "label", "chunk_text"), "chunk_id").join(queries.select("query_id", "text"), "query_id")
        if context:
            out = out.join(s.context_windows(self.chunks).select("chunk_id", "context"), "chunk_id", "left")
        return out

    def find(self, queries: DataFrame) -> DataFrame:
        """Hybrid search as retrieval in rounds wants it."""
        return self.search(queries)

    def answer(self, queries: DataFrame, agentic: bool = False) -> DataFrame:
        """A cited and judged answer to each query; agentic ones are refined by what their evidence says."""
        if not agentic:
            return g.respond(self.find, self.chunks, queries)
        held = g.evidence(g.gathered(self.find, self.chunks, queries))
        return g.post_process(g.judged(a.structured_answers(held)), held)

    def multi_hop(self, queries: DataFrame) -> DataFrame:
        return g.multi_hop(self.find, queries)

    def report(self, queries: DataFrame, passes: int = 2) -> DataFrame:
        """A report on each query: report_id, abstract, markdown, sections."""
        return w.assembled(w.revise(w.drafts(w.section_evidence(self.find, w.plans(queries))), passes))
