"""Search queries: every benchmark passage is a query, its vector that of the same number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import search as s
from ..sources.tables import CHUNKS_SQL, chunks, table
from .registry import query

TOK_ = "regexp_extract_all(lower({}), '" + s.BM25_TOKEN + "')"
QS_ = "qs AS (SELECT item_id AS query_id, item_id AS base, text FROM benchmark)"
POST_ = f"""post AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM (SELECT chunk_id, {TOK_.format('chunk_text')} AS ts FROM chunks)) GROUP BY 1, 2),
st AS (SELECT count(*) AS n, avg(len({TOK_.format('chunk_text')})) AS avgdl FROM chunks), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


def sparse_sql(x: str = "") -> str:
    """Lexical search of the queries in the table qs (with the ending x, as all tables of the search)."""
    return f"""asked{x} AS (SELECT query_id, unnest({TOK_.format('text')}) AS term FROM qs{x}),
sparse_all{x} AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * greatest(dl, 1) / greatest(avgdl, 1)))), 6) AS score FROM asked{x} JOIN post USING (term) JOIN dfs USING (term), st GROUP BY 1, 2),
sparse{x} AS (SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM sparse_all{x} QUALIFY rank <= 20)"""


def dense_sql(x: str = "") -> str:
    """Search by the vectors of the queries' bases."""
    return f"""dense{x} AS (SELECT q.query_id, e.vec_id AS chunk_id, round(list_inner_product(a.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score, (row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id))::INT AS rank FROM qs{x} q JOIN embeddings a ON a.vec_id = q.base, embeddings e QUALIFY rank <= 20)"""


def fused_sql(x: str = "") -> str:
    return f"fused{x} AS (SELECT query_id, chunk_id, coalesce(d.score, 0.0) AS dense_score, coalesce(s.score, 0.0) AS sparse_score, round(coalesce(1.0::DOUBLE / (60 + d.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0.0), 9) AS fused_score FROM dense{x} d FULL JOIN sparse{x} s USING (query_id, chunk_id))"


BM25_, DENSE_, RRF_ = f"{QS_}, {POST_}, {sparse_sql()}", dense_sql(), fused_sql()
WEIGHT_ = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in s.SECTION_WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"
BOOST_ = "CASE WHEN contains(lower(text), 'method') THEN CASE WHEN label IN ('methodology', 'preliminaries') THEN 0.05::DOUBLE ELSE 0 END WHEN contains(lower(text), 'result') THEN CASE WHEN label IN ('results', 'discussion', 'experiments') THEN 0.05::DOUBLE ELSE 0 END WHEN contains(lower(text), 'conclusion') AND label = 'conclusion' THEN 0.05::DOUBLE ELSE 0 END"
ALL_ = f"WITH {CHUNKS_SQL}, {BM25_}, {DENSE_}, {RRF_}"
CITES_ = f"(CASE WHEN list_has_any(regexp_extract_all(text, '{s.ENTITY}'), regexp_extract_all(chunk_text, '{s.ENTITY}')) THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN contains(lower(text), 'citation') AND regexp_matches(chunk_text, '{t.CITATION_MARK}') THEN 0.04::DOUBLE ELSE 0 END)"


def met_sql(x: str = "") -> str:
    """The candidates with their chunks, queries and boosts."""
    return f"met{x} AS (SELECT *, {CITES_} AS citation_boost FROM (SELECT f.*, c.paper_id, c.label, c.chunk_text, q.text, q.base, {BOOST_} AS section_boost, {WEIGHT_} AS section_weight FROM fused{x} f JOIN chunks c USING (chunk_id) JOIN qs{x} q USING (query_id)))"


HYBRID_ = f"{ALL_}, {met_sql()}"
#: The score of hybrid search, and its results.
SCORE_ = "round((fused_score + (section_boost + citation_boost)) * section_weight, 6)"


def results_sql(x: str = "", k: int = 10) -> str:
    return f"res{x} AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM (SELECT *, {SCORE_} AS score FROM met{x}) QUALIFY rank <= {k})"


def search_sql(x: str, k: int = 10) -> str:
    """Another search within the same statement, of the queries in qs with the ending x."""
    return ", ".join((sparse_sql(x), dense_sql(x), fused_sql(x), met_sql(x), results_sql(x, k)))


_cols = "query_id, rank, chunk_id, paper_id, label, score, dense_score, sparse_score, fused_score, section_boost, citation_boost, section_weight"


def _rank(score: str, where: str = "true", more: str = "", k: int = 10) -> str:
    return f" SELECT {_cols}{more} FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM (SELECT *, {score} AS score FROM met WHERE {where})) WHERE rank <= {k}"


RERANK_ = f"round(len(list_intersect({TOK_.format('text')}, {TOK_.format('chunk_text')}))::DOUBLE / greatest(len(list_distinct({TOK_.format('text')})), 1) + CASE WHEN regexp_matches(chunk_text, '{s.ENTITY}') THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN label IN ('introduction', 'methodology', 'results', 'discussion', 'conclusion') THEN 0.08::DOUBLE ELSE 0 END, 6)"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))


def questions(spark, sf_dir):
    """query_id, text, v of every benchmark passage that has a vector of its number."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(own, "query_id")


@query(f"WITH {CHUNKS_SQL}, {BM25_} SELECT query_id, chunk_id, score, rank FROM sparse")
def bm25_topk(spark, sf_dir):
    return s.bm25(chunks(spark, sf_dir), questions(spark, sf_dir))


@query(f"WITH {CHUNKS_SQL}, {BM25_} SELECT (SELECT count(DISTINCT term) FROM post) AS terms, (SELECT count(*) FROM post) AS postings, (SELECT max(df) FROM dfs) AS max_df, n AS chunks, round(avgdl, 6) AS avgdl FROM st")
def bm25_index_stats(spark, sf_dir):
    post = s.postings(chunks(spark, sf_dir))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return df.agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.max("df").alias("max_df")).crossJoin(s.corpus_stats(post, chunks(spark, sf_dir)).select(F.col("n").alias("chunks"), F.round("avgdl", 6).alias("avgdl")))


@query(f"WITH {QS_}, {DENSE_} SELECT query_id, chunk_id, score, rank FROM dense")
def dense_topk(spark, sf_dir):
    return s.exact_dense(vectors(spark, sf_dir), questions(spark, sf_dir).select("query_id", "v"))


def _both(spark, sf_dir):
    return dense_topk(spark, sf_dir), bm25_topk(spark, sf_dir)


@query(f"{ALL_} SELECT * FROM fused")
def rrf_fusion(spark, sf_dir):
    return s.rrf(*_both(spark, sf_dir))


MINMAX_ = "CASE WHEN max(score) OVER (PARTITION BY query_id) = min(score) OVER (PARTITION BY query_id) THEN 1.0::DOUBLE ELSE (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) END"


@query(f"WITH {CHUNKS_SQL}, {BM25_}, {DENSE_}, d AS (SELECT *, {MINMAX_} AS p FROM dense), s AS (SELECT *, {MINMAX_} AS p FROM sparse) SELECT query_id, chunk_id, coalesce(d.score, 0.0) AS dense_score, coalesce(s.score, 0.0) AS sparse_score, round(coalesce(d.p, 0.0) * 0.55::DOUBLE + coalesce(s.p, 0.0) * 0.25::DOUBLE, 6) AS fused_score FROM d FULL JOIN s USING (query_id, chunk_id)")
def weighted_fusion(spark, sf_dir):
    return s.weighted(*_both(spark, sf_dir))


@query(f"WITH {CHUNKS_SQL}, {BM25_} SELECT query_id, chunk_id, 0.0::DOUBLE AS dense_score, score AS sparse_score, score AS fused_score FROM sparse")
def sparse_mode(spark, sf_dir):
    return s.fuse(*_both(spark, sf_dir), mode="sparse")


@query(HYBRID_ + _rank(SCORE_))
def hybrid_search(spark, sf_dir):
    return s.hybrid(chunks(spark, sf_dir), vectors(spark, sf_dir), questions(spark, sf_dir))


@query(HYBRID_ + _rank(SCORE_, "label = 'methodology'"))
def section_filter_after_topk(spark, sf_dir):
    return s.hybrid(chunks(spark, sf_dir), vectors(spark, sf_dir), questions(spark, sf_dir), section="methodology")


@query(HYBRID_ + f", scored AS (SELECT *, {RERANK_} AS rerank_score FROM met) " + _rank("round((fused_score + (section_boost + citation_boost) + rerank_score * 0.20::DOUBLE) * section_weight, 6)", more=", rerank_score").replace("FROM met", "FROM scored"))
def rerank_heuristic(spark, sf_dir):
    return s.hybrid(chunks(spark, sf_dir), vectors(spark, sf_dir), questions(spark, sf_dir), rerank=True)


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, label, {WEIGHT_} AS weight FROM chunks")
def section_weights(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", "label", s.section_weight(F.col("label")).alias("weight"))


@query(HYBRID_ + " SELECT query_id, chunk_id, round(citation_boost, 6) AS boost FROM met")
def citation_boost(spark, sf_dir):
    """Of every candidate of every query, from names that both hold and from citations in the chunk."""
    met = s.rrf(*_both(spark, sf_dir)).join(chunks(spark, sf_dir).select("chunk_id", "chunk_text"), "chunk_id").join(questions(spark, sf_dir).select("query_id", "text"), "query_id")
    return met.select("query_id", "chunk_id", F.round(s.citation_boost(F.col("text"), t.found(F.col("chunk_text"), s.ENTITY), t.citation_density_quality(F.col("chunk_text"))), 6).alias("boost"))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'method') THEN 'method' WHEN contains(lower(text), 'result') THEN 'result' WHEN contains(lower(text), 'conclusion') THEN 'conclusion' ELSE '' END AS cue, CASE WHEN contains(lower(text), 'method') THEN 0.05::DOUBLE ELSE 0.0 END AS methodology_boost FROM conversations")
def section_boost(spark, sf_dir):
    q = F.lower("text")
    cue = F.when(q.contains("method"), "method").when(q.contains("result"), "result").when(q.contains("conclusion"), "conclusion").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cue.alias("cue"), s.section_boost(F.col("text"), F.lit("methodology")).alias("methodology_boost"))


EST_ = "greatest(1, floor(len(regexp_extract_all({}, '\\S+')) * 1.25::DOUBLE))::BIGINT"


@query(f"""WITH {CHUNKS_SQL}, w AS (SELECT chunk_id, chunk_text AS t, {EST_.format('chunk_text')} AS n, lag(chunk_id) OVER p AS b, lead(chunk_id) OVER p AS a, lag(chunk_text) OVER p AS bt, lead(chunk_text) OVER p AS nt FROM chunks WINDOW p AS (PARTITION BY paper_id ORDER BY chunk_index)),
x AS (SELECT *, CASE WHEN b IS NULL THEN [t, nt] ELSE [bt, t, nt] END AS parts FROM w), y AS (SELECT chunk_id, b, a, list_filter(parts, lambda p: p IS NOT NULL) AS parts FROM x),
z AS (SELECT *, list_transform(parts, lambda p: {EST_.format('p')}) AS ns FROM y), k AS (SELECT *, CASE WHEN len(ns) > 1 AND ns[1] + ns[2] <= 1200 THEN CASE WHEN len(ns) > 2 AND ns[1] + ns[2] + ns[3] <= 1200 THEN 3 ELSE 2 END ELSE 1 END AS kept FROM z)
SELECT chunk_id, coalesce(b::VARCHAR, '') AS before, coalesce(a::VARCHAR, '') AS after, kept AS parts_kept, list_sum(ns[1:kept])::BIGINT AS tokens, md5(array_to_string(parts[1:kept], chr(10) || chr(10))) AS context_md5 FROM k""")
def context_window(spark, sf_dir):
    return s.context_windows(chunks(spark, sf_dir)).select("chunk_id", "before", "after", "parts_kept", "tokens", F.md5("context").alias("context_md5"))


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, lag(chunk_id) OVER p AS previous_chunk_id, lead(chunk_id) OVER p AS next_chunk_id FROM chunks WINDOW p AS (PARTITION BY paper_id ORDER BY chunk_index)")
def chunk_links(spark, sf_dir):
    return s.links(chunks(spark, sf_dir))


@query("SELECT sum(n)::BIGINT AS vectors, sum(n - 1)::BIGINT AS duplicates, round(any_value(dense) / any_value(dims), 6) AS density, round((SELECT count(*)::DOUBLE FROM embeddings SEMI JOIN documents ON vec_id = doc_id) / (SELECT count(*) FROM embeddings), 6) AS coverage FROM (SELECT embedding[1:32] AS head, count(*) AS n FROM embeddings GROUP BY 1), (SELECT sum(len(list_filter(embedding, lambda x: abs(x) > 1e-8)))::DOUBLE AS dense, sum(len(embedding))::DOUBLE AS dims FROM embeddings)")
def index_analytics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    heads = e.groupBy(F.slice("embedding", 1, 32).alias("head")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("vectors"), F.sum(F.col("n") - 1).alias("duplicates"))
    density = e.agg(F.round(F.sum(F.size(F.filter("embedding", lambda x: F.abs(x) > 1e-8))) / F.sum(F.size("embedding")), 6).alias("density"))
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.lit(1).alias("there")).distinct()
    coverage = e.select("vec_id").join(ids, "vec_id", "left").agg(F.round(F.count("there") / F.count("*"), 6).alias("coverage"))
    return heads.crossJoin(density).crossJoin(coverage)


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS vector_norm, len(embedding)::INT AS vector_dim FROM embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(t.norm(F.col("embedding")), 6).alias("vector_norm"), F.size("embedding").alias("vector_dim"))


@query("""SELECT src, dst, score FROM (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS r FROM embeddings a, embeddings b) WHERE r <= 3 AND src <> dst""")
def knn_graph(spark, sf_dir):
    v = vectors(spark, sf_dir)
    near = s.exact_dense(v, v.select(F.col("chunk_id").alias("query_id"), "v"), k=3)
    return near.filter("query_id <> chunk_id").select(F.col("query_id").alias("src"), F.col("chunk_id").alias("dst"), "score")


HASH_ = "('0x' || substr(sha256(tok), 1, 8))::BIGINT"


@query(f"""WITH toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(text, '\\s+', ' ', 'g')), '{t.EMBED_TOKEN}')) AS tok FROM documents), h AS (SELECT doc_id, {HASH_} AS h, length(tok) AS l FROM toks),
v AS (SELECT doc_id, h % 768 AS idx, sum(CASE WHEN (h // 768) % 2 = 0 THEN 1 ELSE -1 END * (1 + least(l, 12) / 12.0::DOUBLE)) AS w FROM h GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1)
SELECT doc_id, count(*) AS nonzero, round(sum(abs(w)) / any_value(CASE WHEN norm = 0 THEN 1 ELSE norm END), 5) AS l1 FROM v JOIN n USING (doc_id) WHERE abs(w) > 1e-9 GROUP BY doc_id""")
def hash_embedding(spark, sf_dir):
    from ..operators.embed import hash_vectors

    sparse = hash_vectors(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text")))
    return sparse.filter("abs(raw) > 1e-9").groupBy(F.col("chunk_id").alias("doc_id")).agg(F.count("*").alias("nonzero"), F.round(F.sum(F.abs("weight")), 5).alias("l1"))
