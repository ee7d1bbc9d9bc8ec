"""Evaluation, graphs, histograms and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chunker, evaluate
from ..operators import layout as o
from ..operators.contain import containing
from ..operators.search import positions
from ..sources.tables import CHUNKS_SQL, LINES_SQL, chunks, lines, table
from .registry import query
from .retrieval import BM25_, bm25_topk, knn_graph
from .corpus import JOINED_, PARA_, ROLE_
from .scores import DENSITY_CHUNKER_, n_, unit_

REL_ = "rel AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH {CHUNKS_SQL}, {BM25_}, {REL_}, h AS (SELECT s.query_id, min(rank) AS first, count(*) AS hits FROM sparse s JOIN rel USING (query_id, chunk_id) WHERE rank <= 10 GROUP BY 1), n AS (SELECT query_id, count(*) AS relevant FROM rel GROUP BY 1) SELECT count(*) AS probes, round(avg(coalesce(hits::DOUBLE / relevant, 0)), 4) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mrr, round(avg(coalesce(1.0::DOUBLE / log2(first + 1.0::DOUBLE), 0)), 4) AS ndcg FROM (SELECT item_id AS query_id FROM benchmark) b LEFT JOIN h USING (query_id) LEFT JOIN n USING (query_id)")
def ir_metrics(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    relevant = containing(docs, b.select(F.col("item_id").alias("item"), F.col("text").alias("passage"))).select(F.col("item").alias("query_id"), F.col("id").alias("chunk_id"))
    return evaluate.ir_metrics(bm25_topk(spark, sf_dir), relevant, b.select(F.col("item_id").alias("query_id")))


@query(f"WITH {CHUNKS_SQL}, p AS (SELECT chunk_id AS src, lead(chunk_id) OVER (PARTITION BY paper_id ORDER BY chunk_index) AS dst FROM chunks) SELECT src, dst FROM p WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM p WHERE dst IS NOT NULL")
def section_neighbors(spark, sf_dir):
    return evaluate.section_neighbours(chunks(spark, sf_dir))


ENT_ = """ent AS (SELECT DISTINCT doc_id AS chunk_id, unnest(regexp_extract_all(text, '\\b[A-Z]{3,}\\b')) AS entity FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS text FROM documents)),
sets AS (SELECT chunk_id, list_sort(list(entity)) AS es FROM ent GROUP BY 1), cls AS (SELECT es, min(chunk_id) AS class, count(*) AS n FROM sets GROUP BY 1), own AS (SELECT class, n, unnest(es) AS entity FROM cls),
links AS (SELECT a.class AS src, b.class AS dst, any_value(b.n) AS n, count(*) AS shared FROM own a JOIN own b USING (entity) WHERE a.class <> b.class GROUP BY 1, 2)"""


def _entities(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "_")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.explode(F.array_distinct(t.found(plain, r"\b[A-Z]{3,}\b"))).alias("entity"))


@query(f"WITH {ENT_} SELECT chunk_id, class, n - 1 + coalesce((SELECT sum(l.n) FROM links l WHERE l.src = class), 0)::BIGINT AS links FROM sets JOIN cls USING (es)")
def citation_neighbors(spark, sf_dir):
    """Every chunk with its class and the number of chunks that it shares an entity with."""
    return evaluate.entity_links(_entities(spark, sf_dir))


@query(f"WITH {ENT_} SELECT src AS class, dst AS other, shared FROM links WHERE src < dst")
def citation_links(spark, sf_dir):
    """The links between classes; those of their chunks follow from the classes' members."""
    return evaluate.entity_groups(_entities(spark, sf_dir))[1]


@query(f"WITH {CHUNKS_SQL}, {ENT_}, p AS (SELECT chunk_id AS src, lead(chunk_id) OVER (PARTITION BY paper_id ORDER BY chunk_index) AS dst FROM chunks), k AS (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS r FROM embeddings a, embeddings b) SELECT 'section_neighbor' AS relation, 2 * count(dst) AS n FROM p UNION ALL SELECT 'citation_neighbor', count(*) FROM links HAVING count(*) > 0 UNION ALL SELECT 'semantic_neighbor', count(*) FROM k WHERE r <= 3 AND src <> dst")
def memory_graph(spark, sf_dir):
    """Edges by kind; those of shared entities are between classes of chunks, both ways."""
    ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    shared = citation_links(spark, sf_dir).select(F.explode(F.array(ends("class", "other"), ends("other", "class"))).alias("x")).select("x.src", "x.dst")
    graph = evaluate.memory_graph(section_neighbors(spark, sf_dir), shared, knn_graph(spark, sf_dir))
    return graph.groupBy("relation").agg(F.count("*").alias("n"))


_est = "greatest(1, floor(" + n_(r"\S+") + " * 1.25::DOUBLE))"
_bins = (0, 128, 256, 384, 512, 768, 2048)


@query("SELECT bin, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN e <= {b} THEN '{a}-{b}'" for a, b in zip(_bins, _bins[1:])) + f" END AS bin FROM (SELECT {_est} AS e FROM documents)) WHERE bin IS NOT NULL GROUP BY 1")
def token_histogram(spark, sf_dir):
    e, bin_ = t.token_estimate(F.col("text")), None
    for a, b in zip(_bins, _bins[1:]):
        bin_ = F.when(e <= b, f"{a}-{b}") if bin_ is None else bin_.when(e <= b, f"{a}-{b}")
    return table(spark, sf_dir, "documents").groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).filter("bin is not null")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS chunks, sum({_est})::BIGINT AS tokens, round(avg({_est}), 6) AS mean_tokens, min({_est})::BIGINT AS min_tokens, max({_est})::BIGINT AS max_tokens FROM documents")
def corpus_stats(spark, sf_dir):
    e = t.token_estimate(F.col("text"))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("chunks"), F.sum(e).alias("tokens"), F.round(F.avg(e), 6).alias("mean_tokens"), F.min(e).alias("min_tokens"), F.max(e).alias("max_tokens"))


@query(f"WITH {CHUNKS_SQL}, h AS (SELECT *, sha256(chunk_text) AS h FROM chunks) SELECT (SELECT count(*) - count(DISTINCT chunk_id) FROM h) AS duplicate_ids, (SELECT count(*) FROM (SELECT h FROM h GROUP BY h HAVING count(*) > 1)) AS repeated_hashes, (SELECT count(*) FROM h WHERE chunk_text IS NULL OR chunk_text = '') AS empty, (SELECT sum((length(chunk_text) < 250)::INT)::BIGINT FROM h) AS tiny")
def invariants(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("h", F.sha2("chunk_text", 256))
    ids = c.groupBy("chunk_id").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("duplicate_ids"))
    hashes = c.groupBy("h").agg(F.count("*").alias("n")).agg(F.sum((F.col("n") > 1).cast("long")).alias("repeated_hashes"))
    rest = c.agg(F.sum((F.col("chunk_text").isNull() | (F.col("chunk_text") == "")).cast("long")).alias("empty"), F.sum((F.length("chunk_text") < 250).cast("long")).alias("tiny"))
    return ids.crossJoin(hashes).crossJoin(rest)


@query(f"WITH {LINES_SQL} SELECT paper_id, count(*) AS n_lines, sum((line = '')::INT)::BIGINT AS empty, sum((length(line) < 20)::INT)::BIGINT AS short, CASE WHEN sum((line = '')::INT) > 0 THEN 'failed' WHEN avg((length(line) < 20)::INT) > 0.5 THEN 'needs_review' ELSE 'ready' END AS status FROM lines GROUP BY 1")
def validator_report(spark, sf_dir):
    line = F.col("line")
    rows = lines(spark, sf_dir).groupBy("paper_id").agg(F.count("*").alias("n_lines"), F.sum((line == "").cast("long")).alias("empty"), F.sum((F.length(line) < 20).cast("long")).alias("short"))
    return rows.withColumn("status", F.when(F.col("empty") > 0, "failed").when(F.col("short") / F.col("n_lines") > 0.5, "needs_review").otherwise("ready"))


_tok = "greatest(1, floor(len(regexp_extract_all({}, '\\S+')) * 1.25::DOUBLE))::BIGINT"
_sum = f"coalesce(list_sum(list_transform(texts, lambda x: {_tok.format('x')})), 0)"
_last = "rtrim(texts[-1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_goes = f"((ends_with({_last}, '-') AND small) OR (NOT regexp_matches({_last}, '[.!?:;]$') AND small) OR (regexp_matches({_last}, '(Figure|Table|Algorithm) \\d+$') AND large))"
_apart = "('" + "','".join(sorted(chunker.APART)) + "')"
_cuts = f"(fresh > 0 AND CASE WHEN {_sum} >= {chunker.MOST} THEN true WHEN roles[-1] IN {_apart} OR (role IN {_apart} AND {_sum} < {chunker.TARGET}) OR {_goes} THEN false WHEN {_sum} + {_tok.format('p.text')} > {chunker.TARGET} AND {_sum} >= {chunker.LEAST} THEN true ELSE regexp_matches({_last}, '[.!?]$') AND large AND {_sum} >= {int(0.85 * chunker.TARGET)} END)"
_keep = lambda x: f"CASE WHEN {_tok.format('texts[-1]')} >= 80 OR len(texts) = 1 THEN {x}[-1:] ELSE {x}[-2:] END"
#: Paragraphs and the chunks that a fold in reading order makes of them.
CHUNKED_ = f"""{LINES_SQL}, {PARA_}, pt AS (SELECT paper_id, paragraph, {JOINED_} AS text FROM (SELECT paper_id, paragraph, list(line ORDER BY ord) AS ls FROM para GROUP BY 1, 2)),
pr AS (SELECT paper_id, paragraph::BIGINT AS ord, text, coalesce({ROLE_.replace('line', 'text')}, '') AS role, regexp_matches(text, '^\\p{{Ll}}') AS small, regexp_matches(text, '^\\p{{Lu}}') AS large, row_number() OVER (PARTITION BY paper_id ORDER BY paragraph) AS r, count(*) OVER (PARTITION BY paper_id) AS size FROM pt WHERE text <> ''),
cf AS (SELECT DISTINCT paper_id, size, 0::BIGINT AS r, []::BIGINT[] AS ords, []::VARCHAR[] AS texts, []::VARCHAR[] AS roles, 0::BIGINT AS fresh, []::STRUCT(o BIGINT[], t VARCHAR)[] AS done FROM pr
UNION ALL SELECT f.paper_id, f.size, p.r, CASE WHEN {_cuts} THEN list_append({_keep('ords')}, p.ord) ELSE list_append(ords, p.ord) END, CASE WHEN {_cuts} THEN list_append({_keep('texts')}, p.text) ELSE list_append(texts, p.text) END, CASE WHEN {_cuts} THEN list_append({_keep('roles')}, p.role) ELSE list_append(roles, p.role) END, CASE WHEN {_cuts} THEN 1 ELSE fresh + 1 END, CASE WHEN {_cuts} THEN list_append(done, {{'o': ords, 't': array_to_string(texts, chr(10) || chr(10))}}) ELSE done END FROM cf f JOIN pr p ON p.paper_id = f.paper_id AND p.r = f.r + 1),
ch AS (SELECT paper_id, unnest(range(len(d)))::BIGINT AS chunk_index, unnest(d) AS c FROM (SELECT paper_id, list_append(done, {{'o': ords, 't': array_to_string(texts, chr(10) || chr(10))}}) AS d FROM cf WHERE r = size)), sc AS (SELECT paper_id, chunk_index, c.o AS ids, c.t AS text FROM ch)"""


def chunked(spark, sf_dir):
    return chunker.chunk(o.paragraphs(lines(spark, sf_dir)).select("paper_id", F.col("paragraph").alias("ord"), "text", o.structural_role(F.col("text")).alias("role")))


@query(f"WITH RECURSIVE {CHUNKED_} SELECT paper_id, chunk_index, md5(text) AS text_md5, array_to_string(ids, '|') AS paragraphs FROM sc")
def semantic_chunks(spark, sf_dir):
    return chunked(spark, sf_dir).select("paper_id", "chunk_index", F.md5("chunk_text").alias("text_md5"), F.array_join(F.col("paragraph_ids").cast("array<string>"), "|").alias("paragraphs"))


_dens = DENSITY_CHUNKER_.replace("doc_id", "paper_id, chunk_index").replace("FROM documents", "FROM sc")
SCORED_ = f"""SELECT *, {unit_('coherence_score * 0.24::DOUBLE + (1 - noise_score) * 0.24::DOUBLE + 0.45::DOUBLE * 0.18::DOUBLE + semantic_density_score * 0.18::DOUBLE + least(1.0::DOUBLE, semantic_density_score * 0.45::DOUBLE + least(tokens / 700.0::DOUBLE, 0.15::DOUBLE)) * 0.16::DOUBLE', 4)} AS retrieval_quality_score FROM (
SELECT paper_id, chunk_index, {_tok.format('text')} AS tokens, {unit_(f"1 - abs({_tok.format('text')} / greatest(1, {n_('[.!?]')}) - 24) / 32", 4)} AS coherence_score, {unit_(f"{n_('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92) + 's.,;:()' + chr(92) + '-]')}::DOUBLE / greatest(length(text), 1) * 4", 4)} AS noise_score, density AS semantic_density_score FROM sc JOIN ({_dens}) USING (paper_id, chunk_index))"""


@query(f"WITH RECURSIVE {CHUNKED_} {SCORED_}")
def chunk_scores(spark, sf_dir):
    return chunker.scored(chunked(spark, sf_dir))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_access(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, strftime(o_orderdate, '%Y%m%d%H%M%S') AS stamp FROM orders")
def dates(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.date_format(d, "yyyyMMddHHmmss").alias("stamp"))


@query(f"WITH {CHUNKS_SQL}, w AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(chunk_text), '[a-z0-9]{{3,}}')) AS x, lag(list_distinct(regexp_extract_all(lower(chunk_text), '[a-z0-9]{{3,}}'))) OVER (PARTITION BY paper_id ORDER BY chunk_index) AS y FROM chunks) SELECT chunk_id, round(CASE WHEN y IS NULL OR len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS overlap FROM w")
def adjacent_overlap(spark, sf_dir):
    own = positions(chunks(spark, sf_dir).withColumn("x", F.array_distinct(t.found(F.lower("chunk_text"), "[a-z0-9]{3,}"))), "x")
    before = own.select(F.col("paper_id").alias("p"), (F.col("pos") + 1).alias("at"), F.col("x").alias("y"))
    met = own.join(before, F.col("paper_id").eqNullSafe(F.col("p")) & (F.col("pos") == F.col("at")), "left")
    return met.select("chunk_id", F.round(F.coalesce(t.jaccard(F.col("x"), F.col("y")), F.lit(0.0)), 6).alias("overlap"))
