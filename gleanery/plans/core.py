"""The queries over the retrieval operators, each beside SQL that gives the same rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions import vector as V
from gleanery.operators import analysis, chunking, dense, evaluation, fusion, html, lexical, prompt, rerank, sections, validation
from gleanery.providers import NOT_FOUND, HashEmbedder, OverlapJudgeOfFour, OverlapScorer, embed_column
from gleanery.session import cut, cut_packed, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks once each, in their last delivery: ``id``, ``text`` and metadata."""
    c = table(spark, sf_dir, "semantic_chunks")
    return c.groupBy("chunk_id").agg(F.max_by(F.struct("text", "metadata"), "loaded_at").alias("c")).select(F.col("chunk_id").alias("id"), "c.text", "c.metadata")


# -- pieces of SQL ------------------------------------------------------------------------------------------------

WS, WORD = T.WS, T.WORD.replace("'", "''")


def s_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def s_slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({s_trim(x)}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def s_split(x: str, pattern: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '{pattern}'), lambda p: {s_trim('p')}), lambda p: p <> '')"


def s_sentences(x: str) -> str:
    return s_split(f"regexp_replace({s_trim(x)}, '([.!?])[{WS}]+', '\\1' || chr(1), 'g')", "\\x01")


def s_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{WS}]+'), lambda p: p <> '')"


def s_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


def s_token_set(x: str) -> str:
    return f"list_distinct(list_transform({s_tokens(x)}, lambda t: lower(t)))"


def s_jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


S_CORPUS = "SELECT chunk_id AS id, arg_max(text, loaded_at) AS text, arg_max(metadata, loaded_at) AS metadata FROM semantic_chunks GROUP BY chunk_id"


def s_bm25(documents: str, queries: str, k: int, name: str = "bm25") -> str:
    """CTEs that end in ``name`` (query_id, id, rank, score). documents: id, text. queries: query_id, query."""
    p = f"{name}_"
    return f"""
{p}doc AS MATERIALIZED (SELECT id, {s_words("coalesce(text, '')")} AS w FROM ({documents})),
{p}st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {p}doc),
{p}tf AS MATERIALIZED (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM {p}doc) GROUP BY ALL),
{p}raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM {p}tf GROUP BY term), {p}st),
{p}idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {p}raw) ELSE raw END AS idf FROM {p}raw),
{p}q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({s_words("coalesce(query, '')")}) AS term FROM ({queries})) GROUP BY ALL),
{p}sc AS (SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM {p}q JOIN {p}tf USING (term) JOIN {p}idf USING (term), {p}st GROUP BY ALL),
{p}one AS (SELECT z.query_id, d.id, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM ({queries})) z CROSS JOIN {p}doc d LEFT JOIN {p}sc s ON s.query_id = z.query_id AND s.id = d.id),
{name} AS MATERIALIZED (SELECT query_id, id, CAST(rank AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {p}one) WHERE rank <= {k})"""


def s_usable(dim: int) -> str:
    return f"len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim} AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


def s_knn(source: str, queries: str, k: int, dim: int, name: str = "knn", keep: str = "TRUE") -> str:
    """CTEs that end in ``name`` (query_id, id, rank, distance). source: id, embedding (and columns of ``keep``)."""
    p = f"{name}_"
    return f"""
{p}v AS MATERIALIZED (SELECT * REPLACE (embedding::DOUBLE[] AS embedding) FROM ({source}) WHERE {s_usable(dim)}),
{p}x AS (SELECT q.id AS query_id, c.id, round(1 - list_cosine_similarity(q.embedding, c.embedding), 6) AS distance FROM (SELECT * FROM {p}v WHERE {queries}) q, (SELECT * FROM {p}v WHERE {keep}) c),
{name} AS MATERIALIZED (SELECT query_id, id, CAST(rank AS INTEGER) AS rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM {p}x) WHERE rank <= {k})"""


# -- scalar text functions ----------------------------------------------------------------------------------------


@query(f"""SELECT chunk_id, {s_slug("metadata.section_title")} AS title_slug, {s_slug("replace(metadata.item, ' ', '')")} AS item_slug, CAST(len({s_tokens("text")}) AS INTEGER) AS tokens,
CAST(len({s_token_set("text")}) AS INTEGER) AS distinct_tokens, left(sha1(text), 10) AS hash, replace(metadata.source_file, '.html', '') AS company,
CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END AS preview, CAST(len({s_sentences("text")}) AS INTEGER) AS sentences, CAST(len({s_split("text", chr(92) + "n{2,}")}) AS INTEGER) AS paragraphs,
left({s_trim("left(text, 200)")}, 100) AS fingerprint FROM semantic_chunks""")
def text_scalars(spark, sf_dir):
    c = spread(table(spark, sf_dir, "semantic_chunks").select("chunk_id", "text", "metadata"))
    return c.select("chunk_id", T.slug("metadata.section_title").alias("title_slug"), T.item_slug("metadata.item").alias("item_slug"), T.token_count("text").alias("tokens"), F.size(T.token_set("text")).alias("distinct_tokens"), T.stable_hash("text").alias("hash"), T.company("metadata.source_file").alias("company"), T.preview("text").alias("preview"), F.size(T.sentences("text")).alias("sentences"), F.size(T.paragraphs("text")).alias("paragraphs"), T.fingerprint("text").alias("fingerprint"))


@query(f"SELECT chunk_id, round({s_jaccard('a', 'b')}, 6) AS similarity FROM (SELECT chunk_id, {s_token_set('s[1]')} AS a, {s_token_set('s[len(s)]')} AS b FROM (SELECT chunk_id, {s_sentences('text')} AS s FROM semantic_chunks) WHERE len(s) > 0)")
def sentence_jaccard(spark, sf_dir):
    """Of each chunk, how alike its first and its last sentence are."""
    s = spread(table(spark, sf_dir, "semantic_chunks").select("chunk_id", "text")).select("chunk_id", T.sentences("text").alias("s")).where(F.size("s") > 0)
    return s.select("chunk_id", F.round(T.jaccard(T.token_set(F.element_at("s", 1)), T.token_set(F.element_at("s", -1))), 6).alias("similarity"))


# -- lexical retrieval --------------------------------------------------------------------------------------------

S_QUESTIONS = "SELECT question_id AS query_id, question AS query FROM gold_questions"
S_GOLD = "SELECT question_id AS query_id, list_filter(list_distinct(list_concat(coalesce(gold_chunk_ids, []), coalesce(primary_gold_chunk_ids, []), coalesce(supporting_gold_chunk_ids, []))), lambda x: x IS NOT NULL AND x <> '') AS gold, list_filter(list_distinct(coalesce(primary_gold_chunk_ids, [])), lambda x: x IS NOT NULL AND x <> '') AS prime FROM gold_questions"


def questions(spark, sf_dir):
    return table(spark, sf_dir, "gold_questions").select(F.col("question_id").alias("query_id"), F.col("question").alias("query"))


def bm25_hits(spark, sf_dir, k=10):
    return lexical.search(lexical.build(corpus(spark, sf_dir), "id", "text"), questions(spark, sf_dir), k)


@query("WITH " + s_bm25(S_CORPUS, S_QUESTIONS, 10).split("bm25_q AS")[0].rstrip().rstrip(",") + " SELECT term, round(idf, 6) AS idf FROM bm25_idf")
def bm25_terms(spark, sf_dir):
    return lexical.build(corpus(spark, sf_dir), "id", "text").terms.select("term", F.round("idf", 6).alias("idf"))


@query(f"WITH {s_bm25(S_CORPUS, S_QUESTIONS, 10)} SELECT * FROM bm25")
def bm25_topk(spark, sf_dir):
    return bm25_hits(spark, sf_dir)


@query(f"""WITH {s_bm25(S_CORPUS, S_QUESTIONS, 10)}, g AS ({S_GOLD}),
f AS (SELECT g.query_id, w.what, (SELECT min(rank) FROM bm25 b WHERE b.query_id = g.query_id AND list_contains(w.ids, b.id)) AS r FROM g, LATERAL (SELECT 'any' AS what, g.gold AS ids UNION ALL SELECT 'primary', g.prime) w)
SELECT what, count(*) AS n_questions, round(avg(coalesce(r <= 1, false)::INT), 4) AS recall_at_1, round(avg(coalesce(r <= 5, false)::INT), 4) AS recall_at_5, round(avg(coalesce(r <= 10, false)::INT), 4) AS recall_at_10, round(round(avg(coalesce(1.0 / r, 0)), 8), 4) AS mrr FROM f GROUP BY what""")
def eval_gold(spark, sf_dir):
    """Recall and reciprocal rank of BM25 on the gold questions, for any gold id and for primary ones."""
    gold = table(spark, sf_dir, "gold_questions")
    hits = bm25_hits(spark, sf_dir)
    lists = {"any": ("gold_chunk_ids", "primary_gold_chunk_ids", "supporting_gold_chunk_ids"), "primary": ("primary_gold_chunk_ids",)}
    both = F.array(*[F.struct(F.lit(what).alias("what"), evaluation.all_gold(*columns).alias("gold")) for what, columns in lists.items()])
    g = gold.select(F.col("question_id").alias("query_id"), F.explode(both).alias("g")).select("query_id", "g.what", "g.gold")
    return evaluation.summarise(evaluation.per_question(hits, g, by=(), kinds=("what",)), by=("what",))


# a corpus of so few words that most of them stand in most documents, and weigh less than nothing
FREQUENT = "CASE WHEN doc_id % 7 = 0 THEN 'x y' WHEN doc_id % 5 = 0 THEN 'x y z z' WHEN doc_id % 11 = 0 THEN 'w' WHEN doc_id % 13 = 0 THEN '' ELSE 'x x y' END"
ASKED = "CASE right(question_id, 1) WHEN '1' THEN 'x' WHEN '2' THEN 'x z' WHEN '3' THEN 'w' WHEN '4' THEN 'unknown' WHEN '5' THEN 'y y w' WHEN '6' THEN NULL ELSE 'z' END"
S_FREQUENT = f"WITH {s_bm25(f'SELECT doc_id AS id, {FREQUENT} AS text FROM documents', f'SELECT question_id AS query_id, {ASKED} AS query FROM gold_questions', 20)} SELECT * FROM bm25"


def frequent(spark, sf_dir, **options):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(FREQUENT).alias("text"))
    asked = table(spark, sf_dir, "gold_questions").select(F.col("question_id").alias("query_id"), F.expr(ASKED).alias("query"))
    return lexical.search(lexical.build(docs, "id", "text"), asked, 20, **options)


@query(S_FREQUENT)
def bm25_frequent_words(spark, sf_dir):
    """Scores below 0, documents that fill up, queries without words: within the tasks."""
    return frequent(spark, sf_dir)


@query(S_FREQUENT)
def bm25_frequent_words_by_join(spark, sf_dir):
    """The same hits by the way of large query sets."""
    return frequent(spark, sf_dir, sent_bytes=0)


@query(f"WITH {s_bm25(S_CORPUS, S_QUESTIONS, 10)} SELECT * FROM bm25")
def bm25_topk_by_join(spark, sf_dir):
    return lexical.search(lexical.build(corpus(spark, sf_dir), "id", "text"), questions(spark, sf_dir), 10, sent_bytes=0)


# -- dense retrieval ----------------------------------------------------------------------------------------------

S_VECTORS = "SELECT vec_id AS id, embedding, metadata FROM semantic_index"


@query(f"WITH {s_knn(S_VECTORS, 'id % 100 = 0', 5, 96)} SELECT * FROM knn")
def knn_cosine(spark, sf_dir):
    v = table(spark, sf_dir, "semantic_index")
    return dense.knn(v, v.where("vec_id % 100 = 0"), 5)


FILTER = {"$and": [{"metadata.part": {"$in": ["PART I", "PART II"]}}, {"metadata.item": {"$ne": "Item 7"}}]}


@query(f"WITH {s_knn(S_VECTORS, 'id % 100 = 0', 5, 96, keep=chr(10).join(['metadata.part IN (' + repr('PART I') + ', ' + repr('PART II') + ') AND metadata.item <> ' + repr('Item 7')]))} SELECT * FROM knn")
def knn_filtered(spark, sf_dir):
    v = table(spark, sf_dir, "semantic_index")
    return dense.knn(v, v.where("vec_id % 100 = 0"), 5, where=FILTER)


@query(f"WITH {s_knn('SELECT vec_id AS id, embedding FROM embeddings', 'id % 100 = 0', 10, 64)} SELECT query_id, round(avg((a.label = b.label)::INT), 4) AS same_label FROM knn JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = id WHERE query_id <> id GROUP BY query_id")
def knn_label_share(spark, sf_dir):
    """Of each query vector, the share of its neighbours that bear its label."""
    e = table(spark, sf_dir, "embeddings")
    near = dense.knn(e, e.where("vec_id % 100 = 0"), 10, 64).where("query_id <> id")
    a, b = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), e.select(F.col("vec_id").alias("id"), "label")
    return near.join(a, "query_id").join(b, "id").groupBy("query_id").agg(F.round(F.avg((F.col("own") == F.col("label")).cast("int")), 4).alias("same_label"))


@query("""WITH h AS (SELECT question_id, sha256(question) AS a FROM gold_questions), h2 AS (SELECT *, sha256(unhex(a) || '0'::BLOB) AS b FROM h), h3 AS (SELECT *, sha256(unhex(b) || '1'::BLOB) AS c FROM h2),
v AS (SELECT question_id, unnest(range(96)) AS dim, upper(a || b || c) AS hex FROM h3),
x AS (SELECT question_id, dim, (instr('0123456789ABCDEF', substr(hex, 2 * dim + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex, 2 * dim + 2, 1)) - 1 AS byte FROM v)
SELECT question_id, CAST(dim AS INTEGER) AS dim, round(CAST(CAST(byte / sqrt(sum(byte * byte) OVER (PARTITION BY question_id)) AS FLOAT) AS DOUBLE), 5) AS value FROM x""")
def hash_embedding(spark, sf_dir):
    """The offline embedding of each gold question, one row a dimension."""
    q = embed_column(table(spark, sf_dir, "gold_questions").select("question_id", "question"), "question", HashEmbedder)
    return q.select("question_id", F.posexplode("embedding").alias("dim", "v")).select("question_id", "dim", F.round(F.col("v").cast("double"), 5).alias("value"))


# -- fusion and evaluation on spans -------------------------------------------------------------------------------

S_INDEXED = f"SELECT i.vec_id AS id, c.text, i.embedding FROM semantic_index i JOIN ({S_CORPUS}) c ON c.id = i.chunk_id"
S_SPANS = f"""SELECT query_id, array_to_string(w[p + 1 : p + 14], ' ') AS query FROM (SELECT query_id, w, CAST(('0x' || left(md5(CAST(query_id AS VARCHAR)), 6)) AS BIGINT) % (len(w) - 19) AS p
FROM (SELECT id AS query_id, {s_words("substr(text, 41)")} AS w FROM ({S_INDEXED}) WHERE id % 100 = 0) WHERE len(w) >= 25)"""
S_LEGS = f"WITH {s_bm25(f'SELECT id, text FROM ({S_INDEXED})', S_SPANS, 20)}, {s_knn(f'SELECT id, embedding FROM ({S_INDEXED})', f'id IN (SELECT query_id FROM ({S_SPANS}))', 20, 96)}"


def indexed(spark, sf_dir, *more):
    """Indexed chunks: ``id``, ``text`` and columns of the index."""
    i = table(spark, sf_dir, "semantic_index").select(F.col("vec_id").alias("id"), "chunk_id", *more)
    # the text alone, as all that is taken along is shuffled
    texts = table(spark, sf_dir, "semantic_chunks").groupBy("chunk_id").agg(F.max_by("text", "loaded_at").alias("text"))
    return i.join(texts, "chunk_id").select("id", "text", *more)


def span_table(spark, sf_dir, *more):
    """Texts of the index, and spans cut from a hundredth of them, with the vector of their text."""
    docs = cut_packed(indexed(spark, sf_dir, *more))  # read for the spans, for the index of words and for reranking
    v = table(spark, sf_dir, "semantic_index").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    spans = cut(evaluation.spans(docs.where("id % 100 = 0")).join(v, "query_id", "left"))
    return docs, spans


def legs(spark, sf_dir, k=20):
    """Span queries with their lexical and dense hits, each list made once; the gold id of a span is the chunk it was cut from."""
    docs, spans = span_table(spark, sf_dir)
    v = table(spark, sf_dir, "semantic_index").select(F.col("vec_id").alias("id"), "embedding")
    x = cut(lexical.search(lexical.build(docs, "id", "text"), spans, k))
    d = cut(dense.knn(v, spans, k, 96, "id", "embedding", "query_id", "embedding"))
    return spans.select("query_id", "query"), x, d, docs


def s_tokenset(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[{chr(92)}p{{L}}{chr(92)}p{{N}}_]+'))"


def s_rerank(source: str, k: int, name: str = "rr") -> str:
    """CTEs that end in ``name`` (query_id, id, rank, score): the best of ``source`` by the share of query words in the text."""
    return f"""{name}_w AS (SELECT query_id, {s_tokenset("query")} AS q FROM ({S_SPANS})),
{name}_s AS (SELECT r.query_id, r.id, CASE WHEN len(w.q) = 0 THEN 0.0 ELSE len(list_intersect(w.q, {s_tokenset("coalesce(t.text, '')")}))::DOUBLE / len(w.q) END AS score FROM ({source}) r JOIN {name}_w w USING (query_id) JOIN ({S_INDEXED}) t ON t.id = r.id),
{name} AS MATERIALIZED (SELECT query_id, id, CAST(rank AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_s) WHERE rank <= {k})"""


def s_rrf(k: int, pool: int, missing: str = "0.0", name: str = "rrf") -> str:
    part = lambda c: f"coalesce(1.0::DOUBLE / (60 + {c}), {missing})"
    return f"""{name}_j AS (SELECT coalesce(d.query_id, x.query_id) AS query_id, coalesce(d.id, x.id) AS id, d.rank AS dense_rank, x.rank AS lexical_rank FROM (SELECT * FROM knn WHERE rank <= {pool}) d FULL JOIN (SELECT * FROM bm25 WHERE rank <= {pool}) x ON d.query_id = x.query_id AND d.id = x.id),
{name}_s AS (SELECT *, round({part("dense_rank")} + {part("lexical_rank")}, 9) AS score FROM {name}_j),
{name} AS (SELECT query_id, id, CAST(rank AS INTEGER) AS rank, score, dense_rank, lexical_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, id) AS rank FROM {name}_s) WHERE rank <= {k})"""


@query(f"{S_LEGS}, {s_rrf(5, 5)} SELECT * FROM rrf")
def rrf_hybrid(spark, sf_dir):
    _, x, d, _ = legs(spark, sf_dir)
    return fusion.reciprocal_rank(d, x, 5)


@query(f"{S_LEGS}, {s_rrf(10, 20, '1.0::DOUBLE / (60 + 9999)')} SELECT * FROM rrf")
def rrf_missing_rank(spark, sf_dir):
    _, x, d, _ = legs(spark, sf_dir)
    return fusion.reciprocal_rank(d, x, 10, pool=20, missing_rank=9999)


S_DOCS = "SELECT doc_id AS id, text FROM documents"


@query(f"""WITH {s_bm25(S_CORPUS, S_QUESTIONS, 8, "chunks")}, {s_bm25(S_DOCS, S_QUESTIONS, 8, "docs")},
u AS (SELECT query_id, 'chunks:' || id AS key, 0 AS source, rank FROM chunks UNION ALL SELECT query_id, 'documents:' || CAST(id AS VARCHAR), 1, rank FROM docs),
s AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(source) AS source, min(rank) AS r FROM u GROUP BY ALL)
SELECT query_id, key, CAST(rank AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, r, key) AS rank FROM s) WHERE rank <= 10""")
def rrf_two_indexes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return fusion.fuse_indexes({"chunks": bm25_hits(spark, sf_dir, 8), "documents": lexical.search(lexical.build(docs, "id", "text"), questions(spark, sf_dir), 8)})


S_HITS = f"""{S_LEGS}, {s_rrf(10, 20)}, {s_rrf(20, 20, name="pool")}, {s_rerank("SELECT query_id, id FROM pool", 10)},
hits AS (SELECT 'bm25' AS strategy, query_id, id, rank FROM bm25 WHERE rank <= 10 UNION ALL SELECT 'semantic', query_id, id, rank FROM knn WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, id, rank FROM rrf UNION ALL SELECT 'hybrid_rerank', query_id, id, rank FROM rr)"""
STRATEGIES = ["bm25", "hybrid", "hybrid_rerank", "semantic"]
S_STRATEGIES = "SELECT unnest([" + ", ".join(f"'{s}'" for s in STRATEGIES) + "]) AS strategy"
S_SCORES = f"""{S_HITS}, sc AS (SELECT q.query_id, s.strategy, (SELECT min(rank) FROM hits h WHERE h.strategy = s.strategy AND h.query_id = q.query_id AND h.id = q.query_id) AS r FROM (SELECT query_id FROM ({S_SPANS})) q, ({S_STRATEGIES}) s)"""
S_METRICS = "round(avg(coalesce(r <= 1, false)::INT), 4) AS recall_at_1, round(avg(coalesce(r <= 5, false)::INT), 4) AS recall_at_5, round(avg(coalesce(r <= 10, false)::INT), 4) AS recall_at_10, round(round(avg(coalesce(1.0 / r, 0)), 8), 4) AS mrr"


def reranked(fused, docs, spans, k):
    return rerank.rerank(rerank.with_texts(fused.select("query_id", "id").join(spans, "query_id"), docs), k, OverlapScorer)


def strategy_hits(spark, sf_dir):
    """Ten hits of each strategy; every list is made once."""
    spans, x, d, docs = legs(spark, sf_dir)
    pool = cut(fusion.reciprocal_rank(d, x, 20))
    named = lambda df, n: df.where("rank <= 10").select(F.lit(n).alias("strategy"), "query_id", "id", "rank")
    hits = named(x, "bm25").union(named(d, "semantic")).union(named(pool, "hybrid")).union(named(reranked(pool, docs, spans, 10), "hybrid_rerank"))
    return spans, cut(hits)


def strategy_scores(spark, sf_dir):
    spans, hits = strategy_hits(spark, sf_dir)
    return evaluation.per_question(hits, spans.select("query_id", F.array("query_id").alias("gold")), strategies=STRATEGIES)


@query(f"{S_SCORES} SELECT strategy, count(*) AS n_questions, {S_METRICS} FROM sc GROUP BY strategy")
def eval_strategies(spark, sf_dir):
    return evaluation.summarise(strategy_scores(spark, sf_dir))


@query(f"{S_SCORES} SELECT strategy, round(avg(coalesce(r <= 1, false)::INT), 4) AS \"R@1\", round(avg(coalesce(r <= 5, false)::INT), 4) AS \"R@5\", round(avg(coalesce(r <= 10, false)::INT), 4) AS \"R@10\", round(round(avg(coalesce(1.0 / r, 0)), 8), 4) AS \"MRR\" FROM sc GROUP BY strategy")
def summary_table(spark, sf_dir):
    return analysis.summary_table(evaluation.summarise(strategy_scores(spark, sf_dir)))


# gold of which strategies differ: by the number of the query its own chunk, one that only the vectors rank fifth, one that
# only the words rank fifth, the first reranked hit that no other list has among its five, or none at all
S_SPLIT = f"""{S_HITS}, alone AS (SELECT query_id, arg_min(id, rank) AS id FROM hits h WHERE strategy = 'hybrid_rerank' AND rank <= 5 AND NOT EXISTS (SELECT 1 FROM hits o WHERE o.strategy <> 'hybrid_rerank' AND o.rank <= 5 AND o.query_id = h.query_id AND o.id = h.id) GROUP BY query_id),
gold AS (SELECT q.query_id, CASE q.query_id // 100 % 5 WHEN 0 THEN q.query_id WHEN 1 THEN (SELECT id FROM knn WHERE rank = 5 AND knn.query_id = q.query_id) WHEN 2 THEN (SELECT id FROM bm25 WHERE rank = 5 AND bm25.query_id = q.query_id) WHEN 3 THEN (SELECT id FROM alone WHERE alone.query_id = q.query_id) END AS id FROM (SELECT query_id FROM ({S_SPANS})) q),
sc AS (SELECT g.query_id, s.strategy, (SELECT min(rank) FROM hits h WHERE h.strategy = s.strategy AND h.query_id = g.query_id AND h.id = g.id) AS r FROM gold g, ({S_STRATEGIES}) s)"""


def split_scores(spark, sf_dir):
    spans, hits = strategy_hits(spark, sf_dir)
    five = hits.where("rank <= 5")
    at = lambda s: five.where((F.col("strategy") == s) & (F.col("rank") == 5)).select("query_id", F.col("id").alias(s))
    seen = five.where("strategy <> 'hybrid_rerank'").select("query_id", "id")
    only = five.where("strategy = 'hybrid_rerank'").join(seen, ["query_id", "id"], "left_anti").groupBy("query_id").agg(F.min_by("id", "rank").alias("only"))
    q = spans.select("query_id").join(at("semantic"), "query_id", "left").join(at("bm25"), "query_id", "left").join(only, "query_id", "left")
    kind = F.floor(F.col("query_id") / 100) % 5
    gold = F.when(kind == 0, F.col("query_id")).when(kind == 1, F.col("semantic")).when(kind == 2, F.col("bm25")).when(kind == 3, F.col("only"))
    return evaluation.per_question(hits, q.select("query_id", F.filter(F.array(gold), lambda x: x.isNotNull()).alias("gold")), strategies=STRATEGIES)


@query(f"{S_SPLIT} SELECT query_id, " + ", ".join(f"max(CASE WHEN strategy = '{s}' THEN coalesce(r <= 5, false)::INT END) AS {s}" for s in STRATEGIES) + " FROM sc GROUP BY query_id")
def hit_matrix(spark, sf_dir):
    return analysis.hit_matrix(split_scores(spark, sf_dir), STRATEGIES)


@query(f"{S_SPLIT} SELECT query_id FROM sc GROUP BY query_id HAVING max(coalesce(r <= 5, false)::INT) = 0")
def missed_by_all(spark, sf_dir):
    return analysis.missed_by_all(split_scores(spark, sf_dir))


def s_won(strategy: str) -> str:
    return f"{S_SPLIT} SELECT query_id FROM sc GROUP BY query_id HAVING max(CASE WHEN strategy = '{strategy}' THEN coalesce(r <= 5, false)::INT END) = 1 AND max(CASE WHEN strategy <> '{strategy}' THEN coalesce(r <= 5, false)::INT END) = 0"


@query(s_won("semantic"))
def won_only_by_semantic(spark, sf_dir):
    return analysis.won_only_by(split_scores(spark, sf_dir), "semantic")


@query(s_won("hybrid_rerank"))
def won_only_by_rerank(spark, sf_dir):
    return analysis.won_only_by(split_scores(spark, sf_dir), "hybrid_rerank")


@query(f"{S_SCORES} SELECT query_id, round({s_jaccard('a', 'b')}, 6) AS jaccard FROM (SELECT query_id, coalesce(list(id) FILTER (strategy = 'bm25'), []) AS a, coalesce(list(id) FILTER (strategy = 'semantic'), []) AS b FROM hits WHERE rank <= 5 GROUP BY query_id)")
def strategy_overlap(spark, sf_dir):
    return evaluation.overlap(strategy_hits(spark, sf_dir)[1], "bm25", "semantic").select("query_id", F.round("jaccard", 6).alias("jaccard"))


@query(f"{S_LEGS}, {s_rrf(20, 20, name='pool')}, {s_rerank('SELECT query_id, id FROM pool', 5)} SELECT * FROM rr")
def rerank_cascade(spark, sf_dir):
    """Twenty fused candidates a span, the best five by the scorer of pairs."""
    spans, x, d, docs = legs(spark, sf_dir)
    return reranked(fusion.reciprocal_rank(d, x, 20), docs, spans, 5)


# -- the registry of retrievers, over one index of words ------------------------------------------------------------


def registry_hits(spark, sf_dir, strategies, k, **options):
    corpus, spans = span_table(spark, sf_dir, "embedding")
    index, lists = lexical.build(corpus, "id", "text"), rerank.Lists(20 if "hybrid_rerank" in strategies else k)
    found = [rerank.retriever(corpus, s, k, index=index, lists=lists, **options)(spans).select(F.lit(s).alias("strategy"), "*") for s in strategies]
    return functools.reduce(DataFrame.union, found)


@query(f"""{S_LEGS}, {s_rrf(5, 5)}, {s_rrf(20, 20, name="pool")}, {s_rerank("SELECT query_id, id FROM pool", 5)}
SELECT 'semantic' AS strategy, query_id, id, rank, 1 - distance AS score FROM knn WHERE rank <= 5 UNION ALL SELECT 'bm25', query_id, id, rank, score FROM bm25 WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, id, rank, score FROM rrf UNION ALL SELECT 'hybrid_rerank', query_id, id, rank, score FROM rr""")
def retrievers(spark, sf_dir):
    return registry_hits(spark, sf_dir, rerank.STRATEGIES, 5)


S_FROM_ZERO = s_rrf(5, 5).replace("(60 + d.rank)", "(59 + d.rank)").replace("(60 + dense_rank)", "(59 + dense_rank)").replace("(60 + lexical_rank)", "(59 + lexical_rank)")


@query(f"{S_LEGS}, {S_FROM_ZERO} SELECT 'hybrid' AS strategy, query_id, id, rank, score FROM rrf")
def retriever_ranks_from_zero(spark, sf_dir):
    """The fusion of the second engine, whose ranks begin at 0."""
    return registry_hits(spark, sf_dir, ["hybrid"], 5, rank_base=0)


@query(f"{S_LEGS}, {s_rrf(20, 20, '1.0::DOUBLE / (60 + 9999)')} SELECT 'hybrid_rerank' AS strategy, query_id, id, rank, score FROM rrf WHERE rank <= 5")
def retriever_pool(spark, sf_dir):
    """The pool of the reranker without the reranker, as the interactive surface shows it."""
    return registry_hits(spark, sf_dir, ["hybrid_rerank"], 5, scorer=None, missing_rank=9999)


S_RUN = f"""{S_LEGS}, {s_rrf(10, 10)}, {s_rrf(20, 20, name="pool")}, {s_rerank("SELECT query_id, id FROM pool", 10)},
hits AS (SELECT 'bm25' AS strategy, query_id, id, rank FROM bm25 WHERE rank <= 10 UNION ALL SELECT 'semantic', query_id, id, rank FROM knn WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, id, rank FROM rrf UNION ALL SELECT 'hybrid_rerank', query_id, id, rank FROM rr),
sc AS (SELECT q.query_id, q.query, s.strategy, (SELECT min(rank) FROM hits h WHERE h.strategy = s.strategy AND h.query_id = q.query_id AND h.id = q.query_id) AS r FROM ({S_SPANS}) q, ({S_STRATEGIES}) s)"""


def evaluated(spark, sf_dir):
    corpus, spans = span_table(spark, sf_dir, "embedding")
    index, lists = lexical.build(corpus, "id", "text"), rerank.Lists(20)  # the pool of the reranker
    gold = spans.select("query_id", F.array("query_id").alias("gold"), F.when(F.col("query_id") % 200 == 0, F.array("query_id")).otherwise(F.array().cast("array<bigint>")).alias("prime"))
    return evaluation.evaluate({s: rerank.retriever(corpus, s, 10, index=index, lists=lists) for s in STRATEGIES}, spans, gold, lists=lists)


@query(f"""{S_RUN}, pr AS (SELECT strategy, CASE WHEN query_id % 200 = 0 THEN r END AS r FROM sc)
SELECT a.*, p.* EXCLUDE (strategy) FROM (SELECT strategy, count(*) AS n_questions, {S_METRICS} FROM sc GROUP BY strategy) a JOIN (SELECT strategy, {S_METRICS.replace(" AS ", " AS primary_")} FROM pr GROUP BY strategy) p USING (strategy)""")
def evaluate_retrievers(spark, sf_dir):
    """Four strategies over all spans, for any gold id and for primary ones; the latency differs from run to run and is left out."""
    return evaluated(spark, sf_dir)[1].drop("mean_latency_ms")


@query(f"{S_RUN} SELECT strategy, query_id, query, (SELECT to_json(list(id ORDER BY rank))::VARCHAR FROM hits h WHERE h.strategy = sc.strategy AND h.query_id = sc.query_id) AS hit_ids, coalesce(1.0 / r, 0)::DOUBLE AS rr FROM sc")
def evaluate_questions(spark, sf_dir):
    return evaluated(spark, sf_dir)[0].select("strategy", "query_id", "query", F.to_json("hit_ids").alias("hit_ids"), "rr")


@query(f"""WITH {s_bm25(S_CORPUS, S_QUESTIONS, 10)}, c AS ({S_CORPUS}), g AS (SELECT query_id, unnest(gold) AS id FROM ({S_GOLD})), m AS (SELECT DISTINCT query_id, left({s_trim("left(text, 200)")}, 100) AS mark FROM g JOIN c USING (id) WHERE text <> ''),
f AS (SELECT query_id, min(rank) AS first_rank FROM bm25 JOIN m USING (query_id) JOIN c USING (id) WHERE contains(left(c.text, 400), mark) GROUP BY query_id)
SELECT query_id, first_rank, coalesce(1.0 / first_rank, 0)::DOUBLE AS rr FROM (SELECT DISTINCT query_id FROM g) LEFT JOIN f USING (query_id)""")
def fingerprint_hits(spark, sf_dir):
    c = corpus(spark, sf_dir).select("id", "text")
    gold = table(spark, sf_dir, "gold_questions").select(F.col("question_id").alias("query_id"), F.explode(evaluation.all_gold("gold_chunk_ids", "primary_gold_chunk_ids", "supporting_gold_chunk_ids")).alias("id"))
    texts = gold.join(c, "id", "left").select("query_id", F.coalesce("text", F.lit("")).alias("gold_text"))
    return evaluation.fingerprint_hits(bm25_hits(spark, sf_dir).join(c, "id"), texts)


# -- chunking -----------------------------------------------------------------------------------------------------


def as_sections(spark, sf_dir):
    """Documents as sections of their filing."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source_file", "item", "text")).select("doc_id", "source_file", F.lit(None).cast("string").alias("part"), F.coalesce("item", F.lit("Item 0")).alias("item"), F.lit(None).cast("string").alias("title"), "text")


def chunk_rows(spark, sf_dir, strategy):
    c = chunking.chunk(as_sections(spark, sf_dir), strategy, ("doc_id",))
    return c.select("doc_id", "chunk_id", "text", F.col("metadata.chunk_index").alias("chunk_index"), F.col("metadata.char_count").alias("char_count"), F.col("metadata.token_count").alias("token_count"))


def s_chunks(pieces: str) -> str:
    """``pieces``: an expression over ``text`` and ``s``, the sentences."""
    stem = s_slug("regexp_replace(source_file, '(.)[.][^./]*$', '" + chr(92) + "1')")
    item = s_slug("replace(coalesce(item, 'Item 0'), ' ', '')")
    return f"""SELECT doc_id, format('{{}}_{{}}_chunk_{{:03d}}', stem, item, chunk_index) AS chunk_id, text, chunk_index, CAST(length(text) AS INTEGER) AS char_count, CAST(len({s_tokens("text")}) AS INTEGER) AS token_count
FROM (SELECT doc_id, {stem} AS stem, {item} AS item, unnest(p) AS text, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS chunk_index FROM (SELECT doc_id, source_file, item, {pieces} AS p FROM (SELECT *, {s_sentences("text")} AS s FROM documents)))"""


S_SEMANTIC = f"""(SELECT CASE WHEN len(s) = 0 THEN [] ELSE list_append(z.done, z.cur) END FROM (SELECT list_reduce(list_transform(s[2:], lambda x: {{'done': []::VARCHAR[], 'cur': x, 'seen': {s_token_set("x")}}}),
lambda a, b: CASE WHEN length(a.cur) + 1 + length(b.cur) > 1300 OR (length(a.cur) >= 700 AND ({s_jaccard("a.seen", "b.seen")}) < 0.18) THEN {{'done': list_append(a.done, a.cur), 'cur': b.cur, 'seen': b.seen}}
ELSE {{'done': a.done, 'cur': a.cur || ' ' || b.cur, 'seen': list_distinct(list_concat(a.seen, b.seen))}} END, {{'done': []::VARCHAR[], 'cur': s[1], 'seen': {s_token_set("s[1]")}}}) AS z))"""


@query(s_chunks(S_SEMANTIC))
def chunk_semantic(spark, sf_dir):
    return chunk_rows(spark, sf_dir, "semantic")


S_TAIL = "list_filter(range(1, len(a.cur) + 1), lambda j: length(array_to_string(a.cur[j:], ' ')) <= 300)"
S_FIXED = f"""(SELECT CASE WHEN len(s) = 0 THEN [] ELSE list_append(z.done, array_to_string(z.cur, ' ')) END FROM (SELECT list_reduce(list_transform(s[2:], lambda x: {{'done': []::VARCHAR[], 'cur': [x]}}),
lambda a, b: CASE WHEN length(array_to_string(a.cur, ' ')) + 1 + length(b.cur[1]) <= 1200 THEN {{'done': a.done, 'cur': list_concat(a.cur, b.cur)}}
ELSE {{'done': list_append(a.done, array_to_string(a.cur, ' ')), 'cur': CASE WHEN len({S_TAIL}) > 0 THEN list_concat(a.cur[({S_TAIL})[1]:], b.cur) ELSE b.cur END}} END, {{'done': []::VARCHAR[], 'cur': [s[1]]}}) AS z))"""


@query(s_chunks(S_FIXED))
def chunk_fixed(spark, sf_dir):
    return chunk_rows(spark, sf_dir, "fixed")


def s_pack(s: str) -> str:
    return f"""(SELECT list_append(z.done, z.cur) FROM (SELECT list_reduce(list_transform(({s})[2:], lambda x: {{'done': []::VARCHAR[], 'cur': x}}), lambda a, b: CASE WHEN length(a.cur) + 1 + length(b.cur) <= 1200 THEN {{'done': a.done, 'cur': a.cur || ' ' || b.cur}}
ELSE {{'done': list_append(a.done, a.cur), 'cur': b.cur}} END, {{'done': []::VARCHAR[], 'cur': ({s})[1]}}) AS z))"""


S_PARAGRAPHS = s_split("text", "\\n{2,}")
S_RECURSIVE = f"""SELECT doc_id, source_file, item, p_no, sub, {s_trim("piece")} AS piece FROM (
SELECT doc_id, source_file, item, p_no, unnest(range(len(ps))) AS sub, unnest(ps) AS piece FROM (
SELECT *, CASE WHEN length(para) <= 1200 THEN [para] WHEN len({s_sentences("para")}) > 1 THEN {s_pack(s_sentences("para"))} ELSE list_transform(range(0, CAST(ceil(length(para) / 1200.0) AS BIGINT)), lambda i: substr(para, i * 1200 + 1, 1200)) END AS ps
FROM (SELECT doc_id, source_file, item, unnest(range(len(q))) AS p_no, unnest(q) AS para FROM (SELECT *, CASE WHEN length(text) <= 1200 OR len({S_PARAGRAPHS}) <= 1 THEN [text] ELSE {S_PARAGRAPHS} END AS q FROM documents WHERE text IS NOT NULL)))) WHERE {s_trim("piece")} <> ''"""


@query(f"""SELECT doc_id, format('{{}}_{{}}_chunk_{{:03d}}', {s_slug("regexp_replace(source_file, '(.)[.][^./]*$', '" + chr(92) + "1')")}, {s_slug("replace(coalesce(item, 'Item 0'), ' ', '')")}, chunk_index) AS chunk_id, piece AS text, chunk_index, CAST(length(piece) AS INTEGER) AS char_count, CAST(len({s_tokens("piece")}) AS INTEGER) AS token_count
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p_no, sub) AS INTEGER) AS chunk_index FROM ({S_RECURSIVE}))""")
def chunk_recursive(spark, sf_dir):
    return chunk_rows(spark, sf_dir, "recursive")


@query(f"SELECT 'semantic' AS strategy, count(*) AS chunks, sum(char_count)::BIGINT AS chars, max(char_count) AS longest, round(avg(token_count), 4) AS mean_tokens FROM ({s_chunks(S_SEMANTIC)}) UNION ALL SELECT 'fixed', count(*), sum(char_count)::BIGINT, max(char_count), round(avg(token_count), 4) FROM ({s_chunks(S_FIXED)})")
def chunk_stats(spark, sf_dir):
    out = None
    for s in ("semantic", "fixed"):
        one = chunk_rows(spark, sf_dir, s).agg(F.lit(s).alias("strategy"), F.count("*").alias("chunks"), F.sum("char_count").alias("chars"), F.max("char_count").alias("longest"), F.round(F.avg("token_count"), 4).alias("mean_tokens"))
        out = one if out is None else out.union(one)
    return out


@query(f"SELECT doc_id, chunk_index, text FROM ({s_chunks(S_SEMANTIC)})")
def chunk_semantic_arrow(spark, sf_dir):
    return chunking.arrow_semantic(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


def s_count(x: str) -> str:
    return f"list_sum(list_transform({x}, lambda t: len({s_tokens('t')})))"


S_REST = f"list_filter(range(1, len(a.cur) + 1), lambda j: {s_count('a.cur[j:]')} <= 50)"
S_WINDOWS = f"""(SELECT CASE WHEN len(s) = 0 THEN [] ELSE list_append(z.done, array_to_string(z.cur, ' ')) END FROM (SELECT list_reduce(list_transform(s[2:], lambda x: {{'done': []::VARCHAR[], 'cur': [x]}}),
lambda a, b: CASE WHEN {s_count("a.cur")} + len({s_tokens("b.cur[1]")}) <= 512 THEN {{'done': a.done, 'cur': list_concat(a.cur, b.cur)}}
ELSE {{'done': list_append(a.done, array_to_string(a.cur, ' ')), 'cur': CASE WHEN len({S_REST}) > 0 THEN list_concat(a.cur[({S_REST})[1]:], b.cur) ELSE b.cur END}} END, {{'done': []::VARCHAR[], 'cur': [s[1]]}}) AS z))"""


@query(f"SELECT doc_id, unnest(p) AS text, CAST(unnest(range(len(p))) AS INTEGER) AS chunk_index FROM (SELECT doc_id, {S_WINDOWS} AS p FROM (SELECT doc_id, {s_sentences('text')} AS s FROM documents))")
def chunk_token_windows(spark, sf_dir):
    return chunking.token_windows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


# -- HTML, sections and their checks ------------------------------------------------------------------------------


# pages made of documents, in words that both engines read: lines as paragraphs with references, and all that must vanish
ESCAPED = "replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '’', '&#8217;'), '—', '&mdash;'), chr(10), '</p>' || chr(10) || '<p>')"
HEAD = "'<html><head><title></title><style>p {margin: 0}</style><script>if (a < b) { c(\"<p>no</p>\"); }</script></head><body><!-- <p>no</p> --><div><a href=\"#i\">link <b>text</b></a></div><p>Item&#160;' || CAST(doc_id % 16 + 1 AS STRING) || '. &#x201C;Caf&#233;&#x201D;</p><ix:x><p>'"
PAGE = f"{HEAD} || {ESCAPED} || '</p></ix:x><p>end</p></body></html>'"
# the same with links that nobody closes
BROKEN = f"{HEAD} || {ESCAPED} || '</p></ix:x><p><a name=toc>lost</p><p>kept<div><a name=x>lost too</div><td><a>a<a>b</td>end</body></html>'"
S_LINE = s_trim("replace(line, chr(160), ' ')")


def s_nodes_html() -> str:
    h = "page"
    for pattern in ("(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<a\b[^>]*>.*?</a\s*>"):
        h = f"regexp_replace({h}, '{pattern}', '<>', 'g')"
    t = "replace(replace(replace(replace(replace(part, '&#160;', ' '), '&#8217;', '’'), '&#233;', 'é'), '&#x201C;', '“'), '&#x201D;', '”')"
    for name, char in html.ENTITIES.items():
        t = f"replace({t}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    t = s_trim(f"replace({t}, chr(160), ' ')")
    return f"SELECT doc AS doc, CAST(node_idx AS INTEGER) AS node_idx, text FROM (SELECT doc_id AS doc, node_idx, {t} AS text FROM (SELECT doc_id, unnest(range(len(p))) AS node_idx, unnest(p) AS part FROM (SELECT doc_id, string_split_regex({h}, '<[^>]*>') AS p FROM (SELECT doc_id, {PAGE} AS page FROM documents)))) WHERE text <> ''"


def pages(spark, sf_dir, form):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.expr(form).alias("page"))


@query(s_nodes_html())
def html_text_nodes(spark, sf_dir):
    """Pages made of documents, read by regular expressions."""
    return html.text_nodes(pages(spark, sf_dir, PAGE), "doc_id", "page")


@query(f"""SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY place) - 1 AS INTEGER) AS node_idx, text FROM (
SELECT doc_id AS doc, place, {S_LINE} AS text FROM (SELECT doc_id, unnest(range(len(l))) AS place, unnest(l) AS line FROM (SELECT doc_id, list_concat(['Item ' || CAST(doc_id % 16 + 1 AS VARCHAR) || '. “Café”'], string_split(text, chr(10)), ['kept', 'end']) AS l FROM documents WHERE text IS NOT NULL))) WHERE text <> ''""")
def html_parsed_nodes(spark, sf_dir):
    """Broken pages made of documents, read by the parser: what comes out are the lines that went in."""
    return html.parsed_text_nodes(pages(spark, sf_dir, BROKEN), "doc_id", "page")


# filings made of documents, in words that both engines read: every branch of the section reader
N = "chr(10)"
FILING = f"""CASE WHEN doc_id % 400 = 4 THEN 'Item 12. Own' || {N} || repeat(text || {N}, CAST(floor(200000 / (length(text) + 1)) AS INT) + 1) ELSE CASE doc_id % 8
WHEN 1 THEN 'before' || {N} || 'PART I' || {N} || 'Item 1.' || {N} || 'Business' || {N} || text || {N} || 'part ii.' || {N} || 'ITEM 7 - View' || {N} || left(text, 300) || {N} || 'Item 7. View again' || {N} || text || {N} || 'Item 7. Last' || {N} || text || {N} || 'Signatures' || {N} || 'PART IV' || {N} || 'Item 15. Never' || {N} || 'lost'
WHEN 2 THEN 'Item 15. Exhibits' || {N} || 'list' || {N} || 'Management’s Discussion and Analysis:' || {N} || text || {N} || 'Management''s discussion and analysis' || {N} || 'Report of Independent Registered Public Accounting Firm' || {N} || text
WHEN 3 THEN 'Item 17. Odd' || {N} || 'odd' || {N} || 'PART III' || {N} || 'Item 10.' || {N} || 'PART IV' || {N} || text || {N} || 'Item 18: Odder' || {N} || text
WHEN 4 THEN 'Item 9. Z' || {N} || 'Management''s Discussion and Analysis' || {N} || 'Item 11. Pay' || {N} || 'Incorporated herein by reference to the proxy.' || {N} || 'Item 13. None'
WHEN 5 THEN 'Item 1A. Risk' || {N} || text || {N} || 'Item 1C. Cyber' || {N} || text || {N} || 'Item 4. Mine' || {N} || text
ELSE text END END"""
S_NODES = f"SELECT doc, CAST(node_idx AS INTEGER) AS node_idx, text FROM (SELECT doc_id AS doc, node_idx, {S_LINE} AS text FROM (SELECT doc_id, unnest(range(len(p))) AS node_idx, unnest(p) AS line FROM (SELECT doc_id, string_split({FILING}, chr(10)) AS p FROM documents))) WHERE text <> ''"


def s_sections(nodes: str) -> str:
    part, item, sig, ref = (p.replace("'", "''") for p in (sections.PART, sections.ITEM, sections.SIGNATURES, sections.REFERENCE))
    heading = s_trim(f"regexp_replace({s_trim('lower(translate(text, ' + repr('’‘') + ', ' + chr(39) * 6 + '))')}, '[.:;\\x{{2014}}\\x{{2013}}\\-]+$', '')".replace("{{", "{").replace("}}", "}"))
    mapped = "CASE " + heading + " " + " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{p}|{i}'" for k, (p, i) in sections.HEADINGS.items()) + " END"
    return f"""n0 AS (SELECT *, min(CASE WHEN regexp_matches(text, '{sig}') THEN node_idx END) OVER (PARTITION BY doc) AS stop FROM ({nodes})),
n1 AS (SELECT doc, node_idx, text, nullif(regexp_extract(text, '{part}', 1), '') AS p0, nullif(regexp_extract(text, '{item}', 1), '') AS i0 FROM n0 WHERE stop IS NULL OR node_idx < stop),
n2 AS (SELECT doc, node_idx, text, 'PART ' || upper(p0) AS part, CASE WHEN p0 IS NULL THEN 'Item ' || upper(i0) END AS item FROM n1),
n3 AS (SELECT *, last_value(part IGNORE NULLS) OVER w AS last_part, last_value(item IGNORE NULLS) OVER w AS real_item FROM n2 WINDOW w AS (PARTITION BY doc ORDER BY node_idx ROWS UNBOUNDED PRECEDING)),
n4 AS (SELECT *, CASE WHEN part IS NULL AND item IS NULL AND length(text) < 150 AND real_item IN ('Item 15', 'Item 16') THEN {mapped} END AS mapped FROM n3),
n5 AS (SELECT *, mapped IS NOT NULL AND row_number() OVER (PARTITION BY doc, mapped ORDER BY node_idx) = 1 AS fired FROM n4),
n6 AS (SELECT *, fired OR item IS NOT NULL AS opens, NOT (fired OR item IS NOT NULL) AND part IS NULL AS plain, CASE WHEN item IS NOT NULL THEN {s_trim(f"regexp_replace(text, '{item}', '')")} END AS tail FROM n5),
n7 AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc ORDER BY node_idx ROWS UNBOUNDED PRECEDING) AS seg, plain AND coalesce(lag(tail) OVER w = '', false) AS is_title, CASE WHEN lead(plain) OVER w THEN lead(text) OVER w END AS next_title FROM n6 WINDOW w AS (PARTITION BY doc ORDER BY node_idx)),
h AS (SELECT doc, seg, coalesce(split_part(mapped, '|', 1), CASE WHEN k BETWEEN 1 AND 4 THEN 'PART I' WHEN k BETWEEN 5 AND 9 THEN 'PART II' WHEN k BETWEEN 10 AND 14 THEN 'PART III' WHEN k BETWEEN 15 AND 16 THEN 'PART IV' ELSE last_part END) AS part, coalesce(item, split_part(mapped, '|', 2)) AS item, CASE WHEN fired THEN text WHEN tail <> '' THEN tail ELSE coalesce(next_title, '') END AS title FROM (SELECT *, try_cast(regexp_extract(item, '([0-9]+)', 1) AS INT) AS k FROM n7 WHERE opens)),
b AS (SELECT doc, seg, {s_trim("string_agg(text, chr(10) ORDER BY node_idx)")} AS text FROM n7 WHERE plain AND NOT is_title AND seg > 0 GROUP BY doc, seg),
s AS (SELECT b.doc, CAST(b.seg AS BIGINT) AS seg, b.text, h.part, h.item, h.title, CAST(count(*) OVER k - 1 AS INTEGER) AS duplicates, min(b.seg) OVER k AS first, row_number() OVER (PARTITION BY b.doc, part, item ORDER BY length(b.text) DESC, b.seg) AS best FROM b JOIN h ON b.doc = h.doc AND b.seg = h.seg WHERE b.text <> '' WINDOW k AS (PARTITION BY b.doc, part, item)),
sections AS (SELECT doc, CAST(first AS BIGINT) AS seg, text, part, item, title, duplicates, length(text) < 500 AND regexp_matches(text, '{ref}') AS incorporated_by_reference, length(text) > 200000 AS oversized FROM s WHERE best = 1)"""


def filing_nodes(spark, sf_dir):
    filings = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.expr(FILING).alias("text"))
    return html.line_nodes(filings, "doc_id")


def document_sections(spark, sf_dir):
    return sections.extract_sections(filing_nodes(spark, sf_dir))


@query(f"WITH {s_sections(S_NODES)} SELECT * FROM sections")
def section_extraction(spark, sf_dir):
    return document_sections(spark, sf_dir)


S_ITEMS = "SELECT metadata.source_file AS source_file, metadata.item AS item FROM semantic_chunks"


def s_gaps(items: str) -> str:
    return f"""g0 AS (SELECT DISTINCT source_file, coalesce(try_cast(regexp_extract(item, '^Item\\s+([0-9]{{1,2}})([A-Z]?)', 1) AS INT), 999) AS n, regexp_extract(item, '^Item\\s+([0-9]{{1,2}})([A-Z]?)', 2) AS letter FROM ({items}) WHERE item IS NOT NULL AND source_file IS NOT NULL),
g1 AS (SELECT source_file, n, lead(n) OVER (PARTITION BY source_file ORDER BY n) AS nx FROM (SELECT DISTINCT source_file, n FROM g0)),
g2 AS (SELECT source_file, n, letter, lead(letter) OVER (PARTITION BY source_file, n ORDER BY letter) AS nx FROM g0 WHERE letter <> ''),
gaps AS (SELECT source_file, 'Item ' || CAST(unnest(range(n + 1, nx)) AS VARCHAR) AS gap FROM g1 WHERE nx > n + 1 UNION ALL SELECT source_file, 'Item ' || CAST(n AS VARCHAR) || chr(CAST(unnest(range(ascii(letter) + 1, ascii(nx))) AS INTEGER)) FROM g2 WHERE ascii(nx) > ascii(letter) + 1)"""


@query(f"WITH {s_gaps(S_ITEMS)} SELECT * FROM gaps")
def item_gaps(spark, sf_dir):
    return validation.item_gaps(table(spark, sf_dir, "semantic_chunks").select("metadata.source_file", "metadata.item"))


S_FILED = "SELECT d.source_file, s.* FROM sections s JOIN documents d ON d.doc_id = s.doc"


@query(f"""WITH {s_sections(S_NODES)}, f AS ({S_FILED}), {s_gaps("SELECT source_file, item FROM f")}
SELECT f.source_file, count(DISTINCT part) AS parts, count(DISTINCT item) AS items, coalesce((SELECT count(*) FROM gaps g WHERE g.source_file = f.source_file), 0) AS gaps, count(*) FILTER (length(text) < 500) AS short, sum(duplicates)::BIGINT AS dup, count(DISTINCT part) = 0 AS no_part FROM f GROUP BY f.source_file""")
def filing_summary(spark, sf_dir):
    filed = document_sections(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source_file"), "doc")
    return validation.filing_summary(filed)


@query(f"WITH {s_sections(S_NODES)} SELECT doc, item, CAST(length(text) AS INTEGER) AS chars FROM sections WHERE length(text) < 500")
def short_sections(spark, sf_dir):
    return validation.short_sections(document_sections(spark, sf_dir)).select("doc", "item", F.length("text").alias("chars"))


@query(f"""WITH {s_sections(S_NODES)}, p AS (SELECT doc, part, count(*) AS sections, sum(length(text))::BIGINT AS chars, min(seg) AS first FROM sections GROUP BY doc, part)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY first, part NULLS LAST) AS INTEGER) AS part_no, part, sections, chars FROM p""")
def sections_by_part(spark, sf_dir):
    return validation.sections_by_part(document_sections(spark, sf_dir), "doc")


@query(f"""WITH {s_sections(S_NODES)}, np AS (SELECT doc, to_json(list(part ORDER BY place))::VARCHAR AS parts FROM (SELECT doc, part, min(node_idx) AS place FROM n2 WHERE part IS NOT NULL GROUP BY doc, part) GROUP BY doc),
sy AS (SELECT doc, to_json(list(DISTINCT replace(mapped, '|', '/') ORDER BY replace(mapped, '|', '/')))::VARCHAR AS synthetic FROM n5 WHERE fired GROUP BY doc),
ss AS (SELECT doc, count(*) AS sections, sum(duplicates)::BIGINT AS duplicates_suppressed FROM sections GROUP BY doc)
SELECT doc, coalesce(parts, '[]') AS parts, coalesce(sections, 0) AS sections, coalesce(duplicates_suppressed, 0) AS duplicates_suppressed, coalesce(synthetic, '[]') AS synthetic FROM ss FULL JOIN np USING (doc) FULL JOIN sy USING (doc)""")
def extraction_stats(spark, sf_dir):
    nodes = filing_nodes(spark, sf_dir)
    stats = sections.extraction_stats(nodes, sections.extract_sections(nodes))
    return stats.select("doc", F.to_json("parts_detected").alias("parts"), "sections", "duplicates_suppressed", F.to_json("synthetic_items").alias("synthetic"))


# -- prompts, citations and judges --------------------------------------------------------------------------------


@query("""SELECT result_id, to_json(list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1), lambda x: CAST(x AS BIGINT)))))::VARCHAR AS cited FROM v2_generation_results WHERE answer IS NOT NULL""")
def extract_citations(spark, sf_dir):
    r = table(spark, sf_dir, "v2_generation_results").where("answer IS NOT NULL")
    return r.select("result_id", F.to_json(prompt.citations("answer")).alias("cited"))


S_BLOCKS = f"""SELECT g.query_id, g.query, b.rank, '[' || b.rank || '] ' || coalesce(replace(c.metadata.source_file, '.html', ''), '?') || ' | ' || coalesce(c.metadata.item, '?') || CASE WHEN coalesce(c.metadata.section_title, '') <> '' THEN ' — ' || c.metadata.section_title ELSE '' END || chr(10) || {s_trim("coalesce(c.text, '')")} AS block
FROM ({S_QUESTIONS}) g JOIN bm25 b ON b.query_id = g.query_id JOIN c ON c.id = b.id"""


@query(f"""WITH {s_bm25(S_CORPUS, S_QUESTIONS, 5)}, c AS ({S_CORPUS}), k AS ({S_BLOCKS})
SELECT query_id, '{prompt.INTRODUCTION}' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' || any_value(query) || chr(10) || chr(10) || '{prompt.REQUEST}' AS prompt, CAST(count(*) AS INTEGER) AS passages FROM k GROUP BY query_id""")
def build_prompt(spark, sf_dir):
    hits = bm25_hits(spark, sf_dir, 5).join(corpus(spark, sf_dir), "id")
    return prompt.build_prompts(questions(spark, sf_dir), hits.select("query_id", "rank", F.col("metadata.source_file").alias("source_file"), F.col("metadata.item").alias("item"), F.col("metadata.section_title").alias("title"), "text"))


def question_hits(spark, sf_dir, k=5):
    """Hits of the gold questions with what prompts show of them; one text in ten only as ``document``."""
    c = corpus(spark, sf_dir).select("id", "text", F.col("metadata.source_file").alias("source_file"), F.col("metadata.item").alias("item"), F.col("metadata.section_title").alias("title"))
    c = c.withColumn("document", F.when(F.col("id").endswith("7"), F.col("text"))).withColumn("text", F.when(F.col("document").isNull(), F.col("text")).otherwise(""))
    # every tenth question finds nothing
    return bm25_hits(spark, sf_dir, k).where("NOT query_id LIKE '%0'").join(c, "id")


S_PROMPTED = f"""WITH {s_bm25(S_CORPUS, S_QUESTIONS, 5)}, c AS ({S_CORPUS}), k AS ({S_BLOCKS} WHERE g.query_id NOT LIKE '%0'),
pr AS (SELECT g.query_id, any_value(g.query) AS query, '{prompt.INTRODUCTION}' || chr(10) || chr(10) || coalesce(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), '') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' || coalesce(any_value(g.query), '') || chr(10) || chr(10) || '{prompt.REQUEST}' AS prompt, count(block) AS passages FROM ({S_QUESTIONS}) g LEFT JOIN k USING (query_id) GROUP BY g.query_id),
cx AS (SELECT b.query_id, list({s_trim("coalesce(c.text, '')")} ORDER BY b.rank) AS contexts, list(coalesce(c.text, '') ORDER BY b.rank) AS texts FROM bm25 b JOIN c ON c.id = b.id WHERE b.query_id NOT LIKE '%0' GROUP BY b.query_id)"""
S_SYSTEM = prompt.SYSTEM.replace("'", "''")


def s_first(x: str) -> str:
    first = s_trim(f"string_split_regex(regexp_replace({s_trim(x)}, '([.!?])[{WS}]', '\\1' || chr(1), 'g'), '\\x01|\\n')[1]")
    return f"CASE WHEN {first} <> '' THEN {first} || ' [1]' ELSE '{NOT_FOUND}' END"


def s_cited(x: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({x}, '\\[([0-9]+)\\]', 1), lambda n: CAST(n AS BIGINT))))"


S_ANSWERS = f"""{S_PROMPTED}, an AS (SELECT query_id, query, prompt, passages, contexts, CASE WHEN passages = 0 THEN '{prompt.NOTHING}' ELSE {s_first("contexts[1]")} END AS answer FROM pr LEFT JOIN cx USING (query_id))"""


@query(f"{S_PROMPTED} SELECT query_id, turn, role, text FROM (SELECT query_id, 0 AS turn, 'system' AS role, '{S_SYSTEM}' AS text FROM pr UNION ALL SELECT query_id, 1, 'user', prompt FROM pr)")
def build_messages(spark, sf_dir):
    """The two turns of each question; where a hit has no text its document counts."""
    return prompt.build_messages(prompt.build_prompts(questions(spark, sf_dir), question_hits(spark, sf_dir)))


@query(f"""{S_ANSWERS} SELECT query_id, query AS question, answer, to_json(CASE WHEN passages = 0 THEN []::BIGINT[] ELSE {s_cited("answer")} END)::VARCHAR AS cited_indices, CAST(coalesce(len(list_filter({s_cited("answer")}, lambda n: n BETWEEN 1 AND passages)), 0) AS INTEGER) AS cited, coalesce(to_json(contexts), '[]')::VARCHAR AS contexts, 'extractive' AS model,
CAST(CASE WHEN passages = 0 THEN 0 ELSE len({s_words(f"'{S_SYSTEM}'")}) + len({s_words("prompt")}) END AS INTEGER) AS prompt_tokens, CAST(CASE WHEN passages = 0 THEN 0 ELSE len({s_words("answer")}) END AS INTEGER) AS completion_tokens FROM an""")
def answer_questions(spark, sf_dir):
    """Retrieve, then answer: each gold question over its five best chunks. A question without hits gets the fixed reply."""
    a = prompt.answer_questions(questions(spark, sf_dir), cut(question_hits(spark, sf_dir)))
    return a.select("query_id", "question", "answer", F.to_json("cited_indices").alias("cited_indices"), F.size("cited_chunks").alias("cited"), F.to_json(F.transform("contexts", T.trim_ws)).alias("contexts"), "model", "prompt_tokens", "completion_tokens")


S_BARE = f"""{S_PROMPTED}, an AS (SELECT query_id, CASE WHEN passages = 0 THEN '{prompt.NOTHING}' ELSE {s_first("array_to_string(contexts, chr(10) || chr(10))")} END AS answer, passages, contexts FROM pr LEFT JOIN cx USING (query_id))"""


@query(f"""{S_BARE} SELECT query_id, answer, to_json(CASE WHEN passages = 0 THEN []::BIGINT[] ELSE {s_cited("answer")} END)::VARCHAR AS cited_indices, CAST(passages AS INTEGER) AS source_nodes FROM an""")
def query_engine(spark, sf_dir):
    """The second engine: rules, bare passages and question in one prompt."""
    ask = prompt.answering(lambda q: bm25_hits(spark, sf_dir, 5).where("NOT query_id LIKE '%0'"), corpus(spark, sf_dir).select("id", "text"), numbered=False)
    return ask(questions(spark, sf_dir)).select("query_id", "answer", F.to_json("cited_indices").alias("cited_indices"), F.size("chunks").alias("source_nodes"))


S_EXPECTED = "SELECT question_id AS query_id, coalesce(nullif(expected_answer, ''), answer) AS expected FROM gold_questions"


def answer_records(spark, sf_dir):
    a = prompt.answer_questions(questions(spark, sf_dir), cut(question_hits(spark, sf_dir)))
    gold = table(spark, sf_dir, "gold_questions").select(F.col("question_id").alias("query_id"), F.coalesce(F.nullif("expected_answer", F.lit("")), "answer").alias("expected"))
    return prompt.records(a, gold)


@query(f"{S_ANSWERS} SELECT query_id, query AS question, answer, coalesce(to_json(contexts), '[]')::VARCHAR AS contexts, coalesce(expected, '') AS ground_truth FROM an LEFT JOIN ({S_EXPECTED}) USING (query_id)")
def answer_record_rows(spark, sf_dir):
    """Answers beside what was expected, without the columns that vary."""
    return answer_records(spark, sf_dir).select("query_id", "question", "answer", F.to_json("contexts").alias("contexts"), "ground_truth")


def s_part(a: str, b: str) -> str:
    """The share of the words ``a`` among ``b``, to 4 places; null without words."""
    return f"CASE WHEN len({a}) > 0 THEN round(len(list_intersect({a}, {b}))::DOUBLE / len({a}), 4) END"


S_JUDGED = f"""{S_ANSWERS}, w AS (SELECT query_id, {s_tokenset("query")} AS q, {s_tokenset("answer")} AS a, {s_tokenset("array_to_string(coalesce(contexts, []), ' ')")} AS c, list_transform(coalesce(contexts, []), lambda t: {s_tokenset("t")}) AS cs, {s_tokenset("coalesce(expected, '')")} AS t FROM an LEFT JOIN ({S_EXPECTED}) USING (query_id)),
ju AS (SELECT query_id, {s_part("a", "c")} AS faithfulness, CASE WHEN len(a) > 0 THEN {s_part("q", "a")} END AS answer_relevancy, {s_part("t", "c")} AS context_recall, CASE WHEN len(t) > 0 AND len(cs) > 0 THEN round(len(list_filter(cs, lambda s: 2 * len(list_intersect(t, s)) >= len(t)))::DOUBLE / len(cs), 4) END AS context_precision FROM w)"""


@query(f"{S_JUDGED} SELECT * FROM ju")
def judged_answers(spark, sf_dir):
    """The four scores of every answer by the stand-in for a judge."""
    return evaluation.judge_results(answer_records(spark, sf_dir), OverlapJudgeOfFour)


@query(f"{S_JUDGED} SELECT count(*) AS n_questions, round(round(avg(faithfulness), 8), 4) AS faithfulness, round(round(avg(answer_relevancy), 8), 4) AS answer_relevancy, round(round(avg(context_recall), 8), 4) AS context_recall, round(round(avg(context_precision), 8), 4) AS context_precision FROM ju")
def judged_means(spark, sf_dir):
    scores = evaluation.judge_results(answer_records(spark, sf_dir), OverlapJudgeOfFour)
    return evaluation.judge_means(scores, {m: F.col(m) for m in OverlapJudgeOfFour.metrics})


@query(f"""{S_LEGS}, {s_rrf(10, 20)} SELECT x.query_id, x.id, x.rank, round(1.0::DOUBLE / (60 + x.rank), 9) AS score, list_contains(list_transform(regexp_extract_all(a.answer, '\\[([0-9]+)\\]', 1), lambda c: CAST(c AS BIGINT)), x.rank::BIGINT) AS is_cited
FROM (SELECT query_id, id, rank FROM rrf WHERE rank <= 5) x JOIN v2_generation_results a ON a.result_id = x.query_id WHERE a.answer IS NOT NULL""")
def source_panel(spark, sf_dir):
    """Fused hits of spans beside the answers of the same number: which of the five an answer cites."""
    _, x, d, _ = legs(spark, sf_dir)
    hits = fusion.reciprocal_rank(d, x, 10, pool=20).where("rank <= 5").select("query_id", "id", "rank", F.round(1.0 / (60 + F.col("rank")), 9).alias("rrf_score"))
    answers = table(spark, sf_dir, "v2_generation_results").where("answer IS NOT NULL").select(F.col("result_id").alias("query_id"), "answer")
    known = hits.join(answers.select("query_id"), "query_id", "left_semi")
    return prompt.source_panel(known, answers).select("query_id", "id", "rank", "score", "is_cited")


@query(f"""{S_SCORES}, m AS (SELECT strategy, round(round(avg(coalesce(1.0 / r, 0)), 8), 4) AS mrr, round(avg(coalesce(r <= 5, false)::INT), 4) AS recall_at_5 FROM sc GROUP BY strategy)
SELECT strategy, mrr, recall_at_5, mrr = max(mrr) OVER () AS best_mrr, recall_at_5 = max(recall_at_5) OVER () AS best_recall_at_5 FROM m""")
def best_strategies(spark, sf_dir):
    summary = evaluation.summarise(strategy_scores(spark, sf_dir)).select("strategy", "mrr", "recall_at_5")
    return analysis.best_by_column(summary, ["mrr", "recall_at_5"])


S_TWO = f"{S_SCORES}, m AS (SELECT strategy, {S_METRICS} FROM sc GROUP BY strategy)"


def two_summaries(spark, sf_dir):
    """A summary of all strategies, and one of two that has only some of the columns, under other names."""
    s = cut(evaluation.summarise(strategy_scores(spark, sf_dir)))
    return s, s.where("strategy IN ('bm25', 'semantic')").select("strategy", F.col("recall_at_1").alias("primary_recall_at_1"), F.when(F.col("strategy") == "bm25", F.col("recall_at_5")).alias("recall_at_5"), F.col("recall_at_10").alias("primary_recall_at_5"), "mrr")


@query(f"""{S_TWO} SELECT 'v1/' || strategy AS label, 'v1' AS version, strategy, recall_at_1 AS r_at_1, recall_at_5 AS r_at_5, recall_at_10 AS r_at_10, mrr, 0.0 AS ms FROM m
UNION ALL SELECT 'v2/' || strategy, 'v2', strategy, recall_at_1, CASE WHEN strategy = 'bm25' THEN recall_at_5 ELSE recall_at_10 END, 0.0, mrr, 0.0 FROM m WHERE strategy IN ('bm25', 'semantic')""")
def version_comparison(spark, sf_dir):
    """Two summaries under each other; a metric comes from the first column that has it."""
    return analysis.compare_versions(*two_summaries(spark, sf_dir))


@query(f"{S_TWO} SELECT strategy, recall_at_5 AS first, CASE WHEN strategy = 'bm25' THEN recall_at_5 ELSE 0.0 END AS second FROM m WHERE strategy IN ('bm25', 'semantic', 'hybrid')")
def common_strategies(spark, sf_dir):
    """A metric of the same strategies in both versions; 0 where one does not have it."""
    return analysis.common_strategies(*two_summaries(spark, sf_dir), "recall_at_5", ["semantic", "bm25", "hybrid"])


@query("SELECT count(*) AS n_questions, round(round(avg(CASE WHEN NOT isnan(scores.faithfulness) THEN scores.faithfulness END), 8), 4) AS faithfulness, round(round(avg(CASE WHEN NOT isnan(scores.relevancy) THEN scores.relevancy END), 8), 4) AS relevancy, round(avg(latency_ms), 1) AS mean_latency_ms FROM v2_generation_results")
def judge_means(spark, sf_dir):
    r = table(spark, sf_dir, "v2_generation_results")
    return evaluation.judge_means(r, {"faithfulness": F.col("scores.faithfulness"), "relevancy": F.col("scores.relevancy")}, F.col("latency_ms"))


@query("SELECT result_id, question_id, scores.faithfulness AS faithfulness FROM v2_generation_results WHERE scores.faithfulness < 0.8")
def low_faithfulness(spark, sf_dir):
    r = table(spark, sf_dir, "v2_generation_results").select("result_id", "question_id", F.col("scores.faithfulness").alias("faithfulness"))
    return analysis.below(r, "faithfulness")


@query("SELECT v.vec_id, round(sqrt(list_dot_product(e, e)), 4) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"))
