"""Registered queries of search and fusion, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import index as I
from ..operators import retrieval as R
from ..sources import store as ST
from ..sources.shared import fresh_path
from .tables import chunks, image_pages, image_queries, queries, table, values, vectors

IDENTIFIER_ROWS = """(900001, 'where is valve gfv21 and pump p-101'), (900002, 'what does alarm al-01 mean'), (900003, 'no identifier here'), (900004, 'sus316 and gfv2')"""
IDENTIFIER_CHUNKS = """(900011, 'src0', 1, 'Valve GFV21 is on deck 3.'), (900012, 'src0', 2, 'GFV21 again, with P-101.'), (900013, 'src1', 1, 'AL-01: low oil pressure'), (900014, 'src1', 2, 'material SUS316L')"""


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def token_stats(s: SparkSession, d: str) -> DataFrame:
    """Every term's document and total frequency."""
    return I.postings(chunks(s, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def corpus_stats(s: SparkSession, d: str) -> DataFrame:
    return rounded(I.corpus_stats(I.document_lengths(chunks(s, d))), "avgdl")


def term_weights(s: SparkSession, d: str) -> DataFrame:
    c = chunks(s, d)
    return rounded(I.term_weights(I.postings(c), I.corpus_stats(I.document_lengths(c))), "idf")


def query_tokens(s: SparkSession, d: str) -> DataFrame:
    return queries(s, d).select("query_id", F.array_join(T.query_tokens(F.col("query_text")), " ").alias("tokens"))


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return rounded(I.bm25_topk(chunks(s, d), queries(s, d)), "score")


def vector_topk(s: SparkSession, d: str) -> DataFrame:
    return rounded(I.vector_topk(vectors(s, d), queries(s, d)), "score")


def image_topk_pages(s: SparkSession, d: str) -> DataFrame:
    return rounded(I.image_topk(image_pages(s, d), image_queries(queries(s, d))), "score")


def channels(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c, q = chunks(s, d), queries(s, d)
    return I.vector_topk(vectors(s, d), q), I.bm25_topk(c, q), I.image_topk(image_pages(s, d), image_queries(q)), c


def rrf_three_channel(s: SparkSession, d: str) -> DataFrame:
    vec, bm, img, c = channels(s, d)
    return rounded(R.fuse(vec, bm, img, c), "score")


def hybrid_rrf_topk(s: SparkSession, d: str) -> DataFrame:
    """Vectors and words fused; the five best of every benchmark item."""
    c, q = chunks(s, d), queries(s, d)
    none = I.image_topk(image_pages(s, d).limit(0), image_queries(q))
    return rounded(R.fuse(I.vector_topk(vectors(s, d), q), I.bm25_topk(c, q), none, c, 5), "score")


def identifier_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = values(s, IDENTIFIER_CHUNKS, "chunk_id, source, page, text").select(F.col("chunk_id").cast("long"), F.col("chunk_id").cast("long").alias("chunk_seq"), "source", "page", "text")
    asked = values(s, IDENTIFIER_ROWS, "query_id, query_text").select(F.col("query_id").cast("long"), "query_text")
    return chunks(s, d).unionByName(own), queries(s, d).select("query_id", "query_text").unionByName(asked)


def exact_identifier_hits(s: SparkSession, d: str) -> DataFrame:
    """Chunks that hold an identifier of the query, best score in the words channel first."""
    c, q = identifier_tables(s, d)
    return R.identifier_hits(c, q, I.bm25_scores(c, q), most=3)


def stored_bm25_topk(s: SparkSession, d: str) -> DataFrame:
    """The words channel over an index that was stored, and made again for one source."""
    path = fresh_path(s, "knowledge")
    own = chunks(s, d).select("chunk_id", "chunk_seq", "page", "text", F.when(F.col("chunk_id") % 3 == 0, F.concat(F.lit("context "), "source")).alias("context"), F.lit(None).cast("string").alias("image_path"), F.lit(None).cast("array<float>").alias("vector"), "source")
    ST.save("chunks", own, path)
    ST.save_index(s, path)
    ST.save_index(s, path, ["src3"])
    return rounded(I.ranked(I.search_words(ST.load_index(s, path), queries(s, d)).where("score > 0"), I.POOL, "chunk_id"), "score")


def assemble_top5(s: SparkSession, d: str) -> DataFrame:
    vec, bm, img, c = channels(s, d)
    exact = R.identifier_hits(c, queries(s, d))
    return rounded(R.assemble(R.fuse(vec, bm, img, c), exact, img, c), "score")


def neighbor_expand(s: SparkSession, d: str) -> DataFrame:
    hits = I.vector_topk(vectors(s, d), queries(s, d), 5).select("query_id", "chunk_id")
    return R.expand_neighbours(hits, chunks(s, d), 20).select("query_id", "chunk_seq", "source", "page")


def context_blocks(s: SparkSession, d: str) -> DataFrame:
    hits = I.vector_topk(vectors(s, d), queries(s, d), 5).select("query_id", "chunk_id")
    blocks = R.context_blocks(R.expand_neighbours(hits, chunks(s, d), 20))
    return R.context_text(blocks).select("query_id", F.sha2("context", 256).alias("context_sha256"))


def unit_vectors(s: SparkSession, d: str) -> DataFrame:
    own = table(s, d, "embeddings").select("vec_id", V.l2_normalised(F.col("embedding")).alias("u"))
    return own.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(V.norm(F.col("u")), 6).alias("norm"))


def retrieval_text(s: SparkSession, d: str) -> DataFrame:
    """Labelled documents carry a context; what is indexed, as a digest."""
    lab = table(s, d, "labels").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 1, F.concat(F.lit("context of "), F.col("doc_id"))).otherwise(F.lit("")).alias("context"))
    return chunks(s, d).join(lab, "chunk_id", "left").select("chunk_id", F.sha2(T.retrieval_text(F.col("context"), F.col("text")), 256).alias("sha"))


CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, doc_id AS chunk_seq, source, CAST(doc_id // 40 + 1 AS INTEGER) AS page, coalesce(text, '') AS text FROM documents)"
QUERIES_SQL = "queries AS (SELECT item_id AS query_id, b.text AS query_text, embedding AS query_vector FROM benchmark b LEFT JOIN embeddings ON vec_id = item_id)"
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
POSTS = "posts AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(" + TOKENS.format("text") + ") AS term FROM chunks) GROUP BY ALL)"
LENGTHS = "lengths AS (SELECT chunk_id, len(" + TOKENS.format("text") + ") AS dl FROM chunks), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths)"
WEIGHTS = """raw AS (SELECT term, count(*) AS df, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts, stats GROUP BY term),
    weights AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
SCORED = f"""{POSTS}, {LENGTHS}, {WEIGHTS},
    terms AS (SELECT query_id, unnest(list_distinct({TOKENS.format('query_text')})) AS term FROM queries),
    words AS (SELECT query_id, chunk_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
              FROM terms JOIN weights USING (term) JOIN posts USING (term) JOIN lengths USING (chunk_id), stats GROUP BY ALL)"""
TOP_WORDS = """bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM words WHERE score > 0) WHERE rank < 20)"""
BM25 = f"{CHUNKS}, {QUERIES_SQL}, {SCORED}, {TOP_WORDS}"


def unit(column: str) -> str:
    return f"list_transform(CAST({column} AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST({column} AS DOUBLE[]), CAST({column} AS DOUBLE[]))))"


VECTOR = f"""vecs AS (SELECT vec_id AS chunk_id, {unit('embedding')} AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
    asked AS (SELECT query_id, {unit('query_vector')} AS q FROM queries WHERE query_vector IS NOT NULL),
    vec AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank
            FROM (SELECT query_id, chunk_id, list_dot_product(q, v) AS score FROM asked, vecs)) WHERE rank < 20)"""
IMAGE = f"""pages AS (SELECT source, page, arg_min(embedding, chunk_id)[1:32] AS e FROM chunks JOIN embeddings ON vec_id = chunk_id GROUP BY ALL),
    img AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, source, page) - 1 AS rank
            FROM (SELECT query_id, source, page, list_dot_product(qq, pp) AS score FROM
                  (SELECT query_id, {unit('query_vector[1:32]')} AS qq FROM queries WHERE query_vector IS NOT NULL),
                  (SELECT source, page, {unit('e')} AS pp FROM pages))) WHERE rank < 10 AND round(score, 9) >= 0.35)"""


def fused(most: int, images: bool = True) -> str:
    third = "UNION ALL SELECT query_id, chunk_id, rank, 2 FROM img JOIN chunks USING (source, page)" if images else ""
    return f"""every AS (SELECT query_id, chunk_id, rank, 0 AS channel FROM vec UNION ALL SELECT query_id, chunk_id, rank, 1 FROM bm25 {third}),
    summed AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank + 1)) AS score, min(channel * 1000 + rank) AS first FROM every GROUP BY ALL),
    fused AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, chunk_id) - 1 AS rank FROM summed) WHERE rank < {most})"""




def identifiers(asked: str, searched: str, most: int, scores: str = "") -> str:
    known = f"LEFT JOIN {scores} USING (query_id, chunk_id)" if scores else ""
    by_score = "round(coalesce(score, 0), 9) DESC, " if scores else ""
    return rf"""wanted AS (SELECT query_id, t AS identifier FROM (SELECT query_id, unnest(list_distinct({TOKENS.format('query_text')})) AS t FROM {asked})
             WHERE regexp_full_match(t, '[a-z]{{1,6}}[-.]?[0-9]{{1,5}}[a-z0-9.\-ø]*')),
    found AS (SELECT DISTINCT query_id, chunk_id FROM wanted, {searched} WHERE contains(lower(text), identifier)),
    exact AS (SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY {by_score}chunk_id DESC) - 1 AS rank FROM found {known}) WHERE rank < {most})"""


NEAR = """hits AS (SELECT query_id, chunk_id FROM vec WHERE rank < 5),
    near AS (SELECT DISTINCT h.query_id, c.chunk_seq, c.source, c.page, c.text FROM hits h JOIN chunks o USING (chunk_id) JOIN chunks c ON c.source = o.source AND c.chunk_seq BETWEEN o.chunk_seq - 20 AND o.chunk_seq + 20)"""

QUERIES = {
    f.__name__: f
    for f in (
        token_stats, corpus_stats, term_weights, query_tokens, bm25_topk, vector_topk, image_topk_pages, rrf_three_channel, hybrid_rrf_topk,
        exact_identifier_hits, stored_bm25_topk, assemble_top5, neighbor_expand, context_blocks, unit_vectors, retrieval_text,
    )
}

ORACLE_SQL = {
    "token_stats": f"WITH {CHUNKS}, {POSTS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM posts GROUP BY term",
    "corpus_stats": f"WITH {CHUNKS}, {LENGTHS} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "term_weights": f"WITH {CHUNKS}, {POSTS}, {LENGTHS}, {WEIGHTS} SELECT term, df, round(idf, 6) AS idf FROM weights",
    "query_tokens": f"""WITH t AS (SELECT item_id, unnest({TOKENS.format('text')}) AS t, generate_subscripts({TOKENS.format('text')}, 1) AS i FROM benchmark),
        f AS (SELECT item_id, t, min(i) AS i FROM t GROUP BY ALL)
        SELECT item_id AS query_id, string_agg(t, ' ' ORDER BY i) AS tokens FROM f GROUP BY item_id""",
    "bm25_topk": f"WITH {BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm25",
    "vector_topk": f"WITH {QUERIES_SQL}, {VECTOR} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM vec",
    "image_topk_pages": f"WITH {CHUNKS}, {QUERIES_SQL}, {IMAGE} SELECT query_id, source, page, round(score, 6) AS score, rank FROM img",
    "rrf_three_channel": f"WITH {BM25}, {VECTOR}, {IMAGE}, {fused(15)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM fused",
    "hybrid_rrf_topk": f"WITH {BM25}, {VECTOR}, {fused(5, False)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM fused",
    "exact_identifier_hits": f"""WITH chunks AS (SELECT doc_id AS chunk_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT col0, col3 FROM (VALUES {IDENTIFIER_CHUNKS})),
        queries AS (SELECT item_id AS query_id, text AS query_text FROM benchmark UNION ALL SELECT * FROM (VALUES {IDENTIFIER_ROWS})), {SCORED}, {identifiers('queries', 'chunks', 3, 'words')}
        SELECT query_id, chunk_id, rank FROM exact""",
    "stored_bm25_topk": f"""WITH chunks AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'context ' || source || chr(10) || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM documents), {QUERIES_SQL}, {SCORED}, {TOP_WORDS}
        SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm25""",
    "assemble_top5": f"""WITH {BM25}, {VECTOR}, {IMAGE}, {fused(15)}, {identifiers('queries', 'chunks', 1)},
        line AS (SELECT query_id, chunk_id, -1 AS place, 1.0::DOUBLE AS score FROM exact
                 UNION ALL SELECT query_id, chunk_id, rank, score FROM fused f WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.query_id = f.query_id AND e.chunk_id = f.chunk_id)),
        placed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS slot FROM line) WHERE slot <= 5),
        on_page AS (SELECT query_id, chunk_id FROM img JOIN chunks USING (source, page) WHERE rank = 0),
        pool AS (SELECT query_id, min(rank) AS r FROM fused JOIN on_page USING (query_id, chunk_id)
                 WHERE query_id NOT IN (SELECT query_id FROM placed JOIN on_page USING (query_id, chunk_id)) GROUP BY query_id),
        rescued AS (SELECT f.query_id, f.chunk_id, (SELECT least(max(slot) + 1, 5) FROM placed p WHERE p.query_id = f.query_id) AS slot, f.score
                    FROM fused f JOIN pool ON pool.query_id = f.query_id AND r = rank)
        SELECT query_id, chunk_id, slot, round(score, 6) AS score FROM (
            SELECT query_id, chunk_id, slot, score FROM placed p WHERE NOT EXISTS (SELECT 1 FROM rescued r WHERE r.query_id = p.query_id AND r.slot = p.slot)
            UNION ALL SELECT * FROM rescued)""",
    "neighbor_expand": f"WITH {CHUNKS}, {QUERIES_SQL}, {VECTOR}, {NEAR} SELECT query_id, chunk_seq, source, page FROM near",
    "context_blocks": f"""WITH {CHUNKS}, {QUERIES_SQL}, {VECTOR}, {NEAR},
        marked AS (SELECT *, CASE WHEN lag(source) OVER w IS DISTINCT FROM source OR lag(page) OVER w IS DISTINCT FROM page THEN 1 ELSE 0 END AS new FROM near WINDOW w AS (PARTITION BY query_id ORDER BY chunk_seq)),
        numbered AS (SELECT *, sum(new) OVER (PARTITION BY query_id ORDER BY chunk_seq) AS block FROM marked),
        blocks AS (SELECT query_id, block, source, page, string_agg(text, chr(10) || chr(10) ORDER BY chunk_seq) AS text FROM numbered GROUP BY ALL)
        SELECT query_id, sha256(string_agg('[来源: ' || source || ' 第' || page || '页]' || chr(10) || text, chr(10) || chr(10) ORDER BY block)) AS context_sha256 FROM blocks GROUP BY query_id""",
    "unit_vectors": f"WITH u AS (SELECT vec_id, {unit('embedding')} AS u FROM embeddings) SELECT vec_id, round(list_sum(u), 6) AS total, round(sqrt(list_dot_product(u, u)), 6) AS norm FROM u",
    "retrieval_text": f"""WITH {CHUNKS} SELECT chunk_id, sha256(CASE WHEN quality = 1 THEN 'context of ' || chunk_id || chr(10) || chr(10) || c.text ELSE c.text END) AS sha
        FROM chunks c LEFT JOIN labels ON doc_id = chunk_id""",
}
