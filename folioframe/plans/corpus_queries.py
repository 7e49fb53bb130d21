"""Registered queries of quality checks, chunking, store mutation and layout, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import evaluation as E
from ..operators import layout as L
from ..operators import quality as Q
from ..operators import services as V
from ..operators import store as S
from ..sources import transcripts as TR
from ..sources.shared import fresh_path
from .retrieval_queries import CHUNKS
from .tables import chunks, documents, table, values

NL = "chr(10)"


def pages(s: SparkSession, d: str) -> DataFrame:
    """(source, page, text, image_path): every document as a page."""
    own = documents(s, d)
    page = F.col("doc_id").cast("int")
    return own.select("source", page.alias("page"), F.coalesce("text", F.lit("")).alias("text"), T.image_name(F.col("source"), page).alias("image_path"))


DEGENERATE = """('bad', 1, repeat(concat('The valve GFV12 is shown in the picture here', chr(10)), 40)), ('near', 2, repeat(concat('The valve GFV12 is shown in the picture here', chr(10)), 19)), ('rows', 3, repeat(concat('| a long table row | 12345 |', chr(10)), 60))"""


def degenerate_pages(s: SparkSession, d: str) -> DataFrame:
    fixture = values(s, DEGENERATE, "source, page, text")
    return Q.degenerate_pages(pages(s, d).select("source", "page", "text").unionByName(fixture), ["source", "page"])


def damaged_contexts(s: SparkSession, d: str) -> DataFrame:
    """Texts judged as if they were contexts."""
    own = documents(s, d).select("doc_id", F.col("text").alias("context"))
    return own.select("doc_id", T.is_damaged(F.col("context")).alias("damaged"))


ATTEMPTS = "(1, 1, 'short'), (1, 2, 'the longest one'), (1, 3, 'the longest too'), (2, 1, 'only'), (3, 1, ''), (3, 2, 'x')"


def longest_attempt(s: SparkSession, d: str) -> DataFrame:
    """Every turn of a conversation is an attempt at it, and some made up."""
    own = table(s, d, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("attempt"), "text")
    fixture = values(s, ATTEMPTS, "page, attempt, text").select((-F.col("page")).cast("long").alias("page"), F.col("attempt").cast("long"), "text")
    return Q.longest_attempt(own.unionByName(fixture), ["page"])


def char_split(s: SparkSession, d: str) -> DataFrame:
    own = documents(s, d).select("doc_id", F.posexplode(T.char_pieces(F.coalesce("text", F.lit("")))).alias("piece", "text"))
    return own.select("doc_id", F.col("piece").cast("long").alias("piece"), F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha"))


MARKDOWN = """('m', 1, concat('# Title', chr(10), 'intro text', chr(10), chr(10), '| a | b |', chr(10), '|---|---|', chr(10), '| 1 | 2 |', chr(10), 'after', chr(10), '## Next', chr(10), 'more')),
    ('m', 2, concat('| h | k |', chr(10), '|---|---|', chr(10), repeat(concat('| some cell | another cell of the row |', chr(10)), 120))),
    ('m', 3, repeat(concat('A short paragraph of words.', chr(10), chr(10)), 90)), ('m', 4, ''), ('m', 5, repeat('words without end ', 300))"""


def markdown_pages(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d).select("source", "page", "text").unionByName(values(s, MARKDOWN, "source, page, text"))


def block_split(s: SparkSession, d: str) -> DataFrame:
    found = markdown_pages(s, d).select("source", "page", F.posexplode(C.blocks(F.col("text"))).alias("place", "block"))
    return found.select("source", "page", F.col("place").cast("long").alias("place"), F.sha2("block", 256).alias("sha"))


def chunk_pages(s: SparkSession, d: str) -> DataFrame:
    return C.chunk_pages(markdown_pages(s, d)).select("source", "page", "piece", F.length("text").alias("n"), F.sha2("text", 256).alias("sha"))


def table_split(s: SparkSession, d: str) -> DataFrame:
    found = values(s, MARKDOWN, "source, page, text").where("page = 2").select(F.posexplode(C.table_parts(F.regexp_replace("text", r"\n$", ""))).alias("part", "text"))
    return found.select("part", F.length("text").alias("n"), F.substring("text", 1, 9).alias("header"))


def damaged_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages rebuilt from their chunks and judged."""
    fixture = values(s, DEGENERATE, "source, page, text").select("source", "page", "text", F.lit(1).cast("long").alias("chunk_seq"), F.lit(None).cast("string").alias("image_path"))
    own = chunks(s, d).select("source", "page", "text", "chunk_seq", F.lit(None).cast("string").alias("image_path"))
    return Q.degenerate_pages(S.page_texts(own.unionByName(fixture)), ["source", "page"]).select("source", "page")


def page_rebuild(s: SparkSession, d: str) -> DataFrame:
    own = chunks(s, d).withColumn("image_path", F.when(F.col("chunk_id") % 2 == 0, T.image_name(F.col("source"), F.col("page"))))
    return S.page_texts(own).select("source", "page", F.sha2("text", 256).alias("sha"), "image_path")


SOURCES = "('src3'), ('src7'), ('missing')"


def gone(s: SparkSession) -> DataFrame:
    return values(s, SOURCES, "source")


def remove_source(s: SparkSession, d: str) -> DataFrame:
    return S.remove_source(chunks(s, d), gone(s)).select("chunk_id", "source")


def removed_counts(s: SparkSession, d: str) -> DataFrame:
    return S.removed_counts(chunks(s, d), gone(s))


def uploaded(s: SparkSession, d: str) -> DataFrame:
    """A new version of two sources: their documents again, marked."""
    own = chunks(s, d).join(gone(s), "source", "left_semi")
    return own.select(F.col("chunk_id") + 1_000_000_000, "source", "page", F.concat(F.lit("new "), "text").alias("text")).toDF("chunk_id", "source", "page", "text")


def append_chunks(s: SparkSession, d: str) -> DataFrame:
    return S.append(chunks(s, d), uploaded(s, d), ["chunk_id"]).select("chunk_id", "chunk_seq", "source")


def replace_source(s: SparkSession, d: str) -> DataFrame:
    return S.replace_sources(chunks(s, d), uploaded(s, d), ["chunk_id"]).select("chunk_id", "chunk_seq", "source")


def sources_in_order(s: SparkSession, d: str) -> DataFrame:
    return S.sources_in_order(chunks(s, d))


def context_reuse(s: SparkSession, d: str) -> DataFrame:
    """Contexts of an older store (every third chunk had one) carried over to a newer one of which every fifth text changed."""
    old = chunks(s, d).select("source", "page", "text", "chunk_seq", F.when(F.col("chunk_id") % 3 == 0, F.concat(F.lit("context "), "chunk_id")).otherwise(F.lit("")).alias("context"))
    new = chunks(s, d).withColumn("text", F.when(F.col("chunk_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return S.reuse_contexts(new, old).select("chunk_id", "context")


def context_pages(s: SparkSession, d: str) -> DataFrame:
    """The page text that a chunk's context would be made from; even pages are missing."""
    own = S.page_texts(chunks(s, d).withColumn("image_path", F.lit(None).cast("string"))).where("page % 2 = 1")
    return S.page_of_chunk(chunks(s, d), own).select("chunk_id", F.length("page_text").cast("long").alias("n"))


def merge_pages(s: SparkSession, d: str) -> DataFrame:
    own = pages(s, d)
    existing = own.where("page % 2 = 0")
    parsed = own.where("page % 3 = 0").withColumn("text", F.concat(F.lit("parsed "), "text"))
    diagrams = own.where("page % 7 = 0")
    return S.merge_pages(existing, parsed, diagrams).select("source", "page", F.sha2("text", 256).alias("sha"))


def replace_pages(s: SparkSession, d: str) -> DataFrame:
    """Every fifth page of a source as two new chunks; the rest keeps its place in the one order of the store, and its ids."""
    fixed = chunks(s, d).where("page % 5 = 1").select("source", "page").distinct().select("source", "page", F.posexplode(F.array(F.lit("first"), F.lit("second"))).alias("piece", "text"))
    return S.replace_pages(chunks(s, d), fixed).select("chunk_id", "source", "page", "chunk_seq", F.sha2("text", 256).alias("sha"))


def backfill_pages(s: SparkSession, d: str) -> DataFrame:
    own = chunks(s, d).withColumn("image_path", F.lit("p.png"))
    return S.backfill(own, own.where("source < 'src5'")).select("source", "page", F.sha2("text", 256).alias("sha"), "image_path")


def resume_targets(s: SparkSession, d: str) -> DataFrame:
    own = pages(s, d).select("source", "page")
    done = own.where("page % 2 = 0").withColumn("tag_method", F.when(F.col("page") % 4 == 0, F.lit("v2")).when(F.col("page") % 6 == 0, F.lit("v1")))
    return S.stale(own, done, "v2")


def transcript_sources(s: SparkSession, d: str) -> DataFrame:
    """Sources with their pages in order, as a manifest lists them, of transcripts that were saved."""
    path = fresh_path(s, "transcripts")
    TR.save_pages(pages(s, d), path)
    own = TR.page_lists(s, path)
    return own.select("source", F.size("pages").cast("long").alias("n_pages"), F.sha2(F.array_join(F.col("pages").cast("array<string>"), ","), 256).alias("pages_sha"))


def diagram_titles(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", T.first_line_title(F.coalesce("text", F.lit(""))).alias("title"))


def image_names(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d).select("source", "page", "image_path")


def ndjson_events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(T.event_line(F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id"), F.col("user_id").alias("user"))).alias("line"))


def squashed(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", F.sha2(T.squash(F.coalesce("text", F.lit(""))), 256).alias("sha"))


def evidence_verify(s: SparkSession, d: str) -> DataFrame:
    cases = table(s, d, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("evidence"))
    return E.evidence_pages(cases, pages(s, d))


BLOCKS = """('a', 1, 'text', '0', 'Intro $235m^{3}/hour$ here', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING)),
    ('a', 2, 'text', '0', 'Heading', '2', CAST(NULL AS STRING), CAST(NULL AS STRING)),
    ('a', 3, 'header', '0', 'skip me', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING)),
    ('a', 4, 'table', '1', CAST(NULL AS STRING), CAST(NULL AS STRING), '<table><tr><td>h</td><td>k</td></tr><tr><td>1</td><td>2</td></tr></table>', 'Caption'),
    ('a', 5, 'text', CAST(NULL AS STRING), 'no page', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING)),
    ('a', 6, 'text', 'x', 'bad page', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING)),
    ('a', 7, 'text', '1', '   ', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING)),
    ('a', 8, 'text', '1', 'Deep', '9', CAST(NULL AS STRING), CAST(NULL AS STRING))"""


def layout_blocks(s: SparkSession, d: str) -> DataFrame:
    """The fixture, and the raw web pages' titles as headings."""
    fixture = values(s, BLOCKS, "source, place, type, page_idx, text, text_level, table_body, caption").select(
        "source", F.col("place").cast("long").alias("place"), "type", "page_idx", "text", "text_level", "table_body",
        F.when(F.col("caption").isNotNull(), F.array("caption")).alias("table_caption"), F.lit(None).cast("array<string>").alias("image_caption"),
    )
    web = table(s, d, "pages").select(
        F.lit("web").alias("source"), F.col("page_id").alias("place"), F.lit("text").alias("type"), F.floor(F.col("page_id") / 10).cast("string").alias("page_idx"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("text"), F.lit("1").alias("text_level"), F.lit(None).cast("string").alias("table_body"),
        F.lit(None).cast("array<string>").alias("table_caption"), F.lit(None).cast("array<string>").alias("image_caption"),
    )
    return fixture.unionByName(web)


def blocks_to_pages(s: SparkSession, d: str) -> DataFrame:
    return L.blocks_to_pages(layout_blocks(s, d))


def page_batches(s: SparkSession, d: str) -> DataFrame:
    return L.page_batches(documents(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_pages")))


REASONS = "('bad', 9, 'whatever text', 'length'), ('short', 1, 'fine', 'stop'), ('none', 1, 'fine', CAST(NULL AS STRING))"


def failure_reasons(s: SparkSession, d: str) -> DataFrame:
    """Why transcriptions failed: pages, the degenerate ones, and some that hit the limit."""
    own = pages(s, d).select("source", "page", "text").unionByName(values(s, DEGENERATE, "source, page, text")).withColumn("finish_reason", F.lit("stop"))
    return Q.failure_reasons(own.unionByName(values(s, REASONS, "source, page, text, finish_reason")), ["source", "page"])


def chunk_contexts(s: SparkSession, d: str) -> DataFrame:
    """Contexts that the stand-in writes to every chunk on its page; even pages are missing."""
    own = S.page_texts(chunks(s, d).withColumn("image_path", F.lit(None).cast("string"))).where("page % 2 = 1")
    return V.contextualised(chunks(s, d), own).select("chunk_id", F.sha2("context", 256).alias("sha"))


def transcriptions(s: SparkSession, d: str) -> DataFrame:
    """Pages whose image is their text, read until it is fine or three tries more are over."""
    own = pages(s, d).select("source", "page", "text").unionByName(values(s, DEGENERATE, "source, page, text"))
    return V.transcriptions(own.select("source", "page", F.col("text").cast("binary").alias("content"))).select("source", "page", F.sha2("text", 256).alias("sha"))


def ingest_events(s: SparkSession, d: str) -> DataFrame:
    """What an ingest of two sources reports that replace what the store has of them."""
    new = uploaded(s, d)
    own = pages(s, d).join(gone(s), "source", "left_semi")
    found = V.ingest_events(own, new, own.where("page % 2 = 0"), S.removed_counts(chunks(s, d), gone(s)), S.replace_sources(chunks(s, d), new, ["chunk_id"]))
    return found.withColumn("source", F.coalesce("source", F.lit("-")))


QUERIES = {
    f.__name__: f
    for f in (
        degenerate_pages, damaged_contexts, longest_attempt, char_split, block_split, table_split, chunk_pages, damaged_pages, page_rebuild,
        remove_source, removed_counts, append_chunks, replace_source, sources_in_order, context_reuse, context_pages, merge_pages, replace_pages,
        backfill_pages, resume_targets, transcript_sources, diagram_titles, image_names, ndjson_events, squashed, evidence_verify, blocks_to_pages, page_batches,
        failure_reasons, chunk_contexts, transcriptions, ingest_events,
    )
}

PAGES = "pages_ AS (SELECT source, CAST(doc_id AS INTEGER) AS page, coalesce(text, '') AS text, replace(replace(source, '/', '_'), chr(92), '_') || '_p' || doc_id || '.png' AS image_path FROM documents)"
STRIP = r"regexp_replace({}, '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+|[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g')"


def judged(source: str) -> str:
    return rf"""lines AS (SELECT source, page, {STRIP.format('l')} AS line FROM (SELECT source, page, unnest(string_split(text, {NL})) AS l FROM {source})),
        patterns AS (SELECT source, page, regexp_replace(line, '[A-Za-z]{{0,6}}[-\s]?[0-9][\p{{L}}\p{{N}}_\-./]*', '#', 'g') AS pattern, count(*) AS n
                     FROM lines WHERE length(line) > 12 AND NOT starts_with(line, '|') GROUP BY ALL),
        judged AS (SELECT source, page, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (r), 0) AS BIGINT) AS mass, max(struct_pack(n := n, p := pattern)) FILTER (r) AS top
                   FROM (SELECT *, n >= 3 AND len(regexp_extract_all(pattern, '[0-9A-Za-z一-鿿]')) >= 15 AS r FROM patterns) GROUP BY source, page),
        bad AS (SELECT source, page, n_lines, mass, top.p AS top_pattern, top.n AS top_count FROM judged WHERE n_lines >= 20 AND mass >= 20 AND mass / n_lines > 0.35)"""


def joined(text: str, order: str) -> str:
    return f"string_agg({text}, {NL} || {NL} ORDER BY {order})"


UPLOADED = "uploaded AS (SELECT chunk_id + 1000000000 AS chunk_id, source, page, 'new ' || text AS text FROM chunks WHERE source IN ('src3', 'src7'))"
APPENDED = """SELECT u.chunk_id, (SELECT max(chunk_seq) FROM base) + coalesce((SELECT sum(n) FROM (SELECT source, min(chunk_id) AS f, count(*) AS n FROM uploaded GROUP BY source) b
        WHERE b.f < (SELECT min(chunk_id) FROM uploaded x WHERE x.source = u.source)), 0)::BIGINT + row_number() OVER (PARTITION BY source ORDER BY chunk_id) AS chunk_seq, source FROM uploaded u"""

ORACLE_SQL = {
    "degenerate_pages": f"WITH {PAGES}, every AS (SELECT source, page, text FROM pages_ UNION ALL SELECT * FROM (VALUES {DEGENERATE})), {judged('every')} SELECT * FROM bad",
    "damaged_contexts": r"""SELECT doc_id, text IS NULL OR length(text) < 15 OR NOT regexp_matches(coalesce(text, ''), '[。．.!?！？]\s*$') AS damaged FROM documents""",
    "longest_attempt": f"""WITH a AS (SELECT conv_id AS page, turn AS attempt, text FROM conversations UNION ALL SELECT -col0, col1, col2 FROM (VALUES {ATTEMPTS}))
        SELECT page, text FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY length(text) DESC, attempt) AS i FROM a) WHERE i = 1""",
    "char_split": f"""WITH n AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 WHEN length(text) <= 1600 THEN 1
            ELSE CAST(ceil((length(text) - 100) / 1500) AS INTEGER) END AS n FROM documents),
        p AS (SELECT doc_id, i, {STRIP.format('substr(text, i * 1500 + 1, 1600)')} AS t FROM n, LATERAL (SELECT unnest(range(n)) AS i))
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS piece, length(t) AS n, sha256(t) AS sha FROM p WHERE length(t) > 0""",
    "block_split": rf"""WITH {PAGES}, every AS (SELECT source, page, text FROM pages_ UNION ALL SELECT * FROM (VALUES {MARKDOWN})),
        l AS (SELECT source, page, generate_subscripts(string_split(text, {NL}), 1) AS i, unnest(string_split(text, {NL})) AS line FROM every),
        k AS (SELECT *, length({STRIP.format('line')}) = 0 AS blank, regexp_matches(line, '^\s*\|') AS tab, regexp_matches(line, '^#{{1,6}}\s') AS head FROM l),
        c AS (SELECT *, CASE WHEN blank OR lag(blank) OVER w IS DISTINCT FROM false OR lag(tab) OVER w IS DISTINCT FROM tab OR head THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY source, page ORDER BY i)),
        b AS (SELECT *, sum(new) OVER (PARTITION BY source, page ORDER BY i) AS b FROM c),
        g AS (SELECT source, page, b, string_agg(line, {NL} ORDER BY i) AS block FROM b WHERE NOT blank GROUP BY ALL)
        SELECT source, page, row_number() OVER (PARTITION BY source, page ORDER BY b) - 1 AS place, sha256(block) AS sha FROM g""",
    "damaged_pages": f"""WITH {CHUNKS}, every AS (SELECT source, page, {joined('text', 'chunk_seq')} AS text FROM chunks GROUP BY ALL UNION ALL SELECT * FROM (VALUES {DEGENERATE})), {judged('every')}
        SELECT source, page FROM bad""",
    "page_rebuild": f"""WITH {CHUNKS} SELECT source, page, sha256({joined('text', 'chunk_seq')}) AS sha,
        max(CASE WHEN chunk_id % 2 = 0 THEN replace(source, '/', '_') || '_p' || page || '.png' END) AS image_path FROM chunks GROUP BY source, page""",
    "remove_source": f"WITH {CHUNKS} SELECT chunk_id, source FROM chunks WHERE source IS NULL OR source NOT IN (VALUES {SOURCES})",
    "removed_counts": f"WITH {CHUNKS} SELECT s AS source, (SELECT count(*) FROM chunks WHERE source = s) AS removed FROM (VALUES {SOURCES}) t(s)",
    "append_chunks": f"WITH {CHUNKS}, {UPLOADED}, base AS (SELECT * FROM chunks) SELECT chunk_id, chunk_seq, source FROM base UNION ALL {APPENDED}",
    "replace_source": f"WITH {CHUNKS}, {UPLOADED}, base AS (SELECT * FROM chunks WHERE source NOT IN ('src3', 'src7')) SELECT chunk_id, chunk_seq, source FROM base UNION ALL {APPENDED}",
    "sources_in_order": f"WITH {CHUNKS} SELECT source, min(chunk_seq) AS first_seq, count(*) AS n_chunks FROM chunks GROUP BY source",
    "context_reuse": f"""WITH {CHUNKS}, old AS (SELECT source, page, text, arg_max('context ' || chunk_id, chunk_seq) AS context FROM chunks WHERE chunk_id % 3 = 0 GROUP BY ALL)
        SELECT c.chunk_id, o.context FROM (SELECT chunk_id, source, page, CASE WHEN chunk_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM chunks) c LEFT JOIN old o USING (source, page, text)""",
    "context_pages": f"""WITH {CHUNKS}, p AS (SELECT source, page, {joined('text', 'chunk_seq')} AS t FROM chunks WHERE page % 2 = 1 GROUP BY ALL)
        SELECT chunk_id, length(coalesce(t, text)) AS n FROM chunks LEFT JOIN p USING (source, page)""",
    "merge_pages": f"""WITH {PAGES}, a AS (SELECT * FROM pages_ WHERE page % 2 = 0), b AS (SELECT source, page, 'parsed ' || text AS text FROM pages_ WHERE page % 3 = 0 AND page % 7 <> 0)
        SELECT coalesce(a.source, b.source) AS source, coalesce(a.page, b.page) AS page, sha256(coalesce(b.text, a.text)) AS sha FROM a FULL JOIN b ON a.source = b.source AND a.page = b.page""",
    "replace_pages": f"""WITH {CHUNKS}, r AS (
            SELECT chunk_id, source, page, text, chunk_seq AS place, 0 AS piece FROM chunks WHERE page % 5 <> 1
            UNION ALL SELECT NULL, source, page, t, min(chunk_seq), i FROM chunks, (VALUES ('first', 0), ('second', 1)) v(t, i) WHERE page % 5 = 1 GROUP BY source, page, t, i)
        SELECT chunk_id, source, page, row_number() OVER (ORDER BY place, piece) - 1 AS chunk_seq, sha256(text) AS sha FROM r""",
    "backfill_pages": f"WITH {CHUNKS} SELECT source, page, sha256({joined('text', 'chunk_seq')}) AS sha, 'p.png' AS image_path FROM chunks WHERE source >= 'src5' GROUP BY source, page",
    "resume_targets": f"WITH {PAGES} SELECT source, page FROM pages_ WHERE page % 4 <> 0",
    "transcript_sources": f"WITH {PAGES} SELECT source, count(*) AS n_pages, sha256(string_agg(page::VARCHAR, ',' ORDER BY page)) AS pages_sha FROM pages_ GROUP BY source",
    "diagram_titles": rf"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), {NL}), 1) AS i, {STRIP.format(f"unnest(string_split(coalesce(text, ''), {NL}))")} AS line FROM documents)
        SELECT doc_id, substr(coalesce(arg_min(line, i) FILTER (contains(line, 'Illustration')), arg_min(line, i) FILTER (length(line) > 0), ''), 1, 120) AS title FROM l GROUP BY doc_id""",
    "image_names": f"WITH {PAGES} SELECT source, page, image_path FROM pages_",
    "ndjson_events": """SELECT '{"type":"' || event_type || '","id":' || event_id || ',"user":' || user_id || '}' AS line FROM events""",
    "squashed": r"SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', '', 'g')) AS sha FROM documents",
    "evidence_verify": rf"""WITH {PAGES}, q AS (SELECT item_id AS case_id, regexp_replace(text, '\s+', '', 'g') AS w FROM benchmark)
        SELECT case_id, source, page FROM q, (SELECT source, page, regexp_replace(text, '\s+', '', 'g') AS t FROM pages_) WHERE contains(t, w) AND w <> ''""",
    "blocks_to_pages": rf"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages),
        cut AS (SELECT page_id, string_split_regex(t, '\$[^$]{{1,120}}\$') AS outside, regexp_extract_all(t, '\$([^$]{{1,120}})\$', 1) AS inside FROM t),
        plain AS (SELECT page_id, array_to_string(list_transform(range(1, len(outside) + 1), lambda i: outside[i] || coalesce(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            inside[i], '\^\{{?3\}}?', '³', 'g'), '\^\{{?2\}}?', '²', 'g'), '\\times', '×', 'g'), '\\mathrm\{{([^}}]*)\}}', '\1', 'g'), '[{{}}\\]', '', 'g')), '')), '') AS t FROM cut)
        SELECT 'web' AS source, CAST(page_id // 10 + 1 AS INTEGER) AS page, string_agg(trim('# ' || t), {NL} || {NL} ORDER BY page_id) AS text FROM plain WHERE trim(t) <> '' GROUP BY ALL
        UNION ALL VALUES ('a', 1, 'Intro 235m³/hour here' || {NL} || {NL} || '## Heading'),
                         ('a', 2, 'Caption' || {NL} || '| h | k |' || {NL} || '|---|---|' || {NL} || '| 1 | 2 |' || {NL} || {NL} || '###### Deep')""",
    "page_batches": """WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
        SELECT source, i * 180 AS start, least((i + 1) * 180, n) AS stop FROM n, LATERAL (SELECT unnest(range(CAST(ceil(n / 180) AS INTEGER))) AS i)""",
}
ORACLE_SQL["table_split"] = f"""WITH RECURSIVE l AS (SELECT generate_subscripts(s, 1) AS i, unnest(s) AS row FROM (SELECT string_split(regexp_replace(text, '\\n$', ''), {NL}) AS s FROM (VALUES {MARKDOWN}) t(source, page, text) WHERE page = 2)),
        h AS (SELECT string_agg(row, {NL} ORDER BY i) AS header FROM l WHERE i <= 2),
        f(i, part, n, rows) AS (SELECT 2, 0, length(header), 0 FROM h
            UNION ALL SELECT l.i, CASE WHEN rows > 0 AND n + length(row) + 1 > 1600 THEN part + 1 ELSE part END,
                   CASE WHEN rows > 0 AND n + length(row) + 1 > 1600 THEN length(header) + length(row) + 1 ELSE n + length(row) + 1 END,
                   CASE WHEN rows > 0 AND n + length(row) + 1 > 1600 THEN 1 ELSE rows + 1 END
            FROM f JOIN l ON l.i = f.i + 1, h)
        SELECT CAST(part AS INTEGER) AS part, CAST(max(n) AS INTEGER) AS n, (SELECT substr(header, 1, 9) FROM h) AS header FROM f WHERE i > 2 GROUP BY part"""
ORACLE_SQL["chunk_pages"] = rf"""WITH RECURSIVE {PAGES}, every AS (SELECT source, page, text FROM pages_ UNION ALL SELECT * FROM (VALUES {MARKDOWN})),
        l AS (SELECT source, page, generate_subscripts(string_split(text, {NL}), 1) AS i, unnest(string_split(text, {NL})) AS line FROM every),
        k AS (SELECT *, length({STRIP.format('line')}) = 0 AS blank, regexp_matches(line, '^\s*\|') AS tab, regexp_matches(line, '^#{{1,6}}\s') AS head FROM l),
        c AS (SELECT *, CASE WHEN blank OR lag(blank) OVER w IS DISTINCT FROM false OR lag(tab) OVER w IS DISTINCT FROM tab OR head THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY source, page ORDER BY i)),
        n AS (SELECT *, sum(new) OVER (PARTITION BY source, page ORDER BY i) AS b FROM c),
        g AS (SELECT source, page, b, string_agg(line, {NL} ORDER BY i) AS block, bool_or(tab) AS tab FROM n WHERE NOT blank GROUP BY source, page, b),
        row AS (SELECT source, page, b, line, row_number() OVER (PARTITION BY source, page, b ORDER BY i) AS r FROM n JOIN g USING (source, page, b) WHERE NOT blank AND g.tab AND length(block) > 1600),
        top AS (SELECT source, page, b, string_agg(line, {NL} ORDER BY r) AS header FROM row WHERE r <= 2 GROUP BY ALL),
        f(source, page, b, r, part, n, rows) AS (SELECT source, page, b, 2, 0, length(header), 0 FROM top
            UNION ALL SELECT source, page, b, row.r, CASE WHEN rows > 0 AND n + length(line) + 1 > 1600 THEN part + 1 ELSE part END,
                   CASE WHEN rows > 0 AND n + length(line) + 1 > 1600 THEN length(header) + length(line) + 1 ELSE n + length(line) + 1 END,
                   CASE WHEN rows > 0 AND n + length(line) + 1 > 1600 THEN 1 ELSE rows + 1 END
            FROM f JOIN row USING (source, page, b) JOIN top USING (source, page, b) WHERE row.r = f.r + 1),
        sized AS (SELECT source, page, b, 0 AS part, block AS t FROM g WHERE length(block) <= 1600
            UNION ALL SELECT source, page, b, part, any_value(header) || {NL} || string_agg(line, {NL} ORDER BY r) FROM f JOIN row USING (source, page, b, r) JOIN top USING (source, page, b) WHERE r > 2 GROUP BY source, page, b, part
            UNION ALL SELECT source, page, b, i, {STRIP.format('substr(block, CAST(i * 1500 + 1 AS BIGINT), 1600)')} FROM g, LATERAL (SELECT unnest(range(CAST(ceil((length(block) - 100) / 1500) AS INTEGER))) AS i) WHERE length(block) > 1600 AND NOT tab),
        p AS (SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY b, part) AS i FROM sized WHERE t <> ''),
        packed(source, page, i, piece, n) AS (SELECT source, page, i, 0, length(t) FROM p WHERE i = 1
            UNION ALL SELECT p.source, p.page, p.i, CASE WHEN n + 2 + length(t) <= 800 THEN piece ELSE piece + 1 END, CASE WHEN n + 2 + length(t) <= 800 THEN n + 2 + length(t) ELSE length(t) END
            FROM packed JOIN p ON p.source = packed.source AND p.page = packed.page AND p.i = packed.i + 1)
        SELECT source, page, CAST(piece AS INTEGER) AS piece, CAST(length({joined('t', 'i')}) AS INTEGER) AS n, sha256({joined('t', 'i')}) AS sha FROM packed JOIN p USING (source, page, i) GROUP BY source, page, piece"""
ORACLE_SQL["failure_reasons"] = f"""WITH {PAGES}, every AS (SELECT source, page, text FROM pages_ UNION ALL SELECT * FROM (VALUES {DEGENERATE}) UNION ALL SELECT 'short', 1, 'fine' UNION ALL SELECT 'none', 1, 'fine'), {judged('every')}
        SELECT source, page, mass || '/' || n_lines || ' repeated lines: ' || substr(top_pattern, 1, 40) || ' x ' || top_count AS reason FROM bad UNION ALL SELECT 'bad', 9, 'length limit'"""
ORACLE_SQL["chunk_contexts"] = f"""WITH {CHUNKS}, w AS (SELECT chunk_id, trim(substr(list_last(string_split('片段内容：' || {NL} || text, {NL} || {NL})), 1, 120), ' ' || chr(9) || {NL} || chr(13)) AS c FROM chunks)
        SELECT chunk_id, CASE WHEN c <> '' THEN sha256(c) END AS sha FROM w"""
ORACLE_SQL["transcriptions"] = f"WITH {PAGES} SELECT source, page, sha256(text) AS sha FROM (SELECT source, page, text FROM pages_ UNION ALL SELECT * FROM (VALUES {DEGENERATE})) WHERE {STRIP.format('text')} <> ''"
ORACLE_SQL["ingest_events"] = f"""WITH {CHUNKS}, {PAGES}, p AS (SELECT source, count(*) AS n, count(*) FILTER (page % 2 = 0) AS images FROM pages_ WHERE source IN ('src3', 'src7') GROUP BY source),
        lines AS (SELECT source, 0 AS seq, '{{"type":"page_progress","file":"' || source || '","done":' || n || ',"total":' || n || '}}' AS line FROM p
            UNION ALL SELECT source, 1, '{{"type":"file_done","file":"' || source || '","pages":' || n || '}}' FROM p
            UNION ALL SELECT source, 2, '{{"type":"context_progress","done":' || n || ',"total":' || n || '}}' FROM p
            UNION ALL SELECT source, 3, '{{"type":"replaced","file":"' || source || '","removed":' || n || '}}' FROM p
            UNION ALL SELECT source, 4, '{{"type":"image_index_progress","done":' || images || ',"total":' || images || '}}' FROM p WHERE images > 0
            UNION ALL SELECT '-', 5, '{{"type":"complete","size":' || (SELECT count(*) FROM chunks) || ',"sources":[' || (SELECT string_agg('"' || source || '"', ',' ORDER BY source) FROM (SELECT DISTINCT source FROM chunks WHERE source IS NOT NULL)) || ']}}')
        SELECT seq, source, line FROM lines"""
