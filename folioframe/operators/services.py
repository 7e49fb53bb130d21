"""Jobs that call model services: query preparation, contexts, summaries, page images, diagrams, answers.

Every service is a provider (``functions.providers``), made once per task and called in Arrow batches.
What a failing call costs is said at each job.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import providers as P
from ..functions.text import event_line, keyword_query, strip, tags_in
from ..functions.vectors import l2_normalised
from ..sources.shared import written
from . import conversation, diagram, quality, store

#: How the parts of a prompt are headed.
PAGE_HEAD, CHUNK_HEAD, CONTEXT_HEAD, QUESTION_HEAD = "整页内容：\n", "片段内容：\n", "手册片段：\n", P.QUESTION_HEAD


def prepared_queries(questions: DataFrame, make: Callable[[], P.Writer] = P.KeywordReply) -> DataFrame:
    """(query_id, search_query, keyword_query) of questions (query_id, question, history).

    The service replies with JSON (query, keywords) to history and question.  Where it fails, or the reply is no
    such object, both are the question itself; missing parts count as empty.
    """
    prompt = F.concat_ws("\n", F.col("history"), F.concat(F.lit(QUESTION_HEAD), F.col("question")))
    reply = P.answered([prompt], lambda p, text: p.write(text), make, "string")
    parsed = questions.select("query_id", "question", F.from_json(reply, "query string, keywords string").alias("r"))
    known = F.coalesce(F.when(F.length(strip(F.col("r.query"))) > 0, strip(F.col("r.query"))), F.col("question"))
    return parsed.select("query_id", known.alias("search_query"), keyword_query(F.col("question"), F.col("r.query"), F.col("r.keywords")).alias("keyword_query"))


def contextualised(chunks: DataFrame, pages: DataFrame, make: Callable[[], P.Writer] = P.FirstSentence) -> DataFrame:
    """``chunks`` with ``context``: what the service writes to a chunk and its page (or itself, without one); null where it fails or writes nothing."""
    own = store.page_of_chunk(chunks.drop("context"), pages)
    prompt = F.concat(F.lit(PAGE_HEAD), "page_text", F.lit("\n\n" + CHUNK_HEAD), "text")
    reply = P.answered([prompt], lambda p, text: p.write(text), make, "string")
    return own.withColumn("context", reply).withColumn("context", F.when(F.length(strip(F.col("context"))) > 0, strip(F.col("context")))).drop("page_text")


def summary_replies(messages: DataFrame, summaries: DataFrame, make: Callable[[], P.Writer] = P.FirstSentence, turns: int = conversation.TURNS) -> DataFrame:
    """(conv_id, reply, upto): what the service writes, as it is, to conversations of which something left the window since the last summary; null where it fails."""
    due = conversation.summary_horizon(messages, summaries, turns).where("due").select("conv_id", F.col("kept_from").alias("upto"))
    told = conversation.summary_transcripts(messages.join(due.select("conv_id"), "conv_id", "left_semi"), turns)
    reply = P.answered([F.col("transcript")], lambda p, text: p.write(text), make, "string")
    return told.join(due, "conv_id").select("conv_id", reply.alias("reply"), "upto")


def summarised(messages: DataFrame, summaries: DataFrame, make: Callable[[], P.Writer] = P.FirstSentence, turns: int = conversation.TURNS) -> DataFrame:
    """(conv_id, summary, upto): new summaries of the conversations of which something left the window since the last one.

    Conversations whose summary fails or comes out empty keep the one they have, and aren't in the result.
    """
    replies = summary_replies(messages, summaries, make, turns)
    return replies.select("conv_id", strip(F.col("reply")).alias("summary"), "upto").where(F.length("summary") > 0)


def unit_or_null(vector: Column) -> Column:
    return l2_normalised(vector).cast("array<float>")


def image_vectors(pages: DataFrame, make: Callable[[], P.ImageEmbedder] = P.HashImageEmbedder) -> DataFrame:
    """(source, page, vector) of pages with an image (source, page, content), unit vectors; each page once, failing pages dropped."""
    first = pages.where("content IS NOT NULL").groupBy("source", "page").agg(F.min("content").alias("content"))
    vector = P.answered([F.col("content")], lambda p, image: np.asarray(p.embed_images([bytes(image)])[0], float).tolist(), make, "array<double>")
    return first.select("source", "page", vector.alias("vector")).withColumn("vector", unit_or_null(F.col("vector"))).where("vector IS NOT NULL")


def image_query_vectors(queries: DataFrame, make: Callable[[], P.ImageEmbedder] = P.HashImageEmbedder) -> DataFrame:
    """(query_id, query_vector) in the images' space; null where the service fails, which turns the channel off for the query."""
    vector = P.answered([F.col("query_text")], lambda p, text: np.asarray(p.embed_texts([text])[0], float).tolist(), make, "array<double>")
    return queries.select("query_id", vector.alias("query_vector")).withColumn("query_vector", unit_or_null(F.col("query_vector")))


def transcriptions(pages: DataFrame, make: Callable[[], P.Viewer] = P.PrintedText) -> DataFrame:
    """(source, page, text) of page images (source, page, content).

    A page whose text is cut or degenerate is read again, strictly, up to three times; if none is fine the longest
    stays, the first of equals.  A call that fails gives a line that says so, and pages that stay blank are dropped.
    """
    key = ["source", "page"]
    left, done, tried = pages.select(*key, "content"), [], []
    for attempt in range(1 + P.RETRIES):
        def call(p, page, image, strict=attempt > 0):
            try:
                text, reason = p.view(bytes(image), strict)
            except Exception as e:
                text, reason = f"[第{page}页转录失败: {e}]", None
            return json.dumps({"text": text, "finish_reason": reason})

        reply = P.answered([F.col("page"), F.col("content")], call, make, "string", failing=False)
        seen = left.withColumn("r", F.from_json(reply, "text string, finish_reason string"))
        seen = written(seen.select(*key, "content", F.coalesce("r.text", F.lit("")).alias("text"), "r.finish_reason", F.lit(attempt).alias("attempt")), "attempts")
        bad = written(quality.failure_reasons(seen, key).select(*key), "bad-attempts")
        done.append(seen.join(bad, key, "left_anti").select(*key, "text"))
        seen = seen.join(bad, key, "left_semi")
        tried.append(seen.select(*key, "text", "attempt"))
        left = seen.select(*key, "content")
        if bad.isEmpty():
            break
    fine, every = done[0], tried[0]
    for more, others in zip(done[1:], tried[1:], strict=True):
        fine, every = fine.unionAll(more), every.unionAll(others)
    rest = quality.longest_attempt(every.join(fine.select(*key), key, "left_anti"), key)
    return fine.unionByName(rest.select(*key, "text")).where(F.length(strip(F.col("text"))) > 0)


def tile_readings(tiles: DataFrame, make: Callable[[], P.Viewer] = P.PrintedText) -> DataFrame:
    """(source, page, run, tile, tag): tags that the service reads in tiles (source, page, run, tile, content); a failing call fails the job."""
    text = P.answered([F.col("content")], lambda p, image: p.view(bytes(image), False)[0], make, "string", failing=False)
    return tiles.select("source", "page", "run", "tile", F.explode(tags_in(F.coalesce(text, F.lit("")))).alias("tag"))


def page_tags(readings: DataFrame, least: int = 2) -> DataFrame:
    """(source, page, stable, unstable): tags of each page in order, normalised within a run, by how many runs show them."""
    key = ["source", "page"]
    readings = written(readings, "readings")  # the service reads each tile once
    votes = diagram.tag_votes(diagram.cleaned_runs(readings, key), key, least)
    found = votes.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("stable"), F.col("tag")))).alias("stable"),
        F.array_sort(F.collect_list(F.when(~F.col("stable"), F.col("tag")))).alias("unstable"),
    )
    none = F.array().cast("array<string>")
    own = readings.select(*key).distinct().join(found, key, "left")  # pages whose readings are no tags have neither
    return own.select(*key, F.coalesce("stable", none).alias("stable"), F.coalesce("unstable", none).alias("unstable"))


def gists(pages: DataFrame, make: Callable[[], P.Viewer] = P.PrintedText) -> DataFrame:
    """(source, page, gist) of diagram pages (source, page, content): what the service says of them, stripped; empty where it fails."""
    text = P.answered([F.col("content")], lambda p, image: p.view(bytes(image), False)[0], make, "string")
    return pages.select("source", "page", F.coalesce(strip(text), F.lit("")).alias("gist"))


def answer_events(questions: DataFrame, hits: DataFrame, make: Callable[[], P.Answerer] = P.FirstWords) -> DataFrame:
    """(query_id, seq, line): the events of an answer, as lines of JSON: its sources, pieces of text, and the end.

    ``questions`` (query_id, question, context, images as an array of data URIs, may be null); ``hits`` (query_id, place,
    source, page, text, score, image_path) are told in order of place.  A failing service fails the job.
    """
    cited = F.struct("place", F.struct("source", "page", "text", "score", "image_path").alias("s"))
    sources = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(cited)), lambda x: x["s"]).alias("sources"))
    prompt = F.concat(F.lit(CONTEXT_HEAD), F.coalesce("context", F.lit("")), F.lit("\n\n" + QUESTION_HEAD), "question")
    images = F.coalesce("images", F.array().cast("array<string>"))
    pieces = P.answered([prompt, images], lambda p, text, uris: [d for d in p.stream(text, list(uris)) if d], make, "array<string>", failing=False)
    asked = questions.withColumn("pieces", pieces).join(sources, "query_id", "left")
    kept = {"ignoreNullFields": "false"}
    first = F.to_json(F.struct(F.lit("sources").alias("type"), F.coalesce("sources", F.expr("array()").cast(sources.schema["sources"].dataType)).alias("sources")), kept)
    deltas = F.transform("pieces", lambda d: event_line(F.struct(F.lit("delta").alias("type"), d.alias("text"))))
    lines = F.concat(F.array(first), deltas, F.array(event_line(F.struct(F.lit("done").alias("type")))))
    return asked.select("query_id", F.posexplode(lines).alias("seq", "line"))


def ingest_events(new_pages: DataFrame, new_chunks: DataFrame, images: DataFrame, removed: DataFrame, kept: DataFrame) -> DataFrame:
    """(seq, source, line): what an ingest reports, as lines of JSON.

    For each source its pages (done and total, then the end of the file), its contexts, its page images, and how many
    old chunks it replaced (``removed``: source, removed); then one line for the whole: the size of the store and its
    sources.  Without a chunk the only line is an error.  ``kept`` is the store after the ingest (source).
    """
    counts = new_pages.groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
    counts = counts.join(new_chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks")), "source", "left")
    counts = counts.join(images.groupBy("source").agg(F.count(F.lit(1)).alias("images")), "source", "left")
    counts = counts.join(removed.select("source", "removed"), "source", "left").na.fill(0, ["chunks", "images", "removed"])
    kind = lambda name: F.lit(name).alias("type")
    told = [
        (True, F.struct(kind("page_progress"), F.col("source").alias("file"), F.col("pages").alias("done"), F.col("pages").alias("total"))),
        (True, F.struct(kind("file_done"), F.col("source").alias("file"), "pages")),
        (F.col("chunks") > 0, F.struct(kind("context_progress"), F.col("chunks").alias("done"), F.col("chunks").alias("total"))),
        (F.col("removed") > 0, F.struct(kind("replaced"), F.col("source").alias("file"), "removed")),
        (F.col("images") > 0, F.struct(kind("image_index_progress"), F.col("images").alias("done"), F.col("images").alias("total"))),
    ]
    lines = F.array(*[F.struct(F.lit(i).alias("seq"), F.when(F.lit(c) if c is True else c, event_line(e)).alias("line")) for i, (c, e) in enumerate(told)])
    by_source = counts.select("source", F.inline(lines)).where("line IS NOT NULL")
    total = new_chunks.agg(F.count(F.lit(1)).alias("n"))
    size = kept.agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_set("source")).alias("sources"))
    error = event_line(F.struct(kind("error"), F.lit("no content").alias("message")))
    end = total.crossJoin(size).select(
        F.lit(None).cast("string").alias("source"), F.lit(len(told)).alias("seq"),
        F.when(F.col("n") == 0, error).otherwise(event_line(F.struct(kind("complete"), "size", "sources"))).alias("line"),
    )
    return by_source.join(F.broadcast(total.where("n > 0")).select(F.lit(1).alias("some")), how="cross").drop("some").unionByName(end).select("seq", "source", "line")
