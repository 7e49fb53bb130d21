"""Folds, graphs, rasters, sources, providers and streams against plain Python."""

import json
import random
import re

import numpy as np
from pyspark.sql import functions as F

from folioframe.functions import providers as P
from folioframe.functions import text as T
from folioframe.operators import chunking as C
from folioframe.operators import evaluation as E
from folioframe.operators import graph as G
from folioframe.operators import index as I
from folioframe.operators import quality as Q
from folioframe.operators import raster as R
from folioframe.operators import retrieval as V
from folioframe.operators import store as S
from folioframe.sources import store as ST
from folioframe.sources import transcripts as TR
from folioframe.streaming import ingest


def plain_blocks(text):
    out, held, kind = [], [], None
    for line in [*text.split("\n"), ""]:
        now = "table" if re.match(r"\s*\|", line) else "text"
        if not line.strip() or (kind and now != kind) or re.match(r"#{1,6}\s", line):
            if held:
                out.append("\n".join(held))
            held, kind = [], None
        if line.strip():
            held.append(line)
            kind = now
    return out


def plain_chunks(text, target=800, most=1600):
    sized = []
    for block in plain_blocks(text):
        if len(block) <= most:
            sized.append(block)
        elif block.lstrip().startswith("|"):
            lines = block.split("\n")
            head, rows = "\n".join(lines[:2]), []
            for row in lines[2:]:
                if rows and len(head) + sum(len(r) + 1 for r in rows) + len(row) + 1 > most:
                    sized.append("\n".join([head, *rows]))
                    rows = []
                rows.append(row)
            sized.append("\n".join([head, *rows]))
        else:
            at = 0
            while True:
                sized.append(block[at : at + most].strip())
                if at + most >= len(block):
                    break
                at += most - 100
    out, now = [], ""
    for block in sized:
        joined = f"{now}\n\n{block}" if now else block
        if len(joined) <= target:
            now = joined
        else:
            out += [now] * bool(now)
            now = block
    return out + [now] * bool(now)


def markdown(seed):
    r = random.Random(seed)
    parts = []
    for _ in range(r.randint(0, 12)):
        kind = r.randrange(4)
        if kind == 0:
            parts.append("#" * r.randint(1, 7) + " heading " + "x" * r.randint(0, 30))
        elif kind == 1:
            parts.append("\n".join("| " + "c" * r.randint(1, 60) + " |" for _ in range(r.randint(1, 60))))
        elif kind == 2:
            parts.append("word " * r.randint(1, 700))
        else:
            parts.append("\n".join("line " * r.randint(1, 20) for _ in range(r.randint(1, 5))))
    return "".join(p + r.choice(["\n", "\n\n", "\n \n"]) for p in parts)


def test_chunks_match_a_plain_fold(spark):
    texts = [markdown(i) for i in range(60)] + ["", "\n\n", "one"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "source string, page int, text string")
    found = {}
    for row in C.chunk_pages(df.repartition(5)).collect():
        found.setdefault(row.page, {})[row.piece] = row.text
    for i, t in enumerate(texts):
        assert [found.get(i, {})[k] for k in sorted(found.get(i, {}))] == plain_chunks(t), i


def test_null_page_has_no_chunks(spark):
    assert C.chunk_pages(spark.createDataFrame([("s", 1, None)], "source string, page int, text string")).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(200, 260)]
    parent = list(range(300))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.range(300).withColumnRenamed("id", "node")
    found = G.components(nodes, spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {i: find(i) for i in range(300)}


def test_rank_fusion_of_nothing(spark):
    none = spark.createDataFrame([], "query_id long, chunk_id long, rank int")
    pages = spark.createDataFrame([], "query_id long, source string, page int, rank int")
    chunks = spark.createDataFrame([], "chunk_id long, source string, page int")
    assert V.fuse(none, none, pages, chunks).count() == 0


def test_zero_and_null_vectors_are_not_ranked(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query_vector array<double>")
    assert [r.chunk_id for r in I.vector_topk(vectors, asked).collect()] == [3]


def test_query_blocks_give_the_same_scores(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(10)], "query_id long, query_vector array<double>")

    def found():
        return sorted((r.query_id, r.chunk_id, r["rank"], round(r.score, 9)) for r in I.vector_topk(vectors, asked).collect())

    whole = found()
    monkeypatch.setattr(I, "QUERY_BLOCK", 3)
    assert found() == whole


def test_latex(spark):
    texts = ["$235m^{3}/hour$", "costs $5", "$a \\times b$ and $\\mathrm{kW}$ for $x^2$", "", "$^30$"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.latex_to_plain(F.col("t")))
    assert [r[0] for r in df.collect()] == ["235m³/hour", "costs $5", "a × b and kW for x²", "", "³0"]


def test_html_table(spark):
    table = '<table><tr><th colspan="2">A &amp; B</th></tr><tr><td>x|y</td><td>1</td><td> 2<br>3 </td></tr></table>'
    df = spark.createDataFrame([(table,), ("",), (None,)], "t string").select(T.html_table_to_markdown(F.col("t")))
    assert [r[0] for r in df.collect()] == ["| A & B | A & B |  |\n|---|---|---|\n| x\\|y | 1 | 2 3 |", "", ""]


def test_diagram_pages(spark):
    pages = spark.createDataFrame([("s", 1, " few "), ("s", 2, "x" * 2000), ("s", 3, "few")], "source string, page int, text string")
    images = spark.createDataFrame([("s", 1, 2000, 2000), ("s", 2, 3000, 3000), ("s", 3, 10, 10)], "source string, page int, width int, height int")
    assert [r.page for r in Q.is_diagram(pages, images, ["source", "page"]).collect()] == [1]


def test_append_to_an_empty_store(spark):
    schema = "chunk_id long, chunk_seq long, source string"
    empty = spark.createDataFrame([], schema)
    new = spark.createDataFrame([(5, 0, "b"), (3, 0, "a"), (4, 0, "b")], schema)
    assert sorted(map(tuple, S.append(empty, new, ["chunk_id"]).collect())) == [(3, 0, "a"), (4, 1, "b"), (5, 2, "b")]


def test_recall_without_cases(spark):
    row = E.recall(spark.createDataFrame([], "case_id long, rank int")).first()
    assert (row.cases, row.recall_1, row.mrr) == (0, 0.0, 0.0)


def test_cases(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"q": "a", "source": "s", "page": 3, "evidence": "x"}) + "\n" + json.dumps({"q": "b", "source": "s", "pages": [1, 2], "evidence": {"1": "y", "2": "z"}, "kind": "multi"}))
    found = {r.q: (r.kind, dict(r.evidence)) for r in TR.load_cases(spark, str(tmp_path)).collect()}
    assert found == {"a": ("single", {3: "x"}), "b": ("multi", {1: "y", 2: "z"})}


def test_diagram_index(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"b": {"10": {"title": "T", "tags": ["A1"], "symbols": {"valve": 2}}, "2": {}}, "a": {}}))
    found = TR.load_diagram_index(spark, str(tmp_path / "d.json")).orderBy("source", "page").collect()
    assert [(r.source, r.page, r.title, r.tags, r.symbols) for r in found] == [("b", 2, "", [], {}), ("b", 10, "T", ["A1"], {"valve": 2})]


def test_transcripts(spark, tmp_path):
    path = str(tmp_path / "t")
    names = ["007", "a/b", "a_b", "维护 手册+[1].pdf"]
    schema = "source string, page int, text string, image_path string"
    TR.save_pages(spark.createDataFrame([(n, p, f"{n}{p}", None) for n in names for p in (1, 2)], schema), path)
    TR.save_pages(spark.createDataFrame([("007", 1, "new", "i.png")], schema), path)
    assert sorted(r.source for r in TR.list_sources(spark, path).collect()) == sorted(names)
    assert [tuple(r) for r in TR.load_pages(spark, path, "007").select("page", "text").collect()] == [(1, "new")]
    assert TR.remove_source(spark, path, "a/b") and not TR.remove_source(spark, path, "a/b")
    assert sorted(r.source for r in TR.list_sources(spark, path).collect()) == sorted(n for n in names if n != "a/b")


def test_transcript_tree(spark, tmp_path):
    for name, manifest in (("x", {"source": "the x", "pages": [{"page": 1, "image_path": "1.png"}, {"page": 2, "image_path": None}]}), ("bad", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps(manifest) if manifest else "{broken")
        (tmp_path / name / "p1.md").write_text("line one\nline two")
    assert [tuple(r) for r in TR.load_tree(spark, str(tmp_path)).collect()] == [("the x", 1, "line one\nline two", "1.png")]


def test_stream_replaces_sources(spark, tmp_path):
    arrive, folder = tmp_path / "in", str(tmp_path)
    arrive.mkdir()

    def put(name, *rows):
        (arrive / name).write_text("\n".join(json.dumps(dict(zip(("source", "page", "text"), r))) for r in rows))
        ingest.ingest(ingest.page_stream(spark, str(arrive)), f"{folder}/t", f"{folder}/c", f"{folder}/k").awaitTermination()

    put("1.json", ("a", 1, "one"), ("a", 2, "two"), ("b", 1, "bee"))
    put("2.json", ("a", 1, "new"))
    assert sorted(tuple(r) for r in TR.load_pages(spark, f"{folder}/t").select("source", "page", "text").collect()) == [("a", 1, "new"), ("b", 1, "bee")]
    assert sorted(r.text for r in spark.read.parquet(f"{folder}/c").collect()) == ["bee", "new"]


def test_providers(spark):
    class Broken:
        def write(self, prompt):
            raise RuntimeError

        def rerank(self, query, documents):
            raise RuntimeError

    df = spark.createDataFrame([("some text",), (None,)], "t string")
    assert [len(r[0]) for r in df.select(P.embedded(F.col("t"))).collect()] == [P.DIMENSIONS] * 2
    assert [r[0] for r in df.select(P.written_or(F.col("t"), F.lit("default"), Broken)).collect()] == ["default"] * 2
    pool = spark.createDataFrame([(1, "red valve", i, t, i) for i, t in enumerate(["pump", "red valve", "red"])], "query_id long, query_text string, chunk_id long, text string, rank int")
    assert [r.chunk_id for r in P.reranked(pool).orderBy("rank").collect()] == [1, 2, 0]
    assert [r.chunk_id for r in P.reranked(pool, Broken).orderBy("rank").collect()] == [0, 1, 2]
    assert P.transcribed(lambda i: ("x" * (5 - i), "length"), lambda t, r: r == "length") == "xxxxx"
    assert P.transcribed(lambda i: ("bad" if i < 2 else "fine", None), lambda t, r: t == "bad") == "fine"


def test_symbols():
    page = np.full((60, 80, 3), 255, np.uint8)
    page[20:32, 30:33] = 0
    page[29:32, 30:42] = 0
    page[5:15, 5:15] = (255, 0, 0)
    mask = R.black_mask(page)
    assert mask[21, 31] == 255 and mask[7, 7] == 0
    found = R.symbols(mask, {"corner": mask[18:34, 28:44]})
    assert found[0][:2] == ("corner", 0) and found[0][3] == (28, 18, 44, 34) and found[0][2] > 0.99
    assert R.symbols(np.zeros((20, 20), np.uint8), {"corner": mask[18:34, 28:44]}) == []


def test_store_layers(spark, tmp_path):
    path = str(tmp_path)
    assert ST.load(spark, "chunks", path) is None
    chunks = spark.createDataFrame([(i, i, 1, f"t{i}", None, None, [1.0], s) for i, s in enumerate("aab")], ST.LAYERS["chunks"])
    ST.save("chunks", chunks, path)
    ST.save("chunks", chunks.where("chunk_id = 0").withColumn("text", F.lit("new")), path)
    assert sorted((r.source, r.text) for r in ST.load(spark, "chunks", path).collect()) == [("a", "new"), ("b", "t2")]
    assert ST.delete_source(spark, "a", path) == {"transcripts": False, "chunks": True, "images": False}
    assert [r.source for r in ST.load(spark, "chunks", path).collect()] == ["b"]
    ST.clear(spark, path)
    assert ST.load(spark, "chunks", path) is None


def test_page_image_uris(spark):
    results = spark.createDataFrame([(1, 1, "s", 1, "a.png"), (1, 2, "s", 1, "a.png"), (1, 3, "s", 2, "gone.png"), (1, 4, "s", 3, None)], "query_id long, place int, source string, page int, image_path string")
    files = spark.createDataFrame([("a.png", b"xy")], "image_path string, content binary")
    assert [tuple(r) for r in ST.page_image_uris(results, files).collect()] == [(1, 1, "data:image/png;base64,eHk=")]


def test_diagram_chunks(spark):
    schema = "source string, page int, title string, gist string, tags array<string>, media array<string>, symbols map<string,int>, image_path string"
    pages = spark.createDataFrame([("s", 1, "T", "", ["A1"], [], {}, None), ("s", 2, "U", "g", [], [], {"v": 1}, None)], schema)
    images = spark.createDataFrame([("s", 1, "1.png")], "source string, page int, image_path string")
    found = ST.diagram_chunks(pages, images, F.concat("title", F.lit("!"))).collect()
    assert [(r.page, r.text, r.image_path) for r in found] == [(1, "T!", "1.png")]


def test_keyword_query(spark):
    df = spark.createDataFrame([("q", " better ", "pump"), ("q", None, "pump"), ("q", "", None)], "a string, b string, c string")
    assert [r[0] for r in df.select(T.keyword_query(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["better pump", "q pump", "q"]


def test_entities(spark):
    import html

    texts = ["&deg;C &plusmn;5 &#176; &#xB0;", "&ampx &notit; &unknown; &#128; &#0; &#x110000; &#55296;", "&lt;td&gt; a&#124;b", "plain", "", "&amp;lt;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.entities_resolved(F.col("t")))
    assert [r[0] for r in df.collect()] == [html.unescape(t) for t in texts]
    table = "<table><tr><td>&lt;b&gt; 5 &deg;C</td><td>a&#124;b&nbsp; c</td></tr></table>"
    df = spark.createDataFrame([(table,)], "t string").select(T.html_table_to_markdown(F.col("t")))
    assert df.first()[0] == "| <b> 5 °C | a\\|b c |\n|---|---|"


def test_damaged_and_squashed_white_space(spark):
    df = spark.createDataFrame([("A sentence that ends.　\x1d",), ("A sentence that ends",), ("short.",), (None,)], "t string")
    assert [r[0] for r in df.select(T.is_damaged(F.col("t"))).collect()] == [False, True, True, True]
    assert df.select(T.squash(F.col("t"))).first()[0] == "Asentencethatends."


def test_segmenter(spark):
    df = spark.createDataFrame([("Valve 阀门关闭, ok",)], "t string")
    cut = df.select(T.tokens(F.col("t"), lambda c: F.split(F.regexp_replace(c, "(?<=阀门)", " "), " ")))
    assert cut.first()[0] == ["valve", "阀门", "关闭,", "ok"]


def drawn(scale, page=(90, 120), at=(20, 30)):
    """A page that shows a cross with a filled corner at a scale, and the cross as a template."""
    own = np.zeros((24, 24), np.uint8)
    own[10:14, :] = own[:, 10:14] = own[:10, :6] = 255
    shape = R.resized(own, scale) > 127
    image = np.full((*page, 3), 255, np.uint8)
    y, x = at
    image[y : y + shape.shape[0], x : x + shape.shape[1]][shape] = 0
    return image, own


def test_symbols_at_all_sizes():
    for scale in R.SCALES:
        image, own = drawn(scale)
        hits = R.symbols(R.black_mask(image), {"cross": own})
        side = max(4, int(24 * scale))
        kind, turn, score, box = hits[0]
        assert (kind, turn) == ("cross", 0) and score > 0.85, scale
        assert all(abs(a - b) <= 1 for a, b in zip(box, (30, 20, 30 + side, 20 + side))), scale


def test_symbols_turned_and_cropped(spark):
    image, own = drawn(1.0)
    turned = np.ascontiguousarray(np.rot90(image, -1))
    assert R.symbols(R.black_mask(turned), {"cross": own})[0][:2] == ("cross", 90)
    assert (R.crop_template(image, (30, 20, 54, 44)) == own).all()
    assert R.crop_template(image, (110, 80, 200, 200)).shape == (10, 10)
    pages = spark.createDataFrame([("s", 1, image.shape[0], image.shape[1], image.tobytes()), ("s", 2, 8, 8, b"\xff" * 192)], "source string, page int, height int, width int, rgb binary")
    assert [tuple(r) for r in R.symbol_counts(R.detect(pages, {"cross": own})).collect()] == [("s", 1, "cross", 1)]


def test_replace_pages_keeps_the_order_of_the_store(spark):
    schema = "chunk_id long, chunk_seq long, source string, page int, text string, context string, vector array<float>"
    rows = [(10, 0, "b", 1, "b1", "c", [1.0]), (11, 1, "a", 1, "a1", None, [1.0]), (12, 2, "a", 1, "a1x", None, [1.0]), (13, 3, "a", 2, "a2", "d", [2.0]), (14, 4, "b", 1, "b1x", None, None)]
    fixed = spark.createDataFrame([("a", 1, 0, "new", 99), ("a", 1, 1, "newer", 98), ("b", 1, 0, "bnew", 97), ("x", 9, 0, "unknown", 96)], "source string, page int, piece int, text string, chunk_id long")
    found = S.replace_pages(spark.createDataFrame(rows, schema), fixed)
    assert found.columns == spark.createDataFrame(rows, schema).columns
    assert [(r.chunk_seq, r.chunk_id, r.text, r.context, r.vector) for r in found.orderBy("chunk_seq").collect()] == [
        (0, 97, "bnew", None, None), (1, 99, "new", None, None), (2, 98, "newer", None, None), (3, 13, "a2", "d", [2.0])
    ]


def test_appended_vectors_have_unit_length(spark):
    schema = "chunk_id long, chunk_seq long, source string, vector array<float>"
    found = S.append(spark.createDataFrame([], schema), spark.createDataFrame([(1, 0, "a", [3.0, 4.0]), (2, 0, "a", [0.0, 0.0])], schema), ["chunk_id"])
    assert [[round(v, 5) for v in r.vector] if r.vector else None for r in found.orderBy("chunk_id").collect()] == [[0.6, 0.8], None]


def test_pipe_runs_are_components(spark):
    from folioframe.operators import diagram as D

    r = random.Random(8)
    rows = [(p, p * 1000 + i, *(float(r.randrange(120)) for _ in range(2)), *(float(r.randrange(120)) for _ in range(2))) for p in (1, 2) for i in range(120)]
    lines = spark.createDataFrame(rows, "page int, seg long, x0 double, y0 double, x1 double, y1 double")
    want = {x.node: x.component for x in G.components(lines.select(F.col("seg").alias("node")), D.joined_ends(lines, ["page"])).collect()}
    sizes = {}
    for root in want.values():
        sizes[root] = sizes.get(root, 0) + 1
    found = D.runs_in_order(D.pipe_runs(lines.repartition(3), ["page"]), ["page"]).collect()
    assert {x.run: x.segments for x in found} == sizes and len(set(sizes.values())) > 1
    for p in (1, 2):
        own = sorted((x.place, x.segments) for x in found if x.page == p)
        assert [n for _, n in own] == sorted((n for _, n in own), reverse=True)


def test_diagram_drawings(spark):
    from folioframe.operators import diagram as D

    schema = "source string, page int, item int, kind string, colour string, x0 double, y0 double, x1 double, y1 double"
    rows = [("s", 1, i, "l", "1,0,0", 0.0, 0.0, 1.0, 1.0) for i in range(14)] + [("s", 1, 20, "re", "1,0,0", 0.0, 0.0, 2.0, 3.0), ("s", 2, 1, "l", None, 0.0, 0.0, 1.0, 1.0), ("s", 2, 2, "c", "1,0,0", 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, schema)
    assert [r.page for r in D.has_vector_pipes(df).collect()] == [1]
    edges = {(r.x0, r.y0, r.x1, r.y1) for r in D.segments(df).where("item = 20").collect()}
    assert edges == {(0, 0, 2, 0), (2, 0, 2, 3), (2, 3, 0, 3), (0, 3, 0, 0)} and D.segments(df).count() == 18


def test_stored_index_follows_its_chunks(spark, tmp_path):
    path, images = str(tmp_path / "kb"), tmp_path / "img"
    images.mkdir()
    (images / "a_p1.png").write_bytes(b"x")
    (images / "b_p1.png").write_bytes(b"x")
    schema = ST.LAYERS["chunks"]
    rows = [(1, 0, 1, "red valve", None, "a_p1.png", None, "a"), (2, 1, 1, "blue valve pump", "near the boiler", "b_p1.png", None, "b"), (3, 2, 2, "", None, None, None, "b")]
    asked = spark.createDataFrame([(7, "boiler pump"), (8, "red")], "query_id long, query_text string")

    def found():
        index = ST.load_index(spark, path)
        return sorted((r.query_id, r.chunk_id) for r in I.search_words(index, asked).collect()), index.stats.first()

    assert ST.load_index(spark, path) is None
    ST.save("chunks", spark.createDataFrame(rows, schema), path)
    ST.save_index(spark, path)
    hits, stats = found()
    assert hits == [(7, 2), (8, 1)] and (stats.n, stats.avgdl) == (3, 8 / 3)
    ST.save("chunks", spark.createDataFrame([(4, 3, 1, "red pump", None, None, None, "a")], schema), path)
    ST.save_index(spark, path, ["a"])
    assert found()[0] == [(7, 2), (7, 4), (8, 4)]
    assert ST.delete_source(spark, "b", path, str(images))["chunks"]
    assert found()[0] == [(7, 4), (8, 4)] and [p.name for p in images.iterdir()] == ["a_p1.png"]
    ST.clear(spark, path)
    assert ST.load_index(spark, path) is None


def test_stored_index_scores_as_one_made_for_the_call(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 30)))) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "a bb c"), (2, "zzz"), (3, "")], "query_id long, query_text string")
    index = I.word_index(chunks, I.postings(chunks))
    direct = {(x.query_id, x.chunk_id): round(x.score, 9) for x in I.bm25_scores(chunks, asked).collect()}
    assert direct == {(x.query_id, x.chunk_id): round(x.score, 9) for x in I.search_words(index, asked).collect()} and {q for q, _ in direct} == {1}


def test_vector_scan_keeps_no_more_than_the_best(spark):
    rows = [(i, [float(i % 50), 1.0]) for i in range(5000)]
    vectors = spark.createDataFrame(rows, "chunk_id long, vector array<double>").coalesce(2)
    asked = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(3)], "query_id long, query_vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        scores = I.vector_scores(vectors, asked, ["chunk_id"], 5)
        ranked = I.ranked(scores, 5, "chunk_id").collect()
        held = scores.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for q in range(3):
        unit = {i: (v[0] + q) / ((v[0] ** 2 + 1) ** 0.5 * (1 + q * q) ** 0.5) for i, v in rows}
        want += [(q, i) for i in sorted(unit, key=lambda i: (-round(unit[i], 9), i))[:5]]
    assert sorted((r.query_id, r.chunk_id) for r in ranked) == sorted(want) and held <= 2 * 3 * 100


def test_patterns_in_rounds(spark, monkeypatch):
    from folioframe.functions import patterns as PT

    texts = spark.createDataFrame([(1, "abcd"), (2, ""), (3, None), (4, "bc bc")], "k long, t string")
    wanted = spark.createDataFrame([("bc",), ("abcd",), ("",), (None,), ("zz",)], "p string")
    monkeypatch.setattr(PT, "PATTERN_BLOCK", 1)
    assert sorted(map(tuple, PT.held_patterns(texts, ["k"], "t", wanted).collect())) == [(1, "abcd"), (1, "bc"), (4, "bc")]
    monkeypatch.setattr(PT, "ahocorasick", None)
    assert PT.finder(["bc", "x"])("abc") == {"bc"}


def test_rows_in_order(spark):
    from folioframe.operators.ordering import in_order

    r = random.Random(4)
    rows = [(r.randrange(1000), i) for i in range(500)]
    found = in_order(spark.createDataFrame(rows, "a long, b long").repartition(7), ["a", "b"], "n").collect()
    assert [(x.a, x.b) for x in sorted(found, key=lambda x: x.n)] == sorted(rows) and sorted(x.n for x in found) == list(range(500))


def test_stream_makes_chunks_that_can_be_searched(spark, tmp_path):
    arrive, folder = tmp_path / "in", str(tmp_path)
    arrive.mkdir()
    for name, rows in (("1.json", [("a", 1, "red valve"), ("b", 1, "blue pump")]), ("2.json", [("a", 1, "green valve"), ("a", 2, "")])):
        (arrive / name).write_text("\n".join(json.dumps(dict(zip(("source", "page", "text"), r))) for r in rows))
        ingest.ingest(ingest.page_stream(spark, str(arrive)), f"{folder}/t", f"{folder}/c", f"{folder}/k").awaitTermination()
    found = sorted((r.chunk_seq, r.source, r.text) for r in ingest.stored_chunks(spark, f"{folder}/c").collect())
    assert found == [(1, "b", "blue pump"), (2, "a", "green valve")]
    rows = ingest.stored_chunks(spark, f"{folder}/c").collect()
    assert all(r.context and abs(sum(v * v for v in r.vector) - 1) < 1e-5 for r in rows) and len({r.chunk_id for r in rows}) == 2


def test_services_and_their_failures(spark):
    from folioframe.operators import services as V

    class Odd:
        """Fails, is silent, or isn't JSON, as the text says."""

        def write(self, prompt):
            if "fail" in prompt:
                raise RuntimeError
            return {"s": "", "j": "[1]", "k": '{"query": " better ", "keywords": null}'}.get(prompt[-1], "not json")

        def embed_images(self, images):
            if images[0] == b"fail":
                raise RuntimeError
            return np.array([[3.0, 4.0]])

        def view(self, image, strict):
            if image == b"fail":
                raise RuntimeError("gone")
            line = "The valve GFV12 is shown in the picture here\n"
            return ("fine" if strict else line * 40, "stop") if image == b"once" else (line * (30 + strict), "stop") if image == b"never" else ("", "stop")

        def stream(self, prompt, images):
            yield from ("one ", "", f"two {len(images)}")

    asked = spark.createDataFrame([(i, t, None) for i, t in enumerate(["fail", "xs", "xj", "xk", "x?"])], "query_id long, question string, history string")
    found = {r.query_id: (r.search_query, r.keyword_query) for r in V.prepared_queries(asked, Odd).collect()}
    assert found == {0: ("fail",) * 2, 1: ("xs",) * 2, 2: ("xj",) * 2, 3: ("better",) * 2, 4: ("x?",) * 2}
    chunks = spark.createDataFrame([(1, "s", 1, "fail"), (2, "s", 1, "xs"), (3, "s", 2, "xj")], "chunk_id long, source string, page int, text string")
    none = spark.createDataFrame([], "source string, page int, text string")
    assert {r.chunk_id: r.context for r in V.contextualised(chunks, none, Odd).collect()} == {1: None, 2: None, 3: "[1]"}
    images = spark.createDataFrame([("s", 1, b"ok"), ("s", 1, b"ok"), ("s", 2, b"fail"), ("s", 3, None)], "source string, page int, content binary")
    assert [(r.page, [round(v, 3) for v in r.vector]) for r in V.image_vectors(images, Odd).collect()] == [(1, [0.6, 0.8])]
    pages = spark.createDataFrame([("s", i, c) for i, c in enumerate([b"fail", b"once", b"never", b"blank"])], "source string, page int, content binary")
    read = {r.page: r.text for r in V.transcriptions(pages, Odd).collect()}
    assert read[0] == "[第0页转录失败: gone]" and read[1] == "fine" and read[2].count("\n") == 31 and set(read) == {0, 1, 2}
    assert {r.page: r.gist for r in V.gists(pages, Odd).collect()}[0] == ""
    question = spark.createDataFrame([(1, "q", None, ["u"])], "query_id long, question string, context string, images array<string>")
    hits = spark.createDataFrame([], "query_id long, place int, source string, page int, text string, score double, image_path string")
    lines = [json.loads(r.line) for r in V.answer_events(question, hits, Odd).orderBy("seq").collect()]
    assert lines == [{"type": "sources", "sources": []}, {"type": "delta", "text": "one "}, {"type": "delta", "text": "two 1"}, {"type": "done"}]
    vectors = V.image_query_vectors(spark.createDataFrame([(1, "red valve")], "query_id long, query_text string")).first().query_vector
    assert abs(sum(v * v for v in vectors) - 1) < 1e-5


def test_summaries_of_what_left_the_window(spark):
    from folioframe.operators import services as V

    messages = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for c, n in ((1, 10), (2, 4)) for t in range(n)], "conv_id long, turn long, role string, text string")
    none = spark.createDataFrame([], "conv_id long, summary string, summary_upto long")
    assert [tuple(r) for r in V.summarised(messages, none).collect()] == [(1, "助手：m3", 4)]
    assert V.summarised(messages, spark.createDataFrame([(1, "s", 4)], "conv_id long, summary string, summary_upto long")).count() == 0
    from folioframe.operators import conversation as C

    kept = spark.createDataFrame([(1, "t", "x", 0), (2, "u", "y", 3)], "conv_id long, title string, summary string, summary_upto long")
    new = spark.createDataFrame([(1, "now", 4), (9, "lost", 1)], "conv_id long, summary string, upto long")
    assert sorted(map(tuple, C.summary_saved(kept, new).collect())) == [(1, "t", "now", 4), (2, "u", "y", 3)]


def test_ingest_without_chunks_reports_an_error(spark):
    from folioframe.operators import services as V

    empty = spark.createDataFrame([], "source string, page int")
    found = V.ingest_events(empty, empty, empty, spark.createDataFrame([], "source string, removed long"), empty).collect()
    assert [json.loads(r.line)["type"] for r in found] == ["error"]


def test_cases_in_one_form(spark):
    schema = "q string, source string, page int, pages array<int>, kind string"
    cases = spark.createDataFrame([("a", "s", 3, None, None), ("b", "s", None, [1, 2], "multi")], schema)
    assert [tuple(r) for r in E.normalised_cases(cases).collect()] == [("a", "s", "single", [3]), ("b", "s", "multi", [1, 2])]
    ranks = spark.createDataFrame([(1, 2), (2, None), (3, 1)], "case_id long, rank int")
    kinds = spark.createDataFrame([(1, "tag"), (2, "tag"), (3, None), (4, "multi")], "case_id long, kind string")
    assert sorted(map(tuple, E.kind_hits(ranks, kinds).collect())) == [("multi", 1, 0), ("single", 1, 1), ("tag", 2, 1)]
