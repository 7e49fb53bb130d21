"""Registered queries against their oracles, over texts that the driver's small tables lack."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_oracles import rows

from folioframe.plans import registry

TEXTS = [
    "éab12 ab12é cd34éf ñ77 _x5 x5_", "straße9 ß9 ﬁ7 ſ7 ı8", "tag\t12 tag\x0b12 tag\n12 tag 12 tag\xa012", "k1-ø_ k1-ø9x3.05 p-101 gva11-0889é",
    "K1-.5 é1 ÉRQUE25 ab1234567 abcdefg1", "p-101 p-1013 a-01 a-012", "ab12 éab13", "dn100", "", None, "éab12", "straße9 p-101",
]


@pytest.fixture(scope="module")
def odd_dir(tmp_path_factory):
    """Every text in several documents, so that pages have tags of several runs."""
    texts = TEXTS * 6
    folder = tmp_path_factory.mktemp("odd")
    columns = {"doc_id": pa.array(range(len(texts)), pa.int64()), "source": [f"src{i % 2}" for i in range(len(texts))], "text": texts}
    pq.write_table(pa.table(columns), f"{folder}/documents.parquet")
    return str(folder)


def check(spark, folder, name, *tables):
    con = duckdb.connect()
    for table in tables:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df, oracle = registry.QUERIES[name](spark, folder), con.sql(registry.ORACLE_SQL[name])
    wanted = rows(oracle.columns, oracle.fetchall())
    assert wanted and rows(df.columns, df.collect()) == wanted


@pytest.mark.parametrize("name", ["tag_extraction", "tag_votes", "vote_totals", "normalize_tags", "diagram_chunk_text", "page_tags"])
def test_tags_of_odd_texts(spark, odd_dir, name):
    check(spark, odd_dir, name, "documents")


def test_votes_of_normalised_tags_of_all_runs(spark, tmp_path):
    """Tags are normalised within a run before they vote, runs without tags count, and so do pages without a source."""
    texts = [(1, "s", "gva11-088.9x3.05 p-10 p-101 note2"), (8, "s", "gva11-ø88.9x3.05 p-10"), (15, "s", None), (3, "s", "x1 dn100"), (10, "s", "no tag"), (17, "s", "")]
    texts += [(2, None, "x1"), (9, None, "none"), (4, None, "x1 x12"), (11, None, "x12"), (5, "", "y1"), (5, None, "y1"), (12, None, "")]
    ids, sources, words = zip(*texts, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "source": sources, "text": words}), f"{tmp_path}/documents.parquet")
    check(spark, str(tmp_path), "tag_votes", "documents")
    found = registry.QUERIES["tag_votes"](spark, str(tmp_path)).where("source IS NULL OR source <> 'fixture'").collect()
    assert {(r.source, r.page, r.tag, r.votes, r.stable) for r in found} == {
        ("s", 1, "GVA11-Ø88.9X3.05", 2, True), ("s", 1, "P-101", 1, False), ("s", 1, "P-10", 1, False), ("s", 3, "X1", 1, False),
        (None, 2, "X1", 1, False), (None, 4, "X12", 2, True), ("", 5, "Y1", 1, True), (None, 5, "Y1", 1, False),
    }
    assert len(found) == 8


def test_pages_whose_readings_are_no_tags(spark, tmp_path):
    columns = {"doc_id": pa.array([1, 2, 3], pa.int64()), "source": ["s", "s", None], "text": ["dn100", "note7 p-101", "fig2"]}
    pq.write_table(pa.table(columns), f"{tmp_path}/documents.parquet")
    check(spark, str(tmp_path), "page_tags", "documents")


def test_summaries_of_odd_texts(spark, tmp_path):
    ends = ["x" * 116 + "\n tail", "x" * 115 + " \nab", "x" * 116 + "\ttail", "x" * 116 + " tail", "x" * 116 + "\xa0 tail", "a\n\n\nb", "a\n\n", "a\n\n　b \n", "", "\n\n\n"]
    made = [(c, t, ("user", "assistant")[t % 2], end if t == 1 else f"before\n{end}\n" if t == 0 else "m") for c, end in enumerate(ends, 10) for t in range(8)]
    ids, turns, roles, texts = zip(*made, strict=True)
    columns = {"conv_id": pa.array(ids, pa.int64()), "turn": pa.array(turns, pa.int64()), "role": roles, "text": texts}
    pq.write_table(pa.table(columns), f"{tmp_path}/conversations.parquet")
    check(spark, str(tmp_path), "session_summaries", "conversations")
