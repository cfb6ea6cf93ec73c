"""Queries against their SQL on rows that the smallest tables lack."""

import duckdb
import pytest
from test_queries import canonical

from quizlake.plans.registry import ORACLE_SQL, QUERIES

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def document(n, text="Which of these rivers of the country is the longest one of all?"):
    return (n, text, "en", "web", None if text is None else len(text))


def agrees(spark, folder, name, table, rows, kinds):
    """The rows of the query, which are those of its SQL."""
    path = f"{folder}/{table}.parquet"
    spark.createDataFrame(rows, kinds).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    got, want = QUERIES[name](spark, str(folder)), con.sql(ORACLE_SQL[name])
    found = got.collect()
    assert canonical(got.columns, [tuple(r) for r in found]) == canonical(want.columns, want.fetchall())
    return found


def test_block_numbers_beyond_the_largest(spark, tmp_path):
    rows = agrees(spark, tmp_path, "c26_block_audit", "documents", [document(n) for n in (0, 1, 9998, *range(9999, 10010), 20012)], DOCUMENTS)
    assert len(rows) == 15


def test_pages_of_block_numbers_beyond_the_largest(spark, tmp_path):
    agrees(spark, tmp_path, "a34_page_readiness", "documents", [document(n) for n in (0, 1, 9998, *range(9999, 10010), 20012)], DOCUMENTS)


TITLES = ["Éçé Éçé", "", "to.", "É b c", "Rivers and lakes", "Í, Í, Í", "abcd", "A long title " * 12]
PAGE = '<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>{}</title></head><body><h1>{}</h1><p>A sentence of more than twenty characters.</p></body></html>'


def test_question_pages_with_short_titles(spark, tmp_path):
    pages = [(n, "https://example.org", PAGE.format(x, x)) for i, x in enumerate(TITLES) for n in range(42 * i, 42 * i + 42)]
    rows = agrees(spark, tmp_path, "s7_question_pages", "pages", pages, "page_id long, url string, html string")
    assert {"What is meant by ", "What is meant by to", "What is meant by b c"} < {r.question_text for r in rows if r.page_id % 6 == 2}


@pytest.mark.parametrize("text", ["the coded papera setañta codec", "Set A", "the booklet", "d of the paper code - D version:b", "", "...", None])
def test_paper_set_behind_words_that_end_in_a_mark(spark, tmp_path, text):
    agrees(spark, tmp_path, "x27_paper_set", "documents", [document(n, text) for n in range(16)], DOCUMENTS)


def test_page_kinds_around_the_limits(spark, tmp_path):
    lengths = [(2, 20, 36), (1, 130, 160), (9, 240, 290)]  # words, least and most letters
    texts = [" ".join(["a"] * (words - 1) + ["b" * n]) for words, low, high in lengths for n in range(low, high)]
    agrees(spark, tmp_path, "x30_page_kinds", "documents", [document(7 * i + 3, x) for i, x in enumerate(texts)], DOCUMENTS)
