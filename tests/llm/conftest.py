import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(Path(__file__).resolve().parent)]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs():
    """(doc_id, text) of the smallest documents table."""
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def answer(spark):
    """Rows of a registered query over the smallest tables, as dicts."""
    from tidemark.llm.queries import QUERIES

    kept = {}

    def run(name):
        if name not in kept:
            kept[name] = [r.asDict(recursive=True) for r in QUERIES[name](spark, SF).collect()]
        return kept[name]

    return run


LONG = " ".join(f"word{k % 977}x{k % 13}" for k in range(60_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, a very long text, ties, repeated rows and columns named like those that operators add."""
    copied = "the same sentence stands here again and again for the sake of a test that looks at copies " * 4
    rows = [(None, "text without an id but with some words in it", "en"), (1, None, "en"), (2, "", None), (3, " \t\n \r", "de"), (4, LONG, "en"),
            (5, copied, "en"), (5, copied, "en"), (6, copied, None), (7, "É́ 日本 🙂 \x00 <|endoftext|> a b", "fr"), (8, "one", "en")]
    extra = "kept boolean, score double, ids string, n_words string, removed string, segments string, n_shingles string, votes string, __doc string, decoded int"
    frame = spark.createDataFrame([(*r, *[None] * 10) for r in rows], f"doc_id bigint, text string, lang string, {extra}").coalesce(2)
    return frame
