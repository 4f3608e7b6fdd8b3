"""Every registered query that SQL can express gives the rows and types of its SQL on an independent engine."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.llm import queries as registered

QUERIES, ORACLES = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return con


def sorted_rows(table):
    names = sorted(table.column_names)
    found = [tuple(row[n] for n in names) for row in table.to_pylist()]
    return sorted(found, key=lambda r: [(v is not None, v if not isinstance(v, float) else round(v, 9)) for v in r])


def same(a, b):
    """Equal, doubles up to the last places: the two engines add products in different orders."""
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12))


def types(schema):
    return {f.name: str(f.type).replace("large_", "") for f in schema}


def test_only_registered_queries_have_sql():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, sf_dir, duck):
    found = QUERIES[name](spark, sf_dir).toArrow()
    wanted = duck.sql(ORACLES[name]).to_arrow_table()
    assert types(found.schema) == types(wanted.schema)
    ours, theirs = sorted_rows(found), sorted_rows(wanted)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(map(same, a, b)), (a, b)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Small tables with nulls, empty and odd texts, ties and vectors that take no part."""
    path = tmp_path_factory.mktemp("awkward")
    phrase = "One two three four five six seven eight nine ten eleven"
    texts = [
        None, "", " \t\n", "word", "A b C d e f", "a B c D e f", phrase, phrase + " twelve", "x " * 3 + phrase, "é ü " * 9,
        "password: abcdefg token=short API_KEY = 'Zz9+/_.=-'", "😀 secret=abcdefg " + "AKIA" + "Q7" * 9, "0123456789abcdef" * 2 + "😀" + "a" * 23,
        "PassWord:=abcdef, ſecret=abcdefgh", "sk-" + "a1" * 12, "sk-" + "a1" * 12, "Bearer  " + "Zx9" * 8, "K" * 5 + " apI_Key:abcdef", phrase,
    ]
    sources = ["b", "a", None, "ä", "b", "c"]
    docs = [(i, t, "en", sources[i % 6], 0) for i, t in enumerate(texts)]
    items = [(1, phrase.upper()), (2, "ten eleven"), (10, None), (11, ""), (12, "absent words"), (13, "ten eleven"), (None, phrase)]
    pages = [(1, "u", None), (2, "u", "é" * 50), (3, None, "é" * 50), (4, "u", "x" * 99), (5, "u", "x" * 99), (6, "u", "")]
    nan = float("nan")
    vectors = [None, [], [0.0, 0.0], [1.0, nan], [1.0, None], [1.0, 2.0], [1.0, 2.0], [-1.0, 0.5], [3.0, 0.1, 0.2], [0.3, 0.3, 0.3]]
    embeddings = [(20 * i if i % 2 else i, v, "l") for i, v in enumerate(vectors)] + [(None, [1.0, 1.0], "l")]
    turns = [
        (1, 0, "user", None), (1, 1, "assistant", r"a\b<turn role=x></turn>"), (2, 0, None, "x"), (2, 1, "a>s\\", "😀"), (3, 1, "assistant", "b"),
        (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, None, "user", "</turn"), (4, 0, "assistant", ""), (None, 0, "assistant", "n"),
    ]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": (items, "item_id long, text string"), "pages": (pages, "page_id long, url string, html string"),
        "embeddings": (embeddings, "vec_id long, embedding array<double>, label string"),
        "conversations": (turns, "conv_id long, turn long, role string, text string"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_awkward_rows(name, spark, awkward):
    path, con = awkward
    test_query(name, spark, path, con)
