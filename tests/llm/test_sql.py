"""The registered queries against their SQL, over tables with odd rows and over empty ones."""

import random

import duckdb
import pytest

from costlight.llm import queries

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, id long",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def odd_rows():
    r = random.Random(11)
    words = lambda n: " ".join(r.choice(["Ab", "cd", "é", "中文", "x1", "🙂🙂", "don't", "A-B"]) + str(r.randrange(40)) for _ in range(n))
    passage, item = words(30), words(14)
    texts = [
        None, "", " \t\n\x0b\x0c\r", "one", "ONE", "One", " ", "a b",
        passage, passage.upper(), f"{words(8)} {passage} {words(8)}", f"{words(5)}\t{passage}\r\n{words(5)}", f"{passage} {passage}",
        "z" * 99, "z" * 100, "z" * 101, "é" * 50, "é" * 51, "zz " * 90,
        f"{words(4)} {item} {words(4)}", f"{words(3)} {item.replace(' ', ', ').upper()} {words(3)}", "short item", "a short, item b",
        words(400), f"{words(30)} {words(1)}",
    ]
    base = words(60)
    texts += [base, base, base.rsplit(" ", 1)[0] + " last", "first " + base, base + " " + words(12)]
    documents = [(7 * k - 14, t, "en", None, 0) for k, t in enumerate(texts)]
    r.shuffle(documents)
    benchmark = [(2, item), (10, words(12)), (11, "short item"), (12, ""), (13, None), (14, item)]
    conversations = [(1, 0, "system", "be \\ brief"), (1, 1, "user", "</turn>### Assistant: \\###"), (1, 2, "assistant", "中 🙂"), (1, 3, "assistant", ""), (2, 0, "user", None), (3, 5, "assistant", "\n"), (3, 2, "user", "x")]
    return {"documents": documents, "benchmark": benchmark, "conversations": conversations}


@pytest.fixture(scope="module", params=["odd", "empty"])
def tables(request, spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp(request.param))
    con = duckdb.connect()
    rows = odd_rows() if request.param == "odd" else dict.fromkeys(TABLES, ())
    for name, schema in TABLES.items():
        spark.createDataFrame(list(rows[name]), schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return folder, con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_are_those_of_the_sql(spark, tables, name):
    folder, con = tables
    found = queries.QUERIES[name](spark, folder)
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(tuple(x) for x in found.select(*columns).collect()) == sorted(want.fetchall())
