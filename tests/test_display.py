"""Texts as they are shown, on odd ones, against the SQL."""

import duckdb
import pytest

from tidemark.plans.queries import QUERIES, SQL

BLANKS = ["\x0b", "\r", "\r\n", "\n", "\t", "\f", " ", "\x85", "\u2028", "\u2029", "\xa0", "\x1c", "\u3000"]
TEXTS = [
    None, "", " ", "\n", "\n\n", "a\n", "a\n\n", "a\rb", "a\r\nb\r\n", "a\r", "\x0b", *(f"{b}a{b}b {b}" for b in BLANKS), *(f"a {b}" for b in BLANKS), *(f"{b} a" for b in BLANKS),
    "x" * 50, "x" * 51, "e\u0301" * 26, "\U0001f926\U0001f3fc\u200d\u2642\ufe0f" * 12, "y " * 40, "a\x0bb\n" * 30, "z\x00z", "$1 \\n",
]


@pytest.mark.parametrize("name", ["text_display", "unit_listing"])
def test_odd_texts_as_in_sql(spark, tmp_path, name):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, n_chars bigint").coalesce(1).write.parquet(path)
    want = duckdb.sql(SQL[name].replace("documents", f"read_parquet('{path}/*.parquet')"))
    found = QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: r[0])
    for w, g in zip(order(want.fetchall()), order(found), strict=True):
        assert g == w, TEXTS[w[0]]
