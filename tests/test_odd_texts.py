"""Named queries over documents with empty texts, missing texts and breaks of every kind."""

import duckdb

import __spark_entry__ as entry_point

LINES = {
    "": (0, 0, None, None),
    None: (None, None, None, None),
    "\n": (1, 1, "", ""),
    "\n\n": (2, 2, "", ""),
    " ": (1, 1, " ", " "),
    "a": (1, 1, "a", "a"),
    "a\nb\n": (2, 2, "a", "b"),
    "a\n\n": (2, 2, "a", ""),
    "\nb": (2, 2, "", "b"),
}
CARRIAGE_RETURNS = {"\r\n": (1, 1, "", ""), "\r": (1, 1, "", ""), "a\r\nb\rc\n": (3, 3, "a", "c")}


def split(spark, folder, texts):
    rows = [(k, text) for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, entry_point.queries()["f1_split_lines"](spark, str(folder)).collect()))


def test_lines_of_odd_texts(spark, tmp_path):
    expected = LINES | CARRIAGE_RETURNS
    assert split(spark, tmp_path, expected) == [(k, *row) for k, row in enumerate(expected.values())]


def test_lines_of_empty_texts_as_in_sql(spark, tmp_path):
    found = split(spark, tmp_path, LINES)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(entry_point.oracle_sql()["f1_split_lines"]).fetchall()) == found
