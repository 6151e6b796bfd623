"""Columns of a table that are named as an operator's own keep their values."""

from palimpsest.llm import neardup


def test_keep_one_leaves_clashing_columns(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a", "x", 7), (2, text, "b", "y", 8), (3, "", "c", "z", 9), (None, text, "d", "w", 1), (4, None, "e", "v", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __own string, __id string, __body int")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted((rows[i] for i in (0, 2, 3, 4)), key=str)
    assert neardup.keep_one(docs.where("false")).collect() == []
