"""Problem 3."""

import json

from pyspark.sql import functions as F

from pagequarry.llm import records

A = "Name: Blue Pump\nOwner: Ada of Riga\nNote: v 2.5"
ROWS = [
    (1, A), (2, "NOTE:\tV 2.5;\n* owner = ada of riga;\n* Name - blue pump;"), (3, json.dumps({"Owner": "Ada of Riga", "Name": "Blue Pump", "Note": "v 2.5"})), (4, "name blue pump owner ada of riga note v 25"),
    (5, "Name: Ada of Riga\nOwner: Blue Pump\nNote: v 2.5"), (6, "Straße eins"), (7, "STRASSE EINS!"), (8, None), (9, ""), (10, "-- \n"), (11, "Straße zwei"), (12, "k: 1\nk: 1\nm: 2"), (13, "k: 1\nm: 2\nm: 2"),
    (14, "{not json"), (15, "not json"), (16, "x" * 200_000), (17, "X" * 200_000), (18, '{"a": null, "b": "1"}'), (19, "b=1\na="),
]


def groups(pairs):
    out = {}
    for r in pairs.collect():
        out.setdefault(r.first_row_id, set()).add(r.row_id)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, text string")


def test_pairs(spark):
    got = groups(records.pairs(frame(spark, ROWS)))
    assert got == {1: {2, 3, 4}, 6: {7}, 14: {15}, 16: {17}, 18: {19}}


def test_copies(spark):
    got = {r.record_id: r.copies for r in records.collapse(frame(spark, ROWS)).collect()}
    assert got[1] == 4 and got[5] == got[8] == got[9] == got[10] == 1 and sum(got.values()) == len(ROWS)


def test_torn_letters(spark):
    # The same letters in order, cut into fields in two ways: one record, and with it the reorderings of either.
    rows = [(1, "a: bc\nd: e"), (2, "ab: c\nd: e"), (3, "d: e\na: bc"), (4, "d: e\nab: c"), (5, "abcde")]
    assert groups(records.pairs(frame(spark, rows))) == {1: {2, 3, 4, 5}}


def test_empty_repeated_and_other_columns(spark):
    assert records.pairs(frame(spark, [])).count() == 0 and records.collapse(frame(spark, [])).count() == 0
    twice = frame(spark, [(1, A), (1, A), (2, A)]).withColumn("group", F.lit(1)).withColumn("print", F.lit("x")).withColumn("base", F.lit(2))
    assert groups(records.pairs(twice)) == {1: {2}}
    assert records.collapse(twice).first().copies == 3


def test_hot_record(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "Same: text").otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    assert groups(records.pairs(df)) == {0: set(range(3, 3000, 3))}


def test_long_names_and_many_fields(spark):
    name = "a field with a very long name " * 4
    many = [f"name {k}: value {k}" for k in range(30_000)]
    rows = [(1, f"{name}: 1\nb: 2"), (2, f"b = 2\n{name} = 1"), (3, "\n".join(many)), (4, "\n".join(reversed(many))), (5, "\n".join([*many, "name 0: value 0"])), (6, "\n".join(["name 0: value 0", *reversed(many)])), (7, "\n".join([*many, "name 1: value 1"]))]
    assert groups(records.pairs(frame(spark, rows))) == {1: {2}, 3: {4}, 5: {6}}


def test_equality_is_checked(spark, monkeypatch):
    """Rows whose sums agree and whose fields do not are no record."""
    monkeypatch.setattr(records, "_lane", lambda digests, k: F.lit(1).cast("long"))
    rows = [(1, "a: 1\nb: 2"), (2, "b: 2\na: 1"), (3, "a: 3\nb: 4"), (4, "A = 3\nB = 4"), (5, "a: 1\na: 1"), (6, "a: 1\nb: 1")]
    assert groups(records.pairs(frame(spark, rows))) == {1: {2}, 3: {4}}


def test_chain_of_torn_letters(spark):
    """Records linked by letters, by fields, by letters and so on are one, however long the chain."""
    cuts = ["a: bcd\nx: y", "ab: cd\nx: y", "abc: d\nx: y"]
    rows = [(k, c) for k, c in enumerate(cuts)] + [(10 + k, "\n".join(reversed(c.split("\n")))) for k, c in enumerate(cuts)]
    assert groups(records.pairs(frame(spark, rows))) == {0: {1, 2, 10, 11, 12}}
