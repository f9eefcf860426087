"""Stages of the pipeline on rows that share ids, names or passages."""

import pytest

import corpus_pipeline as cp
from tests.llm.data import SCHEMA, edited, words


def frame(spark, rows, extra=()):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {n} string" for n in extra)
    data = [(i, t, "en", "s", None if t is None else len(t), *["clash"] * len(extra)) for i, t in rows]
    return spark.createDataFrame(data, schema).repartition(3)


def test_rows_of_one_id_are_judged_each_for_itself(spark):
    a, b, c = (" ".join(words(k, 60)) for k in "abc")
    rows = [(5, a), (5, b), (3, edited(a, 200, 1)), (7, a), (7, a), (8, c), (8, c), (None, b), (None, "x y z"), (9, ""), (9, "")]
    left = cp.near_duplicates(spark, frame(spark, rows, ["k", "row", "rows", "component_id"]), "")
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr)
    expected = [(5, b), (3, edited(a, 200, 1)), (8, c), (None, "x y z"), (9, ""), (9, "")]
    assert got == sorted(expected, key=repr)
    assert left.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_many_equal_rows_leave_one(spark):
    rows = [(1, "one two three four five six")] * 200 + [(k, "one two three four five six") for k in range(2, 50)]
    assert [r["doc_id"] for r in cp.near_duplicates(spark, frame(spark, rows), "").collect()] == [1]


@pytest.mark.parametrize(("size", "goes"), [(20, False), (51, True), (60, True), (120, True)])
def test_passages_of_over_fifty_words_go(spark, size, goes):
    passage = " ".join(words(f"p{size}", size))
    rows = [(k, " ".join(words(f"left{k}", 70)) + " " + passage + " " + " ".join(words(f"right{k}", 70))) for k in range(6)]
    rows += [(10, " ".join(words("clean", 150))), (11, None), (12, "")]
    left = {r["doc_id"]: r for r in cp.repeated_strings(spark, frame(spark, rows, ["_was_null", "was_null", "own", "kept"]), "").collect()}
    for k in range(6):
        assert (passage not in left[k]["text"]) == goes
        assert left[k]["text"].startswith(" ".join(words(f"left{k}", 70)[:69]))
        assert left[k]["n_chars"] == len(left[k]["text"])
        assert left[k]["_was_null"] == "clash"
    assert left[10]["text"] == rows[6][1] and left[11]["text"] is None and left[12]["text"] == ""


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cp.near_duplicates(spark, none, "").count() == 0
    assert cp.repeated_strings(spark, none, "").count() == 0
