"""Folds, splits, weights, scaling and joins."""

import pytest
from pyspark.sql import functions as F

from calorix.operators import folds as fo
from calorix.operators import samples as sa
from calorix.operators.scaling import fold_scaling_params, scaling_params, standard_scale
from tests.conftest import rows


@pytest.fixture(scope="module")
def labelled(spark):
    """One class holds most of the rows."""
    label = F.when(F.col("id") % 10 < 8, 0).when(F.col("id") % 10 == 8, 1).otherwise(2)
    return spark.range(997).withColumn("label", label)


@pytest.mark.parametrize("shuffle", [True, False])
def test_folds_are_balanced_and_complete(labelled, shuffle):
    dealt = fo.stratified_kfold(labelled, 5, shuffle=shuffle, seed=3)
    per_class = dealt.groupBy("label", "fold").count().collect()
    for label in (0, 1, 2):
        counts = [r["count"] for r in per_class if r["label"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    totals = [r["count"] for r in dealt.groupBy("fold").count().collect()]
    assert max(totals) - min(totals) <= 1
    assert rows(dealt.select("id")) == rows(labelled.select("id"))


def test_folds_repeat_with_a_seed(labelled):
    first = rows(fo.stratified_kfold(labelled, 4, seed=1))
    assert first == rows(fo.stratified_kfold(labelled.repartition(7), 4, seed=1))
    assert first != rows(fo.stratified_kfold(labelled, 4, seed=2))


def test_filtered_rows_have_no_fold(labelled):
    dealt = fo.stratified_kfold(labelled, 3, filter_cond="id < 300")
    assert dealt.where("fold IS NULL").count() == 697
    assert dealt.where("fold IS NOT NULL AND id >= 300").count() == 0


def test_existing_fold_column(labelled):
    dealt = fo.stratified_kfold(labelled, 3)
    with pytest.raises(ValueError):
        fo.stratified_kfold(dealt, 3)
    assert fo.stratified_kfold(dealt, 4, overwrite=True).agg(F.max("fold")).first()[0] == 3


def test_splits(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, -1), (4, None)], "id int, fold int")
    assert rows(fo.train_rows(df, 0).select("id")) == [(2,)]
    assert rows(fo.validation_rows(df, 0).select("id")) == [(1,)]
    assert rows(fo.study_rows(df).select("id")) == [(1,), (2,)]
    assert fo.all_splits(df.where("fold >= 0")).count() == 4
    seen = {f: (t.count(), v.count()) for f, t, v in fo.iterate_splits(df)}
    assert seen == {-1: (2, 1), 0: (2, 1), 1: (2, 1)}


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "label int")
    found = {r["label"]: r["weight"] for r in fo.class_weights(df).collect()}
    assert found == pytest.approx({0: 4 / 6, 1: 2.0})


def test_head_fraction(labelled):
    head = fo.head_fraction(labelled, ["label"], ["id"], 0.25)
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    found = {r["label"]: r["count"] for r in head.groupBy("label").count().collect()}
    assert found == {k: int(n * 0.25) for k, n in sizes.items()}
    assert head.where("label = 1").agg(F.min("id")).first()[0] == 8


def test_scaling_spreads(spark):
    df = spark.createDataFrame([(1.0, -1.0, 0), (3.0, 1.0, 1), (9.0, 5.0, 2)], "a double, b double, fold int")
    pop = scaling_params(df, "^a$").first()
    assert pop["std_a"] == pytest.approx(3.399346342395)
    part = fold_scaling_params(df, 2, ["a", "b"], absolute=["b"]).first()
    assert (part["avg_a"], part["std_a"]) == pytest.approx((2.0, 2**0.5))
    assert (part["avg_b"], part["std_b"]) == (1.0, 0.0)
    scaled = standard_scale(df, part.asDict(), ["a", "b"], absolute=["b"])
    assert scaled.where("b IS NULL").count() == 3  # a constant column has no scale


def test_numbering_happens_before_the_filter(spark):
    df = spark.createDataFrame([(5,), (1,), (3,)], "x int")
    out = sa.tag_and_filter(df, 1, ["x"], "x > 1", id_offset=10)
    assert rows(out) == [(3, 11, 1), (5, 12, 1)]


def test_pairing(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id int, label int")
    b = spark.createDataFrame([(2, 0), (3, 1)], "id int, label int")
    assert rows(sa.paired(a, b, "id", "_b", ["label"])) == [(2, 1, 0)]
    assert tuple(sa.pairing_counts(a, b, "id").first()) == (1, 1, 1)
    with pytest.raises(RuntimeError):
        sa.require_complete_pairing(a, b, "id")
    sa.require_complete_pairing(a, a, "id")


def test_sources_and_labels_must_match(spark):
    with pytest.raises(ValueError):
        sa.build_samples([], [1])


def test_write_back(spark):
    df = spark.createDataFrame([(1, 9), (2, 9)], "id int, fold int")
    update = spark.createDataFrame([(2, 0)], "id int, fold int")
    assert rows(sa.write_back(df, update, "id", "fold")) == [(1, None), (2, 0)]
