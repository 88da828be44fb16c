import math

import pytest
from pyspark.sql import functions as F

from protlake.functions import scalar as fn
from protlake.operators import fragments as FR


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_confidence_bins(spark):
    df = spark.createDataFrame([(49.9,), (50.0,), (69.9,), (70.0,), (90.0,)], "p double")
    assert [r[0] for r in df.select(fn.confidence_bin(F.col("p"))).collect()] == ["very_low", "low", "low", "confident", "very_high"]


@pytest.mark.parametrize("text,number,code", [("123A", 123, "A"), ("-5", -5, ""), ("", 0, ""), ("A", 0, "A"), ("12-", 12, "-"), ("A-3", -3, "A"), (" 7 ", 7, "")])
def test_residue_number_parts(spark, text, number, code):
    n, c = fn.residue_number_parts(F.lit(text))
    assert (one(spark, n), one(spark, c)) == (number, code)


@pytest.mark.parametrize("n,expected", [
    (2500, [(0, 1000), (800, 1800), (1600, 2500)]), (1000, [(0, 1000)]), (0, []), (1001, [(0, 1000), (800, 1001)]), (10, [(0, 10)])])
def test_windows(spark, n, expected):
    assert [tuple(w) for w in one(spark, fn.sequence_windows(F.lit(n), 1000, 200))] == expected


@pytest.mark.parametrize("size,overlap", [(0, 0), (10, -1), (10, 10)])
def test_window_arguments(size, overlap):
    with pytest.raises(ValueError):
        fn.sequence_windows(F.lit(5), size, overlap)


def test_secondary_structure(spark):
    got = [list(one(spark, fn.secondary_one_hot(F.lit(c)))) for c in "HET"]
    assert got == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_array_quantile(spark):
    assert one(spark, fn.array_quantile(fn.double_array([10, 1, 4, 2, 3]), 0.9)) == pytest.approx(7.6)
    assert one(spark, fn.array_quantile(fn.double_array([5]), 0.5)) == 5


def test_fragment_length_rules(spark):
    df = spark.createDataFrame([(1, 4), (None, None), (5, None), (5, 0), (9, 3)], "s int, e int")
    assert [r[0] for r in df.select(fn.fragment_length(F.col("s"), F.col("e"))).collect()] == [4, 1, 1, 1, 1]


def test_kmer_list_keeps_overlaps(spark):
    assert one(spark, fn.kmers(F.lit("ACACX"), 2)) == ["AC", "CA", "AC", "CX"]


def test_typed_value(spark):
    got = [tuple(one(spark, fn.typed_value(F.lit(t)))) for t in ("12", "-3", "0.5", "abc")]
    assert got == [(12, None, None), (-3, None, None), (None, 0.5, None), (None, None, "abc")]


def test_sigmoid_and_logit_invert(spark):
    assert one(spark, fn.sigmoid(fn.logit(F.lit(0.3)))) == pytest.approx(0.3)
    assert one(spark, fn.logit(F.lit(1.0))) == pytest.approx(math.log((1 - 1e-7) / 1e-7), rel=1e-6)


def test_base_vector_slots(spark):
    t, f = F.lit(True), F.lit(False)
    v = one(spark, fn.base_node_vector(F.lit("A"), F.lit(80.0), f, f, t, f, F.lit(5.0), F.lit(1.0), F.lit(6.0), F.lit(3), F.lit(2), F.lit(2), F.lit(4), F.lit(None)))
    assert len(v) == 32 and sum(v[:21]) == 1 and (v[21], v[24], v[29], v[30], v[31]) == (80, 1, 3, 2, 0.5)
    n = one(spark, fn.normalised_node(fn.double_array(v)))
    assert n[21] == pytest.approx(0.8) and n[29] < 3
    e = one(spark, fn.normalised_edge(fn.double_array([12, 5, 3, 1, 1, 0])))
    assert e[0] == pytest.approx(0.4) and list(e[3:]) == [1, 1, 0]


def test_unknown_residue_letter_goes_to_last_slot(spark):
    assert one(spark, fn.residue_one_hot(F.lit("b")))[20] == 1.0
    assert one(spark, fn.residue_letter(F.lit("GLY"))) == "G" and one(spark, fn.residue_letter(F.lit("QQQ"))) == "X"


def test_finite_check(spark):
    assert one(spark, fn.all_finite(fn.double_array([1, 2])))
    for bad in (float("nan"), float("inf")):
        assert not one(spark, fn.all_finite(F.array(F.lit(1.0), F.lit(bad))))


def test_distinct_errors(spark):
    assert one(spark, FR.distinct_errors(F.array(F.lit("b"), F.lit("a"), F.lit("b"), F.lit("")))) == "b | a"
    assert one(spark, FR.distinct_errors(F.array(F.lit(None).cast("string")))) is None
