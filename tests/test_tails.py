"""p values that lie halfway between two numbers of six digits."""

from convan.functions.tails import binomial_tail
from convan.operators.evaluation import mcnemar


def test_p_between_two_numbers_is_rounded_up(spark):
    assert binomial_tail(1, 8) == 9 / 128 and binomial_tail(0, 8) == 1 / 128
    df = spark.createDataFrame([(7, 1), (1, 7), (8, 0), (0, 0)], "only_a long, only_b long")
    assert [r.p for r in mcnemar(df).collect()] == [0.070313, 0.070313, 0.007813, 1.0]
