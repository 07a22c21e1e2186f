"""Verdicts and pass rates (J9, A9) and the verdict filters.

Test outcomes are an input table (programs are never executed here).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_tested(test_col: str = "test") -> Column:
    """P5: ``df.test.astype(bool)`` with null meaning untested."""
    return F.col(test_col).isNotNull() & (F.col(test_col) != "")


def tested_rows(df: DataFrame, test_col: str = "test") -> DataFrame:
    return df.where(is_tested(test_col))


def programs_by_verdict(df: DataFrame, func_name: str, correct: bool,
                        code_col: str = "func_code") -> DataFrame:
    """The programs of one question with one verdict."""
    return df.where((F.col("func_name") == func_name) & (F.col("correct") == F.lit(correct)))


def grade_submissions(subs: DataFrame, observed: DataFrame, key: str = "sub_id",
                      code_col: str = "func_code", out: str = "correct") -> DataFrame:
    """verdict = non-empty program AND every observed
    case passed; a program without outcomes is not correct.

    Outcomes are pre-aggregated per program before the join, so a program with
    a huge number of outcome rows never lands whole on one task.
    """
    per_sub = observed.groupBy(key).agg(F.bool_and("passed").alias("_all_passed"))
    joined = subs.drop(out) if out in subs.columns else subs
    return (joined.join(per_sub, on=key, how="left")
            .withColumn(out, F.coalesce(F.col("_all_passed"), F.lit(False))
                        & F.coalesce(F.length(code_col) > 0, F.lit(False)))
            .drop("_all_passed"))


def pass_rate(graded: DataFrame, group: str = "func_name", verdict: str = "correct") -> DataFrame:
    """A9 pass@1 per question = share of correct programs."""
    return graded.groupBy(group).agg(
        F.avg(F.col(verdict).cast("double")).alias("pass_at_1"),
        F.count(F.lit(1)).alias("n_programs"))
