"""Corpus sampling: length outliers, modal text, percentage heads,
reference solutions, first rows per question (A1, A2, A4, W1, W4, W5, W7).

Per-group statistics are plain aggregations (partial aggregation before the
shuffle), joined back to the rows; adaptive execution broadcasts the statistic
side when its measured size is small and splits skewed join partitions
otherwise.  No window is ever partitioned by a group of submissions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progcorpus.functions.lines import line_count
from progcorpus.operators.ordering import group_median, group_row_number
from progcorpus.session import materialize


def _keys(group) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def with_line_count(df: DataFrame, code_col: str = "func_code", out: str = "n_lines") -> DataFrame:
    """``n_lines`` per row (F1)."""
    return df.withColumn(out, line_count(code_col))


def mad_outliers(df: DataFrame, group, code_col: str = "func_code",
                 threshold: float = 2.5) -> DataFrame:
    """A2: keep rows with ``(n_lines - median) / MAD <= threshold`` inside
    their group; a group whose MAD is 0 keeps every row.  One-sided, raw MAD
    (no 1.4826 factor).  Output = input columns without index artefacts, plus
    ``n_lines``.

    One pass over the rows builds each group's histogram of line counts
    (partially aggregated, so a hot group costs one row per distinct count).
    Median and MAD are exact: each is selected by rank from running sums over
    the range-partitioned histogram, so no group is gathered anywhere; a second
    pass filters the rows against the small per-group statistics."""
    from progcorpus.operators.columns import drop_index_columns

    keys = _keys(group)
    rows = with_line_count(drop_index_columns(df), code_col)
    hist = materialize(rows.groupBy(*keys, F.col("n_lines").cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    med = group_median(hist, keys, "_v", "_c", "_med")
    dev = (hist.join(med, on=keys, how="inner").groupBy(*keys, F.abs(F.col("_v") - F.col("_med")).alias("_d"))
           .agg(F.sum("_c").alias("_c")))
    stats = med.join(group_median(dev, keys, "_d", "_c", "_mad"), on=keys, how="inner")
    kept = rows.join(stats, on=keys, how="left").where(
        (F.col("_mad") == 0) | ((F.col("n_lines") - F.col("_med")) / F.col("_mad") <= F.lit(threshold)))
    return kept.drop("_med", "_mad")


def modal_keys(df: DataFrame, group, text_key, order_col: str = "sub_id") -> DataFrame:
    """Per group the most frequent value of ``text_key`` (an id or hash of the
    text; ties go to the one seen first): ``group..., modal_key, modal_count,
    first`` with ``first`` the least ``order_col`` of the rows that hold it.
    Only ids and counts are aggregated."""
    keys = _keys(group)
    counts = df.select(*keys, text_key.alias("_key"), F.col(order_col).alias("_order")).groupBy(*keys, "_key").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_first"))
    best = F.min(F.struct((-F.col("_n")).alias("neg"), F.col("_first").alias("first"), F.col("_key").alias("key")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.key").alias("modal_key"), (-F.col("_b.neg")).cast("long").alias("modal_count"),
        F.col("_b.first").alias("first"))


def modal_program(df: DataFrame, group, code_col: str = "func_code",
                  order_col: str = "sub_id") -> DataFrame:
    """A1: per group, the most frequent text; ties
    go to the text seen first under ``order_col`` (which must be unique).
    Output ``group..., modal_code, modal_count``.  Texts are counted by their
    SHA-256; the winners' texts are fetched by row id at the end."""
    best = modal_keys(df, group, F.sha2(F.col(code_col), 256), order_col)
    texts = df.select(F.col(order_col).alias("first"), F.col(code_col).alias("modal_code"))
    return best.join(texts, on="first", how="inner").select(*_keys(group), "modal_code", "modal_count")


def head_percent(df: DataFrame, percentage, group, order_col: str = "sub_id") -> DataFrame:
    """The first ``ceil(n * p / 100)`` rows of each group in ``order_col``
    order (D12: floats are accepted as percentages); ``percentage`` must be a
    positive number (``keep_percentage`` takes the other cases).

    Only the narrow ``(group, order_col)`` projection is numbered (skew-safe,
    see ``ordering``); the row at position ``ceil(n * p / 100)`` gives each
    group's cutoff, a table with one row per group, and the full rows are
    filtered against it.  ``order_col`` must be unique."""
    if isinstance(percentage, bool) or not isinstance(percentage, (int, float)) or percentage <= 0:
        raise ValueError(f"not a positive percentage: {percentage!r}")
    keys = _keys(group)
    known = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        known = known & F.col(k).isNotNull()
    narrow = df.select(*keys, order_col).where(known)     # null groups drop out, as in a pandas groupby
    sizes = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    numbered = group_row_number(narrow, keys, [F.col(order_col).asc()], name="_rn")
    # ceil(n * (p / 100)) in the same float arithmetic as the reference
    cut = (numbered.join(sizes, on=keys, how="inner")
           .where(F.col("_rn") == F.least(F.col("_n"), F.ceil(F.col("_n") * F.lit(float(percentage) / 100.0))))
           .select(*keys, F.col(order_col).alias("_cut")))
    return df.join(cut, on=keys, how="inner").where(F.col(order_col) <= F.col("_cut")).drop("_cut")


def keep_percentage(df: DataFrame, percentage, group, code_col: str = "func_code", order_col: str = "sub_id",
                    ref_sol_col: str | None = None) -> DataFrame:
    """W4 and W5 behind one call: a positive number keeps the head of each group
    (``head_percent``), ``0`` or ``"ref_sol"`` its reference solution
    (``reference_solution``), anything else every row.  Rows without a group drop
    out in each case."""
    df = df.dropna(subset=_keys(group))
    if not isinstance(percentage, bool):
        if percentage in (0, "ref_sol"):
            return reference_solution(df, group, code_col, order_col, ref_sol_col)
        if isinstance(percentage, (int, float)) and percentage > 0:
            return head_percent(df, percentage, group, order_col)
    return df


def reference_solution(df: DataFrame, group, code_col: str = "func_code",
                       order_col: str = "sub_id", ref_sol_col: str | None = None) -> DataFrame:
    """One full row per group,
    the first flagged row when a flag column is given (groups without a flagged
    row give none), else the first row carrying the group's modal text."""
    keys = _keys(group)
    if ref_sol_col:
        first = df.where(F.col(ref_sol_col)).groupBy(*keys).agg(F.min(order_col).alias("first"))
    else:
        first = modal_keys(df.dropna(subset=keys), keys, F.sha2(F.col(code_col), 256), order_col)
    return df.join(first.select(F.col("first").alias(order_col)), on=order_col, how="left_semi")


def first_per_question(df: DataFrame, group: str = "func_name", order_col: str = "sub_id",
                       code_col: str = "func_code") -> DataFrame:
    """Per question, the first description, the first tested row's test
    string, and the first correct program (the export's reference)."""
    order = F.col(order_col)
    tested = F.col("test").isNotNull() & (F.col("test") != "")
    # the rows wanted, by id; their texts are fetched afterwards
    ids = df.groupBy(group).agg(F.min(order).alias("d"), F.min(F.when(tested, order)).alias("t"),
                                F.min(F.when(F.col("correct"), order)).alias("c"))
    wanted = ids.select(group, F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("_row")) for k in "dtc"])).alias("_w")).select(
        group, "_w.kind", "_w._row")
    texts = df.select(order.alias("_row"), "description", "test", F.col(code_col).alias("_code"))
    found = wanted.join(texts, on="_row", how="inner")

    def of(kind, col):
        return F.max(F.when(F.col("kind") == kind, F.col(col)))

    return found.groupBy(group).agg(of("d", "description").alias("description"), of("t", "test").alias("first_test"),
                                    of("c", "_code").alias("reference_code"))


def question_list(df: DataFrame, group: str = "func_name") -> DataFrame:
    """A4 ``sorted(unique())``: distinct questions in code-point order."""
    return df.select(group).distinct().orderBy(group)


def question_numbers(df: DataFrame, group: str = "func_name") -> DataFrame:
    """1-based number of each question in sorted order, computed over the
    distinct questions only (never a global window over submissions)."""
    distinct = df.select(group).where(F.col(group).isNotNull()).distinct()
    return group_row_number(distinct, [], [F.col(group).asc()], name="question_no") \
        .withColumn("question_no", F.col("question_no").cast("long"))
