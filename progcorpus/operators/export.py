"""S6 ``repair_manifest``: the per-question export of a corpus for a repair
tool, as one table ``question_id, func_name, rel_path, content``.

The reference writes one folder per question by re-filtering the whole frame
for every question; here all file kinds are built in one pass and unioned, and
the writer partitions by question.  Numbering (W1-W3) uses the skew-safe
row numbering, never a window over all submissions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progcorpus.functions.testspec import fill as _fill
from progcorpus.functions.testspec import three_digits
from progcorpus.operators.ordering import group_row_number

MANIFEST_COLS = ["question_id", "func_name", "rel_path", "content"]

# The export's folder and file names ({q} = 1-based question
# number, {nnn} = zero-padded program or test-case number).
QUESTION_DIR = "question_{q}"
FUNC_NAME_FILE = "func_name.txt"
DESCRIPTION_FILE = "description.txt"
INPUT_FILE = "ans/input_{nnn}.txt"
OUTPUT_FILE = "ans/output_{nnn}.txt"
CORRECT_FILE = "code/correct/correct_{q}_{nnn}.py"
WRONG_FILE = "code/wrong/wrong_{q}_{nnn}.py"
REFERENCE_FILE = "code/reference/reference.py"
GLOBALS_FILE = "code/global.py"
METADATA_FILE = "code/metadata"


def program_numbers(df: DataFrame, order_col: str = "sub_id") -> DataFrame:
    """``sub_id, func_name, correct, program_no`` (1-based per question and
    verdict), from ids alone."""
    base = df.where(F.col("func_name").isNotNull() & F.col("correct").isNotNull()).select(order_col, "func_name", "correct")
    return group_row_number(base, ["func_name", "correct"], [F.col(order_col).asc()], name="program_no")


def program_files(df: DataFrame, qnum: DataFrame, order_col: str = "sub_id",
                  code_col: str = "func_code") -> DataFrame:
    """``code/correct/correct_{q}_{nnn}.py`` and ``code/wrong/wrong_{q}_{nnn}.py``.
    Ids are numbered; the programs' texts move once, in the join by row id."""
    texts = df.select(order_col, F.col(code_col).alias("_text"))
    numbered = (program_numbers(df, order_col).join(qnum, on="func_name", how="inner")
                .join(texts, on=order_col, how="inner"))
    parts = dict(q=F.col("question_no").cast("string"), nnn=three_digits("program_no"))
    path = F.when(F.col("correct"), _fill(CORRECT_FILE, **parts)).otherwise(_fill(WRONG_FILE, **parts))
    return numbered.select(F.col("question_no"), "func_name", path.alias("rel_path"),
                           F.col("_text").alias("content"))


def repair_manifest(df: DataFrame, order_col: str = "sub_id", code_col: str = "func_code") -> DataFrame:
    """Two passes over the submissions: one aggregation gives every
    per-question fact (first description, first correct program, first tested
    row's test string; a small table, one row per question, from which the
    question numbers, test files and preludes are derived), and the skew-safe
    numbering of all programs gives their files."""
    from progcorpus.functions.testspec import split_call_asserts, test_prelude
    from progcorpus.operators.sampling import first_per_question
    from progcorpus.session import materialize

    per_q = materialize(first_per_question(df.where(F.col("func_name").isNotNull()), "func_name", order_col, code_col))
    qnum = group_row_number(per_q.select("func_name"), [], [F.col("func_name").asc()], name="question_no")
    per_q = per_q.join(qnum, on="func_name", how="inner")

    single = per_q.select("question_no", "func_name", F.explode(F.array(
        F.struct(F.lit(FUNC_NAME_FILE).alias("rel_path"), F.col("func_name").alias("content")),
        F.struct(F.lit(DESCRIPTION_FILE).alias("rel_path"), F.col("description").alias("content")),
        F.struct(F.lit(METADATA_FILE).alias("rel_path"), F.col("func_name").alias("content")),
        F.struct(F.lit(REFERENCE_FILE).alias("rel_path"), F.col("reference_code").alias("content")),
    )).alias("f")).select("question_no", "func_name", "f.rel_path", "f.content")

    cases = per_q.select("question_no", "func_name", F.inline(split_call_asserts("first_test")))
    nnn = three_digits("case_no")
    case_files = cases.select("question_no", "func_name", F.explode(F.array(
        F.struct(_fill(INPUT_FILE, nnn=nnn).alias("rel_path"), F.col("input").alias("content")),
        F.struct(_fill(OUTPUT_FILE, nnn=nnn).alias("rel_path"), F.col("expected").alias("content")),
    )).alias("f")).select("question_no", "func_name", "f.rel_path", "f.content")

    # The prelude itself goes to global.py (the reference writes a program there)
    prelude = (per_q.select("question_no", "func_name", F.lit(GLOBALS_FILE).alias("rel_path"),
                            test_prelude("first_test").alias("content"))
               .where(F.col("content") != ""))

    programs = program_files(df, qnum.select("func_name", "question_no"), order_col, code_col)
    out = single.unionByName(case_files).unionByName(prelude).unionByName(programs)
    return (out.where(F.col("content").isNotNull())          # D32: no file for null content
            .select(_fill(QUESTION_DIR, q=F.col("question_no").cast("string")).alias("question_id"),
                    "func_name", "rel_path", "content"))


def write_manifest(manifest: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write the manifest partitioned by question (one folder per question).

    Rows are range-partitioned on ``(question_id, rel_path)`` first: each
    task writes a contiguous slice, so a question's files land in few
    output files, and a question holding a third of the corpus is written by
    many tasks instead of one."""
    (manifest.repartitionByRange("question_id", "rel_path").write.mode(mode).partitionBy("question_id")
     .format(fmt).save(path))
