"""Program tables derived from the driver tables.

The driver tables carry no program text, so the corpus views are built from
them with expressions that both Spark and DuckDB evaluate: ``submissions``
from ``orders``, ``observed`` test outcomes from ``lineitem``, LLM-style
``completions`` from ``part``.  These builders only shape input rows; every
operator of the library runs on them through its own code.

The template id ``v`` exists only on the SQL side so that oracles can state
expected values per template.  The Spark views do not carry it, so no operator
can read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from progcorpus.sources.tables import read_table

# ---------------------------------------------------------------------------
# The twenty program templates of FIXTURES.md §3.  ``{f}`` is
# replaced by the question's function name.
# ---------------------------------------------------------------------------
TEMPLATES: list[str] = [
    "def {f}(a, b):\n    c = a + b\n    return c",
    "def {f}(x, y):\n    total = x + y\n    return total",
    "def {f}(a, b):\n    return a + b",
    'def {f}(a, b):\n    """Add two numbers."""\n    # add\n    c = a + b\n    return c',
    "def helper(u):\n    return u ** 2\n\ndef {f}(a, b):\n    return helper(a) // b",
    "def {f}(a, b):\n    def inner(k):\n        return k - b\n    return inner(a)",
    "def {f}(a, b)\n    return a + b",
    "def {f}(a, b):\nreturn a + b",
    "def {f}(a, b:\n    return (a + b",
    "def {f}(a, b): return a + b",
    "def {f}(a, b):\n    return a\ndef {f}(a, b):\n    return b",
    'def {f}(items, limit):\n    out = []\n    for it in items:\n'
    '        if it <= limit and it != 0:\n            out.append(it)\n'
    '    s = "items"\n    return out',
    "def other(a, b):\n    return a + b",
    "\n\ndef {f}(a, b):\r\n    return a * b\r\n",
    "",
    "def {f}(a, b):\n" + "    a = a + 1\n" * 30 + "    return a",
    'def helper(a):\n    return a\n\ndef {f}(a, b):\n    return f"{helper(a)}#{d["#k"]}"',
    'def helper(a):\n    return a\n\ndef {f}(x, a):\n    return f"{helper(x)}#{d["#k"]}"',
    "def helper():\n    return max(1, 2)\n\ndef {f}(max):\n    return helper()",
    "def helper():\n    return min(1, 2)\n\ndef {f}(min):\n    return helper()",
]
# Remainders of a row's number by 150 that have a template of their
# own; all others have the template of the remainder by 15.
RARE = {14: 15, 29: 16, 44: 17, 59: 18, 74: 19}
# The test string of every tested question, and the prelude of
# question task_9.
TEST_TEMPLATE = "assert {f}(1, 2) == 3 and {f}(2, 2) == 4"
TASK9_PRELUDE = "OFFSET = 1\n"
COMPLETION_HEADER = "<| file ext=.py |>\n# generated\n"


def _question(row: str, owner: str) -> Column:
    """Name of a row's question: ten questions share a third of the rows (their
    programs are copies of each other), the other questions have one owner each,
    so questions and distinct programs grow with the data."""
    return F.concat(F.lit("task_"), F.when(F.col(row) % 3 == 0, F.col(owner) % 10)
                    .otherwise(F.col(owner) + 10).cast("string"))


def _sql_question(row: str, owner: str) -> str:
    return f"'task_' || CAST(CASE WHEN {row} % 3 = 0 THEN {owner} % 10 ELSE {owner} + 10 END AS VARCHAR)"


def _template_col(v: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), v + 1)


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sub_id, func_name, func_code, description, test, correct, ref_sol``."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    func_name = _question("o_orderkey", "o_custkey")
    v = F.col("o_orderkey") % 15
    for rest, template in RARE.items():
        v = F.when(F.col("o_orderkey") % 150 == rest, F.lit(template)).otherwise(v)
    test = F.when((F.col("func_name") == "task_8") | (F.col("sub_id") % 4 == 0), F.lit(None)) \
        .otherwise(F.concat(F.when(F.col("func_name") == "task_9", F.lit(TASK9_PRELUDE)).otherwise(F.lit("")),
                            F.replace(F.lit(TEST_TEMPLATE), F.lit("{f}"), F.col("func_name"))))
    return (o.select(F.col("o_orderkey").alias("sub_id"), func_name.alias("func_name"),
                     v.cast("int").alias("_v"), (F.col("o_orderstatus") == "F").alias("correct"),
                     (F.col("o_orderkey") % 100 == 0).alias("ref_sol"))
            .select("sub_id", "func_name",
                    F.replace(_template_col(F.col("_v")), F.lit("{f}"), F.col("func_name")).alias("func_code"),
                    F.concat(F.lit("Solve "), F.col("func_name")).alias("description"),
                    "correct", "ref_sol")
            .withColumn("test", test)
            .select("sub_id", "func_name", "func_code", "description", "test", "correct", "ref_sol"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test outcomes ``sub_id, case_no, passed`` (pairs are not unique)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("sub_id"), F.col("l_linenumber").alias("case_no"),
                     (F.col("l_returnflag") != "R").alias("passed"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated programs ``sub_id, func_name, completion``."""
    p = read_table(spark, sf_dir, "part").select("p_partkey")
    func_name = _question("p_partkey", "p_partkey")
    body = F.replace(_template_col((F.col("p_partkey") % len(TEMPLATES)).cast("int")), F.lit("{f}"), func_name)
    return p.select(F.col("p_partkey").alias("sub_id"), func_name.alias("func_name"),
                    F.concat(F.lit(COMPLETION_HEADER), body).alias("completion"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_id, func_name, source, destination``: every wrong submission
    with its question's most frequent correct program (ties: first seen)."""
    from progcorpus.operators.sampling import modal_program

    subs = submissions(spark, sf_dir)
    modal = modal_program(subs.where(F.col("correct")), "func_name", "func_code", "sub_id") \
        .select("func_name", F.col("modal_code").alias("destination"))
    return (subs.where(~F.col("correct")).join(modal, on="func_name", how="inner")
            .select(F.col("sub_id").alias("pair_id"), "func_name", F.col("func_code").alias("source"),
                    "destination"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


# ---------------------------------------------------------------------------
# The same views in DuckDB SQL, for the oracles.
# ---------------------------------------------------------------------------

def sql_str(s: str) -> str:
    """A DuckDB string literal (raw line breaks are legal inside quotes)."""
    return "'" + s.replace("'", "''") + "'"


def _sql_template(v: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {sql_str(t)}" for i, t in enumerate(TEMPLATES))
    return f"(CASE {v} {whens} END)"


SUBMISSIONS_SQL = f"""
submissions_v AS (
  SELECT o_orderkey AS sub_id,
         {_sql_question('o_orderkey', 'o_custkey')} AS func_name,
         CAST(CASE o_orderkey % 150 {' '.join(f'WHEN {r} THEN {t}' for r, t in RARE.items())} ELSE o_orderkey % 15 END AS INTEGER) AS v,
         o_orderstatus = 'F' AS correct,
         o_orderkey % 100 = 0 AS ref_sol
  FROM orders),
submissions AS (
  SELECT sub_id, func_name,
         replace({_sql_template('v')}, '{{f}}', func_name) AS func_code,
         'Solve ' || func_name AS description,
         CASE WHEN func_name = 'task_8' OR sub_id % 4 = 0 THEN NULL
              ELSE (CASE WHEN func_name = 'task_9' THEN {sql_str(TASK9_PRELUDE)} ELSE '' END)
                   || replace({sql_str(TEST_TEMPLATE)}, '{{f}}', func_name) END AS test,
         correct, ref_sol, v
  FROM submissions_v),
observed AS (
  SELECT l_orderkey AS sub_id, l_linenumber AS case_no, l_returnflag <> 'R' AS passed FROM lineitem),
completions AS (
  SELECT p_partkey AS sub_id, {_sql_question('p_partkey', 'p_partkey')} AS func_name,
         {sql_str(COMPLETION_HEADER)} || replace({_sql_template(f'CAST(p_partkey % {len(TEMPLATES)} AS INTEGER)')}, '{{f}}',
                 {_sql_question('p_partkey', 'p_partkey')}) AS completion,
         CAST(p_partkey % {len(TEMPLATES)} AS INTEGER) AS v
  FROM part),
cmodal AS (SELECT func_name, func_code AS destination FROM (
  SELECT func_name, func_code, row_number() OVER (PARTITION BY func_name ORDER BY count(*) DESC, min(sub_id)) AS rn
  FROM submissions WHERE correct GROUP BY func_name, func_code) WHERE rn = 1),
pairs AS (
  SELECT s.sub_id AS pair_id, s.func_name, s.func_code AS source, m.destination, s.v AS src_v,
         (SELECT any_value(v) FROM submissions x WHERE x.func_code = m.destination) AS dst_v
  FROM submissions s JOIN cmodal m USING (func_name) WHERE NOT s.correct)"""


def with_views(body: str, ctes: str = "") -> str:
    """Prefix an oracle query with the derived views and extra CTEs."""
    extra = (",\n" + ctes.strip().lstrip(",")) if ctes.strip() else ""
    return "WITH " + SUBMISSIONS_SQL.strip() + extra + "\n" + body.strip()
