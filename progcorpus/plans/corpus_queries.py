"""Registered queries over whole tables: sampling, verdicts, test strings,
export, line jobs, sources and sinks (all Catalyst-only)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from progcorpus.functions import lines as L
from progcorpus.functions.testspec import three_digits
from progcorpus.operators import columns, export, grading, sampling, testcases
from progcorpus.plans.registry import query
from progcorpus.session import checkpoint_dir
from progcorpus.sources import fixtures as fx
from progcorpus.sources import json_io, sinks
from progcorpus.sources.tables import read_table

# --- SQL snippets shared by the oracles -------------------------------------
_BREAKS = "[\\n\\r\\v\\f\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"


def sql_line_count(x: str) -> str:
    return (f"CAST(len(regexp_extract_all({x}, '\\r\\n|{_BREAKS}')) + CASE WHEN {x} <> '' AND NOT "
            f"regexp_matches({x}, '{_BREAKS}$') THEN 1 ELSE 0 END AS BIGINT)")


def sql_strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


# --- S1 -------------------------------------------------------------------------

@query("scan_submissions", """
SELECT sub_id, func_name, func_code, description, test, correct, ref_sol FROM submissions""")
def q_scan_submissions(spark, sf):
    return fx.submissions(spark, sf)


# --- F1 / A2 --------------------------------------------------------------------

@query("line_count", f"SELECT sub_id, {sql_line_count('func_code')} AS n_lines FROM submissions")
def q_line_count(spark, sf):
    return fx.submissions(spark, sf).select("sub_id", L.line_count("func_code").alias("n_lines"))


@query("line_count_documents", f"SELECT doc_id, {sql_line_count('text')} AS n_lines FROM documents")
def q_line_count_documents(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", L.line_count("text").alias("n_lines"))


def _mad_sql(table: str, key: str, group: str, text: str) -> tuple[str, str]:
    ctes = f"""
s AS (SELECT {key}, {group}, {sql_line_count(text)} AS n_lines FROM {table}),
m AS (SELECT {group}, median(n_lines) AS med FROM s GROUP BY {group}),
d AS (SELECT s.*, m.med, abs(s.n_lines - m.med) AS dev FROM s JOIN m USING ({group})),
a AS (SELECT {group}, median(dev) AS mad FROM d GROUP BY {group})"""
    body = f"""SELECT {key}, {group}, n_lines FROM d JOIN a USING ({group})
WHERE a.mad = 0 OR (d.n_lines - d.med) / a.mad <= 2.5"""
    return body, ctes


_b, _c = _mad_sql("submissions", "sub_id", "func_name", "func_code")


@query("mad_outliers", _b, _c)
def q_mad_outliers(spark, sf):
    out = sampling.mad_outliers(fx.submissions(spark, sf), "func_name", "func_code", 2.5)
    return out.select("sub_id", "func_name", "n_lines")


_b, _c = _mad_sql("documents", "doc_id", "lang", "text")


@query("mad_outliers_documents", _b, _c)
def q_mad_outliers_documents(spark, sf):
    out = sampling.mad_outliers(read_table(spark, sf, "documents"), "lang", "text", 2.5)
    return out.select("doc_id", "lang", "n_lines")


# --- A1 ---------------------------------------------------------------------------

def _modal_sql(table, key, group, text):
    ctes = f"""
c AS (SELECT {group}, {text} AS code, count(*) AS n, min({key}) AS first_seen FROM {table} GROUP BY {group}, {text}),
r AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, first_seen) AS rn FROM c)"""
    return f"SELECT {group}, code AS modal_code, CAST(n AS BIGINT) AS modal_count FROM r WHERE rn = 1", ctes


_b, _c = _modal_sql("submissions", "sub_id", "func_name", "func_code")


@query("modal_program", _b, _c)
def q_modal_program(spark, sf):
    return sampling.modal_program(fx.submissions(spark, sf), "func_name", "func_code", "sub_id")


_b, _c = _modal_sql("documents", "doc_id", "lang", "text")


@query("modal_program_documents", _b, _c)
def q_modal_program_documents(spark, sf):
    return sampling.modal_program(read_table(spark, sf, "documents"), "lang", "text", "doc_id")


# --- W4 ---------------------------------------------------------------------------

def _head_sql(table, key, group, p):
    return f"""SELECT {key}, {group} FROM (
  SELECT {key}, {group}, row_number() OVER (PARTITION BY {group} ORDER BY {key}) AS rn,
         count(*) OVER (PARTITION BY {group}) AS n FROM {table})
WHERE rn <= ceil(n * (CAST({p} AS DOUBLE) / CAST(100 AS DOUBLE)))"""


@query("head_percent", _head_sql("submissions", "sub_id", "func_name", 33))
def q_head_percent(spark, sf):
    return sampling.head_percent(fx.submissions(spark, sf), 33, "func_name", "sub_id") \
        .select("sub_id", "func_name")


@query("head_percent_documents", _head_sql("documents", "doc_id", "source", 33))
def q_head_percent_documents(spark, sf):
    return sampling.head_percent(read_table(spark, sf, "documents"), 33, "source", "doc_id") \
        .select("doc_id", "source")


# --- W5 / W7 / A4 / W1 --------------------------------------------------------------

@query("reference_solution", """
SELECT func_name, sub_id, func_code FROM (
  SELECT *, row_number() OVER (PARTITION BY func_name ORDER BY sub_id) AS rn FROM submissions WHERE ref_sol)
WHERE rn = 1""")
def q_reference_solution(spark, sf):
    return sampling.reference_solution(fx.submissions(spark, sf), "func_name", ref_sol_col="ref_sol") \
        .select("func_name", "sub_id", "func_code")


_b, _c = _modal_sql("submissions", "sub_id", "func_name", "func_code")


@query("reference_solution_modal", """
SELECT s.func_name, min(s.sub_id) AS sub_id, any_value(s.func_code) AS func_code
FROM submissions s JOIN r ON s.func_name = r.func_name AND s.func_code = r.code AND r.rn = 1
GROUP BY s.func_name""", _c)
def q_reference_solution_modal(spark, sf):
    return sampling.reference_solution(fx.submissions(spark, sf), "func_name") \
        .select("func_name", "sub_id", "func_code")


@query("first_per_question", """
SELECT func_name, arg_min(description, sub_id) AS description,
       arg_min(test, sub_id) FILTER (WHERE test IS NOT NULL AND test <> '') AS first_test,
       arg_min(func_code, sub_id) FILTER (WHERE correct) AS reference_code
FROM submissions GROUP BY func_name""")
def q_first_per_question(spark, sf):
    return sampling.first_per_question(fx.submissions(spark, sf))


@query("question_list", "SELECT DISTINCT func_name FROM submissions")
def q_question_list(spark, sf):
    return sampling.question_list(fx.submissions(spark, sf))


@query("question_numbers", """
SELECT func_name, CAST(row_number() OVER (ORDER BY func_name) AS BIGINT) AS question_no
FROM (SELECT DISTINCT func_name FROM submissions)""")
def q_question_numbers(spark, sf):
    return sampling.question_numbers(fx.submissions(spark, sf))


# --- W2 / W3 / S6 ---------------------------------------------------------------------

@query("program_numbers", """
SELECT sub_id, func_name, correct,
       CAST(row_number() OVER (PARTITION BY func_name, correct ORDER BY sub_id) AS BIGINT) AS program_no
FROM submissions""")
def q_program_numbers(spark, sf):
    return export.program_numbers(fx.submissions(spark, sf)).select("sub_id", "func_name", "correct",
                                                                     "program_no")


def _first_tested_sql():
    return """
ft AS (SELECT func_name, arg_min(test, sub_id) AS first_test FROM submissions
       WHERE test IS NOT NULL AND test <> '' GROUP BY func_name),
fb AS (SELECT func_name,
              CASE WHEN strpos(first_test, 'assert') > 0 THEN replace(
                  """ + sql_strip("replace(substr(first_test, strpos(first_test, 'assert')), 'assert', '')") + """,
                  ') ==', ')==') END AS body FROM ft),
tc AS (SELECT func_name, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS case_no, unnest(parts) AS c FROM (
         SELECT func_name, string_split(body, ' and ') AS parts FROM fb WHERE body IS NOT NULL)),
tcs AS (SELECT func_name, case_no, string_split(c, ')==') AS p, c FROM tc),
tct AS (SELECT func_name, case_no,
               CASE WHEN len(p) = 2 THEN p[1] || ')' ELSE c END AS input,
               CASE WHEN len(p) = 2 THEN """ + sql_strip("p[2]") + """ END AS expected FROM tcs)"""


@query("test_case_table", "SELECT func_name, case_no, input, expected FROM tct", _first_tested_sql())
def q_test_case_table(spark, sf):
    return testcases.test_case_table(fx.submissions(spark, sf))


@query("test_case_numbers", """
SELECT func_name, case_no, 'input_' || printf('%03d', case_no) || '.txt' AS input_file,
       'output_' || printf('%03d', case_no) || '.txt' AS output_file FROM tct""",
       _first_tested_sql())
def q_test_case_numbers(spark, sf):
    t = testcases.test_case_table(fx.submissions(spark, sf))
    return t.select("func_name", "case_no",
                    F.concat(F.lit("input_"), three_digits("case_no"), F.lit(".txt")).alias("input_file"),
                    F.concat(F.lit("output_"), three_digits("case_no"), F.lit(".txt")).alias("output_file"))


_PRELUDE_SQL = """
q AS (SELECT DISTINCT func_name FROM submissions),
pre AS (SELECT q.func_name, coalesce(CASE WHEN strpos(ft.first_test, 'assert') > 0 THEN """ + \
    sql_strip("substr(ft.first_test, 1, strpos(ft.first_test, 'assert') - 1)") + """ END, '') AS prelude
        FROM q LEFT JOIN ft USING (func_name))"""


@query("test_prelude", "SELECT func_name, prelude FROM pre", _first_tested_sql() + "," + _PRELUDE_SQL)
def q_test_prelude(spark, sf):
    return testcases.test_preludes(fx.submissions(spark, sf))


@query("split_asserts", """
SELECT sub_id, case_no,
       CASE WHEN len(string_split(c, '==')) = 2 THEN string_split(c, '==')[1] ELSE c END AS input,
       CASE WHEN len(string_split(c, '==')) = 2 THEN """ + sql_strip("string_split(c, '==')[2]") + """
       END AS expected
FROM (SELECT sub_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS case_no, unnest(parts) AS c
      FROM (SELECT sub_id, string_split(""" + sql_strip(
    "replace(substr(test, strpos(test, 'assert')), 'assert', '')") + """, ' and ') AS parts
            FROM submissions WHERE strpos(test, 'assert') > 0))""")
def q_split_asserts(spark, sf):
    return testcases.assert_cases(fx.submissions(spark, sf))


_MANIFEST_SQL = _first_tested_sql() + "," + _PRELUDE_SQL + """,
qn AS (SELECT func_name, row_number() OVER (ORDER BY func_name) AS qno FROM q),
pq AS (SELECT func_name, arg_min(description, sub_id) AS description,
              arg_min(func_code, sub_id) FILTER (WHERE correct) AS reference_code
       FROM submissions GROUP BY func_name),
files AS (
  SELECT func_name, 'func_name.txt' AS rel_path, func_name AS content FROM q
  UNION ALL SELECT func_name, 'description.txt', description FROM pq
  UNION ALL SELECT func_name, 'code/metadata', func_name FROM q
  UNION ALL SELECT func_name, 'code/reference/reference.py', reference_code FROM pq
  UNION ALL SELECT func_name, 'ans/input_' || printf('%03d', case_no) || '.txt', input FROM tct
  UNION ALL SELECT func_name, 'ans/output_' || printf('%03d', case_no) || '.txt', expected FROM tct
  UNION ALL SELECT func_name, 'code/global.py', prelude FROM pre WHERE prelude <> ''
  UNION ALL SELECT s.func_name,
     'code/' || CASE WHEN correct THEN 'correct' ELSE 'wrong' END || '/' || CASE WHEN correct THEN 'correct' ELSE 'wrong' END
       || '_' || CAST(qn.qno AS VARCHAR) || '_'
       || printf('%03d', row_number() OVER (PARTITION BY s.func_name, correct ORDER BY sub_id)) || '.py',
     func_code
  FROM submissions s JOIN qn USING (func_name))"""


@query("repair_manifest", """
SELECT 'question_' || CAST(qn.qno AS VARCHAR) AS question_id, files.func_name, rel_path, content
FROM files JOIN qn USING (func_name) WHERE content IS NOT NULL""", _MANIFEST_SQL)
def q_repair_manifest(spark, sf):
    return export.repair_manifest(fx.submissions(spark, sf))


# --- J9 / A9 / P4 / P5 ------------------------------------------------------------------

_GRADE_SQL = """
o AS (SELECT sub_id, bool_and(passed) AS ok FROM observed GROUP BY sub_id),
g AS (SELECT s.sub_id, s.func_name, coalesce(o.ok, false) AND coalesce(length(s.func_code) > 0, false) AS correct
      FROM submissions s LEFT JOIN o USING (sub_id))"""


@query("grade_submissions", "SELECT sub_id, func_name, correct FROM g", _GRADE_SQL)
def q_grade_submissions(spark, sf):
    return grading.grade_submissions(fx.submissions(spark, sf), fx.observed(spark, sf)) \
        .select("sub_id", "func_name", "correct")


@query("pass_rate", """
SELECT func_name, round(avg(CAST(correct AS DOUBLE)), 6) AS pass_at_1, CAST(count(*) AS BIGINT) AS n_programs
FROM g GROUP BY func_name""", _GRADE_SQL)
def q_pass_rate(spark, sf):
    graded = grading.grade_submissions(fx.submissions(spark, sf), fx.observed(spark, sf))
    return grading.pass_rate(graded).select("func_name", F.round("pass_at_1", 6).alias("pass_at_1"),
                                            "n_programs")


@query("programs_by_verdict", """
SELECT sub_id, func_code FROM submissions WHERE func_name = 'task_3' AND correct = false""")
def q_programs_by_verdict(spark, sf):
    return grading.programs_by_verdict(fx.submissions(spark, sf), "task_3", False).select("sub_id", "func_code")


@query("tested_rows", "SELECT sub_id, func_name, test FROM submissions WHERE test IS NOT NULL AND test <> ''")
def q_tested_rows(spark, sf):
    return grading.tested_rows(fx.submissions(spark, sf)).select("sub_id", "func_name", "test")


# --- P1 / P2 / P3 ------------------------------------------------------------------------

@query("key_subset", """
SELECT event_id,
       CASE WHEN json_extract(props, '$.k') IS NULL THEN '{}'
            ELSE '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' END AS kept,
       '{"user":' || CAST(user_id AS VARCHAR) || '}' AS rejected
FROM events""")
def q_key_subset(spark, sf):
    # a stand-in attribute map: the event's properties and its user
    ev = json_io.parse_json_column(read_table(spark, sf, "events").select("event_id", "user_id", "props"),
                                   "props", "map<string,bigint>")
    ev = ev.withColumn("props", F.map_concat("props", F.create_map(F.lit("user"), F.col("user_id").cast("bigint"))))
    return ev.select("event_id", F.to_json(columns.key_subset_map("props", ["k"])).alias("kept"),
                     F.to_json(columns.key_subset_map("props", ["k"], reject=True)).alias("rejected"))


@query("apply_column", "SELECT doc_id, lang || ':' || md5(text) AS tag FROM documents")
def q_apply_column(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    return columns.apply_column(docs, lambda lang, text: F.concat(lang, F.lit(":"), F.md5(text)), ["lang", "text"],
                                "tag").select("doc_id", "tag")


@query("drop_index_columns", """
SELECT sub_id, func_name, func_code, description, test, correct, ref_sol FROM submissions""")
def q_drop_index_columns(spark, sf):
    # a stand-in input as a pandas round trip leaves it: with an index column
    subs = fx.submissions(spark, sf).withColumn("__index_level_0__", F.col("sub_id"))
    return columns.drop_index_columns(subs)


# --- F2 / F3 / F8 -------------------------------------------------------------------------

@query("strip_generation_lines", """
SELECT sub_id, array_to_string(list_filter(
         CASE WHEN completion = '' THEN [] ELSE regexp_split_to_array(
             regexp_replace(completion, '(\\r\\n|\\n|\\r)$', ''), '\\r\\n|\\n|\\r') END,
         lambda l: NOT (starts_with(l, '<') OR starts_with(ltrim(l), '#'))), chr(10)) AS stripped
FROM completions""")
def q_strip_generation_lines(spark, sf):
    return fx.completions(spark, sf).select("sub_id", L.strip_generation_lines("completion").alias("stripped"))


@query("implementation_start", """
SELECT sub_id, CAST(coalesce(
   list_max(list_transform(range(1, len(string_split(completion, chr(10))) + 1),
            lambda i: CASE WHEN contains(string_split(completion, chr(10))[i], '\"\"\"') THEN i - 1 END)),
   list_max(list_transform(range(1, len(string_split(completion, chr(10))) + 1),
            lambda i: CASE WHEN starts_with(string_split(completion, chr(10))[i], 'def') THEN i - 1 END))) + 1 AS INTEGER)
   AS impl_start
FROM completions""")
def q_implementation_start(spark, sf):
    return fx.completions(spark, sf).select("sub_id", L.implementation_start("completion").alias("impl_start"))


@query("attach_docstring", """
SELECT sub_id, CASE WHEN len(string_split(func_code, chr(10))) > 1 THEN
  array_to_string(list_concat(
     [string_split(func_code, chr(10))[1]],
     [regexp_extract(string_split(func_code, chr(10))[2], '^[ \\t]*', 0) || '\"\"\"' || description || '\"\"\"'],
     string_split(func_code, chr(10))[2:]), chr(10)) END AS with_doc
FROM submissions""")
def q_attach_docstring(spark, sf):
    subs = fx.submissions(spark, sf).select("sub_id", "func_code", "description")
    return L.with_docstring(subs, "func_code", "description").select("sub_id", "with_doc")


# --- S2 / S3 / S4 / S5 ----------------------------------------------------------------------

def _scratch(spark, kind: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


@query("scan_json", "SELECT event_id, user_id, event_type, value, props FROM events")
def q_scan_json(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    path = _scratch(spark, "json")
    json_io.sink_json(ev, path)
    return json_io.scan_json(spark, path, schema=ev.schema, multi_line=False) \
        .select("event_id", "user_id", "event_type", "value", "props")


def _event_documents(spark, sf):
    """JSON documents of a user's events, at most 256 each (a user may have any number)."""
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    return ev.schema, ev.groupBy("user_id", F.floor(F.col("event_id") / 256).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(*ev.columns))).alias("e"))


@query("scan_json_records", "SELECT event_id, user_id, event_type, value, props FROM events")
def q_scan_json_records(spark, sf):
    """Lists of objects over many lines, several to a file, read by their record boundaries."""
    schema, docs = _event_documents(spark, sf)
    path = _scratch(spark, "json-records")
    sinks.sink_text(docs.select(F.to_json("e", {"pretty": "true"}).alias("doc")), path, "doc")
    return json_io.scan_json_lists(spark, path, schema)


@query("scan_json_columns", "SELECT event_id, user_id, event_type, value, props FROM events")
def q_scan_json_columns(spark, sf):
    schema, docs = _event_documents(spark, sf)
    # every field as a column array; nulls of a row stay in their place
    arrays = F.struct(*[F.col(f"e.{f.name}").alias(f.name) for f in schema.fields])
    path = _scratch(spark, "json-columns")
    sinks.sink_text(docs.select(F.to_json(arrays).alias("doc")), path, "doc")
    return json_io.scan_json(spark, path, layout="columns",
                             schema=", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in schema.fields))


@query("sink_table", f"SELECT sub_id, func_name, {sql_line_count('func_code')} AS n_lines FROM submissions")
def q_sink_table(spark, sf):
    out = fx.submissions(spark, sf).select("sub_id", "func_name", L.line_count("func_code").alias("n_lines"))
    path = _scratch(spark, "table")
    sinks.sink_table(out, path, partition_by=None)
    return spark.read.parquet(path)


@query("sink_text", """
SELECT 'question_' || CAST(qn.qno AS VARCHAR) AS question_id, rel_path, content
FROM files JOIN qn USING (func_name) WHERE content IS NOT NULL""", _MANIFEST_SQL)
def q_sink_text(spark, sf):
    """All file kinds of the export as text, a folder per kind, read back whole."""
    files = export.repair_manifest(fx.submissions(spark, sf))
    path = _scratch(spark, "text")
    sinks.sink_texts(files.select(
        F.concat_ws("\n", "question_id", "rel_path", "content").alias("text"),
        F.regexp_replace(F.regexp_replace("rel_path", r"[_0-9]*\.?\w*$", ""), "/", "-").alias("kind")),
        path, "text", partition_by=["kind"])
    parts = F.split("value", "\n", 3)
    return sinks.scan_texts(spark, path).select(parts[0].alias("question_id"), parts[1].alias("rel_path"),
                                                parts[2].alias("content"))


@query("sink_json", """
SELECT '{"event_id":' || CAST(event_id AS VARCHAR) || ',"user_id":' || CAST(user_id AS VARCHAR)
       || ',"event_type":"' || event_type || '"}' AS value
FROM events""")
def q_sink_json(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "event_type")
    path = _scratch(spark, "jsonl")
    json_io.sink_json(ev, path)
    return spark.read.text(path).select("value")


_TYPED = {1: ":type x: int\n:type y: int\n", 4: ":type u: tuple\n", 11: ":type items: int\n:type limit: int\n",
          13: "", 16: ":type a: tuple\n", 17: ":type a: tuple\n", 18: "", 19: ""}


@query("typed_docstring", """
SELECT sub_id, CASE WHEN v = 14 OR test IS NULL OR strpos(test, 'assert') = 0 THEN NULL ELSE
  description || chr(10) || chr(10) || (CASE v """ + " ".join(
    f"WHEN {v} THEN {fx.sql_str(t)}" for v, t in _TYPED.items()) + """
     ELSE ':type a: int' || chr(10) || ':type b: int' || chr(10) END) || ':rtype: int' || chr(10) || chr(10) ||
  ':Example:' || chr(10) || '  >>> ' || func_name || '(1, 2) == 3' || chr(10) || '  >>> ' || func_name || '(2, 2) == 4'
  END AS typed
FROM submissions""")
def q_typed_docstring(spark, sf):
    return testcases.typed_docstring(fx.submissions(spark, sf))
