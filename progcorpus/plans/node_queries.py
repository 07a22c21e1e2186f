"""Registered syntax-tree and equivalence queries (T6, P7, P9, A6, A11, A7,
T5, T3, A5, J2, J3, P8, T7, J6-B, A10, J1, W6, A3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from progcorpus.operators import inventory as C
from progcorpus.operators import dedup as D
from progcorpus.operators import nodes as N
from progcorpus.operators import tokens as T
from progcorpus.plans.golden import FUNCS, GOLDEN, TOKENS
from progcorpus.plans.oracle_sql import DIM, _values, ctes, golden_constructs, golden_funcs, golden_scalars
from progcorpus.plans.registry import query
from progcorpus.session import splittable
from progcorpus.sources import fixtures as fx
from progcorpus.sources.tables import read_table


class _Corpus:
    """Submissions with ``code_id``, their distinct texts, tokens and nodes
    (each built on first use and materialised once)."""

    def __init__(self, spark, sf, code_col="func_code", source="submissions"):
        base = fx.submissions(spark, sf) if source == "submissions" else fx.completions(spark, sf)
        self.code_col = code_col
        self.subs = T.with_code_id(base, code_col)
        self.dim = T.code_dim(self.subs, code_col)
        self._job = self._nt = None

    @property
    def job(self):
        if self._job is None:
            self._job = T.token_table(self.dim)
        return self._job

    @property
    def nt(self):
        if self._nt is None:
            self._nt = N.node_table(self.dim)
        return self._nt

    def pairs(self):
        return self.subs.select("code_id", "func_name").distinct()


def _tree_functions_sql() -> str:
    rows = []
    for v, g in GOLDEN.items():
        if g["compile_error"] is None:
            rows += [(v, i, name, text) for i, (name, text) in enumerate(g["tree_functions"])]
        elif g["tokenizes"]:
            rows += [(v, 1000 + i, name, text) for i, (name, text) in enumerate(FUNCS[v])]
    return _values("gtf", ["v", "ord", "name", "string"], rows, ["INTEGER", "INTEGER", "VARCHAR", "VARCHAR"])


def _named(expr: str, f: str = "d.func_name") -> str:
    """Golden text with the question's name in place of ``task_0`` / ``{f}``."""
    return f"replace(replace({expr}, 'task_0', {f}), '{{f}}', {f})"


# --- T6 / P7 / P9 / A6 / A11 -----------------------------------------------------

@query("node_table", "SELECT d.code_id, gs.n_nodes, gs.compile_error FROM d JOIN gs USING (v)",
       ctes(DIM, golden_scalars()))
def q_node_table(spark, sf):
    c = _Corpus(spark, sf)
    return N.node_counts(c.nt)


@query("compile_status", "SELECT s.sub_id, gs.compile_error FROM submissions s JOIN gs USING (v)",
       ctes(golden_scalars()))
def q_compile_status(spark, sf):
    c = _Corpus(spark, sf)
    return (c.subs.select("sub_id", "code_id").join(splittable(N.parse_status(c.nt)), on="code_id", how="left")
            .select("sub_id", "compile_error"))


@query("multi_function", "SELECT d.code_id, gs.multi_function FROM d JOIN gs USING (v)",
       ctes(DIM, golden_scalars()))
def q_multi_function(spark, sf):
    c = _Corpus(spark, sf)
    return N.multi_function(c.nt, c.dim)


@query("variable_list", "SELECT d.code_id, gs.variables FROM d JOIN gs USING (v)", ctes(DIM, golden_scalars()))
def q_variable_list(spark, sf):
    c = _Corpus(spark, sf)
    return N.variable_string(c.nt)


_ADJ = _values("ga", ["v", "adjacency_md5"], [(v, g["adjacency_md5"]) for v, g in GOLDEN.items()
                                             if g["adjacency_md5"]], ["INTEGER", "VARCHAR"])


@query("adjacency_list", "SELECT d.code_id, ga.adjacency_md5 FROM d JOIN ga USING (v)", ctes(DIM, _ADJ))
def q_adjacency_list(spark, sf):
    c = _Corpus(spark, sf)
    adj = N.adjacency_list(c.nt)
    item = F.concat(F.col("type"), F.lit(":"), F.array_join(F.col("children"), ","))
    return adj.groupBy("code_id").agg(F.md5(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("node_id", item.alias("s")))), lambda s: s["s"]), ";"))
        .alias("adjacency_md5"))


# --- A7 / T5 / T3 ---------------------------------------------------------------------

@query("function_map", f"""
SELECT d.code_id, {_named('gtf.name')} AS name,
       CAST(row_number() OVER (PARTITION BY d.code_id, gtf.name ORDER BY gtf.ord) - 1 AS INTEGER) AS ix,
       CASE WHEN gtf.string = 'WHOLE' THEN substr(d.func_code, strpos(d.func_code, 'def'))
            ELSE {_named('gtf.string')} END AS definition
FROM d JOIN gtf USING (v)""", ctes(DIM, _tree_functions_sql()))
def q_function_map(spark, sf):
    c = _Corpus(spark, sf)
    return N.function_map(c.nt, c.dim)


@query("first_function_name", f"SELECT d.code_id, {_named('gs.first_function')} AS first_function "
                              "FROM d JOIN gs USING (v)", ctes(DIM, golden_scalars()))
def q_first_function_name(spark, sf):
    c = _Corpus(spark, sf)
    return N.first_function_name(c.nt, c.dim)


@query("strip_docstrings", """
SELECT d.code_id,
       CASE WHEN v = 3 THEN 'def ' || d.func_name || '(a, b):' || chr(10) || '    # add' || chr(10) ||
                            '    c = a + b' || chr(10) || '    return c'
            ELSE regexp_replace(d.func_code, '\\r\\n|\\r', chr(10), 'g') END AS stripped,
       CASE WHEN v = 3 THEN 'Add two numbers.' ELSE '' END AS docstrings
FROM d JOIN gs USING (v) WHERE gs.compile_error IS NULL""", ctes(DIM, golden_scalars()))
def q_strip_docstrings(spark, sf):
    c = _Corpus(spark, sf)
    return N.strip_docstrings(c.nt, c.dim)


# --- A5 / J2 / J3 / P8 / T7 ---------------------------------------------------------------

def _inventory(c):
    return C.construct_inventory(N.with_variables(c.nt, c.dim), C.operator_relation(c.subs.sparkSession))


@query("construct_inventory", "SELECT d.code_id, gc.construct, gc.src, gc.positions, gc.n FROM d JOIN gc USING (v)",
       ctes(DIM, golden_constructs()))
def q_construct_inventory(spark, sf):
    return _inventory(_Corpus(spark, sf))


@query("variable_locations", """
SELECT d.code_id, gc.src, gc.positions, gc.n FROM d JOIN gc USING (v) WHERE gc.construct = 'variables'""",
       ctes(DIM, golden_constructs()))
def q_variable_locations(spark, sf):
    c = _Corpus(spark, sf)
    return C.variable_locations(N.with_variables(c.nt, c.dim)).select("code_id", "src", "positions", "n")


@query("string_tokens", """
SELECT d.code_id, gc.src, gc.positions, gc.n FROM d JOIN gc USING (v) WHERE gc.construct = 'strings'""",
       ctes(DIM, golden_constructs()))
def q_string_tokens(spark, sf):
    c = _Corpus(spark, sf)
    return C.string_tokens(N.with_variables(c.nt, c.dim)).select("code_id", "src", "positions", "n")


@query("has_no_constructs", """
SELECT d.code_id, (SELECT count(*) FROM gc WHERE gc.v = d.v) = 0 AS is_empty FROM d""",
       ctes(DIM, golden_constructs()))
def q_has_no_constructs(spark, sf):
    c = _Corpus(spark, sf)
    return C.has_no_constructs(N.with_variables(c.nt, c.dim), C.operator_relation(spark))


@query("submission_profile", f"""
SELECT s.sub_id, gs.compile_error, CASE WHEN gs.tokenizes THEN gs.n_tokens ELSE 0 END AS n_tokens,
       {_named('gs.variables', 's.func_name')} AS variables, go.operator_seq AS operators
FROM submissions s JOIN gs USING (v) JOIN go USING (v)""",
       ctes(golden_scalars(), _values("go", ["v", "operator_seq"],
                                      [(v, g["operator_seq"]) for v, g in GOLDEN.items()], ["INTEGER", "VARCHAR"])))
def q_submission_profile(spark, sf):
    c = _Corpus(spark, sf)
    return C.submission_profile(c.subs, N.with_variables(c.nt, c.dim), C.operator_relation(spark))


# --- J6-B --------------------------------------------------------------------------------

@query("predicted_function_b", """
SELECT c.sub_id, coalesce(CASE WHEN f1.s = 'WHOLE' THEN substr(c.completion, strpos(c.completion, 'def'))
                               ELSE replace(f1.s, '{f}', c.func_name) END, c.completion) AS predicted
FROM completions c LEFT JOIN (SELECT v, arg_min(string, ix) AS s FROM gf WHERE name = '{f}' GROUP BY v) f1
  USING (v)""", ctes(golden_funcs()))
def q_predicted_function_b(spark, sf):
    c = _Corpus(spark, sf, code_col="completion", source="completions")
    fm = N.function_map(c.nt, c.dim)
    return N.predicted_function_b(fm, c.subs).select("sub_id", "predicted")


# --- A10 / J1 / W6 / A3 -------------------------------------------------------------------

_CLASS_SQL = """
cl AS (SELECT s.*, gs.cls FROM submissions s JOIN gs USING (v) WHERE gs.cls IS NOT NULL),
cc AS (SELECT func_name, cls, func_code, count(*) AS n, min(sub_id) AS first_seen FROM cl
       GROUP BY func_name, cls, func_code),
rep AS (SELECT func_name, cls, func_code AS representative FROM (
          SELECT *, row_number() OVER (PARTITION BY func_name, cls ORDER BY n DESC, first_seen) AS rn FROM cc)
        WHERE rn = 1),
kept AS (SELECT cl.sub_id, cl.func_name, cl.func_code, rep.representative
         FROM cl JOIN rep USING (func_name, cls) WHERE cl.func_code = rep.representative)"""


@query("canonical_form", """
SELECT s.sub_id, CASE WHEN gs.cls IS NULL THEN NULL ELSE
         min(s.sub_id) OVER (PARTITION BY s.func_name, gs.cls) END AS class_label
FROM submissions s JOIN gs USING (v)""", ctes(golden_scalars()))
def q_canonical_form(spark, sf):
    c = _Corpus(spark, sf)
    canon = D.canonical_form(c.nt, c.pairs())
    classed = D.with_classes(c.subs, canon)
    label = classed.where(F.col("normalized").isNotNull()).groupBy("func_name", "normalized") \
        .agg(F.min("sub_id").alias("class_label"))
    return classed.join(label, on=["func_name", "normalized"], how="left").select("sub_id", "class_label")


@query("representative_rows", "SELECT sub_id, func_name, representative FROM kept",
       ctes(golden_scalars(), _CLASS_SQL))
def q_representative_rows(spark, sf):
    c = _Corpus(spark, sf)
    canon = D.canonical_form(c.nt, c.pairs())
    return D.representative_rows(D.with_classes(c.subs, canon)).select("sub_id", "func_name", "representative")


@query("unique_solutions", """
SELECT sub_id, func_name, func_code FROM (
  SELECT *, row_number() OVER (PARTITION BY representative ORDER BY func_name DESC, sub_id DESC) AS rn FROM kept)
WHERE rn = 1""", ctes(golden_scalars(), _CLASS_SQL))
def q_unique_solutions(spark, sf):
    c = _Corpus(spark, sf)
    canon = D.canonical_form(c.nt, c.pairs())
    return D.unique_solutions(c.subs, canon).select("sub_id", "func_name", "func_code")


@query("last_duplicate", """
SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY lang DESC, doc_id DESC) AS rn FROM documents)
WHERE rn = 1""")
def q_last_duplicate(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    # duplicates are found by text; the shuffle is keyed by the text's hash
    docs = docs.withColumn("text_id", F.sha2("text", 256))
    return D.last_duplicate(docs, "text_id", ["lang", "doc_id"]).select("doc_id", "lang")




# --- J7 / J8 --------------------------------------------------------------------------------

def _pair_job(spark, sf):
    from progcorpus.operators.rename import PairJob
    from progcorpus.session import materialize

    # the stand-in pairs table, written once as a real input would be
    return PairJob(materialize(fx.pairs(spark, sf)))


def _rename_ctes() -> str:
    toks = [(v, i, k, s) for v, ts in TOKENS.items() for i, (k, s) in enumerate(ts)]
    gt = _values("gt", ["v", "pos", "kind", "src"], toks, ["INTEGER", "INTEGER", "VARCHAR", "VARCHAR"])
    gargs = _values("gargs", ["v", "args"], [(v, g["positional_args"]) for v, g in GOLDEN.items()
                                            if g["positional_args"] is not None], ["INTEGER", "VARCHAR"])
    m = """m AS (SELECT pair_id, func_name, dst_v, CAST(ix - 1 AS INTEGER) AS arg_ix,
              string_split(sa.args, ' ')[ix] AS src_arg, string_split(da.args, ' ')[ix] AS dst_arg
       FROM (SELECT pairs.*, unnest(generate_series(1, least(len(string_split(sa.args, ' ')),
                                                           len(string_split(da.args, ' ')))))  AS ix, sa.args AS sa_args
             FROM pairs JOIN gargs sa ON sa.v = pairs.src_v JOIN gargs da ON da.v = pairs.dst_v) q
       JOIN gargs sa ON sa.v = q.src_v JOIN gargs da ON da.v = q.dst_v)"""
    return ctes(gt, gargs, m)


@query("argument_pairs", "SELECT pair_id, arg_ix, src_arg, dst_arg FROM m", _rename_ctes())
def q_argument_pairs(spark, sf):
    pj = _pair_job(spark, sf)
    return pj.pairs.join(pj.arg_pairs, on=["src_id", "dst_id", "func_name"], how="inner").select(
        "pair_id", "arg_ix", "src_arg", "dst_arg")


@query("rename_arguments", """
SELECT pp.pair_id, CASE WHEN bool_and(ok) THEN string_agg(CASE WHEN gt.kind = 'NAME' AND m.src_arg IS NOT NULL
                 THEN m.src_arg ELSE replace(gt.src, 'task_0', pp.func_name) END, '' ORDER BY gt.pos) END AS renamed
FROM (SELECT pairs.*, (sa.v IS NOT NULL AND da.v IS NOT NULL AND gsd.tokenizes) AS ok FROM pairs
      LEFT JOIN gargs sa ON sa.v = pairs.src_v LEFT JOIN gargs da ON da.v = pairs.dst_v
      JOIN gs gsd ON gsd.v = pairs.dst_v) pp
LEFT JOIN gt ON gt.v = pp.dst_v
LEFT JOIN m ON m.pair_id = pp.pair_id AND m.dst_arg = gt.src
GROUP BY pp.pair_id""", _rename_ctes() + ",\n" + golden_scalars())
def q_rename_arguments(spark, sf):
    pj = _pair_job(spark, sf)
    return pj.pairs.join(pj.renamed(), on=["src_id", "dst_id", "func_name"], how="left").select(
        "pair_id", "renamed")
