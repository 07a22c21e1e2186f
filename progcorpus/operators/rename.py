"""Argument matching and renaming between two programs.

For a (source, destination) pair the i-th positional argument of the
destination's wanted function is renamed to the i-th positional argument of
the source's, up to the shorter list; every NAME token of the destination
equal to a renamed argument is rewritten and the text rebuilt.  Work is done
once per distinct (source text, destination text, name) and joined back to
the pairs.  A pair whose source or destination does not define the function
at module level gets no argument rows and a null text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progcorpus.functions.lines import cut_spans
from progcorpus.functions.tokenstate import let, of_line, read_if_tokenizes, scan, with_offsets
from progcorpus.operators.nodes import FUNCTIONS, NodeJob
from progcorpus.operators.tokens import TokenJob
from progcorpus.session import buckets_of, materialize, splittable


_DEFINED = "struct<name:string,fid:int,aid:int,args:array<string>>"


def positional_arguments(nt: NodeJob) -> DataFrame:
    """``code_id, func_name, args``: positional parameters (positional
    only, then regular), in order, of each function that a text defines at module level (the last
    definition of a name).  A text is read once, whatever names are wanted of it, and does not move:
    its functions and arguments pass in preorder, the function they belong to is the state."""
    none, nothing = F.array().cast(f"array<{_DEFINED}>"), F.array().cast("array<string>")

    def step(s, n):
        top = n["type"].isin(*FUNCTIONS) & (n["parent_id"] == 0)
        own = (n["type"] == "arguments") & (n["parent_id"] == s["fid"])
        param = (n["type"] == "arg") & n["field"].isin("posonlyargs", "args") & (n["parent_id"] == s["aid"])

        def state(name, fid, aid, args):
            return F.struct(name.alias("name"), fid.alias("fid"), aid.alias("aid"), args.alias("args")).cast(_DEFINED)

        new = (F.when(top, state(n["ident"], n["node_id"], F.lit(None).cast("int"), nothing))
               .when(own, state(s["name"], s["fid"], n["node_id"], s["args"]))
               .when(param, state(s["name"], s["fid"], s["aid"], F.concat(s["args"], F.array(n["ident"])))).otherwise(s))
        return F.struct(new.alias("s"), F.when(top & s["fid"].isNotNull(), F.array(s)).otherwise(none).alias("o"))

    def last(fs):       # by name and place; the last of each name
        return F.filter(fs, lambda f, i: ~f["name"].eqNullSafe(F.get(fs, i + 1)["name"]))

    trees = nt.trees("node_id", "parent_id", "field", "type", "ident", types=(*FUNCTIONS, "arguments", "arg"))
    zero = F.lit(None).cast(_DEFINED)
    defined = let(scan(F.array_sort("nodes"), zero, _DEFINED, _DEFINED, step), lambda r: let(F.array_sort(F.concat(
        r["o"], F.when(r["s"]["fid"].isNotNull(), F.array(r["s"])).otherwise(none))), last))
    return trees.select("code_id", F.inline(F.transform(defined, lambda f: F.struct(f["name"].alias("func_name"), f["args"].alias("args")))))


def valid_triples(triples: DataFrame, args: DataFrame) -> DataFrame:
    """``src_id, dst_id, func_name, src_args, dst_args`` of the triples whose source and
    destination both define the function."""
    for side in ("src", "dst"):
        triples = triples.join(args.select(F.col("code_id").alias(f"{side}_id"), "func_name", F.col("args").alias(f"{side}_args")),
                               on=[f"{side}_id", "func_name"], how="inner")
    return triples.select("src_id", "dst_id", "func_name", "src_args", "dst_args")


def argument_pairs(triples: DataFrame) -> DataFrame:
    """``src_id, dst_id, func_name, arg_ix, src_arg, dst_arg`` (the lists zipped to the
    shorter one) of ``valid_triples``."""
    both = F.transform(F.slice("src_args", F.lit(1), F.size("dst_args")), lambda s, i: F.struct(
        i.alias("arg_ix"), s.alias("src_arg"), F.get("dst_args", i).alias("dst_arg")))
    return triples.select("src_id", "dst_id", "func_name", F.inline(both))


def templates(args: DataFrame, job: TokenJob) -> DataFrame:
    """``code_id, func_name, template`` for each of ``args`` whose text tokenizes: a program as pieces, split at the
    tokens that name a positional argument of the wanted function: an array of ``(text,
    arg_ix, arg)``, the text before such a token and the argument it names
    (null after the last).  The tokens are read inside the text's row."""
    wanted = args.groupBy("code_id").agg(F.collect_list(F.struct("func_name", "args")).alias("_w"))

    raw = F.col("raw")

    def made(r):
        def template(w):
            # only a line that holds an argument has its tokens placed (a token that reads as one is a name)
            def of_piece(x):
                return let(of_line(raw, x), lambda ts: F.when(F.arrays_overlap(ts, w["args"]), F.filter(F.transform(
                    with_offsets(ts, x["off"]), lambda t: F.struct(t["off"].alias("off"), t["src"].alias("src"), F.array_position(
                        w["args"], t["src"]).alias("place"))), lambda t: t["place"] > 0)))

            named = F.flatten(F.filter(F.transform(r["lines"], of_piece), lambda ts: ts.isNotNull()))

            def pieces(ts):
                ends = F.concat(F.transform(ts, lambda t, i: F.struct(
                    F.when(i == 0, F.lit(0).cast("long")).otherwise(_end(F.get(ts, i - 1))).alias("a"), t["off"].alias("b"),
                    (t["place"] - 1).cast("int").alias("arg_ix"), t["src"].alias("arg"))), F.array(F.struct(
                        F.coalesce(_end(F.get(ts, F.size(ts) - 1)), F.lit(0).cast("long")).alias("a"),
                        F.length("code").cast("long").alias("b"), F.lit(None).cast("int").alias("arg_ix"),
                        F.lit(None).cast("string").alias("arg"))))
                return cut_spans(F.col("code"), ends, lambda s, cut: F.struct(
                    cut(s["a"], s["b"]).alias("text"), s["arg_ix"].alias("arg_ix"), s["arg"].alias("arg")))

            return F.struct(w["func_name"].alias("func_name"), let(named, pieces).alias("template"))

        return F.transform("_w", template)

    read = read_if_tokenizes(raw, F.col("marks"), made, offsets=True)
    return job.of(wanted).select("code_id", F.inline(read))


def _end(token):
    return token["off"] + F.length(token["src"])


def rename_arguments(triples: DataFrame, job: TokenJob) -> DataFrame:
    """``src_id, dst_id, func_name, renamed`` — the destination's template filled with
    the source's arguments (its own where the source has fewer).  ``triples`` are
    ``valid_triples``, ``job`` the tokens of the
    destinations.  A destination is stored once, however many sources it has; a
    result row is made by one look-up per piece."""
    args = triples.groupBy(F.col("dst_id").alias("code_id"), "func_name").agg(F.any_value("dst_args").alias("args"))
    made = splittable(templates(args, job))
    filled = F.array_join(F.transform("template", lambda p: F.concat(
        p["text"], F.coalesce(F.get("src_args", p["arg_ix"]), p["arg"], F.lit("")))), "")
    return (triples.join(made.withColumnRenamed("code_id", "dst_id"), on=["dst_id", "func_name"], how="left")
            .select("src_id", "dst_id", "func_name", filled.alias("renamed")))


class PairJob:
    """J7/J8 over a pairs table ``pair_id, func_name, source, destination``.

    Texts are identified by SHA-256; the distinct (source, destination, name)
    triples, the distinct texts, their syntax trees and the argument pairs are
    each computed once and materialised; results join back to the pairs."""

    def __init__(self, pairs: DataFrame):
        from progcorpus.operators.nodes import node_table
        from progcorpus.operators.tokens import code_dim

        self.pairs = (pairs.withColumn("src_id", F.sha2("source", 256))
                      .withColumn("dst_id", F.sha2("destination", 256)))
        texts = (self.pairs.select(F.col("source").alias("func_code"))
                 .unionByName(self.pairs.select(F.col("destination").alias("func_code"))))
        self.dim = code_dim(texts)
        # arguments are those of the program without its common margin
        self.nt = node_table(self.dim, dedented=True)
        triples = self.pairs.select("src_id", "dst_id", "func_name").distinct()
        self.args = materialize(positional_arguments(self.nt))
        # a pair whose source or destination lacks the function has no result
        self.triples = materialize(valid_triples(triples, self.args))
        self.arg_pairs = argument_pairs(self.triples)

    def renamed(self) -> DataFrame:
        """``src_id, dst_id, func_name, renamed`` per valid triple."""
        from progcorpus.operators.tokens import token_table

        dst = self.dim.join(self.triples.select(F.col("dst_id").alias("code_id")).distinct(),
                            on="code_id", how="left_semi")
        return rename_arguments(self.triples, token_table(materialize(dst, "code_id", buckets_of(self.dim))))
