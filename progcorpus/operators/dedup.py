"""Equivalence classes of programs and one representative per class
(A10, J1, W6, A3).

A10 renames the local names of the wanted function to ``x_0, x_1, ...`` by
binding, without running the program, and fingerprints the renamed tree.  Which
binding an identifier means is resolved over the program's scope tree: each
occurrence is joined to the scopes from its own outwards and means the nearest
one that binds the name (class scopes only where the name stands in them
directly; ``global`` and ``nonlocal`` as they say).  Renamed are the names bound
in the wanted function and in its comprehensions, wherever they occur: in nested
functions that capture them too, but not where a helper, a nested function, a
keyword or the module has the same spelling.  The order is the first binding in
preorder, so arguments come first.

A usual program (up to ``SHORT`` characters) is renamed inside its row, by array
expressions over its nodes that look each name up in lists of the program's
bindings.  These look-ups grow with names x bindings, so longer programs take the
same steps as joins of node rows, by sort and not by list.

The fingerprint is the node count and the SHA-256 of the renamed tree (preorder id,
parent, field, position in field, type, renamed identifier, context, literal of
each node).  Two programs that differ only in local names and layout get the same
fingerprint, whichever way they were renamed; positions are not part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from progcorpus.functions.tokenstate import let
from progcorpus.operators.nodes import NodeJob, nodes_only
from progcorpus.operators.sampling import modal_keys
from progcorpus.session import splittable

_COMPREHENSIONS = ["ListComp", "SetComp", "DictComp", "GeneratorExp"]
_FIELDS = ["node_id", "parent_id", "field", "child_ix", "type", "ident", "ctx", "ltype", "literal", "scope_id", "scope_path"]
SHORT = 4096            # characters of a text whose names are looked up inside its row
_NAMES = "'([^']*)'"    # the names in the literal of a ``global`` or ``nonlocal``


def _binding(of=F.col):
    """Nodes that bind a name in their scope."""
    return ((of("type") == "arg")
            | ((of("type") == "Name") & of("ctx").isin("Store", "Del"))
            | of("type").isin("FunctionDef", "AsyncFunctionDef", "ClassDef", "alias", "ExceptHandler",
                              "MatchAs", "MatchStar", "MatchMapping"))


def wanted_id(nodes, name) -> Column:
    """The node of the function a program defines under the wanted name at module level
    (the last such definition wins, as execution would bind it); null if there is none."""
    top = F.filter(nodes, lambda n: n["type"].isin("FunctionDef", "AsyncFunctionDef") & (n["parent_id"] == 0) & (n["ident"] == name))
    return F.array_max(F.transform(top, lambda n: n["node_id"]))


def wanted_function(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``wanted_id`` over node rows: ``code_id, func_name, fid``."""
    top = nodes_only(rows).where(F.col("type").isin("FunctionDef", "AsyncFunctionDef") & (F.col("parent_id") == 0)) \
        .select("code_id", F.col("ident").alias("func_name"), F.col("node_id").alias("fid"))
    return top.join(pairs, on=["code_id", "func_name"], how="inner") \
        .groupBy("code_id", "func_name").agg(F.max("fid").alias("fid"))


def _declared(n: DataFrame) -> DataFrame:
    """Names of ``global`` and ``nonlocal`` statements: ``code_id, node_id, place, scope_id, type, ident``."""
    return (n.where(F.col("type").isin("Global", "Nonlocal"))
            .select("code_id", "node_id", "scope_id", "type",
                    F.posexplode(F.regexp_extract_all("literal", F.lit(_NAMES), 1)).alias("place", "ident")))


def _visible_scopes(n: DataFrame) -> DataFrame:
    """The scope tree closed upwards: ``code_id, scope_id, seen`` for every scope and each
    scope whose names are visible in it (rows: scopes x their nesting depth)."""
    opened = n.where(F.col("scope_path").isNotNull())
    pairs = opened.select("code_id", F.col("node_id").alias("scope_id"), F.explode("scope_path").alias("seen"))
    classes = opened.where(F.col("type") == "ClassDef").select("code_id", F.col("node_id").alias("seen"),
                                                               F.lit(True).alias("_class"))
    return (pairs.join(classes, on=["code_id", "seen"], how="left")
            .where(F.col("_class").isNull() | (F.col("seen") == F.col("scope_id"))).select("code_id", "scope_id", "seen"))


def name_bindings(n: DataFrame) -> DataFrame:
    """``code_id, seen, ident, owner, first``: the names that each scope ``seen`` binds, the
    scope that owns the binding (the module for ``global`` names), and the first
    node that binds it there."""
    declared = _declared(n)
    bound = (n.where(_binding() & F.col("ident").isNotNull())
             .groupBy("code_id", F.col("scope_id").alias("seen"), "ident").agg(F.min("node_id").alias("first"))
             .join(declared.select("code_id", F.col("scope_id").alias("seen"), "ident").distinct(),
                   on=["code_id", "seen", "ident"], how="left_anti"))
    to_module = declared.where(F.col("type") == "Global").select(
        "code_id", F.col("scope_id").alias("seen"), "ident", F.lit(0).alias("owner"),
        F.lit(None).cast("int").alias("first")).distinct()
    return bound.select("code_id", "seen", "ident", F.col("seen").alias("owner"), "first").unionByName(to_module)


def local_names(n: DataFrame, target: DataFrame, bindings: DataFrame) -> DataFrame:
    """Local names of the wanted function with their ordinal: ``code_id,
    func_name, owner, ident, new_ident`` (``owner``: the function itself or one of
    its comprehensions)."""
    scopes = n.where(F.col("scope_path").isNotNull() & F.col("type").isin(*_COMPREHENSIONS)).select(
        "code_id", F.col("node_id").alias("owner"), "scope_path")
    kinds = n.where(F.col("scope_path").isNotNull()).select("code_id", F.col("node_id").alias("seen"), F.col("type").alias("_t"))
    # a comprehension belongs to the nearest scope around it that is none
    home = (scopes.select("code_id", "owner", F.explode("scope_path").alias("seen"))
            .join(kinds, on=["code_id", "seen"], how="inner").where(~F.col("_t").isin(*_COMPREHENSIONS))
            .groupBy("code_id", "owner").agg(F.max("seen").alias("fid")))
    owners = (target.select("code_id", "func_name", F.col("fid").alias("owner"))
              .unionByName(target.join(home, on=["code_id", "fid"], how="inner").select("code_id", "func_name", "owner")))
    loc = (bindings.where(F.col("owner") == F.col("seen")).select("code_id", "owner", "ident", "first")
           .join(owners, on=["code_id", "owner"], how="inner"))
    w = Window.partitionBy("code_id", "func_name").orderBy("first")
    return loc.select("code_id", "func_name", "owner", "ident",
                      F.concat(F.lit("x_"), (F.row_number().over(w) - 1).cast("string")).alias("new_ident"))


def resolve(occurrences: DataFrame, scopes: DataFrame, bindings: DataFrame) -> DataFrame:
    """``occurrences`` (``code_id, node_id, place, ident, scope_id``) with the ``owner`` of
    the binding each means; those bound nowhere drop out."""
    return (occurrences.join(scopes, on=["code_id", "scope_id"], how="inner")
            .join(bindings.select("code_id", "seen", "ident", "owner"), on=["code_id", "seen", "ident"], how="inner")
            # scopes further in have larger preorder ids
            .groupBy("code_id", "node_id", "place", "ident").agg(F.max_by("owner", "seen").alias("owner")))


def renamed_nodes(rows: DataFrame, target: DataFrame) -> DataFrame:
    """The node rows of the programs in ``target``, per wanted function, with ``new_ident``
    (null: keeps its name) and ``new_literal`` (the names of a ``nonlocal``)."""
    n = nodes_only(rows).join(target.select("code_id").distinct(), on="code_id", how="left_semi")
    scopes, bindings = _visible_scopes(n), name_bindings(n)
    names = local_names(n, target, bindings)
    idents = names.select("code_id", "ident").distinct()
    uses = (n.where(F.col("ident").isNotNull()).select("code_id", "node_id", F.lit(-1).alias("place"), "ident", "scope_id")
            .unionByName(_declared(n).where(F.col("type") == "Nonlocal")
                         .select("code_id", "node_id", "place", "ident", "scope_id"))
            .join(idents, on=["code_id", "ident"], how="left_semi"))
    found = (resolve(uses, scopes, bindings).join(names, on=["code_id", "owner", "ident"], how="inner")
             .select("code_id", "func_name", "node_id", "place", "new_ident"))
    new = found.where(F.col("place") < 0).drop("place")
    # names of a nonlocal statement, in their order, local ones by their new names
    said = (_declared(n).where(F.col("type") == "Nonlocal").join(target.select("code_id", "func_name"), on="code_id")
            .join(found, on=["code_id", "func_name", "node_id", "place"], how="left")
            .groupBy("code_id", "func_name", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
                "place", F.coalesce("new_ident", "ident").alias("x")))), lambda s: s["x"]), ",").alias("new_literal")))
    return (n.join(target.select("code_id", "func_name"), on="code_id", how="inner")
            .join(new, on=["code_id", "func_name", "node_id"], how="left")
            .join(said, on=["code_id", "func_name", "node_id"], how="left"))


def renamed_in_row(nodes, fid) -> Column:
    """The nodes of one program as ``_node`` structs, the local names of the function
    ``fid`` renamed: what ``renamed_nodes`` finds by joins."""
    def key(scope, ident):
        return F.concat(scope.cast("string"), F.lit(":"), ident)

    def said(n):
        return F.regexp_extract_all(n["literal"], F.lit(_NAMES), F.lit(1))

    def renamed(ns):
        def kind(scope):
            return F.get(ns, scope)["type"]

        def declared(*kinds):
            return F.flatten(F.transform(F.filter(ns, lambda n: n["type"].isin(*kinds)),
                                         lambda n: F.transform(said(n), lambda x: key(n["scope_id"], x))))

        def home(n):        # a comprehension belongs to the nearest scope around it that is none
            return F.array_max(F.filter(n["scope_path"], lambda s: ~kind(s).isin(*_COMPREHENSIONS)))

        owners = F.concat(F.array(fid), F.transform(F.filter(
            ns, lambda n: n["type"].isin(*_COMPREHENSIONS) & (home(n) == fid)), lambda n: n["node_id"]))
        binding = F.transform(F.filter(ns, lambda n: _binding(lambda c: n[c]) & n["ident"].isNotNull()), lambda n: F.struct(
            n["scope_id"].alias("scope"), n["ident"].alias("ident"), key(n["scope_id"], n["ident"]).alias("key")))

        def with_bindings(p):   # p: binding, owners, declared, globals
            own = F.filter(p["binding"], lambda b: F.array_contains(p["owners"], b["scope"]) & ~F.array_contains(p["declared"], b["key"]))

            def with_names(names):      # local names by their first binding
                idents = F.array_distinct(F.transform(names, lambda b: b["ident"]))
                return let(F.struct(F.array_distinct(F.transform(names, lambda b: b["key"])).alias("keys"), idents.alias("idents")),
                           lambda q: let(F.array_distinct(F.concat(p["globals"], F.transform(F.filter(
                               p["binding"], lambda b: F.array_contains(q["idents"], b["ident"]) & ~F.array_contains(p["declared"], b["key"])),
                               lambda b: b["key"]))), lambda bound: rows(q, bound)))

            return let(own, with_names)

        def rows(q, bound):     # q: keys, idents; bound: keys of all scopes that bind such a name
            def new(scope, ident):
                # the nearest scope that binds the name; scopes further in have larger preorder ids
                seen = F.array_max(F.filter(F.get(ns, scope)["scope_path"], lambda s: (
                    (s == scope) | (kind(s) != "ClassDef")) & F.array_contains(bound, key(s, ident))))
                place = let(seen, lambda s: F.array_position(q["keys"], key(s, ident)))
                return F.when(F.array_contains(q["idents"], ident), let(place, lambda i: F.when(
                    i > 0, F.concat(F.lit("x_"), (i - 1).cast("string")))))

            def row(n):
                literal = F.when(n["type"] == "Nonlocal", F.array_join(F.transform(
                    said(n), lambda x: F.coalesce(new(n["scope_id"], x), x)), ",")).otherwise(n["literal"])
                return _node(lambda c: n[c], F.coalesce(new(n["scope_id"], n["ident"]), n["ident"]), literal)

            return F.transform(ns, row)

        return let(F.struct(binding.alias("binding"), owners.alias("owners"), declared("Global", "Nonlocal").alias("declared"),
                            declared("Global").alias("globals")), with_bindings)

    return let(nodes, renamed)


def _node(of, ident, literal) -> Column:
    """What the fingerprint holds of a node."""
    return F.struct(*[of(c).alias(c) for c in ("node_id", "parent_id", "field", "child_ix", "type")], ident.alias("ident"),
                    of("ctx").alias("ctx"), of("ltype").alias("ltype"), literal.alias("literal"))


def canonical_form(nt: NodeJob, pairs: DataFrame) -> DataFrame:
    """A10: ``code_id, func_name, normalized`` for every
    distinct (text, wanted name); no row when the text does not parse or does
    not define the name at module level (the class is then null)."""
    pairs = pairs.where(F.col("func_name").isNotNull())
    short = (nt.where(F.length("code") <= SHORT).over(pairs).trees(*_FIELDS)
             .withColumn("_fid", wanted_id("nodes", F.col("func_name"))).where(F.col("_fid").isNotNull())
             .select("code_id", "func_name", renamed_in_row(F.col("nodes"), F.col("_fid")).alias("_n")))
    long = nt.where(F.length("code") > SHORT)
    n = short
    if not long.texts.isEmpty():
        rows = long.rows(*_FIELDS)
        found = renamed_nodes(rows, wanted_function(rows, pairs))
        n = n.unionByName(found.groupBy("code_id", "func_name").agg(F.array_sort(F.collect_list(_node(
            F.col, F.coalesce("new_ident", "ident"), F.coalesce("new_literal", "literal")))).alias("_n")))
    # fields are named in the JSON text, so a null and its neighbour can't trade places
    canon = n.select("code_id", "func_name", F.concat_ws(
        ":", F.size("_n").cast("string"), F.sha2(F.to_json("_n"), 256)).alias("normalized"))
    # one row per distinct (text, name), read by several branches downstream
    return splittable(canon)


def with_classes(subs: DataFrame, canon: DataFrame) -> DataFrame:
    """Attach ``normalized`` to submissions (null when there is no class)."""
    return subs.join(canon, on=["code_id", "func_name"], how="left")


def representatives(classed: DataFrame, order_col: str = "sub_id") -> DataFrame:
    """``func_name, normalized, code_id``: the most frequent text of every
    (question, class), from ids alone."""
    valid = classed.where(F.col("func_name").isNotNull() & F.col("normalized").isNotNull())
    return modal_keys(valid, ["func_name", "normalized"], F.col("code_id"), order_col).select(
        "func_name", "normalized", F.col("modal_key").alias("code_id"))


def representative_rows(classed: DataFrame, order_col: str = "sub_id", code_col: str = "func_code") -> DataFrame:
    """J1 + filter: rows whose text is the most frequent
    text of their (question, class); rows without question or class drop out.
    Texts are compared through ``code_id`` (their SHA-256), so the shuffles
    carry 64-character keys instead of whole programs."""
    rep = representatives(classed, order_col)
    return (classed.join(rep, on=["func_name", "normalized", "code_id"], how="left_semi")
            .withColumn("representative", F.col(code_col)))


def last_duplicate(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """W6 ``drop_duplicates(key, keep='last')``: the last row per ``key`` in
    ``order`` (which must tell rows apart).  The last place of each key is
    found from the key and order columns alone; whole rows are picked by it."""
    last = df.groupBy(key).agg(F.max(F.struct(*order)).alias("_last"))
    marks = last.select(F.col(key).alias("_k"), *[F.col(f"_last.{c}").alias(f"_o{i}") for i, c in enumerate(order)])
    same = F.col(key).eqNullSafe(F.col("_k"))
    for i, c in enumerate(order):
        same = same & F.col(c).eqNullSafe(F.col(f"_o{i}"))
    return df.join(marks, same, "left_semi")


def unique_solutions(subs: DataFrame, canon: DataFrame, order_col: str = "sub_id",
                     code_col: str = "func_code") -> DataFrame:
    """A3: one row per class of equivalent programs
    (the last copy of its representative text in question/class/row order).
    Class, representative and last copy are chosen on ids; the rows are fetched
    once at the end."""
    ids = with_classes(subs.select(order_col, "func_name", "code_id"), canon)
    kept = ids.join(representatives(ids, order_col), on=["func_name", "normalized", "code_id"], how="left_semi")
    last = last_duplicate(kept, "code_id", ["func_name", "normalized", order_col]).select(order_col, "normalized")
    return subs.join(last, on=order_col, how="inner").withColumn("representative", F.col(code_col))
