"""S2 ``scan_json`` (and ``scan_json_lists`` for large documents) and S3 ``sink_json``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from progcorpus.session import checkpoint_dir


def scan_json(spark: SparkSession, path: str, schema: StructType | str | None = None,
              multi_line: bool = False, layout: str = "records") -> DataFrame:
    """JSON documents as a table.

    ``layout="records"``: a document is an object or a list of objects, one row
    each.  ``layout="columns"``: a document is one object of equally long
    arrays (``{"a": [..], "b": [..]}``), turned into rows with ``arrays_zip`` +
    ``inline``; ``schema`` then describes the arrays.  The layout is never
    guessed from the data.  One document per line is the splittable form;
    ``multi_line`` reads a whole file as one document, hence in one task.
    Give ``schema`` in production; inference reads the data twice.
    """
    if layout not in ("records", "columns"):
        raise ValueError(f"unknown JSON layout {layout!r}")
    reader = spark.read.option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    if layout == "records":
        return df
    fields = df.schema.fields
    if not all(isinstance(f.dataType, ArrayType) for f in fields):
        raise ValueError("the columns layout needs an array in every field")
    return df.select(F.inline(F.arrays_zip(*[F.col(f"`{f.name}`").alias(f.name) for f in fields])))


def _before(pieces: DataFrame, value, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the pieces before this one in its file, from
    sums inside each byte range and one row per range."""
    inside = Window.partitionBy("file", "start").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_v", value)
    offset = pieces.groupBy("file", "start").agg(F.sum("_v").alias("_o")).withColumn(
        "_o", F.coalesce(F.sum("_o").over(ranges), F.lit(0)))
    return (pieces.join(offset, on=["file", "start"], how="inner")
            .withColumn(name, F.col("_o") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_o"))


def scan_json_lists(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """S2 for large documents: files that hold a list of objects (or lists or objects one
    after another), on one line or many, read by many tasks each.

    A file is cut into pieces at every ``}``, which Spark does by byte ranges.  Whether a
    piece begins inside a string follows from the number of quotes before it, and its
    depth of brackets from the brackets outside of strings before it; both are prefix
    sums over the pieces (within each byte range, then over the ranges).  An object is
    what lies between two pieces that end outside of strings at the list's own
    depth.  Objects keep together across byte ranges; only one object is ever put
    together in a task.  The first byte of a file says whether it holds lists."""
    checkpoint_dir(spark)
    pieces = (spark.read.option("lineSep", "}").text(path)
              .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
              .withColumn("place", F.monotonically_increasing_id())
              .checkpoint(eager=True))                          # places are drawn once
    first = pieces.where(F.col("start") == 0).groupBy("file").agg(
        F.min(F.struct("place", F.substring(F.ltrim("value"), 1, 1).alias("c")))["c"].alias("_c"))
    bare = F.regexp_replace(F.concat("value", F.lit("}")), r"(?s)\\.", "")      # without escapes
    p = pieces.select("file", "start", "place", bare.alias("bare"))
    p = p.withColumn("quotes", F.length("bare") - F.length(F.translate("bare", '"', "")))
    p = _before(p, F.col("quotes"), "before")
    opened = F.when(F.col("before") % 2 == 1, F.lit('"')).otherwise(F.lit(""))
    p = p.withColumn("outside", F.regexp_replace(F.concat(opened, F.col("bare")), r'"[^"]*+(?:"|\z)', ""))
    # opening less closing brackets
    p = p.withColumn("step", F.length(F.translate("outside", "]}", "")) - F.length(F.translate("outside", "[{", "")))
    p = _before(p.drop("bare", "outside"), F.col("step"), "depth").join(first, on="file", how="inner")
    ends = (((F.col("before") + F.col("quotes")) % 2 == 0)
            & (F.col("depth") + F.col("step") == F.when(F.col("_c") == "[", 1).otherwise(0)))
    p = _before(p.withColumn("ends", ends).drop("_c"), F.col("ends").cast("int"), "number")
    whole = (p.select("file", "start", "place", "number", "ends").join(pieces, on=["file", "start", "place"], how="inner")
             .groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                 F.struct("start", "place", "value"))), lambda x: x["value"]), "}").alias("_t"), F.max("ends").alias("ends"))
             .where("ends"))
    text = F.concat(F.regexp_replace("_t", r"^[\s,\[\]]++", ""), F.lit("}"))
    return whole.select(F.from_json(text, schema).alias("_r")).select("_r.*")


def parse_json_column(df: DataFrame, col: str, schema: str, out: str | None = None) -> DataFrame:
    """JSON text column -> typed column (``from_json``)."""
    return df.withColumn(out or col, F.from_json(F.col(col), schema))


def sink_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: JSON Lines, one object per row (no pretty indentation)."""
    df.write.mode(mode).json(path)
