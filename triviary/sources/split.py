"""Large single files read in parallel: a file is cut where a closing mark ends, at any byte range, and records are put together from the pieces.

XML dumps: a record ends with its closing tag, so Spark's text source with that tag as line separator gives each task the records that start in its range.

JSON arrays and objects: a piece ends with a closing brace, but whether that ends an element depends on all that stands before it. A piece's effect on the lexer is
small: whether it leaves a string open, and how it changes the depth, for either state in which it may begin. These effects are composed by running sums, within a
block of the file and then over the few blocks of the file, so that every piece learns its state without anyone reading the file in order. Pieces up to one
that comes back to the outermost level make a group; a group holds whole elements and is parsed on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def xml_records(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """One row per <tag> element, with the fields of the schema (a DDL string); elements of the tag mustn't lie in each other.

    Every record is read by the task in whose byte range it starts.
    """
    piece = spark.read.option("lineSep", f"</{tag}>").text(path)
    # what stands before the tag is the file's head or the space between records; the rest behind the last record holds no tag
    inner = F.regexp_extract("value", rf"(?s)<{tag}(?:\s[^>]*)?>(.*)$", 1)
    found = piece.where(F.col("value").rlike(rf"<{tag}[\s>]")).select(inner.alias("x"))
    return found.select(F.from_xml(F.concat(F.lit(f"<{tag}>"), "x", F.lit(f"</{tag}>")), schema, {"rowTag": tag}).alias("r")).select("r.*")


def _count(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def _groups(spark: SparkSession, path: str) -> DataFrame:
    """(file, g, body): runs of whole elements of the outermost array or object of each file, without its brackets."""
    raw = spark.read.option("lineSep", "}").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    # what the lexer sees: no escapes, and strings only by their quotes; the separator's brace is gone from the value
    bare = F.regexp_replace("value", r"\\.", "")
    outside = lambda c: F.regexp_replace(c, r'(?s)"[^"]*("|$)', "")
    depth = lambda c: (_count(c, "{[") - _count(c, "}]")).cast("long")
    p = raw.withColumn("bare", bare).withColumn("odd", _count(F.col("bare"), '"') % 2)
    p = p.withColumn("d0", depth(outside(F.col("bare")))).withColumn("d1", depth(outside(F.regexp_replace("bare", r'(?s)^[^"]*("|$)', "")))).drop("bare")
    # the closing brace counts unless the piece leaves a string open
    effect = lambda s: F.when(F.lit(s) == 0, F.col("d0")).otherwise(F.col("d1")) - F.when((F.lit(s) + F.col("odd")) % 2 == 0, 1).otherwise(0)
    p = p.withColumn("e0", effect(0)).withColumn("e1", effect(1)).drop("d0", "d1")
    own = Window.partitionBy("file", "block").orderBy("i")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("flip", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    for s in (0, 1):
        p = p.withColumn(f"s{s}", F.sum(F.when((F.col("flip") + s) % 2 == 0, F.col("e0")).otherwise(F.col("e1"))).over(own))
    # the state at the beginning of each block: the same composition over the blocks, a row each
    last = p.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd"), F.max_by("s0", "i").alias("t0"), F.max_by("s1", "i").alias("t1"))
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = last.withColumn("in", F.coalesce(F.sum("odd").over(over), F.lit(0)) % 2)
    start = start.withColumn("base", F.coalesce(F.sum(F.when(F.col("in") == 0, F.col("t0")).otherwise(F.col("t1"))).over(over), F.lit(0))).select("file", "block", "in", "base")
    p = p.join(start, ["file", "block"])
    level = F.col("base") + F.when(F.col("in") == 0, F.col("s0")).otherwise(F.col("s1"))
    quoted = (F.col("in") + F.col("flip") + F.col("odd")) % 2 == 1
    p = p.select("file", "block", "i", "value", ((level <= 1) & ~quoted).cast("int").alias("ends"), level.alias("level"), quoted.alias("quoted"))
    # a group is numbered by the ends before it: in the block, and in the blocks before
    p = p.withColumn("n", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    counts = p.groupBy("file", "block").agg(F.sum("ends").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(over), F.lit(0))).select("file", "block", "before")
    p = p.join(counts, ["file", "block"]).withColumn("g", F.col("n") + F.col("before"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "i", "value"))), lambda x: x["value"]), "}")
    whole = p.groupBy("file", "g").agg(joined.alias("t"), F.max("ends").alias("ends"), F.min("level").alias("level"))
    # an end at depth 1 closes an element, one at depth 0 the outermost object; without an end the rest of an array's file is left
    body = F.when((F.col("ends") == 1) & (F.col("level") >= 1), F.concat("t", F.lit("}"))).otherwise(F.regexp_replace("t", r"\]\s*$", ""))
    first = F.when(F.col("g") == 0, F.regexp_replace(body, r"^\x{FEFF}?\s*[\[{]", "")).otherwise(body)
    return whole.select("file", "g", F.regexp_replace(F.regexp_replace(first, r"^[\s,]+", ""), r"[\s,]+$", "").alias("body")).where("body <> ''")


def json_elements(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per element of the JSON arrays in the files; schema: of an element, as a DDL string."""
    found = _groups(spark, path).select(F.explode(F.from_json(F.concat(F.lit("["), "body", F.lit("]")), f"array<struct<{_fields(schema)}>>")).alias("r"))
    return found.select("r.*")


def _fields(schema: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema))


def json_entries(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of the JSON objects in the files; the value's type is a DDL string."""
    return _groups(spark, path).select(F.explode(F.from_json(F.concat(F.lit("{"), "body", F.lit("}")), f"map<string, {value}>")))
