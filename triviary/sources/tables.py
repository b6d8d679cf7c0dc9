"""Readers and writers: pages, facts, JSON tables and maps, keyed tables, guarded and merged writes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import split
from .keyed import KeyedStore

FACT = "title STRING, kind STRING, source STRING, tabbed BOOLEAN, fields MAP<STRING, ARRAY<STRING>>, article_len BIGINT, summary STRING"
QUESTION = "category STRING, type STRING, difficulty STRING, question STRING, correct_answer STRING, incorrect_answers ARRAY<STRING>, options ARRAY<STRING>, source STRING, explainer STRING, image STRING, saga STRING, sagaOrder INT, authoredDifficulty STRING, difficultyScore INT"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one if that is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="triviary-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there and lost executors cost nothing before it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pages(spark: SparkSession, path: str, limit: int | None = None, columns: tuple[str, ...] = ("title", "ns", "text")) -> DataFrame:
    """Pages of a wiki dump, of which only the columns asked for are parsed; a limit of 0 or none reads all, any other stops each task early.

    One dump is read by as many tasks as it has byte ranges.
    """
    parsed = ["revision STRUCT<text: STRING>" if c == "text" else f"{c} STRING" for c in columns]
    rows = split.xml_records(spark, path, "page", ", ".join(parsed))
    rows = rows.select(*(F.col("revision.text").alias(c) if c == "text" else F.col(c) for c in columns))
    return rows.limit(limit) if limit else rows


def facts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of facts, whose fields hold a string or a list of strings; blank lines are skipped."""
    raw = spark.read.schema("title STRING, kind STRING, source STRING, tabbed BOOLEAN, fields MAP<STRING, STRING>, article_len BIGINT, summary STRING").json(path)
    return raw.withColumn("fields", F.transform_values("fields", lambda _, v: as_list(v)))


def as_list(v: Column) -> Column:
    return F.when(F.startswith(v, F.lit("[")), F.coalesce(F.from_json(v, "array<string>"), F.array(v))).otherwise(F.array(v))


def json_array(spark: SparkSession, path: str, schema: str = QUESTION) -> DataFrame:
    """The elements of a file that holds one JSON array, read by several tasks."""
    return split.json_elements(spark, path, schema)


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a file that holds one JSON object, read by several tasks; the value's type is a DDL string. Null values stay, unlike absent keys."""
    return split.json_entries(spark, path, value)


# The wiki's namespaces that hold no subjects.
NAMESPACES = ["talk", "user", "project", "file", "image", "mediawiki", "template", "help", "category", "forum", "board", "module", "gadget", "blog", "thread", "user blog", "message wall"]


def titles(spark: SparkSession, path: str) -> DataFrame:
    """Distinct keys of the <title> lines of a dump that name an article and not a page of another namespace or its talk page."""
    t = spark.read.text(path).select(F.regexp_extract("value", "<title>([^<]+)</title>", 1).alias("t")).where("t <> ''")
    # "talk" may lose its last letter; only a colon after it makes a namespace, so a bare "User:" is an article here
    plain = t.where(~F.col("t").rlike(rf"(?i)^(?:{'|'.join(NAMESPACES)})[ _]*talk?:"))
    return plain.select(F.regexp_replace(F.lower("t"), "[^a-z0-9]", "").alias("key")).where("key <> ''").distinct()


def write_json_array(df: DataFrame, path: str, order: list) -> None:
    """A folder of parts that are one JSON array if they are joined in the order of their names, for banks that a browser loads; nulls are left out.

    Sorted and written in parallel. A row only has to know whether it is the first or the last of all: a range that does is told by the counts of the ranges.
    """
    lines = written(df.orderBy(*order).select(F.to_json(F.struct(*df.columns)).alias("value"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")), "lines")
    ends = lines.agg(F.min("i").alias("a"), F.max("i").alias("z")).first()
    if ends["a"] is None:
        lines.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    before, after = F.when(F.col("i") == ends["a"], "[").otherwise(","), F.when(F.col("i") == ends["z"], "]").otherwise("")
    lines.repartitionByRange("i").sortWithinPartitions("i").select(F.concat(before, "value", after)).write.mode("overwrite").text(path)


def joined(spark: SparkSession, path: str, target: str) -> None:
    """The parts of a folder as one file, byte by byte, in the order of their names; only a buffer of them is held."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source, to = hadoop.fs.Path(path), hadoop.fs.Path(target)
    fs, out_fs = source.getFileSystem(conf), to.getFileSystem(conf)
    parts = sorted((s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    out = out_fs.create(to, True)
    try:
        for p in parts:
            part = fs.open(p)
            try:
                hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line, a file per partition; nulls are left out."""
    df.write.mode("overwrite").json(path)


def write_keyed(df: DataFrame, key: str, path: str) -> None:
    """A table of one row per key, clustered by it so that later merges and lookups read few files."""
    df.repartition(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def upserted(spark: SparkSession, path: str, batches: list[DataFrame], keys: list[str]) -> DataFrame:
    """A keyed table after each of the batches has been merged in and saved, so that a run that is killed goes on with the batches that are left.

    A batch writes to the buckets of its keys alone.
    """
    store = KeyedStore(spark, path, keys)
    for i, new in enumerate(batches, 1):
        store.upsert(new, str(i))
    store.compact()
    return store.read()


def state_of(spark: SparkSession, path: str, keys: tuple[str, ...] = ("k",)) -> tuple[DataFrame | None, int]:
    """The table below path and how many batches it holds."""
    store = KeyedStore(spark, path, list(keys))
    return store.read(), len(store.state["done"])


def looked_up(asked: DataFrame, store: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """asked keys with the store's value, or the default where there is none."""
    s = store.select(F.col(key).alias("_k"), F.col(value).alias(value))
    return asked.join(s, asked[key] == s["_k"], "left").drop("_k").withColumn(value, F.coalesce(F.col(value), default))


def write_guarded(df: DataFrame, write: Callable[[DataFrame], None], failures: DataFrame | None = None, check_only: bool = False) -> int:
    """Writes only if there are rows and no failures; returns the number of rows."""
    n = df.count()
    if not n:
        raise ValueError("refusing to write no rows")
    if failures is not None and (bad := failures.limit(20).collect()):
        raise ValueError(f"refusing to write: {[r.asDict() for r in bad]}")
    if not check_only:
        write(df)
    return n


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of equal keys."""
    return old.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def resolved(asked: DataFrame, aliases: DataFrame, found: DataFrame) -> DataFrame:
    """asked titles with the url of the title or of what it is an alias of; aliases (alias, title, ord): the last wins."""
    a = last_of(aliases, ["alias"], "ord").select("alias", F.col("title").alias("_to"))
    f = found.select(F.col("title").alias("_t"), "url")
    return asked.join(a, asked["title"] == a["alias"], "left").withColumn("_look", F.coalesce("_to", "title")).join(f, F.col("_look") == F.col("_t"), "left").select("title", "url")


def write_batches(rows: DataFrame, path: str) -> None:
    """A folder of text per batch: rows (batch, n, value)."""
    rows.repartition("batch").sortWithinPartitions("batch", "n").select("batch", "value").write.mode("overwrite").partitionBy("batch").text(path)


def verdicts(spark: SparkSession, glob: str) -> DataFrame:
    """(rater, batch, n, knowledge_score, guessable, reason) from files named rater.batch.json."""
    raw = spark.read.schema("ratings ARRAY<STRUCT<n: INT, knowledge_score: INT, guessable: BOOLEAN, reason: STRING>>").option("multiLine", True).json(glob)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return raw.select(F.substring_index(stem, ".", 1).alias("rater"), F.substring_index(stem, ".", -1).alias("batch"), F.explode("ratings").alias("r")).select("rater", "batch", "r.*")


def file_md5(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


_remembered: dict[tuple[str, str], DataFrame] = {}


def remembered(spark: SparkSession, name: str, load: Callable[[], DataFrame]) -> DataFrame:
    """What load() gives, cached and given again to all who ask by this name in the application; a load that fails isn't remembered."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _remembered:
        _remembered[key] = load().cache()
    return _remembered[key]
