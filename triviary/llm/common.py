"""Helpers shared by the operators: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives the executors this package's code, once per application; they need no installation."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parents[1]
        with tempfile.NamedTemporaryFile(prefix=f"{top.name}-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(f.name)
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one if that is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="triviary-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lost executors cost no recomputation of what led to it.

    paths: takes the table's path, for those that are removed once what is made of them is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_path() named."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def swept(spark: SparkSession) -> None:
    """Lets go of the shuffle files of queries that have ended: Spark keeps them until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from df's columns (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def free(df: DataFrame, *names: str) -> None:
    """Raises ValueError if df has a column of a name that an operator adds: the names of results can be chosen, so none is renamed silently."""
    if clash := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"the table has columns named {', '.join(sorted(clash))}; choose other names for the results")


#: What an operator keeps in a worker between its tasks: operator -> what drops it.
_kept: dict[str, Callable[[], None]] = {}
_owner = ""


def keeps(name: str, drop: Callable[[], None]) -> None:
    """Names what drops the memory that an operator keeps in this process."""
    _kept[name] = drop


def claim(name: str) -> None:
    """An operator begins a task: what other operators keep in this worker is dropped and goes back to the system.

    Workers are used again by later stages, so without this the models of all stages would lie beside each other.
    """
    global _owner
    if _owner == name:
        return
    _owner = name
    for other, drop in _kept.items():
        if other != name:
            drop()
    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def slices(batches: Iterator[pa.RecordBatch], column: int | str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose `column` holds about `most` bytes, so that memory doesn't follow the batch size."""
    for batch in batches:
        start, size = 0, 0
        # a string array's offsets tell each row's bytes without reading it
        col = batch.column(column)
        lens = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        for i, n in enumerate(lens):
            size += n
            if size >= most:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < len(lens):
            yield batch.slice(start)
