"""A table of one row per key that takes batches of new rows by rewriting little: hash buckets, a log of deltas for each, and a manifest that is published at once.

A write puts its rows, by bucket, into a folder of its own; no folder that a manifest names is ever changed. Then a manifest of the next number, which lists the folders
of each bucket in order, is written beside the others and renamed to its final name: the write counts from then on or not at all. What a killed run leaves behind is in no
manifest and is never read. A batch has a tag, kept in the manifest with its rows, so a batch that runs again changes nothing.

Readers merge a bucket's folders, the last row of a key counts, and only buckets with several folders need a shuffle; `compact` makes one folder of those with too many.
Columns may be added over time: older rows lack them and read as null or as the defaults that are given. One writer at a time: a second one fails at the renaming.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GONE, BUCKET = "_gone", "_b"


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.number, found = self._newest()
        self.state = found or {"keys": keys, "buckets": buckets, "schema": None, "done": [], "folders": {}}
        if self.state["keys"] != keys:
            raise ValueError(f"the store's keys are {self.state['keys']}")

    # -- manifests

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    def _names(self, *parts: str) -> list[str]:
        where = self._at(*parts)
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def _newest(self) -> tuple[int, dict | None]:
        numbers = [int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json") and not n.startswith((".", "_"))]
        if not numbers:
            return 0, None
        stream = self._fs.open(self._at("manifest", f"{max(numbers):012d}.json"))
        try:
            return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        temporary, target = self._at("manifest", f"_{uuid.uuid4().hex}"), self._at("manifest", f"{self.number + 1:012d}.json")
        out = self._fs.create(temporary)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            raise RuntimeError("another writer has published first")
        self.number, self.state = self.number + 1, state

    # -- reading

    @property
    def schema(self) -> T.StructType | None:
        return T.StructType.fromJson(self.state["schema"]) if self.state["schema"] else None

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.state["buckets"])).cast("int")

    def _rows(self, buckets: dict[str, list[str]]) -> DataFrame:
        """The rows of the folders of some buckets, with the place of the folder in its bucket."""
        by_place: dict[tuple[str, int], list[str]] = {}
        for b, folders in buckets.items():
            for i, folder in enumerate(folders):
                by_place.setdefault((folder, i), []).append(f"{self.path}/{folder}/{BUCKET}={b}")
        schema = T.StructType([*self.schema.fields, T.StructField(GONE, T.BooleanType())])
        out = self.spark.createDataFrame([], schema).withColumn("_v", F.lit(0))
        for (_, i), paths in sorted(by_place.items()):
            out = out.unionByName(self.spark.read.schema(schema).parquet(*paths).withColumn("_v", F.lit(i)))
        return out

    def read(self, only: set[int] | None = None, defaults: dict | None = None) -> DataFrame | None:
        """The table, or that part of it in some buckets; None if nothing was ever written."""
        if self.schema is None:
            return None
        mine = {b: f for b, f in self.state["folders"].items() if only is None or int(b) in only}
        plain, several = ({b: f for b, f in mine.items() if (len(f) > 1) == many} for many in (False, True))
        names = self.schema.names
        out = self._rows(plain).where(f"not {GONE}").select(*names)
        if several:
            last = self._rows(several).groupBy(*self.keys).agg(F.max_by(F.struct(*(c for c in names if c not in self.keys), GONE), "_v").alias("x"))
            out = out.unionByName(last.where(f"not x.{GONE}").select(*self.keys, "x.*").select(*names))
        return out.fillna(defaults) if defaults else out

    def buckets_of(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()}  # as many as there are buckets at most

    def looked_up(self, asked: DataFrame) -> DataFrame:
        """asked with the columns of its keys; only the buckets of these are read."""
        return asked.join(self.read(self.buckets_of(asked)), self.keys, "left")

    # -- writing

    def _written(self, rows: DataFrame) -> tuple[str, list[str]]:
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self.bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        return folder, [n.split("=")[1] for n in self._names(folder) if n.startswith(f"{BUCKET}=")]

    def _grown(self, new: T.StructType) -> dict:
        """The schema with the columns that are new."""
        new = T.StructType([T.StructType.fromDDL(f"`{f.name}` {f.dataType.simpleString()}").fields[0] for f in new.fields])  # everything may be null
        old = self.schema
        if old is None:
            return new.jsonValue()
        have = {f.name: f.dataType for f in old.fields}
        for f in new.fields:
            if f.name in have and have[f.name] != f.dataType:
                raise ValueError(f"column {f.name} is of type {have[f.name].simpleString()}")
        return T.StructType([*old.fields, *(f for f in new.fields if f.name not in have)]).jsonValue()

    def upsert(self, rows: DataFrame, tag: str | None = None, gone: bool = False) -> bool:
        """Puts rows of distinct keys in place of those of equal keys, or takes these keys out; False if the tag's batch was taken before."""
        if tag is not None and tag in self.state["done"]:
            return False
        schema = self._grown(rows.schema)
        folder, touched = self._written(rows.withColumn(GONE, F.lit(gone)))
        folders = dict(self.state["folders"])
        for b in touched:
            folders[b] = [*folders.get(b, []), folder]
        self._publish(self.state | {"schema": schema, "folders": folders, "done": [*self.state["done"], *([tag] if tag is not None else [])]})
        return True

    def merge(self, rows: DataFrame, column: str, combine: Callable[[Column, Column], Column], tag: str | None = None) -> bool:
        """Rows whose `column` is combined with the stored one of their key; only the buckets of the rows' keys are read and written to."""
        if tag is not None and tag in self.state["done"]:
            return False
        if self.schema is not None:
            old = self.read(self.buckets_of(rows)).select(*self.keys, F.col(column).alias("_old"))
            rows = rows.join(old, self.keys, "left").withColumn(column, F.when(F.col("_old").isNull(), F.col(column)).otherwise(combine(F.col("_old"), F.col(column)))).drop("_old")
        return self.upsert(rows, tag)

    def remove(self, gone: DataFrame, on: list[str], tag: str | None = None) -> bool:
        """Takes out all rows that agree with `gone` in some of the key's columns."""
        if self.schema is None:
            return False
        return self.upsert(self.read().join(gone.select(*on).distinct(), on, "left_semi").select(*self.schema.names), tag, gone=True)

    def compact(self, most: int = 4) -> int:
        """Makes one folder of each bucket that has more than `most`; returns how many there were."""
        many = {b for b, f in self.state["folders"].items() if len(f) > most}
        if not many:
            return 0
        folder, left = self._written(self.read({int(b) for b in many}).withColumn(GONE, F.lit(False)))
        folders = {b: f for b, f in self.state["folders"].items() if b not in many} | {b: [folder] for b in left}
        self._publish(self.state | {"folders": folders})
        return len(many)

    def vacuum(self) -> int:
        """Deletes the folders that the newest manifest doesn't name; no reader or writer may be at work on an older one."""
        named = {f for folders in self.state["folders"].values() for f in folders}
        stray = [n for n in self._names("data") if f"data/{n}" not in named]
        for n in stray:
            self._fs.delete(self._at("data", n), True)
        return len(stray)
