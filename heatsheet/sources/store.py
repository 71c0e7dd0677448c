"""Stored tables that change together or not at all, and bucket by bucket.

Data folders of a store are written once and never changed. Numbered manifests say which of them
make up each table; the one with the highest number is the state of all tables. A change
writes new data folders first and then one manifest, which is created only if that number is
not taken. So a reader, who follows one manifest, sees the state before or after a change and never
between; a change that fails on its way leaves the old state; and of two changes that start
from the same state the second is refused (``Conflict``) and can be made again from the new one.

Rows are dealt to buckets by a hash of their whole primary key, so one driver's runs lie in all of them.
A change of some keys writes the buckets of these keys anew and leaves the files of all others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatsheet import schemas

_BUCKET = "store_bucket"
_MANIFESTS = "manifests"


class Conflict(RuntimeError):
    """Another change of the store was committed first."""


def bucket_of(table: str, buckets: int) -> F.Column:
    """The bucket of a row, by its primary key in the stored types, or as the row names it."""
    if table in schemas.FOLLOWED_BUCKETS:
        return F.col(schemas.FOLLOWED_BUCKETS[table]).cast("int")
    types = {f.name: f.dataType for f in schemas.STORED[table].fields}
    keys = [F.col(k).cast(types[k]) for k in schemas.STORED_KEYS[table]]
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Store:
    """The tables of ``schemas.STORED`` in ``folder``, which all executors must share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    # Files, by the file systems that Spark itself uses.

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        files = path.getFileSystem(self._conf)
        if not files.exists(path):
            return []
        return [f.getPath().getName() for f in files.listStatus(path)]

    def _create(self, text: str, name: str) -> None:
        """A whole file under a name that was free, or ``Conflict``."""
        hidden, path = self._path(_MANIFESTS, f".{uuid.uuid4().hex}"), self._path(_MANIFESTS, name)
        out = path.getFileSystem(self._conf).create(hidden)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            path.getFileSystem(self._conf).getUri(), self._conf
        )
        try:
            context.rename(hidden, path, self.spark._sc._gateway.new_array(
                getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0
            ))
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            raise Conflict(f"version {name} was committed by another change") from error

    # States.

    def version(self) -> int:
        """The number of the last change, 0 for an empty store."""
        return max((int(n) for n in self._names(_MANIFESTS) if n.isdigit()), default=0)

    def state(self, version: int | None = None) -> dict[str, dict]:
        """For each table its number of buckets, and the data folders of each bucket."""
        version = self.version() if version is None else version
        if not version:
            return {}
        path = f"{self.folder}/{_MANIFESTS}/{version:010d}"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._rows(table, self.state(version))

    def files(self, table: str, version: int | None = None) -> dict[str, list[str]]:
        """Data folders of every bucket."""
        return self.state(version).get(table, {}).get("folders", {})

    def _rows(self, table: str, state: dict, buckets: list[str] | None = None) -> DataFrame:
        folders = state.get(table, {}).get("folders", {})
        paths = [
            f"{self.folder}/{p}" for b, ps in folders.items() if buckets is None or b in buckets for p in ps
        ]
        schema = schemas.STORED[table]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # Changes.

    def change(self) -> Change:
        """A change from the present state. Nothing is seen of it until it is committed."""
        return Change(self)

    def transact(self, work: Callable[[Change], Any], attempts: int = 5) -> tuple[Any, int]:
        """``work`` on a change, committed. After a conflict it is done again from the new state. Returns
        its result and the number of the new state."""
        for left in reversed(range(attempts)):
            change = self.change()
            result = work(change)
            try:
                return result, change.commit()
            except Conflict:
                if not left:
                    raise
        raise ValueError("at least one attempt is needed")


class Change:
    def __init__(self, store: Store) -> None:
        self.store = store
        self.base = store.version()
        self.state = store.state(self.base)

    def read(self, table: str, buckets: list[str] | None = None) -> DataFrame:
        """A table, or some buckets of it, as this change has left it so far."""
        return self.store._rows(table, self.state, buckets)

    def buckets(self, table: str) -> int:
        """The number of buckets of a table, 0 if there is none."""
        return self.state.get(table, {}).get("buckets", 0)

    def create(self, df: DataFrame, table: str, buckets: int = 1) -> None:
        """A table of these rows, whether there is one or not."""
        self.state[table] = {"buckets": buckets, "folders": {}}
        self.append(df, table)

    def append(self, df: DataFrame, table: str) -> None:
        entry = self._entry(table)
        for bucket, folder in self._write(df, table).items():
            entry["folders"][bucket] = entry["folders"].get(bucket, []) + [folder]

    def rewrite(
        self, table: str, keys: DataFrame, work: Callable[[DataFrame], DataFrame]
    ) -> list[str]:
        """Replace the buckets of ``keys`` by ``work`` of their rows, and return which they are. ``work``
        must keep a row's key. No more than the table's number of buckets is collected."""
        entry = self._entry(table)
        found = keys.select(bucket_of(table, entry["buckets"]).alias(_BUCKET)).distinct().collect()
        touched = sorted({str(r[0]) for r in found} & set(entry["folders"]), key=int)
        if touched:
            written = self._write(work(self.store._rows(table, self.state, touched)), table)
            stray = set(written) - set(touched)
            if stray:
                raise ValueError(f"rows of {table} moved to the buckets {sorted(stray)}")
            for bucket in touched:
                entry["folders"][bucket] = [written[bucket]] if bucket in written else []
        return touched

    def replace(self, table: str, buckets: list[str], df: DataFrame) -> None:
        """Make ``df`` all there is in some buckets of a table, which other buckets' rows must not be in."""
        entry = self._entry(table)
        written = self._write(df, table)
        stray = set(written) - set(buckets)
        if stray:
            raise ValueError(f"rows of {table} belong to the buckets {sorted(stray)}")
        for bucket in buckets:
            entry["folders"][bucket] = [written[bucket]] if bucket in written else []

    def commit(self) -> int:
        """Make the change seen, or raise ``Conflict`` if another one came first."""
        self.store._create(json.dumps(self.state), f"{self.base + 1:010d}")
        return self.base + 1

    def _entry(self, table: str) -> dict:
        # A new entry, so that the state of a failed attempt is never that of another.
        entry = self.state.get(table, {"buckets": 1, "folders": {}})
        self.state[table] = {"buckets": entry["buckets"], "folders": dict(entry["folders"])}
        return self.state[table]

    def _write(self, df: DataFrame, table: str) -> dict[str, str]:
        """A new data folder with one part for each bucket, by bucket."""
        name, buckets = f"{table}-{uuid.uuid4().hex}", self.state[table]["buckets"]
        rows = df.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.STORED[table].fields]
        ).withColumn(_BUCKET, bucket_of(table, buckets))
        if buckets > 1:
            rows = rows.repartition(_BUCKET)
        rows.write.partitionBy(_BUCKET).parquet(f"{self.store.folder}/{name}")
        parts = [n for n in self.store._names(name) if n.startswith(f"{_BUCKET}=")]
        return {n.partition("=")[2]: f"{name}/{n}" for n in parts}
