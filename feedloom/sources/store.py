"""A keyed table that can be changed: buckets of Parquet files, copied on write, under manifests.

A manifest names every bucket's folders. A mutation writes new folders beside the old ones and then puts the next
manifest in place by a rename that never overwrites, which is atomic wherever the file system's rename is. So a reader
sees one whole version, a writer that dies leaves the table as it was, and of two writers the later one finds its number
taken: it goes on from the new version if the other changed other buckets, else it starts again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import sinks

#: Attempts of a mutation that others overtake.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer changed the same buckets first."""


class Store:
    """A table of rows with a key that no two rows share; `path` is a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- files of the driver: manifests, a few bytes for each bucket

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str:
        stream = self._fs().open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, body: str) -> bool:
        """Write a file and rename it into place; False where there is one of that name."""
        jvm, part = self.spark._jvm, self._at(f"_manifests/.{uuid.uuid4().hex}")
        stream = self._fs().create(part, False)
        stream.write(bytearray(body.encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(part, self._at(name), plain)
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self._fs().delete(part, False)
            return False

    def versions(self) -> list[int]:
        fs, at = self._fs(), self._at("_manifests")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no table at {self.path}")
        return json.loads(self._read(f"_manifests/{found[-1] if version is None else version:012d}.json"))

    # --- reading

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType | str, key: list[str], buckets: int | None = None) -> Store:
        """An empty table, of as many buckets as the session has shuffle partitions if no number is given.

        Of two that create one, the second finds the first's; its schema must be the same.
        """
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        store = cls(spark, path)
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        first = {"version": 0, "schema": T.StructType([T.StructField(f.name, f.dataType) for f in schema]).json(), "key": key, "n": buckets, "buckets": {}, "done": {}}
        if not store._put(f"_manifests/{0:012d}.json", json.dumps(first)):
            there = store.manifest(0)
            if (there["schema"], there["key"]) != (first["schema"], key):
                raise ValueError(f"there is another table at {path}")
        return store

    @classmethod
    def of(cls, rows: DataFrame, path: str, key: list[str], buckets: int | None = None, unique: bool = True) -> Store:
        """A table with these rows; of rows with one key any one stays, or all where keys need not be `unique`."""
        store = cls.create(rows.sparkSession, path, rows.schema, key, buckets)
        store.insert_ignore(rows, key) if unique else store.append(rows, ("load", 0))
        return store

    def _bucket(self, m: dict) -> Column:
        return F.pmod(F.xxhash64(*m["key"]), F.lit(m["n"])).cast("int")

    def _rows(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        dirs = [f"{self.path}/{d}" for b, ds in sorted(m["buckets"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets for d in ds]
        return self.spark.read.schema(schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], schema)

    def rows(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the newest; what is read stays the same whatever is written meanwhile."""
        return self._rows(self.manifest(version))

    # --- writing

    def _written(self, rows: DataFrame, m: dict) -> tuple[str, dict[int, str]]:
        folder = f"data/{uuid.uuid4().hex}"
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in T.StructType.fromJson(json.loads(m["schema"]))))
        placed = rows.withColumn("bucket", self._bucket(m))
        placed.repartition(min(m["n"], 4096), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs().listStatus(self._at(folder))]
        return folder, {int(n.removeprefix("bucket=")): f"{folder}/{n}" for n in names if n.startswith("bucket=")}

    def _committed(self, base: dict, read: set[int], change: Callable[[dict], None], done: dict[str, int]) -> int:
        """Put the next manifest in place; `read` are the buckets that must not have changed since `base`."""
        while True:
            m = self.manifest()
            moved = {int(b) for b in set(m["buckets"]) | set(base["buckets"]) if m["buckets"].get(b) != base["buckets"].get(b)}
            if moved & read or any(m["done"].get(k, -1) >= v for k, v in done.items()):
                raise Conflict(f"version {m['version']} changed what was read at {base['version']}")
            change(m["buckets"])
            m["done"] |= done
            m["version"] += 1
            if self._put(f"_manifests/{m['version']:012d}.json", json.dumps(m)):
                return m["version"]

    def _mutate(self, step, batch: tuple[str, int] | None = None) -> int:
        """Run `step(manifest)` -> (rows, replaced buckets, read buckets) until it is committed; the version it made.

        `batch` is (writer, number): a number that is not above the writer's last one is done already and changes nothing.
        """
        for _ in range(ATTEMPTS):
            base = self.manifest()
            if batch and base["done"].get(batch[0], -1) >= batch[1]:
                return base["version"]
            rows, replaced, read = step(base)
            folder, made = self._written(rows, base) if rows is not None else (None, {})

            def change(buckets: dict, replaced=replaced, made=made) -> None:
                for b in replaced:
                    buckets.pop(str(b), None)
                for b, d in made.items():
                    buckets.setdefault(str(b), []).append(d)

            try:
                if not made and not replaced and not batch:
                    return base["version"]
                return self._committed(base, set(read), change, dict([batch]) if batch else {})
            except Conflict:
                if folder:
                    self._fs().delete(self._at(folder), True)
        raise Conflict(f"overtaken {ATTEMPTS} times")

    def _touched(self, rows: DataFrame, m: dict) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket(m).alias("b")).distinct().collect())  # at most the buckets

    def append(self, rows: DataFrame, batch: tuple[str, int]) -> int:
        """Add rows whose keys are new for certain, once for each (writer, number): a replay changes nothing."""
        return self._mutate(lambda m: (rows, [], []), batch)

    def insert_ignore(self, new: DataFrame, order: list[str], batch: tuple[str, int] | None = None) -> int:
        """Add the rows whose key is new, of several the first in order. Reads the keys of touched buckets, rewrites none."""

        def step(m):
            touched = self._touched(new, m)
            old = self._rows(m, touched).select(*m["key"])
            fresh = sinks.insert_ignore(self.spark.createDataFrame([], T.StructType.fromJson(json.loads(m["schema"]))), new.join(old, m["key"], "left_anti"), m["key"], order)
            return fresh, [], touched

        return self._mutate(step, batch)

    def _rewrite(self, touching: Callable[[dict], DataFrame], change: Callable[[DataFrame], DataFrame], batch=None) -> int:
        def step(m):
            touched = self._touched(touching(m), m)
            return change(self._rows(m, touched)), touched, touched

        return self._mutate(step, batch)

    def upsert(self, new: DataFrame, version: str, batch: tuple[str, int] | None = None) -> int:
        """One row per key, the newest by `version`."""
        return self._rewrite(lambda m: new, lambda old: sinks.upsert(old, new, self.manifest()["key"], version), batch)

    def update(self, values: DataFrame, columns: list[str], reset_stale: bool = False, batch: tuple[str, int] | None = None) -> int:
        """Set columns of the rows whose key (one column) is in `values`; with `reset_stale` all others lose theirs."""
        key = self.manifest()["key"][0]
        touching = (lambda m: self._rows(m).select(*m["key"])) if reset_stale else (lambda m: values)
        return self._rewrite(touching, lambda old: sinks.update(old, values, key, columns, reset_stale), batch)

    def mark(self, keys: DataFrame, column: str, value, batch: tuple[str, int] | None = None) -> int:
        """Set a column of the rows whose key (one column) is listed."""
        key = self.manifest()["key"][0]
        return self._rewrite(lambda m: keys, lambda old: sinks.marked(old, keys, key, column, value), batch)

    def partial_upsert(self, new: DataFrame, replace: list[str], batch: tuple[str, int] | None = None) -> int:
        """Replace some columns of known keys (one column), add rows of new ones."""
        key = self.manifest()["key"][0]
        return self._rewrite(lambda m: new, lambda old: sinks.partial_upsert(old, new, key, replace), batch)

    def delete(self, keys: DataFrame, columns: list[str] | None = None, batch: tuple[str, int] | None = None) -> int:
        """Delete rows whose key is listed, or whose `columns` are: then only these and the key are read to find buckets."""
        by = columns or self.manifest()["key"]
        listed = keys.select(*by).distinct()
        touching = (lambda m: self._rows(m).select(*{*m["key"], *by}).join(listed, by, "left_semi")) if columns else (lambda m: listed)
        return self._rewrite(touching, lambda old: sinks.deleted(old, listed, by), batch)

    def retain(self, time: str, cutoff, batch: tuple[str, int] | None = None) -> int:
        """Delete rows older than the cutoff, or of no time; buckets without any are left alone."""
        gone = ~F.coalesce(F.col(time) >= cutoff, F.lit(False))
        return self._rewrite(lambda m: self._rows(m).filter(gone), lambda old: sinks.retained(old, time, cutoff), batch)

    def cascade(self, parents: DataFrame, child_key: str, parent_key: str, batch: tuple[str, int] | None = None) -> int:
        """Delete rows whose parent is gone."""
        p = parents.select(F.col(parent_key).alias("__parent")).distinct()
        orphans = lambda m: (r := self._rows(m).select(*{*m["key"], child_key})).join(p, r[child_key] == p["__parent"], "left_anti")
        return self._rewrite(orphans, lambda old: sinks.cascaded(old, parents, child_key, parent_key), batch)

    def compact(self, most_folders: int = 8) -> int:
        """Rewrite buckets that inserts have left in more folders than that."""

        def step(m):
            many = [int(b) for b, ds in m["buckets"].items() if len(ds) > most_folders]
            return (self._rows(m, many) if many else None), many, many

        return self._mutate(step)

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the newest `keep` manifests, and the folders that none of these names; how many folders went.

        Only when no writer is at work: folders that are not committed yet are named by no manifest either.
        """
        found = self.versions()
        kept = found[-keep:]
        named = {d for v in kept for ds in self.manifest(v)["buckets"].values() for d in ds}
        fs, gone = self._fs(), 0
        for v in found[:-keep]:
            fs.delete(self._at(f"_manifests/{v:012d}.json"), False)
        if not fs.exists(self._at("data")):
            return 0
        for folder in fs.listStatus(self._at("data")):
            name = folder.getPath().getName()
            parts = [p.getPath() for p in fs.listStatus(folder.getPath())]
            buckets = [p for p in parts if p.getName().startswith("bucket=")]
            stale = [p for p in buckets if f"data/{name}/{p.getName()}" not in named]
            for p in parts if len(stale) == len(buckets) else stale:
                fs.delete(p, True)
            if len(stale) == len(buckets):
                fs.delete(folder.getPath(), True)
            gone += len(stale)
        return gone
