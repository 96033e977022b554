"""Versioned tables (K2, K6, K8, K10, K13): Spark writes each new table state to
a folder of its own, and one small commit file makes a set of them current.

``root/data/<table>/...`` holds Parquet folders, ``root/commits/<n>.json`` names
the folder of every table in version n.  A commit file is created once and
never changed, so a reader sees whole versions only: whatever a job had written
when it was stopped is invisible until its commit file is there, and several
tables change together.  Each commit may carry the id of the batch it came
from; a batch that runs again finds itself committed and changes nothing.

Tables with ``buckets`` are written bucketed and sorted by their key columns,
so joins and groupings on the key read them without a shuffle.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskfold import schemas


class VersionedStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._registered: dict[str, str] = {}

    # ------------------------------------------------------------ commits --
    def _path(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self) -> list[int]:
        fs, p = self._path("commits")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def _load(self, version: int) -> dict | None:
        """The commit, or None for one whose writer was stopped half way."""
        fs, p = self._path("commits", f"{version:012d}.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            return None

    def history(self) -> list[int]:
        """Readable versions, oldest first."""
        return [v for v in self._names() if self._load(v) is not None]

    def state(self, version: int | None = None) -> dict:
        for v in reversed(self._names()):
            if version is None or v == version:
                found = self._load(v)
                if found is not None:
                    return found
        if version is not None:
            raise ValueError(f"no version {version} in {self.root}")
        return {"version": 0, "batches": {}, "tables": {}}

    def _publish(self, tables: dict, batches: dict) -> int:
        version = max(self._names(), default=0) + 1
        fs, p = self._path("commits", f"{version:012d}.json")
        out = fs.create(p, False)  # fails if another writer took this version
        try:
            out.write(bytearray(json.dumps({"version": version, "tables": tables, "batches": batches}).encode()))
        finally:
            out.close()
        return version

    # ------------------------------------------------------------- tables --
    def create(self, name: str, schema: T.StructType, keys: list[str], buckets: int = 0) -> None:
        """An empty typed table with its key columns, if it is missing;
        an existing one must have the same columns and keys."""
        state = self.state()
        found = state["tables"].get(name)
        if found is None:
            schemas.require_columns(self.spark.createDataFrame([], schema), keys)
            tables = state["tables"] | {name: {"path": None, "keys": list(keys), "buckets": buckets, "schema": schema.jsonValue()}}
            self._publish(tables, state["batches"])
        elif (T.StructType.fromJson(found["schema"]).simpleString(), found["keys"]) != (schema.simpleString(), list(keys)):
            raise ValueError(f"table {name} exists with other columns or keys")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        table = self.state(version)["tables"].get(name)
        if table is None:
            raise ValueError(f"no table {name} in {self.root}")
        schema = T.StructType.fromJson(table["schema"])
        if table["path"] is None:
            return self.spark.createDataFrame([], schema)
        path = f"{self.root}/{table['path']}"
        if not table["buckets"]:
            return self.spark.read.schema(schema).parquet(path)
        if path not in self._registered:
            keys = ", ".join(f"`{k}`" for k in table["keys"])
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self._registered[path] = view = f"versioned_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {view} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                           f"INTO {table['buckets']} BUCKETS LOCATION '{path}'")
        return self.spark.table(self._registered[path])

    def committed(self, batch: str, stream: str = "") -> bool:
        """Whether batch ``batch`` (numbers grow) of ``stream`` is in."""
        last = self.state()["batches"].get(stream)
        return last is not None and int(batch) <= int(last)

    def commit(self, changes: dict[str, DataFrame], batch: str | None = None, stream: str = "", allow_empty: bool = True) -> int:
        """Write the new contents of some tables and make them current
        together.  The others stay as they are.  K10: with ``allow_empty=False``
        an empty table is refused and nothing changes."""
        state = self.state()
        if batch is not None and self.committed(batch, stream):
            return state["version"]
        tables = dict(state["tables"])
        for name, df in changes.items():
            if name not in tables:
                raise ValueError(f"no table {name}: create it first")
            table = tables[name]
            df = schemas.conform(df, T.StructType.fromJson(table["schema"]))
            path = f"data/{name}/{uuid.uuid4().hex}"
            target = f"{self.root}/{path}"
            if table["buckets"]:
                view = f"versioned_{uuid.uuid4().hex}"
                (df.repartition(table["buckets"], *table["keys"]).write.bucketBy(table["buckets"], *table["keys"]).sortBy(*table["keys"])
                 .option("path", target).format("parquet").saveAsTable(view))
                self._registered[target] = view
            else:
                df.write.parquet(target)
            tables[name] = table | {"path": path}
            if not allow_empty:
                schemas.require_rows(self.spark.read.schema(df.schema).parquet(target), name)
        return self._publish(tables, state["batches"] | ({stream: str(batch)} if batch is not None else {}))

    def expire(self, keep: int = 2) -> int:
        """Delete the data that none of the ``keep`` newest versions names;
        returns the number of deleted folders."""
        versions = self.history()
        used = {t["path"] for v in versions[-keep:] for t in self._load(v)["tables"].values()}
        old = {t["path"] for v in versions[:-keep] for t in self._load(v)["tables"].values()} - used - {None}
        for path in sorted(old):
            view = self._registered.pop(f"{self.root}/{path}", None)
            if view:
                self.spark.sql(f"DROP TABLE IF EXISTS {view}")
            fs, p = self._path(path)
            fs.delete(p, True)
        for v in versions[:-keep]:
            fs, p = self._path("commits", f"{v:012d}.json")
            fs.delete(p, False)
        return len(old)
