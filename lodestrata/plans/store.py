"""Tables in buckets of their keys' hashes, under one manifest that changes as a whole.

A commit writes its data beside what is there and then a new manifest, by a rename. So tables, logs of pages and the state
of what fills them change together: after a crash at any place a reader sees all of a commit or nothing of it. One writer at
a time; that is what jobs.run is for.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans.upsert import KEYS, UPDATED, upsert
from lodestrata.schemas import conform, schema
from lodestrata.tables import exists, file_system, names, remove

BUCKETS = 64
#: What a log holds beside a table's columns: when a row was updated, and in which page it came.
LOGGED = "__updated timestamp, __page bigint"
_EMPTY = {"tables": {}, "logs": {}, "state": {}, "pages": {}}


@dataclass(frozen=True)
class Store:
    """buckets is fixed when a table is first written; a bucket is a folder, of which the manifest names the present one."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def version(self) -> int:
        """The newest manifest's number; -1: none."""
        return max((int(x[:-5]) for x in names(self.spark, f"{self.path}/manifest") if x.endswith(".json")), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version < 0:
            return json.loads(json.dumps(_EMPTY))
        fs, p = file_system(self.spark, f"{self.path}/manifest/{version:09d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, version: int, manifest: dict) -> None:
        """The manifest of a new version: written under a name of its own, then renamed."""
        fs, part = file_system(self.spark, f"{self.path}/manifest/{uuid.uuid4().hex}.part")
        stream = fs.create(part)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        _, whole = file_system(self.spark, f"{self.path}/manifest/{version:09d}.json")
        if fs.exists(whole) or not fs.rename(part, whole):
            raise RuntimeError(f"another writer has written version {version} of {self.path}")

    def base(self, table: str, manifest: dict, only: set[int] | None = None) -> DataFrame:
        """A table's buckets, or some of them, without its log."""
        held = manifest["tables"].get(table, {})
        paths = [f"{self.path}/data/{table}/{d}" for b, d in held.items() if only is None or int(b) in only]
        return self.spark.read.schema(schema(table)).parquet(*paths) if paths else self.spark.createDataFrame([], schema(table))

    def log(self, table: str, manifest: dict) -> DataFrame | None:
        paths = [f"{self.path}/log/{table}/{d}" for d in manifest["logs"].get(table, [])]
        ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema(table)])
        return self.spark.read.schema(f"{ddl}, {LOGGED}").parquet(*paths) if paths else None

    def merged(self, table: str, base: DataFrame, rows: DataFrame) -> DataFrame:
        """Of a key's rows in the log the latest by update, then by page, counts."""
        order = [F.col("__updated").desc_nulls_last(), F.desc("__page"), F.desc(F.to_json(F.struct(*sorted(rows.columns))))]
        return upsert(base, rows, KEYS[table], UPDATED[table], order)

    def read(self, table: str) -> DataFrame:
        """The table with what its log adds; empty where nothing was written."""
        manifest = self.manifest()
        base, rows = self.base(table, manifest), self.log(table, manifest)
        return base if rows is None else self.merged(table, base, rows)

    def append(self, stage: str, run: str, page: int, rows: dict[str, DataFrame], state: dict) -> dict:
        """Add a page's rows to the tables' logs, with the stage's state, in one commit; returns the state as it stands.

        rows: by table, with __updated. state's "count" is added to the stage's. A page that a run has committed before
        changes nothing, so that a stream may give it again.
        """
        version = self.version()
        manifest = self.manifest(version)
        if manifest["pages"].get(f"{stage} {run}", -1) >= page:
            return manifest["state"].get(stage, {})
        for table, df in rows.items():
            folder = f"{stage}-{page}-{uuid.uuid4().hex}"
            conform(df, table, "__updated").withColumn("__page", F.lit(version + 1).cast("long")).write.parquet(f"{self.path}/log/{table}/{folder}")
            manifest["logs"].setdefault(table, []).append(folder)
        before = manifest["state"].get(stage, {})
        manifest["state"][stage] = {**before, **state, "count": before.get("count", 0) + state.get("count", 0)}
        manifest["pages"][f"{stage} {run}"] = page
        self.put(version + 1, manifest)
        return manifest["state"][stage]

    def state(self) -> dict:
        return self.manifest()["state"]

    def set_state(self, stage: str, **values) -> dict:
        version = self.version()
        manifest = self.manifest(version)
        manifest["state"][stage] = manifest["state"].get(stage, {}) | values
        self.put(version + 1, manifest)
        return manifest["state"][stage]

    def compact(self, table: str) -> list[int]:
        """Take the log into the buckets that its keys fall in, and only those are written anew; returns them."""
        version = self.version()
        manifest = self.manifest(version)
        rows = self.log(table, manifest)
        if rows is None:
            return []
        bucket = F.pmod(F.xxhash64(*KEYS[table]), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in rows.select(bucket.alias("b")).distinct().collect())  # at most as many as there are buckets
        merged = self.merged(table, self.base(table, manifest, set(touched)), rows)
        folder = uuid.uuid4().hex
        merged.withColumn("__bucket", bucket).repartition(max(1, len(touched)), "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{table}/{folder}")
        manifest["tables"].setdefault(table, {}).update({str(b): f"{folder}/__bucket={b}" for b in touched})
        manifest["logs"][table] = []
        self.put(version + 1, manifest)
        return touched

    def delete(self, table: str, repo_id: int) -> None:
        """Take a repository's rows out of a table, log included."""
        self.compact(table)
        version = self.version()
        manifest = self.manifest(version)
        left = self.base(table, manifest).where(F.col("repo_id") != repo_id)
        bucket = F.pmod(F.xxhash64(*KEYS[table]), F.lit(self.buckets)).cast("int")
        folder = uuid.uuid4().hex
        left.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{table}/{folder}")
        kept = [x for x in names(self.spark, f"{self.path}/data/{table}/{folder}") if x.startswith("__bucket=")]
        manifest["tables"][table] = {x.split("=")[1]: f"{folder}/{x}" for x in kept}
        self.put(version + 1, manifest)

    def forget(self, prefix: str = "") -> None:
        """Drop the state and page marks of the stages whose names begin so."""
        version = self.version()
        manifest = self.manifest(version)
        for part in ("state", "pages"):
            manifest[part] = {k: v for k, v in manifest[part].items() if not k.startswith(prefix)}
        self.put(version + 1, manifest)

    def clean(self, keep: int = 2) -> None:
        """Remove what the last `keep` manifests don't name: former versions, and what crashes left."""
        newest = self.version()
        manifests = [self.manifest(v) for v in range(max(0, newest - keep + 1), newest + 1)]
        for kind in ("data", "log"):
            for table in names(self.spark, f"{self.path}/{kind}"):
                named = {d.split("/")[0] for m in manifests for d in (m["tables"].get(table, {}).values() if kind == "data" else m["logs"].get(table, []))}
                for folder in set(names(self.spark, f"{self.path}/{kind}/{table}")) - named:
                    remove(self.spark, f"{self.path}/{kind}/{table}/{folder}")
        for x in names(self.spark, f"{self.path}/manifest"):
            if not x.endswith(".json") or int(x[:-5]) <= newest - keep:
                remove(self.spark, f"{self.path}/manifest/{x}")


def has_store(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/manifest")
