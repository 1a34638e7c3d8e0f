"""Keyed tables: parquet folders with an upsert.

A table is cut into parts by the values of its ``by`` columns (some of its
keys). ``upsert`` joins the new rows with the stored ones by key and writes
only the parts in which a row really changes, each into a folder of its own;
then one small manifest names the folder of every part. Readers take the
newest finished manifest: they see all of an upsert or nothing of it, rows of
other keys stay as they are, and running the same upsert again changes
nothing, not even the manifest.

A manifest is created under the next number and may not exist yet, so of two
writers at once one fails and tries again. It ends with a mark; one without the
mark (its writer died) is passed over. The driver handles the names of the
parts, as with any partitioned table, never rows.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART, _VERSION, _SIDE, _ROW = "kt_part", "kt_version", "kt_new", "kt_row"  # no column of a table may begin with kt_
_END = "end"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system Spark reads; none if it isn't there."""
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


class Conflict(RuntimeError):
    """Another writer has finished in between."""


class KeyedTable:
    """A table under ``path`` with unique ``keys``, cut into parts by ``by`` (a subset of the keys)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], by: list[str]):
        if not set(by) <= set(keys):
            raise ValueError("a row can't change its part: `by` has to be among the keys")
        self.spark, self.path, self.keys, self.by = spark, path.rstrip("/"), list(keys), list(by)

    # --- manifests ---

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in _names(self.spark, f"{self.path}/manifest") if n.endswith(".json"))

    def _manifest(self, version: int) -> dict | None:
        p, fs = _fs(self.spark, f"{self.path}/manifest/{version}.json")
        stream = fs.open(p)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text[:-len(_END)]) if text.endswith(_END) else None

    def manifest(self) -> dict:
        """The newest finished one; before the first upsert, one without parts."""
        for v in reversed(self._versions()):
            found = self._manifest(v)
            if found:
                return found
        return {"version": -1, "parts": {}, "schema": None}

    def _publish(self, manifest: dict) -> None:
        version = max(self._versions(), default=-1) + 1
        p, fs = _fs(self.spark, f"{self.path}/manifest/{version}.json")
        try:
            stream = fs.create(p, False)
        except Exception as e:  # the number has been taken
            raise Conflict(str(p)) from e
        try:
            stream.write(bytearray((json.dumps(manifest | {"version": version}) + _END).encode()))
        finally:
            stream.close()

    # --- rows ---

    def _part(self) -> Column:
        """A folder name that is safe for any value, null included."""
        text = F.to_json(F.struct(*[F.col(c).cast("string").alias(str(i)) for i, c in enumerate(self.by)]))
        return F.hex(F.encode(text, "UTF-8"))

    def _read(self, manifest: dict, parts=None, schema: T.StructType | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"])) if manifest["schema"] else schema
        live: dict[str, list[str]] = {}
        for k, v in manifest["parts"].items():
            if parts is None or k in parts:
                live.setdefault(v, []).append(k)
        if not live:
            return self.spark.createDataFrame([], schema or T.StructType())
        folders = (self.spark.read.schema(T.StructType([*schema, T.StructField(_VERSION, T.StringType()), T.StructField(_PART, T.StringType())]))
                       .option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{v}" for v in sorted(live)]))
        # folders are pruned by name when the scan is planned
        inside = [(F.col(_VERSION) == v.split("=", 1)[1]) & F.col(_PART).isin(sorted(ks)) for v, ks in sorted(live.items())]
        return folders.where(reduce(lambda a, b: a | b, inside)).select(*[F.col(f"`{f.name}`") for f in schema])

    def read(self, near: DataFrame | None = None) -> DataFrame:
        """All rows; or those of the parts that ``near`` (with the ``by`` columns) has rows of."""
        m = self.manifest()
        return self._read(m, None if near is None else self._touched(near))

    def _touched(self, rows: DataFrame) -> set[str]:
        return {r[0] for r in rows.select(self._part()).distinct().collect()}

    def upsert(self, rows: DataFrame, order: list[str] | None = None, deleted: DataFrame | None = None, tries: int = 3) -> set[str]:
        """Insert or replace rows by key; keys of ``deleted`` go. Returns the parts written.

        Of new rows with the same key the last by ``order`` counts (by all columns
        in their order, without it); a key that is both new and deleted is new. Null
        is a key value like others. No rows, no change. The first upsert sets the
        schema; later ones are cast to it by name."""
        for left in reversed(range(tries)):
            try:
                return self._upsert(rows, order, deleted)
            except Conflict:
                if not left:
                    raise
        return set()

    def _upsert(self, rows: DataFrame, order: list[str] | None, deleted: DataFrame | None) -> set[str]:
        was = self.manifest()
        if was["schema"]:
            want = T.StructType.fromJson(json.loads(was["schema"]))
            rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        near = self._touched(rows) | (self._touched(deleted) if deleted is not None else set())
        old = self._read(was, near, schema)
        values = [f.name for f in schema if f.name not in self.keys]
        keyed = lambda df, side, live=True: df.select(
            *self.keys, F.lit(side).alias(_SIDE), F.lit(live).alias("kt_live"),
            (F.struct(*[F.col(c) for c in values]) if live and values else F.lit(None).cast(_type(schema, values))).alias(_ROW),
            *([F.struct(*[F.col(c) for c in order])] if order and side == 2 else [F.lit(None)] if order else []))
        names = [*self.keys, _SIDE, "kt_live", _ROW, *(["kt_order"] if order else [])]
        sides = [keyed(old, 0).toDF(*names), keyed(rows, 2).toDF(*names)]
        if deleted is not None:
            sides.append(keyed(deleted, 1, False).toDF(*names))
        every = sides[0]
        for s in sides[1:]:
            every = every.unionByName(s)
        rank = F.struct(_SIDE, *(["kt_order"] if order else []), _ROW)
        stored = F.max(F.when(F.col(_SIDE) == 0, F.col(_ROW)))
        merged = every.groupBy(*self.keys).agg(
            F.max_by(F.struct("kt_live", _ROW), rank).alias("kt_last"), F.count_if(F.col(_SIDE) == 0).alias("kt_had"), stored.alias("kt_was"))
        differs = ((F.col("kt_had") == 0) & F.col("kt_last.kt_live")) | (
            (F.col("kt_had") > 0) & (~F.col("kt_last.kt_live") | ~F.col(f"kt_last.{_ROW}").eqNullSafe(F.col("kt_was"))))
        folder = f"{_VERSION}={uuid.uuid4().hex}"
        out = f"{self.path}/data/{folder}"
        merged = merged.withColumn(_PART, self._part()).withColumn("kt_differs", differs)
        staged = f"{self.path}/staged/{folder}"
        merged.write.parquet(staged)    # the join runs once: for what differs, and for the rows
        merged = self.spark.read.schema(merged.schema).parquet(staged)
        changed = {r[0] for r in merged.where("kt_differs").select(_PART).distinct().collect()}
        if changed:
            live = merged.where(F.col("kt_last.kt_live") & F.col(_PART).isin(sorted(changed)))
            (live.select(_PART, *[F.col(f.name) if f.name in self.keys else F.col(f"kt_last.{_ROW}.`{f.name}`").alias(f.name) for f in schema])
                 .hint("rebalance", _PART)  # few files a part; a part with a third of all rows is split over many tasks
                 .write.partitionBy(_PART).parquet(out))
            written = {n.split("=", 1)[1] for n in _names(self.spark, out) if n.startswith(f"{_PART}=")}
            parts = {k: v for k, v in was["parts"].items() if k not in changed} | {k: folder for k in changed & written}
            if self.manifest()["version"] != was["version"]:
                raise Conflict(self.path)
            self._publish({"parts": parts, "schema": was["schema"] or schema.json(), "keys": self.keys, "by": self.by})
        p, fs = _fs(self.spark, staged)
        fs.delete(p, True)
        return changed

    def vacuum(self, keep: int = 2) -> None:
        """Deletes folders that none of the ``keep`` newest manifests names, and older manifests."""
        versions = self._versions()
        kept = [m for m in (self._manifest(v) for v in versions[-keep:]) if m]
        live = {(v, k) for m in kept for k, v in m["parts"].items()}
        for v in _names(self.spark, f"{self.path}/data"):
            for n in _names(self.spark, f"{self.path}/data/{v}"):
                if n.startswith(f"{_PART}=") and (v, n.split("=", 1)[1]) not in live:
                    p, fs = _fs(self.spark, f"{self.path}/data/{v}/{n}")
                    fs.delete(p, True)
        for v in versions[:-keep]:
            p, fs = _fs(self.spark, f"{self.path}/manifest/{v}.json")
            fs.delete(p, False)


def _type(schema: T.StructType, names: list[str]) -> T.StructType:
    return T.StructType([f for f in schema if f.name in names])


def corrections(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What turns ``before`` into ``after``: ``keys, change`` (insert, change or delete),
    and every value column as ``c`` (after) and ``c_before``. Equal rows don't come
    out. Both sides have unique keys; null is a key value like others. One
    aggregate over the rows of both, no join."""
    values = [c for c in after.columns if c not in keys]
    side = lambda df, n: df.select(*keys, F.lit(n).alias(_SIDE), F.struct(*[F.col(c) for c in values]).alias(_ROW))
    pick = lambda n: F.max(F.when(F.col(_SIDE) == n, F.col(_ROW)))
    both = side(before, 0).unionByName(side(after, 1)).groupBy(*keys).agg(pick(0).alias("kt_b"), pick(1).alias("kt_a"))
    change = (F.when(F.col("kt_b").isNull(), "insert").when(F.col("kt_a").isNull(), "delete")
               .when(~F.col("kt_a").eqNullSafe(F.col("kt_b")), "change"))
    return (both.withColumn("change", change).where("change is not null")
                .select(*keys, "change", *[F.col(f"kt_a.`{c}`").alias(c) for c in values],
                        *[F.col(f"kt_b.`{c}`").alias(f"{c}_before") for c in values]))
