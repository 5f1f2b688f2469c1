"""Versioned tables in parts: a change writes only the parts it touches.

A store is a folder of tables. A table is cut into buckets by a hash of its keys,
or of some of them, such as the episode. Each version of the store has one
manifest, a small file that names the folder of every part of every table. A
commit writes the touched parts into folders of their own and then the next
manifest; all other parts keep the folders they have. The manifest's file takes
its number by a rename that fails where the number is taken. So readers see all
tables before a commit or after it, and of two writers that started from the same
version one gets :class:`Conflict` and nothing is lost.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuematch.plans import storage
from cuematch.plans.persist import upsert

PART = "cuematch_part"


class Conflict(RuntimeError):
    """Another commit has been made since the version this one started from."""


@dataclass(frozen=True)
class Table:
    """A table's name and keys, cut into ``buckets`` by a hash of the columns ``by`` (all keys by default).

    ``spread`` tasks write each bucket, where single ones grow large.
    """

    name: str
    keys: tuple[str, ...]
    buckets: int = 64
    by: tuple[str, ...] = ()
    spread: int = 1

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*(self.by or self.keys)), F.lit(self.buckets)).cast("string")


@dataclass
class Change:
    """New content of the ``touched`` parts of a table; without them, of the whole table."""

    table: Table
    rows: DataFrame
    touched: Sequence[str] | None = None


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.split(".")[0]) for n in _names(spark, f"{path}/manifests") if n.endswith(".json")]


def _manifest(spark: SparkSession, path: str, version: int | None) -> dict:
    if version is None:
        return {"tables": {}}
    row = spark.read.text(f"{path}/manifests/{version:012d}.json", wholetext=True).first()
    return json.loads(row[0])


def _put(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    fs, target = _fs(spark, f"{path}/manifests/{version:012d}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)  # never over another manifest
    try:
        context.rename(draft, target, none)
    except Exception as error:  # the JVM's error says only that the rename failed
        fs.delete(draft, False)
        if fs.exists(target):
            raise Conflict(f"version {version} of {path} was committed by another writer") from error
        raise


def current(spark: SparkSession, path: str) -> int | None:
    """Number of the last version, None before the first commit."""
    return max(versions(spark, path), default=None)


def commit(spark: SparkSession, path: str, changes: Sequence[Change], base: int | None) -> int:
    """Write the changes as one new version; ``base`` is the version they were made from."""
    manifest, run = _manifest(spark, path, base), uuid.uuid4().hex
    for change in changes:
        table, folder = change.table, f"data/{run}/{change.table.name}"
        rows = change.rows.withColumn(PART, table.part())
        salt = [F.pmod(F.xxhash64(F.lit(1), *table.keys), F.lit(table.spread))] if table.spread > 1 else []
        rows.repartition(F.col(PART), *salt).write.partitionBy(PART).parquet(f"{path}/{folder}")
        written = {n.split("=", 1)[1]: f"{folder}/{n}" for n in _names(spark, f"{path}/{folder}") if n.startswith(f"{PART}=")}
        stored = manifest["tables"].get(table.name, {}).get("parts", {})
        if change.touched is None:
            stored = {}
        elif odd := set(written) - set(change.touched):
            raise ValueError(f"rows of {table.name} lie outside the touched parts: {sorted(odd)[:5]}")
        left = {k: v for k, v in stored.items() if k not in set(change.touched or ())}
        manifest["tables"][table.name] = {
            "schema": change.rows.schema.jsonValue(), "keys": table.keys, "buckets": table.buckets, "by": table.by,
            "spread": table.spread, "parts": left | written,
        }
    version = 0 if base is None else base + 1
    _put(spark, path, version, manifest)
    return version


def parts(spark: SparkSession, path: str, name: str, version: int | None = None) -> dict[str, str]:
    """Folder of each part that holds rows."""
    at = current(spark, path) if version is None else version
    return dict(_manifest(spark, path, at)["tables"][name]["parts"])


def _table(name: str, entry: dict) -> Table:
    return Table(name, tuple(entry["keys"]), entry["buckets"], tuple(entry["by"]), entry["spread"])


def _read(spark: SparkSession, path: str, entry: dict, wanted: Sequence[str] | None) -> DataFrame:
    schema = T.StructType.fromJson(entry["schema"])
    keep = entry["parts"].keys() if wanted is None else set(wanted) & entry["parts"].keys()
    folders = [f"{path}/{entry['parts'][k]}" for k in sorted(keep)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(
    spark: SparkSession, path: str, name: str, wanted: Sequence[str] | None = None, version: int | None = None
) -> DataFrame:
    """A table, or some of its parts, in the last version or an older one that is still kept."""
    at = current(spark, path) if version is None else version
    return _read(spark, path, _manifest(spark, path, at)["tables"][name], wanted)


def merge(
    incoming: DataFrame, path: str, name: str, keep: Sequence[str] = ("id", "created_at"), order: Sequence[str] | None = None
) -> int:
    """Upsert rows by the table's keys (:func:`persist.upsert`) and commit; returns the version.

    Only the buckets the incoming keys fall into are read, merged and written.
    """
    spark = incoming.sparkSession
    base = current(spark, path)
    entry = _manifest(spark, path, base)["tables"][name]
    table = _table(name, entry)
    incoming = storage.materialize(incoming, "incoming")  # read for its buckets and for the merge
    touched = [r[0] for r in incoming.select(table.part()).distinct().collect()]  # at most one name per bucket
    stored = _read(spark, path, entry, touched)
    merged = upsert(stored, incoming, table.keys, keep, order).drop("merge_action")
    return commit(spark, path, [Change(table, merged, touched)], base)


def replacing(spark: SparkSession, path: str, base: int | None, table: Table, rows: DataFrame, gone: DataFrame) -> Change:
    """The change that takes out all rows whose ``by`` columns occur in ``gone`` and puts ``rows`` in their place.

    ``rows`` must lie within ``gone``. A table that is stored keeps the buckets it has.
    """
    entry = _manifest(spark, path, base)["tables"].get(table.name)
    table = _table(table.name, entry) if entry else table
    touched = [r[0] for r in gone.select(table.part()).distinct().collect()]  # at most one name per bucket
    if not entry:
        return Change(table, rows, touched)
    stored, by = _read(spark, path, entry, touched), table.by or table.keys
    out = gone.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return Change(table, stored.join(out, same, "left_anti").unionByName(rows, allowMissingColumns=True), touched)


def drop_old(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all but the last ``keep`` versions and the folders that no kept one names; no reader may still use them."""
    numbers = sorted(versions(spark, path))
    held: set[str] = set()
    for version in numbers[-keep:]:
        for entry in _manifest(spark, path, version)["tables"].values():
            held |= set(entry["parts"].values())
    for version in numbers[:-keep]:
        storage.delete(spark, f"{path}/manifests/{version:012d}.json")
    for run in _names(spark, f"{path}/data"):
        for name in _names(spark, f"{path}/data/{run}"):
            for part in _names(spark, f"{path}/data/{run}/{name}"):
                if f"data/{run}/{name}/{part}" not in held:
                    storage.delete(spark, f"{path}/data/{run}/{name}/{part}")
