"""Tables of one folder that change together, version by version.

A folder holds immutable data and a log. Each row belongs to a bucket, by the hash of its table's key; a version names
the data folders of every bucket of every table. A change writes the buckets it touches, then publishes the next version
by renaming a finished file to its number, which fails where that number is taken. So

* a change of a few keys reads and writes their buckets only, never the whole table;
* all tables of the folder move together: no reader sees one of them without the other;
* a run that dies before its rename leaves the version before it as it was, and only unnamed data behind;
* a reader holds the folders of one version, which stay until `expire` drops that version;
* of two writers with a common base, the later one commits if it touched other buckets, else it gets `Conflict`.

The rename has to be refused by the file system where its target exists, as HDFS does.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.operators.skew import attach

BUCKETS = 64
BUCKET = "_bucket"
EMPTY = {"version": 0, "at": 0.0, "note": "", "properties": {}, "tables": {}, "changed": {}}


class Conflict(RuntimeError):
    """Another writer has changed the same buckets since the base version."""


@dataclass
class Written:
    """What a change has made of one table: its schema and the new folders of the touched buckets."""

    schema: str
    key: str
    buckets: int
    files: dict[str, list[str]]
    whole: bool = False


@dataclass
class Change:
    """Collects written tables on top of `base`; nothing is visible before `commit`."""

    tables: Tables
    base: dict
    done: dict[str, Written] = field(default_factory=dict)
    properties: dict = field(default_factory=dict)

    def replace(self, name: str, rows: DataFrame, touched: DataFrame, key: str, row_id: list[str]) -> None:
        """All rows whose key is in `touched` (one column, named as the key) or among the keys of `rows` give way to `rows`.

        Only the buckets of those keys are read and written. `row_id` tells the rows of one key apart, so that a
        key which owns most of a bucket is matched in parts. Rows without a key are keyed by null like any other.
        """
        known = self.base["tables"].get(name, {})
        if known.get("key", key) != key:
            raise ValueError(f"{name} is kept by {known['key']}, not by {key}")
        n = known.get("buckets", self.tables.buckets)  # a table keeps the number it was made with
        keys = touched.select(key).unionByName(rows.select(key)).distinct()
        buckets = sorted(r[0] for r in keys.select(self.tables.bucket(key, n)).distinct().collect())  # at most n numbers
        old = self.tables._read(self.base, name, buckets)
        if old is not None:
            gone = keys.where(f"`{key}` IS NOT NULL").withColumn("_gone", F.lit(True))
            held = attach(old, gone, [key], row_id, "left").where(F.col("_gone").isNull()).drop("_gone")
            if not keys.where(f"`{key}` IS NULL").isEmpty():
                held = held.where(f"`{key}` IS NOT NULL")
            rows = held.unionByName(rows, allowMissingColumns=True)
        self.done[name] = self.tables._write(name, rows, key, n, buckets)

    def overwrite(self, name: str, rows: DataFrame, key: str) -> None:
        """The table becomes `rows`."""
        self.done[name] = self.tables._write(name, rows, key, self.tables.buckets, [])
        self.done[name].whole = True

    def commit(self, note: str = "") -> int:
        return self.tables._commit(self, note)


class Tables:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._conf = spark._jsc.hadoopConfiguration()

    # Versions

    def versions(self) -> list[int]:
        """The numbers of the committed versions that are still kept."""
        return sorted(int(n[:-5]) for n in self._names("log") if re.fullmatch(r"\d{20}\.json", n))

    def latest(self) -> int:
        return max(self.versions(), default=0)

    def state(self, version: int | None = None) -> dict:
        """What a version consists of; version 0 is empty."""
        number = self.latest() if version is None else version
        if number == 0:
            return EMPTY
        return json.loads("\n".join(r[0] for r in self.spark.read.text(self._log(number), wholetext=True).collect()))

    def history(self) -> DataFrame:
        """version, at, note, changed (table to number of buckets written), oldest first."""
        kinds = "version long, at timestamp, note string, changed map<string, int>"
        found = [self.state(n) for n in self.versions()]
        rows = [(s["version"], s["at"], s["note"], {t: len(b) for t, b in s["changed"].items()}) for s in found]
        frame = self.spark.createDataFrame(rows, "version long, at double, note string, changed map<string, int>")
        return frame.withColumn("at", F.timestamp_seconds("at")).to(T._parse_datatype_string(kinds))

    def at(self, seconds: float) -> int:
        """The version that was current at a time (seconds since 1970)."""
        return max((n for n in self.versions() if self.state(n)["at"] <= seconds), default=0)

    def property(self, name: str, version: int | None = None):
        return self.state(version)["properties"].get(name)

    # Reading

    def read(self, name: str, version: int | None = None, keys: Iterable | None = None) -> DataFrame | None:
        """A table as of a version (the latest at the time of the call); None if that version has no such table.

        With `keys`, only the buckets of these key values are read, and only their rows returned.
        """
        state = self.state(version)
        if name not in state["tables"]:
            return None
        if keys is None:
            return self._read(state, name)
        key = state["tables"][name]["key"]
        kind = T.StructType.fromJson(json.loads(state["tables"][name]["schema"]))[key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(key, kind)]))
        found = sorted(r[0] for r in asked.select(self.bucket(key, state["tables"][name]["buckets"])).distinct().collect())
        return self._read(state, name, found).join(F.broadcast(asked.distinct()), key, "left_semi")

    def _read(self, state: dict, name: str, buckets: Iterable[int] | None = None) -> DataFrame | None:
        table = state["tables"].get(name)
        if table is None:
            return None
        files = table["files"]
        wanted = files.values() if buckets is None else [files[str(b)] for b in buckets if str(b) in files]
        paths = [f"{self.root}/data/{folder}" for folders in wanted for folder in folders]
        schema = T.StructType.fromJson(json.loads(table["schema"]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # Writing

    def change(self, version: int | None = None) -> Change:
        """A change on top of a version, the latest by default."""
        return Change(self, self.state(version))

    def replace_in(self, name: str, rows: DataFrame, touched: DataFrame, key: str, row_id: list[str], note: str = "", tries: int = 5) -> int:
        """A change of one table that does not depend on what it held; made anew where another writer was first."""
        for left in range(tries, 0, -1):
            change = self.change()
            change.replace(name, rows, touched, key, row_id)
            try:
                return change.commit(note)
            except Conflict:
                if left == 1:
                    raise
        raise ValueError("no try asked for")

    def bucket(self, key: str, n: int | None = None) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n or self.buckets)).cast("int").alias(BUCKET)

    def _write(self, name: str, rows: DataFrame, key: str, n: int, buckets: list[int]) -> Written:
        folder = f"{name}-{uuid.uuid4().hex}"
        # A bucket is one task's files, and a large one several: the rebalance splits what is skewed.
        placed = rows.withColumn(BUCKET, self.bucket(key, n)).hint("rebalance", BUCKET)
        placed.write.partitionBy(BUCKET).parquet(f"{self.root}/data/{folder}")
        made = [n for n in self._names(f"data/{folder}") if n.startswith(f"{BUCKET}=")]
        files = {str(b): [] for b in buckets} | {n.split("=")[1]: [f"{folder}/{n}"] for n in made}
        return Written(rows.schema.json(), key, n, files)

    def _commit(self, change: Change, note: str) -> int:
        number = change.base["version"] + 1
        while True:
            base = self.state(number - 1)
            entry = {
                "version": number, "at": time.time(), "note": note, "properties": base["properties"] | change.properties,
                "tables": dict(base["tables"]), "changed": {t: sorted(w.files, key=int) for t, w in change.done.items()},
            }
            for name, done in change.done.items():
                old = {} if done.whole else base["tables"].get(name, {}).get("files", {})
                files = {b: f for b, f in (old | done.files).items() if f}
                entry["tables"][name] = {"schema": done.schema, "key": done.key, "buckets": done.buckets, "files": files}
            if self._publish(number, entry):
                return number
            other = self.state(number)  # another writer was first
            for name, done in change.done.items():
                mine, theirs = (x["tables"].get(name, {}) for x in (base, other))
                whole = done.whole or (mine.get("schema"), mine.get("buckets")) != (theirs.get("schema"), theirs.get("buckets"))
                if name in other["changed"] and (whole or set(other["changed"][name]) & set(done.files)):
                    raise Conflict(f"version {number} has changed the same rows of {name}")
            number += 1

    def _publish(self, number: int, entry: dict) -> bool:
        """Whether the entry became that version; False where the number is taken."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        system = self._system()
        draft, target = hadoop.Path(f"{self.root}/log/.{uuid.uuid4().hex}"), hadoop.Path(self._log(number))
        out = system.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(system.getUri(), self._conf).rename(draft, target, none)
        except Py4JJavaError as error:
            system.delete(draft, False)
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    # Clearing

    def expire(self, keep: int = 10, grace_seconds: float = 86_400.0) -> int:
        """Drops all versions but the last `keep` and the data that no kept version names; returns the folders deleted.

        Data younger than the grace time stays, as it may belong to a change that is not committed yet.
        """
        kept = self.versions()[-max(1, keep) :]
        for number in self.versions():
            if number not in kept:
                self._delete(self._log(number))
        named = {f for n in kept for t in self.state(n)["tables"].values() for folders in t["files"].values() for f in folders}
        whole = {f.split("/")[0] for f in named}
        gone, limit = 0, (time.time() - grace_seconds) * 1000
        for folder in self._names("data", before=limit):
            if folder not in whole:
                self._delete(f"{self.root}/data/{folder}")
                gone += 1
                continue
            for part in self._names(f"data/{folder}"):
                if part.startswith(f"{BUCKET}=") and f"{folder}/{part}" not in named:
                    self._delete(f"{self.root}/data/{folder}/{part}")
                    gone += 1
        return gone

    # Files

    def _log(self, number: int) -> str:
        return f"{self.root}/log/{number:020d}.json"

    def _system(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self._conf)

    def _names(self, folder: str, before: float | None = None) -> list[str]:
        system, path = self._system(), self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        if not system.exists(path):
            return []
        return [s.getPath().getName() for s in system.listStatus(path) if before is None or s.getModificationTime() <= before]

    def _delete(self, path: str) -> None:
        self._system().delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
