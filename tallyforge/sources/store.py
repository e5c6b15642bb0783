"""Tables in hash buckets that are committed together: one manifest names the files of all of them.

A manifest (``manifests/<number>.json``) lists, for each table, the folders of each bucket; the highest number is what
readers see, whole or not at all. A transaction stages new folders under ``data`` beside those in use, and its commit puts the next manifest
in place; a number that is taken is a conflict. What was staged and not committed is taken back by ``abort`` or later by ``vacuum``.

An upsert deals the changes to the buckets of their keys. Only the key columns of those buckets are read to see which keys are there:
a bucket without one of them gets another folder, a bucket with one is written anew without those rows, all others stay
as they are. So what is written grows with the buckets that the changes meet, not with the table.

The driver holds the manifest: one path a bucket and upsert since the bucket was last written anew (``MOST_FOLDERS`` at most).
"""

from __future__ import annotations

import copy
import json
import uuid
from dataclasses import asdict, dataclass, field
from types import TracebackType

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of a bucket from which on an upsert that meets it writes it anew.
MOST_FOLDERS = 8
#: Column of the bucket while rows are dealt out.
BUCKET = "bucket_"


class Conflict(RuntimeError):
    """Another commit was faster."""


@dataclass
class Table:
    keys: list[str]
    buckets: int
    schema: str
    folders: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class Manifest:
    version: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def parse(text: str) -> Manifest:
        found = json.loads(text)
        return Manifest(found["version"], {k: Table(**t) for k, t in found["tables"].items()}, found["marks"])


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys; nulls are equal to each other."""
    test = F.lit(True)
    for k in keys:
        test = test & left[k].eqNullSafe(right[k])
    return test


class Store:
    """A folder of tables, on any file system that Hadoop reaches and that renames whole files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _list(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def delete(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def versions(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in self._list("manifests") if x.removesuffix(".json").isdigit())

    def current(self, version: int | None = None) -> Manifest:
        """The last manifest, or an earlier one."""
        known = self.versions()
        if version is None and not known:
            return Manifest()
        at = self._path(f"{self.root}/manifests/{known[-1] if version is None else version}.json")
        stream = self._fs.open(at)
        try:
            return Manifest.parse(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_manifest(self, manifest: Manifest) -> None:
        """Put the next manifest in place, if its number is free."""
        text = json.dumps(asdict(manifest)).encode()
        aside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(text)
        stream.close()
        self.rename(aside, self._path(f"{self.root}/manifests/{manifest.version}.json"))

    def rename(self, source: object, target: object) -> None:
        """Rename without replacing: of several writers of one number, one wins."""
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf) if target.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(source, target, none)
        except Exception as error:  # py4j wraps whatever the file system throws
            if self._fs.exists(target):
                self._fs.delete(source, False)
                raise Conflict(f"{target} is there already") from error
            raise

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of the last commit, or an earlier version that has not been vacuumed."""
        return self.files(self.current(version).tables[name])

    def files(self, table: Table, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(table.schema))
        paths = [f"{self.root}/{p}" for b, folders in table.folders.items() if buckets is None or int(b) in buckets for p in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self) -> Transaction:
        return Transaction(self)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete manifests but the last ``keep``, and staged folders that none of those names; gives the folders."""
        known = self.versions()
        for old in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/{old}.json"), False)
        used = {"/".join(p.split("/")[:3]) for v in known[-keep:] for t in self.current(v).tables.values() for ps in t.folders.values() for p in ps}
        gone = [f for name in self._list("data") for f in (f"data/{name}/{x}" for x in self._list(f"data/{name}")) if f not in used]
        for folder in gone:
            self.delete(folder)
        return gone


class Transaction:
    """Changes to several tables, committed together; as a context, an error takes back what was staged."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.current()
        self.next = copy.deepcopy(self.base)
        self.next.version += 1
        self.id, self.staged, self.scratch = uuid.uuid4().hex[:16], [], []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind: type[BaseException] | None, value: BaseException | None, trace: TracebackType | None) -> None:
        if kind:
            self.abort()
        else:
            self.commit()

    def _stage(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Write rows with their bucket; gives each bucket's new folder."""
        folder = f"data/{name}/{self.id}-{len(self.staged)}"
        self.staged.append(folder)
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.store.root}/{folder}")
        found = {x.removeprefix(f"{BUCKET}="): f"{folder}/{x}" for x in self.store._list(folder) if x.startswith(f"{BUCKET}=")}
        if not found:
            self.scratch.append(folder)
        return found

    def read(self, name: str) -> DataFrame:
        """A table as this transaction leaves it."""
        return self.store.files(self.next.tables[name])

    def create(self, name: str, rows: DataFrame, keys: list[str], buckets: int = 64) -> None:
        """A new table, or new content for one."""
        table = Table(keys, buckets, rows.schema.json())
        found = self._stage(name, rows.withColumn(BUCKET, bucket_of(keys, buckets)))
        table.folders = {b: [f] for b, f in found.items()}
        self.next.tables[name] = table

    def _dealt(self, table: Table, rows: DataFrame, name: str) -> tuple[DataFrame, list[int]]:
        """The rows with their buckets, written once; the buckets that they meet."""
        folder = f"data/{name}/{self.id}-{len(self.staged)}"
        self.staged.append(folder)
        self.scratch.append(folder)
        dealt = rows.withColumn(BUCKET, bucket_of(table.keys, table.buckets))
        dealt.write.parquet(f"{self.store.root}/{folder}")
        dealt = self.store.spark.read.schema(dealt.schema).parquet(f"{self.store.root}/{folder}")
        return dealt, [r[0] for r in dealt.select(BUCKET).distinct().collect()]  # one row a bucket at most

    def _holding(self, table: Table, keys: DataFrame, met: list[int]) -> list[int]:
        """Of the buckets met, those with one of the keys; only key columns are read."""
        there = self.store.files(table, met).select(*table.keys)
        hit = there.join(keys, same(there, keys, table.keys), "left_semi").select(bucket_of(table.keys, table.buckets).alias(BUCKET))
        return [r[0] for r in hit.distinct().collect()]  # one row a bucket at most

    def _rewrite(self, name: str, changes: DataFrame, with_changes: bool, verify: bool) -> None:
        table = self.next.tables[name]
        names = StructType.fromJson(json.loads(table.schema)).names if with_changes else table.keys
        dealt, met = self._dealt(table, changes.select(*names), name)
        if with_changes and not dealt.groupBy(*table.keys).count().where("count > 1").isEmpty():
            raise ValueError(f"{name}: a key is changed twice")
        if not met:
            return
        keys = dealt.select(*table.keys)
        anew = set(self._holding(table, keys, met))
        if with_changes:
            anew |= {b for b in met if len(table.folders.get(str(b), [])) >= MOST_FOLDERS}
        old = self.store.files(table, sorted(anew))
        kept = old.join(keys, same(old, keys, table.keys), "left_anti").withColumn(BUCKET, bucket_of(table.keys, table.buckets))
        found = self._stage(name, kept.unionByName(dealt) if with_changes else kept)
        for b in met if with_changes else anew:
            before = [] if b in anew else table.folders.get(str(b), [])
            table.folders[str(b)] = before + ([found[str(b)]] if str(b) in found else [])
        if verify:
            self._verify(name, dealt.drop(BUCKET), met)

    def _verify(self, name: str, sent: DataFrame, met: list[int]) -> None:
        back = self.store.files(self.next.tables[name], met).select(*sent.columns)
        if not sent.exceptAll(back).isEmpty():
            raise ValueError(f"{name}: not all changes were kept")

    def upsert(self, name: str, changes: DataFrame, verify: bool = False) -> None:
        """Replace rows by key and add new ones. verify: read what was staged and compare it with what was sent."""
        self._rewrite(name, changes, True, verify)

    def remove(self, name: str, keys: DataFrame) -> None:
        """Take away the rows with these keys."""
        self._rewrite(name, keys, False, False)

    def mark(self, stream: str, number: int) -> None:
        """Remember how far a stream has been taken in, with the same commit."""
        self.next.marks[stream] = number

    def commit(self) -> int:
        try:
            self.store.write_manifest(self.next)
        except (Conflict, PySparkException):
            self.abort()
            raise
        for folder in self.scratch:
            self.store.delete(folder)
        return self.next.version

    def abort(self) -> None:
        """Take back everything that was staged."""
        for folder in self.staged:
            self.store.delete(folder)
        self.staged = []
