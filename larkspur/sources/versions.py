"""Versioned tables below one folder: whole commits, stale writers refused, replayed batches without effect (DML2, DML8, DML11, DML13, DML15, SNK1-SNK3).

A store is a folder with a log. A commit is one small JSON record, ``_commits/<number>.json``, that names the schema, the key
buckets and the files of all tables of the store. It is made whole beside the log and then put to its number only if that is absent:
by a hard link on a local file system, by Hadoop's rename without overwriting elsewhere (atomic where the file system's rename is, such
as HDFS). So a commit is there as a whole or not at all, for all tables at once; of two writers that began at the same
version one gets the number, the other a ``StaleWriter``; readers go on with the version they opened.

Tables with keys are cut into buckets by a hash of the keys. A merge reads and writes only buckets that a change falls into, so
it costs in proportion to the batch; the record names the old files of all others. Choose the number of buckets so that one is
some hundred megabytes: a bucket is written by one task. Tables without keys grow by a part for each append.

A commit can carry (writer, batch): a batch that is not after the last one of its writer has no effect and writes no file,
so a stream that starts again after a failure repeats itself without harm.

Files of a writer that failed or was refused stay below ``data/`` and are named by no record; ``clean()`` deletes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"
#: Parts of a table without keys, beyond which an append writes them anew as one.
MOST_PARTS = 1000


class StaleWriter(RuntimeError):
    """Another commit came first."""


@dataclass
class Table:
    schema: str
    keys: list[str]
    buckets: int
    parts: dict[str, str] = field(default_factory=dict)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")


@dataclass
class Commit:
    version: int
    tables: dict[str, Table]
    writers: dict[str, int]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @cached_property
    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def latest(self) -> Commit:
        """The last commit; version -1 and no tables in an empty store."""
        numbers = [n for n in self._names("_commits") if n.endswith(".json") and not n.startswith(".")]
        return self.at(int(numbers[-1][:-5])) if numbers else Commit(-1, {}, {})

    def at(self, version: int) -> Commit:
        source = self._fs.open(self._path(f"{self.root}/_commits/{version:020d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
        record = json.loads(text)
        return Commit(version, {n: Table(**t) for n, t in record["tables"].items()}, record["writers"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        commit = self.latest() if version is None else self.at(version)
        if name not in commit.tables:
            raise KeyError(f"no table {name} in version {commit.version}")
        return self._rows(commit.tables[name], None)

    def _rows(self, table: Table, buckets: set[str] | None) -> DataFrame:
        paths = [f"{self.root}/{p}" for b, p in table.parts.items() if buckets is None or b in buckets]
        schema = StructType.fromJson(json.loads(table.schema))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self, version: int | None = None) -> Transaction:
        """From the last version, or from one that the caller has read before."""
        return Transaction(self, self.latest() if version is None else self.at(version))

    def _put(self, version: int, content: str) -> None:
        """Create the record of a version if there is none."""
        jvm = self.spark.sparkContext._jvm
        made, final = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}"), self._path(f"{self.root}/_commits/{version:020d}.json")
        out = self._fs.create(made)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(final), local(made))
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
                none[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(made, final, none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise StaleWriter(f"version {version} of {self.root} is there already") from None
            raise
        finally:
            if self._fs.exists(made):
                self._fs.delete(made, False)

    def clean(self, keep: int = 1) -> int:
        """Forget all but the last ``keep`` versions and delete folders that these don't name. No writer may be at work. Gives the number of deleted folders."""
        last = self.latest().version
        for v in range(max(0, last - keep + 1)):
            self._fs.delete(self._path(f"{self.root}/_commits/{v:020d}.json"), False)
        named = {p.split("/")[1] for v in range(max(0, last - keep + 1), last + 1) for t in self.at(v).tables.values() for p in t.parts.values()}
        gone = [n for n in self._names("data") if n not in named]
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/data/{n}"), True)
        return len(gone)


class Transaction:
    """Changes to tables of a store from one version on; nothing is seen before commit(), all of it after."""

    def __init__(self, store: Store, base: Commit):
        self.store, self.base = store, base
        self.tables = {n: Table(t.schema, t.keys, t.buckets, dict(t.parts)) for n, t in base.tables.items()}
        self.written: list[str] = []

    def read(self, name: str) -> DataFrame:
        return self.store._rows(self.tables[name], None)

    def _write(self, df: DataFrame, table: Table) -> dict[str, str]:
        """Files of a table with keys by bucket; of one without, a single part."""
        name = f"data/{uuid.uuid4().hex}"
        path = f"{self.store.root}/{name}"
        self.written.append(name)
        if not table.keys:
            df.write.parquet(path)
            return {name: name}
        df.withColumn(BUCKET, table.bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)
        return {n.split("=")[1]: f"{name}/{n}" for n in self.store._names(name) if n.startswith(f"{BUCKET}=")}

    def put(self, name: str, df: DataFrame, keys: tuple[str, ...] = (), buckets: int = 64) -> None:
        """A table as a whole, in place of what it was."""
        table = Table(df.schema.json(), list(keys), buckets if keys else 1)
        table.parts = self._write(df, table)
        self.tables[name] = table

    def _touched(self, name: str, changes: DataFrame) -> set[str]:
        if not self.tables[name].keys:
            raise ValueError(f"{name} has no keys")
        # No more numbers than there are buckets.
        return {str(r[0]) for r in changes.select(self.tables[name].bucket().alias("b")).distinct().collect()}

    def around(self, name: str, changes: DataFrame) -> DataFrame:
        """The rows of all buckets that a change falls into: all rows with its keys, and some others."""
        return self.store._rows(self.tables[name], self._touched(name, changes))

    def merge(self, name: str, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """``apply`` gets the old rows of all buckets that a change falls into, and the changes, and gives the new rows of these buckets. Gives the buckets."""
        table, touched = self.tables[name], self._touched(name, changes)
        if touched:
            columns = StructType.fromJson(json.loads(table.schema)).names
            made = self._write(apply(self.store._rows(table, touched), changes).select(*columns), table)
            if not made.keys() <= touched:
                raise ValueError(f"a merge made rows of {name} in buckets without a change")
            table.parts = {b: p for b, p in table.parts.items() if b not in touched} | made
        return sorted(map(int, touched))

    def append(self, name: str, df: DataFrame) -> None:
        """New rows of a table without keys."""
        table = self.tables.get(name)
        if table is None:
            self.put(name, df)
            return
        columns = StructType.fromJson(json.loads(table.schema)).names
        if len(table.parts) >= MOST_PARTS:
            table.parts = self._write(self.read(name).unionByName(df.select(*columns)), table)
        else:
            table.parts |= self._write(df.select(*columns), table)

    def done(self, writer: str, batch: int) -> bool:
        """Whether this batch of the writer, or one after it, is in the store already."""
        return batch <= self.base.writers.get(writer, -1)

    def commit(self, writer: str | None = None, batch: int | None = None) -> int:
        """The new version. StaleWriter if another commit came after the version from which this one began."""
        if writer is not None and batch is not None and self.done(writer, batch):
            return self.base.version
        writers = self.base.writers | ({writer: batch} if writer is not None and batch is not None else {})
        version = self.base.version + 1
        self.store._put(version, json.dumps({"tables": {n: vars(t) for n, t in self.tables.items()}, "writers": writers}))
        return version


def batched(store: Store, writer: str, batch: int, work: Callable[[Transaction], None], tries: int = 5) -> int:
    """Run ``work`` and commit it under (writer, batch), exactly once. Where another writer came first, the work is done again from its version; the last refusal is raised."""
    for left in reversed(range(tries)):
        t = store.begin()
        if t.done(writer, batch):
            return t.base.version
        work(t)
        try:
            return t.commit(writer, batch)
        except StaleWriter:
            if not left:
                raise
    raise ValueError("tries is 1 or more")


def append_once(store: Store, name: str, rows: DataFrame, writer: str, batch: int, refuse: dict[str, Column] | None = None) -> int:
    """SNK1-SNK3: append a batch exactly once. Rows for which a condition of ``refuse`` (reason: condition) holds go to ``<name>_refused`` with the first such reason.

    A condition that is null does not refuse. Both tables are in one commit.
    """
    reason = F.lit(None).cast("string")
    for text, condition in reversed(list((refuse or {}).items())):
        reason = F.when(condition, text).otherwise(reason)

    def work(t: Transaction) -> None:
        # Decided once for each row: a row cannot be in both tables.
        marked = rows.withColumn("__reason", reason)
        t.append(name, marked.where("__reason is null").drop("__reason"))
        t.append(f"{name}_refused", marked.where("__reason is not null").withColumnRenamed("__reason", "reason"))

    return batched(store, writer, batch, work)
