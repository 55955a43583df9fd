"""The corpus store: documents, units, sessions and metrics as Parquet.

A manifest names the folders that make up all tables. Every write makes new folders first and then one new
manifest, by a rename; so documents and units change together, a reader sees the one state or the other, and
a writer that is lost leaves the old one in place. Documents and units are bucketed by document, and a
write makes new folders for the buckets that it touches only. Sessions and metrics are logs: a record is a
folder more, and `compact` folds a log into one. `sweep` removes what no late manifest names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..plans.keep import keep

BUCKETED = ("documents", "units")


class CorpusStore:
    """A folder of tables under a manifest; `buckets` is fixed when the store is first written."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- the manifest ---------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._names("manifest") if n.startswith("m-")]

    def manifest(self, name: str | None = None) -> dict:
        """version, corpus (counts writes of documents or units), buckets, tables, schemas and logs."""
        names = [name] if name else self._manifests()[-1:]
        if not names:
            return {"version": 0, "corpus": 0, "buckets": self.buckets, "tables": {}, "schemas": {}, "logs": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifest/{names[0]}", wholetext=True).first()[0])

    def _commit(self, new: dict) -> None:
        """Make `new` the state, if nobody has made another one since it was read."""
        new["version"] += 1
        draft, final = (self._path(f"{self.root}/manifest/{n}") for n in (f"draft-{uuid.uuid4().hex}", f"m-{new['version']:012d}"))
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError("COR-003: the store was written by someone else; read it and write again")

    def sweep(self, states: int = 2) -> list[str]:
        """Remove folders that none of the last `states` manifests names, and the manifests before them."""
        names = self._manifests()
        late = [self.manifest(n) for n in names[-states:]]
        named = {f for m in late for t in m["tables"].values() for f in t.values()} | {f for m in late for log in m["logs"].values() for f in log}
        named |= {f"snapshots/{m['corpus']}" for m in late}
        folders = [f"{t}/{n}" for t in self._names("") if t != "manifest" for n in self._names(t)]
        gone = [f for f in folders if f not in named] + [f"manifest/{n}" for n in self._names("manifest") if n not in names[-states:]]
        for f in gone:
            self._fs.delete(self._path(f"{self.root}/{f}"), True)
        return gone

    # -- documents and units --------------------------------------------------------------

    def exists(self, table: str) -> bool:
        m = self.manifest()
        return table in m["schemas"] or table in m["logs"]

    def _read(self, m: dict, table: str, buckets: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(m["schemas"][table])
        paths = [f"{self.root}/{f}/bucket={b}" for b, f in m["tables"].get(table, {}).items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str) -> DataFrame | None:
        m = self.manifest()
        if table in m["logs"]:
            return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.root}/{f}" for f in m["logs"][table]])
        return self._read(m, table) if table in m["schemas"] else None

    def _bucket(self, m: dict, key: str):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(m["buckets"])).cast("int")

    def _change(self, ids: DataFrame, fresh: dict[str, DataFrame], key: str) -> None:
        """Rows of these ids go, fresh ones come, in the buckets of either only."""
        m = self.manifest()
        ids = keep(ids.select(key).distinct())
        for table in BUCKETED:
            rows, known = fresh.get(table), table in m["schemas"]
            if rows is None and not known:
                continue
            keys = ids if rows is None else ids.unionByName(rows.select(key))
            touched = {r[0] for r in keys.select(self._bucket(m, key)).distinct().collect()}  # as many as there are buckets at most
            left = self._read(m, table, touched).join(ids, key, "left_anti") if known else None
            out = left if rows is None else rows if left is None else left.unionByName(rows, allowMissingColumns=True)
            folder = f"{table}/{uuid.uuid4().hex}"
            out.withColumn("bucket", self._bucket(m, key)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
            made = {n.partition("=")[2] for n in self._names(folder) if n.startswith("bucket=")}
            m["tables"][table] = {b: f for b, f in m["tables"].get(table, {}).items() if int(b) not in touched} | {b: folder for b in made}
            m["schemas"][table] = json.loads(out.schema.json())
        m["corpus"] += 1
        self._commit(m)

    def upsert(self, documents: DataFrame, units: DataFrame, key: str = "document_id") -> None:
        """Replace documents of the same id and their units."""
        self._change(documents, {"documents": documents, "units": units}, key)

    def delete(self, ids: DataFrame, key: str = "document_id") -> None:
        """Documents and their units."""
        self._change(ids, {}, key)

    def clear(self) -> None:
        """No document and no unit, by the manifest alone."""
        m = self.manifest()
        m["tables"] = {}
        m["corpus"] += 1
        self._commit(m)

    def units(self, ids: list[str] | None = None, key: str = "document_id") -> DataFrame:
        """Units in document order, of some documents or of all."""
        rows = self.read("units")
        if rows is None:
            raise ValueError("COR-001: the corpus is empty")
        return (rows.where(F.col(key).isin(*ids)) if ids else rows).orderBy(key, "ordinal")

    def documents(self, order: str = "filename") -> DataFrame:
        """S10."""
        rows = self.read("documents")
        if rows is None:
            raise ValueError("COR-001: the corpus is empty")
        return rows.orderBy(order)

    def counts(self) -> DataFrame:
        m = self.manifest()
        if "documents" not in m["schemas"]:
            raise ValueError("COR-001: the corpus is empty")
        one = lambda t: self._read(m, t).agg(F.count("*").alias(t))
        return one("documents").crossJoin(one("units"))

    def snapshot(self, key: str = "document_id") -> DataFrame:
        """`snapshot` of the units, computed once for each state of the corpus.

        Writes of documents or units make another state, and so another snapshot; sessions do not.
        """
        m = self.manifest()
        path = f"{self.root}/snapshots/{m['corpus']}"
        if not self._fs.exists(self._path(f"{path}/_SUCCESS")):
            snapshot(self._read(m, "units"), key).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    # -- sessions and metrics -------------------------------------------------------------

    def record(self, table: str, rows: DataFrame) -> None:
        """Rows more in a log, with `seq`, which grows from record to record; nothing is read or rewritten."""
        m = self.manifest()
        folder = f"{table}/{uuid.uuid4().hex}"
        rows.withColumn("seq", F.lit(m["version"]).cast("long")).write.parquet(f"{self.root}/{folder}")
        m["logs"].setdefault(table, []).append(folder)
        self._commit(m)

    def latest(self, table: str, key: str, by: str = "seq") -> DataFrame:
        rows = self.read(table)
        if rows is None:
            raise ValueError("COR-002: nothing is recorded")
        return latest_by(rows, key, by)

    def compact(self, table: str, fold: Callable[[DataFrame], DataFrame]) -> None:
        """One folder in place of a log's many, holding what `fold` leaves of its rows."""
        m = self.manifest()
        folder = f"{table}/{uuid.uuid4().hex}"
        fold(self.read(table)).write.parquet(f"{self.root}/{folder}")
        m["logs"][table] = [folder]
        self._commit(m)

    def open_sessions(self, rows: DataFrame) -> None:
        """session_id, profile_id, created_at; a session of the same id is replaced, closed or not."""
        self.record("sessions", rows.select("session_id", "profile_id", "created_at", F.lit(None).cast("timestamp").alias("closed_at"), F.lit(None).cast("long").alias("requests"), F.lit("open").alias("event")))

    def close_sessions(self, rows: DataFrame) -> None:
        """session_id, closed_at, requests; sessions that are not known stay unknown."""
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        self.record("sessions", rows.select("session_id", none("profile_id", "string"), none("created_at", "timestamp"), "closed_at", F.col("requests").cast("long").alias("requests"), F.lit("close").alias("event")))

    def sessions(self) -> DataFrame:
        """session_id, profile_id, created_at, and closed_at and requests of the last close after the last open."""
        rows = self.read("sessions")
        if rows is None:
            raise ValueError("COR-002: nothing is recorded")
        return folded_sessions(rows).select("session_id", "profile_id", "created_at", "closed_at", "requests")

    def compact_sessions(self) -> None:
        self.compact("sessions", folded_sessions)


def folded_sessions(log: DataFrame) -> DataFrame:
    """A session's log as its one row, an `open` that carries its close; itself a log.

    The last of each event is a max of structs, combined before the shuffle, however long a log is.
    """
    opened = F.max(F.when(F.col("event") == "open", F.struct("seq", "profile_id", "created_at", "closed_at", "requests"))).alias("o")
    closed = F.max(F.when(F.col("event") == "close", F.struct("seq", "closed_at", "requests"))).alias("c")
    rows = log.groupBy("session_id").agg(opened, closed).where("o IS NOT NULL")
    late = F.coalesce(F.col("c.seq") > F.col("o.seq"), F.lit(False))
    pick = lambda x: F.when(late, F.col(f"c.{x}")).otherwise(F.col(f"o.{x}")).alias(x)
    return rows.select("session_id", "o.profile_id", "o.created_at", pick("closed_at"), pick("requests"), F.lit("open").alias("event"), F.col("o.seq").alias("seq"))


def latest_by(rows: DataFrame, key: str, by: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(by))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def unit_checksums(units: DataFrame) -> DataFrame:
    """Checksum of each unit's canonical JSON, metadata left out."""
    fields = [c for c in units.columns if c not in ("meta", "checksum")]
    return units.withColumn("checksum", T.sha(T.canonical_json({c: F.col(c) for c in fields})))


def snapshot(units: DataFrame, key: str = "document_id") -> DataFrame:
    """One row: documents, units, tokens, corpus checksum.

    The checksum is defined over the list of all units' checksums in order, and SHA-256 has no parts that
    could be put together: one task streams the sorted checksums (65 bytes a unit) through it, and holds
    none of them.
    """

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, first = hashlib.sha256(), True
        for batch in batches:
            for x in batch.column(0).to_pylist():
                digest.update(x.encode() if first else b"|" + x.encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["corpus_checksum"])

    sums = units.groupBy(key).agg(F.count("*").alias("n"), F.sum("token_estimate").alias("t")).agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("units"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
    ordered = units.select(key, "ordinal", "checksum").repartition(1).sortWithinPartitions(key, "ordinal").select("checksum")
    return sums.crossJoin(F.broadcast(ordered.mapInArrow(streamed, "corpus_checksum string")))


def write_results(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Results as JSON lines or Parquet."""
    rows.write.mode("overwrite").format(kind).save(path)
