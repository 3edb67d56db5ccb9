"""Tables that streams change in guarded commits: written first, then made visible by a marker that only one writer can put in place."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.tables import held


class Marks:
    """Numbered markers in a folder of any store that Spark writes to. A marker appears whole or not at all, and once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.hadoop, self.conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway, self.folder = spark.sparkContext._gateway, self.hadoop.Path(path)
        self.files = self.folder.getFileSystem(self.conf)

    def _at(self, n: int) -> object:
        return self.hadoop.Path(self.folder, f"{n:012d}.json")

    def last(self, below: int | None = None) -> int:
        """The highest number, of those below one if given; -1 where there is none."""
        if not self.files.exists(self.folder):
            return -1
        names = [s.getPath().getName() for s in self.files.listStatus(self.folder)]
        return max([int(x[:-5]) for x in names if x.endswith(".json") and (below is None or int(x[:-5]) < below)], default=-1)

    def get(self, n: int) -> dict:
        stream = self.files.open(self._at(n))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def put(self, n: int, said: dict) -> bool:
        """Make marker n; False if there is one already."""
        self.files.mkdirs(self.folder)
        draft = self.hadoop.Path(self.folder, f".{uuid.uuid4().hex}")
        out = self.files.create(draft, False)
        out.write(json.dumps(said, sort_keys=True).encode())
        out.close()
        never_over = self.gateway.new_array(self.hadoop.Options.Rename, 1)
        never_over[0] = self.hadoop.Options.Rename.NONE
        try:
            self.hadoop.FileContext.getFileContext(self.folder.toUri(), self.conf).rename(draft, self._at(n), never_over)
        except Py4JJavaError as e:
            self.files.delete(draft, False)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True


@dataclass(frozen=True)
class Version:
    """number; where each bucket's rows lie; and for each stream the last batch that it has brought in."""

    number: int = -1
    buckets: dict[str, str] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)


class Ledger:
    """A table by key whose changes are commits. Rows lie in buckets by their key, and a commit writes the buckets that it touches.

    A commit counts from its marker on. What a writer that died has written before is never read. Of two writers that began at one
    version the second one fails, reads again and merges anew, so no change is lost and none is made twice.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self.marks = Marks(spark, f"{self.path}/commits")

    def head(self) -> Version:
        n = self.marks.last()
        return Version(n, **self.marks.get(n)) if n >= 0 else Version()

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def read(self, version: Version | None = None, only: list[int] | None = None) -> DataFrame:
        version = version or self.head()
        paths = sorted(p for b, p in version.buckets.items() if only is None or int(b) in only)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def change(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], stream: str | None = None, batch: int = -1) -> bool:
        """Commit merge(stored, incoming), which must keep keys apart; False if the stream's batch is in already.

        incoming is read more than once. merge gets the stored rows of the buckets that incoming touches, and gives all that is to lie there.
        """
        while True:
            head = self.head()
            if stream is not None and head.streams.get(stream, -1) >= batch:
                return False
            touched = [r[0] for r in self._bucketed(incoming).select("bucket").distinct().collect()]  # at most as many as there are buckets
            folder = f"{self.path}/rows/{uuid.uuid4().hex}"
            new = head.buckets
            if touched:
                merged = self._bucketed(merge(self.read(head, touched), incoming))
                merged.repartition("bucket").write.partitionBy("bucket").parquet(folder)
                there = {s.getPath().getName() for s in self.marks.files.listStatus(self.marks.hadoop.Path(folder))}
                new = {b: p for b, p in head.buckets.items() if int(b) not in touched}
                new |= {str(b): f"{folder}/bucket={b}" for b in touched if f"bucket={b}" in there}
            if self.marks.put(head.number + 1, {"buckets": new, "streams": head.streams | ({stream: batch} if stream is not None else {})}):
                return True

    def clean(self) -> None:
        """Delete the rows that the head does not name; for a time without writers and readers."""
        used = {p.rpartition("/")[0] for p in self.head().buckets.values()}
        rows = self.marks.hadoop.Path(f"{self.path}/rows")
        for s in self.marks.files.listStatus(rows) if self.marks.files.exists(rows) else []:
            if f"{self.path}/rows/{s.getPath().getName()}" not in used:
                self.marks.files.delete(s.getPath(), True)


def inserted(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with new keys join the stored ones, one a key; known keys change nothing."""
    return stored.unionByName(incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def guarded(stored: DataFrame, incoming: DataFrame, keys: list[str], state: str, moves: dict[str, list[str | None]]) -> DataFrame:
    """A row of incoming (one a key, the columns of stored) replaces the stored one only where moves lets that state become its own; None is no row yet."""
    values = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, F.lit(True).alias("_known"), *[F.col(c).alias(f"_old_{c}") for c in values])
    new = incoming.select(*keys, F.lit(True).alias("_comes"), *[F.col(c).alias(f"_new_{c}") for c in values])
    both = old.join(new, keys, "full_outer")
    may = F.lit(False)
    for to, froms in moves.items():
        known = F.col("_known").isNotNull() & F.col(f"_old_{state}").isin([x for x in froms if x is not None])
        may = may | ((F.col(f"_new_{state}") == to) & (known | (F.col("_known").isNull() if None in froms else F.lit(False))))
    may = F.coalesce(may, F.lit(False))
    rows = both.withColumn("_may", may).where("_may OR _known IS NOT NULL")
    return rows.select(*keys, *[F.when(F.col("_may"), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c) for c in values])


def keep_up(stream: DataFrame, ledger: Ledger, name: str, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Bring what has arrived into the ledger, a commit a micro-batch. A batch that is run again after a failure is not merged again."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()
        ledger.change(batch, merge, name, number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Which states of a delivery may become which.
DELIVERY: dict[str, list[str | None]] = {"queued": [None], "publishing": ["queued", "failed"], "sent": ["publishing"], "failed": ["publishing"], "uncertain": ["publishing"]}


def deliver(ledger: Ledger, worker: str, now: str, lease_seconds: int, send: Callable[[DataFrame], DataFrame], most: int) -> None:
    """Send what is queued, nothing twice. The ledger has its keys, state, leased (timestamp) and worker.

    A delivery is claimed by a commit before it is sent, and recorded after. One whose worker died in between stays `publishing`; when
    its lease has run out it is uncertain, and is left to people. send gets the claimed rows and returns their keys and ok; within a run
    Spark may try a task again, so it passes key and worker on as the token by which a receiver knows a repeat.
    """
    clock, columns = F.lit(now).cast("timestamp"), ledger.read().columns

    def stale(stored: DataFrame) -> DataFrame:
        old = (F.col("state") == "publishing") & (F.unix_timestamp(clock) - F.unix_timestamp("leased") > lease_seconds)
        return stored.where(old).withColumn("state", F.lit("uncertain"))

    step = lambda rows: ledger.change(rows.select(*columns), lambda s, i: guarded(s, i, ledger.keys, "state", DELIVERY))
    step(stale(ledger.read()))
    ready = ledger.read().where("state IN ('queued', 'failed')").orderBy(*ledger.keys).limit(most)
    claim = f"{worker}-{uuid.uuid4().hex}"  # another writer may claim the same rows: the ledger says whose they are
    step(ready.withColumns({"state": F.lit("publishing"), "leased": clock, "worker": F.lit(claim)}))
    mine = ledger.read().where((F.col("state") == "publishing") & (F.col("worker") == claim))
    outcome = held(send(mine).select(*ledger.keys, "ok"))  # what fails here leaves the claim; what is held is never computed again
    step(mine.join(outcome, ledger.keys).withColumn("state", F.when(F.col("ok"), "sent").otherwise("failed")))
