"""An edge table kept up to date by a stream: a versioned base and the batches after it.

    <path>/batches/batch_id=N/   counts of one batch; run again after a failure, it overwrites itself
    <path>/bases/<name>/         sums of all batches up to some batch
    <path>/pointers/<through>.<name>   empty files: which base holds, and the last batch in it

A base is committed by creating its pointer, which is one atomic step, after it is written whole. A crash
before that leaves an orphan that nothing reads; after it, batches up to the pointer are skipped if they
are replayed. So every batch counts once, and at most `fold` batches are ever read beside the base.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

EDGES = "src string, dst string, n long"
#: Batches that are folded into a new base together.
FOLD = 10


class Base(NamedTuple):
    """The committed base: its folder's name (none yet: empty) and the last batch in it."""

    name: str
    through: int


class EdgeTable:
    """The edge table in a folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, path: str, fold: int = FOLD):
        self.spark, self.path, self.fold = spark, path.rstrip("/"), fold
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: object):
        return self._hadoop.Path("/".join([self.path, *map(str, parts)]))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(at)) if self._files.exists(at) else []

    def _batches(self) -> list[int]:
        """Numbers of the batches that are written whole."""
        found = [int(name.split("=")[1]) for name in self._names("batches") if name.startswith("batch_id=")]
        return [n for n in found if self._files.exists(self._at("batches", f"batch_id={n}", "_SUCCESS"))]

    def base(self) -> Base:
        """What the newest pointer says."""
        pointers = self._names("pointers")
        if not pointers:
            return Base("", -1)
        through, name = pointers[-1].split(".", 1)
        return Base(name, int(through))

    def write(self, counted: DataFrame, batch_id: int) -> None:
        """Take in the edge counts (src, dst, n) of a batch, and fold when enough batches have come."""
        base = self.base()
        if batch_id <= base.through:
            return  # a replay of what the base has
        counted.select("src", "dst", F.col("n").cast("long").alias("n")).write.mode("overwrite").parquet(f"{self.path}/batches/batch_id={batch_id}")
        if sum(n > base.through for n in self._batches()) >= self.fold:
            self.commit(self.write_base(batch_id))

    def write_base(self, through: int) -> Base:
        """Sum everything up to a batch into a new base, which counts from its `commit` on."""
        new = Base(f"base-{uuid.uuid4().hex}", through)
        self.read(through).write.parquet(f"{self.path}/bases/{new.name}")
        return new

    def commit(self, new: Base) -> None:
        """Make a written base the one that holds, then delete what no reader needs.

        The base before stays until the next commit, for readers that have already planned on it.
        """
        before = self.base()
        if not self._files.createNewFile(self._at("pointers", f"{new.through:020d}.{new.name}")):
            raise RuntimeError(f"base {new.name} is committed already")
        for n in self._batches():
            if n <= before.through:
                self._files.delete(self._at("batches", f"batch_id={n}"), True)
        for pointer in self._names("pointers"):
            if pointer.split(".", 1)[1] not in (new.name, before.name):
                self._files.delete(self._at("pointers", pointer), False)
        for name in self._names("bases"):
            if name not in (new.name, before.name):
                self._files.delete(self._at("bases", name), True)

    def read(self, through: int | None = None) -> DataFrame:
        """src, dst, n: sums of all batches, or of those up to one that the base does not go beyond."""
        base = self.base()
        paths = [f"{self.path}/bases/{base.name}"] if base.name else []
        paths += [f"{self.path}/batches/batch_id={n}" for n in self._batches() if n > base.through and (through is None or n <= through)]
        if not paths:
            return self.spark.createDataFrame([], EDGES)
        return self.spark.read.schema(EDGES).parquet(*paths).groupBy("src", "dst").agg(F.sum("n").alias("n"))

    def parts(self) -> int:
        """Folders of batches and bases that are there."""
        return len(self._names("batches")) + len(self._names("bases"))


def event_edges(events: DataFrame) -> DataFrame:
    """Edges between an event's type and the number in its `props`, with counts."""
    k = F.from_json("props", "map<string,string>")["k"]
    return (
        events.select(F.col("event_type").alias("src"), F.concat(F.lit("k"), k).alias("dst"))
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    )


def upsert_edges(events: DataFrame, path: str, checkpoint: str, fold: int = FOLD) -> StreamingQuery:
    """Keep the edge table of a folder up to date from a stream of events; `read_edges` gives the sums."""
    table = EdgeTable(events.sparkSession, path, fold)
    return (
        events.writeStream.foreachBatch(lambda batch, batch_id: table.write(event_edges(batch), batch_id))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """The edge table of `upsert_edges`: the committed base and newer batches, summed."""
    return EdgeTable(spark, path).read()
