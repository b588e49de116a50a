"""Searches as a source: requests are rows, and so are hits and failures (SRC1-SRC3, SRC6, SRC7, SRC11-SRC15, SRC18-SRC22, SRC27, SRC28, STM1).

Requests wait in a log, a folder of numbered batches of small Parquet files; a task takes
one file and asks for its requests one after the other, so only names of files pass the
driver, and a lost task asks again for its own file.  A request that fails is tried
``attempts`` times and then gives a row with its error.  Each request gives a row at
least: hits by ``pos``, or one row without ``pos``, whose ``error`` is null if the
service found nothing.

As a stream the source's offset is the number of the last batch taken of each log.  A log
has one writer: what failed goes to a second log, which the stream writes and reads
itself, until it has been asked for in ``rounds`` rounds.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator, Sequence

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

REQUEST = "place long, query string, round int"
HIT = "place long, query string, round int, pos int, title string, url string, content string, published string, engine string, error string, attempts int"
_FIELDS = ("title", "url", "content", "published", "engine")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _listed(log: str) -> list[tuple[int, str]]:
    """(number, folder) of the batches that are complete, without those after a gap."""
    system, root = fs.FileSystem.from_uri(log)
    found = {}
    for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if x.base_name.startswith("batch-") and system.get_file_info(f"{x.path}/_SUCCESS").type == fs.FileType.File:
            found[int(x.base_name.split("-")[1])] = x.base_name
    out = []
    while len(out) + 1 in found:
        out.append((len(out) + 1, f"{log}/{found[len(out) + 1]}"))
    return out


def _files(folder: str) -> list[InputPartition]:
    """A partition for each file of a batch; ``folder`` is as the log's address says it."""
    system, root = fs.FileSystem.from_uri(folder)
    names = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".parquet"))
    return [_File(f"{folder}/{x}") for x in names]


class _Asking:
    """What batch and stream reader share: a task asks for the requests of one file."""

    def __init__(self, options: dict):
        self.logs = json.loads(options["logs"])
        self.transport = options["transport"]
        self.attempts, self.wait = int(options.get("attempts", "3")), float(options.get("wait", "1"))

    def read(self, partition: _File) -> Iterator[tuple]:
        module, _, name = self.transport.partition(":")
        call = getattr(importlib.import_module(module), name)
        system, path = fs.FileSystem.from_uri(partition.path)
        with pq.ParquetFile(path, filesystem=system) as f:
            for batch in f.iter_batches(columns=["place", "query", "round"]):
                for place, query, turn in zip(*(batch.column(c).to_pylist() for c in ("place", "query", "round")), strict=True):
                    yield from self._answer(call, place, query, turn)

    def _answer(self, call, place: int, query: str | None, turn: int) -> Iterator[tuple]:
        head, none = (place, query, turn), (None,) * (1 + len(_FIELDS))
        if not (query or "").strip():
            yield (*head, *none, "EmptyQuery: nothing to ask for", 0)
            return
        for tried in range(1, self.attempts + 1):
            try:
                hits = list(call(query))
                break
            except Exception as e:  # any failure of a service is a row
                if tried == self.attempts:
                    yield (*head, *none, f"{type(e).__name__}: {e}", tried)
                    return
                time.sleep(self.wait * 2 ** (tried - 1))
        for k, hit in enumerate(hits):
            yield (*head, k, *(hit.get(x) for x in _FIELDS), None, tried)
        if not hits:
            yield (*head, *none, None, tried)


class _Reader(_Asking, DataSourceReader):
    def partitions(self):
        return [x for log in self.logs for _, folder in _listed(log) for x in _files(folder)] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        return super().read(partition) if partition.path else iter(())


class _StreamReader(_Asking, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {log: 0 for log in self.logs}

    def latestOffset(self) -> dict:
        return {log: len(_listed(log)) for log in self.logs}

    def partitions(self, start: dict, end: dict):
        return [x for log in self.logs for n, folder in _listed(log) if start.get(log, 0) < n <= end.get(log, 0) for x in _files(folder)]


class SearchSource(DataSource):
    """``format("search")`` with options ``logs`` (a JSON list of folders), ``transport`` (``module:function``), ``attempts`` and ``wait`` (seconds before the second try, doubled each time)."""

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return HIT

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def enqueue(requests: DataFrame, log: str, tag: str = "", size: int = 50) -> int:
    """The requests (place, query and, if they are asked for again, round) as the log's next batch; its number.

    Files hold at most ``size`` requests.  A batch with a ``tag`` is written once: the
    same tag again changes nothing, one that was left unfinished is written anew.
    """
    system, root = fs.FileSystem.from_uri(log)
    done = _listed(log)
    for n, folder in done:
        if tag and folder.endswith(f"-{tag}"):
            return n
    turn = F.col("round").cast("int") if "round" in requests.columns else F.lit(0)
    rows = requests.select(F.col("place").cast("long").alias("place"), F.col("query").cast("string").alias("query"), turn.alias("round"))
    rows.write.mode("overwrite").option("maxRecordsPerFile", size).parquet(f"{log}/batch-{len(done) + 1:08d}-{tag}")
    return len(done) + 1


def _options(logs: Sequence[str], transport: str, attempts: int, wait: float) -> dict:
    return {"logs": json.dumps(list(logs)), "transport": transport, "attempts": attempts, "wait": wait}


def search(requests: DataFrame, log: str, transport: str, attempts: int = 3, wait: float = 1.0, size: int = 50) -> DataFrame:
    """SRC2, SRC3, SRC6, SRC7, SRC11-SRC15, SRC18-SRC22, SRC27, SRC28: what a service says to each row of ``requests``.

    ``log`` is a new folder that driver and executors share.  Each action on the result asks again; write it first.
    """
    spark = requests.sparkSession
    enqueue(requests, log, size=size)
    spark.dataSource.register(SearchSource)
    return spark.read.format("search").options(**_options([log], transport, attempts, wait)).load()


def run_searches(spark: SparkSession, log: str, again: str, path: str, checkpoint: str, transport: str, rounds: int = 2, attempts: int = 3, wait: float = 1.0) -> None:
    """STM1: asks for all that waits in ``log`` and ``again`` and appends the answers, a folder for each epoch.

    An epoch that is tried again replaces its folder.  Its failures, read back from
    there, go to the log ``again`` under the epoch's tag, so each is asked for once more
    in a later epoch or run.
    """
    spark.dataSource.register(SearchSource)

    def add(batch: DataFrame, epoch: int) -> None:
        own = f"{path}/epoch={epoch}"
        batch.write.mode("overwrite").parquet(own)
        failed = spark.read.schema(HIT).parquet(own).filter((F.col("error").isNotNull()) & (F.col("attempts") > 0) & (F.col("round") + 1 < rounds))
        if not failed.isEmpty():
            enqueue(failed.withColumn("round", F.col("round") + 1), again, f"e{epoch}")

    stream = spark.readStream.format("search").options(**_options([log, again], transport, attempts, wait)).load()
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def answers(spark: SparkSession, path: str) -> DataFrame:
    """The rows of each request's last round."""
    rows = spark.read.schema(f"{HIT}, epoch long").parquet(path)
    last = F.max("round").over(Window.partitionBy("place", "query"))
    return rows.withColumn("_last", last).filter("round = _last").drop("_last", "epoch")


def stand_in(query: str) -> list[dict]:
    """A transport without a service: up to three hits by the query's hash; one query in sixteen fails for good."""
    import hashlib

    digit = int(hashlib.md5(query.encode()).hexdigest()[0], 16)
    if digit == 0:
        raise ConnectionError("no answer")
    return [{"title": f"{query} {k}", "url": f"https://hits.example.org/{digit}/{k}", "content": query[:20], "engine": "stand-in"} for k in range(digit % 4)]
