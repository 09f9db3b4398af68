"""Messages as batches: a pull client, and Structured Streaming."""

from __future__ import annotations

import asyncio
import json
import time as clock
from collections.abc import Callable, Iterator, Mapping
from datetime import datetime, timedelta, timezone
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.functions.registry import readers
from tidemark.plans.pipeline import Batch, DatasetRunner, run_transaction
from tidemark.session import stage
from tidemark.sources.dsv import union_all
from tidemark.utils import utc

#: Seconds between attempts while a stream isn't there: the first and the longest wait.
BACK_OFF = (5.0, 60.0)
#: Column with the number of a row's message within its fetch.
MESSAGE = "__message"


class StreamMissing(RuntimeError):
    """The stream doesn't exist yet."""


class Message(Protocol):
    data: bytes
    time: datetime

    def ack(self) -> None: ...

    def nak(self) -> None: ...


class Client(Protocol):
    """A durable pull consumer, such as one of JetStream, that the caller owns."""

    def fetch(self, stream: str, subject: str, durable: str | None, batch_size: int, timeout: float) -> list[Message]: ...


def read_message(data: bytes, time: datetime, config: dict[str, Any]) -> DataFrame:
    """A message's rows: its JSON goes to the reader that it names itself (fn_loader_name, fn_loader_args) or that the
    configuration names (fn_name, fn_args)."""
    payload = json.loads(data)
    own = payload if isinstance(payload, dict) else {}
    name = own.get("fn_loader_name") or config.get("fn_name")
    args = own.get("fn_loader_args") or config.get("fn_args") or {}
    df = readers().call_function(name, payload, time, args)
    missing = {"__path", "__created_at"} - set(df.columns)
    if missing:
        raise ValueError(f"reader {name} gave no {sorted(missing)}")
    return df


def decode_json(messages: DataFrame, schema: str, column: str = "data") -> DataFrame:
    """Messages, batch or stream, whose JSON has a known schema: its fields as columns beside the others, and __bad, true
    where the text is no such JSON. All of it is done without Python."""
    parsed = F.from_json(F.col(column), f"{schema}, __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    df = messages.withColumn("__json", parsed)
    bad = F.col(column).isNotNull() & (F.col("__json").isNull() | F.col("__json.__corrupt").isNotNull())
    fields = [f.name for f in df.schema["__json"].dataType.fields if f.name != "__corrupt"]
    return df.select(*(c for c in messages.columns if c != column and c not in fields), *(F.col(f"__json.`{n}`").alias(n) for n in fields), bad.alias("__bad"))


def message_batches(runner: DatasetRunner, client: Client, sleep: Callable[[float], None] = clock.sleep) -> Iterator[Batch]:
    """Fetches until nothing is left (run_until empty) or for ever. Messages are acknowledged after the commit that loads
    or rejects all of their items, or if the audit log has them all; any other one is given back and so comes again.

    An item (path, time) is left out only if the audit log has its path. One that is older than the newest audited
    one is loaded like any other; with late_messages: reject in the input configuration its rows go to the dataset's
    reject table instead, in the same commit as its audit row. With a scrape_limit a fetch loads its first items by time,
    each one whole.
    """
    config = runner.dataset.input_config
    sub, fetch = config.jetstream.get("subscription", {}), config.jetstream.get("fetch") or {}
    if hasattr(client, "configure"):
        client.configure(sub)
    wait, longest = BACK_OFF
    while True:
        try:
            messages = client.fetch(sub.get("stream"), sub.get("subject"), sub.get("durable"), fetch.get("batch_size", 1000), fetch.get("batch_timeout", 5.0))
            wait = BACK_OFF[0]
        except StreamMissing:
            sleep(wait)
            wait = min(2 * wait, longest)
            continue
        if not messages:
            if config.run_until == "empty":
                return
            continue
        rows = union_all([read_message(m.data, utc(m.time), dict(config.payload_ingest)).withColumn(MESSAGE, F.lit(i)) for i, m in enumerate(messages)])
        todo, newest = runner.audit.unaudited(rows.select("__path", "__created_at"), runner.main.name)
        rest = set[int]()
        if runner.dataset.scrape_limit > 0:
            todo, rest = _first_items(rows, todo, runner.dataset.scrape_limit)
        us = F.unix_micros("__created_at")
        items = [(r[0], r[1]) for r in todo.select("__path", us).collect()]  # at most one fetch's
        todo = runner.db.spark.createDataFrame(items, "__path string, __us long")
        fresh = rows.withColumn("__us", us).join(F.broadcast(todo), ["__path", "__us"], "left_semi").drop("__us")
        late = None
        if config.late_messages == "reject" and newest is not None:
            late, fresh = fresh.where(us < newest).drop(MESSAGE), fresh.where(us >= newest)
        last = max((utc(m.time) for i, m in enumerate(messages) if i not in rest), default=utc(messages[0].time))
        yield Batch(
            fresh.drop("__path", "__created_at", MESSAGE),
            last,
            [("nats-jetstream", path, _time(t)) for path, t in items],
            lambda: [m.nak() if i in rest else m.ack() for i, m in enumerate(messages)],  # noqa: B023
            lambda: [m.nak() for m in messages],  # noqa: B023
            late,
        )


def _first_items(rows: DataFrame, todo: DataFrame, limit: int) -> tuple[DataFrame, set[int]]:
    """The first of todo's items by time that have limit rows at most, or the first one alone; and the messages that hold
    some of the others."""
    found = rows.join(todo, ["__path", "__created_at"], "left_semi").groupBy("__path", F.unix_micros("__created_at").alias("us"))
    items = sorted(found.agg(F.count(F.lit(1)).alias("n"), F.collect_set(MESSAGE).alias("messages")).collect(), key=lambda r: (r["us"], r["__path"]))
    n, total = 0, 0
    for r in items:
        total += r["n"]
        if n and total > limit:
            break
        n += 1
    kept = rows.sparkSession.createDataFrame([(r["__path"], r["us"]) for r in items[:n]], "__path string, us long")
    return kept.select("__path", F.timestamp_micros("us").alias("__created_at")), {i for r in items[n:] for i in r["messages"]}


def _time(us: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


class JetStreamMessage:
    """A message of a JetStream subscription; ack and nak wait until the server has them."""

    def __init__(self, message: Any, wait: Callable[[Any], Any]):
        self._message, self._wait = message, wait
        self.data, self.time = message.data, message.metadata.timestamp

    def ack(self) -> None:
        self._wait(self._message.ack())

    def nak(self) -> None:
        self._wait(self._message.nak())


class JetStreamClient:
    """Client over a JetStream context that the caller owns, with the event loop that runs it in another thread.

    The pull subscription is made at the first fetch, with the configuration's options and consumer_args, and kept. A
    fetch that times out is empty; a stream that isn't there raises StreamMissing. consumer_config and not_found are
    those of nats-py, which is needed only where they aren't given.
    """

    def __init__(self, js: Any, loop: asyncio.AbstractEventLoop, consumer_config: Callable[..., Any] | None = None, not_found: type[Exception] | None = None):
        if consumer_config is None or not_found is None:
            from nats.js.api import ConsumerConfig
            from nats.js.errors import NotFoundError

            consumer_config, not_found = consumer_config or ConsumerConfig, not_found or NotFoundError
        self._js, self._loop, self._config, self._not_found = js, loop, consumer_config, not_found
        self._subscription: dict[str, Any] = {}
        self._open: dict[tuple, Any] = {}

    def _wait(self, coroutine: Any) -> Any:
        return asyncio.run_coroutine_threadsafe(coroutine, self._loop).result()

    def configure(self, subscription: Mapping[str, Any]) -> None:
        self._subscription = dict(subscription)

    def fetch(self, stream: str, subject: str, durable: str | None, batch_size: int, timeout: float) -> list[JetStreamMessage]:
        key = (stream, subject, durable)
        try:
            if key not in self._open:
                options, args = self._subscription.get("options") or {}, self._subscription.get("consumer_args") or {}
                self._open[key] = self._wait(self._js.pull_subscribe(subject=subject, durable=durable, stream=stream, config=self._config(**args), **options))
            return [JetStreamMessage(m, self._wait) for m in self._wait(self._open[key].fetch(batch_size, timeout))]
        except self._not_found as e:
            self._open.pop(key, None)
            raise StreamMissing(stream) from e
        except TimeoutError:
            return []


def start_stream(runner: DatasetRunner, stream: DataFrame, checkpoint: str, run_until: str = "empty", interval: str = "10 seconds", name: str | None = None) -> StreamingQuery:
    """A streaming DataFrame of loaded rows through the dataset's pipeline.

    empty: what is there now, then the query ends; forever: a batch every interval. The number of a micro-batch goes
    into the same commit as its rows, so a batch that Spark gives again after a failure changes nothing; late-data state
    is in the manifest and outlives the process.
    """
    key = name or runner.dataset.name

    def each(df: DataFrame, number: int) -> None:
        def work(tx) -> None:
            seen = tx.state.setdefault("streams", {})
            if seen.get(key, -1) >= number:
                return
            seen[key] = number
            # read more than once, and whatever executor is lost
            runner.load(tx, Batch(stage(df, "micro-batch"), utc(None)))

        run_transaction(runner.db, work, wait=1.0)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if run_until == "empty" else writer.trigger(processingTime=interval)).start()


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        module, _, function = options["client"].partition(":")
        import importlib

        self.client = getattr(importlib.import_module(module), function)(options)
        self.most = int(options.get("batch_size", "1000"))

    def initialOffset(self) -> dict:
        return {"sequence": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(self.client.read(start["sequence"], start["sequence"] + self.most))
        return iter(rows), {"sequence": max([start["sequence"], *(r[0] + 1 for r in rows)])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(self.client.read(start["sequence"], end["sequence"])))


class MessageDataSource(DataSource):
    """Format tidemark-messages: rows (sequence, time, data) of a client that can read a range of sequence numbers.
    Option client names module:function that makes it from the options."""

    @classmethod
    def name(cls) -> str:
        return "tidemark-messages"

    def schema(self) -> str:
        return "sequence bigint, time timestamp, data string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(dict(self.options))
