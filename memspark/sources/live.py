"""A live chat service as a Spark data source: pages of channels, messages and replies, batch or streaming, with a high-water mark for each channel.

The service is reached through a client that the option ``client`` names as ``module:factory``; ``factory()`` gives an object with ``get(method, params)`` that returns one page.
Marks are the stream's offsets: Spark writes them to the checkpoint when a batch is planned and commits them after its sink is done, so a failed batch is read again.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "channel_id string, channel_name string, ts string, user string, text string, thread_ts string"


def pages(client: Any, method: str, key: str, params: dict) -> Iterator[dict]:
    """The objects listed under a key on all pages of a method."""
    cursor = None
    while True:
        page = client.get(method, params | ({"cursor": cursor} if cursor else {}))
        if not page.get("ok"):
            raise RuntimeError(f"{method} failed: {page.get('error', 'unknown error')}")
        yield from (x for x in page.get(key) or [] if isinstance(x, dict))
        cursor = (page.get("response_metadata") or {}).get("next_cursor")
        if not cursor:
            return


def ts_number(ts: str | None) -> float:
    try:
        return float(ts or 0)
    except ValueError:
        return 0.0


def message(m: dict, channel: tuple[str, str], parent: str | None = None) -> tuple | None:
    """The row of a message; null if it has no text or time."""
    text, ts = str(m.get("text") or "").strip(), str(m.get("ts") or "")
    if not text or not ts:
        return None
    return (*channel, ts, str(m.get("user") or m.get("username") or m.get("bot_id") or "unknown"), text, parent or m.get("thread_ts"))


def channel_rows(client: Any, channel: tuple[str, str], oldest: str | None) -> list[tuple]:
    """The messages of a channel after a time, and all replies to those that have any, by time."""
    rows = []
    for m in pages(client, "conversations.history", "messages", {"channel": channel[0], "limit": 200, "inclusive": False} | ({"oldest": oldest} if oldest else {})):
        rows.append(message(m, channel))
        if m.get("reply_count") or m.get("thread_ts"):
            root = str(m.get("ts"))
            rows += [message(r, channel, root) for r in pages(client, "conversations.replies", "messages", {"channel": channel[0], "ts": root, "limit": 200}) if str(r.get("ts")) != root]
    return sorted((r for r in rows if r), key=lambda r: ts_number(r[2]))


class _Reading:
    def __init__(self, options: dict):
        module, _, factory = options["client"].partition(":")
        self.factory = (module, factory)
        self.wanted = {c.strip() for c in options.get("channels", "").split(",") if c.strip()}
        self.lateness = float(options.get("lateness", "0"))

    def client(self) -> Any:
        return getattr(importlib.import_module(self.factory[0]), self.factory[1])()

    def channels(self, client: Any) -> list[tuple[str, str]]:
        """Id and name of the channels asked for, by either; all without a choice."""
        every = [(str(c["id"]), str(c.get("name") or c["id"])) for c in pages(client, "conversations.list", "channels", {"limit": 200}) if c.get("id")]
        return [c for c in every if not self.wanted or self.wanted & set(c)]


class ChannelPartition(InputPartition):
    def __init__(self, channel: tuple[str, str]):
        super().__init__(channel)
        self.channel = channel


class ChatReader(DataSourceReader, _Reading):
    """One task for each channel."""

    def __init__(self, options: dict):
        _Reading.__init__(self, options)

    def partitions(self):
        return [ChannelPartition(c) for c in self.channels(self.client())]

    def read(self, partition):
        yield from channel_rows(self.client(), partition.channel, None)


class ChatStreamReader(SimpleDataSourceStreamReader, _Reading):
    """Each batch holds what is newer than the channels' marks. With ``lateness`` (seconds) older messages are asked for again, so that late replies are not missed; repeated
    rows are for the consumer to drop by channel and ts (``streaming.new_rows``)."""

    def __init__(self, options: dict):
        _Reading.__init__(self, options)

    def initialOffset(self) -> dict:
        return {"marks": "{}"}

    def _since(self, mark: str | None) -> str | None:
        return mark if mark is None or not self.lateness else f"{max(0.0, ts_number(mark) - self.lateness):.6f}"

    def read(self, start: dict):
        client, marks, rows = self.client(), json.loads(start["marks"]), []
        for c in self.channels(client):
            new = channel_rows(client, c, self._since(marks.get(c[0])))
            if new:
                marks[c[0]] = max([*(r[2] for r in new), marks.get(c[0])], key=ts_number)
                rows += new
        return iter(rows), {"marks": json.dumps(marks, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict):
        low, high = json.loads(start["marks"]), json.loads(end["marks"])
        client = self.client()
        for c in self.channels(client):
            if c[0] in high:
                yield from (r for r in channel_rows(client, c, self._since(low.get(c[0]))) if ts_number(r[2]) <= ts_number(high[c[0]]))

    def commit(self, end: dict) -> None:
        pass


class ChatSource(DataSource):
    """Register with ``spark.dataSource.register(ChatSource)``, then ``spark.read.format("chat_live")`` or ``readStream``."""

    @classmethod
    def name(cls) -> str:
        return "chat_live"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return ChatReader(self.options)

    def simpleStreamReader(self, schema):
        return ChatStreamReader(self.options)
