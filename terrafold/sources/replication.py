"""Replication feeds: numbered change files with a state file each, read as a stream whose offset is the sequence number."""

from __future__ import annotations

import io
import os
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from terrafold import schemas
from terrafold.sources import xmlfiles

TIMEOUT_S = 10


class FeedError(RuntimeError):
    """A state or change file that can't be had or read."""


def path_of(seq: int) -> str:
    return f"{seq // 1_000_000:03d}/{seq % 1_000_000 // 1000:03d}/{seq % 1000:03d}"


@dataclass(frozen=True)
class State:
    sequence: int
    timestamp: int  # epoch seconds


def parse_state(text: str) -> State:
    """``key=value`` lines; ``#`` begins a comment and ``\\:`` stands for a colon."""
    got = {}
    for raw in text.splitlines():
        key, sep, value = raw.split("#", 1)[0].strip().partition("=")
        if sep:
            got[key.strip()] = value.strip().replace("\\:", ":")
    try:
        return State(int(got["sequenceNumber"]), xmlfiles.epoch(got["timestamp"]))
    except (KeyError, ValueError) as e:
        raise FeedError("not a state file") from e


class Feed:
    """A feed at a folder or an address."""

    def __init__(self, base: str, suffix: str = "osc.gz"):
        self.base, self.suffix = base.rstrip("/"), suffix

    def fetch(self, name: str) -> bytes:
        try:
            if "://" in self.base and not self.base.startswith("file://"):
                with urllib.request.urlopen(f"{self.base}/{name}", None, TIMEOUT_S) as r:
                    return r.read()
            with open(os.path.join(self.base.removeprefix("file://"), name), "rb") as f:
                return f.read()
        except OSError as e:
            raise FeedError(f"{name} can't be had from {self.base}") from e

    def state(self, seq: int | None = None) -> State:
        """Of a sequence, or the latest."""
        return parse_state(self.fetch("state.txt" if seq is None else f"{path_of(seq)}.state.txt").decode())

    def changes(self, seq: int) -> Iterator[tuple]:
        raw = self.fetch(f"{path_of(seq)}.{self.suffix}")
        if raw[:2] == b"\x1f\x8b":
            import gzip

            raw = gzip.decompress(raw)
        return xmlfiles.changes(io.BytesIO(raw), seq)

    def sequence_at(self, when: int) -> int:
        """The highest available sequence that is strictly older than a time, the latest for times from its own on, the
        lowest for times before all.  Sequences without a state file are stepped over."""
        last = self.state()
        if when >= last.timestamp or last.sequence <= 0:
            return last.sequence

        def near(seq: int, low: int) -> State | None:
            while seq >= low:
                try:
                    return self.state(seq)
                except FeedError:
                    seq -= 1
            return None

        low, high, best, least, halve = 0, last.sequence - 1, None, last, False
        while low <= high:
            # between two known states the place of the time between theirs is guessed, every other time the middle is taken
            if best and not halve and least.timestamp > best.timestamp:
                guess = best.sequence + (least.sequence - best.sequence) * (when - best.timestamp) // (least.timestamp - best.timestamp)
                mid = min(max(guess, low), high)
            else:
                mid = (low + high) // 2
            halve = not halve
            got = near(mid, low)
            if got is None:
                low = mid + 1
            elif got.timestamp < when:
                best, low = got, mid + 1
            else:
                least, high = got, got.sequence - 1
        return (best or least).sequence


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.base, self.suffix = options["path"], options.get("suffix", "osc.gz")
        self.first = int(options.get("startingSequence", 0))

    def initialOffset(self):
        return {"seq": self.first}

    def latestOffset(self, *args):
        return {"seq": Feed(self.base, self.suffix).state().sequence}

    def partitions(self, start, end):
        return [InputPartition(s) for s in range(start["seq"] + 1, end["seq"] + 1)]

    def read(self, partition):
        return Feed(self.base, self.suffix).changes(partition.value)


class Replication(DataSource):
    """``spark.readStream.format("change_feed").option("startingSequence", n).load(base)``: the changes after n."""

    @classmethod
    def name(cls):
        return "change_feed"

    def schema(self):
        return schemas.CHANGES

    def streamReader(self, schema):
        return _Stream(self.options)


def timestamp_text(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
