"""Streams from endpoints that cannot be asked twice for the same rows: one reader an endpoint, and a log of what it got.

The offset is a vector: how many rounds each endpoint has had. In a round a task asks one endpoint for what is behind
its cursor and writes the answer down, with the next cursor, before it returns a row; a batch that is run again reads
what is written. So endpoints are read side by side on the executors, a replay returns the same rows without a fetch,
and one that fails has an empty round, waits longer each time, and holds up no other.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

#: Rounds of an endpoint that are kept behind the last one that is done.
KEPT = 10


def backoff(attempt: int, first: float = 5.0, most: float = 60.0) -> float:
    """Seconds before a reconnect: doubled from `first` up to `most`."""
    return min(most, first * 2 ** max(0, attempt))


class Log:
    """Rounds of an endpoint as files; a name says the round, failures in a row and until when to wait (milliseconds)."""

    def __init__(self, folder: str, endpoint: str):
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(folder)
        self.dir = f"{root}/{uuid.uuid5(uuid.NAMESPACE_URL, endpoint).hex}"

    def rounds(self) -> dict[int, tuple[int, int, str]]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.dir, allow_not_found=True))
        names = [f.base_name.removesuffix(".json") for f in found if f.base_name.endswith(".json")]
        return {n: (failed, until, f"{self.dir}/{name}.json") for name in names for n, failed, until in [map(int, name.split("-"))]}

    def read(self, path: str) -> dict:
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def write(self, n: int, failed: int, until: int, entry: dict) -> None:
        self.fs.create_dir(self.dir, recursive=True)
        part = f"{self.dir}/{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps(entry).encode())
        self.fs.move(part, f"{self.dir}/{n:012d}-{failed}-{until}.json")

    def forget(self, below: int) -> None:
        for n, (_, _, path) in self.rounds().items():
            if n < below:
                self.fs.delete_file(path)


class Rounds(InputPartition):
    """The rounds of one endpoint behind `start`, up to `end`."""

    def __init__(self, endpoint: str, start: int, end: int):
        super().__init__((endpoint, start, end))
        self.endpoint, self.start, self.end = endpoint, start, end


class RoundsReader(DataSourceStreamReader):
    """Reads `fetch(endpoint, cursor)`, which returns (items, next cursor), both of JSON; `rows(endpoint, item)` are an item's rows.

    `folder` is a URI that the driver and all executors reach. A cursor is null at first. `clock` returns seconds.
    """

    def __init__(self, endpoints: list[str], folder: str, fetch: Callable, rows: Callable, clock: Callable[[], float] = time.time):
        self.endpoints, self.folder, self.fetch, self.rows, self.clock = endpoints, folder, fetch, rows, clock

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.endpoints, 0)

    def latestOffset(self) -> dict:
        """One round more for each endpoint that is not to wait; names of files tell, nothing is fetched here."""
        out, now = {}, self.clock() * 1000
        for e in self.endpoints:
            done = Log(self.folder, e).rounds()
            last = max(done, default=0)
            out[e] = last + 1 if not last or done[last][1] <= now else last
        return out

    def partitions(self, start: dict, end: dict) -> list[Rounds]:
        found = [Rounds(e, start.get(e, 0), n) for e, n in end.items() if n > start.get(e, 0)]
        return found or [Rounds("", 0, 0)]

    def read(self, partition: Rounds):
        if not partition.endpoint:
            return
        log, e = Log(self.folder, partition.endpoint), partition.endpoint
        done = log.rounds()
        for n in range(partition.start + 1, partition.end + 1):
            if n not in done:
                self._ask(log, e, n, done)
                done = log.rounds()
            for item in log.read(done[n][2])["items"]:
                yield from self.rows(e, item)

    def _ask(self, log: Log, endpoint: str, n: int, done: dict) -> None:
        failed, _, path = done.get(n - 1, (0, 0, None))
        cursor = log.read(path)["cursor"] if path else None
        try:
            items, cursor = self.fetch(endpoint, cursor)
        except Exception:  # noqa: BLE001  whatever a client raises, it is this endpoint's round alone
            log.write(n, failed + 1, int((self.clock() + backoff(failed)) * 1000), {"items": [], "cursor": cursor})
        else:
            log.write(n, 0, 0, {"items": items, "cursor": cursor})

    def commit(self, end: dict) -> None:
        for e, n in end.items():
            Log(self.folder, e).forget(n - KEPT)
