"""Stream sources: newline-delimited JSON from files, and poll or socket sources through the Python Data Source API.

Sources that need a network have a method that fetches or connects; a subclass has the client, tests and replays need none.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from .rounds import RoundsReader

COMMIT = (
    "did STRING, time_us BIGINT, kind STRING, commit STRUCT<operation: STRING, collection: STRING, rkey: STRING,"
    " record: STRUCT<`$type`: STRING, text: STRING, createdAt: STRING, langs: ARRAY<STRING>>>"
)


def json_events(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    """Commit events from JSON lines; malformed lines are dropped, the raw line is kept."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return parsed_events(lines)


def parsed_events(lines: DataFrame, line: str = "value") -> DataFrame:
    parsed = lines.withColumn("raw_json", F.col(line)).withColumn("variant", F.try_parse_json(line)).filter("variant IS NOT NULL")
    return parsed.select("raw_json", F.from_json(line, COMMIT).alias("e")).select("raw_json", "e.*")


def posts_of(events: DataFrame) -> DataFrame:
    """Posts of commit events: created ones, in English or of no stated language, not blank."""
    record = F.col("commit.record")
    text = F.trim(F.regexp_replace(record["text"], r"^[ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$", ""))
    langs = F.coalesce(record["langs"], F.array().cast("array<string>"))
    return events.filter((F.col("kind") == "commit") & (F.col("commit.operation") == "create") & record.isNotNull()).filter(
        (F.size(langs) == 0) | F.array_contains(langs, "en")
    ).select(
        F.lit("bluesky").alias("source"),
        F.concat("did", F.lit("/"), F.col("commit.rkey")).alias("source_id"),
        F.col("did").alias("author_id"),
        text.alias("text"),
        F.when(F.array_contains(langs, "en"), "en").alias("lang"),
        F.coalesce(F.try_to_timestamp(record["createdAt"]), F.timestamp_micros("time_us"), F.current_timestamp()).alias("created_at"),
        "raw_json",
    ).filter(F.length("text") > 0)


def accepted_statuses(statuses: DataFrame) -> DataFrame:
    """Public statuses whose account has not opted out; only an explicit false opts out."""
    on = lambda c: F.coalesce(F.col(c), F.lit(True))
    return statuses.filter((F.col("visibility") == "public") & on("account.discoverable") & on("account.indexable") & (F.col("language").isNull() | (F.col("language") == "en")))


def _by_id(id_: str) -> tuple[int, str]:
    return len(id_), id_


class PollSource(DataSource):
    """`spark.readStream.format("polled")`: rows (instance, id, body) of instances, each polled behind its highest id.

    Options: `instances` (comma-joined) and `log`, a URI for what was fetched (see `rounds`). A subclass overrides `fetch`;
    this one replays option `pages`, a JSON object {instance: [[id, body], ...]}, `page` rows at a time.
    """

    @classmethod
    def name(cls):
        return "polled"

    def schema(self):
        return "instance string, id string, body string"

    def fetch(self, instance: str, since: str | None) -> list[tuple[str, str]]:
        """[(id, body)] behind an id; null for the newest there are."""
        found = [(str(i), b) for i, b in json.loads(self.options.get("pages", "{}")).get(instance, [])]
        return sorted((x for x in found if since is None or _by_id(x[0]) > _by_id(since)), key=lambda x: _by_id(x[0]))[: int(self.options.get("page", "1000000"))]

    def _round(self, instance: str, since: str | None):
        page = [(str(i), b) for i, b in self.fetch(instance, since)]
        return page, max([*(i for i, _ in page), *([since] if since else [])], key=_by_id, default=None)

    def streamReader(self, schema):
        return RoundsReader(self.options["instances"].split(","), self.options["log"], self._round, lambda instance, item: [(instance, *item)])


class FirehoseSource(DataSource):
    """`spark.readStream.format("firehose")`: rows (host, value), JSON lines of sockets, each resumed behind its last time_us.

    Options: `hosts`, `log`, and the `most` lines that a round takes. A subclass overrides `connect`; this one replays the
    files of option `replay`, JSON lines by host. A socket that breaks ends the round with what came; the next one
    connects behind it, after a wait if nothing came.
    """

    @classmethod
    def name(cls):
        return "firehose"

    def schema(self):
        return "host string, value string"

    def connect(self, host: str, cursor: int | None):
        """Iterator of lines from `cursor` on, or of the newest."""
        with open(json.loads(self.options["replay"])[host]) as f:
            yield from (line.rstrip("\n") for line in f)

    def _round(self, host: str, cursor: int | None):
        lines = []
        try:
            for line in self.connect(host, cursor):
                try:
                    at = json.loads(line).get("time_us")
                except (ValueError, AttributeError):
                    at = None  # the parser counts and drops it
                if at is not None and cursor is not None and at <= cursor:
                    continue
                lines.append(line)
                cursor = cursor if at is None else at
                if len(lines) >= int(self.options.get("most", "10000")):
                    break
        except Exception:
            if not lines:
                raise
        return lines, cursor

    def streamReader(self, schema):
        return RoundsReader(self.options["hosts"].split(","), self.options["log"], self._round, lambda host, line: [(host, line)])


class ModelRegistry:
    """Artifacts under `<prefix>/<version>/`, immutable, and `<prefix>/latest.json` that names the current one."""

    def __init__(self, root: str, prefix: str):
        from pathlib import Path

        self.dir = Path(root) / prefix

    def current(self) -> str | None:
        f = self.dir / "latest.json"
        return json.loads(f.read_text())["version"] if f.exists() else None

    def versions(self) -> list[str]:
        return sorted(p.name for p in self.dir.iterdir() if p.is_dir()) if self.dir.exists() else []

    def upload(self, version: str, artifacts: dict[str, bytes]) -> None:
        at = self.dir / version
        at.mkdir(parents=True)  # a version is never written twice
        for name, body in artifacts.items():
            (at / name).write_bytes(body)

    def publish(self, version: str, names: list[str]) -> None:
        missing = [n for n in names if not (self.dir / version / n).exists()]
        if missing:
            raise FileNotFoundError(f"{version} lacks {', '.join(missing)}")
        (self.dir / "latest.json").write_text(json.dumps({"version": version}))

    def fetch(self, names: list[str]) -> dict[str, bytes]:
        version = self.current()
        if version is None:
            raise FileNotFoundError("nothing is published")
        return {n: (self.dir / version / n).read_bytes() for n in names}
