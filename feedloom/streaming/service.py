"""The scoring cycle as a running job over stored tables: stages in order, each when it is due."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import cycle
from ..sources.store import Store
from ..sources.tables import unprocessed
from .state import Throttle

#: What is kept of a post that no exclusion takes.
PROCESSED = (
    "id long, created_s long, cluster long, canonical boolean, sentiment double, sentiment_method string, topicality double, bot_score double, is_bot boolean,"
    " category string, category_method string, penalty double, base_score double, pipeline_version string, rank_score double, position long"
)
#: Seconds between two runs of a stage, and between two rounds with nothing to do and with posts left.
EVERY = {"guard": 30.0, "score": 0.0, "refresh": 30.0, "retention": 3600.0}
IDLE, BACKLOG = 300.0, 3.0


class Service:
    """Rounds over raw posts (id, source, author_id, text, lang, raw_json, created_s) and what is processed of them.

    `score(posts, now)` returns the rows of PROCESSED but for the rank, of posts that stay; those that do not are deleted
    from the raw table, so every raw post is looked at once. `fits()` says whether there is room; without, posts wait and
    only what is too old goes. All writes are mutations that may be repeated, so a round that dies is done again.
    """

    def __init__(self, raw: Store, processed: Store, score: Callable[[DataFrame, float], DataFrame], fits: Callable[[], bool] = lambda: True, beat: Callable[[dict], None] = lambda counts: None, every: dict[str, float] | None = None, batch: int = 500, keep_s: float | None = None, cfg: Config = DEFAULT):
        self.raw, self.processed, self.score, self.fits, self.beat, self.batch, self.cfg = raw, processed, score, fits, beat, batch, cfg
        self.throttle, self.room = Throttle(EVERY if every is None else every), True
        self.keep_s = cfg.window_h * 3600 if keep_s is None else keep_s

    def round(self, now: float) -> dict:
        """Run the stages that are due: counts of posts read, processed and filtered, and the stages that ran."""
        counts = {"read": 0, "processed": 0, "filtered": 0, "stages": []}

        def due(stage: str) -> bool:
            ran = self.throttle.due(stage, now)
            counts["stages"] += [stage] * ran
            return ran

        if due("guard"):
            self.room = self.fits()
        if self.room and due("score"):
            done = self.processed.rows().select(F.col("id").alias("raw_post_id"))
            ids = [r["id"] for r in unprocessed(self.raw.rows().select("id", "created_s"), done, self.batch).select("id").collect()]  # a batch at most
            if ids:
                posts = self.raw.rows().filter(F.col("id").isin(ids))
                kept = self.score(posts, now).withColumns({"rank_score": F.lit(None).cast("double"), "position": F.lit(None).cast("long")})
                self.processed.insert_ignore(kept, ["created_s"])
                stay = {r["id"] for r in self.processed.rows().filter(F.col("id").isin(ids)).select("id").collect()}
                if gone := [i for i in ids if i not in stay]:
                    self.raw.delete(posts.sparkSession.createDataFrame([(i,) for i in gone], "id long"))
                counts |= {"read": len(ids), "processed": len(stay), "filtered": len(gone)}
        if due("refresh"):
            order = cycle.ranked(self.processed.rows(), self.raw.rows(), F.lit(now).cast("long"), self.cfg)
            self.processed.update(order, ["rank_score", "position"], reset_stale=True)
        if due("retention"):
            for table in (self.raw, self.processed):
                table.retain("created_s", F.lit(now - self.keep_s))
        self.beat(counts)
        return counts

    def run(self, once: bool = False, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep, rounds: int | None = None) -> dict:
        """Round after round, or one; waits longer when there was nothing to do. Returns the last round's counts."""
        while True:
            counts = self.round(clock())
            rounds = None if rounds is None else rounds - 1
            if once or rounds == 0:
                return counts
            sleep(BACKLOG if counts["read"] == self.batch else IDLE)
