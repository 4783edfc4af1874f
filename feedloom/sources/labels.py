"""The label stream: CBOR frames whose sequence number is the offset."""

from __future__ import annotations

import json
import struct
from binascii import unhexlify
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from .rounds import RoundsReader


def decoded(raw: bytes, at: int = 0):
    """The CBOR item that begins at a place, and the place behind it. Byte strings stay bytes; tags are left out."""
    if at >= len(raw):
        raise ValueError("a frame is cut")
    major, info = raw[at] >> 5, raw[at] & 31
    at += 1
    if major == 7:
        if info in (20, 21, 22, 23):
            return (False, True, None, None)[info - 20], at
        size = {25: ">e", 26: ">f", 27: ">d"}.get(info)
        if size is None:
            raise ValueError("a simple value that is not known")
        return struct.unpack_from(size, raw, at)[0], at + struct.calcsize(size)
    if info < 24:
        n = info
    elif info < 28:
        width = 1 << (info - 24)
        if at + width > len(raw):
            raise ValueError("a frame is cut")
        n, at = int.from_bytes(raw[at : at + width], "big"), at + width
    else:
        raise ValueError("lengths must be definite")
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if at + n > len(raw):
            raise ValueError("a frame is cut")
        return (raw[at : at + n] if major == 2 else raw[at : at + n].decode()), at + n
    if major == 6:
        return decoded(raw, at)
    out: list = []
    for _ in range(n * (2 if major == 5 else 1)):
        item, at = decoded(raw, at)
        out.append(item)
    return (dict(zip(out[::2], out[1::2], strict=True)) if major == 5 else out), at


def frame(raw: bytes) -> tuple[str, dict]:
    """Kind and payload of a frame: `labels`, `info`, `error`, or `other` for what cannot be read."""
    try:
        header, at = decoded(raw)
        payload, _ = decoded(raw, at)
    except (ValueError, IndexError, struct.error):
        return "other", {}
    if not isinstance(header, dict) or not isinstance(payload, dict):
        return "other", {}
    if header.get("op") == -1:
        return "error", payload
    return {"#labels": "labels", "#info": "info"}.get(header.get("t"), "other"), payload


def labels_of(payload: dict) -> list[tuple]:
    """Rows (seq, src, uri, val, neg, cts) of a label frame's payload."""
    found = [x for x in payload.get("labels") or [] if isinstance(x, dict)]
    return [(payload["seq"], x.get("src"), x.get("uri"), x.get("val"), bool(x.get("neg", False)), x.get("cts")) for x in found]


def behind(frames, cursor: int | None):
    """Payloads of label frames behind a sequence number.

    Where the server says that the number is outdated, from the oldest frame that it still has. Error frames and frames
    that cannot be read are left out.
    """
    outdated = False
    for raw in frames:
        kind, payload = frame(raw)
        if kind == "info" and payload.get("name") == "OutdatedCursor":
            outdated = True
        elif kind == "labels" and isinstance(payload.get("seq"), int) and (outdated or cursor is None or payload["seq"] > cursor):
            yield payload


class LabelSource(DataSource):
    """`spark.readStream.format("labels")`: rows (seq, src, uri, val, neg, cts) of label servers, resumed by sequence number.

    Options: `hosts`, `log` (see `rounds`), and the `most` frames that a round takes. A subclass overrides `connect`; this
    one replays option `frames`, a JSON array of frames in hex.
    """

    @classmethod
    def name(cls):
        return "labels"

    def schema(self):
        return "seq long, src string, uri string, val string, neg boolean, cts string"

    def connect(self, host: str, cursor: int | None):
        """Iterator of raw frames behind a sequence number, or of the newest."""
        return (unhexlify(x) for x in json.loads(self.options.get("frames", "[]")))

    def _round(self, host: str, cursor: int | None):
        found = list(islice(behind(self.connect(host, cursor), cursor), int(self.options.get("most", "10000"))))
        return [labels_of(p) for p in found], found[-1]["seq"] if found else cursor

    def streamReader(self, schema):
        return RoundsReader(self.options.get("hosts", "labels").split(","), self.options["log"], self._round, lambda host, rows: map(tuple, rows))


def exclusions(labels: DataFrame, adult: tuple[str, ...]) -> DataFrame:
    """(source_id, seq) of posts that an adult label takes out. A retraction brings nothing back: it is left out."""
    from ..functions.urls import post_target

    kept = labels.filter(~F.coalesce(F.col("neg"), F.lit(False)) & F.col("val").isin(*adult))
    return kept.select(post_target(F.col("uri")).alias("source_id"), "seq").filter("source_id IS NOT NULL")
