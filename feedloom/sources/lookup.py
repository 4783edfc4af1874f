"""Lookups over a network, in batches: each fails on its own, and pages are fetched hop by hop."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.urls import is_public_address

#: Hops that are followed, and bytes of a page that are read.
MOST_HOPS, MOST_BYTES = 3, 2 << 20


def batched(keys: DataFrame, fetch, key: str = "key", size: int = DEFAULT.lookup_batch) -> DataFrame:
    """(key, state, body) of each distinct key: found, not_found, or failed with its batch.

    `fetch(list of keys)` returns {key: body}; it runs on the executors, on at most `size` keys at a time. A batch whose
    fetch raises is `failed` and holds up no other. Null keys are left out.
    """
    rows = keys.select(F.col(key).cast("string").alias("key")).filter("key IS NOT NULL").distinct()

    def run(batches):
        import pandas as pd

        def answer(part):
            try:
                found = fetch(part)
            except Exception:  # noqa: BLE001  whatever the client raises, it is this batch alone
                return pd.DataFrame({"key": part, "state": "failed", "body": None})
            return pd.DataFrame({"key": part, "state": ["found" if k in found else "not_found" for k in part], "body": [found.get(k) for k in part]})

        waiting: list[str] = []
        for pdf in batches:
            waiting += pdf["key"].tolist()
            while len(waiting) >= size:
                yield answer(waiting[:size])
                waiting = waiting[size:]
        if waiting:
            yield answer(waiting)

    return rows.mapInPandas(run, "key string, state string, body string")


def page(url: str, get, resolve, most_hops: int = MOST_HOPS, most_bytes: int = MOST_BYTES) -> str | None:
    """The body of a page, or null where it must not or cannot be read.

    `get(url)` returns (status, headers in lower case, iterator of byte chunks) and follows nothing itself; `resolve(host)`
    returns its addresses. Every hop is looked at again: http or https, and public addresses alone. The body is cut at
    `most_bytes`; what is not HTML is left.
    """
    for _ in range(most_hops + 1):
        at = urlsplit(url)
        if at.scheme not in ("http", "https") or not at.hostname:
            return None
        try:
            addresses = resolve(at.hostname)
            if not addresses or not all(map(is_public_address, addresses)):
                return None
            status, headers, chunks = get(url)
        except OSError:
            return None
        if status in (301, 302, 303, 307, 308):
            if not headers.get("location"):
                return None
            url = urljoin(url, headers["location"])
            continue
        if status != 200 or "html" not in headers.get("content-type", ""):
            return None
        body = b""
        for c in chunks:
            body += c
            if len(body) >= most_bytes:
                break
        return body[:most_bytes].decode("utf-8", errors="replace")
    return None


def healthy(spark: SparkSession, seconds: float = 3.0) -> bool:
    """Whether the session answers a trivial query in time."""
    from concurrent.futures import ThreadPoolExecutor, TimeoutError

    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(lambda: spark.sql("SELECT 1").first()[0] == 1).result(timeout=seconds)
    except TimeoutError:
        return False
    finally:
        pool.shutdown(wait=False)
