"""Workers take batches in pieces: what they hold does not grow with the rows of a batch."""

import numpy as np
import pyarrow as pa
import pytest
from feedloom.operators import batches, classify, dedup, scoring, terms


def of(words):
    return pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int64()), pa.array(words)], names=["id", "x"])


@pytest.mark.parametrize("rows", [[["a", "b"], [], ["c"] * 9, None, ["d"], ["e", "f"]], ["ab", "", "c" * 9, None, "d", "éf"]])
def test_pieces_are_bounded_and_whole(rows):
    cut = list(batches.in_pieces([of(rows), of(rows).slice(1, 4)], 1, 3))
    assert [r for b in cut for r in b.column(1).to_pylist()] == rows + rows[1:5]
    assert all(sum(len(r.encode() if isinstance(r, str) else r) for r in b.column(1).to_pylist() if r) <= 3 or len(b) == 1 for b in cut)
    assert list(batches.in_pieces([of(rows).slice(0, 0)], 1, 3)) == []


def test_terms_are_counted_a_piece_at_a_time(monkeypatch):
    rng = np.random.default_rng(1)
    rows = [[f"w{x}" for x in rng.integers(0, 30, 50)] for _ in range(40)]
    monkeypatch.setattr(scoring, "WORDS_AT_ONCE", 200, raising=False)
    out = list(scoring._counted([of(rows)]))
    assert len(out) == 10
    got = {(i, t): n for b in out for i, t, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)}
    assert got == {(i, t): r.count(t) for i, r in enumerate(rows) for t in r}


def test_a_batch_of_shingles_is_cut(monkeypatch):
    monkeypatch.setattr(dedup, "TEXT_BYTES", 12, raising=False)
    out = [r for b in dedup._shingled(2)([of(["a b c d e", "", "a b c d e", "b a", "a b a b a b", None, "a b"])]) for r in b.to_pylist()]
    assert [(r["id"], r["n"]) for r in out] == [(0, 4), (2, 4), (3, 1), (4, 2), (6, 1)]
    sets = {r["id"]: set(r["items"]) for r in out}
    assert all(len(r["items"]) == len(set(r["items"])) for r in out) and len({r["own"] for r in out}) == 4
    assert sets[0] == sets[2] and sets[6] < sets[4] and sets[3] < sets[4] and sets[6] < sets[0] and not sets[3] & sets[0]


def test_bounds_are_small():
    assert max(scoring.WORDS_AT_ONCE, dedup.WORDS_AT_ONCE, classify.GRAMS_AT_ONCE) <= 1 << 18 and max(terms.TEXT_BYTES, dedup.TEXT_BYTES) <= 1 << 20
