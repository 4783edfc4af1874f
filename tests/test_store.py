"""A stored table changes only where it is touched, and stays whole."""

import random
import threading

import pytest
from feedloom.sources import store as S
from feedloom.sources.store import Conflict, Store
from pyspark.sql import functions as F

SCHEMA = "k long, v long, note string"


def rows(store, version=None):
    return sorted(map(tuple, store.rows(version).collect()))


@pytest.fixture
def made(spark, tmp_path):
    df = spark.createDataFrame([(k, k, f"n{k}") for k in range(40)], SCHEMA)
    return Store.of(df, f"file://{tmp_path}/t", ["k"], 8)


def test_mutations_equal_a_dictionary(spark, made):
    held = {k: (k, k, f"n{k}") for k in range(40)}
    rng = random.Random(1)
    df = lambda found, schema=SCHEMA: spark.createDataFrame(found, schema)
    for turn in range(3):
        new = [(rng.randrange(60), rng.randrange(100), f"t{turn}") for _ in range(6)]
        made.insert_ignore(df(new), ["v", "note"])
        for r in sorted(new, key=lambda r: r[1:]):
            held.setdefault(r[0], r)
        new = list({k: (k, rng.randrange(100), "up") for k in rng.sample(range(70), 5)}.values())
        made.upsert(df(new), "v")
        for r in new:
            if r[0] not in held or r[1] >= held[r[0]][1]:
                held[r[0]] = r
        values = [(k, -k) for k in rng.sample(range(70), 4)]
        made.update(df(values, "k long, v long"), ["v"])
        held |= {k: (k, v, held[k][2]) for k, v in values if k in held}
        new = [(k, turn, "part") for k in rng.sample(range(90), 4)]
        made.partial_upsert(df(new), ["v"])
        held |= {r[0]: (r[0], r[1], held[r[0]][2] if r[0] in held else r[2]) for r in new}
        made.mark(df([(turn,), (999,)], "k long"), "note", F.lit("marked"))
        held |= {turn: (turn, held[turn][1], "marked")} if turn in held else {}
        gone = rng.sample(range(3, 40), 3)
        made.delete(df([(k,) for k in gone], "k long"))
        held = {k: r for k, r in held.items() if k not in gone}
        assert rows(made) == sorted(held.values())
    made.delete(df([("part",)], "note string"), ["note"])
    made.retain("v", F.lit(0))
    assert rows(made) == sorted(r for r in held.values() if r[2] != "part" and r[1] >= 0)
    made.cascade(df([(k,) for k in range(20)], "id long"), "k", "id")
    assert rows(made) == sorted(r for r in held.values() if r[2] != "part" and r[1] >= 0 and r[0] < 20)
    made.update(df([(5, 7)], "k long, v long"), ["v"], reset_stale=True)
    assert {r[1] for r in made.rows().collect()} <= {None, 7}


def test_only_touched_buckets_are_written_and_versions_stay(spark, made):
    before, m = rows(made), made.manifest()
    old = made.rows()
    made.upsert(spark.createDataFrame([(3, 1000, "x")], SCHEMA), "v")
    after = made.manifest()
    assert sum(m["buckets"][b] != after["buckets"][b] for b in m["buckets"]) == 1
    assert rows(made, m["version"]) == before == sorted(map(tuple, old.collect())) != rows(made)
    assert made.delete(spark.createDataFrame([(12345,)], "k long")) >= m["version"]  # nothing to delete
    made.insert_ignore(spark.createDataFrame([(100 + k, 1, "y") for k in range(30)], SCHEMA), ["v"])
    made.compact(most_folders=1)
    assert all(len(ds) == 1 for ds in made.manifest()["buckets"].values())
    whole = rows(made)
    assert made.vacuum(keep=1) > 0 and rows(made) == whole and len(made.versions()) == 1


def test_a_killed_writer_leaves_a_whole_table(spark, made, monkeypatch):
    before = rows(made)

    def dies(self, *args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_committed", dies)
        with pytest.raises(KeyboardInterrupt):
            made.upsert(spark.createDataFrame([(3, 1000, "x")], SCHEMA), "v")
    assert rows(made) == before
    assert made.vacuum(keep=1) >= 1 and rows(made) == before  # what the dead writer wrote goes


def test_two_writers(spark, made, monkeypatch):
    """The other one commits between this one's read and its commit: other buckets are kept, the same are done anew."""
    put, raced = Store._written, []

    def slow(self, found, m):
        out = put(self, found, m)
        if not raced:
            raced.append(1)
            made.upsert(spark.createDataFrame([(1, 500, "other"), (2, 500, "other")], SCHEMA), "v")
        return out

    monkeypatch.setattr(Store, "_written", slow)
    made.upsert(spark.createDataFrame([(2, 400, "late"), (30, 400, "mine")], SCHEMA), "v")
    got = {r[0]: r[1:] for r in rows(made)}
    assert got[1] == got[2] == (500, "other") and got[30] == (400, "mine") and len(got) == 40


def test_writers_side_by_side(spark, made):
    failed = []

    def write(k):
        try:
            Store(spark, made.path).insert_ignore(spark.createDataFrame([(200 + j, k, "w") for j in range(10)] + [(300 + k, k, "own")], SCHEMA), ["v"])
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    keys = [r[0] for r in rows(made)]
    assert len(keys) == len(set(keys)) == 40 + 10 + 4


def test_batches_count_once_and_conflicts_end(spark, made, monkeypatch):
    new = spark.createDataFrame([(500, 1, "b")], SCHEMA)
    assert made.append(new, ("job", 0)) > made.manifest(0)["version"]
    at = made.manifest()["version"]
    assert made.append(new, ("job", 0)) == at and [r for r in rows(made) if r[0] == 500] == [(500, 1, "b")]
    assert made.append(new.limit(0), ("job", 1)) == at + 1

    def always(self, *args):
        raise Conflict("overtaken")

    monkeypatch.setattr(Store, "_committed", always)
    monkeypatch.setattr(S, "ATTEMPTS", 2)
    with pytest.raises(Conflict, match="2 times"):
        made.upsert(new, "v")


def test_tables_are_not_mixed_up(spark, made):
    with pytest.raises(ValueError, match="another"):
        Store.create(spark, made.path, "k long, other string", ["k"])
    with pytest.raises(FileNotFoundError):
        Store(spark, made.path + "-none").rows()
    assert Store.create(spark, made.path, SCHEMA, ["k"]).manifest()["version"] >= 1
