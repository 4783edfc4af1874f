import math
import hashlib
import random
import re

from feedloom.llm import pii

#: The contract's own patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(d)))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def texts():
    rng = random.Random(5)
    bits = ["a@b.co", "x.y_z@m-1.example.com", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 123-4567", "+123", "@", ".", "-", " ", "7", "00", "é", "🙂", "_d@e.f", "0001.002.3.255", "%", "+"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    return [*out, None, "", "a" * 30000 + "@", "1" * 30000, "1 " * 9000 + "a@b" + ".c" * 9000, "4111111111111111 " * 1500]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = list(enumerate(texts())) + [(None, "a@b.co"), (3, "a@b.co")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.digest(pii.find(df)).collect()
    assert len(got) == len(rows)
    base = sorted((r["doc_id"] is None, r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got)
    want = []
    for i, t in rows:
        spans = brute(t)
        n = [sum(s.startswith(k + ":") for s in spans) for k in PLAIN]
        want.append((i is None, i, hashlib.sha256(",".join(spans).encode()).hexdigest(), *n))
    assert base == sorted(want)


def test_terms_that_tell_an_entity_are_added_and_clean_texts_left_alone(spark):
    rng = random.Random(1)
    filler = ["river", "stone", "cloud", "light", "table", "green", "under", "walks"]
    say = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, f"{say(6)} Zanzibar owner@mail.example.com {say(6)}") for i in range(6)]
    rows += [(10 + i, say(20)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(df)).collect()}
    for i, t in rows[:6]:
        at = t.index("Zanzibar")
        assert f"removed:{at}:{at + 8}" in spans[i]
        assert "general" not in spans[i] and spans[i].count("removed") == 1
    assert all(not spans[i] for i, _ in rows[6:])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all(clean[i] == t for i, t in rows[6:])
    assert all("Zanzibar" not in clean[i] and "[EMAIL]" in clean[i] and "@" not in clean[i] for i, _ in rows[:6])


def test_sanitise_keeps_rows_columns_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, None, "x", 2), (2, "", None, 3), (2, "ip 1.2.3.4, card 4111111111111111.", "y", 4), (2, "ip 1.2.3.4, card 4111111111111111.", "y", 4)], "doc_id long, text string, spans string, __hash0 int")
    out = pii.sanitise(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, None, "x", 2), (2, "", None, 3), *[(2, "ip [IP], card [CARD].", "y", 4)] * 2], key=str)
    assert pii.digest(pii.find(df.limit(0))).count() == 0


def test_copies_count_once_in_the_statistics(spark):
    rows = [f"write to ann@x.org about zebracode {w} today" for w in ("one", "two", "six")]
    rows = [*rows, *[rows[0]] * 300, *(f"plain filler text number {'abcdefghij'[i % 10]}{i}" for i in range(1000))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    spans = {r["doc_id"]: {(s["kind"], rows[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]} for r in pii.find(df).collect()}
    assert all(("removed", "zebracode") in spans[i] for i in range(303))
    assert not any(spans[i] for i in range(303, len(rows)))


def test_terms_far_from_their_entity_are_found(spark):
    """Ten words away, and at the other end of a long text; copies of a text and clashing columns change nothing."""
    far = "one two three four five six seven eight nine ten eleven twelve " * 60
    rows = [(i, f"Quillfeather {far if i % 2 else 'a b c d e f g h i j k l '} ann@x.org {'say' + 'abcdefghijklmnopqrst'[i]}") for i in range(20)]
    rows += [(100 + i, f"{far} plain {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}") for i in range(500)] + [rows[0]] * 5
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], "doc_id long, text string, hash int, base string, told string, term int")
    got = pii.find(df).collect()
    told = [r for r in got if r["doc_id"] < 20]
    assert len(told) == 25 and all(("removed", 0, 12) in {tuple(s) for s in r["spans"]} for r in told)
    assert all(len([s for s in r["spans"] if s["kind"] == "removed"]) == 1 for r in told)
    assert not any(r["spans"] for r in got if r["doc_id"] >= 100)
    clean = pii.sanitise(df)
    assert clean.columns == df.columns and not clean.filter("text LIKE '%Quillfeather%'").count()


def test_added_spans_equal_brute_force_mutual_information(spark):
    rng = random.Random(9)
    common = ["river", "stone", "cloud", "light", "table", "green"]
    own = {"ann@x.org": ["zebra", "quartz", "river"], "bob@y.net": ["falcon", "quartz", "stone"], "cat@z.com": ["cobalt", "falcon", "cloud"]}
    texts = []
    for _ in range(60):
        mail = rng.choice(list(own))
        pick = lambda: " ".join(rng.choice(own[mail] if rng.random() < 0.5 else common) for _ in range(3))
        texts.append(f"{pick()} {mail} {pick()}")
    texts += [" ".join(rng.choice([*common, "falcon", "zebra"]) for _ in range(5)) for _ in range(150)]
    rows = list(enumerate([*texts, *texts[:20], *[texts[0]] * 30]))
    distinct = set(texts)
    words = {t: {w for w in t.split() if "@" not in w} for t in distinct}
    of = {t: next((w for w in t.split() if "@" in w), None) for t in distinct}
    n = len(distinct)
    kind = {}
    for mail in own:
        near = [t for t in distinct if of[t] == mail]
        for term in set().union(*(words[t] for t in near)):
            both = sum(term in words[t] for t in near)
            share = math.log2(n * both / (len(near) * sum(term in w for w in words.values()))) / math.log2(n / len(near))
            if both >= 3 and share >= 0.5:
                kind[mail, term] = "removed" if share >= 0.8 else "general"
    assert len(set(kind.values())) == 2
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), generalise=0.5, remove=0.8).collect()
    for r in found:
        t = rows[r["doc_id"]][1]
        want = {(kind[of[t], m[0]], m.start(), m.end()) for m in re.finditer("[a-z]+", t) if of[t] and (of[t], m[0]) in kind and not t.index(of[t]) <= m.start() < t.index(of[t]) + len(of[t])}
        assert {(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in ("general", "removed")} == want
