"""The exact operators over vectors, license notices and conversations against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("pagemill.llm")
from pagemill.llm import clusters, licenses, turns  # noqa: E402

# --- centroid clustering -------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims):
    """Every vector against every centroid, in whole numbers."""
    vectors = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v):
            vectors.append((i, [max(-(1 << 27), min(1 << 27, math.floor(256 * c))) for c in v]))
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)[:k]
    centroids = [list(v) for _, v in starts]
    if not centroids:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in vectors:
            members[near(v)[1]].append(v)
        for j, own in members.items():
            centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *near(v)) for i, v in vectors]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    fits = lambda x: x if x < 1 << 63 else None
    return [(i, j, d, fits(inertia[j]), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found]


def clustered(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("x", "x")
    got = clusters.cluster(df, **how)
    return sorted((tuple(r)[:6] for r in got.collect()), key=str), got


@pytest.mark.parametrize("grid", [0.004, 0.5])
def test_clusters_against_brute_force(spark, grid):
    """A coarse grid makes many ties between centroids, on the edge of the annulus too."""
    rng = random.Random(5)
    rows = [(i, [round(rng.uniform(-2, 2) / grid) * grid for _ in range(3)]) for i in range(600)]
    rows += [(700, [0.0, 0.0]), (701, None), (702, [0.1, None, 0.2]), (703, [0.1, float("nan"), 0.2]), (704, [float("inf"), 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (5, [9.0, 9.0, 9.0]), (5, [9.0, 9.0, 9.0]), (6, [-0.0, 1e-9, -1e-9])]
    got, _ = clustered(spark, rows, k=17, rounds=4, dims=3)
    assert got == sorted(plain_clusters(rows, 17, 4, 3), key=str) and len(got) == 604


def test_annulus_compares_few_and_keeps_ties():
    rng = np.random.default_rng(3)
    centroids = (rng.normal(size=(40, 2)) * 40).astype(np.int64)
    x = (rng.normal(size=(3000, 2)) * 60).astype(np.int64)
    number, squared, compared = clusters.Annulus(centroids).nearest(x)
    every = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (squared == every.min(1)).all()
    assert (every == every.min(1)[:, None]).sum() > len(x) and compared.mean() < 20  # there are ties; half of the comparisons are saved


def test_clusters_of_odd_tables(spark):
    assert clustered(spark, [], k=3, dims=2)[0] == []
    assert clustered(spark, [(None, [1.0, 2.0])], k=3, dims=2)[0] == []
    huge = [(1, [3e30, -3e30]), (2, [0.0, 0.0]), (3, [-3e30, 1e300])]
    assert clustered(spark, huge, k=1, rounds=2, dims=2)[0] == sorted(plain_clusters(huge, 1, 2, 2), key=str)
    one = spark.createDataFrame([(1, [1.0, 2.0], 7)], "vec_id long, embedding array<float>, cluster long")
    assert [r.cluster for r in clusters.cluster(one, k=5, dims=2).collect()] == [0]


# --- license scans -------------------------------------------------------------------------------


def plain_scan(text, threshold=licenses.THRESHOLD):
    own = licenses.words(text or "")
    places = [(p, label) for phrase, label in licenses.PHRASES.items() for p in range(len(own)) if own[p : p + len(phrase.split())] == phrase.split()]
    blocks = defaultdict(dict)
    for t, (_, template) in enumerate(licenses.TEMPLATES):
        known = licenses.words(template)
        half = 1
        while half < len(known):
            half *= 2
        for at in range(0, max(1, len(own)), half):
            shared = set(own[at : at + 2 * half]) & set(known)
            if len(shared) * 1.0 >= threshold * len(set(known)) - 1e-9:
                blocks[half, at][t] = shared
    met = {t for b in blocks.values() for t in b}
    every = [(at, at + 2 * half, t, s) for (half, at), b in blocks.items() for t, s in b.items()]
    stands = {t for a, z, t, s in every if not any(s < o and a < y and x < z for x, y, _, o in every)}
    name = lambda ts: {licenses.TEMPLATES[t][0] for t in ts}
    share = max((len(s) / len(set(licenses.words(licenses.TEMPLATES[t][1]))) for b in blocks.values() for t, s in b.items()), default=0.0)
    base = {label for _, label in places}
    at = [p for p, _ in places]
    return len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | name(stands))), 1.0 if at else share, ",".join(sorted(name(met)))


def test_licenses_against_brute_force(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["the", "of", "license", "software", "this", "und", "licence", "über", "version", "work", "file", "x9", "is"]) for _ in range(n))
    texts = [None, "", " \n", "THE", "Released under the MIT License.", "under the mit\nlicense under THE mit license", "CC BY-NC 4.0", "under the mit licenses", "Apache License, Version 2.0", "x" * 70_000]
    for _, notice in licenses.TEMPLATES:
        for drop in (0.0, 0.1, 0.2, 0.25):
            kept = [w for w in notice.split() if rng.random() >= drop]
            texts.append(prose(rng.randint(0, 200)) + "\n" + " ".join(kept) + "\n" + prose(rng.randint(0, 90)))
        texts.append(prose(40) + notice.upper().replace(" ", "\n# ") + prose(10))
    texts.append(prose(60_000) + licenses.TEMPLATES[12][1] + prose(60_000) + licenses.TEMPLATES[15][1])
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(4, texts[4], "y"), (None, texts[20], "z")]
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()]
    want = [(i, *plain_scan(t)) for i, t, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    labels = {r[0]: r[6] for r in got}
    assert labels[4] == "mit" and labels[5] == "mit" and labels[6] == "cc-by-nc" and labels[7] == "" and labels[8] == "apache-2"
    assert sum(bool(r[6]) for r in got) > 40


def test_license_notices_stand_for_themselves(spark):
    notices = dict(licenses.TEMPLATES)
    rows = [(1, notices["agpl-3"]), (2, notices["cc-by-nc-4"]), (3, notices["gpl-2"]), (4, notices["mit"] + " " + notices["apache-2"])]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "agpl-3" and "gpl-3" in got[1].met_labels and got[2].labels == "cc-by-nc-4" and got[3].labels == "gpl-2" and got[4].labels == "apache-2,mit"
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    none = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=[], phrases={}).collect()
    assert [r.labels for r in none] == [""] * 4


# --- the prefix trie of conversations ------------------------------------------------------------


def plain_trie(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    said = {c: [t[3] for t in sorted(own)] for c, own in said.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(said.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children, below, leaves = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for key, own in members.items():
        for d in range(len(key) + 1):
            below[key[:d]] += (len(own) - 1) * len(key[-1][1]) if key else 0
            leaves[key[:d]] += not children[key]
    ends = lambda key, own: hashlib.sha256(",".join(str(c) for c in own if built[c] == key).encode()).hexdigest()
    return {(own[0], len(key), members[key[:-1]][0] if key else None, len(own), children[key], leaves[key], below[key], ends(key, own)) for key, own in members.items()}


def trie(spark, rows, kind="conv_id long, turn long, role string, text string"):
    got = [tuple(r) for r in turns.trie(spark.createDataFrame(rows, kind)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_trie_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for c in [*range(-130, -90), *range(0, 260, 3), *range(1000, 1180), 5001, 5002, 99_999_999_999]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "no", "\U0001f389 yes", "a longer answer"])) for t in range(rng.choice([1, 2, 3, 6, 9]))]
    rows += [(c, t, "user", "same") for c in range(2000, 2100) for t in range(7)]
    rows += [(3000, t, None, f"x{t % 3}") for t in range(150)] + [(3001, t, None, f"x{t % 3}") for t in range(150)] + [(3002, None, "r", None), (3002, 5, None, None), (3002, None, "r", "b"), (3002, None, "r", "b"), (None, 0, "user", "no conversation")]
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_spans_and_ranges(spark, monkeypatch):
    """Small spans of depths and blocks of ids give the same nodes."""
    monkeypatch.setattr(turns, "SPAN", 2)
    monkeypatch.setattr(turns, "IDS", 3)
    rows = [(c, t, "user", f"{t % 5}") for c in range(700, 800) for t in range(3 + c % 20)]
    rows += [(750, None, "user", "x")] * 300  # a long conversation, in several ranges
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie(spark, rows) == plain_trie(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_odd_tables(spark):
    assert trie(spark, []) == set()
    assert trie(spark, [(None, 1, "user", "x")]) == set()
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in range(1, 60)}
    c = next(c for c in h if h[c] >= 1)  # its only turn is before the shared ones end, and its group has no first conversation
    assert trie(spark, [(c, 0, "user", "gone")]) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}
    wide = [(7, 0, "user", "long " * 100_000, 1), (8, 0, "user", "long " * 100_000, 2)]
    got = turns.trie(spark.createDataFrame(wide, "conv_id long, turn long, role string, text string, depth int")).collect()
    assert {tuple(r) for r in got} == plain_trie([r[:4] for r in wide])
