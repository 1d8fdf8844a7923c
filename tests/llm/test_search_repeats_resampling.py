"""Lexical search, removal of repeats and resampling against brute force, with their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import importance, lexical_search, suffix_dedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def search_by_hand(docs, queries, k):
    own = [(d, Counter(words_of(t))) for d, t in docs]
    n_docs, n_words = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in queries:
        found = []
        for d, c in own:
            n = sum(c.values())
            m = 75 + (25 * n * n_docs) // n_words if n else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in words_of(text) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_search_by_hand(spark, monkeypatch):
    """Several segments, clusters of more than a block, several blocks of queries, ties, repeated rows, null texts and ids, clashing columns."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcñé日x9") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    some = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary[: rng.choice([5, 40, 120])]) for _ in range(n))
    docs = [(i, some(rng.randint(0, 30)), "x") for i in range(1500)] + [(2000, None, "x"), (2001, "", "x"), (None, some(8), "x"), (None, "ABC abc", "x")]
    docs += [docs[3]] * 5 + [(3000 + i, "the same text stands here", "x") for i in range(40)] + [(4000, " ".join(some(30) for _ in range(3000)), "x")]
    queries = [(str(i), some(rng.randint(1, 12))) for i in range(25)] + [("a", None), ("b", ""), (None, some(3)), ("c", "Same same TEXT"), ("c", "Same same TEXT"), ("d", "unknown words only")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n string").withColumnRenamed("n", "score").repartition(3)
    asked = spark.createDataFrame(queries, "item_id string, text string")
    expected = search_by_hand([d[:2] for d in docs], queries, 20)
    assert sorted(map(tuple, lexical_search.search(frame, asked).collect()), key=str) == expected
    monkeypatch.setattr(lexical_search, "SEGMENT_DOCS", 300)
    monkeypatch.setattr(lexical_search, "BLOCK_QUERIES", 9)
    counts = []
    assert sorted(map(tuple, lexical_search.search(frame, asked, counts=counts).collect()), key=str) == expected
    assert len(counts) == 4 and 0 < sum(s for _, s in counts) < sum(a for a, _ in counts)
    assert lexical_search.search(frame.limit(0), asked).count() == 0 == lexical_search.search(frame, asked.limit(0)).count()


def test_bounds_hold_for_every_document():
    """No document scores more than the bound of any block that it is in."""
    rng = np.random.default_rng(5)
    size, n = 60, 700
    rows = [np.sort(rng.choice(size, rng.integers(1, 25), replace=False)) for _ in range(n)]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    terms, impact, weights = np.concatenate(rows), rng.integers(1, 999_999, bounds[-1]), rng.integers(1, 9000, size)
    import pyarrow as pa

    columns = lexical_search._segment(pa.array(range(n)), bounds, terms, impact, weights, rng.normal(size=(size, lexical_search.DIRECTIONS)).astype(np.float32))
    segment = lexical_search.Segment(dict(zip(("ids", *lexical_search.INDEX), columns, strict=True)), size)
    matrix = lexical_search._matrix([rng.choice(size, 7, replace=False) for _ in range(5)], [rng.integers(1, 9000, 7) for _ in range(5)], size)
    limit = segment.block_bounds(matrix)
    for q in range(5):
        for block in np.flatnonzero(limit[:, q] >= 0):
            _, scores = segment.scores(np.array([block]), matrix[:, q].astype(np.int64), np.zeros(n, bool))
            assert scores.max() <= limit[block, q]
    members = [set(segment.members[a:b].tolist()) for a, b in zip(segment.edges[:-1], segment.edges[1:], strict=True)]
    for t in range(size):
        held = [m for m, of in zip(members, segment.of, strict=True) if of == t]
        assert sum(map(len, held)) == len(set().union(*held)) == sum(t in r for r in rows)


def repeats_by_hand(rows, width):
    first = {}
    for d, t in rows:
        own = (t or "").encode()
        for p in range(len(own) - width + 1) if d is not None else ():
            first[own[p : p + width]] = min(first.get(own[p : p + width], d), d)
    out = []
    for d, t in rows:
        own = (t or "").encode()
        gone = [False] * len(own)
        for p in range(len(own) - width + 1) if d is not None else ():
            if first[own[p : p + width]] < d:
                gone[p : p + width] = [True] * width
        spans = sum(g and not b for g, b in zip(gone, [False, *gone], strict=False))
        out.append((d, len(own), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(own, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def repeated():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abñ日") for _ in range(rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(12)] + ["a" * 200, "ab" * 90]

    def text():
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            i = rng.randint(0, len(p) // 2)
            parts.append(p[i : i + rng.randint(10, len(p))] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 15))))
        return rng.choice(["", " "]).join(parts)

    rows = [(rng.choice([i, i, i, i // 2]), text()) for i in range(300)]
    rows += [(7, None), (None, passages[0]), (None, None), (8, ""), (500, passages[0]), (500, passages[0]), (501, passages[0] + passages[1]), (-3, passages[2])]
    # a line of 45 bytes in many surroundings, a very long text, and one that ends and one that starts with what another holds
    rows += [(600 + i, word() * 9 + "a common line of 45 bytes stands here in all x" + word() * 9) for i in range(60)]
    rows += [(700, " ".join(word() for _ in range(40_000)) + passages[3]), (701, passages[3] + " " + passages[3])]
    return rows


@pytest.mark.parametrize("width", [50, 8, 23])
def test_repeats_by_hand(spark, repeated, width):
    rows = [(*r, "x") for r in repeated]
    frame = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(5)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(frame, width).collect()), key=str) == repeats_by_hand(repeated, width)


def test_repeats_without_a_sample_and_as_text(spark, repeated):
    """The sample decides how runs are dealt, not what is found; the kept text is that of the digest. An empty table works."""
    frame = spark.createDataFrame(repeated, "doc_id long, text string").repartition(4)
    found = suffix_dedup.remove_repeats(frame, sampled_docs=10, buckets=3, with_text=True).collect()
    assert sorted([tuple(r)[:5] for r in found], key=str) == repeats_by_hand(repeated, 50)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in found if "�" not in r["text"])
    assert suffix_dedup.remove_repeats(frame.limit(0)).count() == 0


def test_multikey_classes():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (4000, 5)).astype(np.uint64)
    classes = suffix_dedup.multikey_classes(rows)
    ranks = {r: i for i, r in enumerate(sorted(set(map(tuple, rows.tolist()))))}
    assert classes.tolist() == [ranks[tuple(r)] for r in rows.tolist()]


def test_checksums_of_runs():
    rng = random.Random(1)
    own = ["".join(rng.choice("abéñ日z") for _ in range(rng.choice([1, 2, 3, 5, 9, 70, 130, 600, 5000]))) for _ in range(200)]
    text, other = " ".join(own).encode(), " ".join(own[:3]).encode()
    bounds, found = importance.feature_buckets(np.frombuffer(text + other, np.uint8), np.array([0, len(text), len(text) + len(other)]))
    assert bounds.tolist() == [0, 200, 203]
    for k in range(3):
        assert found[k].tolist() == [zlib.crc32(" ".join(w[i : i + k + 1]).encode()) % 10000 if i + k < len(w) else -1 for w in (own, own[:3]) for i in range(len(w))]


def resample_by_hand(docs, target, percent=5, least=20):
    features = lambda t: [" ".join(w[i : i + n]) for w in [words_of(t)] for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    out, some = [], []
    for i, (d, x) in enumerate(docs):
        own = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in map(bucket, own))
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words_of(x)) >= least:
                some.append((-score, d, i))
        out.append([d, len(own), weight, score, None])
    for rank, (_, _, i) in enumerate(sorted(some)[: percent * len(some) // 100]):
        out[i][4] = rank + 1
    return sorted(map(tuple, out), key=str)


def test_resampling_by_hand(spark):
    """Null and empty texts, null ids, repeated rows, a hot id, a very long text and a column that clashes."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcñ日9") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    some = lambda n: " ".join(rng.choice(vocabulary[rng.choice([0, 100]) :]) for _ in range(n))
    docs = [(i, some(rng.randint(0, 60))) for i in range(400)] + [(1000, None), (None, some(30)), (None, None), (1001, ""), (1002, some(60_000))]
    docs += [(77, some(25))] * 200 + [(-5, some(40)), (1 << 60, some(40))]
    target = [some(50) for _ in range(20)] + [None]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 40, 100, 0):
        got = sorted(map(tuple, importance.resample(frame, wanted, percent).collect()), key=str)
        assert got == resample_by_hand(docs, target, percent)
    assert importance.resample(frame.limit(0), wanted).count() == 0
    assert importance.resample(frame, wanted.limit(0)).count() == len(docs)


def test_cutoff_among_ties(spark):
    """Every wanted number of rows with few scores and ids of both signs: the cutoff takes exactly those, but for rows alike in both."""
    rng = random.Random(6)
    rows = [(rng.randint(-40, 40), rng.choice([-3, 0, 5])) for _ in range(60)] + [(9, None)]
    frame = spark.createDataFrame(rows, "doc_id long, score long").cache()
    order = sorted((-s, d) for d, s in rows if s is not None)
    for wanted in (0, 1, 7, 30, 59, 60):
        got = sorted((-r["score"], r["doc_id"]) for r in frame.where(importance.drawn(frame, wanted)).collect())
        cut = order[:wanted]
        assert got == [r for r in order if cut and r <= cut[-1]]
