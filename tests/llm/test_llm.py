"""Brute force, round trips and held-out accuracy of the corpus operators, with their edge cases."""

import hashlib
import itertools
import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import bin_search, bpe, chat, decontaminate, license_scan, ngram_join, packing, quality, token_counts, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def edge_texts():
    rng = random.Random(5)
    alphabet = "ab '\n\t  sdtrelvm'12é½$.日😀 "
    own = ["", " ", "a", "it's 'stuff ''s I'll\n's", "a" * 5000, "naïve “quote” ½", "😀 x", "<|endoftext|> hi", "\x85 \xa0 x", "end  "]
    return own + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]


def test_bpe_equals_the_library(library):
    own, texts = bpe.Encoder(bpe.default_vocabulary()), edge_texts()
    got = []
    for first, last, counts, ids in own.encode(pa.array(texts), with_ids=True):
        edge = np.concatenate([[0], np.cumsum(counts)])
        got += [ids[edge[k] : edge[k + 1]].tolist() for k in range(last - first)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_runs_equal_the_library(library):
    """A megabyte without a break, repeated letters, and borders of blocks at all places; in a time that grows with the length."""
    rng = random.Random(3)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = [some(letters, 1_000_000), some(letters[:26], 100_000), "a" * 100_001, "ab" * 30_000 + "a", "😀" * 3000, "-" * 7001, "the" * 5000]
    texts += [some(rng.choice(["ab", "aab", "thein", "etaoinshrdlu"]), rng.randint(250, 700)) for _ in range(300)]
    own = bpe.Encoder(bpe.default_vocabulary())
    got = [ids.tolist() for text in texts for _, _, _, ids in own.encode(pa.array([text]), with_ids=True)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_counts(spark, library):
    docs = spark.createDataFrame([(1, "héllo world", "x"), (2, None, "x"), (1, "héllo world", "x"), (None, "", "x")], DOCS).withColumnRenamed("lang", "n_tokens")
    got = sorted(map(tuple, token_counts.count_tokens(docs, limit=2).collect()), key=str)
    n = len(library.encode("héllo world").ids)
    assert got == sorted([(1, 12, n, n > 2), (1, 12, n, n > 2), (2, 0, 0, False), (None, 0, 0, False)], key=str)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def documents(spark, n=60, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(k, " ".join(rng.choice(["lorem", "ipsum", "dolor", "zq"]) for _ in range(rng.choice([0, 3, 200, 700, 3000]))), "x") for k in range(n)] + [(900, None, "x")], DOCS)


def test_packing_round_trip(spark, library):
    docs = documents(spark)
    parts: dict[int, dict[int, list[int]]] = {}
    for row in packing.pack_tokens(docs, length=512, window=20_000).collect():
        ids, positions = np.frombuffer(row["input_ids"], "<u2"), np.frombuffer(row["position_ids"], "<u2")
        assert len(ids) == len(positions) == 512 and row["cu_seqlens"][-1] == row["n_tokens"] <= 512
        for doc, start, a, b in zip(row["doc_ids"], row["piece_starts"], row["cu_seqlens"], row["cu_seqlens"][1:], strict=False):
            parts.setdefault(doc, {})[start] = ids[a:b].tolist()
            assert positions[a:b].tolist() == list(range(b - a))
    for row in docs.collect():
        whole = list(itertools.chain.from_iterable(v for _, v in sorted(parts[row["doc_id"]].items())))
        assert whole == library.encode(row["text"] or "", add_special_tokens=False).ids + [2]
    assert packing.pack_tokens(docs.limit(0)).count() == 0


def test_best_fit_search(spark, library):
    docs = documents(spark, 80, 2)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = bin_search.pack_documents(docs).collect()
    fill: dict[int, list] = {}
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2]
        piece = ids[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"] and len(piece) == r["length"]
        assert r["length"] == 1024 or r["piece"] == 0
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in fill.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["length"] for r in got) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values())
    assert len(fill) <= len(packing.best_fit_decreasing([r["length"] for r in got], 1024))


@pytest.mark.parametrize("low, high", [(1, 40), (1, 1023), (200, 700), (340, 520)])
def test_best_fit_decreasing_equals_a_scan(low, high):
    rng = random.Random(high)
    lengths = [rng.randint(low, high) for _ in range(500)] + [1024, 1024]
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 1024) - n)
    bins = packing.best_fit_decreasing(lengths, 1024)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert sorted(1024 - sum(lengths[i] for i in b) for b in bins) == sorted(rooms)


def test_search_gains_bins():
    rng = random.Random(200)
    lengths = [rng.randint(200, 700) for _ in range(4096)]
    assert len(bin_search.search(lengths, 1024)) <= len(packing.best_fit_decreasing(lengths, 1024)) - 10


@pytest.mark.parametrize("low, high", [(1, 1023), (200, 700), (340, 520)])
def test_search_is_no_worse_than_best_fit(low, high, monkeypatch):
    rng = random.Random(low)
    lengths = [rng.randint(low, high) for _ in range(800)]
    one = bin_search.exchange

    def watched(pool, donor):
        """Every exchange raises the sum of squared fills, and fits."""
        step = one(pool, donor)
        bins, room = pool.bins, pool.room
        if step:
            given, taken, to = step
            gain = sum(lengths[i] for i in given) - sum(lengths[i] for i in taken)
            fill, own = 1024 - room[to], 1024 - room[donor]
            assert 0 < gain <= room[to] and (fill + gain) ** 2 + (own - gain) ** 2 > fill**2 + own**2
            assert set(given) <= set(bins[donor]) and set(taken) <= set(bins[to])
        return step

    monkeypatch.setattr(bin_search, "exchange", watched)
    bins = bin_search.search(lengths, 1024)
    assert sorted(i for b in bins for i in b) == list(range(800)) and max(sum(lengths[i] for i in b) for b in bins) <= 1024
    assert len(bins) <= len(packing.best_fit_decreasing(lengths, 1024))


@pytest.mark.parametrize("lengths", [[600] * 4096, [random.Random(1).randint(515, 1000) for _ in range(2048)], [random.Random(2).randint(340, 520) for _ in range(4096)]])
def test_a_shard_costs_under_a_second(lengths):
    import time

    began = time.process_time()
    bins = bin_search.search(lengths, 1024)
    assert time.process_time() - began < 1
    assert bin_search.least_bins(lengths, 1024) <= len(bins) <= len(packing.best_fit_decreasing(lengths, 1024))


def test_lower_bound_by_all_packings():
    """No packing of a few pieces has fewer bins than the bound says."""

    def fewest(items, bins):
        if not items:
            return len(bins)
        put = [fewest(items[1:], [*bins[:k], b - items[0], *bins[k + 1 :]]) for k, b in enumerate(bins) if b >= items[0] and b not in bins[:k]]
        return min([*put, fewest(items[1:], [*bins, 10 - items[0]])])

    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.randint(1, 10) for _ in range(rng.randint(1, 7))]
        assert bin_search.least_bins(lengths, 10) <= fewest(sorted(lengths, reverse=True), [])


def test_repeated_rows_pack_right(spark):
    """A hundred thousand rows of one text and no id are dealt to many shards; no two sequences share a number."""
    docs = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "repeat('word ', 300) AS text")
    got = bin_search.pack_documents(docs).groupBy("sequence_id").agg({"length": "sum", "offset": "max", "*": "count"}).toPandas()
    assert got["sum(length)"].max() <= 1024 and got["count(1)"].sum() == 100_000
    size = int(got["sum(length)"].sum() // 100_000)
    assert len(got) <= -(-100_000 // (1024 // size)) + 1 and (got["max(offset)"] == (got["count(1)"] - 1) * size).all()


def test_levels_gain_over_shards_alone(spark):
    """Bins of different shards exchange: fewer sequences than the shards' own, no piece lost or doubled."""
    rng = random.Random(11)
    sizes = [(i, rng.randint(200, 700)) for i in range(6000)]
    frame = spark.createDataFrame(sizes, "row long, length int")
    got = bin_search.packed_rows(frame, 1024, 300).collect()
    assert sorted(r["row"] for r in got) == list(range(6000))
    fill: dict[int, list] = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], sizes[r["row"]][1]))
    for items in fill.values():
        assert [o for o, _ in sorted(items)] == list(itertools.accumulate([n for _, n in sorted(items)][:-1], initial=0)) and sum(n for _, n in items) <= 1024
    assert len(fill) < len(packing.best_fit_decreasing([n for _, n in sizes], 1024))


def test_chat_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", " lead", "tail \n", "", "<\\|im_end|> <\\\\| x", "日本 😀é", "a|<|"]
    rows = [(c, t, r, x) for c in range(30) for t, (r, x) in enumerate(zip(["user", "assistant", "sys\ntem\\n<|im_sep|>", "assistant"], random.Random(c).choices(texts, k=4), strict=True))]
    rows += [(99, 0, None, None), (99, None, "user", "first"), (None, 0, "assistant", "x")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(talks)).collect()}
    assert len(got) == 32
    for conv in got:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for _, _, r, x in own if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[conv]["loss_chars"] == len(said)


def words_of(text, pattern=r"[^\x20\x09-\x0D]+"):
    import re

    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_quality_base_rules(spark):
    texts = ["", None, "one two", "a b c d e f g h " * 4, "x #$\nx #$\n\n y   z" + " w" * 30, " ".join(map(str, range(40))) + "\n" + " ".join(map(str, range(9)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = {"weights": [0.0] * quality.FEATURES, "start": 1.0, "stay": (0.0, 0.0, 0.0, 0.0)}
    got = {r["doc_id"]: r for r in quality.rate_documents(docs, model).collect()}
    for k, text in enumerate(texts):
        own = __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
        hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
        lines = (text or "").split("\n")
        dup = sum(1 for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r") and x in lines[:i])
        base = len(own) < 20 or 100 * len(hit) > 30 * len(own)
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), base)
        assert not (r["base_failed"] and r["kept"])


def test_viterbi_is_the_best_path():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 7)
        scores, start, stay = [rng.uniform(-2, 2) for _ in range(n)], rng.uniform(-1, 1), tuple(rng.uniform(-1, 1) for _ in range(4))
        value = lambda y: start * y[0] + sum(s for s, k in zip(scores, y, strict=True) if k) + sum(stay[2 * a + b] for a, b in itertools.pairwise(y))
        assert value(quality.viterbi(scores, start, stay)) == pytest.approx(max(value(y) for y in itertools.product((0, 1), repeat=n)))


def test_crf_gradient_equals_differences():
    """The gradient against differences of the likelihood, and the likelihood against an enumeration of all labellings."""
    rng = np.random.default_rng(5)
    lines = rng.integers(0, quality.FEATURES + 1, (4, 5, quality.SLOTS)).astype(np.uint8)
    mask = np.arange(5)[None] < np.array([5, 1, 3, 2])[:, None]
    lines[~mask] = quality.FEATURES
    y, first, each = rng.integers(0, 2, (4, 5)) * mask, np.array([True, True, False, True]), np.array([1.0, 0.5, 2.0, 0.25])
    theta = rng.normal(0, 0.3, quality.FEATURES + 5)
    value = lambda t: quality.likelihood_gradient(t, lines, y, mask, first, each, value=True)
    gradient = quality.likelihood_gradient(theta, lines, y, mask, first, each)
    for k in [*range(0, quality.FEATURES, 5), *range(quality.FEATURES, quality.FEATURES + 5)]:
        step = np.zeros_like(theta)
        step[k] = 1e-5
        assert (value(theta + step) - value(theta - step)) / 2e-5 == pytest.approx(gradient[k], abs=1e-6)
    weights, start, trans = np.append(theta[: quality.FEATURES], 0), theta[quality.FEATURES], theta[quality.FEATURES + 1 :]
    total = 0.0
    for i in range(4):
        n = int(mask[i].sum())
        emit = weights[lines[i, :n]].sum(axis=1)
        emit[0] += start * first[i]
        said = lambda z, emit=emit: sum(e for e, k in zip(emit, z, strict=True) if k) + sum(trans[2 * a + b] for a, b in itertools.pairwise(z))
        total += each[i] * (said(y[i, :n].tolist()) - np.log(sum(np.exp(said(z)) for z in itertools.product((0, 1), repeat=n))))
    assert value(theta) == pytest.approx(total)


def labelled(spark, folder="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


NAVIGATION = ["Home | Products | Blog | Contact", "Copyright 2024 Acme Corp. All rights reserved.", "Privacy Policy | Terms of Service", "Sign up for our newsletter"]


def test_quality_by_labels_and_lines(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    model = quality.fit(docs, labels, train_docs=300)
    got = quality.rate_documents(docs, model).join(labels, "doc_id").where("n_words >= 20").collect()
    good = [r for r in got if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in got if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(r["kept"] for r in bad) <= 0.02 * len(bad)

    # lines of navigation in good documents, and documents of good and bad lines: the share of content decides
    def labels_of(lines):
        features, _, _ = quality.described_lines("\n".join(lines).encode())
        return quality.viterbi([sum(model["weights"][f] for f in x) for x in features], model["start"], model["stay"])

    texts = {q: [r["text"].split("\n") for r in docs.join(labels, "doc_id").where(f"quality = {q}").orderBy("doc_id").collect()] for q in (0, 1)}
    texts = {q: [[x for x in t if x.strip()] for t in texts[q]] for q in texts}
    long = [t for t in texts[1] if 4 <= len(t) <= 12][:100]
    found, others = [], []
    for k, own in enumerate(long):
        at = (0, len(own), len(own) // 2)[k % 3]
        some = NAVIGATION[: 1 + k % 4]
        said = labels_of(own[:at] + some + own[at:])
        found += said[at : at + len(some)]
        others += said[:at] + said[at + len(some) :]
    assert np.mean(found) <= 0.1 and np.mean(others) >= 0.95
    junk = [t for t in texts[0] if len(t) >= 4]
    mixed = [own[:4] + junk[k % len(junk)][:8] for k, own in enumerate(long)]
    rated = quality.rate_documents(spark.createDataFrame([(k, "\n".join(t)) for k, t in enumerate(mixed)], "doc_id long, text string"), model).collect()
    assert sum(0 < r["content_share"] < 1 for r in rated) >= 0.8 * len(rated)
    assert any(r["kept"] for r in rated) and any(not r["kept"] and not r["base_failed"] for r in rated)
    none = quality.fit(docs, labels.limit(0))
    assert quality.viterbi([0.0, 0.0], none["start"], none["stay"]) in ([0, 0], [1, 1])


INSULTS = ["trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"]


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    right = sum(r["predicted"] == r["toxic"] == 1 for r in got)
    assert right >= 0.9 * sum(r["predicted"] for r in got) and right >= 0.9 * sum(r["toxic"] for r in got)
    bent = spark.createDataFrame([(1, "the i.d.i.o.t and s c u m of the", "x"), (2, "of the and thing", "x"), (3, None, "x"), (4, "", "x"), (5, "𝐢𝐝𝐢𝐨𝐭 and ｓｃｕｍ of", "x"), (6, "x" * 100_000, "x")], DOCS)
    said = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(bent, model).collect()}
    assert said == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0}
    # three insults in a clean text, each with a letter put in at a random place, or with stars between its letters
    rng = random.Random(4)
    clean = [r["text"].split() for r in docs.join(labels, "doc_id").where("toxic = 0 and lang = 'en' and length(text) between 150 and 1500").orderBy("doc_id").limit(100).collect()]
    rows = []
    for kind in (0, 1):
        for own in clean:
            own = list(own)
            for _ in range(3):
                x = rng.choice(INSULTS)
                k = rng.randrange(1, len(x))
                own.insert(rng.randrange(len(own)), "*".join(x) if kind else x[:k] + rng.choice("abcdefghijklmnopqrstuvwxyz") + x[k:])
            rows.append((kind, " ".join(own), "x"))
    said = toxicity.score_documents(spark.createDataFrame(rows, DOCS), model).groupBy("doc_id").sum("predicted").collect()
    assert all(r["sum(predicted)"] >= 90 for r in said)
    assert toxicity.fit(docs, labels.limit(0)) is None


def test_long_words_have_one_rule():
    """A word over LONGEST letters stands for its windows, in bags and in scores alike."""
    flat, first, length, texts = toxicity.letter_words(np.frombuffer(b"ab abc " + b"abcdefghij" * 5 + b" a b c", np.uint8), np.array([0, 64]))
    letters = [flat[a : a + n].tobytes() for a, n in zip(first, length, strict=True)]
    long = bytes(k % 10 + 1 for k in range(50))
    assert letters == [b"\1\2\3", *(long[a : a + 24] for a in (0, 12, 24, 26)), b"\1\2\3"]


def test_kernel_expansion_equals_the_kernel():
    """Against an enumeration of all subsequences of three letters."""
    words = ["idiot", "idxiot", "scum", "the", "disgusting"]

    def kernel_row(word):
        own: dict[str, float] = {}
        norm = 0.0
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k - i + 1 <= toxicity.SPAN:
                weight = toxicity.DECAY ** (k - i + 1)
                norm += weight**2
                own[word[i] + word[j] + word[k]] = own.get(word[i] + word[j] + word[k], 0.0) + weight
        return {s: w / norm**0.5 for s, w in own.items()}

    rows = [kernel_row(w) for w in words]
    as_letters = ["".join(chr(ord(c) - 96) for c in w) for w in words]
    used, phi = toxicity.landmark_features(as_letters)
    for k in range(len(words)):
        want = [sum(w * rows[k].get(s, 0.0) for s, w in row.items()) for row in rows]
        weights = np.zeros(toxicity.LETTERS**3, np.float32)
        weights[used] = phi[k]
        assert np.allclose(toxicity.expand(*toxicity.as_runs(as_letters), weights), want, atol=1e-5)
        assert np.allclose(phi @ phi[k], want, atol=1e-5)


def test_licenses_equal_brute_force(spark):
    """Random texts of the phrases' and templates' words, with repeats, ties and a very long text."""
    rng = random.Random(8)
    pool = sorted({w for _, x in license_scan.PHRASES + license_scan.TEXTS[3:5] for w in words_of(x, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")})
    pieces = [x for _, x in license_scan.PHRASES] + [x for _, x in license_scan.TEXTS]

    def some():
        out = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(pieces).split()
            if rng.random() < 0.4:
                del piece[rng.randrange(len(piece))]
            out[rng.randint(0, len(out)) : 0] = piece
        return rng.choice([" ", "-", ", "]).join(out)

    rows = [(k % 140, some()) for k in range(150)] + [(200, None), (201, ""), (202, some() + " cc by nc" * 5000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    want = []
    for doc, text in rows:
        own, places, labels = words_of(text, pattern), [], set()
        for label, phrase in license_scan.PHRASES:
            p = phrase.split()
            at = [i for i in range(len(own) - len(p) + 1) if own[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        more = set(labels)
        for label, template in license_scan.TEXTS:
            t = words_of(template, pattern)
            more |= {label} if any(own[i : i + len(t)] == t for i in range(len(own))) else set()
        want.append((doc, len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), more))
    got = license_scan.scan_licenses(docs).collect()
    mine = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str)
    assert mine == sorted((w[:6] for w in want), key=str)
    whole = {(w[0], w[1]): w[6] for w in want}
    for r in got:
        # a whole license text is always found; one with a word left out may be as well
        assert whole[r["doc_id"], r["n_words"]] <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_places(spark):
    texts = ["Under the MIT license. x under the mit license", "CC BY-NC cc by nc", "apache license, version 2.0", "under the mit", None, "", "x " + license_scan.TEXTS[0][1].replace("publish", "print") + " y", "under the mit license"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(7, texts[7])], "doc_id long, text string")
    got = sorted(license_scan.scan_licenses(docs).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got] == [(2, 0, 5, "mit"), (2, 0, 3, "cc-by-nc"), (1, 0, 0, "apache-2"), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (1, 0, 0, "mit"), (1, 0, 0, "mit")]
    assert got[6]["labels"] == "mit" and 0.75 <= got[6]["score"] < 1 and got[3]["labels"] == ""
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_warc_links(spark):
    rows = [(1, "http://a.org/x", "<title>T</title><p>a &amp; b<script>no</script></p><p>c</p>"), (2, None, None), (3, "http://b.org/\r\nWARC-Type: evil", "<title>x\r\ny</title>&eacute;&#8217;&#x1F600;&amp;lt;&nope;&#0;"), (1, "http://a.org/x", "<title>T</title><p>a &amp; b<script>no</script></p><p>c</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, block string")
    every = warc.build_derivatives(pages).collect()
    got = {(r["page_id"], r["warc_type"]): r for r in every}
    assert len(every) == 12 and len(got) == 9 and got[1, "conversion"]["block"] == "T\na & b\nc"
    assert got[1, "conversion"]["refers_to"] == got[1, "metadata"]["refers_to"] == got[1, "response"]["record_id"]
    assert got[1, "conversion"]["block_digest"] == got[1, "conversion"]["payload_digest"] == "sha256:" + hashlib.sha256("T\na & b\nc".encode()).hexdigest()
    assert "host: a.org\r\n" in got[1, "metadata"]["block"] and got[2, "conversion"]["content_length"] == 0
    assert got[3, "conversion"]["block"] == "x\ny\né’😀&lt;&nope;�"
    for r in every:
        assert uuid.UUID(r["record_id"][1:-1]).version == 8 and uuid.UUID(r["record_id"][1:-1]).variant == uuid.RFC_4122
        names = [x.split(":")[0] for x in r["headers"].split("\r\n")]
        assert len(set(names)) == len(names) and "evil" not in [x.split(": ")[-1] for x in r["headers"].split("\r\n")]
        assert len(r["block"].encode()) == r["content_length"] and r["headers"].endswith(f"Content-Length: {r['content_length']}")
    for r in (got[k, "response"] for k in (1, 2, 3)):
        head, _, body = r["block"].partition("\r\n\r\n")
        assert head.startswith("HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(body.encode())}" in head and r["payload_digest"] == "sha256:" + hashlib.sha256(body.encode()).hexdigest()
    assert warc.build_derivatives(pages.limit(0)).count() == 0


def test_decontamination_blocks_and_spans(spark):
    docs = spark.createDataFrame([(1, "A b c d e f g h i j k"), (2, "nothing here"), (3, None), (4, "x short-item y")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "b c d e f g h i j k l"), (2, "Short item"), (5, ""), (6, None)], "item_id long, text string")
    one = sorted(map(tuple, decontaminate.scan_documents(docs, bench).collect()))
    many = sorted(map(tuple, decontaminate.scan_documents(docs, bench, block_windows=1).collect()))
    assert one == many and [(r[0], r[2], r[3], r[5]) for r in one] == [(1, 10, 1, True), (2, 0, 0, False), (3, 0, 0, False), (4, 2, 1, True)]
    for size in (1, 1000):
        assert {r["doc_id"]: r["text"] for r in decontaminate.remove_contamination(docs, bench, mode="span", block_windows=size).collect()} == {1: "A ", 2: "nothing here", 3: None, 4: "x  y"}
        assert sorted(r["doc_id"] for r in decontaminate.remove_contamination(docs, bench, block_windows=size).collect()) == [2, 3]
    assert decontaminate.scan_documents(docs, bench.limit(0)).where("contaminated").count() == 0
    named = bench.selectExpr("concat('item-', item_id) AS item_id", "text")
    assert {r["doc_id"]: r["n_items"] for r in decontaminate.scan_documents(docs, named).collect()} == {1: 1, 2: 0, 3: 0, 4: 1}


@pytest.mark.parametrize("block", [40, 10_000])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    """Over ten blocks and long items in parts, or one block; repeated rows and items, ties, a very long text."""
    monkeypatch.setattr(decontaminate, "PART", 7)
    rng = random.Random(9)
    some = lambda n: " ".join(rng.choice(["Foo", "bar", "baz", "été", "x1"]) for _ in range(n))
    items = [(k, some(rng.choice([0, 1, 3, 9, 10, 11, 40]))) for k in range(40)] + [(3, "Foo bar baz"), (3, "Foo bar baz"), (77, "Foo bar baz")]
    texts = [some(rng.randint(0, 30)) + "; -" + items[rng.randrange(40)][1].upper().replace("ÉTÉ", "été") + some(3) for _ in range(60)] + [some(30_000), None, ""]
    rows = [(k % 61, t) for k, t in enumerate(texts)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for item, text in items:
        w = words_of(text, pattern)
        n = min(10, len(w))
        windows |= {(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n}
    by_window = {}
    for item, w in windows:
        by_window.setdefault(w, set()).add(item)
    want = []
    for doc, text in rows:
        w, hit, found = words_of(text, pattern), set(), set()
        for n in {len(x) for x in by_window}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in by_window:
                    hit.update(range(i, i + n))
                    found |= by_window[tuple(w[i : i + n])]
        want.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, decontaminate.scan_documents(docs, bench, block_windows=block).collect())) == sorted(want)


def brute_components(rows):
    sets = {}
    for k, (_, text) in enumerate(rows):
        w = words_of(text)
        sets[k] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
    group = list(range(len(rows)))
    find = lambda x: x if group[x] == x else find(group[x])
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            group[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), doc), doc)
    return sorted((doc, len(sets[k]), least[find(k)]) for k, (doc, _) in enumerate(rows))


def copies_of(base, n, rng, word, least, most):
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(least, most)):
            own[rng.randrange(len(own))] = word()
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("crowded, block", [(16, 4096), (0, 7)])
def test_join_equals_brute_force(spark, monkeypatch, crowded, block):
    """Chains of near copies, two large balls whose rims meet, shared passages, copies, short and empty texts, a very long one."""
    monkeypatch.setattr(ngram_join, "CROWDED", crowded)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    base = [word() for _ in range(80)]
    passage = [word() for _ in range(50)]
    texts = ["", None, "one two", "One two", "a b c d", " ".join(base)]
    texts += copies_of(base, 90, rng, word, 0, 3)
    second = list(base)
    second[10:13] = [word() for _ in range(3)]
    second[50:52] = [word() for _ in range(2)]
    texts += copies_of(second, 60, rng, word, 0, 2)
    drift = [word() for _ in range(80)]
    for _ in range(25):
        drift = list(drift)
        drift[rng.randrange(80)] = word()
        texts.append(" ".join(drift))
    texts += [" ".join([word() for _ in range(rng.randint(1, 60))] + passage) for _ in range(50)]
    texts += [texts[7]] * 5 + [" ".join(word() for _ in range(20_000))]
    rng.shuffle(texts)
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(rows)
    assert sorted(map(tuple, ngram_join.link_documents(docs).collect())) == want
    if block == 7:
        return
    assert ngram_join.link_documents(docs.limit(0)).count() == 0
    # repeated rows, an id that two unrelated texts share, and one that two linked texts share
    more = [(5000, "one two three four five six seven"), (5000, "alpha beta gamma delta epsilon zeta"), (5001, "alpha beta gamma delta epsilon zeta"), (4999, "one two three four five six seven"), (6000, texts[7]), (6000, " ".join(base)), (7000, "zz yy xx ww"), (7000, "zz yy xx ww"), (None, "zz yy xx ww")]
    whole = docs.union(docs.limit(20)).union(spark.createDataFrame(more, "doc_id long, text string"))
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_one_of_each(whole).collect() if r["text"]), key=str)
    alone = {c for _, n, c in want if n}
    first = {d: t for d, t in rows if d in alone}
    assert kept == sorted([*first.items(), (4999, more[3][1]), (5000, more[1][1]), (7000, "zz yy xx ww"), (None, "zz yy xx ww")], key=str)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "u long, v long")
    assert {r["vertex"]: r["component"] for r in ngram_join.components(edges).collect()} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
            assert out.count() <= seen
            seen, docs = out.count(), out
    assert out.select("doc_id").distinct().count() == seen


def test_stages_keep_rows_they_should(spark):
    """Nulls in any column, clashing names, repeated rows, and empty tables, through every stage."""
    import corpus_pipeline

    good = " ".join(f"and{chr(97 + k % 26)} the thing{chr(97 + k * 7 % 26)} of it." for k in range(12))
    schema = "doc_id long, text string, score double, hits int, rest string, node long, sig string, n long, held_out int"
    rows = [(1, good, 0.5, 1, "r", 2, "s", 3, None), (1, good, 0.5, 1, "r", 2, "s", 3, None), (None, good, None, None, None, None, None, None, None), (2, None, 1.0, 1, "r", 2, "s", 3, 4), (3, "", 1.0, 1, "r", 2, "s", 3, 4)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert ngram_join.keep_one_of_each(docs).where("doc_id = 1").count() == 1
    assert ngram_join.keep_one_of_each(docs).where("doc_id is null").count() == 1
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == 5
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), SF).count() == 0


def tagless_by_hand(html):
    """A page without scripts, styles, comments and tags, read character by character."""
    blocks, raw, white = set(warc.BLOCKS.split("|")), {"script", "style", "noscript"}, " \t\n\x0b\f\r"

    def end_of_tag(at):
        """After the tag whose name ends at ``at``, or -1; quotes count right after an equals sign."""
        if at < len(html) and html[at] == ">":
            return at + 1
        first, start = html.find(">", at), at
        while at < len(html) and html[at] != ">":
            if html[at] == "=":
                quote = at + 1
                while quote < len(html) and html[quote] in white:
                    quote += 1
                close = html.find(html[quote], quote + 1) if quote < len(html) and html[quote] in "\"'" else -1
                at = close if close >= 0 else at
            at += 1
        return at + 1 if at < len(html) else first + 1 if first >= start and first >= 0 else -1

    html, out, at = html.translate({0xFFFE: None, 0xFFFF: None}), [], 0
    while at < len(html):
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            out.append(" ")
            at = end + 3 if end >= 0 else len(html)
            continue
        if html[at] == "<" and html[at + 1 : at + 2] in ("!", "?") and html.find(">", at) >= 0:
            at = html.find(">", at) + 1
            continue
        name_at = at + 1 + (html[at + 1 : at + 2] == "/")
        if html[at] == "<" and html[name_at : name_at + 1].isascii() and html[name_at : name_at + 1].isalpha():
            name_end = name_at
            while name_end < len(html) and html[name_end] not in white + "/>":
                name_end += 1
            name, end = html[name_at:name_end].lower(), end_of_tag(name_end)
            if end > 0:
                if name in raw and name_at == at + 1:
                    out.append(" ")
                    low, close = html.lower(), end
                    while (close := low.find(f"</{name}", close)) >= 0:
                        after = close + len(name) + 2
                        if after < len(html) and (html[after] in white + "/>") and html.find(">", after) >= 0:
                            break
                        close += 1
                    at = html.find(">", close) + 1 if close >= 0 else len(html)
                else:
                    out.append("\n" if name in blocks else "")
                    at = end
                continue
        out.append(html[at])
        at += 1
    return "".join(out)


def test_hard_pages(spark):
    """Attributes with tags in them, code with end tags in it, unclosed elements, signs that are no tags: as read character by character."""
    hard = '<a title="x > y">link</a> if a < b and c > d then <script>var s="</style>"; hidden()</script> end<script>open()'
    pages = [hard, "<p title='a>b'>x</p><br/>y", "<!-- <p> -- > x -->z<!--open", "<SCRIPT a='>'>x</scripty></Script >y", "1 < 2 <3 > <", "<a href=it's>k</a>'>", "<a b=\"never closed>t</a>", "<div", "</p >q</ p>", "<?php x ?><!doctype html>d", "<script/>x</script>y", "<noscript><p>n</p></noscript>m", "￿<p>￿z", "<p" + " a='1'" * 20_000 + ">long</p>", "<" * 5000, "<b>" * 3000 + "t"]
    rng = random.Random(4)
    parts = ["<", ">", "=", '"', "'", "/", " ", "a", "p", "<p>", "</p>", "<b x='", "<script>", "</script>", "<!--", "-->", "<style a=\">\">", "</style", "text", "\n", "!", "?", "&amp;"]
    pages += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(list(enumerate(pages)), "id long, html string").repartition(4)
    got = dict(map(tuple, frame.select("id", warc.tagless(F.col("html"))).collect()))
    assert [got[i] for i in range(len(pages))] == [tagless_by_hand(p) for p in pages]
    built = {r["warc_type"]: r["block"] for r in warc.build_derivatives(spark.createDataFrame([(1, "u", f"<title a='>'>A &lt;b&gt; &#{'9' * 40};\n</title>{hard}&#x{'f' * 30};&#{'0' * 30}65;")], "page_id long, url string, html string")).collect()}
    assert "title: A <b> � \r\n" in built["metadata"] and built["conversion"] == "A <b> �\nlink if a < b and c > d then end"


def test_stages_run_under_their_bounds(spark):
    """A stage's rows are written before it returns, so no batch of it is made under another session setting; the setting comes back."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs, sf)
        assert "MapInArrow" not in left._jdf.queryExecution().executedPlan().toString(), name
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
        assert sorted(left.columns) == sorted(docs.columns) or name == "best-fit packing"
        assert left.count()
