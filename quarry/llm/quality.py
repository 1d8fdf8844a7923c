"""Quality rules, and line labels by a linear-chain conditional random field.

Base rules count words, characters, symbols, repeated lines and words in repeated 8-word windows. A CRF then labels each line
that has a word as content or boilerplate by Viterbi decoding, from what the line looks like and its neighbours' labels; a
document is kept if it doesn't fail the base rules and lines labelled content hold ``share`` of its word characters.

The CRF is trained on the driver, by gradient steps on its log likelihood, on a bounded sample of documents with a quality
label: at most ``train_docs`` of each label, by a hash of their id, one row an id, whole texts, 13 bytes a line. Labels within a
document differ: runs of SEEDS and of other documents' lines of the opposite label are planted in copies of the training
documents, and from the second round on each document's own lines take the labels that the CRF gives them, as long as
lines of its own label keep most of its characters. All documents are labelled whole.

Null texts have no words and fail the base rules. Repeated rows each give a row. Without labelled rows of both kinds the
CRF calls every line content. An empty table gives an empty result. Only the id and text columns are read, and ``quality`` of
the label table. Repeated windows are found by 64-bit hashes.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import WHITE, mix, run_hashes, shingle_hashes, text_slices, words

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
# Words of lines that pages repeat, and such lines to plant.
FURNITURE = frozenset(b"about account advertisement archive archives categories category click comment comments contact cookie cookies copyright download facebook faq follow home instagram license licensed linkedin login logout menu navigation newsletter next password policy posted previous print privacy register registered related reply reserved rights rss search settings share sidebar sign sitemap skip sponsored subscribe tags terms toggle trademark trademarks tweet twitter username whatsapp youtube".split())
SEEDS = [
    "Home | About | Contact | Login",
    "Skip to main content",
    "Home > News > Archive",
    "Copyright 2023 Example Inc. All rights reserved.",
    "(c) 2019 Example Ltd. All Rights Reserved. Privacy Policy | Terms of Use",
    "We use cookies to improve your experience. Accept all cookies",
    "Subscribe to our newsletter",
    "Share this: Facebook Twitter Email Print",
    "Read more",
    "Previous 1 2 3 4 5 Next",
    "Posted on March 3, 2021 by admin | 12 comments",
    "Log in to leave a reply",
    "Tags: news, world, archive",
    "Menu Search Sign in",
    "Follow us on Instagram | YouTube | RSS",
    "Advertisement",
    "Related posts",
    "Contact us | Sitemap | Careers | Help",
    "Terms and conditions apply.",
    "Toggle navigation",
    "Click here to download the app",
    "About Us",
    "Back to top",
    "Username: Password: Forgot your password?",
]
SEGMENT = 32
#: Upper bounds of the bins that a line's measures fall into.
BINS = {
    "words": (2, 5, 10, 20, 40),
    "symbol_share": (0.0, 0.02, 0.08, 0.2),
    "upper_share": (0.0, 0.05, 0.15, 0.4, 0.8),
    "digit_share": (0.0, 0.03, 0.1, 0.3),
    "repeated_share": (0.0, 0.1, 0.25, 0.5, 0.75),
    "adjacent_share": (0.0, 0.02, 0.1, 0.4),
    "word_length": (2.0, 3.5, 5.0, 7.0, 10.0),
    "punctuation_share": (0.0, 0.05, 0.2, 0.6),
    "furniture_share": (0.0, 0.1, 0.3),
}
_FIRST = dict(zip(BINS, np.cumsum([0, *(len(b) + 1 for b in BINS.values())]).tolist(), strict=False))
FLAGS = sum(len(b) + 1 for b in BINS.values())
FEATURES = FLAGS + 3
#: Places for the features of one line; unused ones hold FEATURES, whose weight is 0.
SLOTS = len(BINS) + 3
_BARE = bytes(32 if chr(c) in ".,;:!?|()[]<>\"'/" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def line_features(line: bytes, seen: bool) -> list[int]:
    """Numbers of the features that hold for a line with a word."""
    own = line.split()
    n, size = len(own), sum(map(len, own))
    count = lambda drop: len(line) - len(line.translate(None, drop))
    upper, lower = count(_UPPER), count(_LOWER)
    measures = (n, count(SYMBOLS) / size, upper / max(1, upper + lower), count(_DIGITS) / size, 1 - len(set(own)) / n, sum(map(eq, own, own[1:])) / n, size / n, count(b".,;:!?") / n, len(FURNITURE.intersection(line.translate(_BARE).split())) / n)
    out = []
    for (name, bins), x in zip(BINS.items(), measures, strict=True):
        k = 0
        while k < len(bins) and x > bins[k]:
            k += 1
        out.append(_FIRST[name] + k)
    if seen:
        out.append(FLAGS)
    if own[-1][-1] in b".!?":
        out.append(FLAGS + 1)
    if upper and own[0][:1].isupper():
        out.append(FLAGS + 2)
    return out


def described_lines(text: bytes) -> tuple[list[list[int]], list[int], int]:
    """Features and word characters of each line with a word, and how many of them equal an earlier line."""
    features, sizes, repeated, before = [], [], 0, set()
    for line in text.split(b"\n"):
        own = line.translate(None, b" \t\n\x0b\x0c\r")
        if own:
            seen = line in before
            repeated += seen
            before.add(line)
            features.append(line_features(line, seen))
            sizes.append(len(own.decode("utf-8", "replace")))
    return features, sizes, repeated


def viterbi(scores: list[float], start: float, stay: tuple[float, float, float, float]) -> list[int]:
    """Best labels (1: content) for each line's score of content over boilerplate; stay: transition scores 00, 01, 10, 11."""
    s00, s01, s10, s11 = stay
    zero, one, back = 0.0, start + scores[0], []
    for x in scores[1:]:
        to0, to1 = (zero + s00 >= one + s10), (zero + s01 > one + s11)
        back.append((0 if to0 else 1, 0 if to1 else 1))
        zero, one = max(zero + s00, one + s10), max(zero + s01, one + s11) + x
    labels = [1 if one >= zero else 0]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def packed_lines(features: list[list[int]]) -> np.ndarray:
    """Lines' features as a row of SLOTS each."""
    out = np.full((len(features), SLOTS), FEATURES, np.uint8)
    for row, f in zip(out, features, strict=True):
        row[: len(f)] = f
    return out


def planted(lines: np.ndarray, labels: np.ndarray, pool: np.ndarray, label: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A document with a run of one to six lines of the pool, at its start, its end or anywhere."""
    run = int(rng.integers(1, 7))
    first = int(rng.integers(0, max(1, len(pool) - run + 1)))
    some = pool[first : first + run]
    at = [0, len(lines), int(rng.integers(0, len(lines) + 1))][int(rng.integers(0, 3))]
    return np.concatenate([lines[:at], some, lines[at:]]), np.concatenate([labels[:at], np.full(len(some), label), labels[at:]])


def log_likelihood_steps(sequences: list[tuple[np.ndarray, np.ndarray]], theta: np.ndarray, steps: int, rate: float, decay: float) -> np.ndarray:
    """Adam on the log likelihood of labelled sequences (lines, labels); theta: weights, start, transitions 00, 01, 10, 11."""
    cut = [(x[a : a + SEGMENT], y[a : a + SEGMENT], a == 0, len(x)) for x, y in sequences for a in range(0, len(x), SEGMENT)]
    n = len(cut)
    lines = np.full((n, SEGMENT, SLOTS), FEATURES, np.uint8)
    y, mask = np.zeros((n, SEGMENT), np.int64), np.zeros((n, SEGMENT), bool)
    for i, (x, labels, _, _) in enumerate(cut):
        lines[i, : len(x)], y[i, : len(x)], mask[i, : len(x)] = x, labels, True
    first = np.array([c[2] for c in cut])
    # sequences count by the root of their lines
    each = np.array([c[3] ** -0.5 for c in cut])
    each = each / (each[:, None] * mask).sum()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        g = likelihood_gradient(theta, lines, y, mask, first, each) - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


def likelihood_gradient(theta: np.ndarray, lines: np.ndarray, y: np.ndarray, mask: np.ndarray, first: np.ndarray, each: np.ndarray, value: bool = False):
    """The gradient of the weighted log likelihood of padded sequences, or with ``value`` the likelihood itself."""
    n, longest = mask.shape
    weights, start, trans = np.append(theta[:FEATURES], 0.0), theta[FEATURES], theta[FEATURES + 1 :].reshape(2, 2)
    one = weights[lines].sum(axis=2)
    one[:, 0] += start * first
    emit = np.stack([np.zeros_like(one), one], axis=2)
    forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    forward[:, 0] = emit[:, 0]
    for t in range(1, longest):
        into = np.logaddexp(forward[:, t - 1, 0, None] + trans[0], forward[:, t - 1, 1, None] + trans[1]) + emit[:, t]
        forward[:, t] = np.where(mask[:, t, None], into, forward[:, t - 1])
    z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    both = mask[:, 1:]
    if value:
        said = (one * y * mask).sum(axis=1) + (trans[y[:, :-1], y[:, 1:]] * both).sum(axis=1)
        return (each * (said - z)).sum()
    for t in range(longest - 2, -1, -1):
        out = emit[:, t + 1] + backward[:, t + 1]
        out = np.logaddexp(out[:, 0, None] + trans[:, 0], out[:, 1, None] + trans[:, 1])
        backward[:, t] = np.where(mask[:, t + 1, None], out, 0.0)
    p1 = np.exp(forward[:, :, 1] + backward[:, :, 1] - z[:, None])
    gap = (y - p1) * mask * each[:, None]
    g_weights = np.bincount(lines.ravel(), np.repeat(gap.ravel(), SLOTS), FEATURES + 1)[:FEATURES]
    g_trans = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            p = np.exp(forward[:, :-1, a] + trans[a, b] + emit[:, 1:, b] + backward[:, 1:, b] - z[:, None])
            g_trans[a, b] = (((y[:, :-1] == a) & (y[:, 1:] == b)) * both * each[:, None]).sum() - (p * both * each[:, None]).sum()
    return np.concatenate([g_weights, [(gap[:, 0] * first).sum()], g_trans.ravel()])


def model_of(theta: np.ndarray) -> dict:
    return {"weights": theta[:FEATURES].tolist(), "start": float(theta[FEATURES]), "stay": tuple(theta[FEATURES + 1 :].tolist())}


def train_crf(rows: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 3, steps: int = 60, rate: float = 0.2, decay: float = 1e-3, seed: int = 7) -> dict:
    """Weights of content over boilerplate; rows: (label, lines' features, their word characters) of documents."""
    rows = [r for r in rows if len(r[1])]
    theta = np.zeros(FEATURES + 5)
    if len({y for y, _, _ in rows}) < 2:
        return model_of(theta)
    rng = np.random.default_rng(seed)
    own = [np.full(len(x), y) for y, x, _ in rows]
    seeds = packed_lines(described_lines("\n".join(SEEDS).encode())[0])
    for turn in range(rounds):
        if turn:
            # a document's own lines by the CRF, as long as its label keeps most of its characters
            held = model_of(theta)
            weights = np.append(theta[:FEATURES], 0.0)
            for k, (y, x, sizes) in enumerate(rows):
                labels = np.array(viterbi(weights[x].sum(axis=1).tolist(), held["start"], held["stay"]))
                own[k] = labels if 2 * sizes[labels == y].sum() > sizes.sum() else np.full(len(x), y)
        pool = [np.concatenate([x[labels == t] for (_, x, _), labels in zip(rows, own, strict=True)]) for t in (0, 1)]
        sequences = []
        for k, ((y, x, _), labels) in enumerate(zip(rows, own, strict=True)):
            sequences.append((x, labels))
            sequences.append(planted(x, labels, seeds if y and k % 2 else pool[1 - y], 1 - y, rng))
        theta = log_likelihood_steps(sequences, theta, steps, rate, decay)
    return model_of(theta)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 500, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Train the CRF on documents with a quality label."""
    labels = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    few = [labels.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs) for q in (0, 1)]
    # one row an id, so that the sample is as small as it says
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(few[0].unionByName(few[1])), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text")).select("quality", "text")

    def lines(batches):
        for batch in batches:
            found = [described_lines((t or "").encode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            packed = [packed_lines(f).tobytes() for f, _, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array([sizes for _, sizes, _ in found], pa.list_(pa.int32()))], names=["quality", "lines", "sizes"])

    rows = sample.mapInArrow(lines, "quality int, lines binary, sizes array<int>").collect()
    rows = sorted((r["quality"], bytes(r["lines"]), r["sizes"]) for r in rows)
    return train_crf([(y, np.frombuffer(x, np.uint8).reshape(-1, SLOTS), np.array(sizes)) for y, x, sizes in rows])


def repeat_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each text the words inside a window of WINDOW words that its text has twice or more."""
    hashes, at = shingle_hashes(run_hashes(data, starts, ends - starts), texts, WINDOW)
    keys = mix(hashes + texts[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = at[counts[inverse] > 1]
    change = np.zeros(len(starts) + 1, np.int32)
    change[again] += 1
    np.subtract.at(change, again + WINDOW, 1)
    return np.bincount(texts[np.cumsum(change[:-1]) > 0], minlength=len(offsets) - 1)


def rate_documents(docs: DataFrame, model: dict, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document with the base counts, base_failed, kept, n_lines, n_content_lines and content_share."""
    extra = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("rest")] if keep else []
    docs = docs.select(F.col(id_col).alias("doc_id"), *extra, F.col(text_col).cast("string").alias("text"))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [*((n, T.LongType()) for n in longs), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("n_lines", T.LongType()), ("n_content_lines", T.LongType()), ("content_share", T.DoubleType())]
    schema = T.StructType([*docs.schema.fields[:-1], *(T.StructField(n, t) for n, t in fields)])
    weights, start, stay = model["weights"], model["start"], model["stay"]
    last_col = len(docs.columns) - 1

    def rate(batches):
        for batch in batches:
            out = {n: [] for n, _ in fields}
            for first, last, data, offsets in text_slices(batch.column(last_col)):
                starts, ends, texts = words(data, offsets, WHITE)
                out["n_words"] += np.bincount(texts, minlength=last - first).tolist()
                out["n_repeat_words"] += repeat_words(data, offsets, starts, ends, texts).tolist()
                raw = data.tobytes()
                for r in range(last - first):
                    text = raw[offsets[r] : offsets[r + 1]]
                    features, sizes, repeated = described_lines(text)
                    labels = viterbi([sum(weights[f] for f in line) for line in features], start, stay) if features else []
                    total, content = sum(sizes), sum(s for s, c in zip(sizes, labels, strict=True) if c)
                    out["word_chars"].append(total)
                    out["n_symbols"].append(len(text) - len(text.translate(None, SYMBOLS)))
                    out["n_dup_lines"].append(repeated)
                    out["n_lines"].append(len(labels))
                    out["n_content_lines"].append(sum(labels))
                    out["content_share"].append(content / total if total else 0.0)
            out["base_failed"] = [n < LEAST_WORDS or 100 * k > MOST_REPEATED * n for n, k in zip(out["n_words"], out["n_repeat_words"], strict=True)]
            out["kept"] = [not f and s >= share for f, s in zip(out["base_failed"], out["content_share"], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(out[n], pa.float64() if isinstance(t, T.DoubleType) else pa.bool_() if isinstance(t, T.BooleanType) else pa.int64()) for n, t in fields)], names=schema.names)

    return docs.mapInArrow(rate, schema)


def keep_content(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are kept."""
    return rate_documents(docs, fit(docs, labels), keep=docs.columns).where("kept").select("rest.*")
