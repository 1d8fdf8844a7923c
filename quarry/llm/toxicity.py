"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

Kernel of two words: over all subsequences of three letters, the product of their weights in both, where an occurrence that
spans s letters weighs DECAY ** s (up to SPAN letters), scaled by the weight that a word of that length can hold. Inserted
letters, gaps and doubled letters so cost a part of the similarity only; punctuation and digits inside a word are skipped,
case, width and ornament of letters are folded, and runs of single letters are read as one word. A word over LONGEST letters
stands for its overlapping windows of LONGEST letters, in training and in scoring alike.

Training sees labelled texts as bags of words. Words that stand in toxic texts more often than chance would have it are
positive, and so, from the second turn on, is the most toxic word of a toxic text that has none of them; each comes with
variants that have letters inserted or doubled. Words of texts that aren't toxic are negative. Landmarks are drawn from both;
the words' Nystroem features go into a linear SVM, which then picks the hardest negatives for the next turn. The landmarks'
expansion is one weight for each subsequence, so scoring a word is a sum over its subsequences, equal to the kernel expansion.
A text scores by its MARGINS most toxic places, through a logistic regression fitted on the training texts, so one word that
merely looks like an insult weighs less than several.

Bounds of the training, all parameters: ``train_docs`` texts of each label, taken by a hash of their id, one row an id;
``negatives`` negative words to begin with; ``landmarks``. Training texts and all others are read whole.

Null and empty texts score as texts without a word. Without labelled rows of both kinds every score is 0. Rows with no label
or no id take no part in training; a null id is not held out. Repeated rows each give a row. Words of one or two letters are
below the kernel's subsequences and not seen. Columns other than id and text, also of the label table but for its id and
``toxic``, are never read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import ragged, run_hashes, text_slices, words

DECAY, SPAN, LONGEST, LETTERS = 0.7, 7, 24, 64
WHITE = 255
#: Log-likelihood gain from which a word counts as toxic by its texts' labels alone.
EVIDENCE = 11.0
#: Most toxic places of a text that its score depends on, and the least and largest margin told apart there.
MARGINS, LOW, HIGH = 2, 0.0, 6.0
REMEMBERED = 300_000
_WHITE_TABLE = np.arange(256) == WHITE


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Letter number of each code point up to U+1FFFF: a to z 1 to 26, other letters 27 to 63, white space 255."""
    table = np.zeros(0x20000, np.uint8)
    for c in range(0x20000):
        x = chr(c)
        if x.isspace():
            table[c] = WHITE
        elif x.isalpha():
            plain = (unicodedata.normalize("NFKC", x).lower() or x)[0]
            table[c] = ord(plain) - 96 if "a" <= plain <= "z" else 27 + zlib.crc32(plain.encode()) % (LETTERS - 27)
    return table


def letters_of(data: np.ndarray) -> np.ndarray:
    """Letter number of the character that starts at each byte; 0 inside characters and for all that is no letter."""
    table = letter_table()
    out = table[:256][data]
    out[data >= 0x80] = 0
    two = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    if len(two):
        out[two] = table[(data[two].astype(np.uint32) & 0x1F) << 6 | (data[two + 1] & 0x3F)]
    three = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
    if len(three):
        out[three] = table[(data[three].astype(np.uint32) & 0x0F) << 12 | (data[three + 1].astype(np.uint32) & 0x3F) << 6 | (data[three + 2] & 0x3F)]
    four = np.flatnonzero(data >= 0xF0)
    if len(four):
        point = (data[four].astype(np.uint32) & 0x07) << 18 | (data[four + 1].astype(np.uint32) & 0x3F) << 12 | (data[four + 2].astype(np.uint32) & 0x3F) << 6 | (data[four + 3] & 0x3F)
        # beyond the table: ideographs
        out[four] = np.where(point < len(table), table[np.minimum(point, len(table) - 1)], 27 + point % (LETTERS - 27))
    return out


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts, and start, length and text of each word of three letters or more; of long ones, of their windows."""
    codes = letters_of(data)
    starts, ends, texts = words(codes, offsets, _WHITE_TABLE)
    at = np.flatnonzero((codes > 0) & (codes < WHITE))
    flat = codes[at]
    first = np.searchsorted(at, starts)
    length = np.searchsorted(at, ends) - first
    some = length > 0
    first, length, texts = first[some], length[some], texts[some]
    if len(first):
        new = np.ones(len(first), bool)
        new[1:] = ~((length[1:] == 1) & (length[:-1] == 1) & (texts[1:] == texts[:-1]))
        head = np.flatnonzero(new)
        length = np.add.reduceat(length, head)
        first, texts = first[head], texts[head]
    some = length >= 3
    first, length, texts = first[some], length[some], texts[some]
    if len(length) and length.max() > LONGEST:
        n = np.where(length > LONGEST, -(-(length - LONGEST) // (LONGEST // 2)) + 1, 1)
        owner = np.repeat(np.arange(len(first)), n)
        step = ragged(np.zeros(len(n), np.int64), n)
        # the last window ends with the word
        step = np.minimum(step * (LONGEST // 2), np.maximum(length[owner] - LONGEST, 0))
        first, length, texts = first[owner] + step, np.minimum(length[owner], LONGEST), texts[owner]
    return flat, first, length, texts


@lru_cache(64)
def places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All places i < j < k in a word of n letters that span at most SPAN letters, and their scaled weights."""
    out = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]
    i, j, k = np.array(out).T
    weight = DECAY ** (k - i + 1.0)
    return i, j, k, (weight / np.sqrt((weight**2).sum())).astype(np.float32)


def by_size(length: np.ndarray, rows: int):
    """Words of one size at a time, a number of rows at once: (size, rows)."""
    for size in np.unique(length):
        some = np.flatnonzero(length == size)
        for a in range(0, len(some), rows):
            yield int(size), some[a : a + rows]


def expand(flat: np.ndarray, first: np.ndarray, length: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of ``weights`` over the subsequences of each word, by the kernel's own weights."""
    out = np.zeros(len(first), np.float32)
    for size, some in by_size(length, 512):
        i, j, k, w = places(size)
        word = flat[first[some][:, None] + np.arange(size)].astype(np.int32)
        out[some] = weights[(word[:, i] * LETTERS + word[:, j]) * LETTERS + word[:, k]] @ w
    return out


def landmark_features(marks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences that landmarks hold, sorted, and a row for each landmark with the weight of each."""
    held = []
    for mark in marks:
        word = np.frombuffer(mark.encode("latin-1"), np.uint8).astype(np.int64)
        i, j, k, w = places(len(word))
        held.append(((word[i] * LETTERS + word[j]) * LETTERS + word[k], w))
    used = np.unique(np.concatenate([at for at, _ in held]))
    return used, np.stack([np.bincount(np.searchsorted(used, at), w, len(used)) for at, w in held])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float

    def score(self, margins: np.ndarray) -> np.ndarray:
        """Scores of texts; margins: a row of MARGINS each."""
        return 1 / (1 + np.exp(-np.clip(margins @ self.slopes + self.shift, -60, 60)))


def largest(values: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """The MARGINS largest values of each of n texts, LOW where there are fewer, clipped."""
    out = np.full((n, MARGINS), LOW)
    order = np.lexsort((-values, texts))
    texts = texts[order]
    place = np.arange(len(texts)) - np.searchsorted(texts, texts)
    some = place < MARGINS
    out[texts[some], place[some]] = np.clip(values[order[some]], LOW, HIGH)
    return out


def as_runs(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(units).encode("latin-1"), np.uint8)
    length = np.array([len(u) for u in units], np.int64)
    return flat, np.cumsum(length) - length, length


def variants(units: list[str], seed: int = 7) -> list[str]:
    """Each word with a letter inserted, with a letter doubled, and with two letters inserted."""
    rng = np.random.default_rng(seed)
    out = []
    for u in units:
        at = rng.integers(1, len(u), 3)
        new = [chr(c) for c in rng.integers(1, 27, 3)]
        out.append(u[: at[0]] + new[0] + u[at[0] :])
        out.append(u[: at[1]] + u[at[1] - 1] + u[at[1] :])
        a, b = sorted(at[1:])
        out.append(u[:a] + new[1] + u[a:b] + new[2] + u[b:])
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 300000.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM by Newton steps on the rows inside the margin; y is 1 or -1."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x1.shape[1])
    loss = lambda w: 0.5 * w @ ridge @ w + c * (weight * np.maximum(0, 1 - y * (x1 @ w)) ** 2).sum()
    for _ in range(rounds):
        active = y * (x1 @ w) < 1
        xa, wa = x1[active], weight[active]
        new = np.linalg.solve(ridge + 2 * c * (xa * wa[:, None]).T @ xa, 2 * c * xa.T @ (wa * y[active]))
        step = 1.0
        while step > 1e-4 and loss(w + step * (new - w)) > loss(w):
            step /= 2
        if step <= 1e-4 or np.abs(new - w).max() < 1e-6:
            break
        w = w + step * (new - w)
    return w[:-1], float(w[-1])


def features(runs: tuple[np.ndarray, np.ndarray, np.ndarray], used: np.ndarray, project: np.ndarray) -> np.ndarray:
    """The projections of each word's feature vector; project: a row each, over ``used``."""
    flat, first, length = runs
    columns = np.vstack([np.zeros((1, len(project))), project.T]).astype(np.float32)
    place = np.zeros(LETTERS**3, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    out = np.zeros((len(first), len(project)))
    for size, some in by_size(length, 32):
        i, j, k, w = places(size)
        word = flat[first[some][:, None] + np.arange(size)].astype(np.int32)
        out[some] = np.einsum("btm,t->bm", columns[place[(word[:, i] * LETTERS + word[:, j]) * LETTERS + word[:, k]]], w)
    return out


def train(bags: list[tuple[int, list[str]]], landmarks: int = 256, negatives: int = 4000, turns: int = 8, seed: int = 7) -> Model | None:
    """Fit on (toxic, words) of labelled texts; words are strings of letter numbers, repeated up to MARGINS times each."""
    label = np.array([x for x, _ in bags], float)
    totals = (label == 0).sum(), (label == 1).sum()
    if not all(totals):
        return None
    names = sorted({u for _, units in bags for u in units})
    number = {u: i for i, u in enumerate(names)}
    owner = np.repeat(np.arange(len(bags)), [len(units) for _, units in bags])
    held = np.fromiter((number[u] for _, units in bags for u in units), np.int64, len(owner))
    pairs = np.unique(owner * max(1, len(names)) + held)
    counts = [np.bincount(pairs[label[pairs // max(1, len(names))] == t] % max(1, len(names)), minlength=len(names)) for t in (0, 1)]
    if not counts[1].any():
        return None
    rng = np.random.default_rng(seed)
    runs = as_runs(names)

    # words that stand in toxic texts more often than chance would have it among so many words
    n, prior = counts[0] + counts[1], totals[1] / len(bags)
    p = counts[1] / n
    gain = n * (p * np.log(np.maximum(p, 1e-12) / prior) + (1 - p) * np.log(np.maximum(1 - p, 1e-12) / (1 - prior)))
    told = (p > np.maximum(prior, 0.5)) & (gain > EVIDENCE)
    if not told.any():
        odds = np.log((counts[1] + 0.5) / (totals[1] + 1)) - np.log((counts[0] + 0.5) / (totals[0] + 1))
        told[odds.argmax()] = True
    positive = {int(i): int(counts[1][i]) for i in np.flatnonzero(told)}
    unsaid = np.setdiff1d(np.flatnonzero(label), owner[told[held]])
    clean = np.flatnonzero(counts[0])
    picked = set(rng.permutation(clean)[:negatives].tolist())
    often = counts[0] ** 0.5
    hard: dict[int, None] = {}
    least, model = np.inf, None
    for turn in range(turns):
        pos = sorted(positive, key=lambda i: (-positive[i], names[i]))
        neg = sorted(picked - set(pos))
        marks = pos[: landmarks * 2 // 5]
        marks += list(hard)[: landmarks - len(marks)]
        used, phi = landmark_features([names[i] for i in marks])
        values, vectors = np.linalg.eigh(phi @ phi.T)
        good = values > 1e-6 * values.max()
        project = (vectors[:, good] / np.sqrt(values[good])).T @ phi
        bent = variants([names[i] for i in pos], seed + turn)
        x = features(as_runs([*(names[i] for i in pos), *bent, *(names[i] for i in neg)]), used, project)
        y = np.array([1.0] * (len(pos) + len(bent)) + [-1.0] * len(neg))
        # positive words count by how many texts they tell apart, variants like their words
        weight = np.array([positive[i] for i in pos] + [positive[i] / 3 for i in pos for _ in range(3)] + [often[i] for i in neg], float)
        weight[y > 0] *= 0.5 / weight[y > 0].sum()
        weight[y < 0] *= 0.5 / max(1, weight[y < 0].sum())
        w, bias = linear_svm(x, y, weight)
        weights = np.zeros(LETTERS**3, np.float32)
        weights[used] = w @ project
        margin = expand(*runs, weights) + bias
        order = clean[np.argsort(-np.where(told, 0, np.maximum(0, 0.5 + margin) ** 2 * often)[clean], kind="stable")]
        picked |= set(order[:600].tolist())
        hard |= dict.fromkeys(order[: landmarks * 3 // (5 * turns - 5)].tolist())
        positive = {int(i): int(counts[1][i]) for i in np.flatnonzero(told)}
        for b in unsaid:
            own = held[owner == b]
            if len(own) and margin[own].max() > 0:
                best = int(own[margin[own].argmax()])
                positive[best] = positive.get(best, 0) + 1
        # the turn whose texts are told apart best counts
        seen = largest(margin[held], owner, len(bags))
        slopes, shift = logistic(seen, label)
        own = Model(weights, bias, slopes, shift)
        p = np.clip(own.score(seen), 1e-6, 1 - 1e-6)
        loss = -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()
        if loss < least:
            least, model = loss, own
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of a logistic regression, by Newton steps with a little weight decay; both labels count alike."""
    w = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    design = np.hstack([x, np.ones((len(x), 1))])
    theta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (w * (p - y)) + 1e-3 * theta
        hess = design.T @ (design * (w * p * (1 - p))[:, None]) + 1e-3 * np.eye(len(theta))
        theta = theta - np.linalg.solve(hess, grad)
    return theta[:-1], float(theta[-1])


class Scorer:
    """The largest margins of texts; remembers the words that a worker has scored."""

    def __init__(self, model: Model | None):
        self.model = model
        self.known, self.value = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        flat, first, length, texts = letter_words(data, offsets)
        if not len(first):
            return np.full((n, MARGINS), LOW)
        distinct, where, inverse = np.unique(run_hashes(flat, first, length), return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known, self.value = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            pick = where[new]
            value = expand(flat, first[pick], length[pick], self.model.weights)
            self.known, self.value = np.insert(self.known, at[new], distinct[new]), np.insert(self.value, at[new], value)
            at = np.searchsorted(self.known, distinct)
        return largest(self.value[at][inverse] + self.model.bias, texts, n)


def _held_out(column: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Train on labelled texts whose crc32(id as text) mod 5 is not 0."""
    labels = labels.select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~_held_out("doc_id"))
    # an id that has both labels tells nothing
    labels = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    few = [labels.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs) for t in (0, 1)]
    few = few[0].unionByName(few[1])
    # one row an id, so that the sample is as small as it says
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")

    def bags(batches):
        for batch in batches:
            out = []
            for first_row, last_row, data, offsets in text_slices(batch.column(1)):
                flat, first, length, texts = letter_words(data, offsets)
                letters = flat.tobytes()
                found = [Counter() for _ in range(last_row - first_row)]
                for s, n, t in zip(first.tolist(), length.tolist(), texts.tolist(), strict=True):
                    found[t][letters[s : s + n]] += 1
                # no letter has the number 0
                out += [b"\0".join(u for u, n in f.items() for _ in range(min(n, MARGINS))) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["toxic", "units"])

    rows = sample.mapInArrow(bags, "toxic int, units binary").collect()
    # a word is one object however many texts have it
    held: dict[str, str] = {}
    return train(sorted((r["toxic"], [held.setdefault(u, u) for u in bytes(r["units"]).decode("latin-1").split("\0")] if r["units"] else []) for r in rows))


def score_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted (score >= 0.5); with ``keep``, those columns as well."""
    extra = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("rest")] if keep else []
    docs = docs.select(F.col(id_col).alias("doc_id"), _held_out(id_col).alias("held_out"), *extra, F.col(text_col).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    last_col = len(docs.columns) - 1
    schema = T.StructType([*docs.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches):
        own = Scorer(held.value)
        for batch in batches:
            value = np.zeros(batch.num_rows)
            if own.model is not None:
                for first, last, data, offsets in text_slices(batch.column(last_col)):
                    value[first:last] = own.model.score(own.margins(data, offsets))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(score, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that aren't predicted toxic."""
    scored = score_documents(docs, fit(docs, labels), keep=docs.columns)
    return scored.where("predicted = 0").select("rest.*")
