"""Importance resampling towards a target distribution.

1. Features are runs of 1 to 3 words, hashed to a fixed number of buckets by crc32. Words' checksums come from whole arrays at
   once; a run's checksum is put together from those of its words, as appending bytes is linear in a checksum.
2. One pass over the documents and one over the target count the buckets (an array of fixed size for each task, summed by Spark);
   a second pass adds up each document's gains. Weight and score are written, so that nothing below reads a text again.
3. The draw is the ``share`` of the eligible documents with the highest scores (Gumbel noise of the id's digest makes it a sample
   without replacement). Its cutoff is found by numeric bisection: each job counts exactly how many scores are at or above a few
   thresholds between the bounds, until one score is left; ties are cut by the same bisection over their ids.
4. The drawn rows are range-partitioned by score and id; a row's rank is its place in its partition after the rows of all
   partitions before it.

Null and empty texts have no features and weight 0. Documents without an id have no score and are never drawn; they count in the
bucket counts, but not in the number to draw from. Repeated rows each count and each have a row and, if drawn, a rank of their
own. An empty table gives an empty result; without documents or target every gain comes from the counts that there are. Only the
id and text columns are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, NOT_ALNUM, sums, text_slices, words
from .common import written

#: Counters of features.
BUCKETS = 10_000
#: Thresholds that one count job tries: it halves the range log2(STEPS + 1) times.
STEPS = 15
#: Words from this length on get their checksum by themselves.
LONG_WORD = 512
_SHORT = 64


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _byte_table()


def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """What appending zero bytes does to each byte of a checksum: for 0 to 63 of them, and for 64, 128, 256 and so on."""
    short = np.empty((_SHORT, 4, 256), np.uint32)
    short[0] = np.arange(256, dtype=np.uint32)[None] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    after = lambda c: _TABLE[c & 255] ^ (c >> 8)
    for n in range(1, _SHORT):
        short[n] = after(short[n - 1])
    doubled = [after(short[-1])]
    while len(doubled) < 30:
        held = doubled[-1]
        doubled.append(held[0][held & 255] ^ held[1][held >> 8 & 255] ^ held[2][held >> 16 & 255] ^ held[3][held >> 24])
    return short, np.stack(doubled)


_SHORT_SHIFTS, _LONG_SHIFTS = _shifts()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums carried over n more bytes: xor with the checksum of those bytes gives that of the whole."""
    few = n % _SHORT
    out = _SHORT_SHIFTS[few, 0, crc & 255] ^ _SHORT_SHIFTS[few, 1, crc >> 8 & 255] ^ _SHORT_SHIFTS[few, 2, crc >> 16 & 255] ^ _SHORT_SHIFTS[few, 3, crc >> 24]
    many, step = n // _SHORT, 0
    while many.any():
        some = np.flatnonzero(many & 1)
        c, table = out[some], _LONG_SHIFTS[step]
        out[some] = table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]
        many, step = many >> 1, step + 1
    return out


def word_checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each word, all words at once by position, longest first; very long words one by one."""
    out = np.empty(len(starts), np.uint32)
    long = lengths >= LONG_WORD
    for i in np.flatnonzero(long):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes())
    some = np.flatnonzero(~long)
    some = some[np.argsort(lengths[some].astype(np.uint16), kind="stable")[::-1]]
    at, sizes = starts[some], lengths[some]
    c = np.full(len(some), 0xFFFFFFFF, np.uint32)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -k, "left"))
        c[:m] = _TABLE[(c[:m] ^ data[at[:m] + k]) & 255] ^ (c[:m] >> 8)
    out[some] = ~c
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, longest: int = 3, buckets: int = BUCKETS):
    """The bounds of each text's words, and for runs of 1, 2, ... words their buckets by first word (-1: the run leaves the text)."""
    starts, ends, texts = words(data, offsets, NOT_ALNUM)
    lengths = ends - starts
    own = word_checksums(data, starts, lengths)
    spaced = shifted(np.full(len(own), zlib.crc32(b" "), np.uint32), lengths) ^ own
    out, run = [(own % buckets).astype(np.int64)], own
    for k in range(1, longest):
        run = shifted(run[:-1], lengths[k:] + 1) ^ spaced[k:] if len(run) else run
        found = np.full(len(own), -1, np.int64)
        found[: len(run)] = np.where(texts[: len(run)] == texts[k:], (run % buckets).astype(np.int64), -1)
        out.append(found)
    return np.searchsorted(texts, np.arange(len(offsets))), out


def bucket_counts(texts: DataFrame, longest: int = 3, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts of a table with one column; each task hands on an array of fixed size."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                for found in feature_buckets(LOWER[data], offsets, longest, buckets)[1]:
                    total += np.bincount(found[found >= 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(of_docs: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares) of each bucket."""
    n_docs, n_target, size = int(of_docs.sum()), int(of_target.sum()), len(of_docs)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(n_docs + size) / (float(s + 1) * float(n_target + size)))) for s, t in zip(of_docs.tolist(), of_target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = 3) -> DataFrame:
    """doc_id, n_words, n_features and weight of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(gain)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def weigh(batches):
        # the last entry is for runs that leave their text
        gain = np.append(held.value, 0)
        for batch in batches:
            columns = [], [], []
            for _, _, data, offsets in text_slices(batch.column(1)):
                bounds, found = feature_buckets(LOWER[data], offsets, longest, len(gain) - 1)
                columns[0].append(np.diff(bounds))
                columns[1].append(sums(sum((f >= 0).astype(np.int64) for f in found), bounds))
                columns[2].append(sums(sum(gain[f] for f in found), bounds))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(c) if c else [], pa.int64()) for c in columns)], names=schema.names)

    return docs.mapInArrow(weigh, schema)


def _bisected(rows: DataFrame, value: str, least: int, most: int, wanted: int) -> int:
    """The largest x from ``least`` to ``most`` such that at least ``wanted`` rows have a value of x or more, which holds for ``least``."""
    while least < most:
        steps = sorted({least + max(1, (most - least) * i // (STEPS + 1)) for i in range(1, STEPS + 2)})
        counts = rows.agg(*[F.count_if(F.col(value) >= x).alias(f"c{i}") for i, x in enumerate(steps)]).first()
        enough = [x for x, n in zip(steps, counts, strict=True) if n >= wanted]
        more = [x for x, n in zip(steps, counts, strict=True) if n < wanted]
        least, most = max(enough, default=least), min(more, default=most + 1) - 1
    return least


def drawn(scores: DataFrame, wanted: int) -> F.Column:
    """Whether a row of a written table (doc_id, score of the eligible, else null) is among the ``wanted`` highest scores, of equal ones the smallest ids.

    Rows with one score and id, at the cutoff, are all taken; the ranks tell them apart.
    """
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    if wanted <= 0 or low is None:
        return F.lit(False)
    cutoff = _bisected(scores, "score", low, high, wanted)
    above, ties, first, last = scores.agg(F.count_if(F.col("score") > cutoff), F.count_if(F.col("score") == cutoff), *(f(F.when(F.col("score") == cutoff, F.col("doc_id"))) for f in (F.min, F.max))).first()
    if above + ties <= wanted:
        return F.col("score") >= cutoff
    # the smallest id up to which enough ties stand: ids are turned round for it
    turned = scores.where(F.col("score") == cutoff).select((-F.col("doc_id")).alias("turned"))
    smallest = -_bisected(turned, "turned", -last, -first, wanted - above)
    return (F.col("score") > cutoff) | ((F.col("score") == cutoff) & (F.col("doc_id") <= smallest))


def ranked(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, row, score, ...) with their rank from 1: highest score first, then smallest id; rows are range-partitioned for it."""
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("row").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = written(dealt.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)}), "ranked")
    # one row for each partition
    before, edges = 0, []
    for part, n in sorted(map(tuple, dealt.groupBy("part").count().collect())):
        edges.append((part, before))
        before += n
    starts = rows.sparkSession.createDataFrame(edges, "part long, before long")
    return dealt.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.col("at") + 1).drop("part", "at", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, longest: int = 3, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score and rank (null if not drawn).

    floor(percent * N / 100) documents are drawn of the N that have ``least_words`` words or more. ``docs`` has an integer id.
    ``target``: a table with a column of the same name for its texts.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gain = gains(bucket_counts(docs.select("text"), longest, buckets), bucket_counts(target.select(F.col(text_col).cast("string")), longest, buckets))
    digest = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((digest + 0.5) / 4294967296)))
    scored = weighted(docs, gain, longest).withColumns({"score": F.col("weight") + noise, "row": F.monotonically_increasing_id()})
    scored = written(scored, "scored")
    eligible = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    wanted = percent * scored.where(eligible).count() // 100
    take = drawn(scored.select("doc_id", F.when(eligible, F.col("score")).alias("score")), wanted)
    some = F.coalesce(eligible & take, F.lit(False))
    columns = ["doc_id", "n_features", "weight", "score"]
    first = ranked(scored.where(some).select(*columns, "row")).select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return scored.where(~some).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(first)
