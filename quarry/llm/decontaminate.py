"""Benchmark decontamination by a broadcast set of test n-grams.

The benchmark's words become numbers of a small vocabulary and its windows rows of those numbers. Each task turns a text's
words into the same numbers (0: not a benchmark word), keeps the windows without a 0 whose hash is in the broadcast set, and
verifies each hit number by number. The benchmark is the side that is broadcast: its windows are counted first, and where there
are more than ``block_windows`` they are dealt into blocks of about that many, long items in parts. One block at a time is
collected, broadcast, scanned against all documents, and its hits are written before the next one is read; the blocks' hits
are then merged by document.

A window is ``n`` consecutive words of an item; an item of fewer words, but not none, is one window of its own length.
Null texts have no words. Repeated rows each give a row; benchmark items with the same text count as an item each, and items
without an id don't count. Ids of items may be of any type and are read as strings. Without benchmark windows nothing is hit.
Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, NOT_ALNUM, mix, ragged, text_slices, words
from .common import written

_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
#: Every byte as its lower-case form, or as a space if it separates words.
_WORD_BYTES = bytes(32 if c < 128 and not chr(c).isalnum() else int(LOWER[c]) for c in range(256))
#: First words of windows in one part of a long item.
PART = 4096


def normal_words(text: str | bytes | None) -> list[bytes]:
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return raw.translate(_WORD_BYTES).split()


@dataclass
class Windows:
    """The windows of a block: numbers of words; for each window length its sorted hashes, rows, and items' names as bounds and numbers."""

    numbers: dict[bytes, int]
    names: np.ndarray
    lengths: list[int]
    hashes: list[np.ndarray]
    rows: list[np.ndarray]
    bounds: list[np.ndarray]
    owners: list[np.ndarray]


def hashed(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = h * _MULTIPLIER + rows[:, k].astype(np.uint64)
    return mix(h)


def item_windows(items: list[tuple], n: int) -> Windows:
    """The distinct windows of (item, text) rows, each with the items that have it."""
    numbers: dict[bytes, int] = {}
    names, whose = np.unique(np.array([str(item) for item, _ in items], object), return_inverse=True) if items else (np.zeros(0, object), np.zeros(0, np.int64))
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, (_, text) in zip(whose.tolist(), items, strict=True):
        own = np.array([numbers.setdefault(w, len(numbers) + 1) for w in normal_words(text)], np.int32)
        if len(own):
            by_size.setdefault(min(n, len(own)), []).append((item, own))
    out = Windows(numbers, names, [], [], [], [], [])
    for size, held in sorted(by_size.items()):
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(own, size) for _, own in held])
        owner = np.repeat([item for item, _ in held], [len(own) - size + 1 for _, own in held])
        hashes = hashed(rows)
        order = np.lexsort((owner, *rows.T[::-1], hashes))
        rows, owner, hashes = rows[order], owner[order], hashes[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        fresh = new.copy()
        fresh[1:] |= owner[1:] != owner[:-1]
        first = np.flatnonzero(new)
        out.lengths.append(size)
        out.hashes.append(hashes[first])
        out.rows.append(rows[first])
        out.owners.append(owner[fresh].astype(np.int32))
        out.bounds.append(np.append(np.cumsum(fresh)[first] - 1, fresh.sum()))
    return out


def hits(numbers: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Which of the words are hit, and the numbers of the items whose windows occur; numbers: of a text's words."""
    change, items = np.zeros(len(numbers) + 1, np.int64), [np.zeros(0, np.int32)]
    known = np.concatenate([[0], np.cumsum(numbers > 0)])
    for size, hashes, rows, bounds, owners in zip(windows.lengths, windows.hashes, windows.rows, windows.bounds, windows.owners, strict=True):
        if len(numbers) < size:
            continue
        at = np.flatnonzero(known[size:] - known[:-size] == size)
        if not len(at):
            continue
        view = numbers[at[:, None] + np.arange(size)]
        h = hashed(view)
        place = np.searchsorted(hashes, h)
        some = np.arange(len(at))
        # equal hashes stand side by side; each is verified
        while len(some):
            some = some[place[some] < len(hashes)]
            some = some[hashes[place[some]] == h[some]]
            same = some[(rows[place[some]] == view[some]).all(axis=1)]
            np.add.at(change, at[same], 1)
            np.add.at(change, at[same] + size, -1)
            found = np.unique(place[same])
            items.append(owners[ragged(bounds[found], bounds[found + 1] - bounds[found])])
            place[some] += 1
    return np.cumsum(change[:-1]) > 0, np.unique(np.concatenate(items))


def without_words(text: bytes, where: np.ndarray) -> str:
    """A text without runs of its words (by their numbers), each from the first byte of the first to the last of the last."""
    part = np.frombuffer(text, np.uint8)
    starts, ends, _ = words(LOWER[part], np.array([0, len(part)]), NOT_ALNUM)
    heads = np.flatnonzero(np.diff(where, prepend=-9) > 1)
    tails = np.append(heads[1:], len(where)) - 1
    cuts = [0, *np.stack([starts[where[heads]], ends[where[tails]]], axis=1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)).decode("utf-8", "replace")


def _scan(docs: DataFrame, block: list[tuple], n: int, hits_only: bool = False) -> DataFrame:
    """Rows of docs (..., text) with n_words, hits (numbers of hit words) and items; with ``hits_only``, only rows that have a hit."""
    held = docs.sparkSession.sparkContext.broadcast(item_windows(block, n))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
    keep = len(docs.columns) - 1

    def scan(batches):
        windows = held.value
        get = windows.numbers.get
        for batch in batches:
            n_words, hit_rows, item_rows = [], [], []
            for first, last, data, offsets in text_slices(batch.column(keep)):
                raw = data.tobytes()
                for r in range(last - first):
                    own = raw[offsets[r] : offsets[r + 1]].translate(_WORD_BYTES).split()
                    n_words.append(len(own))
                    hit, items = hits(np.fromiter((get(w, 0) for w in own), np.int32, len(own)), windows)
                    hit_rows.append(np.flatnonzero(hit).astype(np.int32))
                    item_rows.append(windows.names[items].tolist())
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(hit_rows, pa.list_(pa.int32())), pa.array(item_rows, pa.list_(pa.string()))], names=schema.names)
            yield out.filter(pa.array([len(x) > 0 for x in hit_rows], pa.bool_())) if hits_only else out

    return docs.mapInArrow(scan, schema)


def _blocks(benchmark: DataFrame, n: int, block_windows: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_windows`` windows; a block is collected when it is asked for. Long items come in parts."""
    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")

    def cut(batches):
        for batch in batches:
            out = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = normal_words(text)
                for at in range(0, max(1, len(own) - n + 1) if own else 0, PART):
                    some = own[at : at + PART + n - 1]
                    out.append((item, b" ".join(some).decode("utf-8", "replace"), max(1, len(some) - n + 1)))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["item_id", "text", "windows"])

    parts = named.mapInArrow(cut, "item_id string, text string, windows long")
    size = parts.agg(F.sum("windows")).first()[0] or 0
    count = max(1, math.ceil(size / block_windows))
    parts = parts if count == 1 else written(parts.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count))), "benchmark")
    for b in range(count):
        yield [(r["item_id"], r["text"]) for r in (parts if count == 1 else parts.where(F.col("block") == b)).select("item_id", "text").collect()]


def _hits(docs: DataFrame, benchmark: DataFrame, n: int, block_windows: int) -> DataFrame:
    """The rows of docs (..., text) with n_words, hits and items of all blocks."""
    blocks = _blocks(benchmark, n, block_windows)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan(docs, first, n)
    # rows are numbered once, in a written table, so that every block means the same row
    numbered = written(docs.select(F.monotonically_increasing_id().alias("row"), *docs.columns), "numbered")
    keyed = numbered.select("row", "text")
    merged = written(_scan(keyed, first, n, hits_only=True).drop("text"), "hits")
    del first
    while second is not None:
        merged = merged.unionByName(written(_scan(keyed, second, n, hits_only=True).drop("text"), "hits"))
        second = next(blocks, None)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = merged.groupBy("row").agg(union("hits"), union("items"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return _scan(numbered, [], n).drop("hits", "items").join(merged, "row", "left").select(*docs.columns, "n_words", none("hits", "int"), none("items", "string"))


def scan_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_windows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (any word hit).

    ``block_windows`` bounds the memory of driver and executors: about 100 bytes a window, and the block's distinct words.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _hits(docs, benchmark, n, block_windows).select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def remove_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "document", block_windows: int = 500_000, text_col: str = "text") -> DataFrame:
    """Documents without benchmark passages, with the columns they had.

    mode "document": contaminated documents go. mode "span": each run of hit words goes from the text, from the first byte of
    its first word to the last of its last; documents without hits keep their text as it was.
    """
    others = [c for c in docs.columns if c != text_col]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("struct<x:int>")
    found = _hits(docs.select(rest.alias("rest"), F.col(f"`{text_col}`").cast("string").alias("text")), benchmark, n, block_windows)
    if mode == "document":
        found = found.where(F.size("hits") == 0)
    else:

        def cut(batches):
            for batch in batches:
                texts = [without_words(t.encode("utf-8", "surrogatepass"), np.array(h)) if h else t for t, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["rest", "text"])

        pair = found.select("rest", "text", "hits")
        found = pair.mapInArrow(cut, T.StructType(pair.schema.fields[:2]))
    return found.select(*[F.col("rest").getField(c).alias(c) if c != text_col else F.col("text").alias(text_col) for c in docs.columns])
