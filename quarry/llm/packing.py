"""Pieces of documents as token ids, and best-fit-decreasing packing with a segment tree over free capacities.

``token_pieces`` cuts documents over the sequence length into pieces without losing a token. ``pack_tokens`` packs pieces
into rows of a packed id matrix: each task packs windows of a bounded number of tokens, so memory is bounded by the window
and at most one row in each window is far from full. No shuffle: token ids never leave the task that made them.

Null texts count as empty; an empty text has only the end-of-document id. Repeated rows are packed each. An empty table
gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import default_vocabulary, encoder

#: The id that ends each document.
END = 2


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; all are of full length but, perhaps, the first."""
    head = n - (n - 1) // length * length
    return [(0, head)] + [(s, length) for s in range(head, n, length)]


def ended_documents(batch: pa.RecordBatch, own):
    """Yield (row, ids with the end id) of each text in a batch whose second column is the text."""
    for first, last, counts, ids in own.encode(batch.column(1), with_ids=True):
        edge = np.concatenate([[0], np.cumsum(counts)])
        grown = np.insert(ids, edge[1:], END)
        edge = edge + np.arange(len(edge))
        for r in range(last - first):
            yield first + r, grown[edge[r] : edge[r + 1]]


def token_pieces(docs: DataFrame, vocabulary: str | None = None, length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of the ids as unsigned little-endian 32-bit numbers)."""
    path = vocabulary or default_vocabulary()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def pieces(batches):
        own = encoder(path)
        for batch in batches:
            rows, piece, start, size, crc = [], [], [], [], []
            for row, ids in ended_documents(batch, own):
                raw = memoryview(ids.astype("<u4").tobytes())
                for k, (s, n) in enumerate(cut(len(ids), length)):
                    rows.append(row), piece.append(k), start.append(s), size.append(n)
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return docs.mapInArrow(pieces, schema)


class Capacities:
    """A segment tree over free capacities 0 to ``most``; each leaf counts the open bins with that much room."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.tree = [0] * (2 * self.base)

    def add(self, room: int, n: int) -> None:
        node = self.base + room
        while node:
            self.tree[node] += n
            node >>= 1

    def smallest_from(self, room: int) -> int:
        """The smallest capacity of at least ``room`` that an open bin has, or -1."""
        node = self.base + room
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return -1
            node += 1
            while node < self.base:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.base


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes to the fullest bin that can hold it."""
    free, rooms, bins = Capacities(capacity), [[] for _ in range(capacity + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = free.smallest_from(lengths[i])
        if room < 0:
            b, room = len(bins), capacity
            bins.append([])
        else:
            b = rooms[room].pop()
            free.add(room, -1)
        bins[b].append(i)
        if room > lengths[i]:
            rooms[room - lengths[i]].append(b)
            free.add(room - lengths[i], 1)
    return bins


def pack_tokens(docs: DataFrame, vocabulary: str | None = None, length: int = 2048, window: int = 4_000_000, pad: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of packed id matrices.

    sequence_id; n_tokens and n_segments; doc_ids, piece_starts of the segments in order; cu_seqlens, the segments' bounds
    from 0; input_ids, ``length`` little-endian ids (16 bits if the vocabulary allows, else 32), padded with ``pad``;
    position_ids, as many 16- or 32-bit positions that start from 0 with every segment. ``window``: tokens that a task packs
    together.
    """
    path = vocabulary or default_vocabulary()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType
    fields = [("sequence_id", T.LongType()), ("n_tokens", T.LongType()), ("n_segments", T.LongType()), ("doc_ids", T.ArrayType(kind)), ("piece_starts", T.ArrayType(T.LongType())), ("cu_seqlens", T.ArrayType(T.IntegerType())), ("input_ids", T.BinaryType()), ("position_ids", T.BinaryType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def pack(batches):
        from pyspark import TaskContext

        own = encoder(path)
        wide = "<u2" if own.vocabulary.size <= 65536 else "<u4"
        steps = np.arange(length, dtype="<u2" if length <= 65536 else "<u4")
        base = TaskContext.get().partitionId() << 32
        made = 0

        def flush(held):
            nonlocal made
            docs_, starts, parts = zip(*held)
            bins = best_fit_decreasing([len(p) for p in parts], length)
            for at in range(0, len(bins), 1024):
                some = bins[at : at + 1024]
                ids = np.full((len(some), length), pad, wide)
                positions = np.zeros((len(some), length), steps.dtype)
                bounds = []
                for r, items in enumerate(some):
                    edge = [0]
                    for i in items:
                        a, b = edge[-1], edge[-1] + len(parts[i])
                        ids[r, a:b], positions[r, a:b] = parts[i], steps[: b - a]
                        edge.append(b)
                    bounds.append(edge)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(base + made + np.arange(len(some))),
                        pa.array([e[-1] for e in bounds], pa.int64()),
                        pa.array([len(e) - 1 for e in bounds], pa.int64()),
                        pa.array([[docs_[i] for i in items] for items in some]).cast(pa.list_(docs_type)),
                        pa.array([[starts[i] for i in items] for items in some], pa.list_(pa.int64())),
                        pa.array(bounds, pa.list_(pa.int32())),
                        pa.array([row.tobytes() for row in ids], pa.binary()),
                        pa.array([row.tobytes() for row in positions], pa.binary()),
                    ],
                    names=schema.names,
                )
                made += len(some)

        held, size = [], 0
        docs_type = None
        for batch in batches:
            docs_type = batch.column(0).type
            names = batch.column(0).to_pylist()
            for row, ids in ended_documents(batch, own):
                for s, n in cut(len(ids), length):
                    held.append((names[row], s, ids[s : s + n].copy()))
                    size += n
                if size >= window:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return docs.mapInArrow(pack, schema)
