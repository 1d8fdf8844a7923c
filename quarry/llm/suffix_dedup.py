"""Removal of repeated passages by a sparse suffix array that Spark sorts in range partitions.

A byte goes if a string of ``width`` bytes covers it that also starts in a document with a smaller id. A suffix array of every
place would be many times the text, so only anchored suffixes are sorted; no repeat is lost by that:

1. The anchor of a window of ``width`` bytes is the place in it whose k bytes hash lowest (the first of equal ones). It depends
   on the window alone, so equal windows have their anchors at the same place of equal k bytes. Windows in a row with one anchor
   are a run, about 16 of them; a run's content is all its bytes.
2. Runs are dealt to buckets by their anchor's bytes (as hashes). A task first puts its equal runs together: only the smallest
   document's go out, the others are repeats already. So a passage in a third of all documents sends a run for each task.
   Anchors that stand in very many different runs, found in a bounded sample, are dealt by their windows instead.
3. In a bucket, of equal runs all but those of the smallest document are repeats. Where one anchor has different runs, some of
   their windows may still be equal; these runs go on as suffixes with their bytes.
4. Those suffixes are range-partitioned by their leading k bytes, with splitters that Spark samples. A partition's windows are
   sorted by multikey quicksort, eight bytes at a time, and neighbours compared; equal leading bytes stand in one partition, so
   no equal windows lie across a boundary. Windows that a smaller document has as well are repeats.
5. Repeats of each document are put together and its other bytes kept.

Null texts count as empty. Documents without an id neither lose bytes nor take any from others. Rows with the same id are no
smaller than each other, so repeated rows keep what they share; each has a row in the result. An empty table gives an empty
result. Ids are integers. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import MULTIPLIER, mix, ragged, sums, text_slices
from .common import BROADCAST_IDS, batches_of, scratch, sized_broadcast, written

#: Runs that a task puts together before they go out, and bytes whose runs are found at once.
HELD_RUNS, SLICE = 300_000, 1 << 18
#: Documents whose repeats one task puts together.
PART_DOCS = 16_384
#: Suffixes whose windows are sorted at once, if no anchor has more.
HELD_SUFFIXES = 30_000
#: Documents in which anchors with many different runs are looked for, and how many such runs an anchor needs.
SAMPLED_DOCS, MANY_RUNS = 20_000, 8
#: Bytes of an anchor's hash that go out beside its bucket.
KEY_BYTES = 6
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


def rolled(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from every place on: hashes of 1, 2, 4, ... bytes are put together."""
    held, size, out, done = _BYTES[data], 1, None, 0
    while k:
        power = np.uint64(pow(int(MULTIPLIER), size, 1 << 64))
        if k & 1:
            if out is None:
                out = held.copy()
            else:
                n = max(0, min(len(out), len(held) - done))
                out = out[:n] * power + held[done : done + n]
            done += size
        k >>= 1
        if k:
            held = held[:-size] * power + held[size:] if len(held) > size else held[:0]
            size *= 2
    return mix(out)


def span_of(width: int) -> int:
    """Places of a window among which its anchor is chosen: a power of two, at most two thirds of it."""
    return 1 << (2 * width // 3).bit_length() - 1


class Runs:
    """The runs of a slice of texts: text, first and last window (from the text's start), anchor, key and content."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, many: np.ndarray | None = None):
        span = span_of(width)
        n = max(0, len(data) - width + 1)
        change = np.zeros(len(data) + 1, np.int8)
        some = np.flatnonzero(np.diff(offsets) >= width)
        change[offsets[some]] += 1
        change[offsets[some + 1] - width + 1] -= 1
        valid = np.cumsum(change[:n], dtype=np.int8) > 0
        if not valid.any():
            self.text = self.first = self.last = self.anchor = np.zeros(0, np.int64)
            self.key = self.content = np.zeros(0, np.uint64)
            return
        low = rolled(data, width - span + 1)
        own, at, step = low, np.arange(len(low), dtype=np.int32), 1
        while step < span:
            left = own[:-step] <= own[step:]
            own, at, step = np.where(left, own[:-step], own[step:]), np.where(left, at[:-step], at[step:]), 2 * step
        new, end = valid.copy(), valid.copy()
        other = at[1:n] != at[: n - 1]
        new[1:] &= ~valid[:-1] | other
        end[:-1] &= ~valid[1:] | other
        first, last = np.flatnonzero(new), np.flatnonzero(end)
        anchor = at[first].astype(np.int64)
        windows = rolled(data, width)
        key, content = low[anchor], mix(windows[first] * MULTIPLIER + windows[last] + mix((anchor - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)))
        if many is not None and len(many):
            # each window of such an anchor is a run of its own, with a key of its own
            apart = many[np.minimum(np.searchsorted(many, key), len(many) - 1)] == key
            each = ragged(first[apart], last[apart] - first[apart] + 1)
            first, last = np.concatenate([first[~apart], each]), np.concatenate([last[~apart], each])
            anchor = np.concatenate([anchor[~apart], each])
            key, content = np.concatenate([key[~apart], mix(windows[each])]), np.concatenate([content[~apart], windows[each]])
        self.text = np.searchsorted(offsets, first, "right") - 1
        start = offsets[self.text]
        self.first, self.last, self.anchor, self.key, self.content = first - start, last - start, anchor - start, key, content


def _many(docs: DataFrame, width: int, share: float) -> np.ndarray:
    """Keys of the anchors that stand in ``MANY_RUNS`` different runs or more of a share of the documents, sorted."""

    def runs(batches):
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0), SLICE):
                found = Runs(data, offsets, width)
                yield pa.RecordBatch.from_arrays([pa.array(found.key.view(np.int64)), pa.array(found.content.view(np.int64))], names=["key", "content"])

    texts = docs.where(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(1 << 20)) < round(share * (1 << 20))).select("text")
    found = texts.mapInArrow(runs, "key long, content long").distinct().groupBy("key").count().where(F.col("count") >= MANY_RUNS).select("key")
    return np.sort(np.array([r["key"] for r in found.collect()], np.int64).view(np.uint64))


def _trimmed(values: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _widened(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


_DEALT = {"bucket": pa.int32(), **{c: pa.binary() for c in ("ids", "marks", "counts", "keys", "contents", "firsts", "lasts")}}
_DEALT_SCHEMA = "bucket int, ids binary, marks binary, counts binary, keys binary, contents binary, firsts binary, lasts binary"
_JUDGED_SCHEMA = "part int, ids binary, marks binary, hits binary, asks binary, firsts binary, lasts binary, asked binary"
_FOUND_SCHEMA = "doc_id long, mark long, firsts array<int>, lasts array<int>, asked array<int>"


def _by_document(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Places at which another document starts, and their number at the end."""
    if not len(ids):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])) + 1, [len(ids)]])


def _joined(ids: np.ndarray, marks: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of windows by document and place; those that touch or overlap as one."""
    order = np.lexsort((first, marks, ids))
    ids, marks, first, last = ids[order], marks[order], first[order].astype(np.int64), last[order].astype(np.int64)
    edge = _by_document(ids, marks)
    document = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    # a running maximum that starts anew with each document
    reach = np.maximum.accumulate(last + (document << 33)) - (document << 33) if len(last) else last
    new = np.ones(len(ids), bool)
    new[1:] = (document[1:] != document[:-1]) | (first[1:] > reach[:-1] + 1)
    heads = np.flatnonzero(new)
    return ids[heads], marks[heads], first[heads], reach[np.append(heads[1:], len(ids)) - 1] if len(heads) else last


def _dealt(docs: DataFrame, width: int, buckets: int, many) -> DataFrame:
    """Runs in rows of arrays, by bucket: ids, marks and numbers of runs of the documents, then of each run key, content, first window and windows after it.

    Rows without keys hold windows that are repeats already.
    """

    def row(bucket, ids, marks, first, last, key=None, content=None):
        edge = _by_document(ids, marks)
        held = [b"", b""] if key is None else [_trimmed(key, KEY_BYTES), content.tobytes()]
        return [bucket, ids[edge[:-1]].tobytes(), marks[edge[:-1]].tobytes(), np.diff(edge).astype("<u4").tobytes(), *held, first.astype("<u4").tobytes(), last.astype("<u4" if key is None else np.uint8).tobytes()]

    def out(held, turn):
        ids, marks = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        base = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
        doc = np.concatenate([(h[2].text + b).astype(np.int32) for h, b in zip(held, base, strict=True)])
        key, content, first, last = (np.concatenate([getattr(h[2], c) for h in held]) for c in ("key", "content", "first", "last"))
        held.clear()
        order = np.lexsort((first, marks[doc], ids[doc], content, key))
        doc, key, content, first, last = doc[order], key[order], content[order], first[order], last[order]
        new = np.ones(len(doc), bool)
        new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        smallest = ids[doc[new]][np.cumsum(new, dtype=np.int32) - 1]
        fresh = new.copy()
        fresh[1:] |= (ids[doc[1:]] != ids[doc[:-1]]) | (marks[doc[1:]] != marks[doc[:-1]]) | (first[1:] != first[:-1])
        rows, some = [], np.flatnonzero((ids[doc] > smallest) & fresh)
        if len(some):
            rows.append(row(turn % buckets, *_joined(ids[doc[some]], marks[doc[some]], first[some], last[some])))
        some = np.flatnonzero((ids[doc] == smallest) & fresh)
        bucket = (key[some] % np.uint64(buckets)).astype(np.int32)
        by_bucket = np.lexsort((first[some], doc[some], bucket))
        some, bucket = some[by_bucket], bucket[by_bucket]
        for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(bucket)) + 1):
            if len(part):
                s = some[part]
                rows.append(row(int(bucket[part[0]]), ids[doc[s]], marks[doc[s]], first[s], (last - first)[s], key[s] // np.uint64(buckets), content[s]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DEALT.values(), strict=True)], names=list(_DEALT))

    def deal(batches):
        from pyspark import TaskContext

        turn, held, size = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            ids, marks = (np.asarray(batch.column(c), np.int64) for c in (0, 1))
            for a, b, data, offsets in text_slices(batch.column(2), SLICE):
                held.append((ids[a:b], marks[a:b], Runs(data, offsets, width, many.value)))
                size += len(held[-1][2].key)
                if size >= HELD_RUNS:
                    yield out(held, turn)
                    turn, held, size = turn + 1, [], 0
        if size:
            yield out(held, turn)

    return docs.mapInArrow(deal, _DEALT_SCHEMA)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int32()))


def _judged(parts: int):
    """Runs of a bucket: which are repeats, and which have to be asked for window by window; in a row for each part of the documents."""

    def part_of(ids, marks):
        return (mix(ids.view(np.uint64) * MULTIPLIER + marks.view(np.uint64)) % np.uint64(parts)).astype(np.int64)

    def judge(group: pa.Table) -> pa.Table:
        columns: dict[str, list] = {c: [] for c in ("id", "mark", "key", "content", "first", "last")}
        known = [[np.zeros(0, np.int64)] for _ in range(4)]
        for row in group.to_pylist():
            counts = np.frombuffer(row["counts"], "<u4")
            id_, mark = (np.repeat(np.frombuffer(row[c], np.int64), counts) for c in ("ids", "marks"))
            first = np.frombuffer(row["firsts"], "<u4").astype(np.int64)
            if not row["keys"]:
                for held, values in zip(known, (id_, mark, first, np.frombuffer(row["lasts"], "<u4").astype(np.int64)), strict=True):
                    held.append(values)
                continue
            for c, values in zip(columns, (id_, mark, _widened(row["keys"], KEY_BYTES), np.frombuffer(row["contents"], np.uint64), first.astype(np.int32), np.frombuffer(row["lasts"], np.uint8)), strict=True):
                columns[c].append(values)
        del group
        if columns["id"]:
            id_, mark, key, content, first, last = (np.concatenate(columns.pop(c)) for c in list(columns))
            order = np.lexsort((id_, content, key))
            k, c, i = key[order], content[order], id_[order]
            new_key = np.append(True, k[1:] != k[:-1])
            new = new_key | np.append(True, c[1:] != c[:-1])
            smallest = i[new][np.cumsum(new, dtype=np.int32) - 1]
            hit = order[i > smallest]
            # anchors with different runs, of different documents
            heads = np.flatnonzero(new_key)
            mixed = (np.minimum.reduceat(smallest, heads) < np.maximum.reduceat(smallest, heads))[np.cumsum(new_key, dtype=np.int32) - 1]
            ask = order[mixed & (i == smallest)]
            for held, values in zip(known, (id_[hit], mark[hit], first[hit].astype(np.int64), first[hit].astype(np.int64) + last[hit]), strict=True):
                held.append(values)
            asked = id_[ask], mark[ask], first[ask].astype(np.int64)
        else:
            asked = known[0][0], known[0][0], known[0][0]
        hits = _joined(*(np.concatenate(x) for x in known))
        own, asking = part_of(*hits[:2]), part_of(*asked[:2])
        order, asking_order = np.argsort(own, kind="stable"), np.lexsort((asked[2], asked[1], asked[0], asking))
        out = []
        for p in np.union1d(own, asking):
            h, a = (o[np.searchsorted(w[o], p, "left") : np.searchsorted(w[o], p, "right")] for o, w in ((order, own), (asking_order, asking)))
            ids, marks = np.concatenate([hits[0][h], asked[0][a]]), np.concatenate([hits[1][h], asked[1][a]])
            kind = np.repeat([0, 1], [len(h), len(a)])
            by = np.lexsort((kind, marks, ids))
            edge = _by_document(ids[by], marks[by])
            counts = sums(kind[by], edge)
            out.append([int(p), ids[by][edge[:-1]].tobytes(), marks[by][edge[:-1]].tobytes(), (np.diff(edge) - counts).astype("<u4").tobytes(), counts.astype("<u4").tobytes(), *(x.astype("<u4").tobytes() for x in (hits[2][h], hits[3][h], asked[2][a]))])
        names = ["part", "ids", "marks", "hits", "asks", "firsts", "lasts", "asked"]
        kinds = [pa.int32(), *[pa.binary()] * 7]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names=names)

    return judge


def _by_text(group: pa.Table) -> pa.Table:
    """A part's documents, each once, with their repeats and asked runs."""
    held = [[np.zeros(0, np.int64)] for _ in range(4)], [[np.zeros(0, np.int64)] for _ in range(3)]
    for row in group.to_pylist():
        ids, marks = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["marks"], np.int64)
        for kind, counts, names in ((0, "hits", ("firsts", "lasts")), (1, "asks", ("asked",))):
            counts = np.frombuffer(row[counts], "<u4")
            for x, values in zip(held[kind], (np.repeat(ids, counts), np.repeat(marks, counts), *(np.frombuffer(row[c], "<u4").astype(np.int64) for c in names)), strict=True):
                x.append(values)
    hits = _joined(*(np.concatenate(x) for x in held[0]))
    asked = [np.concatenate(x) for x in held[1]]
    order = np.lexsort((asked[2], asked[1], asked[0]))
    ids, marks = np.concatenate([hits[0], asked[0][order]]), np.concatenate([hits[1], asked[1][order]])
    kind = np.repeat([0, 1], [len(hits[0]), len(order)])
    by = np.lexsort((kind, marks, ids))
    edge = _by_document(ids[by], marks[by])
    asks = sums(kind[by], edge)
    counts = np.diff(edge) - asks
    return pa.table({"doc_id": pa.array(ids[by][edge[:-1]]), "mark": pa.array(marks[by][edge[:-1]]), "firsts": _lists(hits[2], counts), "lasts": _lists(hits[3], counts), "asked": _lists(asked[2][order], asks)})


def _binaries(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[ragged(starts, lengths)]))])


def _suffixes(docs: DataFrame, width: int) -> DataFrame:
    """The asked runs of docs (doc_id, mark, text, asked) as suffixes: leading bytes, first window, windows and all bytes of the run."""
    k = width - span_of(width) + 1
    schema = "lead binary, doc_id long, mark long, first int, windows int, piece binary"

    def cut(batches):
        for batch in batches:
            ids, marks, asked = batch.column(0), batch.column(1), batch.column(3)
            for a, b, data, offsets in text_slices(batch.column(2), SLICE):
                found = Runs(data, offsets, width)
                part = asked.slice(a, b - a)
                rows, firsts = np.asarray(pc.list_parent_indices(part), np.int64), np.asarray(pc.list_flatten(part), np.int64)
                place = found.text << 40 | found.first
                at = np.searchsorted(place, rows << 40 | firsts)
                start, windows = offsets[rows] + firsts, found.last[at] - found.first[at] + 1
                lead = offsets[rows] + found.anchor[at]
                rows = pa.array(rows + a)
                yield pa.RecordBatch.from_arrays([_binaries(data, lead, np.full(len(lead), k)), ids.take(rows), marks.take(rows), pa.array(firsts, pa.int32()), pa.array(windows, pa.int32()), _binaries(data, start, windows + width - 1)], names=["lead", "doc_id", "mark", "first", "windows", "piece"])

    return docs.mapInArrow(cut, schema)


def multikey_classes(rows: np.ndarray) -> np.ndarray:
    """The class of each row of big-endian words, equal rows in one class: rows are sorted by their first word, those that tie by the next, and so on."""
    order = np.argsort(rows[:, 0], kind="stable")
    new = np.append(True, rows[order[1:], 0] != rows[order[:-1], 0])
    for word in range(1, rows.shape[1]):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        part = (np.cumsum(new) - 1)[at]
        value = rows[order[at], word]
        own = np.lexsort((value, part))
        order[at] = order[at[own]]
        value = value[own]
        # a place of this part starts a class where the part did, or where the word changes
        new[at[1:]] |= (value[1:] != value[:-1]) & (part[1:] == part[:-1])
    out = np.empty(len(rows), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _compared(suffixes: pa.Table, width: int) -> pa.RecordBatch:
    """The windows of these suffixes that a smaller document among them has as well."""
    ids, marks = np.asarray(suffixes["doc_id"], np.int64), np.asarray(suffixes["mark"], np.int64)
    first, windows = np.asarray(suffixes["first"], np.int64), np.asarray(suffixes["windows"], np.int64)
    pieces = suffixes["piece"].combine_chunks()
    pieces = pieces.chunk(0) if isinstance(pieces, pa.ChunkedArray) else pieces
    offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    data = np.append(np.frombuffer(pieces.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8))
    owner = np.repeat(np.arange(len(ids)), windows)
    start = ragged(offsets[:-1], windows)
    words = -(-width // 8)
    rows = np.zeros((len(start), 8 * words), np.uint8)
    rows[:, :width] = np.lib.stride_tricks.sliding_window_view(data, width)[start]
    classes = multikey_classes(rows.view(">u8").astype(np.uint64))
    smallest = np.full(int(classes.max()) + 1 if len(classes) else 0, np.iinfo(np.int64).max)
    np.minimum.at(smallest, classes, ids[owner])
    hit = ids[owner] > smallest[classes]
    place = first[owner] + (start - offsets[owner])
    head = hit & ~np.append(False, hit[:-1] & (owner[1:] == owner[:-1]))
    tail = hit & ~np.append(hit[1:] & (owner[1:] == owner[:-1]), False)
    counts = np.bincount(owner[head], minlength=len(ids))
    some = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(marks[some]), _lists(place[head], counts[some]), _lists(place[tail], counts[some])], names=["doc_id", "mark", "firsts", "lasts"])


def _sorted_suffixes(suffixes: DataFrame, width: int) -> DataFrame:
    """Repeats among written suffixes: doc_id, mark, first and last windows."""

    def compare(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < HELD_SUFFIXES:
                continue
            rows = pa.Table.from_batches(held)
            # what comes may have the leading bytes of the last row
            last = pc.index(pc.equal(rows["lead"], rows["lead"][len(rows) - 1]), True).as_py()
            if last:
                yield _compared(rows.slice(0, last), width)
            held, size = rows.slice(last).to_batches(), len(rows) - last
        if held:
            yield _compared(pa.Table.from_batches(held), width)

    return suffixes.repartitionByRange("lead").sortWithinPartitions("lead").mapInArrow(compare, "doc_id long, mark long, firsts array<int>, lasts array<int>")


def _kept(docs: DataFrame, width: int, with_text: bool) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept text) of docs (doc_id, text, firsts, lasts)."""
    fields = [docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([*fields, *([T.StructField("text", T.StringType())] if with_text else [])])

    def keep(batches):
        for batch in batches:
            columns = [[] for _ in range(5)]
            for a, b, data, offsets in text_slices(batch.column(1)):
                change = np.zeros(len(data) + 1, np.int64)
                for c, sign, more in ((2, 1, 0), (3, -1, width)):
                    part = batch.column(c).slice(a, b - a)
                    rows, places = np.asarray(pc.list_parent_indices(part), np.int64), np.asarray(pc.list_flatten(part), np.int64)
                    np.add.at(change, offsets[rows] + places + more, sign)
                gone = np.cumsum(change[:-1]) > 0
                heads = gone.copy()
                heads[1:] &= ~gone[:-1]
                inner = offsets[:-1][np.diff(offsets) > 0]
                heads[inner] = gone[inner]
                columns[0].append(np.diff(offsets))
                columns[1].append(sums(gone, offsets))
                columns[2].append(sums(heads, offsets))
                left, edge = data[~gone].tobytes(), np.concatenate([[0], np.cumsum(np.diff(offsets) - columns[1][-1])])
                for i in range(b - a):
                    own = left[edge[i] : edge[i + 1]]
                    columns[3].append(hashlib.sha256(own).hexdigest())
                    if with_text:
                        columns[4].append(own.decode("utf-8", "replace"))
            numbers = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in columns[:3]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(columns[3], pa.string()), *([pa.array(columns[4], pa.string())] if with_text else [])], names=schema.names)

    return docs.mapInArrow(keep, schema)


def remove_repeats(docs: DataFrame, width: int = 50, buckets: int | None = None, sampled_docs: int = SAMPLED_DOCS, batch_rows: int = 500, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the bytes that stay.

    ``width``: 8 to 250 bytes. ``with_text``: the kept text too (bytes of a character that was cut through become U+FFFD).
    ``buckets``: into how many parts runs are dealt, at least one for each task that runs at a time; by default the number of
    shuffle partitions, or of the table's if that is larger.
    """
    if not 8 <= width <= 250:
        raise ValueError("width must be from 8 to 250 bytes")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    with batches_of(spark, batch_rows), scratch(spark):
        named = docs.where("doc_id is not null").select("doc_id", "mark", "text")
        buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
        n = named.count()
        many = spark.sparkContext.broadcast(_many(named, width, min(1.0, sampled_docs / max(1, n))))
        judged = _dealt(named, width, buckets, many).groupBy("bucket").applyInArrow(_judged(max(1, n // PART_DOCS)), _JUDGED_SCHEMA)
        found = written(judged.groupBy("part").applyInArrow(_by_text, _FOUND_SCHEMA), "found")
        asked = found.where(F.size("asked") > 0).groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("asked")).alias("asked"))
        asked = written(asked, "asked")
        suffixes = _suffixes(named.join(sized_broadcast(asked.select("doc_id", "mark")), ["doc_id", "mark"], "left_semi").join(asked, ["doc_id", "mark"]).select("doc_id", "mark", "text", "asked"), width)
        suffixes = written(suffixes, "suffixes")
        repeats = found.where(F.size("firsts") > 0).select("doc_id", "mark", "firsts", "lasts").unionByName(_sorted_suffixes(suffixes, width))
        repeats = written(repeats.groupBy("doc_id", "mark").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("firsts", "lasts")]), "repeats")
        none = [F.array().cast("array<int>").alias(c) for c in ("firsts", "lasts")]
        if repeats.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
            # only texts with repeats are shuffled
            keys = F.broadcast(repeats.select("doc_id", "mark"))
            hit = docs.join(keys, ["doc_id", "mark"], "left_semi").join(repeats, ["doc_id", "mark"]).select("doc_id", "text", "firsts", "lasts")
            parts = [hit, docs.join(keys, ["doc_id", "mark"], "left_anti").select("doc_id", "text", *none)]
        else:
            parts = [docs.join(repeats, ["doc_id", "mark"], "left").select("doc_id", "text", *[F.coalesce(c, n).alias(c) for c, n in zip(("firsts", "lasts"), none, strict=True)])]
        parts = [_kept(p, width, with_text) for p in parts]
        return written(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "kept", keep=True)
