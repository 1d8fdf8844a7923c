"""Best-fit packing improved by swap-based local search.

Token pieces (id, piece, start, length and a checksum; no ids) are dealt to shards by a hash, about ``SHARD`` pieces each,
and every shard is packed by one task: best fit first, then exchanges between underfull bins. An exchange takes from a bin and
gives to one at least as full, so it raises the sum of squared fills; it goes on until bins empty or none helps:
 - move: a piece goes to a bin with room for it;
 - one for one: a piece changes places with a shorter one of another bin;
 - two for one: two pieces of the emptier bin change places with one piece, or one piece with two.
Shards of a fixed number of pieces keep a task's work and memory the same at any input size; pieces are dealt by a number of
their own, so rows that repeat don't meet in one. Then all bins with room left are dealt anew, whole, to as many shards as their
pieces need, and searched again from there, so pieces of different shards meet; this goes on until a level empties fewer than one in
LEAST_GAIN of the bins that it was given.
"""

from __future__ import annotations

import math
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written
from .packing import best_fit_decreasing, token_pieces

#: Pieces that a task packs at once.
SHARD = 4096
#: Turns without an emptied bin after which a shard's search ends.
PATIENCE = 2
#: A level must empty one of so many bins for another to follow.
LEAST_GAIN = 500


def least_bins(lengths: list[int], capacity: int) -> int:
    """A lower bound of the bins that any packing needs: pieces over a half stand alone, and what the rest is longer than their room."""
    sizes = np.sort(np.asarray(lengths, np.int64))
    total = np.concatenate([[0], np.cumsum(sizes)])
    half = np.searchsorted(sizes, capacity // 2, "right")
    # pieces under a are left out; those over capacity - a can't share with any that isn't
    a = np.unique(np.concatenate([[0], sizes[:half]]))
    from_a, over = np.searchsorted(sizes, a, "left"), np.maximum(half, np.searchsorted(sizes, capacity - a, "right"))
    room = capacity * (over - half) - (total[over] - total[half])
    rest = total[half] - total[np.minimum(from_a, half)]
    return int((len(sizes) - half + np.maximum(0, -(-(rest - room) // capacity))).max())


class Pool:
    """Bins of a shard, and for each length, and each sum of two, the bin with most room that holds such pieces.

    Bins that are full, or have been donors, are no receivers. Heaps keep the receivers of each length; entries of bins that have
    changed since are dropped when they come to the top.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.room = [capacity - sum(lengths[i] for i in b) for b in bins]
        self.version, self.receives = [0] * len(bins), [r > 0 for r in self.room]
        # the largest room by what is taken in exchange: nothing (0) or one piece, and two pieces
        self.best = np.full((2, capacity + 1), -1, np.int64)
        self.heaps: tuple[dict[int, list], dict[int, list]] = {}, {}
        for b in range(len(bins)):
            if self.receives[b]:
                self.enter(b)
        for kind in (0, 1):
            for n in self.heaps[kind]:
                self.settle(kind, n)

    def choices(self, b: int) -> tuple[dict[int, tuple], dict[int, tuple]]:
        """One piece of each length in a bin, and two for each sum of two; nothing counts as a length of 0 among the first."""
        one: dict[int, tuple] = {0: ()}
        two: dict[int, tuple] = {}
        for i in self.bins[b]:
            n = self.lengths[i]
            if n in one:
                two.setdefault(2 * n, (*one[n], i))
            else:
                for m, j in one.items():
                    if m:
                        two.setdefault(n + m, (*j, i))
                one[n] = (i,)
        return one, two

    def enter(self, b: int) -> None:
        for heaps, held in zip(self.heaps, self.choices(b), strict=True):
            for n in held:
                heappush(heaps.setdefault(n, []), (-self.room[b], b, self.version[b]))

    def settle(self, kind: int, n: int) -> None:
        heap = self.heaps[kind].get(n, [])
        while heap and (not self.receives[heap[0][1]] or heap[0][2] != self.version[heap[0][1]]):
            heappop(heap)
        self.best[kind, n] = -heap[0][0] if heap else -1

    def change(self, b: int, given=(), taken=()) -> None:
        """Put pieces into a bin and take others out; it stays a receiver if it was one and has room."""
        before = self.choices(b)
        for i in taken:
            self.bins[b].remove(i)
        self.bins[b] += given
        self.room[b] += sum(self.lengths[i] for i in taken) - sum(self.lengths[i] for i in given)
        self.version[b] += 1
        self.receives[b] = self.receives[b] and self.room[b] > 0
        if self.receives[b]:
            self.enter(b)
        after = self.choices(b) if self.receives[b] else ({}, {})
        for kind in (0, 1):
            for n in before[kind].keys() | after[kind].keys():
                self.settle(kind, n)

    def retire(self, b: int) -> None:
        held = self.choices(b)
        self.receives[b] = False
        for kind in (0, 1):
            for n in held[kind]:
                self.settle(kind, n)


def exchange(pool: Pool, donor: int) -> tuple[tuple, tuple, int] | None:
    """The exchange that moves most from the donor to a receiver: (items given, items taken, bin they go to), or None.

    Of equal gains one of fewer pieces is taken. Receivers are at least as full as the donor, for donors come emptiest first.
    """
    one, two = pool.choices(donor)
    found: tuple = (0, 0)
    for more, kind, options in ((1, 0, one), (2, 1, one), (2, 0, two)):
        for n, items in options.items():
            if n <= found[0]:
                continue
            # nothing is no exchange for two pieces: they would be moved one by one
            low = 0 if options is one and kind == 0 else 1
            fits = pool.best[kind, low:n] >= n - np.arange(low, n)
            at = int(fits.argmax()) if len(fits) else 0
            gain = n - low - at
            if len(fits) and fits[at] and gain > found[0]:
                found = (gain, more, items, kind, n - gain)
    if not found[0]:
        return None
    _, _, items, kind, n = found
    to = pool.heaps[kind][n][0][1]
    return items, pool.choices(to)[kind][n], to


def search(lengths: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Bins of item numbers, as few as the search finds, from the given bins or those of best fit.

    In a turn every underfull bin gives once, emptiest first, until it is empty or no exchange is left; what is left of it receives
    from the next turn on. The search ends when PATIENCE turns in a row have emptied no bin, or the bins are as few as any packing
    needs.
    """
    bins = best_fit_decreasing(lengths, capacity) if bins is None else [list(b) for b in bins]
    least, idle = least_bins(lengths, capacity), 0
    while len(bins) > least and idle < PATIENCE:
        pool, before, moved = Pool(bins, lengths, capacity), len(bins), False
        live = before
        while live > least and pool.heaps[0].get(0):
            donor = pool.heaps[0][0][0][1]
            pool.retire(donor)
            while bins[donor]:
                step = exchange(pool, donor)
                if step is None:
                    break
                given, taken, to = step
                pool.change(to, given, taken)
                pool.change(donor, taken, given)
                moved = True
            else:
                live -= 1
        bins = [b for b in bins if b]
        idle = idle + 1 if live == before else 0
        if not moved:
            break
    return bins


def pack_documents(docs: DataFrame, vocabulary: str | None = None, length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset in the sequence.

    Null texts count as empty: one piece that holds the end id alone. Rows with the same id, or none, are packed each, and dealt
    to shards by a number of their own. Pieces of full length get sequences of their own without being dealt out. An empty table
    gives an empty result.
    """
    with scratch(docs.sparkSession):
        pieces = written(token_pieces(docs, vocabulary, length, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces", keep=True)
        full = pieces.where(F.col("length") == length).select(*pieces.columns[:-1], (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        sizes = pieces.where(F.col("length") < length).select("row", F.col("length").cast("int").alias("length"))
        placed = packed_rows(sizes, length)
        rest = pieces.where(F.col("length") < length).join(placed, "row").select(*pieces.columns[:-1], "sequence_id", "offset")
        return full.unionByName(rest)


def packed_rows(sizes: DataFrame, capacity: int, shard: int = SHARD) -> DataFrame:
    """row, sequence_id and offset of rows (row, length).

    Shards are packed, then whole underfull bins are dealt anew and packed, while that gains; then those up to half full, until
    they are in one shard.
    """
    n = sizes.count()
    shards, level = max(1, math.ceil(n / shard)), 0
    schema = "row long, length int, bin long, room int, offset long"

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True]).reset_index(drop=True)
        lengths, number = group["length"].tolist(), int(group["shard"].iloc[0])
        found = search(lengths, capacity)
        if group["bin"].notna().all():
            held: dict[int, list[int]] = {}
            for i, b in enumerate(group["bin"].tolist()):
                held.setdefault(int(b), []).append(i)
            # from the bins as they are, if that ends with no more
            other = search(lengths, capacity, list(held.values()))
            found = other if len(other) <= len(found) else found
        own, room, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int32), np.zeros(len(group), np.int64)
        for b, items in enumerate(found):
            at = 0
            for i in items:
                own[i], offset[i] = (level << 56) | (number << 21) | b, at
                at += lengths[i]
            room[items] = capacity - at
        if len(found) >= 1 << 21 or level >= 64:
            raise ValueError("more bins or levels than sequence numbers")
        return group.assign(bin=own, room=room, offset=offset)[["row", "length", "bin", "room", "offset"]]

    dealt = sizes.select("*", F.lit(None).cast("long").alias("bin"), F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
    out, given, gained = [], None, True
    while True:
        done = written(dealt.groupBy("shard").applyInPandas(pack, schema), "packed", keep=True)
        if given is not None:
            gained = gained and level < 32 and (given - done.select("bin").distinct().count()) * LEAST_GAIN >= given
        # a shard leaves one bin at most that isn't over half full, so these get fewer with every level
        again = (F.col("room") > 0) & (F.lit(gained) | (2 * F.col("room") >= capacity))
        under = done.where(again)
        pieces, given = under.agg(F.count("*"), F.count_distinct("bin")).first()
        if shards == 1 or not pieces:
            out.append(done)
            break
        out.append(done.where(~again))
        shards, level = math.ceil(pieces / shard), level + 1
        dealt = under.select("row", "length", "bin", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(shards)).alias("shard"))
    placed = out[0]
    for part in out[1:]:
        placed = placed.unionByName(part)
    return placed.select("row", F.col("bin").alias("sequence_id"), "offset")
