"""Jaccard join on word shingles by adaptive multi-match prefixes, and the groups that its links form.

1. A sketch of fixed size counts shingles over all documents; shingles are ordered by estimated frequency, rarest first.
2. Documents with equal sets form one class; everything below works on classes.
3. A class's prefix for multiplicity l holds its n - ceil(t n) + l first shingles: two sets that link share l of them at
   least. Each class takes the l whose prefix costs least by the sketch (places read, and candidates to verify), so sets made of
   frequent shingles get longer prefixes and must share more of them before they are verified.
   Places of a prefix from which two sets have too few shingles left to link are not joined.
4. Large groups are not paired out. Classes with the same smallest hash are first verified against one pivot, the one with
   fewest rare shingles. Those that link stand behind their pivot with their distance, a ball; prefixes are then joined by pivot,
   places of a shingle that very many pivots have in blocks. Pairs of pivots are verified.
5. Where two pivots don't link, aren't in one group by other links, and the triangle inequality of the Jaccard distance allows a
   link between their balls, the members' own prefixes are joined, pair of balls by pair, and what comes of that is verified.
   Pairs of balls for which that would make many more rows than they have members have their members verified against the other
   pivot first; if none of them links, only those near enough to it are joined. No link that could join two groups is left out.
6. Links become groups by alternating large-star and small-star steps over written edge tables.

Shingles are 64-bit hashes of word hashes, classes 128-bit digests of their sets; verification intersects whole sets.

Texts without words, and null texts, have an empty set and link with nothing, not even each other. A null id takes part in no
link and has no component. Repeated rows have one class and each a row in the result. Rows that share an id but not their text
are documents of their own, each in its text's group. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, WHITE, mix, run_hashes, shingle_hashes, text_slices, words
from .common import batches_of, discard, join_groups, scratch, sized_broadcast, written

#: Counters of the frequency sketch, as a power of two, and the counters of one row of it.
SKETCH_BITS, ROW_BITS = 20, 14
#: The largest multiplicity that a prefix may ask for.
MOST_SHARED = 6
#: What verifying a candidate costs, in places read.
VERIFY_COST = 8.0
#: Pivots with one shingle that are joined with each other in one block.
BLOCK = 16384
#: Pairs of places a member, from which the members of two balls are measured against the other pivot first.
CROWDED = 16
#: Tasks whose sketches are added up in one group.
FAN = 1024
_SECOND = np.uint64(0xA24BAED4963EE407)


def sets_of(column, k: int):
    """Yield (row, sorted distinct shingle hashes) of each text of a string column."""
    for first, last, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, texts = words(data, offsets, WHITE)
        own = run_hashes(data, starts, ends - starts)
        hashes, at = shingle_hashes(own, texts, k)
        bounds = np.searchsorted(texts, np.arange(last - first + 1))
        cuts = np.searchsorted(at, bounds)
        for r in range(last - first):
            if cuts[r + 1] > cuts[r]:
                yield first + r, np.unique(hashes[cuts[r] : cuts[r + 1]])
            elif bounds[r + 1] > bounds[r]:
                few = own[bounds[r] : bounds[r + 1]]
                yield first + r, shingle_hashes(few, np.zeros(len(few), np.int64), len(few))[0]
            else:
                yield first + r, hashes[:0]


def digest(hashes: np.ndarray) -> bytes:
    """128 bits of a set."""
    a = mix(hashes * _SECOND + np.uint64(1))
    parts = int(hashes.sum(dtype=np.uint64)) + len(hashes), int(np.bitwise_xor.reduce(a)) + int(a.sum(dtype=np.uint64))
    return b"".join((x & (1 << 64) - 1).to_bytes(8, "little") for x in parts)


def frequency_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Counts of all documents' shingles by the upper bits of their hash: a table of fixed size, summed row by row.

    The tasks' tables are added up FAN at a time first, so a group has FAN rows, or as many as there are such groups.
    """

    def count(batches):
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() // FAN
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            held, n = [], 0
            for _, hashes in sets_of(batch.column(1), k):
                held.append(hashes)
                n += len(hashes)
                if n > 500_000:
                    total += np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
                    held, n = [], 0
            if held:
                total += np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        rows = total.reshape(-1, 1 << ROW_BITS)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), group)), pa.array(some, pa.int64()), pa.array([zlib.compress(rows[i].astype("<i8").tobytes(), 1) for i in some], pa.binary())], names=["tasks", "part", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), "<i8") for c in group["counts"])
        return pd.DataFrame({"tasks": group["tasks"].iloc[:1], "part": group["part"].iloc[:1], "counts": [zlib.compress(total.astype("<i8").tobytes(), 1)]})

    schema = "tasks long, part long, counts binary"
    out = np.zeros((1 << SKETCH_BITS - ROW_BITS, 1 << ROW_BITS), np.int64)
    for row in docs.mapInArrow(count, schema).groupBy("tasks", "part").applyInPandas(add, schema).groupBy("part").applyInPandas(add, schema).collect():
        out[row["part"]] = np.frombuffer(zlib.decompress(row["counts"]), "<i8")
    return out.ravel()


def least_overlap(n: int, percent: int) -> int:
    """The fewest shingles that a set of n shares with any set it links with."""
    return -(-percent * n // 100)


def least_common(n: int, m: int, percent: int) -> int:
    """The fewest shingles that two sets of n and m share if they link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_of(hashes: np.ndarray, frequency: np.ndarray, noise: float, percent: int) -> tuple[int, np.ndarray]:
    """The multiplicity chosen for a set and its prefix: by frequency, then hash."""
    n = len(hashes)
    held = frequency[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((hashes, held))
    overlap = least_overlap(n, percent)
    short = n - overlap
    choices = np.arange(1, min(MOST_SHARED, overlap) + 1)
    # what a set of the same size can read of it: later places are beyond the positional bound
    near = n - least_common(n, n, percent)
    read = np.cumsum(np.maximum(held[order[: near + len(choices)]] - noise, 0.0))[near + choices - 1]
    need = int(choices[np.argmin(read + VERIFY_COST * read / choices + choices)])
    return need, hashes[order[: short + need]]


def _described(docs: DataFrame, sketch: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc_id, class digest, set size, smallest hash by a second order, rare shingles, multiplicity and prefix of each row."""
    noise = float(np.median(sketch))
    held = docs.sparkSession.sparkContext.broadcast(sketch.astype(np.int64))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (("sig", T.BinaryType()), ("n", T.LongType()), ("key", T.LongType()), ("rare", T.LongType()), ("need", T.LongType()), ("prefix", T.ArrayType(T.LongType()))))])

    def describe(batches):
        frequency = held.value
        for batch in batches:
            out = {c: [] for c in schema.names[1:]}
            for _, hashes in sets_of(batch.column(1), k):
                out["n"].append(len(hashes))
                if not len(hashes):
                    for c, v in (("sig", None), ("key", None), ("rare", 0), ("need", 0), ("prefix", [])):
                        out[c].append(v)
                    continue
                need, prefix = prefix_of(hashes, frequency, noise, percent)
                out["sig"].append(digest(hashes))
                out["key"].append(int(mix(hashes * _SECOND).min().astype(np.int64)))
                out["rare"].append(int((frequency[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] <= 2 * noise + 8).sum()))
                out["need"].append(need)
                out["prefix"].append(prefix.view(np.int64))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], t) for c, t in zip(schema.names[1:], kinds, strict=True))], names=schema.names)

    return docs.mapInArrow(describe, schema)


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node and the whole set of the classes named in ``nodes`` (a column node)."""
    wanted = written(classes.select("node", "doc_id", "sig").join(nodes.distinct(), "node"), "wanted")
    texts = docs.join(sized_broadcast(wanted.select("doc_id").distinct()), "doc_id").select("doc_id", "text")

    def build(batches):
        for batch in batches:
            sig, sets = [], []
            for _, hashes in sets_of(batch.column(1), k):
                sig.append(digest(hashes) if len(hashes) else None)
                sets.append(hashes.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["sig", "shingles"])

    found = texts.mapInArrow(build, "sig binary, shingles array<long>")
    sets = written(found.join(sized_broadcast(wanted.select("node", "sig")), "sig").select("node", "shingles"), "sets")
    # a row that repeats in the documents gives its set again
    total, distinct = sets.select(F.count("*"), F.count_distinct("node")).first()
    return sets if total == distinct else written(sets.dropDuplicates(["node"]), "sets-once")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Written pairs (a, b, ...) with the sizes of their sets' intersection and union; no set is shuffled that isn't in a pair."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")).join(sized_broadcast(pairs), "a")
    right = sets.join(sized_broadcast(pairs.select(F.col("b").alias("node")).distinct()), "node", "left_semi").select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = left.join(right, "b").withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    return both.withColumn("union", F.size("of_a") + F.size("of_b") - F.col("shared")).drop("of_a", "of_b")


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of the vertices of edges (u, v): the smallest vertex that can be reached."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "small-star")
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        seen = mark


SIDES = ("need", "most", "low", "high", "left", "count")


def _fits(percent: int) -> F.Column:
    """Whether two balls' places of a shingle (columns of both sides) leave room for a link between their members."""
    sizes = (F.col("high_a") * 100 >= F.col("low_b") * percent) & (F.col("high_b") * 100 >= F.col("low_a") * percent)
    return sizes & ((F.least("left_a", "left_b") + F.least("most_a", "most_b") - 1) * (100 + percent) >= (F.col("low_a") + F.col("low_b")) * percent)


def _by_ball(places: DataFrame, *keys: str) -> DataFrame:
    """Places (n, place, need) by the keys and pivot.

    need and most: the least and the largest multiplicity of the pivot's members there; low and high: their set sizes; left: the
    shingles of a set from the place on, at most; count: the places.
    """
    return places.groupBy(*keys, "pivot").agg(F.min("need").alias("need"), F.max("need").alias("most"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("place")).alias("left"), F.count("*").alias("count"))


def _pairs_of_balls(places: DataFrame, percent: int, *keys: str) -> DataFrame:
    """Pairs of pivots (a < b) with a shingle of their members' prefixes in common, and what _by_ball says of both."""
    one, two = (places.withColumnsRenamed({c: f"{c}_{side}" for c in (*SIDES, "own") if c in places.columns} | {"pivot": side}) for side in "ab")
    return one.join(two, list(keys)).where(F.col("a") < F.col("b")).where(_fits(percent))


def _often(places: DataFrame, sketch: np.ndarray) -> DataFrame | None:
    """Shingles that more than BLOCK places have, with their number of blocks; exact counts, of the few that the sketch allows to be so frequent."""
    hot = np.flatnonzero(sketch > BLOCK)
    if not len(hot):
        return None
    buckets = F.broadcast(places.sparkSession.createDataFrame(pd.DataFrame({"bucket": hot.astype(np.int64)})))
    counts = places.join(buckets, F.shiftrightunsigned("shingle", 64 - SKETCH_BITS) == F.col("bucket"), "left_semi").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    often = written(counts.select("shingle", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "often")
    return None if often.isEmpty() else sized_broadcast(often)


def _in_blocks(places: DataFrame, sketch: np.ndarray) -> tuple[DataFrame, list[str], F.Column]:
    """Places (shingle, pivot, ...) with the block of their pivot (own), the columns to join them by, and the condition that makes every pair of pivots once.

    Places of a shingle that very many have are dealt into blocks; every two blocks meet under a key of their own.
    """
    often = _often(places, sketch)
    if often is None:
        return places.withColumn("own", F.lit(0)), ["shingle"], F.lit(True)
    columns = places.columns
    dealt = places.join(often, "shingle", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("pivot"), F.col("blocks")).cast("int"), F.lit(0)))
    meets = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j")))
    # two places of one block meet where it meets itself
    return dealt.select(*columns, "own", F.inline(meets)), ["shingle", "i", "j"], (F.col("own_a") != F.col("own_b")) | (F.col("i") == F.col("j"))


def _candidates(members: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """Pairs of pivots (a < b) that share as many places as one of their members' multiplicities asks for."""
    places = members.select("pivot", "need", "n", F.posexplode("prefix").alias("place", "shingle"))
    # one number beside shingle and pivot keeps what is shuffled small
    packed = F.shiftleft("n", 32) + F.shiftleft(F.col("place").cast("long"), 4) + F.col("need")
    places = places.select("shingle", "pivot", packed.alias("packed"))
    places, keys, once = _in_blocks(places, sketch)
    places = places.repartition(*keys).withColumns({"n": F.shiftright("packed", 32), "place": F.shiftright("packed", 4).bitwiseAND(0xFFFFFFF), "need": F.col("packed").bitwiseAND(15)})
    shared = _pairs_of_balls(_by_ball(places, *keys, "own"), percent, *keys).where(once)
    return shared.groupBy("a", "b").agg(F.count("*").alias("common"), F.min(F.least("need_a", "need_b")).alias("need")).where("common >= need").select("a", "b")


def linked_groups(classes: DataFrame, docs: DataFrame, sketch: np.ndarray, k: int, percent: int) -> DataFrame:
    """(vertex, component) of the nodes of classes that link with another; every link used is verified, none that could join two groups is left out."""
    most = 1 - percent / 100 + 1e-9
    linked = F.col("shared") * 100 >= F.col("union") * percent
    distance = 1 - F.col("shared") / F.col("union")

    # stars: classes with the same smallest hash against the one among them with the fewest rare shingles
    stars = classes.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rare", "n", "doc_id", "node")).alias("pivot")).where("size > 1")
    stars = written(stars.select("key", "size", F.col("pivot.node").alias("b"), F.col("pivot.n").alias("n_b")), "heads")
    near = (F.col("n") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n") * percent)
    pairs = join_groups(classes.select("key", "n", F.col("node").alias("a")), stars, "key").where("a <> b").where(near).select("a", "b")
    pairs = written(pairs, "stars")
    sets = _sets(docs, classes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), k)
    stood = written(_verified(pairs, sets).where(linked).select("a", "b", distance.alias("distance")), "stood")

    # prefixes by pivot
    members = classes.join(stood.select(F.col("a").alias("node"), "b", "distance"), "node", "left").select("node", F.coalesce("b", "node").alias("pivot"), F.coalesce("distance", F.lit(0.0)).alias("distance"), "n", "need", "prefix")
    candidates = written(_candidates(members, sketch, percent), "candidates")
    pivot_sets = _sets(docs, classes, candidates.select(F.col("a").alias("node")).union(candidates.select("b")), k)
    checked = written(_verified(candidates, pivot_sets).select("a", "b", linked.alias("linked"), distance.alias("distance")), "checked")
    groups = components(stood.select(F.col("a").alias("u"), F.col("b").alias("v")).union(checked.where("linked").select("a", "b")))

    # pairs of balls whose pivots don't link and aren't in one group yet, opened where the triangle inequality allows a link
    balls = stood.groupBy("b").agg(F.max("distance").alias("radius"))

    def still_apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        out = pairs
        for side in "ab":
            out = out.join(groups.withColumnsRenamed({"vertex": side, "component": f"group_{side}"}), side, "left")
        return out.where(F.coalesce("group_a", "a") != F.coalesce("group_b", "b")).select(pairs.columns)

    apart = checked.where("not linked").select("a", "b", "distance")
    for side in "ab":
        apart = apart.join(balls.withColumnsRenamed({"b": side, "radius": f"radius_{side}"}), side, "left")
    apart = apart.where("radius_a is not null or radius_b is not null").fillna(0.0, ["radius_a", "radius_b"]).where(F.col("distance") <= most + F.col("radius_a") + F.col("radius_b"))
    apart = written(still_apart(apart, groups), "apart")
    if apart.isEmpty():
        return groups

    # which pairs of balls share shingles in their members' prefixes, and how many pairs of places that makes
    alone = sized_broadcast(written(apart.select(F.col("a").alias("pivot")).union(apart.select("b")).distinct(), "alone"))
    places = members.join(alone, "pivot").select("pivot", "node", F.col("distance").alias("own"), F.col("need").cast("int").alias("need"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("place", "shingle"))
    # each task puts its places of a pivot together first, so a shingle that all members have sends few rows
    dealt, keys, once = _in_blocks(places.drop("own"), sketch)
    held = _by_ball(dealt, *keys, "own")
    shared = _pairs_of_balls(held, percent, *keys).where(once).select("a", "b", "shingle", "count_a", "count_b")
    shared = written(shared.join(sized_broadcast(apart), ["a", "b"]), "shared").drop("radius_a", "radius_b", "distance")
    sizes = members.join(alone, "pivot").groupBy("pivot").agg(F.count("*").alias("size"))
    work = shared.groupBy("a", "b").agg(F.sum(F.col("count_a") * F.col("count_b")).alias("work")).join(apart, ["a", "b"])
    for side in "ab":
        work = work.join(sizes.withColumnsRenamed({"pivot": side, "size": f"size_{side}"}), side)
    work = written(work, "work")
    few = F.col("work") <= CROWDED * (F.col("size_a") + F.col("size_b"))
    # a class may have its set in both
    every = sets.union(pivot_sets)

    def opened(keys: DataFrame, places: DataFrame, far: bool) -> DataFrame:
        """Pairs of members that may link; keys: pairs of balls with the shingles they share and their pivots' distance."""
        both = keys
        for side in "ab":
            own = places.withColumn("left", F.col("n") - F.col("place")).drop("place")
            both = both.join(own.withColumnsRenamed({"pivot": side} | {c: f"{c}_{side}" for c in own.columns if c not in ("pivot", "shingle", "other")} | {"other": "b" if side == "a" else "a"}), ["shingle", "a", "b"] if far else ["shingle", side])
        fits = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
        fits &= (F.least("left_a", "left_b") + F.least("need_a", "need_b") - 1) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
        fits &= F.col("own_a") + F.col("own_b") + most >= F.col("distance")
        if far:
            fits &= (F.abs(F.col("own_a") - F.col("far_b")) <= most) & (F.abs(F.col("own_b") - F.col("far_a")) <= most)
        found = both.where(fits).groupBy("node_a", "node_b").agg(F.count("*").alias("common"), F.min(F.least("need_a", "need_b")).alias("need")).where("common >= need")
        return found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    pairs = opened(shared.drop("count_a", "count_b").join(sized_broadcast(written(work.where(few).select("a", "b", "distance"), "few")), ["a", "b"]), places, False)
    crowded = written(work.where(~few).select("a", "b", "distance", "radius_a", "radius_b"), "crowded")
    if not crowded.isEmpty():
        # members against the other ball's pivot, in both directions
        both = crowded.select(F.col("a").alias("ball"), F.col("b").alias("other"), "distance", F.col("radius_b").alias("reach")).union(crowded.select("b", "a", "distance", "radius_a"))
        behind = stood.select(F.col("b").alias("ball"), F.col("a").alias("node"), F.col("distance").alias("own"))
        crossing = written(behind.join(both, "ball").where(F.col("own") + F.col("reach") + most >= F.col("distance")).select(F.col("node").alias("a"), F.col("other").alias("b"), "ball", "own", "reach"), "crossing")
        measured = written(_verified(crossing, every).select(F.col("a").alias("node"), F.col("b").alias("other"), "ball", "reach", distance.alias("far"), linked.alias("linked")).distinct(), "measured")
        groups = components(groups.select(F.col("vertex").alias("u"), F.col("component").alias("v")).union(measured.where("linked").select("node", "other")))
        crowded = sized_broadcast(written(still_apart(crowded.select("a", "b", "distance"), groups), "still"))
        edge = measured.where(F.col("far") <= most + F.col("reach")).select("node", "other", "far")
        pairs = pairs.union(opened(shared.drop("count_a", "count_b").join(crowded, ["a", "b"]), places.join(edge, "node"), True))
    pairs = written(pairs, "opened")
    if pairs.isEmpty():
        return groups
    inside = _verified(pairs, every).where(linked).select("a", "b")
    return components(groups.select(F.col("vertex").alias("u"), F.col("component").alias("v")).union(inside))


def grouped_rows(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row of docs (doc_id, text) with its class digest and set size, and the classes: sig, size, group and first, the group's smallest id."""
    with scratch(docs.sparkSession):
        sketch = frequency_sketch(docs, k)
        described = written(_described(docs, sketch, k, percent), "described")
        some = described.where("n > 0 and doc_id is not null")
        classes = some.groupBy("sig").agg(F.min(F.struct("doc_id", "n", "key", "rare", "need", "prefix")).alias("c"), F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("node"), "sig", "copies", "c.*")
        classes = written(classes, "classes")
        rows = written(described.select("doc_id", "n", "sig"), "rows", keep=True)
        discard(described)
        groups = linked_groups(classes, docs, sketch, k, percent)
        named = written(groups.join(classes.select(F.col("node").alias("vertex"), "sig", "copies", "doc_id"), "vertex"), "named")
        firsts = written(named.groupBy("component").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")), "firsts")
        named = join_groups(named, firsts, "component").select("sig", F.col("copies").alias("size"), F.col("component").alias("group"), "first")
        alone = classes.join(groups.select(F.col("vertex").alias("node")), "node", "left_anti").select("sig", F.col("copies").alias("size"), F.col("node").alias("group"), F.col("doc_id").alias("first"))
        return rows, written(named.unionByName(alone), "by-class", keep=True)


def link_documents(docs: DataFrame, k: int = 4, percent: int = 85, batch_rows: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id that links lead to.

    Two documents link when 100 * shared >= percent * union over their sets of k-word shingles. ``batch_rows``: whole texts that go
    to Python at once.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with batches_of(docs.sparkSession, batch_rows):
        rows, by_class = grouped_rows(docs, k, percent)
    counted = F.col("n").alias("n_shingles")
    found = join_groups(rows.where("n > 0 and doc_id is not null"), by_class, "sig").select("doc_id", counted, F.col("first").alias("component_id"))
    return found.unionByName(rows.where("n = 0 or doc_id is null").select("doc_id", counted, F.col("doc_id").alias("component_id")))


def keep_one_of_each(docs: DataFrame, k: int = 4, percent: int = 85, batch_rows: int = 500) -> DataFrame:
    """The documents, with all their columns, that are the first of their group: one row of the smallest id.

    Rows without an id or without words link with nothing and stay. Rows that share an id but not their group stay as well, one
    of each group whose smallest id it is.
    """
    with batches_of(docs.sparkSession, batch_rows):
        rows, by_class = grouped_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")), k, percent)
        found = written(join_groups(rows.where("n > 0 and doc_id is not null"), by_class, "sig").select("doc_id", "sig", "group", "first"), "grouped")
    again = sized_broadcast(written(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again"))
    if again.isEmpty():
        return _without(docs, found.where("doc_id <> first").select("doc_id"))
    # rows of repeated ids are told apart by their texts, all others by their ids
    gone = found.join(again, "doc_id", "left_anti").where("doc_id <> first").select("doc_id")
    left = _without(docs, gone.unionByName(again))
    schema = T.StructType([T.StructField("rest", T.StructType(docs.schema.fields)), T.StructField("sig", T.BinaryType())])

    def signed(batches):
        for batch in batches:
            sig = [digest(hashes) if len(hashes) else None for _, hashes in sets_of(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.binary())], names=["rest", "sig"])

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")
    repeated = docs.join(again, "doc_id", "left_semi").select(rest, F.col("text").cast("string").alias("text")).mapInArrow(signed, schema)
    own = found.join(again, "doc_id", "left_semi").where("doc_id = first").select("sig", "group", "first").distinct()
    firsts = repeated.join(own, "sig").where(F.col("rest.doc_id") == F.col("first")).groupBy("group").agg(F.min_by("rest", "sig").alias("rest"))
    return left.unionByName(firsts.select("rest.*")).unionByName(repeated.where("sig is null").select("rest.*"))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id isn't among those; all without an id, which no shuffle sees."""
    ids = sized_broadcast(written(ids.distinct(), "gone"))
    left = docs.where("doc_id is not null").join(ids, "doc_id", "left_anti").select(docs.columns)
    return left.unionByName(docs.where("doc_id is null"))
