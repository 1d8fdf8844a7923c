"""Ranked lexical search over an index of posting lists in geometric blocks.

1. Queries are read in blocks of bounded size; their terms are numbered. One pass over the documents keeps, of each, its length and
   the query terms that it has; Spark counts documents, words, and documents of each term.
2. The index: about ``SEGMENT_CELLS`` / terms documents in a row make a segment. In a segment the postings of each term are
   clustered by similarity of their documents (projections of their weighted terms): each goes to the nearest of some postings of
   the list, and every cluster is a block. A block's summary is the largest impact of each term over its documents, rounded up.
3. The search takes, for each query and segment, the block with the highest bound (query weights times summary) and scores its
   documents; the k-th highest of these scores over all segments is a threshold that the k-th hit reaches at least. A block is
   skipped only if its bound is below the threshold. Documents of all other blocks are scored whole, each once.
4. Every segment's k best go to a window over the query.

Impacts, weights and scores are integers; bounds are summed in single precision and raised by more than what rounding can take from them.

Null and empty texts have no terms and are found by nothing. Documents without an id count and can be found; among equal scores
they come last. Repeated rows are documents, and queries, of their own. Queries without terms find nothing. An empty table gives
an empty result. Only the id and text columns of both tables are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import ragged, sums, text_slices
from .common import batches_of, scratch, written
from .decontaminate import normal_words

#: Terms and queries of a block of queries, about.
BLOCK_TERMS, BLOCK_QUERIES = 8192, 512
#: Documents times terms of a segment, and its documents at most.
SEGMENT_CELLS, SEGMENT_DOCS = 1 << 23, 8192
#: Postings that a block has on average; a cluster of over twice as many is cut.
BLOCK = 128
#: One step of a summary; impacts are below 1,000,000.
STEP = 4000
#: Numbers that stand for a document's direction.
DIRECTIONS = 32
#: Blocks whose bounds are worked out at once.
BOUNDS_AT_ONCE = 256
#: Segments are long rows: one or two of them are read or written at once.
LONG_ROWS = {"parquet.block.size": str(4 << 20), **{f"parquet.{what}.size.row.check.{edge}": "1" for what in ("block", "page") for edge in ("min", "max")}}


@dataclass
class Queries:
    """A block of queries: their ids, terms (number by word), and for each query its terms' numbers and how often it has them."""

    ids: list
    numbers: dict[bytes, int]
    terms: list[np.ndarray]
    times: list[np.ndarray]


def _query_blocks(queries: DataFrame) -> Iterator[Queries]:
    """The queries (item_id, text) in blocks; one is collected when it is asked for."""

    def split(batches):
        for batch in batches:
            rows = [Counter(normal_words(t)) for t in batch.column(1).to_pylist()]
            words, times = [list(r) for r in rows], [list(r.values()) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))], names=["item_id", "words", "times"])

    schema = T.StructType([queries.schema["item_id"], T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType()))])
    found = queries.mapInArrow(split, schema).where(F.size("words") > 0)
    n, size = found.agg(F.count("*"), F.sum(F.size("words"))).first()
    if not n:
        return
    count = max(math.ceil(n / BLOCK_QUERIES), math.ceil(size / BLOCK_TERMS))
    found = found if count == 1 else written(found.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(count))), "queries")
    for b in range(count):
        rows = (found if count == 1 else found.where(F.col("block") == b)).select("item_id", "words", "times").collect()
        numbers: dict[bytes, int] = {}
        terms = [np.array([numbers.setdefault(bytes(w), len(numbers)) for w in r["words"]], np.int64) for r in rows]
        if rows:
            yield Queries([r["item_id"] for r in rows], numbers, terms, [np.array(r["times"], np.int64) for r in rows])


def _forward(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms with repeats), and the numbered terms with their times of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(numbers)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def read(batches):
        get = held.value.get
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1)):
                raw = data.tobytes()
                n, own = np.zeros(last - first, np.int64), []
                for r in range(last - first):
                    found = normal_words(raw[offsets[r] : offsets[r + 1]])
                    n[r] = len(found)
                    known = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
                    own.append(r << 32 | known[known >= 0])
                keys, times = np.unique(np.concatenate(own), return_counts=True)
                bounds = pa.array(np.searchsorted(keys, np.arange(last - first + 1) << 32), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (keys & 0xFFFFFFFF, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(n), *lists], names=schema.names)

    return docs.mapInArrow(read, schema)


def impacts(times: np.ndarray, n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 12 m) of terms in documents of n words."""
    product = 25 * n * n_docs if int(n.max(initial=0)) * 25 * n_docs < 1 << 63 else np.array([25 * int(x) * n_docs for x in n], object)
    m = 75 + (product // n_words).astype(np.int64)
    return 1_000_000_000 * times // (1000 * times + 12 * m)


def blocks_of(docs: np.ndarray, direction: np.ndarray) -> list[np.ndarray]:
    """A posting list's documents in blocks of similar ones."""
    if len(docs) <= BLOCK:
        return [docs]
    heads = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // BLOCK)).astype(np.int64)]
    nearest = np.argmax(direction[docs] @ direction[heads].T, axis=1)
    order = np.argsort(nearest, kind="stable")
    out = []
    for cluster in np.split(docs[order], np.flatnonzero(np.diff(nearest[order])) + 1):
        out += np.array_split(cluster, -(-len(cluster) // BLOCK)) if len(cluster) > 2 * BLOCK else [cluster]
    return out


INDEX = ("bounds", "terms", "impacts", "block_terms", "block_bounds", "members", "mask", "tops")


def _segment(ids: pa.Array, bounds: np.ndarray, terms: np.ndarray, impact: np.ndarray, weights: np.ndarray, projection: np.ndarray) -> list:
    """A segment of the index: the forward lists of its documents, and blocks with their members and summaries."""
    n, size = len(ids), len(weights)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    rounded = np.zeros((n, size), np.uint8)
    rounded[owner, terms] = -(-impact // STEP)
    direction = np.empty((n, DIRECTIONS), np.float32)
    for a in range(0, n, 1024):
        direction[a : a + 1024] = rounded[a : a + 1024].astype(np.float32) @ projection
    direction /= np.maximum(np.linalg.norm(direction, axis=1, keepdims=True), 1e-9)
    order = np.argsort(terms, kind="stable")
    edge = np.searchsorted(terms[order], np.arange(size + 1))
    of, members, tops = [], [], []
    for t in np.flatnonzero(np.diff(edge)):
        for block in blocks_of(owner[order[edge[t] : edge[t + 1]]], direction):
            of.append(t)
            members.append(block)
            tops.append(rounded[block].max(axis=0))
    tops = np.stack(tops) if tops else np.zeros((0, size), np.uint8)
    held = tops > 0
    columns = [bounds.astype("<i4"), terms.astype("<u2" if size <= 65536 else "<u4"), impact.astype("<u4"), np.array(of, "<i4"), np.concatenate([[0], np.cumsum([len(x) for x in members])]).astype("<i4"), np.concatenate([*members, np.zeros(0, np.int64)]).astype("<u2"), np.packbits(held, axis=1), tops[held]]
    return [ids, *(c.tobytes() for c in columns)]


def _index(forward: DataFrame, weights: np.ndarray, n_docs: int, n_words: int) -> DataFrame:
    """One row for each segment: ids, and arrays as bytes."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(forward.schema["doc_id"].dataType)), *(T.StructField(c, T.BinaryType()) for c in INDEX)])
    most = max(256, min(SEGMENT_DOCS, SEGMENT_CELLS // len(weights)))
    held = forward.sparkSession.sparkContext.broadcast(weights)

    def build(batches):
        weights = held.value
        projection = (np.random.default_rng(7).choice([-1.0, 1.0], (len(weights), DIRECTIONS)) * weights[:, None]).astype(np.float32)

        def out(rows: pa.Table):
            rows = rows.combine_chunks()
            ids, n, lists, times = (rows[c].chunk(0) for c in ("doc_id", "n", "terms", "times"))
            counts = np.asarray(pc.list_value_length(lists), np.int64)
            terms, times = (np.asarray(pc.list_flatten(x), np.int64) for x in (lists, times))
            impact = impacts(times, np.repeat(np.asarray(n, np.int64), counts), n_docs, n_words)
            columns = _segment(ids, np.concatenate([[0], np.cumsum(counts)]), terms, impact, weights, projection)
            kinds = [pa.list_(ids.type), *[pa.binary()] * len(INDEX)]
            return pa.RecordBatch.from_arrays([pa.array([c.to_pylist() if c is ids else c], t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

        rows, size = [], 0
        for batch in batches:
            rows.append(batch)
            size += batch.num_rows
            while size >= most:
                table = pa.Table.from_batches(rows)
                yield out(table.slice(0, most))
                rows, size = table.slice(most).to_batches(), size - most
        if size:
            yield out(pa.Table.from_batches(rows))

    return forward.where(F.size("terms") > 0).mapInArrow(build, schema)


class Segment:
    """A segment as it is searched."""

    def __init__(self, row: dict, size: int):
        self.ids = row["ids"]
        get = lambda c, kind: np.frombuffer(row[c], kind)
        self.bounds, self.terms, self.impacts = get("bounds", "<i4").astype(np.int64), get("terms", "<u2" if size <= 65536 else "<u4"), get("impacts", "<u4")
        self.of, self.edges, self.members = get("block_terms", "<i4"), get("block_bounds", "<i4").astype(np.int64), get("members", "<u2")
        self.mask = np.unpackbits(get("mask", np.uint8).reshape(len(self.of), -1), axis=1, count=size).astype(bool) if len(self.of) else np.zeros((0, size), bool)
        self.tops, self.size = get("tops", np.uint8), size

    def block_bounds(self, matrix: np.ndarray) -> np.ndarray:
        """An upper bound of the score of any document in each block, by query; -1 where the query hasn't the block's term."""
        out = np.full((len(self.of), matrix.shape[1]), -1.0)
        at = np.concatenate([[0], np.cumsum(self.mask.sum(axis=1))])
        asking, small = matrix > 0, matrix.astype(np.float32)
        # more than what rounding to single precision can take from a sum of so many terms
        slack = 1 + 1.2e-7 * (int(asking.sum(axis=0).max(initial=0)) + 2)
        for a in range(0, len(self.of), BOUNDS_AT_ONCE):
            b = min(a + BOUNDS_AT_ONCE, len(self.of))
            part = np.zeros((b - a, self.size), np.float32)
            part[self.mask[a:b]] = self.tops[at[a] : at[b]]
            # the blocks of a term stand together
            heads = np.flatnonzero(np.diff(self.of[a:b], prepend=-1))
            for i, j in zip(heads, np.append(heads[1:], b - a), strict=True):
                queries = np.flatnonzero(asking[self.of[a + i]])
                if len(queries):
                    out[a + i : a + j, queries] = (part[i:j] @ small[:, queries]).astype(np.float64) * (STEP * slack)
        return out

    def scores(self, blocks: np.ndarray, weight: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of the blocks that aren't done yet, and their whole scores."""
        fresh = np.zeros(len(self.ids), bool)
        fresh[self.members[ragged(self.edges[blocks], self.edges[blocks + 1] - self.edges[blocks])]] = True
        docs = np.flatnonzero(fresh & ~done)
        counts = self.bounds[docs + 1] - self.bounds[docs]
        at = ragged(self.bounds[docs], counts)
        return docs, sums(weight[self.terms[at]] * self.impacts[at], np.concatenate([[0], np.cumsum(counts)]))


def _matrix(terms: list[np.ndarray], weights: list[np.ndarray], size: int) -> np.ndarray:
    out = np.zeros((size, len(terms)))
    for q, (t, w) in enumerate(zip(terms, weights, strict=True)):
        out[t, q] = w
    return out


def _search(index: DataFrame, terms: list[np.ndarray], weights: list[np.ndarray], size: int, k: int, least: np.ndarray | None) -> DataFrame:
    """query, doc_id and score of the k best of each segment and query, and how many blocks were asked for and scored.

    Without thresholds, only the documents of the block with the highest bound.
    """
    context = index.sparkSession.sparkContext
    held = context.broadcast((terms, weights, least))
    ids = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("doc_id", ids), T.StructField("score", T.LongType()), T.StructField("blocks", T.LongType()), T.StructField("scored", T.LongType())])

    def search(batches):
        terms, weights, least = held.value
        matrix = _matrix(terms, weights, size)
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row, size)
                if not len(segment.of):
                    continue
                names, bounds = pa.array(segment.ids, batch.schema.field("ids").type.value_type), segment.block_bounds(matrix)
                out = [], [], [], [], []
                for q in range(len(terms)):
                    own = bounds[:, q]
                    asked = np.flatnonzero(own >= 0)
                    if not len(asked):
                        continue
                    weight = matrix[:, q].astype(np.int64)
                    done = np.zeros(len(segment.ids), bool)
                    best = asked[np.argmax(own[asked])]
                    floor = 1 if least is None else max(1, int(least[q]))
                    docs, scores, tried = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
                    for turn in range(1 if least is None else 2):
                        some = np.array([best]) if turn == 0 else np.setdiff1d(asked, [best])
                        some = some[own[some] >= floor]
                        more, found = segment.scores(some, weight, done)
                        done[more] = True
                        tried += len(some)
                        docs, scores = np.concatenate([docs, more]), np.concatenate([scores, found])
                        keep = scores >= floor
                        docs, scores = docs[keep], scores[keep]
                        if len(scores) > k:
                            keep = scores >= np.partition(scores, -k)[-k]
                            docs, scores = docs[keep], scores[keep]
                        if len(scores) >= k:
                            floor = max(floor, int(scores.min()))
                    found = pa.table({"doc_id": names.take(pa.array(docs)), "score": pa.array(scores)})
                    found = found.take(pc.sort_indices(found, [("score", "descending"), ("doc_id", "ascending")])).slice(0, k)
                    n = max(1, len(found))
                    rows = [np.full(n, q), found["doc_id"].to_pylist() or [None], found["score"].to_pylist() or [None], [len(asked)] + [0] * (n - 1), [tried] + [0] * (n - 1)]
                    for column, values in zip(out, rows, strict=True):
                        column.extend(values)
                kinds = [pa.int32(), names.type, pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=schema.names)

    return index.mapInArrow(search, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank; each task hands on k rows of a query at most."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.where("score is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 20, batch_rows: int = 500, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", counts: list | None = None) -> DataFrame:
    """item_id, rank, doc_id and score of the k documents that score highest for each query, of equal ones the smallest ids.

    ``counts``: takes, for each block of queries, how many blocks of the index were asked for and how many of them scored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    queries = queries.select(F.col(query_id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([queries.schema["item_id"], T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], schema)
    for block in _query_blocks(queries):
        with scratch(spark):
            size = len(block.numbers)
            with batches_of(spark, batch_rows):
                forward = written(_forward(docs, block.numbers), "forward")
            n_docs, n_words = forward.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
            if not n_docs:
                continue
            holding = np.zeros(size, np.int64)
            for row in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
                holding[row["term"]] = row["count"]
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)
            asked = [weights[t] * n for t, n in zip(block.terms, block.times, strict=True)]
            with batches_of(spark, 1024):
                index = written(_index(forward, weights, n_docs, n_words), "index", options=LONG_ROWS)
            with batches_of(spark, 1):
                seeds = _best(_search(index, block.terms, asked, size, k, None), k).where(F.col("rank") == k).select("query", "score").collect()
                least = np.zeros(len(asked), np.int64)
                for row in seeds:
                    least[row["query"]] = row["score"]
                found = written(_search(index, block.terms, asked, size, k, least), "hits")
            if counts is not None:
                counts.append(tuple(found.agg(F.sum("blocks"), F.sum("scored")).first()))
            names = spark.createDataFrame([(q, x) for q, x in enumerate(block.ids)], T.StructType([T.StructField("query", T.IntegerType()), queries.schema["item_id"]]))
            best = _best(found, k).join(F.broadcast(names), "query")
            out = out.unionByName(written(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked", keep=True))
    return out
