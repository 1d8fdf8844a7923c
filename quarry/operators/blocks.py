"""Best chunks of each query within its scope, by blocks of queries against blocks of chunks.

Every query of a scope meets every chunk of it, but only inside a task: rows are dealt into blocks, each pair of blocks goes to one
task, and what leaves a task is the first k of each of its queries. So what is shuffled are the blocks, once for each block they
meet, and no table of pairs. A task holds one block of queries and one tile of chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows of a block of queries and of chunks, and of the tile of chunks that a task holds; of a tile of texts, the bytes too.
QUERY_BLOCK, CHUNK_BLOCK, VECTOR_BLOCK, TILE = 131_072, 1_048_576, 32_768, 2_048
#: Pairs of a block from which a scope's chunks are cut to more blocks than their number asks for.
PAIRS = 1 << 28
TEXT_TILE, VECTOR_TILE, TILE_BYTES = 131_072, 16_384, 64_000_000
#: Numbers of a tile's matrix at most (32 MB), and pairs of vectors that are scored at once.
CELLS, VECTOR_CELLS = 4_000_000, 1 << 20
#: Chunks of a tile's first range and how many times as many the next ones have; the share of a k-th score that terms may add which are looked up.
FIRST_RANGE, WIDER, LOOSE = 2_048, 4, 0.4
#: Terms of a tile that can be looked up by chunk at most.
DENSE = 64
#: How far a product of matrices may be from the sum in order.
SLACK = 1e-9


def _sizes(queries: DataFrame, chunks: DataFrame, query_block: int, chunk_block: int, least: int) -> DataFrame:
    """Of each scope that is asked, how many blocks of queries and of chunks it has; few large ones are cut further, so that they make more tasks."""
    n = lambda df, name: df.groupBy("scope").agg(F.count("*").alias(name))
    spread = 2 * queries.sparkSession.sparkContext.defaultParallelism
    both = n(queries, "q").join(n(chunks, "c"), "scope").withColumn("n_q", F.ceil(F.col("q") / query_block))
    more = F.least(F.ceil(spread / F.col("n_q")), F.ceil(F.col("q") * F.col("c") / PAIRS), F.ceil(F.col("c") / least))
    return both.select("scope", F.col("n_q").cast("int"), F.greatest(F.ceil(F.col("c") / chunk_block), more).cast("int").alias("n_c"))


def paired(queries: DataFrame, chunks: DataFrame, query_block: int = QUERY_BLOCK, chunk_block: int = CHUNK_BLOCK, least: int = TILE) -> DataFrame:
    """Queries (query_id, scope, ...) and chunks (chunk_id, scope, the same columns) by pair of blocks, in the order that ``folded`` reads.

    The scopes that are asked are broadcast with their numbers of blocks. To make more tasks, chunks are cut to smaller blocks, but not below ``least`` rows.
    """
    queries, chunks = queries.where("scope is not null"), chunks.where("scope is not null")
    sizes = F.broadcast(written(_sizes(queries, chunks, query_block, chunk_block, least), "sizes"))
    own = lambda n, key: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    rest = [c for c in queries.columns if c != "query_id"]
    missing = lambda df, key: F.lit(None).cast(df.schema[key].dataType).alias(key)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(sizes, "scope").select(F.lit(0).alias("side"), "query_id", missing(chunks, "chunk_id"), *rest, own("n_q", "query_id").alias("qb"), every("n_c").alias("cb"))
    right = chunks.join(sizes, "scope").select(F.lit(1).alias("side"), missing(queries, "query_id"), "chunk_id", *rest, own("n_c", "chunk_id").alias("cb"), every("n_q").alias("qb"))
    spark = queries.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return left.unionByName(right).repartition(n, "scope", "qb", "cb").sortWithinPartitions("scope", "qb", "cb", "side")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """Runs of rows of one pair of blocks and one side: its key, its side, its rows."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(b["scope"].to_pylist(), b["qb"].to_pylist(), b["cb"].to_pylist(), b["side"].to_pylist(), strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start][:3], keys[start][3], b.slice(start, i - start)
                start = i


def folded(rows: DataFrame, scorer: Callable, k: int, query_type: str, chunk_type: str, scope_type: str, width: int = TILE) -> DataFrame:
    """(query_id, scope, chunk_id, score): the first k of each query of each pair of blocks. ``scorer(queries)`` has ``add(chunks)`` and ``best()``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, own, tile, n, size = None, [], None, [], 0, 0

        def flush():
            nonlocal own, tile, n, size
            if own is None:
                own = scorer(pa.Table.from_batches(held), k)
            if tile:
                own.add(pa.Table.from_batches(tile))
            tile, n, size = [], 0, 0

        def out():
            if own is None or tile:
                flush()
            query, chunk, score = own.best()
            for at in range(0, len(query), 10_000):
                part = slice(at, at + 10_000)
                # a missing query's or chunk's vector has no distance
                columns = query[part], pa.repeat(pa.scalar(key[0], schema.field("scope").type), len(query[part])), chunk[part], score[part]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type, from_pandas=True) for x, f in zip(columns, schema, strict=True)], schema=schema)

        schema = None
        for found, side, part in _spans(batches):
            if schema is None:
                schema = pa.schema([("query_id", _plain(part, query_type)), ("scope", part.schema.field("scope").type), ("chunk_id", _plain(part, chunk_type)), ("score", pa.float64())])
            if found != key:
                if held:
                    yield from out()
                key, held, own, tile, n, size = found, [], None, [], 0, 0
            if side == 0:
                held.append(part)
            elif held:
                for at in range(0, part.num_rows, min(width, TILE)):
                    piece = part.slice(at, min(width, TILE))
                    if n + piece.num_rows > width or size + piece.nbytes > TILE_BYTES:
                        flush()
                    tile.append(piece)
                    n, size = n + piece.num_rows, size + piece.nbytes
        if held:
            yield from out()

    return rows.mapInArrow(run, f"query_id {query_type}, scope {scope_type}, chunk_id {chunk_type}, score double")


def _plain(part: pa.RecordBatch, kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as one array and the places where the lists begin."""
    column = column.combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    lengths = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))


#: Bytes of tokens, and for each length what masks the bytes after it.
_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", dtype=np.uint8))
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def tokens(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a-z and 0-9 of lower-case texts (null: none) as 64-bit numbers, and the places where the texts' tokens begin.

    Up to eight characters are their own number; longer ones are hashed, to numbers that no short one has.
    """
    parts = [(numbers, counts) for numbers, *_, counts in map(token_places, column.chunks)]
    size = [np.zeros(0, dtype=np.int64), *(n for _, n in parts)]
    return np.concatenate([np.zeros(0, dtype=np.int64), *(h for h, _ in parts)]), np.concatenate(([0], np.cumsum(np.concatenate(size))))


def token_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens as numbers, the bytes of the texts, where each token begins there, its length, and how many tokens a text has."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    if offsets[-1] == offsets[0]:
        none = np.zeros(0, dtype=np.int64)
        return none, none.view(np.uint8), none, none, np.zeros(len(texts), dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    length = np.flatnonzero(inside & (~after | edge[1:])) + 1 - begin
    # eight bytes from each place on
    words = np.ndarray(len(data), dtype="<u8", buffer=np.append(data, np.zeros(8, dtype=np.uint8)), strides=(1,))
    out = words[begin] & _MASK[np.minimum(length, 8)]
    long, at = np.flatnonzero(length > 8), 8
    state = out[long] ^ length[long].astype(np.uint64)
    while len(long):
        state = (state ^ (state >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        state ^= words[begin[long] + at] & _MASK[np.minimum(length[long] - at, 8)]
        at += 8
        ended = length[long] <= at
        last = (state ^ (state >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[long[ended]] = (last[ended] ^ (last[ended] >> np.uint64(32))) | np.uint64(1 << 63)
        long, state = long[~ended], state[~ended]
    return out.view(np.int64), data, begin, length, np.diff(np.searchsorted(begin, offsets))


def terms_of(texts: DataFrame, key: str, key_type: str, scope_type: str) -> DataFrame:
    """(key, scope, term): the tokens of lower-case texts (key, scope, text), repeats included, as the numbers that ``tokens`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TILE):
                part = pa.Table.from_batches([b.slice(at, TILE)])
                terms, edges = tokens(part["text"])
                row = np.repeat(np.arange(part.num_rows), np.diff(edges))
                found = pa.Table.from_arrays([part[key].take(pa.array(row)), part["scope"].take(pa.array(row)), pa.chunked_array([terms])], [key, "scope", "term"])
                yield from found.to_batches(max_chunksize=10_000)

    return texts.select(key, "scope", "text").mapInArrow(run, f"{key} {key_type}, scope {scope_type}, term bigint")


def frequencies(texts: DataFrame, scope_type: str) -> DataFrame:
    """(scope, term, n, n_words): in how many lower-case texts (scope, text) a scope has a term; without a term, its texts that aren't null and their tokens."""

    def counted(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        terms, edges = tokens(t["text"])
        scopes = t["scope"].combine_chunks().dictionary_encode()
        scopes = scopes.combine_chunks() if isinstance(scopes, pa.ChunkedArray) else scopes
        own, size = scopes.indices.to_numpy(), np.diff(edges)
        there = t["text"].is_valid().to_numpy()
        texts, words = (np.bincount(own, w, len(scopes.dictionary)).astype(np.int64) for w in (there, size))
        yield from out(scopes.dictionary, np.arange(len(texts)), None, texts, words)
        vocabulary, term = np.unique(terms, return_inverse=True)
        # a term once of each text, then by scope
        once = np.sort(np.repeat(np.arange(len(size)), size) * len(vocabulary) + term) if len(terms) else term
        once = once[np.flatnonzero(np.diff(once, prepend=-1))]
        held, n = np.unique(own[once // max(1, len(vocabulary))] * len(vocabulary) + once % max(1, len(vocabulary)), return_counts=True)
        yield from out(scopes.dictionary, held // max(1, len(vocabulary)), vocabulary[held % max(1, len(vocabulary))], n, np.zeros(len(n), dtype=np.int64))

    def out(scopes: pa.Array, own: np.ndarray, term: np.ndarray | None, n: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        terms = pa.nulls(len(own), pa.int64()) if term is None else pa.array(term)
        for at in range(0, len(own), 10_000):
            part = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([scopes.take(pa.array(own[part])), terms[part], pa.array(n[part]), pa.array(words[part])], ["scope", "term", "n", "n_words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > TILE_BYTES // 2:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)

    found = texts.where("scope is not null").select("scope", "text").mapInArrow(run, f"scope {scope_type}, term bigint, n bigint, n_words bigint")
    return found.groupBy("scope", "term").agg(F.sum("n").alias("n"), F.sum("n_words").alias("n_words"))


class _Best:
    """The first k of each of n queries: highest score, then smallest id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score: list[np.ndarray] = [np.empty(0)] * len(ids)
        self.chunk: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(ids)
        self.floor = np.full(len(ids), -np.inf)

    def merge(self, q: int, score: np.ndarray, chunk: np.ndarray) -> None:
        if len(self.score[q]):
            score, chunk = np.concatenate((self.score[q], score)), np.concatenate((self.chunk[q], chunk))
        if len(score) > 8 * self.k:
            # the k-th score first, so that few are sorted
            least = np.partition(score, len(score) - self.k)[len(score) - self.k]
            keep = score >= least
            score, chunk = score[keep], chunk[keep]
        by_id = np.argsort(chunk, kind="stable")
        order = by_id[np.argsort(-score[by_id], kind="stable")][: self.k]
        self.score[q], self.chunk[q] = score[order], chunk[order]
        if len(order) == self.k:
            self.floor[q] = self.score[q][-1]

    def merge_all(self, queries: np.ndarray, at: np.ndarray, score: np.ndarray, chunk: np.ndarray) -> None:
        """Rows of many queries, given by their places in ``queries`` in rising order."""
        found, first = np.unique(at, return_index=True)
        edges = np.append(first, len(at))
        if chunk.dtype == object or len(at) > 64 * self.k * len(found):
            for i, q in enumerate(queries[found].tolist()):
                self.merge(q, score[edges[i] : edges[i + 1]], chunk[edges[i] : edges[i + 1]])
            return
        mine = queries[found].tolist()
        group = np.concatenate((np.repeat(np.arange(len(found)), [len(self.score[q]) for q in mine]), np.repeat(np.arange(len(found)), np.diff(edges))))
        score, chunk = np.concatenate([*(self.score[q] for q in mine), score]), np.concatenate([*(self.chunk[q] for q in mine), chunk])
        order = np.lexsort((chunk, -score, group))
        begin = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=len(found)))))
        order = order[np.arange(len(order)) - begin[group[order]] < self.k]
        score, chunk, size = score[order], chunk[order], np.minimum(np.diff(begin), self.k)
        end = np.cumsum(size)
        for q, a, b in zip(mine, (end - size).tolist(), end.tolist(), strict=True):
            # copies, as parts would hold the whole
            self.score[q], self.chunk[q] = score[a:b].copy(), chunk[a:b].copy()
        full = size == self.k
        self.floor[queries[found[full]]] = score[end[full] - 1]

    def best(self):
        n = [len(s) for s in self.score]
        if not sum(n):
            return self.ids[:0], self.ids[:0], np.empty(0)
        return np.repeat(self.ids, n), np.concatenate([c for c in self.chunk if len(c)]), np.concatenate(self.score)


def _ids(t: pa.Table, name: str) -> np.ndarray:
    return t[name].to_numpy()


class _Postings:
    """The terms of a tile of chunks that queries ask: for each, its chunks with what it adds to them, in ranges of chunks.

    Chunks of most asked tokens stand first, ranges grow, and each has its own bounds.
    """

    def __init__(self, ids: np.ndarray, place: np.ndarray, column: np.ndarray, n_terms: int, value: Callable):
        shared = np.bincount(column, minlength=len(ids))
        order = np.argsort(-shared, kind="stable")[: np.count_nonzero(shared)]
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.ids, n = ids[order], max(1, len(order))
        cells = np.sort(place * n + rank[column])
        first = np.flatnonzero(np.diff(cells, prepend=-1))
        tf, cells = np.diff(np.append(first, len(cells))), cells[first]
        term, self.column = cells // n, cells % n
        self.value = value(term, tf.astype(np.float64), order[self.column])
        begin = np.flatnonzero(np.diff(term, prepend=-1))
        self.row = np.full(n_terms, -1)
        self.row[term[begin]] = np.arange(len(begin))
        self.edges = np.unique(np.minimum([0, *(FIRST_RANGE * WIDER ** np.arange(20))], n))
        self.cut = np.searchsorted(cells, term[begin][:, None] * n + self.edges)
        self.most = np.zeros((len(begin), len(self.edges) - 1))
        filled = np.flatnonzero(np.diff(self.cut, axis=1).ravel())
        if len(filled):
            self.most.ravel()[filled] = np.maximum.reduceat(self.value, self.cut[:, :-1].ravel()[filled])
        # what the most frequent terms add, by chunk
        often = np.argsort(self.cut[:, 0] - self.cut[:, -1], kind="stable")[: min(DENSE, CELLS // n)]
        self.dense_row = np.full(len(begin), -1)
        self.dense_row[often] = np.arange(len(often))
        self.dense = np.zeros((n, len(often)))
        at = np.repeat(self.dense_row, self.cut[:, -1] - self.cut[:, 0])
        self.dense[self.column[at >= 0], at[at >= 0]] = self.value[at >= 0]

    def gathered(self, rows: np.ndarray, s: int) -> np.ndarray:
        """What the terms add to each chunk of a range."""
        parts = [slice(a, b) for a, b in zip(self.cut[rows, s].tolist(), self.cut[rows, s + 1].tolist(), strict=True) if b > a]
        width = self.edges[s + 1] - self.edges[s]
        if not parts:
            return np.zeros(width)
        return np.bincount(np.concatenate([self.column[x] for x in parts]) - self.edges[s], np.concatenate([self.value[x] for x in parts]), width)

    def looked_up(self, rows: np.ndarray, s: int, at: np.ndarray) -> np.ndarray:
        """What frequent terms add to some chunks of a range."""
        asked = np.zeros(self.dense.shape[1])
        asked[self.dense_row[rows]] = 1
        return self.dense[at + self.edges[s]] @ asked


class Counted:
    """Sums of what the terms that a query and a chunk share add.

    ``bm25`` None: an occurrence adds one; otherwise BM25 with (k1, b), the terms' weights and the scope's mean size. For each range of
    chunks, frequent terms that together can't reach a query's k-th score find no chunk of their own; they are looked up in those where
    the other terms leave them a chance, and ranges whose terms can't reach it at all are left out.
    """

    def __init__(self, t: pa.Table, k: int, bm25: tuple[float, float] | None):
        self.held, self.bm25 = _Best(_ids(t, "query_id"), k), bm25
        terms, self.at = _lists(t["terms"]) if bm25 else tokens(t["text"])
        self.vocabulary, self.own = np.unique(terms, return_inverse=True)
        if bm25:
            self.weight = np.zeros(len(self.vocabulary))
            self.weight[self.own] = _lists(t["weights"])[0]
            self.mean = float(t["mean"][0].as_py())

    def add(self, t: pa.Table) -> None:
        ids, (terms, at) = _ids(t, "chunk_id"), tokens(t["text"])
        if not len(self.vocabulary):
            return
        size = np.diff(at)
        place = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        asked = self.vocabulary[place] == terms
        column = np.repeat(np.arange(len(ids)), size)[asked]
        if not len(column):
            return

        def value(term: np.ndarray, tf: np.ndarray, chunk: np.ndarray) -> np.ndarray:
            if not self.bm25:
                return tf
            k1, b = self.bm25
            return self.weight[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[chunk] / self.mean))

        index = _Postings(ids, place[asked], column, len(self.vocabulary), value)
        rows = index.row[self.own]
        there, edges = np.flatnonzero(rows >= 0), np.searchsorted(np.flatnonzero(rows >= 0), self.at)
        rows = rows[there]
        # what each range can add to a query at most, a few queries at once; most can't reach its k-th score
        for start in range(0, len(self.held.ids), TILE):
            part = edges[start : start + TILE + 1]
            most = index.most[rows[part[0] : part[-1]]]
            total = np.zeros((len(part) - 1, most.shape[1]))
            if len(filled := np.flatnonzero(np.diff(part))):
                total[filled] = np.add.reduceat(most, part[filled] - part[0])
            reach = (total > 0) & (total >= self.held.floor[start : start + TILE, None] - SLACK)
            for i in np.flatnonzero(reach.any(axis=1)).tolist():
                self._meet(start + i, rows[part[i] : part[i + 1]], most[part[i] - part[0] : part[i + 1] - part[0]], total[i], index)

    def _meet(self, q: int, mine: np.ndarray, most: np.ndarray, total: np.ndarray, index: _Postings) -> None:
        for s, reach in enumerate(total.tolist()):
            if reach > 0 and reach >= self.held.floor[q] - SLACK:
                self._meet_range(q, mine, most[:, s], index, s)

    def _meet_range(self, q: int, mine: np.ndarray, most: np.ndarray, index: _Postings, s: int) -> None:
        least = self.held.floor[q] - SLACK
        # terms that are looked up: frequent ones of small bounds
        frequent = np.flatnonzero(index.dense_row[mine] >= 0)
        frequent = frequent[np.argsort(most[frequent])]
        sums = np.cumsum(most[frequent])
        n = int(np.searchsorted(sums, LOOSE * least)) if least > 0 else 0
        loose = frequent[:n]
        score = index.gathered(np.delete(mine, loose), s)
        at = np.flatnonzero(score >= least - sums[n - 1]) if n else np.flatnonzero((score >= least) & (score > 0))
        score = score[at]
        if n and len(at):
            score = score + index.looked_up(mine[loose], s, at)
            found = np.flatnonzero(score >= least)
            at, score = at[found], score[found]
        if len(at):
            self.held.merge(q, np.round(score, 9) if self.bm25 else score, index.ids[at + index.edges[s]])

    def best(self):
        return self.held.best()


class Nearest:
    """Cosine distances, by products of matrices in single precision first; what is among the nearest by them, less what these may be
    wrong by, is summed up in order. Scores are negative distances."""

    def __init__(self, t: pa.Table, k: int):
        self.held = _Best(_ids(t, "query_id"), k)
        self.sides = self._by_length(t)

    @staticmethod
    def _by_length(t: pa.Table) -> dict[int, tuple]:
        """The rows of each length of vector: which, as doubles, norms, unit vectors; length -1 are null ones."""
        values, at = _lists(t["vector"])
        size = np.where(t["vector"].is_null().to_numpy(), -1, np.diff(at))
        out = {}
        for n in np.unique(size):
            which = np.flatnonzero(size == n)
            v = values[at[which][:, None] + np.arange(max(n, 0))].astype(np.float64)
            square = np.zeros(len(which))
            for j in range(max(n, 0)):
                square += v[:, j] * v[:, j]
            norm = np.sqrt(square)
            out[int(n)] = which, v, norm, (v / np.where(norm == 0, 1.0, norm)[:, None]).astype(np.float32)
        return out

    def add(self, t: pa.Table) -> None:
        ids, chunks = _ids(t, "chunk_id"), self._by_length(t)
        for n, (mine, v, norm, unit) in self.sides.items():
            for m, (theirs, w, other, units) in chunks.items():
                step = max(1, VECTOR_CELLS // len(theirs))
                for start in range(0, len(mine), step):
                    part = slice(start, start + step)
                    self._meet(mine[part], v[part], norm[part], unit[part], ids[theirs], w, other, units, n == m and n >= 0, n < 0 or m < 0)

    def _meet(self, mine, v, norm, unit, ids, w, other, units, comparable, missing) -> None:
        near = unit @ units.T if comparable else np.full((len(mine), len(ids)), -np.inf if missing else 0.0)
        if comparable and not (np.isfinite(unit).all() and np.isfinite(units).all()):
            near[np.isnan(near)] = -np.inf
        # twice the error of a sum of so many products, and of a square's root
        slack = (unit.shape[1] + 8) * 2.0**-22
        floor = self.held.floor[mine]
        k = self.held.k
        if len(ids) > 8 * k:
            if (fresh := np.flatnonzero(floor == -np.inf)).size:
                # the k-th of a few chunks, so that most others are left out
                few = near[fresh, : max(8 * k, FIRST_RANGE)]
                floor[fresh] = np.partition(few, few.shape[1] - k, axis=1)[:, few.shape[1] - k] - 1.0
        # far faster than nonzero of two dimensions
        q, c = np.divmod(np.flatnonzero(near >= (floor + 1 - slack)[:, None].astype(near.dtype)), len(ids))
        if comparable:
            total = np.zeros(len(q))
            for j in range(v.shape[1]):
                total += v[q, j] * w[c, j]
            scale = norm[q] * other[c]
            distance = np.where(scale == 0, 1.0, 1 - total / np.where(scale == 0, 1.0, scale))
            score = np.where(np.isnan(distance), -np.inf, -distance)
        else:
            score = near[q, c] - 1.0
        if len(q):
            self.held.merge_all(mine, q, score, ids[c])

    def best(self):
        query, chunk, score = self.held.best()
        return query, chunk, np.where(np.isinf(score), np.nan, -score)
