"""Hybrid retrieval for a table of queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..sources.scratch import written
from . import blocks

# What a passage's section adds to its score, and the other weights of the second ranking.
SECTION_PRIOR = {"Assessment": 0.10, "Plan": 0.10, "Impression": 0.10, "Medications": 0.05, "Chief Complaint": 0.03}
OVERLAP_WEIGHT, RECENCY_WEIGHT, AGREEMENT = 0.25, 0.08, 0.05
FLOOR, FUSION_K = 0.55, 60
#: BM25's usual parameters.
K1, B = 1.2, 0.75


def with_documents(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with what a citation names of their document (doc_id, title, chunk_date); chunks of no document go."""
    return chunks.join(docs.select("doc_id", "title", "chunk_date"), "doc_id")


def chunk_filters(chunks: DataFrame, encounter_id=None, sections: Sequence[str] | None = None, since=None, until=None) -> DataFrame:
    """F8: chunks by their metadata, before anything is ranked."""
    if encounter_id is not None:
        chunks = chunks.where(F.col("encounter_id") == encounter_id)
    if sections:
        chunks = chunks.where(F.col("section").isin(list(sections)))
    if since is not None:
        chunks = chunks.where(F.col("chunk_date") >= F.lit(since))
    if until is not None:
        chunks = chunks.where(F.col("chunk_date") <= F.lit(until))
    return chunks


def ranked(hits: DataFrame, order: Sequence[Column], k: int | None = None) -> DataFrame:
    """The position of each hit of its query; with k, the first ones."""
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


#: Documents that queries are confined to: (query_id, doc_id, each once), or groups of documents, (query_id, group, a query once) and (group, doc_id, each once).
Within = DataFrame | tuple[DataFrame, DataFrame]


def vector_search(queries: DataFrame, chunks: DataFrame, k: int = 20, within: Within | None = None) -> DataFrame:
    """Q3: the nearest chunks of each query (query_id, scope, embedding) within its scope and, if given, its documents.

    Blocks of queries meet blocks of chunks inside tasks; of equal vectors of a scope only the k smallest ids do, as no others can be
    among the first.
    """
    vector = F.col("embedding").cast("array<float>" if chunks.schema["embedding"].dataType.elementType.typeName() == "float" else "array<double>").alias("vector")
    left, right = _confined(queries.select("query_id", "scope", vector), chunks.select("chunk_id", "scope", vector, *_doc(within)), within)
    copies = F.row_number().over(Window.partitionBy("scope", "vector").orderBy("chunk_id"))
    right = right.withColumn("copy", copies).where(F.col("copy") <= k).drop("copy")
    pairs = blocks.paired(left, right, blocks.VECTOR_BLOCK, blocks.CHUNK_BLOCK, blocks.TILE)
    near = _own_scope(blocks.folded(pairs, blocks.Nearest, k, *_kinds(left, right), blocks.VECTOR_TILE), queries, within).withColumnRenamed("score", "distance")
    return ranked(near, [F.asc_nulls_last("distance"), F.asc("chunk_id")], k).withColumn("retriever", F.lit("vector"))


def _doc(within: Within | None) -> list[str]:
    return [] if within is None else ["doc_id"]


def _confined(left: DataFrame, right: DataFrame, within: Within | None) -> tuple[DataFrame, DataFrame]:
    """Queries and chunks with scope and group of documents in the place of the scope, so that a query meets its documents' chunks alone.

    Queries that name one group share its chunks; with documents listed by query, each query is a group of its own.
    """
    if within is None:
        return left, right
    named, held = within if isinstance(within, tuple) else (within.select("query_id", F.col("query_id").alias("group")).distinct(), within.select(F.col("query_id").alias("group"), "doc_id"))
    both = lambda df: df.where("scope is not null").withColumn("scope", F.to_json(F.struct("scope", "group")))
    return both(left.join(named, "query_id")).select(left.columns), both(right.join(held, "doc_id")).select([c for c in right.columns if c != "doc_id"])


def _own_scope(hits: DataFrame, queries: DataFrame, within: Within | None) -> DataFrame:
    """Hits of confined queries with the scope that the query has."""
    return hits if within is None else hits.drop("scope").join(queries.select("query_id", "scope"), "query_id")


def _kinds(queries: DataFrame, chunks: DataFrame) -> tuple[str, str, str]:
    return tuple(df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (chunks, "chunk_id"), (queries, "scope")))


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int = 20, within: Within | None = None, scorer: str = "count") -> DataFrame:
    """Q4: the chunks of each query's scope and, if given, its documents that fit its terms best.

    scorer "count": an occurrence of a term counts one; "bm25": BM25 with K1 and B over the scope's chunks. Only tokens that some
    query of the scope asks for are counted.
    """
    order = F.desc("hits") if scorer == "count" else F.desc(F.round("hits", 9))
    hits = _keyword_blocks(queries, chunks, k, scorer, within)
    return ranked(hits, [order, F.asc("chunk_id")], k).select("query_id", "scope", "chunk_id", F.lit(1.0).alias("distance"), "rank", F.lit("keyword").alias("retriever"), "hits")


def _rare() -> Column:
    return F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _keyword_blocks(queries: DataFrame, chunks: DataFrame, k: int, scorer: str, within: Within | None) -> DataFrame:
    """Terms are compared as 64-bit numbers; BM25 weighs by the whole scope, whatever documents a query is confined to."""
    bm25 = scorer == "bm25"
    left = queries.select("query_id", "scope", F.array_join(X.keyword_terms(F.col("query")), " ").alias("text"))
    # chunks of the scopes that are asked, before anything is made of their texts
    right = chunks.join(F.broadcast(queries.select("scope").distinct()), "scope", "left_semi").select("chunk_id", "scope", *_doc(within), F.lower("text").alias("text"))
    kinds = _kinds(left, right)
    if bm25:
        counts = written(blocks.frequencies(right, kinds[2]), "frequencies")
        often = counts.where("term is not null").select("scope", "term", F.col("n").alias("df"))
        whole = right.groupBy("scope").agg(F.count("*").alias("n_chunks")).join(counts.where("term is null").select("scope", F.try_divide("n_words", "n").alias("mean")), "scope")
        weighed = blocks.terms_of(left, "query_id", kinds[0], kinds[2]).join(often, ["scope", "term"]).join(F.broadcast(whole), "scope")
        asked = weighed.groupBy("query_id", "scope", "mean").agg(F.collect_list(F.struct("term", _rare().alias("weight"))).alias("list"))
        left = asked.select("query_id", "scope", F.lit(None).cast("string").alias("text"), F.col("list.term").alias("terms"), F.col("list.weight").alias("weights"), "mean")
        right = right.withColumns({"terms": F.lit(None).cast("array<bigint>"), "weights": F.lit(None).cast("array<double>"), "mean": F.lit(None).cast("double")})
    own = (K1, B) if bm25 else None
    left, right = _confined(left, right, within)
    hits = blocks.folded(blocks.paired(left, right, blocks.QUERY_BLOCK, blocks.CHUNK_BLOCK, blocks.TEXT_TILE), lambda t, k: blocks.Counted(t, k, own), k, *_kinds(left, right), blocks.TEXT_TILE)
    hits = _own_scope(hits, queries, within).withColumnRenamed("score", "hits")
    return hits if bm25 else hits.withColumn("hits", F.col("hits").cast("long"))


def rrf(lists: Sequence[DataFrame], k: int = FUSION_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, chunk_id, distance, rank, retriever)."""
    names = ["query_id", "chunk_id", "distance", "rank", "retriever"]
    every = reduce(DataFrame.unionByName, [x.select(names) for x in lists])
    out = every.groupBy("query_id", "chunk_id").agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"), F.min("distance").alias("distance"), F.array_sort(F.collect_set("retriever")).alias("retrievers"))
    out = out.withColumns({"similarity": V.similarity(F.col("distance")), "retriever": F.when(F.size("retrievers") > 1, "hybrid").otherwise(F.get("retrievers", F.lit(0)))})
    return ranked(out.drop("retrievers"), [F.desc(F.round("rrf", 12)), F.desc(F.round("similarity", 9)), F.asc("chunk_id")])


def dedup_passages(hits: DataFrame) -> DataFrame:
    """One hit for each passage of a query, the best; how often it stood there, and the other dates it has.

    Copies are counted by date first, so a group of copies comes to one task as its dates only. Hits that bring the digest of their
    passage need no text.
    """
    keyed = hits if "passage" in hits.columns else hits.withColumn("passage", F.md5(X.passage_key(F.col("text"))))
    hits = hits.drop("passage")
    by_date = keyed.groupBy("query_id", "passage", "chunk_date").agg(F.min_by(F.struct("rank", *[c for c in hits.columns if c not in ("query_id", "rank")]), "rank").alias("best"), F.count("*").alias("n"))
    dated = F.array_sort(F.collect_list(F.when(F.col("chunk_date").isNotNull(), F.struct(F.col("best.rank").alias("rank"), "chunk_date"))))
    whole = by_date.groupBy("query_id", "passage").agg(F.min_by("best", "best.rank").alias("kept"), F.sum("n").alias("occurrences"), F.transform(dated, lambda d: d["chunk_date"]).alias("dates"))
    others = F.filter("dates", lambda d: ~d.eqNullSafe(F.col("kept.chunk_date"))).alias("other_dates")
    return whole.select("query_id", *[F.col(f"kept.{c}").alias(c) for c in hits.columns if c not in ("query_id", "rank")], "occurrences", others)


def fuse_report(vector: DataFrame, keyword: DataFrame, fused: DataFrame, kept: DataFrame) -> DataFrame:
    """U4: for each query how many hits each retriever had, both had, were fused and were collapsed."""
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    both = vector.select("query_id", "chunk_id").intersect(keyword.select("query_id", "chunk_id"))
    out = count(fused, "n_fused")
    for part in (count(vector, "n_vector"), count(keyword, "n_keyword"), count(both, "n_both"), count(kept, "n_kept")):
        out = out.join(part, "query_id", "left")
    out = out.fillna(0, ["n_vector", "n_keyword", "n_both", "n_kept"])
    return out.withColumn("n_collapsed", F.col("n_fused") - F.col("n_kept"))


def similarity_floor(hits: DataFrame, least: float = FLOOR) -> DataFrame:
    """hits near enough; what the keyword retriever alone found passes."""
    return hits.where((F.col("retriever") == "keyword") | (F.col("similarity") >= least))


def rerank_none(hits: DataFrame, k: int) -> DataFrame:
    """Q5: the first k as they are."""
    return hits.where(F.col("rank") <= k)


def _asked_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", X.rerank_terms(F.col("query")).alias("terms"))


def _overlap(own: Column) -> Column:
    """The share of a query's terms that a hit has."""
    return F.when(F.size("terms") > 0, F.size(F.array_intersect("terms", own)) / F.size("terms")).otherwise(0.0)


def rerank_heuristic(hits: DataFrame, queries: DataFrame, today, k: int) -> DataFrame:
    """Q6: by similarity, shared terms, section, age (E9) and agreement. Hits that bring their overlap need no text."""
    if "overlap" not in hits.columns:
        hits = hits.join(_asked_terms(queries), "query_id").withColumn("overlap", _overlap(X.rerank_terms(F.col("text")))).drop("terms")
    prior = F.lit(0.0)
    for name, value in SECTION_PRIOR.items():
        prior = F.when(F.col("section") == name, value).otherwise(prior)
    age = F.datediff(F.lit(today), "chunk_date")
    recency = F.coalesce(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0), age - 365) / 730) * RECENCY_WEIGHT, F.lit(0.0))
    score = F.col("similarity") + OVERLAP_WEIGHT * F.col("overlap") + prior + recency + F.when(F.col("retriever") == "hybrid", AGREEMENT).otherwise(0.0)
    scored = hits.withColumn("score", score).drop("overlap", "rank")
    return ranked(scored, [F.desc(F.round("score", 9)), F.asc("chunk_id")], k)


def rerank_external(hits: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Q7: by scores from elsewhere (query_id, chunk_id, relevance), by similarity where there is none."""
    joined = hits.drop("rank").join(scores, ["query_id", "chunk_id"], "left").withColumn("score", F.coalesce("relevance", "similarity"))
    return ranked(joined.drop("relevance"), [F.desc("score"), F.asc("chunk_id")], k)


def pack_context(hits: DataFrame, budget: int = 3000) -> DataFrame:
    """Hits in rank order until the first that would go over the budget; the first is always kept."""
    numbered = hits.withColumn("block", X.source_block(F.col("rank"), F.col("title"), F.col("section"), F.col("chunk_date").cast("string"), F.col("text")))
    cost = X.token_estimate(F.col("block"))
    spent = F.sum("cost").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("cost", cost).withColumn("spent", spent).where((F.col("spent") <= budget) | (F.col("rank") == 1))


def retrieve(queries: DataFrame, chunks: DataFrame, today, vector_k: int = 20, keyword_k: int = 20, k: int = 5, budget: int = 3000, within: Within | None = None, scorer: str = "count") -> DataFrame:
    """Queries (query_id, scope, query, embedding) against chunks (scope, chunk_id, text, section, title, chunk_date, embedding).

    F8: with documents given, only their chunks are candidates of a query; chunks then have a doc_id.
    What is ranked has no texts: a chunk's digest and terms are made once, and the texts come to the k best alone.
    """
    queries = queries.withColumn("query", X.normal_query(F.col("query")))
    fused = written(rrf([vector_search(queries, chunks, vector_k, within), keyword_search(queries, chunks, keyword_k, within, scorer)]), "fused")
    found = chunks.drop("embedding", "scope").join(fused.select("chunk_id").distinct(), "chunk_id", "left_semi")
    known = found.select(*[c for c in found.columns if c != "text"], F.md5(X.passage_key(F.col("text"))).alias("passage"), X.rerank_terms(F.col("text")).alias("own"))
    # the query's few terms go to the chunk, not the chunk's to the query
    hits = fused.join(_asked_terms(queries), "query_id").join(known, "chunk_id").withColumn("overlap", _overlap(F.col("own"))).drop("terms", "own")
    best = rerank_heuristic(similarity_floor(dedup_passages(hits)).withColumn("rank", F.lit(0)), queries, today, k)
    return pack_context(best.join(found.select("chunk_id", "text"), "chunk_id"), budget)


def retrieve_anchored(queries: DataFrame, chunks: DataFrame, anchors: DataFrame, today, k: int = 5, documents: DataFrame | None = None) -> DataFrame:
    """Hits in a query's anchored documents, which are chosen before anything is ranked; queries without any hit there get unanchored ones.

    anchors: (query_id, doc_id), or (query_id, group), a query once, with documents (group, doc_id): what many queries share is named once.
    """
    wanted = anchors.select("query_id", "doc_id").distinct() if documents is None else (anchors.select("query_id", "group"), documents.select("group", "doc_id").distinct())
    first = written(retrieve(queries, chunks, today, k=k, budget=1 << 30, within=wanted), "anchored")
    left = written(queries.join(first.select("query_id").distinct(), "query_id", "left_anti"), "unanchored")
    rest = retrieve(left, chunks, today, k=k, budget=1 << 30)
    return first.withColumn("anchored", F.lit(True)).unionByName(rest.withColumn("anchored", F.lit(False)))


def retrieval_status(queries: DataFrame, chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """For each query how many chunks its scope has, and whether it is empty, has no match or was answered."""
    indexed = chunks.groupBy("scope").agg(F.count("*").alias("n_indexed"))
    found = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    out = queries.select("query_id", "scope").join(indexed, "scope", "left").join(found, "query_id", "left").fillna(0, ["n_indexed", "n_hits"])
    return out.withColumn("status", F.when(F.col("n_indexed") == 0, "empty_index").when(F.col("n_hits") == 0, "no_match").otherwise("answered"))


def distinct_queries(df: DataFrame) -> DataFrame:
    """Each text once, with how many rows ask it."""
    return df.groupBy("text").agg(F.count("*").alias("n"))


def resolve_relevant(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk ids that a case's title prefix and sections name within its scope."""
    fits = F.startswith(F.col("title"), F.col("title_prefix")) & ((F.size("sections") == 0) | F.array_contains("sections", F.col("section")))
    return cases.join(chunks, "scope").where(fits).groupBy("case_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("relevant"))
