"""Registered ingestion queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ingest as D
from ..sources.tables import load
from .registry import query


def _docs(spark, sf_dir):
    """Documents with a heading before every fifth line."""
    docs = load(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 3, F.concat(F.lit("PLAN OF CARE:\n"), x)).otherwise(x))
    return docs.select("doc_id", F.array_join(lines, "\n").alias("text"))


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"
_SECTIONS = f"(SELECT doc_id, CASE WHEN part = 0 THEN 'Preamble' ELSE 'Plan of Care' END AS section, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS body FROM (SELECT *, (i + 2) // 5 AS part FROM {_LINES}) GROUP BY doc_id, part)"


@query(f"SELECT doc_id, section, count(*)::BIGINT AS n, sum(length(body))::BIGINT AS n_chars FROM {_SECTIONS} WHERE body <> '' GROUP BY ALL")
def split_sections(spark, sf_dir):
    return D.split_sections(_docs(spark, sf_dir)).groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("n_chars"))


@query()
def chunk_documents(spark, sf_dir):
    return D.chunk_documents(_docs(spark, sf_dir)).select("doc_id", "chunk_index", "section", F.md5("text").alias("text_md5"))


@query("SELECT count(*)::BIGINT AS n_documents, count(CASE WHEN doc_id % 11 > 0 THEN 1 END)::BIGINT AS n_chunked, count(CASE WHEN doc_id % 11 = 0 THEN 1 END)::BIGINT AS n_empty, true AS covers FROM documents")
def ingest_report(spark, sf_dir):
    """One document of eleven is blank."""
    docs = _docs(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 11 == 0, " \n ").otherwise(F.col("text")))
    return D.ingest_report(docs, D.chunk_documents(docs)).select("n_documents", "n_chunked", "n_empty", (F.col("n_chunks") >= F.col("n_chunked")).alias("covers"))


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_documents, 0::BIGINT AS n_twice FROM documents")
def ingest_twice_is_once(spark, sf_dir):
    """Whole texts; n counts the documents whose chunks, (chunk_index, md5(text)), are the same after both runs."""
    docs = _docs(spark, sf_dir)
    once = D.ingest(docs, D.chunk_documents(docs.limit(0)))
    twice = D.ingest(docs, once, missing_only=False)
    return D.compare_runs(docs, once, twice).agg(F.count_if("same").alias("n"), F.count_if(F.col("n_chunks") > 0).alias("n_documents"), F.coalesce(F.sum("n_twice"), F.lit(0)).alias("n_twice"))


@query("SELECT source, count(CASE WHEN doc_id % 3 <> 0 THEN 1 END)::BIGINT AS n_missing, count(CASE WHEN doc_id % 3 = 0 THEN 1 END)::BIGINT AS n_there FROM documents GROUP BY 1")
def only_missing(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    chunks = docs.where("doc_id % 3 = 0").select("doc_id")
    missing, there = D.only_missing(docs, chunks), D.already_ingested(docs, chunks)
    rows = missing.select("source", F.lit(1).alias("m"), F.lit(0).alias("t")).union(there.select("source", F.lit(0), F.lit(1)))
    return rows.groupBy("source").agg(F.sum("m").alias("n_missing"), F.sum("t").alias("n_there"))


@query("SELECT doc_id, concat_ws(' — ', CASE doc_id % 3 WHEN 0 THEN 'Note ' || doc_id WHEN 1 THEN 'Note of 2024-01-05' END, CASE WHEN doc_id % 3 <> 1 AND doc_id % 2 = 1 THEN '2024-01-05' END, source) || chr(10) || text AS embedding_input FROM documents")
def contextualise(spark, sf_dir):
    """Each text is a chunk; a third of the titles has the date, a third is missing."""
    docs = load(spark, sf_dir, "documents")
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Note "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, "Note of 2024-01-05")
    held = docs.select("doc_id", title.alias("title"), F.when(F.col("doc_id") % 2 == 1, F.lit("2024-01-05")).alias("day"), F.lit(1).alias("version"), F.lit("final").alias("status"))
    return D.contextualise(docs.select("doc_id", F.col("source").alias("section"), "text"), held).select("doc_id", "embedding_input")


@query()
def contextualise_whole(spark, sf_dir):
    """Whole chunks of whole texts; a fold, so no SQL."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Note "), F.col("doc_id").cast("string")).alias("title"), F.when(F.col("doc_id") % 2 == 1, F.lit("2024-01-05")).alias("day"), F.lit(1).alias("version"), F.lit("final").alias("status"))
    return D.contextualise(D.chunk_documents(_docs(spark, sf_dir)), docs).select("doc_id", "chunk_index", "embedding_input")


_W = "(SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)"


@query(f"""WITH c AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 6))::BIGINT % 16 AS b, sum(CASE WHEN substr(md5(w), 7, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0 END) AS s FROM {_W} GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(s * s)) AS l FROM c GROUP BY 1)
SELECT c.doc_id, c.b::INTEGER AS bucket, round(s / l, 6) AS value FROM c JOIN n USING (doc_id) WHERE s <> 0""")
def embed_hashing(spark, sf_dir):
    docs = D.embed_hashing(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 16)
    return docs.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).where("value <> 0").withColumn("value", F.round("value", 6))


@query("SELECT count(CASE WHEN len(embedding) <> 64 THEN 1 END)::BIGINT AS n_wrong, count(CASE WHEN len(embedding) <> 32 THEN 1 END)::BIGINT AS n_not_32 FROM embeddings")
def check_dimension(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings")
    count = lambda d, name: D.check_dimension(rows, d).agg(F.count("*").alias(name))
    return count(64, "n_wrong").join(count(32, "n_not_32"))


@query("SELECT count(*)::BIGINT AS n_chunks, count(CASE WHEN vec_id % 4 > 0 THEN 1 END)::BIGINT AS n_embedded, count(DISTINCT label)::BIGINT AS n_documents, count(*) / count(DISTINCT label) AS mean_chunks FROM embeddings")
def chunk_stats(spark, sf_dir):
    return D.chunk_statistics(load(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.when(F.col("vec_id") % 4 > 0, F.col("embedding")).alias("embedding")))


@query("""SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, chr(10))) AS digest FROM
(SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents WHERE NOT contains(text, chr(1)))""")
def sentence_splits(spark, sf_dir):
    """Sentences of whole documents."""
    held = load(spark, sf_dir, "documents").where(~F.contains("text", F.lit("\x01"))).select("doc_id", X.sentences(F.col("text")).alias("s"))
    return held.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("digest"))
