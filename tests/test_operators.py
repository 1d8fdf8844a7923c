"""Hand-built cases of the record, retrieval, ingestion, graph, metric, corpus, rule and operation jobs."""

import itertools
import math
import random
import re
from collections import Counter
from datetime import date, datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import vectors as V
from quarry.operators import blocks, conversations, corpus, graph, ingest, metrics, operations, records, retrieval, rules
from quarry.plans import ingest as ingest_plans
from quarry.plans import metrics as metric_plans
from quarry.plans import retrieval as plans
from quarry.sources import tables
from quarry.streaming import jobs


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_scope_fails_closed(spark):
    df = spark.createDataFrame([(1, 1), (2, None)], "id long, scope long")
    assert rows(records.scoped(df, 1)) == [(1, 1)]
    assert rows(records.scoped(df, None)) == []


def test_bounded_is_clamped(spark):
    df = spark.range(300).withColumn("scope", F.lit(1))
    assert records.bounded(df, [F.asc("id")], 1000).count() == 200
    assert records.bounded(df, [F.asc("id")], -3).count() == 1


def test_in_effect_ends_count(spark):
    courses = spark.createDataFrame([(1, "a", date(2020, 1, 1), date(2020, 1, 5)), (1, "b", date(2020, 1, 6), None)], "scope long, name string, start_date date, end_date date")
    dates = spark.createDataFrame([(1, date(2020, 1, 5)), (1, date(2020, 1, 6))], "scope long, on_date date")
    assert rows(records.in_effect(courses, dates).select("name", F.dayofmonth("on_date")), "name") == [("a", 5), ("b", 6)]


def test_diff_states(spark):
    schema = "scope long, name string, start_date date, dosage string"
    day = date(2020, 1, 1)
    before = spark.createDataFrame([(1, "Aspirin ", day, "1"), (1, "x", day, "1"), (1, "same", day, None)], schema)
    after = spark.createDataFrame([(1, "aspirin", day, "2"), (1, "y", day, "1"), (1, "same", day, None)], schema)
    assert rows(records.diff_states(before, after, ["dosage"]).select("key", "change"), "key") == [("aspirin", "changed"), ("x", "stopped"), ("y", "started")]


def test_compact_row_and_term(spark):
    df = spark.sql("select map('a', 1, 'b', cast(null as int)) m, 'Heart' d, 'k' k, array('Cor') al")
    assert df.select(records.compact_row("m")).first()[0] == {"a": 1}
    assert df.select(records.term_matches(F.col("d"), F.col("k"), F.col("al"), F.lit("cO"))).first()[0]


def test_replace_twice_is_once(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d")], "k long, v string")
    once = tables.replace_by_key(target, new, "k")
    assert rows(tables.replace_by_key(once, new, "k"), "k", "v") == rows(once, "k", "v") == [(1, "a"), (2, "c"), (2, "d")]


def test_sources_round_trip(spark, tmp_path):
    chat = spark.createDataFrame([([("user", "hi")], "t", "x", "train")], "messages array<struct<role:string,content:string>>, task string, template_id string, split string")
    tables.write_split(chat, f"{tmp_path}/split")
    assert tables.read_corpus(spark, f"{tmp_path}/split/split=train").count() == 1
    (tmp_path / "cases.json").write_text('{"cases": [{"id": "a", "relevant": {"title_prefix": "T", "sections": []}}]}')
    assert tables.read_cases(spark, str(tmp_path / "cases.json")).first()["relevant"]["title_prefix"] == "T"
    tables.append_audit(chat.select("task"), f"{tmp_path}/audit")
    tables.append_audit(chat.select("task"), f"{tmp_path}/audit")
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 2


def test_text_functions(spark):
    df = spark.createDataFrame([("Hi, please show me  X",), ("hello ",), ("ASSESSMENT AND PLAN:",), ("A SENTENCE HERE.",), ("plan",)], "t string")
    got = rows(df.select(X.normal_query(F.col("t")), X.heading(F.col("t"))))
    assert got[0][0] == "show me X" and got[1][0] == "hello"
    assert [g[1] for g in got[2:]] == ["Assessment and Plan", None, "Plan"]
    assert df.select(X.keyword_terms(F.lit("What is the A1 dose dose"))).first()[0] == ["a1", "dose"]


def test_cosine_rules(spark):
    df = spark.sql("select array(1f, 0f) a, array(0f, 0f) z, array(1f) s, cast(null as array<float>) n")
    c = lambda x, y: V.cosine_distance(F.col(x), F.col(y))
    assert tuple(df.select(c("a", "a"), c("a", "z"), c("a", "s"), c("a", "n")).first()) == (0.0, 1.0, 1.0, None)


def test_fusion_does_not_depend_on_list_order(spark):
    schema = "query_id long, chunk_id long, distance double, rank int, retriever string"
    a = spark.createDataFrame([(1, 10, 0.1, 1, "vector"), (1, 11, 0.2, 2, "vector")], schema)
    b = spark.createDataFrame([(1, 11, 1.0, 1, "keyword"), (1, 12, 1.0, 2, "keyword")], schema)
    one, two = (rows(retrieval.rrf(x).select("chunk_id", "rank", "retriever"), "rank") for x in ([a, b], [b, a]))
    assert one == two == [(11, 1, "hybrid"), (10, 2, "vector"), (12, 3, "keyword")]


def test_dedup_dates(spark):
    d = [date(2020, 1, k) for k in (1, 2, 3)]
    hits = spark.createDataFrame([(1, 1, "A  b", d[0], 1), (1, 2, "a b", d[1], 2), (1, 3, "a B", d[0], 3), (1, 4, "a b", None, 4), (1, 5, "c", d[2], 5)], "query_id long, chunk_id long, text string, chunk_date date, rank int")
    assert rows(retrieval.dedup_passages(hits).select("chunk_id", "occurrences", "other_dates"), "chunk_id") == [(1, 4, [d[1]]), (5, 1, [])]


def test_context_keeps_the_first_and_does_not_skip(spark):
    hits = spark.createDataFrame([(1, k, "x" * n, "s", "t", date(2020, 1, 1)) for k, n in ((1, 4000), (2, 40), (3, 4))], "query_id long, rank int, text string, section string, title string, chunk_date date")
    assert rows(retrieval.pack_context(hits, 100).select("rank")) == [(1,)]
    assert rows(retrieval.pack_context(hits.where("rank > 1"), 40).select("rank"), "rank") == [(2,), (3,)]


def test_anchors_come_before_the_candidate_limit(spark):
    """Three anchored passages behind 250 better ones; one of them has its twin in another document."""
    day, axis = date(2024, 1, 1), [1.0, 0.0]
    chunks = [(1, k, 1, f"dose dose dose dose {k}", "Plan", "note_1", day, axis) for k in range(250)]
    chunks += [(1, 900 + k, 2, text, "Plan", "note_2", day, [0.8 - k / 100, 0.6]) for k, text in enumerate(("dose of the anchor", "dose other", "dose dose dose dose 7"))]
    chunks += [(1, 950, 3, "dose elsewhere", "Plan", "note_3", day, [0.9, 0.1]), (2, 960, 2, "dose of another scope", "Plan", "note_2", day, axis)]
    chunks = spark.createDataFrame(chunks, "scope long, chunk_id long, doc_id long, text string, section string, title string, chunk_date date, embedding array<double>")
    asked = spark.createDataFrame([(q, 1, "dose", axis) for q in (1, 2, 3)], "query_id long, scope long, query string, embedding array<double>")
    anchors = spark.createDataFrame([(1, 2), (1, 2), (2, 77)], "query_id long, doc_id long")
    got = rows(retrieval.retrieve_anchored(asked, chunks, anchors, date(2024, 6, 1)).select("query_id", "rank", "chunk_id", "anchored"), "query_id", "rank")
    alone = lambda df: [r[0] for r in rows(retrieval.retrieve(asked.where("query_id = 1"), df, date(2024, 6, 1), budget=1 << 30).select("chunk_id", "rank"), "rank")]
    inside, every = alone(chunks.where("doc_id = 2")), alone(chunks)
    assert sorted(inside) == [900, 901, 902] and len(every) == 5
    assert got == [(q, i + 1, c, q == 1) for q, ids in ((1, inside), (2, every), (3, every)) for i, c in enumerate(ids)]


@pytest.mark.parametrize("scorer", ["count", "bm25"])
def test_groups_of_documents_confine_as_lists_do(spark, scorer):
    """Queries that share a group of documents, and the same documents listed for each query: the hits of a scan; BM25 still weighs by the whole scope."""
    rng = random.Random(11)
    made = [(i % 2, i, i % 9, " ".join(rng.choice(["dose", "pain", "visit", "zeta"]) for _ in range(rng.randint(1, 6))), [rng.random(), rng.random()]) for i in range(200)]
    chunks = spark.createDataFrame(made, "scope long, chunk_id long, doc_id long, text string, embedding array<double>")
    asked = [(q, q % 2, rng.choice(["dose", "pain visit", "zeta dose"]), [rng.random(), 0.5]) for q in range(12)]
    queries = spark.createDataFrame(asked, "query_id long, scope long, query string, embedding array<double>")
    held = {"a": [0, 1, 2, 77], "b": [4, 5]}
    group = {q: "ab"[q % 3 // 2] for q, *_ in asked if q < 10}
    named = spark.createDataFrame(list(group.items()), "query_id long, group string"), spark.createDataFrame([(g, d) for g, ds in held.items() for d in ds], "group string, doc_id long")
    listed = spark.createDataFrame([(q, d) for q, g in group.items() for d in held[g]], "query_id long, doc_id long")
    for search in (lambda w: retrieval.vector_search(queries, chunks, 7, w), lambda w: retrieval.keyword_search(queries, chunks, 7, w, scorer)):
        own = rows(search(named).select("query_id", "rank", "chunk_id", "scope"), "query_id", "rank")
        assert own == rows(search(listed).select("query_id", "rank", "chunk_id", "scope"), "query_id", "rank")
        # the first of all hits that lie in the query's documents
        score = "distance" if "hits" not in search(named).columns else "hits"
        every = retrieval.vector_search(queries, chunks, 200) if score == "distance" else retrieval.keyword_search(queries, chunks, 200, None, scorer)
        kept, want = {}, []
        for q, _, c, s in rows(every.select("query_id", "rank", "chunk_id", "scope"), "query_id", "rank"):
            if q in group and c % 9 in held[group[q]] and kept.setdefault(q, 0) < 7:
                kept[q] += 1
                want.append((q, kept[q], c, s))
        assert own == want


def test_questions_and_passages_are_whole(spark, tmp_path):
    ask = " " * 70 + "zebra"
    spark.createDataFrame([(4, 0, "system", "be brief"), (4, 1, "user", ask), (4, 2, "user", "later"), (8, 0, "assistant", "hm")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(0, "src0", "\n".join(["a", "", "zebra"] + ["b"] * 10000)), (1, "src0", "zebra zebra"), (2, "src0", "")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(plans.first_questions(spark, str(tmp_path)).select("query_id", "query")) == [(4, "Hello, please " + ask)]
    lines = plans.lines(spark, str(tmp_path))
    assert lines.count() == lines.select("chunk_id").distinct().count() == 10003
    assert rows(plans.keyword_topk(spark, str(tmp_path)).select("chunk_id", "hits"), "chunk_id") == [(2, 1), (plans.AT, 2)]
    assert {r["chunk_id"] for r in plans.hybrid_retrieve(spark, str(tmp_path)).collect()} >= {2, plans.AT}


def chunked_by_copying(body, most, overlap, least):
    """The rules of D2 on copies of the text, unit after unit."""
    import re

    units = []
    for p in re.split(r"\n\s*\n", body):
        units += [x.rstrip() for x in ([p] if len(p) <= most else re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", p)) if x.strip()]
    out, held, fresh = [], "", False
    for unit in units:
        longer = held + "\n\n" + unit if held else unit
        if held and len(longer) > most:
            if fresh:
                out.append(held.strip())
            longer = (held[max(0, len(held) - overlap) :] + "\n\n" + unit).lstrip()
        while len(longer) > most:
            at = longer[:most].rfind(" ")
            at = at if at > most // 2 else most
            out.append(longer[:at].strip())
            longer = longer[max(at - overlap, 1) :].lstrip()
        held, fresh = longer, True
    out += [held.strip()] if held.strip() else []
    return [*out[:-2], out[-2] + "\n\n" + out[-1]] if len(out) > 1 and len(out[-1]) < least else out


@pytest.mark.parametrize("most, overlap, least", [(60, 15, 8), (60, 0, 8), (100, 30, 20), (37, 10, 5)])
def test_chunks_equal_the_rules_on_copies(most, overlap, least):
    import random

    rng = random.Random(most + overlap)
    for _ in range(400):
        body = "".join(rng.choice(["Word ", "ab", "Long" * 9, ". Next ", "! 5 ", "\n", "\n\n", "\n \n", " ", "x. y"]) for _ in range(rng.randint(0, 60))).strip()
        assert ingest.packed(body, most, overlap, least) == chunked_by_copying(body, most, overlap, least), body


def test_long_line_is_chunked_in_linear_time():
    import time

    began = time.time()
    assert len(ingest.packed("word " * 1_000_000)) > 4000 and len(ingest.packed("x" * 2_000_000)) > 1900
    assert time.time() - began < 20


def test_containment_finds_parts_of_words(spark):
    texts = spark.createDataFrame([(1, "Call Joann Leeson today"), (2, "ÜBER alles"), (3, None), (4, "")], "text_id long, text string")
    terms = spark.createDataFrame([(7, "ann lee"), (8, "über"), (9, "o"), (10, ""), (11, None), (12, "ANN LEE")], "term_id long, term string")
    want = [(1, 7), (1, 9), (1, 12), (2, 8)]
    assert rows(corpus.contains_join(texts, terms), "text_id", "term_id") == want
    assert corpus.contains_join(texts, terms.limit(0)).count() == 0


def test_first_object():
    assert corpus.first_object('Here { it is: {"a": {"b": 1}} done') == '{"a": {"b": 1}}'
    assert corpus.first_object('{"a":' * 100_000) is None and corpus.first_object("{" * 200_000) is None
    assert corpus.first_object(None) is None and corpus.first_object("none {") is None


def test_embedding_header_keeps_the_date(spark):
    df = spark.sql("select * from values ('Plan of 2024-01-05', '2024-01-05', 'S'), (null, '2024-01-05', 'S'), ('', '2024-01-05', null), (null, null, null) as t(title, day, section)")
    got = [r[0] for r in df.select(X.embedding_input(F.col("title"), F.col("day"), F.col("section"), F.lit("x"))).collect()]
    assert got == ["Plan of 2024-01-05 — S\nx", "2024-01-05 — S\nx", "2024-01-05\nx", "x"]


def test_pipe_table(spark):
    df = spark.sql("select * from values (1, 7.100bd, timestamp'2024-01-05 10:20:30', date'2024-01-05', cast(null as string)), (2, 40.000bd, null, null, 'a') as t(id, d, t, day, s)")
    assert records.pipe_table(df, [F.asc("id")], 1).first()[0] == "id | d | t | day | s\n1 | 7.1 | 2024-01-05 10:20 | 2024-01-05 | NULL\n... 1 more row(s)"
    assert records.pipe_table(df.where("id = 2"), [F.asc("id")]).first()[0].endswith("\n2 | 40 | NULL | NULL | a")
    assert records.pipe_table(df.limit(0), [F.asc("id")]).first()[0] == "(no rows)"


def test_budget_equals_one_fold(spark):
    """Over all requests in order: the budget is asked first, and what is refused uses up nothing."""
    import random

    rng = random.Random(3)
    asked = sorted((rng.uniform(0, 3 * 86400), i, rng.choice([1, 1, 1, 2, 3, 4, 5])) for i in range(1500))
    # many around midnight, where closed days meet the windows of the next
    asked = sorted(asked + [(86400 + rng.uniform(-600, 600), 2000 + i, rng.choice([1, 2, 3])) for i in range(200)])
    own, today, day, want = {}, 0, -1, {}
    for t, i, c in asked:
        if int(t // 86400) != day:
            day, today = int(t // 86400), 0
        if today >= 150:
            want[i] = "budget"
            continue
        want[i] = own.setdefault(c, operations.Limiter(2, 40, 300)).admit(t)[0]
        today += want[i] == "accepted"
    df = spark.createDataFrame([(c, i, t) for t, i, c in asked], "client long, request_id long, second double").repartition(3)
    got = {r["request_id"]: r["decision"] for r in operations.admit_within_budget(df, 2, 40, 150, 300).collect()}
    assert got == want and set(want.values()) == {"accepted", "window_limit", "daily_limit", "budget"}


def test_bm25_and_citations(spark):
    chunks = spark.createDataFrame([(1, 10, "dose dose dose"), (1, 11, "rare dose"), (1, 12, "other words here"), (2, 13, "rare")], "scope long, chunk_id long, text string")
    asked = spark.createDataFrame([(5, 1, "rare dose")], "query_id long, scope long, query string")
    assert [r[0] for r in rows(retrieval.keyword_search(asked, chunks).select("chunk_id", "rank"), "rank")] == [10, 11]
    assert [r[0] for r in rows(retrieval.keyword_search(asked, chunks, scorer="bm25").select("chunk_id", "rank"), "rank")] == [11, 10]
    docs = spark.createDataFrame([(1, "T", date(2024, 1, 1))], "doc_id long, title string, chunk_date date")
    assert rows(retrieval.with_documents(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), docs)) == [(1, "a", "T", date(2024, 1, 1))]
    visits = spark.createDataFrame([(9, date(2024, 2, 2))], "id long, encounter_date date")
    assert rows(ingest.with_encounter_day(spark.createDataFrame([(1, 9), (2, None)], "doc_id long, encounter_id long"), visits).select("doc_id", "day"), "doc_id") == [(1, date(2024, 2, 2)), (2, None)]


def test_percentiles_equal_nearest_rank(spark):
    import math
    import random

    rng = random.Random(2)
    data = [("a", rng.choice([1.0, 5.5, rng.random() * 1e6])) for _ in range(500)] + [("b", 3.0), ("c", None), (None, 2.0), (None, 9.0)]
    got = {r["g"]: tuple(r)[1:] for r in metrics.latency_summary(spark.createDataFrame(data, "g string, v double"), "v", ["g"]).collect()}
    for g in ("a", "b", "c", None):
        own = sorted(v for k, v in data if k == g and v is not None)
        at = lambda p, own=own: own[max(1, math.ceil(len(own) * p)) - 1] if own else None
        assert got[g][1:] == (at(0.5), at(0.95), own[-1] if own else None)


def test_stream_ingest_replaces_a_document(spark, tmp_path):
    write = jobs.ingest_batches(f"{tmp_path}/target")
    docs = lambda *r: spark.createDataFrame(r, "doc_id long, text string")
    write(docs((1, "one."), (2, "two."), (3, "three.")), 0)
    write(docs((2, "TWO again."), (3, "")), 1)
    write(docs((2, "TWO again."), (3, "")), 1)
    assert rows(jobs.current_chunks(spark, f"{tmp_path}/target").select("doc_id", "text"), "doc_id") == [(1, "one."), (2, "TWO again.")]


def test_streams_classify_check_and_forget(spark, tmp_path):
    """Classification and checks as streams, and a client idle for two days whose state is gone."""
    folder = f"{tmp_path}/in"
    requests = lambda *r: spark.createDataFrame(r, "client long, request_id long, second double").selectExpr("client", "request_id", "timestamp_seconds(second) AS ts")
    requests((1, 1, 1000.0), (1, 2, 1010.0)).write.parquet(f"{folder}/0", mode="overwrite")
    source = spark.readStream.schema("client long, request_id long, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
    run = lambda df, name: df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}.log").trigger(availableNow=True).start(f"{tmp_path}/{name}")
    run(jobs.admit_stream(source, 1, 9, 60), "first").awaitTermination(120)
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/first").select("decision").collect()) == ["accepted", "window_limit"]
    later = 1000.0 + 4 * 86400
    for k, row in enumerate([(2, 3, later), (2, 4, later + 100), (2, 5, later + 200)], 1):
        requests(row).write.parquet(f"{folder}/{k}")
        query = run(jobs.admit_stream(source, 1, 9, 60), "first")
        query.awaitTermination(120)
    # what two days of silence leave: the state of one client
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    alone = run(jobs.admit_stream(spark.readStream.schema("client long, request_id long, ts timestamp").parquet(f"{folder}/3"), 1, 9, 60), "alone")
    alone.awaitTermination(120)
    assert left == alone.lastProgress["stateOperators"][0]["numRowsTotal"]
    spark.createDataFrame([(1, "when is my next appointment?")], "id long, text string").write.parquet(f"{tmp_path}/talk")
    said = spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/talk")
    run(jobs.classified_stream(said), "routes").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/routes").select("route").collect() == rules.classify_routes(spark.read.parquet(f"{tmp_path}/talk")).select("route").collect()


def test_chunking_cases():
    assert ingest.packed("a. " * 600)[0].startswith("a.")
    long = "word " * 600
    out = ingest.packed(long, 1200, 150, 80)
    assert all(len(c) <= 1200 + 82 for c in out) and out[0] in long
    assert ingest.packed("A" * 3000, 1200, 0, 80) == ["A" * 1200, "A" * 1200, "A" * 600]
    folded = ingest.packed("Aaa bbb. " * 15 + "\n\n" + "Cc.", 130, 0, 80)
    assert folded[-1].endswith("Cc.") and len(folded[-1]) > 80
    assert ingest.packed("") == []


def test_sections_and_index(spark):
    docs = spark.createDataFrame([(1, "start\nPLAN:\nrest\nPlan is to rest.\nassessment\nfine"), (2, ""), (3, None)], "doc_id long, text string")
    got = rows(ingest.chunk_documents(docs).select("doc_id", "chunk_index", "section", "text"), "doc_id", "chunk_index")
    assert got == [(1, 0, "Preamble", "start"), (1, 1, "Plan", "rest\nPlan is to rest."), (1, 2, "Assessment", "fine")]
    report = ingest.ingest_report(docs, ingest.chunk_documents(docs)).first()
    assert tuple(report) == (3, 1, 2, 3)


def test_ingest_only_missing(spark):
    docs = spark.createDataFrame([(1, "new"), (2, "two")], "doc_id long, text string")
    held = spark.createDataFrame([(1, 0, "Preamble", "old")], "doc_id long, chunk_index int, section string, text string")
    assert rows(ingest.ingest(docs, held, missing_only=True).select("doc_id", "text"), "doc_id") == [(1, "old"), (2, "two")]
    assert rows(ingest.ingest(docs, held, ids=[1]).select("doc_id", "text"), "doc_id") == [(1, "new")]


def test_ingest_and_context_of_whole_texts(spark, tmp_path):
    """Bodies over 1,200 characters and several sections, as chunks by ``packed``."""
    texts = {1: "\n".join(f"Line {i} of one. " + "word " * 90 for i in range(9)), 2: "short", 3: "a\nb\nc\nd\ne"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, text in texts.items():
        lines = text.split("\n")
        parts = [("Preamble", lines[:3])] + [("Plan of Care", lines[i : i + 5]) for i in range(3, len(lines), 5)]
        cut = [(name, c) for name, body in parts for c in ingest.packed("\n".join(body).strip())]
        want += [(k, i, " — ".join([f"Note {k}"] + ["2024-01-05"] * (k % 2) + [name]) + "\n" + c) for i, (name, c) in enumerate(cut)]
    assert len(want) > 6 and any(len(w[2]) > 1000 for w in want)
    assert rows(ingest_plans.contextualise_whole(spark, str(tmp_path)), "doc_id", "chunk_index") == want
    assert tuple(ingest_plans.ingest_twice_is_once(spark, str(tmp_path)).first()) == (3, 3, 0)
    once = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "doc_id long, chunk_index int, text string")
    twice = spark.createDataFrame([(1, 0, "x"), (1, 1, "changed"), (1, 1, "y"), (2, 0, "z")], once.schema)
    assert rows(ingest.compare_runs(docs, once, twice), "doc_id") == [(1, False, 3, 1), (2, True, 1, 0), (3, True, 0, 0)]


def test_diagnosis_history_keeps_all(spark):
    day = date(2020, 1, 1)
    seen = spark.createDataFrame([(1, "flu", day, p, f"c{p % 7}") for p in range(12)] + [(1, "flu", day, 3, None), (2, "flu", day, None, None)], "scope long, condition string, start_date date, provider_id long, code string")
    want = (1, "flu", day, 13, 12, ",".join(sorted(map(str, range(12)))), ",".join(f"c{k}" for k in range(7)))
    assert rows(graph.diagnosis_history(seen), "scope") == [want, (2, "flu", day, 1, 0, "", "")]


def test_graph_repair(spark):
    nodes = spark.createDataFrame([("Visit", "v", 1, None), ("Visit", "w", 2, None), ("Owner", "1", 1, None), ("Owner", "2", 2, None)], "label string, id string, scope long, name string")
    edges = spark.createDataFrame([("Owner", "1", "HAD", "Visit", "v"), ("Owner", "2", "HAD", "Visit", "v"), ("Owner", "2", "HAD", "Visit", "w")], "src_label string, src_id string, rel string, dst_label string, dst_id string")
    assert rows(graph.ownership_violations(edges, "Owner").select("dst_id")) == [("v",)]
    good = graph.reconcile(edges, nodes, "Owner")
    assert good.count() == 2 and graph.ownership_violations(good, "Owner").count() == 0
    left, kept = graph.sweep(nodes, good, nodes.where("id <> 'w'").select("label", "id"))
    assert left.count() == 3 and rows(kept.select("dst_id")) == [("v",)]


def test_metrics_are_null_not_zero(spark):
    empty = spark.createDataFrame([], "p int, e int")
    assert metrics.accuracy(empty, "p", "e").first()["accuracy"] is None
    df = spark.createDataFrame([([], "x")], "terms array<string>, answer string")
    assert tuple(df.select(metrics.answer_correctness(F.col("terms"), F.col("answer")), metrics.leak_free(F.col("terms"), F.col("answer"))).first()) == (None, None)
    ranked = spark.createDataFrame([], "query_id long, id long, rank int")
    wanted = spark.createDataFrame([(1, 5)], "query_id long, id long")
    assert tuple(metrics.ranking_metrics(ranked, wanted, 5).first()) == (1, 0.0, 0.0, 0.0)


def test_nearest_rank(spark):
    assert metrics.latency_summary(spark.range(1, 56), "id").first()["p95_ms"] == 53


def test_split_keeps_templates_together(spark):
    df = spark.createDataFrame([("t", f"x{k % 20}") for k in range(200)], "task string, template_id string")
    out = corpus.split_by_template(df)
    assert corpus.template_overlap(out).count() == 0
    assert {r["split"]: r["n_templates"] for r in corpus.split_manifest(out).collect()} == {"train": 14, "val": 3, "test": 3}


def test_oversample(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "task string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.5), ("c", 0.2)], "task string, weight double")
    assert {r["task"]: r["count"] for r in corpus.oversample(df, weights).groupBy("task").count().collect()} == {"a": 1, "b": 3, "c": 1}


def test_json_extraction(spark):
    df = spark.createDataFrame([('```json\n{"k": "1"}\n```',), ('see { it: {"k": "{2}"} end',), ("none",), (None,)], "t string")
    assert [r["parsed"] for r in corpus.extract_json(df, "t", "map<string,string>").collect()] == [{"k": "1"}, {"k": "{2}"}, None, None]


def test_contains_join(spark):
    texts = spark.createDataFrame([(1, "Call Ann Lee today"), (2, "Ann and Lee"), (3, None)], "text_id long, text string")
    terms = spark.createDataFrame([(7, "ann lee"), (8, "--")], "term_id long, term string")
    assert rows(corpus.contains_join(texts, terms)) == [(1, 7)]


def test_contains_join_at_parts_of_words(spark):
    texts = spark.createDataFrame([(1, "the bobcat sat only"), (2, "cat, sat on")], "text_id long, text string")
    assert rows(corpus.contains_join(texts, spark.createDataFrame([(7, "Cat sat on")], "term_id long, term string"))) == [(1, 7)]


def test_name_leaks(spark):
    said = ["Dr White called", "patient  white.", "Anna Q. White", "anna. white", "white cell count", "mr whites", "Mr Lee", "call Bo Lee today", "ms Müller", "dr a.b+c", "Dra White", "doctor\nO'Neil", None]
    texts = spark.createDataFrame(list(enumerate(said)), "text_id long, text string")
    names = spark.createDataFrame([(1, "Anna Q. White"), (2, "Bo Lee"), (3, "Eva Müller,"), (4, "x a.b+c"), (5, "White"), (6, "\\E( O'Neil"), (7, None)], "name_id long, name string")
    got = rows(corpus.name_leaks(texts, names), "text_id", "name_id")
    assert [x for x in got if x[1] != 5] == [(0, 1), (1, 1), (2, 1), (3, 1), (7, 2), (8, 3), (9, 4), (11, 6)]
    # a full name is looked for wherever it stands, inside words too
    assert [x[0] for x in got if x[1] == 5] == [0, 1, 2, 3, 4, 5, 10]


def test_window_leaks(spark):
    texts = spark.createDataFrame([(1, "so THE end,\nof it all"), (2, "one two"), (3, "ones two"), (4, None), (5, "the end it")], "text_id long, text string")
    terms = spark.createDataFrame([(7, "a b c the end of it"), (8, "one two"), (9, "--"), (10, None)], "term_id long, term string")
    assert rows(corpus.window_leaks(texts, terms), "text_id") == [(1, 7, 2), (2, 8, 1)]


@pytest.mark.parametrize(("text", "route"), [("Select the name from my list", "OUT_OF_SCOPE"), ("please book me an appointment", "ACTION"), ("Please update my address where I live now", None), ("what was the average glucose", "TEXT_TO_SQL"), ("when is my next appointment", "API"), ("good morning", None)])
def test_routes(spark, text, route):
    assert rules.classify_routes(spark.createDataFrame([(text,)], "text string")).first()["route"] == route


def test_answers(spark):
    schema = "answer string, truncated boolean, available array<string>, cited array<string>, expect_sources boolean"
    df = spark.createDataFrame([("fine", False, ["a"], ["a"], True), (" ", False, None, None, False), ("cut", True, None, None, True), ("x", False, [], ["b"], False)], schema)
    got = rules.check_answers(df).collect()
    assert [r["violations"] for r in got] == [[], ["empty_answer"], ["truncated_answer", "missing_sources"], ["cited_unavailable_source"]]
    assert got[1]["shown"] == rules.BLOCKED and got[2]["shown"].endswith("rest._")


def test_rewrite_and_title(spark):
    turns = spark.createDataFrame([(1, 0, "user", "And it?"), (1, 1, "assistant", "yes"), (1, 2, "user", "what did the cardiologist say about chest pain"), (1, 3, "user", "and then")], "conv_id long, turn long, role string, text string")
    assert rows(rules.needs_rewrite(turns).select("turn", "needs_rewrite"), "turn") == [(0, False), (2, False), (3, True)]
    long = spark.createDataFrame([(1, 0, "user", "word " * 30)], turns.schema)
    assert rules.conversation_titles(long).first()["title"] == "word " * 10 + "word…"


def test_history_starts_at_a_user_turn(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s" * 99), (1, 1, "user", "a" * 10), (1, 2, "assistant", "b" * 10), (1, 3, "user", "c" * 10), (1, 4, "assistant", "d" * 10)], "conv_id long, turn long, role string, text string")
    assert rows(conversations.select_history(turns, 35).select("turn"), "turn") == [(3,), (4,)]
    assert rows(conversations.select_history(turns, 5).select("turn")) == []


def test_limiter():
    own = operations.Limiter(2, 3, 60)
    assert [own.admit(t)[0] for t in (0, 1, 2, 60, 61, 62, 86400)] == ["accepted", "accepted", "window_limit", "accepted", "daily_limit", "daily_limit", "accepted"]


def test_booking_reasons(spark):
    now = datetime(2024, 1, 1)
    requests = spark.createDataFrame([(1, 1, "soon", "a"), (2, 1, "2023-01-01T10:00:00", "a"), (3, 1, "2026-01-01T10:00:00", "a"), (4, 1, "2024-02-01T10:40:00", "z"), (5, 1, "2024-02-01T11:00:00", "b")], "request_id long, scope long, when string, appointment_type string")
    taken = spark.createDataFrame([(9, 1, datetime(2024, 2, 1, 10, 30), "scheduled")], "id long, scope long, appointment_date timestamp, status string")
    seen = spark.createDataFrame([], "scope long, provider_id long, encounter_date date, id long")
    got = operations.validate_bookings(requests, taken, seen, spark.createDataFrame([(4,)], "provider_id long"), now, ["a", "b"])
    assert rows(got.select("request_id", "reason", "provider_id", "appointment_type"), "request_id") == [(1, "unparsable_time", 4, "a"), (2, "in_the_past", 4, "a"), (3, "too_far_ahead", 4, "a"), (4, "slot_taken", 4, "a"), (5, None, 4, "b")]


def test_stream_admits_as_batch(spark, tmp_path):
    from quarry.streaming.jobs import admit_stream, trace_rollup_stream

    data = spark.createDataFrame([(k % 3, k, datetime.fromtimestamp(1_700_000_000 + 7 * k)) for k in range(60)], "client long, request_id long, ts timestamp")
    data.write.parquet(f"{tmp_path}/in")
    batch = rows(operations.admit(data.select("client", "request_id", F.col("ts").cast("double").alias("second")), 2, 20).select("request_id", "decision"), "request_id")
    stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
    job = admit_stream(stream, 2, 20).writeStream.format("memory").queryName("admitted").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert rows(spark.table("admitted").select("request_id", "decision"), "request_id") == batch
    traces = stream.select(F.col("ts").alias("created_at"), F.lit("r").alias("route"), F.lit(None).cast("string").alias("error"), F.lit(1.0).alias("total_ms"), F.lit(1).alias("input_tokens"), F.lit(0.0).alias("cost_usd"))
    job = trace_rollup_stream(traces).writeStream.format("memory").outputMode("complete").queryName("rolled").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert spark.table("rolled").agg(F.sum("n")).first()[0] == 60


def test_rival_confirmations(spark):
    """One slot is booked once; a repeated token counts once; booking twice equals once."""
    at = lambda h: datetime(2024, 5, 1, h)
    held = spark.createDataFrame([(1, 7, at(9), "scheduled", "checkup"), (2, 7, at(10), "cancelled", "checkup")], "id long, scope long, appointment_date timestamp, status string, appointment_type string")
    asked = [("b", 7, at(10), at(12), "x"), ("a", 7, at(10), at(12), "y"), ("c", 7, at(10), at(11), "z"), ("c", 7, at(10), at(11), "z"), ("d", 7, at(9), at(12), "x"), ("e", 7, at(11), at(1), "x"), ("f", 7, at(11), at(12), "x"), ("g", 8, at(10), at(12), "x"), ("h", 9, at(3), at(12), "x"), ("i", 9, at(3), at(13), "x")]
    confirms = spark.createDataFrame(asked, "token string, scope long, slot timestamp, expires_at timestamp, appointment_type string")
    audit = spark.createDataFrame([("f", "executed"), ("h", "executed"), ("g", "rejected")], "token string, outcome string")
    decided = operations.apply_confirms(confirms, held, audit, at(5))
    assert dict(rows(decided.select("token", "outcome"), "token")) == {"a": "slot_taken", "b": "slot_taken", "c": "executed", "d": "slot_taken", "e": "expired", "f": "repeated", "g": "executed", "h": "repeated", "i": "executed"}
    once = operations.booked(held, decided)
    assert rows(once.select("scope", "appointment_date", "status", "appointment_type"), "scope", "appointment_date", "status") == [(7, at(9), "scheduled", "checkup"), (7, at(10), "cancelled", "checkup"), (7, at(10), "scheduled", "z"), (8, at(10), "scheduled", "x"), (9, at(3), "scheduled", "x")]
    assert rows(operations.booked(once, decided), "id") == rows(once, "id")
    assert dict(rows(operations.apply_confirms(confirms, once, audit, at(5)).select("token", "outcome"), "token"))["c"] == "slot_taken"


def test_replacing_on_disk_leaves_other_files(spark, tmp_path):
    import glob

    path, frame = f"{tmp_path}/t", lambda *r: spark.createDataFrame(r, "k long, v string")
    every = frame(*[(k, f"{k}-{i}") for k in range(40) for i in range(2)])
    tables.replace_on_disk(every, every, path, "k", 16)
    before = set(glob.glob(f"{path}/bucket=*/*.parquet"))
    update = frame((3, "new"), (99, "added"))
    for _ in range(2):
        tables.replace_on_disk(update, frame((3, ""), (99, ""), (4, "")), path, "k", 16)
        want = sorted([(k, f"{k}-{i}") for k in range(40) for i in range(2) if k not in (3, 4)] + [(3, "new"), (99, "added")])
        assert rows(tables.read_replaced(spark, path, "k"), "k", "v") == want
    kept = before & set(glob.glob(f"{path}/bucket=*/*.parquet"))
    assert len(before) - len(kept) <= 3 and len(kept) >= 10
    # the last keys of all folders go
    tables.replace_on_disk(frame().limit(0), every.union(update), path, "k", 16)
    assert tables.read_replaced(spark, path, "k").isEmpty()


def test_audit_batches_are_written_once(spark, tmp_path, monkeypatch):
    """A batch that fails between its rows and its manifest is written over; one that is run again changes nothing."""
    path, frame = f"{tmp_path}/audit", lambda *r: spark.createDataFrame(r, "token string, outcome string")
    write = tables.audit_batches(path)
    write(frame(("a", "executed"), ("b", "expired")), 0)
    # rows of batch 1 without its number in the manifest: what a failure leaves
    frame(("half", "executed")).write.parquet(f"{path}/rows/batch=1")
    assert rows(tables.read_audit(spark, path), "token") == [("a", "executed"), ("b", "expired")]
    for _ in range(2):
        write(frame(("c", "executed")), 1)
        write(frame(("a", "executed"), ("b", "expired")), 0)
        assert rows(tables.read_audit(spark, path), "token") == [("a", "executed"), ("b", "expired"), ("c", "executed")]


def _streamed(spark, tmp_path, batches, schema, build, name, files_per_batch=1):
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}-in/{k}")
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).parquet(f"{tmp_path}/{name}-in")
    query = build(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}.log").trigger(availableNow=True).start(f"{tmp_path}/{name}")
    query.awaitTermination(200)
    return spark.read.parquet(f"{tmp_path}/{name}"), query


def test_streamed_limits_equal_the_fold(spark, tmp_path):
    """Clients' limits over batches equal the batch form; with the budget of a day they equal one fold; both forget by timers."""
    rng = random.Random(9)
    asked = sorted((1_700_006_400.0 + round(rng.uniform(0, 2.5 * 86400), 3), i, rng.choice([1, 1, 1, 2, 3])) for i in range(900))
    batch = [(c, i, datetime.fromtimestamp(t)) for t, i, c in asked]
    schema, parts = "client long, request_id long, ts timestamp", [batch[:300], batch[300:600], batch[600:]]
    alone, _ = _streamed(spark, tmp_path, parts, schema, lambda s: jobs.admit_stream(s, 2, 60, 900), "alone")
    frame = spark.createDataFrame([(c, i, t) for t, i, c in asked], "client long, request_id long, second double")
    assert rows(alone.select("request_id", "decision"), "request_id") == rows(operations.admit(frame, 2, 60, 900).select("request_id", "decision"), "request_id")
    both, query = _streamed(spark, tmp_path, parts, schema, lambda s: jobs.admit_within_budget_stream(s, 2, 30, 80, 900), "both")
    own, spent, want = {}, {}, {}
    for t, i, c in asked:
        said, day = own.setdefault(c, operations.Limiter(2, 30, 900)).admit(t)[0], int(t // 86400)
        said = "budget" if spent.get(day, 0) >= 80 else said
        spent[day] = spent.get(day, 0) + (said == "accepted")
        want[i] = said
    assert dict(rows(both.select("request_id", "decision"), "request_id")) == want and set(want.values()) == {"accepted", "window_limit", "daily_limit", "budget"}
    # five days later one client is left, and one day
    spark.createDataFrame([(8, 10_000, datetime.fromtimestamp(asked[-1][0] + 5 * 86400))], schema).write.parquet(f"{tmp_path}/both-in/9")
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/both-in")
    query = jobs.admit_within_budget_stream(source, 2, 30, 80, 900).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/both.log").trigger(availableNow=True).start(f"{tmp_path}/both")
    query.awaitTermination(200)
    assert spark.read.parquet(f"{tmp_path}/both").count() == 901


def test_confirmations_meet_their_proposals(spark, tmp_path):
    """In time, too late, before the proposal, and of no proposal; a confirmation later than its watermark isn't seen."""
    at = lambda m: datetime(2024, 5, 1, 8) + timedelta(minutes=m)
    asked, said = "token string, scope long, slot timestamp, proposed_at timestamp", "token string, confirmed_at timestamp"
    proposals = [[("a", 1, at(500), at(0)), ("b", 1, at(530), at(1)), ("c", 2, at(500), at(2))], [("d", 3, at(500), at(40)), ("z", 9, at(0), at(300))], [("z2", 9, at(0), at(301))]]
    confirms = [[("a", at(5)), ("c", at(1)), ("n", at(3))], [("b", at(30)), ("d", at(45)), ("z", at(300))], [("a", at(6)), ("z2", at(301))]]
    for name, batches, schema in (("p", proposals, asked), ("c", confirms, said)):
        for k, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k}")
    read = lambda name, schema: spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    query = jobs.confirmed_stream(read("p", asked), read("c", said)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(200)
    got = dict(rows(spark.read.parquet(f"{tmp_path}/out").select("token", "outcome"), "token"))
    assert got == {"a": "open", "b": "expired", "c": "expired", "d": "open", "n": "expired", "z": "open", "z2": "open"}
    assert spark.read.parquet(f"{tmp_path}/out").where("token = 'a'").count() == 1


def test_a_hot_client_is_cut_at_its_pauses(spark):
    """Half of all requests of one client, over midnights and with days that close inside a part: the decisions of one fold, from many parts."""
    rng = random.Random(4)
    asked = sorted((rng.uniform(0, 4 * 86400), i, rng.choice([1, 1, 1, 2, 3, 4])) for i in range(3000))
    # busy stretches around midnights, without a pause
    asked = sorted(asked + [(d * 86400 - 1500 + 9.5 * k, 5000 + 1000 * d + k, 1) for d in (1, 2, 3) for k in range(320)])
    frame = spark.createDataFrame([(c, i, t) for t, i, c in asked], "client long, request_id long, second double").repartition(4)
    for per_window, per_day, window in ((2, 60, 120), (3, 0, 60), (5, 7, 30), (1, 500, 45)):
        own, want = {}, {}
        for t, i, c in asked:
            want[i] = own.setdefault(c, operations.Limiter(per_window, per_day, window)).admit(t)
        got = {r["request_id"]: (r["decision"], r["retry_after"]) for r in operations.admit(frame, per_window, per_day, window).collect()}
        assert got == want
    assert operations._parts(frame, 30).where("client = 1").select("part").distinct().count() > 300
    lost = spark.createDataFrame([(None, 1, 5.0), (1, 2, None)], "client long, request_id long, second double")
    assert rows(operations.admit(lost, 1, 1).select("request_id", "decision"), "request_id") == [(1, None), (2, None)]


def test_courses_meet_dates_by_buckets(spark):
    """Random, long, open and reversed courses equal a scan of all pairs; what can't overlap never meets."""
    rng = random.Random(8)
    day = lambda n: date(1990, 1, 1) + timedelta(days=n)
    courses = [(rng.randint(1, 3), i, day(a := rng.randint(0, 6000)), rng.choice([None, day(a + rng.choice([0, 1, 30, 3000])), day(a - 2)])) for i in range(300)] + [(1, 900, date(1, 1, 1), date(9999, 12, 31)), (1, 901, None, None)]
    dates = [(rng.randint(1, 4), day(rng.randint(-50, 9000))) for _ in range(200)] + [(1, date(1, 1, 1)), (1, date(9999, 12, 31)), (1, None)]
    frame, asked = spark.createDataFrame(courses, "scope long, id long, start_date date, end_date date"), spark.createDataFrame(dates, "scope long, on_date date")
    want = sorted((i, d) for s, i, a, b in courses for t, d in dates if s == t and a and d and a <= d and (b is None or d <= b))
    assert rows(records.in_effect(frame, asked).select("id", "on_date"), "id", "on_date") == want
    # a scope of many short courses and dates
    many = spark.range(100_000).selectExpr("1L AS scope", "id", "date_add(DATE '1900-01-01', CAST(id / 3 AS INT)) AS start_date", "date_add(DATE '1900-01-01', CAST(id / 3 AS INT) + 1) AS end_date")
    every = spark.range(33_000).selectExpr("1L AS scope", "date_add(DATE '1900-01-01', CAST(id AS INT)) AS on_date")
    assert records.in_effect(many, every).count() == sum(1 for i in range(100_000) for d in (i // 3, i // 3 + 1) if d < 33_000)


def test_cancellations_mean_the_earliest_near(spark):
    rng = random.Random(5)
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    held = [(i, rng.randint(1, 2), at(rng.randint(0, 20000)), rng.choice(["scheduled", "cancelled"])) for i in range(120)] + [(500, 1, at(5000), "scheduled"), (501, 1, at(5000), "scheduled")]
    asked = [(i, rng.randint(1, 3), at(rng.randint(0, 20000))) for i in range(150)] + [(900, 1, at(5720)), (901, 1, at(4280))]
    frame, requests = spark.createDataFrame(held, "id long, scope long, appointment_date timestamp, status string"), spark.createDataFrame(asked, "request_id long, scope long, near timestamp")
    want = {}
    for r, s, t in asked:
        near = sorted((d, i) for i, scope, d, status in held if scope == s and status == "scheduled" and d >= at(3000) and abs(d - t) <= timedelta(hours=12))
        if near:
            want[r] = near[0][1]
    assert dict(rows(operations.resolve_cancellations(requests, frame, at(3000)).select("request_id", "id"))) == want


def test_terms_and_values_by_scan(spark):
    """Terms of every length, upper case, other alphabets; pairs and names at all distances, repeated and overlapping: as a scan of all pairs finds them."""
    import re

    rng = random.Random(6)
    alphabet = "abé日. \nA-1"
    texts = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 5, 60, 300])))) for i in range(80)] + [(90, None), (91, "a" * 5000)]
    terms = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 5)))) for i in range(60)] + [(70, "aaaa"), (71, "aaaa"), (72, None)]
    frame = spark.createDataFrame(texts, "text_id long, text string")
    got = rows(corpus.contains_join(frame, spark.createDataFrame(terms, "term_id long, term string")), "text_id", "term_id")
    assert got == sorted((i, j) for i, t in texts for j, x in terms if t and x and x.lower() in t.lower())
    words = ["ab", "cd", "x.y", "ab cd", "(q)", "cd-e", "zz"]
    said = [(i, "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", " " * rng.randint(1, 45), "w"]) for _ in range(rng.randint(1, 9)))) for i in range(150)]
    pairs = [(k, x, y) for k, (x, y) in enumerate((x, y) for x in words for y in words)]
    near = lambda x, y: f"(^|[^a-z0-9]){re.escape(x)}[^a-z0-9]([\\s\\S]{{0,38}}[^a-z0-9])?{re.escape(y)}([^a-z0-9]|$)"
    want = sorted((i, k) for i, t in said for k, x, y in pairs if re.search(f"{near(x, y)}|{near(y, x)}", t.lower()))
    assert rows(corpus.pair_leaks(spark.createDataFrame(said, "text_id long, text string"), spark.createDataFrame(pairs, "pair_id long, first string, second string")), "text_id", "pair_id") == want


def test_objects_in_long_and_odd_texts():
    import json
    import time

    def slow(text):
        start = text.find("{")
        while start >= 0:
            try:
                return text[start : json.JSONDecoder().raw_decode(text, start)[1]]
            except ValueError:
                start = text.find("{", start + 1)
        return None

    rng = random.Random(1)
    parts = ["{", "}", "[", "]", '"', ":", ",", "1", "-2.5e3", "true", "null", " ", "\n", '"a"', '"b":', '{"a":', '\\"', "x", "{}", '{"k":1}', '"\\u00e9"', "NaN", "-", "01"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert corpus.first_object(text) == slow(text)
    for text, found in (("{" * 2_000_000, None), ('{"a": "' + "{" * 2_000_000, None), ('{"a":' * 200_000 + '{"ok": 1}', '{"ok": 1}'), ('{"a": [1,1,' * 90_000 + ' {"ok": 1}', '{"ok": 1}')):
        began = time.process_time()
        assert corpus.first_object(text) == found and time.process_time() - began < 5


def test_confirmations_each_on_its_own(spark, tmp_path):
    """The query judges two confirmations of one free slot alike, as its SQL does; the operator books one of them."""
    from quarry.plans import corpus as corpus_plans

    at = datetime(2000, 5, 1)
    orders = [(2, 7, "F", at), (4, 7, "F", at), (6, 8, "O", at), (8, 8, "F", at), (14, 9, "F", at), (22, 9, "F", at)]
    spark.createDataFrame([(i, c, s, 1.0, t, "1-URGENT") for i, c, s, t in orders], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = dict(rows(corpus_plans.apply_confirms(spark, str(tmp_path)), "token"))
    assert got == {2: "executed", 4: "executed", 6: "slot_taken", 8: "slot_taken", 14: "repeated", 22: "expired"}


def test_sentences_lose_spaces_only(spark):
    """The digits of a sentence's place aren't trimmed; Unicode's spaces are."""
    df = spark.createDataFrame([("0 a. 1 b 1. \u00a02. 19.37.233.111",), (" . ",), ("",)], "t string")
    assert [r[0] for r in df.select(X.sentences(F.col("t"))).collect()] == [["0 a.", "1 b 1. \u00a02.", "19.37.233.111"], ["."], []]


def _small_blocks(monkeypatch):
    from quarry.operators import blocks

    for name, n in (("QUERY_BLOCK", 7), ("CHUNK_BLOCK", 40), ("VECTOR_BLOCK", 25), ("TILE", 16)):
        monkeypatch.setattr(blocks, name, n)


def test_nearest_in_blocks(spark, monkeypatch):
    """Copies, vectors of length 0, other lengths and missing ones: the order of all pairs, whatever the blocks; no row for each pair is shuffled."""
    _small_blocks(monkeypatch)
    rng = random.Random(1)
    vector = lambda: [float(rng.randint(-2, 2)) for _ in range(3)]
    held = [(i, f"s{i % 2}", rng.choice([vector(), vector(), [0.0, 0.0, 0.0], [1.0, 2.0], None, [1.0, 2.0, 2.0]])) for i in range(150)]
    df = spark.createDataFrame(held, "id long, scope string, embedding array<float>")
    queries, chunks = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "chunk_id")
    both = queries.withColumnRenamed("embedding", "q").join(chunks, "scope").withColumn("distance", V.cosine_distance(F.col("q"), F.col("embedding")))
    want = retrieval.ranked(both, [F.asc_nulls_last("distance"), F.asc("chunk_id")], 5).select("query_id", "chunk_id", "distance", "rank")
    got = retrieval.vector_search(queries, chunks, 5)
    assert rows(got.select("query_id", "chunk_id", "distance", "rank"), "query_id", "rank") == rows(want, "query_id", "rank")


def test_terms_in_blocks(spark, monkeypatch):
    """Hits and BM25 of all pairs by a loop; ties by id; ids may be texts."""
    import math

    _small_blocks(monkeypatch)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)] + ["the"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    chunks = [(f"c{i:03}", f"s{i % 2}", rng.choice([None, "", text(3), text(40), text(9)])) for i in range(200)]
    queries = [(i, f"s{i % 3}", rng.choice([None, text(1), text(3)])) for i in range(40)]
    q, c = spark.createDataFrame(queries, "query_id long, scope string, query string"), spark.createDataFrame(chunks, "chunk_id string, scope string, text string")
    for scorer in ("count", "bm25"):
        want = []
        for i, scope, asked in queries:
            mine, terms = [(j, (t or "").split()) for j, s, t in chunks if s == scope], sorted({w for w in (asked or "").split() if w != "the"})
            full = [len(t) for (_, s, x) in chunks if s == scope and x is not None for t in [x.split()]]
            found = []
            for j, t in mine:
                score = 0
                for w in terms:
                    tf, df = t.count(w), sum(w in u for _, u in mine)
                    if tf:
                        score += tf if scorer == "count" else math.log(1 + (len(mine) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / (sum(full) / len(full))))
                if score:
                    found.append((-round(score, 9), j))
            want += [(i, j, n + 1, round(-s, 6)) for n, (s, j) in enumerate(sorted(found)[:4])]
        got = retrieval.keyword_search(q, c, 4, scorer=scorer).select("query_id", "chunk_id", "rank", F.round(F.col("hits").cast("double"), 6))
        assert rows(got, "query_id", "rank") == sorted(want, key=lambda r: (r[0], r[2]))


def test_no_table_of_pairs(spark, tmp_path):
    """Neither search joins queries with chunks row by row."""
    q, c = spark.createDataFrame([(1, "s", "plan", [1.0])], "query_id long, scope string, query string, embedding array<float>"), spark.createDataFrame([(1, "s", "plan", [1.0])], "chunk_id long, scope string, text string, embedding array<float>")
    for found in (retrieval.vector_search(q, c), retrieval.keyword_search(q, c), retrieval.keyword_search(q, c, scorer="bm25")):
        assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_ranking_without_texts(spark):
    """Hits that bring their passage's digest and their overlap are ranked as those with texts are."""
    hits = spark.createDataFrame([(1, i, i, "keyword", 0.5, date(2024, 1, i), "Plan", t) for i, t in enumerate(["a plan", "A  plan", "other plan", "none"], 1)], "query_id long, chunk_id long, rank int, retriever string, similarity double, chunk_date date, section string, text string")
    asked = spark.createDataFrame([(1, "the other plan")], "query_id long, query string")
    bare = hits.select("*", F.md5(X.passage_key(F.col("text"))).alias("passage"), F.expr("array(0.5, 0.5, 1.0, 0.0)[chunk_id - 1]").cast("double").alias("overlap")).drop("text")
    names = ["chunk_id", "occurrences", F.round("score", 9), "rank"]
    ranked = lambda df: rows(retrieval.rerank_heuristic(retrieval.dedup_passages(df).withColumn("rank", F.lit(0)), asked, date(2024, 6, 1), 5).select(*names), "rank")
    assert ranked(bare) == ranked(hits) and len(ranked(bare)) == 3


def test_words_that_no_phrase_has_are_not_shuffled(spark):
    """Phrases of one word need no shuffle of a text's words; firsts that are no plain words are found by their places."""
    texts = spark.createDataFrame([(1, "o'brien white, jo. white; x white"), (2, "jo white"), (3, "brien white")], "text_id long, text string")
    names = spark.createDataFrame([(1, "O'Brien Gray White"), (2, "Jo. B White"), (3, "Jo C White")], "name_id long, name string")
    assert rows(corpus.name_leaks(texts, names), "text_id", "name_id") == [(1, 1), (1, 2), (1, 3), (2, 3)]
    found = corpus.phrases_found(corpus.postings(texts, corpus.NAME_WORD), spark.createDataFrame([(1, "white")], "key long, phrase string"), corpus.NAME_WORD)
    assert found.count() == 5 and "hashpartitioning" not in found._jdf.queryExecution().optimizedPlan().toString() and "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()


def test_a_few_dates_and_many_meet_the_same_courses(spark, monkeypatch):
    """Scopes below and above the bound in one table: each way alone, and both, find the same."""
    day = lambda n: date(1990, 1, 1) + timedelta(days=n)
    courses = spark.createDataFrame([(s, i, day(i * 7), None if i % 5 == 0 else day(i * 7 + i % 40)) for s in (1, 2, 3) for i in range(40)], "scope long, id long, start_date date, end_date date")
    dates = spark.createDataFrame([(s, day(11 * k)) for s in (1, 2) for k in range(3 if s == 1 else 30)] + [(1, None), (9, day(1))], "scope long, on_date date")
    got = []
    for few in (0, 10, 1000):
        monkeypatch.setattr(records, "FEW_DATES", few)
        found = records.in_effect(courses, dates)
        got.append(rows(found.select("scope", "id", "on_date"), "scope", "id", "on_date"))
        # few dates need no buckets
        assert ("shiftright" in found._jdf.queryExecution().optimizedPlan().toString()) == (few < 30)
    assert got[0] == got[1] == got[2] and len(got[0]) > 100


def test_hot_clients_are_cut_and_others_folded_once(spark, monkeypatch):
    """Clients above and below the bound in one table: the decisions of one fold."""
    rng = random.Random(12)
    asked = sorted((rng.uniform(0, 3 * 86400), i, rng.choice([1, 1, 1, 2, 3])) for i in range(600))
    own, want = {}, {}
    for t, i, c in asked:
        want[i] = own.setdefault(c, operations.Limiter(1, 20, 900)).admit(t)[0]
    frame = spark.createDataFrame([(c, i, t) for t, i, c in asked], "client long, request_id long, second double")
    cut = []
    monkeypatch.setattr(operations, "_parts", lambda rows_, window, f=operations._parts: (cut.append(1), f(rows_, window))[1])
    for whole in (1000, 200, 0):
        monkeypatch.setattr(operations, "WHOLE", whole)
        assert dict(rows(operations.admit(frame, 1, 20, 900).select("request_id", "decision"), "request_id")) == want
        assert bool(cut) == (whole < 1000)


def test_bodies_are_cut_a_few_at_once(spark, monkeypatch):
    """The chunks of ``packed``, whatever number of bodies is cut at once; a column that isn't cut keeps its type."""
    made = [(d, d % 3, "Plan", "word " * (300 + 40 * d)) for d in range(10)] + [(77, 0, "Plan", "short")]
    sections = spark.createDataFrame(made, "doc_id long, part long, section string, body string")
    want = sorted((d, p, s, i, t) for d, p, s, b in made for i, t in enumerate(ingest.packed(b.strip()) if len(b) > ingest.MOST else [b]))
    monkeypatch.setattr(ingest, "AT_ONCE", 3)
    out = ingest.pack_sections(sections)
    assert sorted(map(tuple, out.collect())) == want
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()


def test_relevant_ids_are_counted_not_listed(spark):
    """Metrics with totals given equal those of the whole table of relevant ids."""
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1)], "query_id long, id long, rank int")
    relevant = spark.createDataFrame([(1, 6), (1, 8), (1, 9), (2, 8), (3, 1)], "query_id long, id long")
    total = spark.createDataFrame([(1, 3), (2, 1), (3, 1)], "query_id long, n_relevant long")
    some = relevant.join(ranked, ["query_id", "id"], "left_semi")
    assert rows(metrics.ranking_metrics(ranked, some, 2, total), "query_id") == rows(metrics.ranking_metrics(ranked, relevant, 2), "query_id")


def test_care_team_keeps_visits_apart_once(spark):
    """No row per distinct count (F24): a visit counts at its first condition, also where that is null or a visit has rows of two providers."""
    from quarry.operators import graph

    visits = spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 1, 5)), (3, date(2024, 1, 3))], "id long, encounter_date date")
    courses = spark.createDataFrame([(7, 1, 1, "a"), (7, 1, 1, "a"), (7, 1, 1, "b"), (7, 2, 1, "a"), (7, 2, 1, None), (7, 3, 1, None), (7, 3, 2, "b"), (8, 1, 1, "a"), (8, 9, 1, "a")], "scope long, encounter_id long, provider_id long, condition string")
    got = graph.care_team(courses, visits)
    assert rows(got, "scope", "provider_id") == [(7, 1, 3, date(2024, 1, 5), 2), (7, 2, 1, date(2024, 1, 3), 1), (8, 1, 1, date(2024, 1, 1), 1)]
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_projection_deals_rows_once(spark):
    """Edges of an id that is one scope's own share a shuffle (F15); repeated rows, null ends and ids of two scopes come out right."""
    from quarry.operators import graph

    labs = spark.createDataFrame([(1, 5, "x", "A"), (1, 5, "x", "A"), (2, 5, "x", None), (None, 6, "y", "A"), (3, None, None, "B")], "scope long, encounter_id long, id string, lab_id string")
    taken = spark.createDataFrame([(1, 5, 10, "n", "c"), (1, 6, 10, "m", "c"), (2, 6, None, "m", "c"), (2, 7, 11, "o", None)], "scope long, encounter_id long, id long, name string, condition_id string")
    found = graph.project_edges({"lab_results": labs, "medications": taken})
    lab, med = ("LabResult",), ("Medication",)
    want = [("Patient", "1", "HAS_LAB_RESULT", *lab, "x"), ("Patient", "2", "HAS_LAB_RESULT", *lab, "x"), ("Encounter", "5", "ORDERED", *lab, "x"), ("Encounter", "6", "ORDERED", *lab, "y"), (*lab, "x", "OF_LAB", "Lab", "A"), (*lab, "y", "OF_LAB", "Lab", "A")]
    want += [("Patient", "1", "TAKES", *med, "10"), ("Patient", "2", "TAKES", *med, "11"), ("Encounter", "5", "PRESCRIBED", *med, "10"), ("Encounter", "6", "PRESCRIBED", *med, "10"), ("Encounter", "7", "PRESCRIBED", *med, "11"), (*med, "10", "TREATS", "Condition", "c")]
    assert sorted(tuple(r) for r in found.select("src_label", "src_id", "rel", "dst_label", "dst_id").collect()) == sorted(want)
    assert graph.project_edges({"lab_results": labs})._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(id") == 1
    nodes = graph.project_nodes({"lab_results": labs, "medications": taken})
    assert sorted(tuple(r) for r in nodes.select("label", "id", "scope", "name").collect()) == [("Lab", "A", None, "A"), ("Lab", "B", None, "B"), ("LabResult", "x", 1, None), ("LabResult", "y", None, None), ("Medication", "10", None, "m"), ("Medication", "11", None, "o")]


def test_readings_of_visits_are_dealt_once(spark):
    """Readings and conditions go by visit once (F19), in partitions that aren't put together; a condition twice at a visit counts once, null keys meet nothing."""
    from quarry.operators import graph

    readings = spark.createDataFrame([(1, 5, "A", 2.0), (1, 5, "A", 3.0), (1, 6, "A", 9.0), (2, 5, "A", 7.0), (1, 5, "B", None), (None, 5, "A", 1.0)], "scope long, id long, test_name string, value double")
    courses = spark.createDataFrame([(1, 5, "c"), (1, 5, "c"), (1, 5, None), (1, 7, "c"), (2, 5, "c"), (None, 5, "c")], "scope long, encounter_id long, condition string")
    got = graph.t_readings_for(readings, courses)
    assert sorted(map(str, rows(got, "scope"))) == sorted(map(str, [(1, "c", "A", 2, 3.0), (1, None, "A", 2, 3.0), (1, "c", "B", 1, None), (1, None, "B", 1, None), (2, "c", "A", 1, 7.0)]))
    plan = graph.t_readings_for(readings.hint("merge"), courses)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 3 and plan.count("REPARTITION_BY_NUM") == 2


def test_chunks_are_dealt_once_for_many_queries(spark):
    """20,000 queries of a scope are one block: a chunk isn't shuffled anew for every few thousand of them."""
    queries, chunks = spark.range(20_000).select(F.col("id").alias("query_id"), F.lit("s").alias("scope"), F.lit("plan").alias("text")), spark.range(1_000).select(F.col("id").alias("chunk_id"), F.lit("s").alias("scope"), F.lit("plan").alias("text"))
    assert blocks.paired(queries, chunks).where("side = 1").count() == 1_000


def _odd_texts():
    rng = random.Random(5)
    words = ["a", "of", "planplan", "planplano", "planplane", "x" * 16, "x" * 17, "x" * 17 + "y", "9" * 300, "\u00e9t\u00e9", "\u4e2d", "a1b", "--"]
    return [None, "", "abc", "def", " ", "\u00e9", *("".join(rng.choice(words) + rng.choice([" ", "", ",", "\n", "\u00df"]) for _ in range(rng.randint(0, 30))) for _ in range(200))]


def test_tokens_as_numbers():
    """The same tokens as the pattern's, in slices and chunks too: equal ones are one number, others are not."""
    texts = _odd_texts()
    column = pa.chunked_array([pa.array(texts[:90]), pa.array(texts)[90:150], pa.array(texts)[150:], pa.array([], pa.string())])
    numbers, at = blocks.tokens(column)
    want = [re.findall("[a-z0-9]+", t or "") for t in texts]
    assert at.tolist() == [0, *itertools.accumulate(map(len, want))]
    named = dict(zip([w for t in want for w in t], numbers.tolist(), strict=True))
    assert len(set(named.values())) == len(named) and [named[w] for t in want for w in t] == numbers.tolist()


@pytest.mark.parametrize("scorer", [None, (1.2, 0.75)])
def test_terms_that_cannot_reach_find_no_chunks(monkeypatch, scorer):
    """Tiles, ranges, looked up terms and left out ranges: the first ones of a loop, for fewer postings than all."""
    for name, n in (("FIRST_RANGE", 8), ("WIDER", 2), ("DENSE", 5)):
        monkeypatch.setattr(blocks, name, n)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    draw = lambda n: rng.choices(words, [1 / (i + 1) for i in range(300)], k=n)
    chunks = [draw(int(rng.paretovariate(1) * 3) % 400) for _ in range(2_000)]
    queries = [sorted(set(draw(10))) for _ in range(30)]
    mean, df = sum(map(len, chunks)) / len(chunks), Counter(w for c in chunks for w in set(c))
    weight = {w: math.log(1 + (len(chunks) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    texts = pa.table({"query_id": range(30), "text": [" ".join(q) for q in queries]})
    if scorer:
        numbers, at = blocks.tokens(texts["text"])
        lists = lambda x: [x[a:b] for a, b in itertools.pairwise(at.tolist())]
        texts = pa.table({"query_id": range(30), "terms": lists(numbers.tolist()), "weights": lists([weight.get(w, 0.0) for q in queries for w in q]), "mean": [mean] * 30})
    found, seen = blocks.Counted(texts, 5, scorer), []
    gathered = blocks._Postings.gathered
    monkeypatch.setattr(blocks._Postings, "gathered", lambda self, rows, s: seen.append(int((self.cut[rows, s + 1] - self.cut[rows, s]).sum())) or gathered(self, rows, s))
    for a in range(0, 2_000, 700):
        found.add(pa.table({"chunk_id": range(a, min(2_000, a + 700)), "text": [" ".join(c) for c in chunks[a : a + 700]]}))
    got = list(zip(*(x.tolist() for x in found.best()), strict=True))
    want, postings = [], 0
    for q, terms in enumerate(queries):
        scored = []
        for c, mine in enumerate(chunks):
            tf = [(mine.count(w), weight.get(w)) for w in terms if w in mine]
            postings += len(tf)
            if tf:
                scored.append((round(-sum(w * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(mine) / mean)) if scorer else n for n, w in tf), 9), c))
        want += [(q, c, -s) for s, c in sorted(scored)[:5]]
    assert [(q, c, round(s, 6)) for q, c, s in got] == [(q, c, round(s, 6)) for q, c, s in want]
    assert sum(seen) < 0.7 * postings


def test_terms_counted_by_scope(spark):
    """In how many texts of a scope a term is, and how many texts and tokens a scope has: of all partitions together, each text once."""
    texts = _odd_texts()
    df = spark.createDataFrame([(i, ["s", "t", None][i % 3], t) for i, t in enumerate(texts)], "id long, scope string, text string")
    pairs = {(r["id"], r["term"]) for r in blocks.terms_of(df, "id", "bigint", "string").collect()}
    own = {i: [re.findall("[a-z0-9]+", t or "") for t in [t]][0] for i, t in enumerate(texts)}
    assert Counter(i for i, _ in pairs) == {i: len(set(x)) for i, x in own.items() if x}
    want = Counter((["s", "t"][i % 3], n) for i, n in pairs if i % 3 < 2)
    got = {(r["scope"], r["term"]): (r["n"], r["n_words"]) for r in blocks.frequencies(df.repartition(3), "string").collect()}
    assert {k: v[0] for k, v in got.items() if k[1] is not None} == want
    for x, s in enumerate("st"):
        assert got[s, None] == (sum(t is not None for t in texts[x::3]), sum(len(own[i]) for i in range(x, len(texts), 3)))


def test_every_vector_is_a_query_of_the_ranking_metrics(spark):
    """One row for each vector, not for those of some ids only; what they are, for ids that aren't divisible by 100."""
    folder = "/root/testdata/sf0.001"
    got = {r["query_id"]: r for r in metric_plans.recall_precision_mrr(spark, folder).collect()}
    stored = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    assert len(got) == len(stored) and set(got) == {r["vec_id"] for r in stored}
    unit = lambda e: [x / sum(y * y for y in e) ** 0.5 for x in e]
    units = [(r["vec_id"], r["label"], unit(r["embedding"])) for r in stored]
    for i, label, e in units[1:4]:
        near = [b for *_, b in sorted((round(1 - sum(x * y for x, y in zip(e, f, strict=True)), 9), j, a == label) for j, a, f in units)][:20]
        first = next((n for n, hit in enumerate(near, 1) if hit), None)
        want = sum(near[:10]) / sum(a == label for _, a, _ in units), sum(near[:10]) / 10, 1 / first if first else 0.0
        assert [got[i]["recall"], got[i]["precision"], got[i]["reciprocal_rank"]] == pytest.approx(want)


def test_embedding_without_a_row_for_each_word(spark, monkeypatch):
    """The vectors of the column builders, for odd texts and a small store of digests; words aren't shuffled, other columns stay."""
    monkeypatch.setattr(ingest, "EMBEDDED", 17)
    monkeypatch.setattr(ingest, "KNOWN", 5)
    df = spark.createDataFrame([(i, t, date(2024, 1, 1)) for i, t in enumerate([*_odd_texts(), "Plan PLAN plan K", "a b c " * 50])], "id long, text string, day date")
    got = ingest.embed_hashing(df, "id", "text", 16)
    assert got.columns == ["id", "text", "day", "embedding"] and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    counts = df.select("id", F.explode(X.tokens(F.col("text"))).alias("w")).groupBy("id", V.hash_bucket(F.col("w"), 16).alias("b")).agg(F.sum(V.hash_sign(F.col("w"))).alias("n"))
    made = counts.groupBy("id").agg(V.dense_unit(F.map_from_entries(F.collect_list(F.struct("b", "n"))), 16).alias("want"))
    want = rows(df.join(made, "id", "left").select("id", "text", "day", F.coalesce("want", F.array_repeat(F.lit(0.0), 16))), "id")
    assert rows(got, "id") == want


def test_nearest_of_many_tiles(spark, monkeypatch):
    """A floor from a few chunks, text ids, and queries of which very many chunks are equally near: the order of all pairs."""
    for name, n in (("VECTOR_TILE", 64), ("FIRST_RANGE", 4), ("VECTOR_CELLS", 640)):
        monkeypatch.setattr(blocks, name, n)
    rng = random.Random(7)
    held = [(i, "s", [0.0, 0.0] if i % 3 == 0 else [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(400)]
    df = spark.createDataFrame(held, "id long, scope string, embedding array<double>")
    for kind in ("long", "string"):
        queries, chunks = df.where("id % 7 < 2").withColumnRenamed("id", "query_id"), df.select(F.format_string("%05d", "id").cast(kind).alias("chunk_id"), "scope", "embedding")
        both = queries.withColumnRenamed("embedding", "q").join(chunks, "scope").withColumn("distance", V.cosine_distance(F.col("q"), F.col("embedding")))
        want = retrieval.ranked(both, [F.asc("distance"), F.asc("chunk_id")], 3).select("query_id", "chunk_id", "rank")
        assert rows(retrieval.vector_search(queries, chunks, 3).select("query_id", "chunk_id", "rank"), "query_id", "rank") == rows(want, "query_id", "rank")
