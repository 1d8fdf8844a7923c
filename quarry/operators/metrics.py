"""Evaluation metrics (A8-A27). What can't be computed is null, never zero."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metrics of which less is better.
LOWER_IS_BETTER = ["mean_ms", "p50_ms", "p95_ms", "max_ms", "error_rate", "mean_tool_calls"]
#: Steps that a group's values are counted in before some of them are ordered.
BINS = 4096


def rate(condition: Column) -> Column:
    """The share of rows for which a condition holds; rows where it is null don't count."""
    return F.avg(condition.cast("double"))


def accuracy(df: DataFrame, predicted: str, expected: str, by: list[str] = ()) -> DataFrame:
    """The share of rows with an expectation that meet it."""
    return df.groupBy(*by).agg(rate(F.when(F.col(expected).isNotNull(), F.col(predicted).eqNullSafe(F.col(expected)))).alias("accuracy"))


def confusion(df: DataFrame, predicted: str, expected: str) -> DataFrame:
    """Rows of each pair of expectation and prediction."""
    return df.where(F.col(expected).isNotNull()).groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int, total: DataFrame | None = None) -> DataFrame:
    """recall@k, precision@k and reciprocal rank of each query (query_id, id, rank) against (query_id, id).

    With the number of each query's relevant ids given (query_id, n_relevant), only those that are ranked need be in ``relevant``.
    """
    wanted = relevant.select("query_id", "id").distinct()
    total = wanted.groupBy("query_id").agg(F.count("*").alias("n_relevant")) if total is None else total
    shown = ranked.select("query_id", "id", "rank").join(wanted.withColumn("hit", F.lit(True)), ["query_id", "id"], "left")
    per = shown.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("n_window"), F.count_distinct(F.when(F.col("hit") & (F.col("rank") <= k), F.col("id"))).alias("n_hit"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"))
    out = total.join(per, "query_id", "left").fillna(0, ["n_window", "n_hit"])
    return out.select("query_id", F.try_divide("n_hit", "n_relevant").alias("recall"), F.when(F.col("n_window") == 0, 0.0).otherwise(F.try_divide("n_hit", "n_window")).alias("precision"), F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank"))


def answer_correctness(terms: Column, answer: Column) -> Column:
    """The share of required terms that an answer has; null without any."""
    return F.try_divide(F.size(F.filter(terms, lambda t: F.contains(F.lower(answer), F.lower(t)))), F.size(terms))


def leak_free(terms: Column, answer: Column) -> Column:
    """Whether an answer has none of the forbidden terms; null without any."""
    return F.when(F.size(terms) > 0, ~F.exists(terms, lambda t: F.contains(F.lower(answer), F.lower(t))))


def citation_correctness(cited: Column, relevant: Column) -> Column:
    """The share of citations that are relevant; null without ground truth or citations."""
    return F.when(F.size(relevant) > 0, F.try_divide(F.size(F.filter(cited, lambda c: F.array_contains(relevant, c))), F.size(cited)))


def grounding_rate(df: DataFrame, cited: str, expects: str, by: list[str] = ()) -> DataFrame:
    """The share of rows that expect sources and cite any."""
    return df.groupBy(*by).agg(rate(F.when(F.col(expects), F.size(cited) > 0)).alias("grounding_rate"))


def tool_metrics(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Recall and precision of the tools used (arrays expected_tools, tools_used), calls that went well, mean calls."""
    hit = F.size(F.array_intersect("expected_tools", "tools_used"))
    return df.groupBy(*by).agg(F.avg(F.try_divide(hit, F.size("expected_tools"))).alias("recall"), F.avg(F.try_divide(hit, F.size(F.array_distinct("tools_used")))).alias("precision"), F.try_divide(F.sum(F.size(F.filter("tool_calls", lambda c: c["ok"]))), F.sum(F.size("tool_calls"))).alias("success_rate"), F.avg(F.size("tool_calls")).alias("mean_calls"))


def json_validity(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Structured calls without a failure; null without calls."""
    return df.groupBy(*by).agg(F.try_divide(F.sum("structured_calls") - F.sum("structured_failures"), F.sum("structured_calls")).alias("validity"))


def traversal_metrics(choices: DataFrame, templates: DataFrame) -> DataFrame:
    """Whether a chosen traversal has all relations asked for and goes as deep (template, edges, hops)."""
    chosen = choices.join(templates, "template", "left")
    return chosen.select("case_id", (F.size(F.array_except("expected_relations", F.coalesce("edges", F.array().cast("array<string>")))) == 0).alias("covers"), (F.coalesce("hops", F.lit(0)) >= F.col("expected_hops")).alias("deep_enough"))


def latency_summary(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Mean, nearest-rank percentiles and maximum.

    A group's values are counted in BINS equal steps first; only those of the step that holds a percentile are ordered.
    """
    by = list(by)
    values = df.select(*by, F.col(column).alias("value"))
    held = values.groupBy(*by).agg(F.avg("value").alias("mean_ms"), F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("max_ms"))
    step = F.coalesce(F.least(F.lit(BINS - 1), F.floor(F.try_divide(F.col("value") - F.col("least"), F.col("max_ms") - F.col("least")) * BINS)), F.lit(0)).alias("step")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    joined = lambda left, right, *more, how="inner": left.alias("l").join(right.alias("r") if by else F.broadcast(right.alias("r")), reduce(and_, [*on, *more], F.lit(True)), how)
    placed = joined(values.where("value is not null"), held).select(*[F.col(f"l.{c}") for c in by], "value", step).groupBy(*by, "step", "value").agg(F.count("*").alias("k"))
    steps = placed.groupBy(*by, "step").agg(F.sum("k").alias("k"))
    upto = F.coalesce(F.sum("k").over(Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = joined(steps.withColumn("before", upto), held).select(*[F.col(f"l.{c}") for c in by], "step", "before", "l.k", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.greatest(F.lit(1), F.ceil(F.col("r.n") * p)).alias("at")) for p in (0.5, 0.95)])).alias("w"))
    wanted = wanted.where((F.col("before") < F.col("w.at")) & (F.col("w.at") <= F.col("before") + F.col("k"))).select(*by, "step", "before", "w.p", "w.at")
    inside = joined(placed, wanted, F.col("l.step") == F.col("r.step")).select(*[F.col(f"l.{c}") for c in by], "l.value", "l.k", "r.before", "r.p", "r.at")
    place = F.col("before") + F.sum("k").over(Window.partitionBy(*by, "p").orderBy("value"))
    found = inside.withColumn("place", place).where("place >= at").groupBy(*by).agg(F.min(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50_ms"), F.min(F.when(F.col("p") == 0.95, F.col("value"))).alias("p95_ms"))
    return joined(held, found, how="left").select(*[F.col(f"l.{c}") for c in by], "mean_ms", "p50_ms", "p95_ms", "max_ms")


def run_states(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Cases that ran, were skipped or failed, and the error rate of those that weren't skipped."""
    ran = F.col("skipped").isNull()
    return df.groupBy(*by).agg(F.count_if(ran & F.col("error").isNull()).alias("n_ran"), F.count_if(~ran).alias("n_skipped"), F.count_if(ran & F.col("error").isNotNull()).alias("n_errored"), rate(F.when(ran, F.col("error").isNotNull())).alias("error_rate"))


def score_card(groups: dict[str, DataFrame]) -> DataFrame:
    """One-row metric tables of any columns as one tall table (group, metric, value, skip_reason)."""
    parts = []
    for name, df in groups.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
        parts.append(df.select(F.lit(name).alias("group"), F.inline(pairs)))
    return reduce(DataFrame.unionByName, parts).withColumn("skip_reason", F.when(F.col("value").isNull(), "nothing to score"))


# Metric groups, their metrics and what the cases are without where one has no value.
SCORES = [
    ("routing", "router_accuracy", "without routes to compare"),
    ("retrieval", "recall_at_k", "without relevant documents"),
    ("retrieval", "precision_at_k", "without relevant documents"),
    ("retrieval", "mrr", "without relevant documents"),
    ("generation", "answer_correctness", "without facts to mention"),
    ("generation", "citation_correctness", "without citations to compare"),
    ("generation", "grounding_rate", "without answers that need sources"),
    ("generation", "faithfulness", "without judged claims"),
    ("tools", "tool_recall", "without expected tools"),
    ("tools", "tool_precision", "without used tools"),
    ("tools", "mean_tool_calls", "without finished cases"),
    ("safety", "leak_free_rate", "without forbidden terms"),
    ("reliability", "error_rate", "without attempted cases"),
]


def score_results(results: DataFrame, k: int = 5) -> DataFrame:
    """The score card of a run: (group, metric, value, n, skip_reason), n being the cases that count; one pass over the cases.

    results: skipped, error, route, expected_route, retrieved and relevant (arrays of ids), answer, must_mention, must_not_mention,
    cited, needs_sources, faithfulness, expected_tools, tools_used. Skipped and failed cases count for error_rate only.
    """
    ran = F.col("skipped").isNull() & F.col("error").isNull()
    truth = F.size("relevant") > 0
    first = F.slice("retrieved", 1, k)
    hits = F.size(F.array_intersect(first, "relevant"))
    found = F.filter(F.transform("retrieved", lambda x, i: F.when(F.array_contains("relevant", x), i + 1)), lambda i: i.isNotNull())
    shared = F.size(F.array_intersect("expected_tools", "tools_used"))
    values = {
        "router_accuracy": F.when(F.col("expected_route").isNotNull() & F.col("route").isNotNull(), F.col("route") == F.col("expected_route")),
        "recall_at_k": F.when(truth, hits / F.size(F.array_distinct("relevant"))),
        "precision_at_k": F.when(truth, F.coalesce(F.try_divide(F.size(F.filter(first, lambda x: F.array_contains("relevant", x))), F.size(first)), F.lit(0.0))),
        "mrr": F.when(truth, F.coalesce(1 / F.get(found, F.lit(0)), F.lit(0.0))),
        "answer_correctness": answer_correctness(F.col("must_mention"), F.col("answer")),
        "citation_correctness": citation_correctness(F.col("cited"), F.col("relevant")),
        "grounding_rate": F.when(F.col("needs_sources"), F.size("cited") > 0),
        "faithfulness": F.col("faithfulness"),
        "tool_recall": F.try_divide(shared, F.size("expected_tools")),
        "tool_precision": F.try_divide(shared, F.size(F.array_distinct("tools_used"))),
        "mean_tool_calls": F.size("tools_used"),
        "leak_free_rate": leak_free(F.col("must_not_mention"), F.col("answer")),
    }
    rows = results.select(*[F.when(ran, v.cast("double")).alias(m) for m, v in values.items()], F.when(F.col("skipped").isNull(), F.col("error").isNotNull().cast("double")).alias("error_rate"))
    whole = rows.agg(*[x for _, m, _ in SCORES for x in (F.avg(m).alias(m), F.count(m).alias(f"n_{m}"))])
    tall = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"n_{m}").alias("n"), F.lit(none).alias("skip_reason")) for g, m, none in SCORES])
    return whole.select(F.inline(tall)).withColumn("skip_reason", F.when(F.col("n") == 0, F.col("skip_reason")))


def faithfulness(claims: DataFrame) -> DataFrame:
    """The share of a case's claims that are supported, and those that aren't."""
    return claims.groupBy("case_id").agg(rate(F.col("supported")).alias("faithfulness"), F.count_if(~F.col("supported")).alias("n_unsupported"), F.array_sort(F.collect_list(F.when(~F.col("supported"), F.col("claim")))).alias("unsupported"))


def compare_runs(metrics: DataFrame, base: str, other: str) -> DataFrame:
    """Metrics of two runs side by side; delta is positive where the other is better."""
    wide = metrics.groupBy("metric").pivot("run", [base, other]).agg(F.first("value"))
    delta = F.col(other) - F.col(base)
    return wide.withColumn("delta", F.when(F.col("metric").isin(LOWER_IS_BETTER), -delta).otherwise(delta))


def failure_report(outcomes: DataFrame) -> DataFrame:
    """For each task its rows, failures of each kind, and accuracy without provider errors (task, failure or null)."""
    kinds = ["wrong_value", "invalid_json", "complied", "provider_error"]
    wide = outcomes.groupBy("task").pivot("failure", kinds).count().fillna(0)
    graded = outcomes.groupBy("task").agg(F.count("*").alias("n"), F.try_divide(F.count_if(F.col("failure").isNull()), F.count_if(~F.col("failure").eqNullSafe(F.lit("provider_error")))).alias("accuracy"))
    return graded.join(wide.select("task", *kinds), "task")


def accuracy_rollup(outcomes: DataFrame) -> DataFrame:
    """Accuracy of each task and of all."""
    graded = outcomes.where(~F.col("failure").eqNullSafe(F.lit("provider_error")))
    return graded.rollup("task").agg(rate(F.col("failure").isNull()).alias("accuracy"), F.count("*").alias("n"))
