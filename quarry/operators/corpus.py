"""Training-corpus preparation and grading."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.scratch import written

# Phrases that decline, that speculate, that narrate reasoning, and that say nothing is known.
DECLINES = ["i am not able", "i'm not able", "i can only help", "cannot help with", "can't help with", "not something i can", "please speak to your care team", "raise it with your care team", "i cannot provide", "i can't provide", "unable to", "not able to answer"]
SPECULATION = ["likely", "probably", "should be around", "i'd estimate", "i would estimate", "you can expect", "typically", "usually around", "my prediction"]
NARRATION = ["let me think", "first, i", "step 1", "my reasoning", "i'll start by", "<think>"]
DENIALS = ["not in the record", "nothing on record", "no ", "cannot predict"]
# What may stand before a surname, and the shortest surname that is looked for after it.
TITLES = "dr|doctor|mr|mrs|ms|miss|patient"
LEAST_SURNAME = 4
#: Runs of letters and digits of any alphabet, and of the characters that a regular expression counts as a word's.
WORD, NAME_WORD = "[\\p{L}\\p{N}]+", "(?U)\\w+"
ASCII_WORD = "[a-z0-9]+"
#: A brace that may open an object; white space, and a token of JSON if there is one.
JSON_OPENING = re.compile(r'[{](?=[ \t\n\r]*["}])')
JSON_TOKEN = re.compile(r'[ \t\n\r]*("[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity|[]{}[:,])?')
FIGURE = "\\b\\d+(?:\\.\\d+)?\\b"


def seeded_order(column: str, seed: int) -> Column:
    """An order that looks random and is the same everywhere."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def stratified_sample(cases: DataFrame, size: int) -> DataFrame:
    """Cases taken from each category in turn (case_id, category). The limit is global, so the last order is too."""
    turn = F.row_number().over(Window.partitionBy("category").orderBy("case_id"))
    return cases.withColumn("turn", turn).orderBy("turn", "category").limit(size)


def split_by_template(df: DataFrame, seed: int = 7, share: float = 0.15) -> DataFrame:
    """A split for each row; all rows of a template share one, and each task gives validation and test their part."""
    templates = df.select("task", "template_id").distinct()
    n = F.count("*").over(Window.partitionBy("task"))
    rank = F.row_number().over(Window.partitionBy("task").orderBy(seeded_order("template_id", seed), "template_id"))
    held = F.when(n >= 3, F.greatest(F.lit(1), F.bround(n * share).cast("int"))).otherwise(0)
    named = templates.withColumn("split", F.when(rank <= held, "test").when(rank <= 2 * held, "val").otherwise("train"))
    return df.join(named, ["task", "template_id"])


def split_manifest(df: DataFrame) -> DataFrame:
    """Rows and templates of each split and task."""
    return df.groupBy("split", "task").agg(F.count("*").alias("n"), F.count_distinct("template_id").alias("n_templates"))


def template_overlap(df: DataFrame) -> DataFrame:
    """Templates in more than one split."""
    return df.groupBy("template_id").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def task_weights(df: DataFrame) -> DataFrame:
    """Each task's weight, the largest task's count over its own."""
    counts = df.groupBy("task").agg(F.count("*").alias("n"))
    largest = counts.agg(F.max("n").alias("largest"))
    return counts.join(F.broadcast(largest)).select("task", "n", F.round(F.col("largest") / F.col("n"), 3).alias("weight"))


def balance_warnings(df: DataFrame, share: float = 0.6, least: int = 10) -> DataFrame:
    """Tasks with too large a share or too few rows."""
    counts = df.groupBy("task").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    out = counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total"))
    return out.select("task", "n", F.when(F.col("share") > share, "skewed").when(F.col("n") < least, "thin").alias("warning")).where("warning is not null")


def oversample(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Each row as often as its task's weight says, rounded half up, once at least."""
    whole = F.floor("weight")
    copies = F.greatest(F.lit(1), whole) + (F.col("weight") - whole >= 0.5).cast("int")
    return df.join(weights.select("task", "weight"), "task").withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("weight")


def expand_templates(templates: DataFrame, vocabularies: dict[str, DataFrame]) -> DataFrame:
    """Each template with every choice of its slots; vocabularies are lists of words (word)."""
    out = templates
    for slot, words in vocabularies.items():
        mark = F.lit("{" + slot + "}")
        with_slot = out.where(F.contains("text", mark)).join(words).withColumn("text", F.replace(F.col("text"), mark, F.col("word"))).drop("word")
        out = out.where(~F.contains("text", mark)).unionByName(with_slot)
    return out


def malformed_rows(corpus: DataFrame) -> DataFrame:
    """Chat rows that aren't system, user, assistant, or have an empty text."""
    roles = F.transform("messages", lambda m: m["role"])
    wrong = (F.size("messages") != 3) | ~roles.eqNullSafe(F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))) | F.exists("messages", lambda m: m["content"].isNull() | (F.trim(m["content"]) == ""))
    return corpus.where(wrong)


#: Texts of one partition where whole texts are dealt.
DEALT = 2_000
#: Rows of a table of tokens, grams or phrases that is broadcast at most; larger ones are shuffled.
BROADCAST = 500_000


def _sized(df: DataFrame) -> DataFrame:
    """With a broadcast hint, if it is small enough."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def _grams(column: str, n: int) -> Column:
    """The distinct strings of n characters in a row, overlapping ones too, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1)))


def contains_join(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_id, term_id) where a text has a term, in any case and inside longer words as well.

    An index of trigrams: each term stands under the trigram that fewest texts have (shorter terms under themselves), texts are
    looked up by theirs, and what is found is verified. Grams that no term has are dropped where they are made. Whole texts are
    shuffled once, for the verification, and only those with a candidate. Empty terms are in no text; terms with the same text are
    found together. Ids of texts are unique.
    """
    held = texts.select("text_id", F.lower("text").alias("text"))
    own = terms.select("term_id", F.lower("term").alias("term")).where("term <> ''")
    distinct = own.select("term").distinct()
    lengths = {r["n"] for r in distinct.select(F.least(F.char_length("term"), F.lit(3)).alias("n")).distinct().collect()}
    found = []
    for n in sorted(lengths - {3}):
        # such a term is its own gram
        short = distinct.where(F.char_length("term") == n)
        found.append(held.select("text_id", F.explode(_grams("text", n)).alias("term")).join(_sized(short), "term"))
    if 3 in lengths:
        cut = distinct.where(F.char_length("term") >= 3).select("term", F.explode(_grams("term", 3)).alias("gram"))
        grams = held.select("text_id", F.explode(_grams("text", 3)).alias("gram"))
        often = grams.join(_sized(cut.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
        # a gram that no text has settles its term
        rarest = written(cut.join(often, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).getField("gram").alias("gram")), "rarest")
        asked = grams.join(_sized(rarest), "gram").groupBy("text_id").agg(F.collect_set("term").alias("asked"))
        found.append(held.join(asked, "text_id").select("text_id", F.explode(F.filter("asked", lambda x: F.contains("text", x))).alias("term")))
    if not found:
        return texts.select("text_id").join(own.select("term_id")).where("false")
    return reduce(DataFrame.unionByName, found).join(_sized(own), "term").select("text_id", "term_id")


def postings(texts: DataFrame, word: str, columns: tuple[str, ...] = ("text_id",), text: str = "text") -> DataFrame:
    """The words of lower-cased texts: the given columns, of (how many), at (0, 1, ...), token, the one before it (prior), and what stands before and after it."""
    low = F.lower(text)
    tokens, gaps = F.regexp_extract_all(low, F.lit(word), F.lit(0)), F.split(low, word, -1)
    # all in one array, so that nothing is worked out for each word again
    zipped = F.arrays_zip(F.array_repeat(F.size(tokens), F.size(tokens)).alias("of"), tokens.alias("token"), F.concat(F.array(F.lit(None).cast("string")), tokens).alias("prior"), F.slice(gaps, F.lit(1), F.size(tokens)).alias("before"), F.slice(gaps, F.lit(2), F.size(tokens)).alias("after"))
    return texts.select(*columns, F.posexplode(zipped).alias("at", "x")).select(*columns, "at", "x.*").where("token is not null")


def phrases_found(posted: DataFrame, phrases: DataFrame, word: str) -> DataFrame:
    """Where phrases (key, phrase) stand in posted texts: text_id, key, first and last word, the word before (prior) and the gap to it, what comes after, and the columns ``start`` and ``stop`` of their words, if posted.

    A phrase is its words and what stands between them; what it has before its first and after its last word must be there too, and
    no other word right beside that. Words of texts that no phrase has are dropped where they are made. A phrase of one word is found
    where that stands; words of longer ones are joined by token, and those that follow one another are put together.
    """
    own = _sized(postings(phrases, word, ("key",), "phrase").drop("prior").withColumnsRenamed({"of": "n", "at": "k", "before": "lead", "after": "trail"}))
    both = posted.join(own, "token")
    opening = F.endswith("before", F.col("lead")) & ((F.col("lead") == "") | (F.length("before") > F.length("lead")) | (F.col("at") == 0))
    closing = F.startswith("after", F.col("trail")) & ((F.col("trail") == "") | (F.length("after") > F.length("trail")) | (F.col("at") == F.col("of") - 1))
    fits = F.when(F.col("k") == 0, opening).otherwise(F.col("before") == F.col("lead")) & ((F.col("k") < F.col("n") - 1) | closing)
    head, last = F.col("k") == 0, F.col("k") == F.col("n") - 1
    values = {"prior": F.when(head, F.col("prior")), "gap": F.when(head, F.col("before")), "rest": F.when(last, F.substr("after", F.length("trail") + 1))}
    edges = {"start": F.col("start") - F.when(head, F.length("lead")).otherwise(0), "stop": F.col("stop") + F.when(last, F.length("trail")).otherwise(0)} if "start" in posted.columns else {}
    place = ["text_id", "key", (F.col("at") - F.col("k")).alias("first_at")]
    single = both.where(fits & (F.col("n") == 1)).select(*place, F.col("at").alias("last_at"), *[v.alias(c) for c, v in (values | edges).items()])
    if phrases.where(F.size(F.regexp_extract_all(F.lower("phrase"), F.lit(word), F.lit(0))) > 1).isEmpty():
        return single
    joined = both.where(fits & (F.col("n") > 1)).groupBy(*place, "n").agg(F.count("*").alias("words"), *[(F.min if c == "start" else F.max)(v).alias(c) for c, v in (values | edges).items()]).where("words = n")
    return single.unionByName(joined.withColumn("last_at", F.col("first_at") + F.col("n") - 1).drop("n", "words"))


def name_leaks(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, name_id) where a text has a full name (name_id, name), as contains_join finds it, or its surname after a title or the first name.

    Surnames are looked up in the words of the texts; one counts where the word before it is a title or the first name, with at most a
    full stop and white space between. A first name that is no plain word is looked up with its places and joined. A surname alone is
    no leak. Ids of texts are unique.
    """
    parts = F.split(F.trim(F.lower("name")), "(?U)\\s+")
    named = names.where(F.size(parts) > 1).select("name_id", F.get(parts, F.lit(0)).alias("first"), F.regexp_replace(F.element_at(parts, -1), "(?U)^\\W+|\\W+$", "").alias("surname")).where(F.length("surname") >= LEAST_SURNAME)
    named = named.withColumn("plain", F.rlike("first", F.lit(f"^{NAME_WORD}$")))
    posted = postings(texts, NAME_WORD)
    near = lambda c: F.rlike(c, F.lit("(?U)^\\.?\\s+$"))
    surnames = phrases_found(posted, named.select(F.struct("name_id", "first", "plain").alias("key"), F.col("surname").alias("phrase")), NAME_WORD).where(near("gap"))
    called = F.col("key.plain") & (F.col("prior") == F.col("key.first"))
    found = [surnames.where(F.col("prior").isin(TITLES.split("|")) | called).select("text_id", "key.name_id")]
    odd = named.where("not plain").select(F.col("name_id").alias("key"), F.col("first").alias("phrase"))
    if not odd.isEmpty():
        firsts = phrases_found(posted, odd, NAME_WORD).where(near("rest")).select("text_id", F.col("key").alias("name_id"), (F.col("last_at") + 1).alias("first_at"))
        found.append(surnames.where("not key.plain").select("text_id", "key.name_id", "first_at").join(firsts, ["text_id", "name_id", "first_at"]).drop("first_at"))
    full = contains_join(texts, names.select(F.col("name_id").alias("term_id"), F.trim("name").alias("term"))).withColumnRenamed("term_id", "name_id")
    return reduce(DataFrame.unionByName, [full, *found]).distinct()


def window_leaks(texts: DataFrame, terms: DataFrame, n: int = 3) -> DataFrame:
    """(text_id, term_id, n_windows) where a text has some n words that follow one another in a term, wherever they stand in it; a shorter term is one window."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    cut = lambda df, key, m: df.where(F.size("words") >= m).select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " ")))).alias("window"))
    held, asked = texts.select("text_id", words("text").alias("words")), terms.select("term_id", words("term").alias("words"))
    found = []
    for m in range(1, n + 1):
        wanted = cut(asked if m == n else asked.where(F.size("words") == m), "term_id", m)
        found.append(cut(held, "text_id", m).join(wanted, "window").select("text_id", "term_id"))
    return reduce(DataFrame.unionByName, found).groupBy("text_id", "term_id").agg(F.count("*").alias("n_windows"))


def pair_leaks(texts: DataFrame, pairs: DataFrame, window: int = 40) -> DataFrame:
    """Texts where two values stand as words within a window of characters, in either order (pair_id, first, second).

    Texts are dealt once by their id, whole, and all steps keep to that: words get their places, those that no value has are dropped,
    values are looked up, and ends of the one and starts of the other are put in order for each text and pair, so that values that
    occur very often aren't all paired. Ids of texts are unique.
    """
    values = [pairs.select(F.struct("pair_id", F.lit(side).alias("side")).alias("key"), F.col(side).alias("phrase")) for side in ("first", "second")]
    values = values[0].unionByName(values[1])
    words = postings(values, ASCII_WORD, ("key",), "phrase").select("token").distinct()
    spark = texts.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, texts.count() // DEALT)
    posted = postings(texts.repartition(n, "text_id"), ASCII_WORD).drop("prior")
    stop = F.sum(F.length("before") + F.length("token")).over(Window.partitionBy("text_id").orderBy("at"))
    posted = posted.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("token")).withColumn("prior", F.lit(None).cast("string")).join(_sized(words), "token", "left_semi")
    found = phrases_found(posted, values, ASCII_WORD).select("text_id", "key.*", "start", "stop")
    marks = F.inline(F.array(F.struct(F.col("stop").alias("place"), F.lit(True).alias("ends")), F.struct(F.col("start").alias("place"), F.lit(False).alias("ends"))))
    marks = found.select("text_id", "pair_id", "side", marks)
    before = Window.partitionBy("text_id", "pair_id").orderBy("place").rangeBetween(-window, -1)
    ended = lambda side: F.count_if(F.col("ends") & (F.col("side") == side)).over(before) > 0
    near = ~F.col("ends") & F.when(F.col("side") == "first", ended("second")).otherwise(ended("first"))
    return marks.withColumn("near", near).where("near").select("text_id", "pair_id").distinct()


def narration(texts: DataFrame) -> DataFrame:
    """Texts that narrate reasoning."""
    return texts.where(X.has_any(F.col("text"), NARRATION))


def _object_at(text: str, at: int, closed: dict[int, int], failed: set[int]) -> None:
    """Read JSON from an opening brace on: notes where objects that close end (closed), or, if it breaks off, which were open (failed)."""
    stack, wants = [at], "key or end"
    at += 1
    while stack:
        m = JSON_TOKEN.match(text, at)
        token, at = m[1], m.end()
        inside = stack[-1]
        if token is None:
            break
        first = token[0]
        if first == '"' and wants[0] == "k":
            wants = "colon"
        elif first == ":" and wants == "colon":
            wants = "value"
        elif first == "," and wants == "end":
            wants = "key" if inside >= 0 else "value"
        elif first in "}]" and wants[-3:] == "end" and (first == "}") == (inside >= 0):
            stack.pop()
            if inside >= 0:
                closed[inside] = at
            wants = "end"
        elif wants[0] == "v" and first == "{":
            stack.append(m.start(1))
            wants = "key or end"
        elif wants[0] == "v" and first == "[":
            # arrays are known by a negative number
            stack.append(-1)
            wants = "value or end"
        elif wants[0] == "v" and first not in "}]:,":
            wants = "end"
        else:
            break
    failed.update(stack)


def first_object(text: str | None) -> str | None:
    """The first JSON object of a text, however deep: that with the earliest opening brace from which a whole object can be read.

    What was read for one brace settles those inside it as well, whether they closed or were open when it broke off, so only braces
    inside strings are read from again, and the time grows with the length.
    """
    text = text or ""
    closed: dict[int, int] = {}
    failed: set[int] = set()
    for opening in JSON_OPENING.finditer(text):
        at = opening.start()
        if at not in closed and at not in failed:
            _object_at(text, at, closed, failed)
        if at in closed:
            return text[at : closed[at]]
    return None


def extract_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The first object in a text, fenced or among prose, as a column ``parsed``; null if there is none."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    return df.withColumn("parsed", F.from_json(find(F.regexp_replace(column, "```(json)?", "")), schema))


def grade_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """Outcomes (expected, got: maps from key to value): missing key, wrong value, or right."""
    wrong = F.lit(None).cast("string")
    for k in reversed(keys):
        want, have = F.element_at("expected", F.lit(k)), F.element_at("got", F.lit(k))
        wrong = F.when(want.isNotNull() & have.isNull(), "missing_key").when(want.isNotNull() & (F.lower(F.trim(want)) != F.lower(F.trim(have))), "wrong_value").otherwise(wrong)
    return df.withColumn("failure", F.when(F.col("got").isNull(), "invalid_json").otherwise(wrong))


def grade_refusal(df: DataFrame) -> DataFrame:
    """Whether an answer declines exactly where it should."""
    should, did = X.has_any(F.col("expected"), DECLINES), X.has_any(F.col("got"), DECLINES)
    return df.withColumn("failure", F.when(should & ~did, "complied").when(~should & did, "refused_wrongly"))


def grade_grounding(df: DataFrame) -> DataFrame:
    """Whether an answer speculates, lacks a figure, or makes one up where nothing is known."""
    figures = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(FIGURE), F.lit(0)))
    missing = F.size(F.array_except(figures("expected"), figures("got"))) > 0
    invented = X.has_any(F.col("expected"), DENIALS) & (F.size(figures("expected")) == 0) & (F.size(figures("got")) > 0)
    return df.withColumn("failure", F.when(X.has_any(F.col("got"), SPECULATION), "ungrounded").when(missing, "wrong_value").when(invented, "ungrounded"))
