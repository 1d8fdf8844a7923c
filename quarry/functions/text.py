"""Text column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a question that carry no keyword.
QUESTION_WORDS = ["what", "when", "where", "which", "who", "why", "how", "did", "does", "do", "is", "are", "was", "were", "am", "my", "me", "i", "you", "your", "the", "a", "an", "about", "tell", "say", "said", "show", "give", "please", "can", "could", "would", "any", "have", "has", "had"]
# Words that don't count when passages are ranked again.
RERANK_STOP = ["a", "about", "am", "and", "any", "are", "as", "at", "be", "did", "do", "does", "for", "from", "had", "has", "have", "i", "in", "is", "it", "me", "my", "of", "on", "or", "that", "the", "to", "was", "were", "what", "when", "which", "who", "why", "with", "you", "your"]
# Section names in the form they are shown.
SECTIONS = ["Chief Complaint", "History of Present Illness", "History", "Examination", "Physical Examination", "Assessment", "Assessment and Plan", "Medications", "Plan", "Allergies", "Review of Systems", "Family History", "Social History", "Vitals", "Impression", "Follow-up"]
# Words that stay small in a heading.
SMALL_WORDS = ["of", "and", "the", "in", "on", "for", "to", "a", "an"]
# What a question may open with, and the pattern of a heading.
GREETING = "(?i)^(hi|hello|hey)[,!.\\s]+"
SCAFFOLDING = "(?i)^(can you|could you|please|i want to know|tell me)\\s+"
HEADING = "^\\s*([A-Z][A-Z /&'\\-]{2,58})\\s*:?\\s*$"
PREAMBLE = "Preamble"


def words_of(names: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in names])


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the edges."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def normal_query(c: Column) -> Column:
    """Without greeting and scaffolding; a question that would be empty stays as it is."""
    out = F.trim(F.regexp_replace(F.regexp_replace(collapsed(c), GREETING, ""), SCAFFOLDING, ""))
    return F.when(out == "", F.trim(c)).otherwise(out)


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def keyword_terms(c: Column) -> Column:
    """Distinct tokens of two characters or more that are no question words."""
    return F.array_distinct(F.filter(tokens(c), lambda x: (F.length(x) > 1) & ~x.isin(QUESTION_WORDS)))


def rerank_terms(c: Column) -> Column:
    """Distinct tokens but the stop words."""
    return F.array_except(tokens(c), words_of(RERANK_STOP))


def passage_key(c: Column) -> Column:
    """What two copies of a passage have in common."""
    return F.trim(F.regexp_replace(F.lower(c), "\\s+", " "))


def token_estimate(c: Column) -> Column:
    """E5: four characters a token, one token at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def heading(line: Column) -> Column:
    """The section that a line names, in the form it is shown, or null."""
    bare = F.trim(F.regexp_replace(F.trim(line), ":+$", ""))
    known = F.create_map(*[F.lit(x) for s in SECTIONS for x in (s.upper(), s)])
    shown = F.array_join(F.transform(F.split(bare, "\\s+"), lambda w, i: F.when((i > 0) & F.lower(w).isin(SMALL_WORDS), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))), " ")
    found = F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, _: k == F.upper(bare))), F.lit(0)), F.when(line.rlike(HEADING), shown))
    return F.when((bare != "") & (F.length(bare) <= 60), found)


# Fixed value: what stands between sentences.
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z0-9])"


# Fixed value: spaces at the edges of a sentence, Unicode's too.
EDGE_SPACES = r"^\p{Zs}+|\p{Zs}+$"


def sentences(c: Column) -> Column:
    """Parts that begin with a capital or a digit after the end of a sentence, without spaces at their edges."""
    return F.filter(F.transform(F.split(c, SENTENCE_GAP), lambda x: F.regexp_replace(x, EDGE_SPACES, "")), lambda x: x != "")


def embedding_input(title: Column, day: Column, section: Column, text: Column) -> Column:
    """A header of title, date and section before the text; a date that the title has isn't said again, what is missing is left out."""
    title = F.nullif(title, F.lit(""))
    header = F.concat_ws(" — ", title, F.when(title.isNull() | ~F.contains(title, day), day), F.nullif(section, F.lit("")))
    return F.when(header == "", text).otherwise(F.concat(header, F.lit("\n"), text))


def rendered(name: str, kind: str) -> Column:
    """A value as text: null as NULL, decimals without trailing zeros, times to the minute, dates as they are."""
    c = F.col(name)
    if kind.startswith("decimal"):
        # zeros after the point go, and the point if nothing is left behind it
        shown = F.regexp_replace(F.regexp_replace(c.cast("string"), "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    elif kind.startswith("timestamp"):
        shown = F.date_format(c, "yyyy-MM-dd HH:mm")
    else:
        shown = c.cast("string")
    return F.coalesce(shown, F.lit("NULL"))


def pipe_row(df_types: list[tuple[str, str]]) -> Column:
    """A row's values between pipes, in the order of the columns."""
    return F.concat_ws(" | ", *[rendered(n, t) for n, t in df_types])


def source_block(number: Column, title: Column, section: Column, day: Column, text: Column) -> Column:
    """A numbered source as the context shows it."""
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.concat_ws(" — ", F.initcap(F.replace(title, F.lit("_"), F.lit(" "))), section, day), F.lit("\n"), text)


def human_date(c: Column) -> Column:
    """5 March 2024."""
    return F.date_format(c, "d MMMM yyyy")


def has_any(c: Column, phrases: list[str]) -> Column:
    """Whether one of the phrases stands in a text, whatever its case."""
    low = F.lower(c)
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out
