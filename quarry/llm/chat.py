"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, in turn order: ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn, a line feed
between turns. It is encoded once, with character offsets; the spans of the assistant's texts are sorted, and a token is in
the loss if a binary search of its offsets among them finds one. The three marks are tokens of their own, so no token reaches
across a text's border.

Escapes, undone by ``unescape``: between the ``<`` and the ``|`` that would open a mark inside a text, one backslash more than
stands there. Roles also have line feeds and backslashes escaped.

Rows are ordered by turn, then role, then text; null turns come first, null roles and texts are empty, repeated rows are kept.
Rows without a conversation id are one conversation. A conversation must fit a row, as it is one training example; nothing is
cut. An empty table gives an empty result. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import default_vocabulary

START, SEPARATOR, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_OPENING, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _OPENING.sub(lambda m: f"<{m[1]}\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of the texts of the trained role."""
    parts, spans, at = [], [], 0
    for k, (role, text) in enumerate(turns):
        head = ("\n" if k else "") + START + escape_role(role) + SEPARATOR
        body = escape(text)
        if role == trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, STOP]
        at += len(head) + len(body) + len(STOP)
    return "".join(parts), spans


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (rows of start, end) overlap one of the sorted, disjoint spans."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool)
    starts, ends = np.array(spans).T
    at = np.searchsorted(ends, offsets[:, 0], "right")
    inside = at < len(starts)
    return inside & (starts[np.minimum(at, len(starts) - 1)] < offsets[:, 1]) & (offsets[:, 1] > offsets[:, 0])


def masked_texts(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The stretches of the formatted text that masked tokens cover, one for each stretch, still escaped."""
    out, low, high = [], None, None
    for (a, b), m in zip(offsets.tolist(), mask.tolist(), strict=True):
        if not m:
            continue
        if low is not None and a > high:
            out.append(formatted[low:high])
            low = None
        if low is None:
            low, high = a, b
        high = max(high, b)
    return out + ([formatted[low:high]] if low is not None else [])


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted conversation was rendered from."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition(SEPARATOR)
        turns.append((unescape_role(role), unescape(rest[: rest.rindex(STOP)])))
    return turns


@lru_cache(2)
def marked_tokenizer(path: str):
    """The vocabulary with the three marks as tokens of their own, and offsets that keep white space."""
    from tokenizers import AddedToken, Tokenizer, processors

    out = Tokenizer.from_file(path)
    out.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, SEPARATOR, STOP)])
    out.post_processor = processors.ByteLevel(trim_offsets=False)
    return out


def format_conversations(conversations: DataFrame, vocabulary: str | None = None, trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, input_ids, token_starts and token_ends (characters), loss_mask."""
    path = vocabulary or default_vocabulary()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select("conv_id", F.struct("turn", text("role"), text("text")).alias("row"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([conversations.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("input_ids", ints), T.StructField("token_starts", ints), T.StructField("token_ends", ints), T.StructField("loss_mask", T.ArrayType(T.BooleanType()))])

    def encode(batches):
        own = marked_tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rendered = [render([tuple(t.values()) for t in turns], trained) for turns in some.column(1).to_pylist()]
                encoded = [own.encode(formatted, add_special_tokens=False) for formatted, _ in rendered]
                offsets = [np.array(e.offsets, np.int32).reshape(-1, 2) for e in encoded]
                masks = [loss_mask(o, spans) for o, (_, spans) in zip(offsets, rendered, strict=True)]
                arrays = [
                    some.column(0),
                    pa.array([len(t) for t in some.column(1).to_pylist()], pa.int64()),
                    pa.array([f for f, _ in rendered], pa.string()),
                    pa.array([e.ids for e in encoded], pa.list_(pa.int32())),
                    pa.array([o[:, 0] for o in offsets], pa.list_(pa.int32())),
                    pa.array([o[:, 1] for o in offsets], pa.list_(pa.int32())),
                    pa.array(masks, pa.list_(pa.bool_())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return whole.mapInArrow(encode, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations say: of their turns, and of all text under the loss mask."""
    schema = T.StructType([formatted.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def read(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in schema.names[1:]}
            for row in batch.drop_columns(["conv_id"]).to_pylist():
                turns = parse(row["formatted"])
                offsets = np.array([row["token_starts"], row["token_ends"]], np.int64).T
                loss = "".join(map(unescape, masked_texts(row["formatted"], offsets, np.array(row["loss_mask"], bool))))
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(row["formatted"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], pa.string() if c.endswith("sha256") else pa.int64()) for c in schema.names[1:])], names=schema.names)

    return formatted.select("conv_id", "formatted", "token_starts", "token_ends", "loss_mask").mapInArrow(read, schema)
