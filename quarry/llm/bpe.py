"""Byte-level BPE over batches: rank-synchronous merging of ragged arrays.

The pre-tokenizer's pattern is evaluated on whole byte buffers as class runs, so pre-tokens come out as spans without a
regular expression per text. Each distinct pre-token is merged once per worker: all new ones of a slice form one ragged
array of symbols, and in every round each sequence joins all places of its own lowest-ranked pair at once. Sequences
without a ranked pair left leave the round; long ones are cut into blocks that are sequences of their own, and their borders
mended. Pre-tokens are known by a 64-bit hash. Texts whose characters lie outside the stable part of the character table,
or that hold one of the vocabulary's special strings, are passed to the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import cached_property, lru_cache

import numpy as np

from .arrays import ragged, run_hashes, text_slices

LETTER, NUMBER, OTHER, WHITE, UNSURE = 0, 1, 2, 3, 4
#: Pre-tokens remembered by one worker; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Bytes from which a pre-token is merged in blocks, and those of a block.
LONG, BLOCK = 256, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def character_classes() -> np.ndarray:
    """Class of each code point up to U+1FFFF; UNSURE where versions of Unicode may differ, and beyond.

    What is no letter, number or space today was none before it was assigned either, so emoji are sure; letters and numbers
    are if Unicode 3.2 has them.
    """
    table = np.full(0x20000, UNSURE, np.uint8)
    white = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    of = {"L": LETTER, "N": NUMBER}
    for c in range(0x20000):
        now, then = unicodedata.category(chr(c))[0], unicodedata.ucd_3_2_0.category(chr(c))
        if c in white:
            table[c] = WHITE
        elif then[0] == now and now in of:
            table[c] = of[now]
        elif now in "SPM" and then[0] not in "LNZ":
            table[c] = OTHER
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = character_classes()
    out = table[:256][data]
    high = data >= 0x80
    if high.any():
        out[high] = UNSURE
        n = len(data)
        two = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        point = (data[two].astype(np.uint32) & 0x1F) << 6 | (data[np.minimum(two + 1, n - 1)] & 0x3F)
        for k in range(2):
            out[two + k] = table[point]
        three = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
        if len(three):
            point = (data[three].astype(np.uint32) & 0x0F) << 12 | (data[three + 1].astype(np.uint32) & 0x3F) << 6 | (data[three + 2] & 0x3F)
            for k in range(3):
                out[three + k] = table[point]
        four = np.flatnonzero(data >= 0xF0)
        if len(four):
            point = (data[four].astype(np.uint32) & 0x07) << 18 | (data[four + 1].astype(np.uint32) & 0x3F) << 12 | (data[four + 2].astype(np.uint32) & 0x3F) << 6 | (data[four + 3] & 0x3F)
            point = np.where(point < len(table), table[np.minimum(point, len(table) - 1)], UNSURE)
            for k in range(4):
                out[four + k] = point
    return out


def pre_tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the spans that the byte-level pre-tokenizer's pattern cuts, over all texts of a slice."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.empty(n, bool)
    cut[0] = True
    np.not_equal(classes[1:], classes[:-1], out=cut[1:])
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    cut |= text_start[:n]
    white = classes == WHITE
    # the first byte of each character: a cut may only stand there
    lead = (data & 0xC0) != 0x80
    # a white run followed by something else in its text gives its last character away: ' ' joins what follows, others stand alone
    follows = np.zeros(n, bool)
    follows[:-1] = white[:-1] & ~white[1:] & ~text_start[1:n]
    last = np.flatnonzero(follows)
    for _ in range(3):
        back = ~lead[last]
        if not back.any():
            break
        last = last - back
    joins = data[last] == 0x20
    cut[last] = True
    after = np.flatnonzero(follows)[joins] + 1
    cut[after] = False
    # contractions: a lone apostrophe at the start of a token and the letters after it
    mark = np.flatnonzero((data == 0x27) & cut)
    if len(mark):
        end = np.append(data, np.zeros(3, np.uint8))
        stop = np.append(text_start, np.ones(3, bool))
        a, b = end[mark + 1], end[mark + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & ~stop[mark + 1]
        two = ((a == 0x72) & (b == 0x65) | (a == 0x76) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)) & ~stop[mark + 1] & ~stop[mark + 2]
        for found, size in ((mark[one], 2), (mark[two & ~one], 3)):
            cut[found + 1] = False
            rest = found + size
            rest = rest[rest < n]
            # letters that follow start a token of their own; other classes start one anyway
            inner = rest[(classes[rest] == LETTER) & ~text_start[rest]]
            cut[inner] = True
    starts = np.flatnonzero(cut)
    return starts, np.diff(np.append(starts, n))


class Vocabulary:
    """The merge table of a tokenizers file, and the library's own encoder for texts that need it."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, ids = spec["model"], spec["model"]["vocab"]
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        self.size = max([*ids.values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        shown = byte_characters()
        self.byte_ids = np.array([ids[shown[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.width = np.ones(max(ids.values()) + 1, np.int64)
        for token, i in ids.items():
            self.width[i] = len(token)
        # open addressing in a numpy table: key -> rank
        self.bits = 19
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, len(pairs), np.int32)
        self.probes = 1
        keys, ranks = left << 20 | right, np.arange(len(pairs), dtype=np.int32)
        slot = self.slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            order = np.flatnonzero(free)
            _, first = np.unique(slot[order], return_index=True)
            put = order[first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], ranks[put]
            left_over = np.ones(len(keys), bool)
            left_over[put] = False
            keys, ranks, slot = keys[left_over], ranks[left_over], (slot[left_over] + 1) & (size - 1)
            self.probes += bool(len(keys))
        self.none = len(pairs)

    @cached_property
    def library(self):
        """The library's tokenizer, loaded once a text needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols, or ``none``."""
        keys = left.astype(np.int64) << 20 | right
        slot = self.slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ranks[slot], self.none).astype(np.int32)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot_ = slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slot_]
            hit = held == keys[open_]
            out[open_[hit]] = self.ranks[slot_[hit]]
            open_ = open_[(held >= 0) & ~hit]
        return out


def byte_characters() -> list[str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b], extra = chr(256 + extra), extra + 1
    return [out[b] for b in range(256)]


def merge_all(symbols: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merge ragged symbol sequences to the end; returns the surviving symbols and their count for each sequence.

    One round: the rank of every neighbouring pair, each sequence's lowest rank, and all places of that rank joined from
    left to right, in every sequence at once. A merge can only create pairs of higher rank, so this equals joining one
    pair at a time.
    """
    counts = lengths.astype(np.int64).copy()
    done_symbols: list[np.ndarray] = []
    done_owner: list[np.ndarray] = []
    owner = np.arange(len(lengths))
    sizes = counts.copy()
    while len(owner):
        starts = np.cumsum(sizes) - sizes
        seq = np.repeat(np.arange(len(owner)), sizes)
        rank = np.full(len(symbols), vocabulary.none, np.int32)
        inner = seq[1:] == seq[:-1]
        at = np.flatnonzero(inner)
        rank[at] = vocabulary.rank(symbols[at], symbols[at + 1])
        best = np.minimum.reduceat(rank, starts)
        live = best < vocabulary.none
        if not live.all():
            gone = ~live[seq]
            done_symbols.append(symbols[gone])
            done_owner.append(owner[~live])
            counts[owner[~live]] = sizes[~live]
            keep = ~gone
            symbols, rank, owner, sizes, best = symbols[keep], rank[keep], owner[live], sizes[live], best[live]
            if not len(owner):
                break
            seq = np.repeat(np.arange(len(owner)), sizes)
        hit = rank == best[seq]
        pos = np.flatnonzero(hit)
        # x x x: places of one pair that overlap are taken from the left, every other one
        if len(pos) > 1:
            linked = np.concatenate([[False], (pos[1:] == pos[:-1] + 1) & (seq[pos[1:]] == seq[pos[:-1]])])
            if linked.any():
                idx = np.arange(len(pos))
                head = np.maximum.accumulate(np.where(linked, 0, idx))
                pos = pos[(idx - head) % 2 == 0]
        symbols = symbols.copy()
        symbols[pos] = vocabulary.merged[best[seq[pos]]]
        keep = np.ones(len(symbols), bool)
        keep[pos + 1] = False
        sizes = sizes - np.bincount(seq[pos], minlength=len(sizes))
        symbols = symbols[keep]
    if not done_symbols:
        return symbols, counts
    flat, who = np.concatenate(done_symbols), np.concatenate(done_owner)
    place = np.empty(len(lengths), np.int64)
    begin = np.cumsum(counts[who]) - counts[who]
    place[who] = begin
    return flat[ragged(place, counts)], counts


def merge_long(symbols: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Merge one long sequence of byte symbols: blocks first, all at once, then what lies at their borders.

    A sequence of tokens is the right one if every two neighbours, merged from their bytes alone, come out as those two: the
    first merge across a border would otherwise happen between these two by themselves as well. Where two don't, the tokens
    around them are merged anew, more of them each time, until all borders hold. So the rounds see short sequences only.
    """
    sizes = np.full(-(-len(symbols) // BLOCK), BLOCK)
    sizes[-1] -= sizes.sum() - len(symbols)
    tokens, counts = merge_all(symbols, sizes, vocabulary)
    border, reach = np.cumsum(counts)[:-1] - 1, 2
    while len(border):
        ends = np.cumsum(vocabulary.width[tokens])
        starts = ends - vocabulary.width[tokens]
        lengths = ends[border + 1] - starts[border]
        again, n = merge_all(symbols[ragged(starts[border], lengths)], lengths, vocabulary)
        first = np.cumsum(n) - n
        wrong = n != 2
        wrong[~wrong] = again[first[~wrong]] != tokens[border[~wrong]]
        border = border[wrong]
        if not len(border):
            break
        low, high = np.maximum(border - reach + 1, 0), np.minimum(border + reach + 1, len(tokens))
        # stretches that meet become one
        new = np.ones(len(low), bool)
        new[1:] = low[1:] > np.maximum.accumulate(high)[:-1]
        low, high = low[new], np.maximum.reduceat(high, np.flatnonzero(new))
        lengths = ends[high - 1] - starts[low]
        again, n = merge_all(symbols[ragged(starts[low], lengths)], lengths, vocabulary)
        parts, at, k, border, made = [], 0, 0, [], 0
        for a, b, size in zip(low.tolist(), high.tolist(), n.tolist(), strict=True):
            made += a - at
            parts += [tokens[at:a], again[k : k + size]]
            border += [made - 1, made + size - 1]
            at, k, made = b, k + size, made + size
        tokens = np.concatenate([*parts, tokens[at:]])
        border = np.unique([x for x in border if 0 <= x < len(tokens) - 1]).astype(np.int64)
        reach *= 2
    return tokens


class Encoder:
    """Token ids and counts of whole texts, slice by slice; one per worker process."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32 if self.vocabulary.size > 65536 else np.uint16)

    def learn(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> None:
        """Merge pre-tokens that aren't known yet; hashes are sorted and distinct."""
        if len(self.known) + len(hashes) > REMEMBERED:
            self.forget()
        long = np.flatnonzero(lengths > LONG)
        short = np.flatnonzero(lengths <= LONG)
        flat, few = merge_all(self.vocabulary.byte_ids[data[ragged(starts[short], lengths[short])]], lengths[short], self.vocabulary)
        counts = np.zeros(len(lengths), np.int64)
        counts[short] = few
        if len(long):
            parts = np.split(flat, np.cumsum(few)[:-1]) if len(short) else []
            own = dict(zip(short.tolist(), parts, strict=True))
            for i in long.tolist():
                own[i] = merge_long(self.vocabulary.byte_ids[data[starts[i] : starts[i] + lengths[i]]], self.vocabulary)
                counts[i] = len(own[i])
            flat = np.concatenate([own[i] for i in range(len(lengths))])
        first = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.first = np.insert(self.first, at, first)
        self.count = np.insert(self.count, at, counts.astype(np.int32))

    def spans(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each pre-token and its entry among the known ones."""
        starts, lengths = pre_tokens(data, offsets, classes)
        hashes = run_hashes(data, starts, lengths)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        while True:
            at = np.searchsorted(self.known, distinct)
            new = np.ones(len(distinct), bool)
            inside = at < len(self.known)
            new[inside] = self.known[at[inside]] != distinct[inside]
            if not new.any():
                return starts, at[inverse]
            before = len(self.known)
            pick = where[new]
            if before + len(pick) > REMEMBERED and before:
                self.forget()
                continue
            self.learn(data, starts[pick], lengths[pick], distinct[new])

    def encode(self, column, with_ids: bool):
        """Yield (first row, row after the last, token counts, ids or None) over a string column; ids are concatenated."""
        for first, last, data, offsets in text_slices(column):
            classes = byte_classes(data)
            odd = np.zeros(last - first, bool)
            unsure = np.flatnonzero(classes == UNSURE)
            odd[np.searchsorted(offsets, unsure, "right") - 1] = True
            raw = data.tobytes()
            for mark in self.vocabulary.special:
                at = raw.find(mark)
                while at >= 0:
                    odd[np.searchsorted(offsets, at, "right") - 1] = True
                    at = raw.find(mark, at + 1)
            starts, entry = self.spans(data, offsets, classes)
            bounds = np.searchsorted(starts, offsets)
            sizes = self.count[entry]
            total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            counts = total[bounds[1:]] - total[bounds[:-1]]
            ids = self.flat[ragged(self.first[entry], sizes)] if with_ids else None
            if odd.any():
                rows = np.flatnonzero(odd)
                own = {}
                for r in rows:
                    text = raw[offsets[r] : offsets[r + 1]].decode("utf-8", "replace")
                    own[r] = np.array(self.vocabulary.library.encode(text, add_special_tokens=False).ids, np.int64)
                if with_ids:
                    edge = total[bounds]
                    parts, at = [], 0
                    for r in rows:
                        parts += [ids[at : edge[r]], own[r].astype(ids.dtype)]
                        at = edge[r + 1]
                    ids = np.concatenate([*parts, ids[at:]])
                for r in rows:
                    counts[r] = len(own[r])
            yield first, last, counts, ids


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The worker's encoder; worker processes are reused, so its memory of pre-tokens outlives a task."""
    return Encoder(path)
