"""Byte-level BPE ids by the tokenizers library, with a table of words already encoded.

The usual byte-level split never joins characters across the start of " word" or of a line where all white space
is single, so such texts are taken apart into words at once, and the library encodes only words that the table lacks.
Any other text goes through the library as a whole. Words in the table are told apart by all their bytes.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from quern.llm.common import LANES, Texts, byte_table, lane_hashes, mix, word_lanes, word_spans

#: Words in the table, and ids in all; beyond either, those that were met but once or have many ids go. A word takes about 45 bytes.
KEPT_WORDS, KEPT_IDS, KEPT_LENGTH = 1_500_000, 16 << 20, 16
_SLOTS = 1 << 22
#: Signs that the split keeps apart from letters before them.
_SIGNS = ".,;:!?$%&*#()|"
_INSIDE = byte_table(lambda b: b not in (0x0A, 0x20))
#: White space beside blanks and line feeds that is one byte long.
_ODD = byte_table(lambda b: b in (0x09, 0x0B, 0x0C, 0x0D) or 0x1C <= b <= 0x1F)


def _irregular(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has white space that is not one blank or line feed between two words."""
    n = len(offsets) - 1
    out = np.zeros(n, bool)
    if not len(data):
        return out
    gap = ~_INSIDE[data]
    bad = _ODD[data]
    bad[1:] |= gap[1:] & gap[:-1]
    for lead, follow in ((0xC2, ((0x85,), (0xA0,))), (0xE1, ((0x9A, 0x80),)), (0xE2, (*((0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F))), (0xE3, ((0x80, 0x80),))):
        at = np.flatnonzero(data == lead)
        after = [data[np.minimum(at + k, len(data) - 1)] for k in (1, 2)]
        for f in follow:
            bad[at[np.logical_and.reduce([a == x for a, x in zip(after, f, strict=False)])]] = True
    at = np.flatnonzero(bad)
    out[np.searchsorted(offsets, at, "right") - 1] = True
    full = np.flatnonzero(np.diff(offsets))
    out[full] |= gap[offsets[full]] | gap[offsets[full + 1] - 1]
    return out


class Table:
    """Token lists of words: by their lanes and tag (length and what stands before) in open addressing, all words of a call
    together; words that the lanes do not hold whole by their bytes."""

    def __init__(self, kind: str):
        self.slots = np.full(_SLOTS, -1, np.int32)
        self.first, self.last, self.tag = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint8)
        self.starts, self.ids, self.n, self.used = np.zeros((1 << 16) + 1, np.int64), np.zeros(1 << 16, kind), 0, 0
        self.again = np.zeros(KEPT_WORDS + (1 << 20), bool)  # entries that were found after they were entered
        self.long: dict[tuple[bytes, bool], int] = {}

    def find(self, keys: np.ndarray, first: np.ndarray, last: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Entry of each word, -1 where missing; keys are hashes of the words."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        slot = (keys & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(left):
            held = self.slots[slot]
            some = held >= 0
            left, slot, held = left[some], slot[some], held[some]
            hit = (self.first[held] == first[left]) & (self.last[held] == last[left]) & (self.tag[held] == tag[left])
            out[left[hit]] = held[hit]
            left, slot = left[~hit], (slot[~hit] + 1) & (_SLOTS - 1)
        met = out[out >= 0]
        self.again[met[met < len(self.again)]] = True
        return out

    def slim(self) -> Table:
        """A table of the entries that were met again and have at most KEPT_LENGTH ids, at most half of KEPT_WORDS; long words go."""
        entry = np.flatnonzero(self.again[: self.n] & (self.tag[: min(self.n, len(self.again))] > 0))
        sizes = self.starts[entry + 1] - self.starts[entry]
        entry, sizes = entry[sizes <= KEPT_LENGTH][: KEPT_WORDS // 2], sizes[sizes <= KEPT_LENGTH][: KEPT_WORDS // 2]
        new = Table(self.ids.dtype.str)
        if len(entry):
            at = np.repeat(self.starts[entry] - np.cumsum(sizes) + sizes, sizes)
            at += np.arange(len(at))
            entries = new.add(self.ids[at], sizes)
            new.enter(entries, word_keys(self.first[entry], self.last[entry], self.tag[entry]), self.first[entry], self.last[entry], self.tag[entry])
        return new

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New entries, with their ids one after the other and how many each has."""
        need = self.n + len(sizes)
        while need > len(self.tag):
            for name in ("first", "last", "tag"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
            self.starts = np.concatenate([self.starts, np.zeros(len(self.tag) + 1 - len(self.starts), np.int64)])
        total = len(ids)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(total, len(self.ids)), self.ids.dtype)])
        self.ids[self.used : self.used + total] = ids
        self.starts[self.n + 1 : need + 1] = self.used + np.cumsum(sizes)
        entries = np.arange(self.n, need)
        self.n, self.used = need, self.used + total
        return entries

    def enter(self, entries: np.ndarray, keys: np.ndarray, first: np.ndarray, last: np.ndarray, tag: np.ndarray) -> None:
        """Make entries found under distinct words that are missing."""
        self.first[entries], self.last[entries], self.tag[entries] = first, last, tag
        slot = (keys & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            won = self.slots[slot] == entries
            entries, slot = entries[~won], (slot[~won] + 1) & (_SLOTS - 1)


def word_keys(first: np.ndarray, last: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Hashes of words by lanes and tag."""
    return mix(lane_hashes(first, last, tag >> 1) + (tag & 1))


class Encoder:
    """Ids of texts in a little-endian integer type."""

    def __init__(self, path: str, kind: str = "<i4", special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kind = np.dtype(kind)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.special = [] if special_as_text else [t["content"] for t in spec.get("added_tokens") or []]
        self.line = self._whole("\n")
        self.by_word = bool(split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor") and len(self.line) == 1)
        self.table = Table(kind)
        self.signs: dict[str, np.ndarray] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)

    def _lines(self, words: list[str], before: str) -> list[np.ndarray]:
        """Encodings of before + word, for words without line feeds: they are the lines of one text."""
        if not words:
            return []
        got = self.library.encode_batch_fast(["\n".join([before + w for w in words])], add_special_tokens=False)[0]
        ids = np.array(got.ids, self.kind)
        return [x[k > 0 :] for k, x in enumerate(np.split(ids, np.flatnonzero(ids == self.line[0])))]

    def _words(self, words: list[str], before: str) -> list[np.ndarray]:
        """Encodings of distinct words. The split parts a run of letters from the signs behind it, so "word," is "word" and ","."""
        stems, asked = [], {}
        for w in words:
            stem = w.rstrip(_SIGNS)
            stem = stem if len(stem) < len(w) and stem.isalpha() and max(stem) < "\u0250" else w
            stems.append(stem)
            asked[stem] = None
        ids = dict(zip(asked, self._lines(list(asked), before), strict=True))
        out = []
        for w, stem in zip(words, stems, strict=True):
            own = ids[stem]
            if stem is not w:
                tail = w[len(stem) :]
                if tail not in self.signs:
                    if len(self.signs) > 100_000:
                        self.signs.clear()
                    self.signs[tail] = self._whole(tail)
                own = np.concatenate([own, self.signs[tail]])
            out.append(own)
        return out

    def _lists(self, words: list[str], follows: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and how many each has; `follows` tells those that follow a blank."""
        lists: list = [None] * len(words)
        for value, before in ((True, " "), (False, "")):
            own = [i for i, f in enumerate(follows) if bool(f) == value]
            for i, x in zip(own, self._words([words[i] for i in own], before), strict=True):
                lists[i] = x
        return np.concatenate(lists), np.array([len(x) for x in lists], np.int64)

    def _learn(self, data: np.ndarray, starts: np.ndarray, keys: np.ndarray, first: np.ndarray, last: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Entries of words, of which none is in the table yet."""
        _, at, back = np.unique(keys, return_index=True, return_inverse=True)
        rep = at[back]
        same = (first == first[rep]) & (last == last[rep]) & (tag == tag[rep])
        raw, sizes = data.tobytes(), (tag >> 1).astype(np.int64)
        words = [raw[a : a + n].decode("utf-8", "replace") for a, n in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)]
        entries = self.table.add(*self._lists(words, (tag[at] & 1).tolist()))
        self.table.enter(entries, keys[at], first[at], last[at], tag[at])
        out = entries[back]
        if not same.all():  # other words of the same hash
            rest = np.flatnonzero(~same)
            out[rest] = self.table.find(keys[rest], first[rest], last[rest], tag[rest])
            rest = rest[out[rest] < 0]
            if len(rest):
                out[rest] = self._learn(data, starts[rest], keys[rest], first[rest], last[rest], tag[rest])
        return out

    def _long(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Entries of words that are longer than the lanes."""
        raw, held = data.data, self.table.long
        keys = [(bytes(raw[a:b]), f) for a, b, f in zip(starts.tolist(), ends.tolist(), follows.tolist(), strict=True)]
        new = [k for k in dict.fromkeys(keys) if k not in held]
        if new:
            entries = self.table.add(*self._lists([w.decode("utf-8", "replace") for w, _ in new], [f for _, f in new]))
            held.update(zip(new, entries.tolist(), strict=True))
        return np.array([held[k] for k in keys], np.int64)

    def encode_column(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) one after the other, each followed by `end` if it is given, and how many each text has."""
        n, closing = len(column), end is not None
        if self.by_word:
            texts = Texts(column)
            whole = _irregular(texts.data, texts.offsets)
            whole |= [any(s in (t or "") for s in self.special) for t in column.to_pylist()] if self.special and any(s.encode() in texts.data.tobytes() for s in self.special) else False
        else:
            whole = np.ones(n, bool)
        lists: dict[int, np.ndarray] = {i: self._whole(column[i].as_py() or "") for i in np.flatnonzero(whole).tolist()}
        if not self.by_word or whole.all():
            entry = np.empty(0, np.int64)
            doc = lead = entry
        else:
            starts, ends, of = word_spans(texts.data, texts.offsets, _INSIDE)
            doc = np.repeat(np.arange(n), np.diff(of))
            use = ~whole[doc]
            starts, ends, doc = starts[use], ends[use], doc[use]
            opens = starts == texts.offsets[doc]
            follows = ~opens & (texts.data[np.maximum(starts - 1, 0)] == 0x20)
            lead = ~opens & ~follows  # a line feed stands before the word
            # a word at the start of a line is encoded as one at the start of a text
            if self.table.n > KEPT_WORDS or self.table.used > KEPT_IDS:
                self.table = self.table.slim()
            entry = np.full(len(starts), -1, np.int64)
            size = ends - starts
            short, long = np.flatnonzero(size <= LANES), np.flatnonzero(size > LANES)
            first, last, _ = word_lanes(texts.data, starts[short], ends[short])
            tag = (2 * size[short] + follows[short]).astype(np.uint8)
            keys = word_keys(first, last, tag)
            found = self.table.find(keys, first, last, tag)
            miss = np.flatnonzero(found < 0)
            if len(miss):
                found[miss] = self._learn(texts.data, starts[short[miss]], keys[miss], first[miss], last[miss], tag[miss])
            entry[short] = found
            if len(long):
                entry[long] = self._long(texts.data, starts[long], ends[long], follows[long])
        begin = self.table.starts[entry]
        long = self.table.starts[entry + 1] - begin
        wide = long + lead
        sizes = np.bincount(doc, weights=wide, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
        for i, x in lists.items():
            sizes[i] = len(x)
        sizes += closing
        out = np.empty(int(sizes.sum()), self.kind)
        ends_at = np.cumsum(sizes)
        if closing:
            out[ends_at - 1] = end
        if len(doc):
            # a word's place: its text's start and what stands before it in the text
            before = np.cumsum(wide) - wide
            first_word = np.r_[True, doc[1:] != doc[:-1]]
            place = (ends_at - sizes)[doc] + before - np.repeat(before[first_word], np.diff(np.r_[np.flatnonzero(first_word), len(doc)]))
            out[place[lead.astype(bool)]] = self.line[0]
            place = place + lead
            step = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
            out[np.repeat(place, long) + step] = self.table.ids[np.repeat(begin, long) + step]
        for i, x in lists.items():
            out[ends_at[i] - sizes[i] : ends_at[i] - closing] = x
        return out, sizes


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, kind: str = "<i4", special_as_text: bool = False) -> Encoder:
    """One encoder for each process and kind."""
    key = (path, kind, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
