"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each position the automaton's output links give every piece that ends there; each relaxes the best score of
its end. A character that no piece covers costs the least piece score less 10 and is written as byte pieces. Ties
go to the piece that starts first. Where no piece holds a word boundary inside (checked at load), words are
independent and their encodings are kept in a bounded table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import list_array, map_texts

MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Words whose encodings a worker keeps, and their greatest length; the table starts afresh beyond the first, longer words are not kept.
KEPT_WORDS, KEPT_LENGTH = 700_000, 64


class Codec:
    """Encoder and decoder over (piece, score) rows; ids are positions. `bytes_at` is the id of byte piece 0, or None."""

    def __init__(self, pieces: list[tuple[str, float]], plain: Iterable[bool], bytes_at: int | None, unknown: int = 0):
        self.pieces, self.bytes_at, self.unknown = pieces, bytes_at, unknown
        plain = list(plain)
        self.scores = np.array([s for _, s in pieces], np.float64)
        least = min((s for (_, s), ok in zip(pieces, plain, strict=True) if ok), default=0.0)
        self.lost = least - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        usable = [p for (p, _), ok in zip(pieces, plain, strict=True) if ok and p]
        for i, ((p, s), ok) in enumerate(zip(pieces, plain, strict=True)):
            if ok and p:
                self.automaton.add_word(p, (len(p), i, s))
        if usable:
            self.automaton.make_automaton()
        self.empty = not usable
        self.split = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+") if not any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in usable) else None
        self.kept: dict[str, tuple[bytes, float]] = {}
        self.raw = [p.replace(MARK, " ").encode() for p, _ in pieces]
        if bytes_at is not None:
            for b in range(256):
                self.raw[bytes_at + b] = bytes([b])
        for i, ok in enumerate(plain):
            if not ok and not (bytes_at is not None and bytes_at <= i < bytes_at + 256):
                self.raw[i] = b""

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation of a marked text."""
        n, lost = len(text), self.lost
        best, start, piece = [0.0] + [-1e300] * n, [0] * (n + 1), [-1] * (n + 1)
        end, alone = 0, True  # all before `end` is final; `alone`: a piece covers the one character that ends there

        def uncovered(upto: int) -> None:
            """Close `end` and the ends after it that no piece reaches: their last character may go uncovered."""
            if not alone and best[end - 1] + lost > best[end]:
                best[end], start[end], piece[end] = best[end - 1] + lost, end - 1, -1
            for e in range(end + 1, upto):
                best[e], start[e], piece[e] = best[e - 1] + lost, e - 1, -1

        # the links give the pieces of one end from the longest to the shortest
        for last, (length, i, s) in () if self.empty else self.automaton.iter(text):
            if last >= end:
                uncovered(last + 1)
                end, alone = last + 1, False
            score = best[end - length] + s
            if score > best[end]:
                best[end], start[end], piece[end] = score, end - length, i
            if length == 1:
                alone = True
        uncovered(n + 1)
        ids: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            elif self.bytes_at is None:
                ids.append(self.unknown)
            else:
                ids += [self.bytes_at + b for b in reversed(text[start[at] : at].encode())]
            at = start[at]
        return ids[::-1], best[n]

    def _word(self, word: str) -> tuple[bytes, float]:
        ids, score = self.viterbi(word)
        got = (np.array(ids, "<i4").tobytes(), score)
        if len(word) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            self.kept[word] = got
        return got

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        """Ids and score of a text; a word mark stands for each space and before the first character."""
        if not text:
            return np.empty(0, np.int32), 0.0
        marked = MARK + text.replace(" ", MARK)
        if self.split is None:
            ids, score = self.viterbi(marked)
            return np.array(ids, np.int32), score
        words = self.split.findall(marked)
        got = list(map(self.kept.get, words))
        if None in got:
            got = [g if g is not None else self.kept.get(w) or self._word(w) for g, w in zip(got, words, strict=True)]
        ids, scores = zip(*got, strict=True)
        return np.frombuffer(b"".join(ids), np.int32), sum(scores)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 give replacement characters. The first word mark goes."""
        out = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


_CODECS: dict[str, Codec] = {}
#: What any usual normaliser changes: a ligature, a wide letter, two blanks, one at the end.
_PROBE = "\ufb01 \uff21  b "


def load(model_file: str) -> Codec:
    """The codec of a sentencepiece model file; kept once in each process. An error if the model has a normaliser of its own."""
    if model_file not in _CODECS:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if sp.normalize(_PROBE) != MARK + _PROBE.replace(" ", MARK):
            raise ValueError(f"{model_file} normalises texts")
        n = sp.get_piece_size()
        pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(n)]
        at = next((i for i in range(n) if sp.is_byte(i)), None)
        _CODECS[model_file] = Codec(pieces, plain, at, sp.unk_id())
    return _CODECS[model_file]


def encode(docs: DataFrame, model_file: str, keep: dict[str, Column], text: Column) -> DataFrame:
    """`keep` columns with ids (array<int>), n_tokens, score and round_trip (decoding the ids gives the text back).

    Null and empty texts have no ids, score 0 and round_trip true. Texts that hold U+2581 decode with spaces in
    its place, so round_trip is false. Of equal scores the piece that starts first wins, so repeated rows have equal ids; each is returned.
    Very long texts are taken whole, word by word where the pieces allow it. An empty table gives an empty result.
    """

    def make():
        codec = load(model_file)

        def work(column):
            texts = [t or "" for t in column.to_pylist()]
            got = [codec.encode(t) for t in texts]
            lengths = np.array([len(i) for i, _ in got], np.int64)
            back = [codec.decode(i.tolist()) == t for (i, _), t in zip(got, texts, strict=True)]
            flat = np.concatenate([i for i, _ in got]) if got else np.empty(0, np.int32)
            return [list_array(flat, lengths, pa.int32()), pa.array(lengths), pa.array([s for _, s in got], pa.float64()), pa.array(back, pa.bool_())]

        return work

    return map_texts(docs, text, keep, "ids array<int>, n_tokens long, score double, round_trip boolean", make)


def decode(rows: DataFrame, model_file: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """`rows` with the decoded text of their ids; null for null."""

    @F.pandas_udf("string")
    def text_of(column):
        codec = load(model_file)
        return column.map(lambda x: None if x is None else codec.decode(x))

    return rows.withColumn(name, text_of(F.col(ids)))


def tokenize(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_tokens, score, round_trip, ids; see `encode` for odd texts.

    Rows without an id and repeated rows are each returned; an empty table gives an empty result. Other columns are not read.
    """
    return encode(docs, model_file, {"doc_id": F.col(id_col)}, F.col(text_col)).select("doc_id", "n_tokens", "score", "round_trip", "ids")
