"""SentencePiece BPE encoding by a merge-type prefix table, and decoding."""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, documents_select, list_array, task, utf8

SPACE = "▁"
#: Chunks that a task remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Pairs of pieces that a worker remembers to be compatible or not, likewise.
PAIRS = 500_000
#: A chunk with more characters is not remembered.
SHORT = 64
#: A run of spaces with a word, a line break, or spaces at an end. No piece crosses these, so each is encoded alone.
_CHUNK = re.compile(" *[^ \n]+|\n| +")
#: The same where no piece has letters and other characters either: letters of a word, and what stands between them, are
#: chunks of their own, of which there are fewer different ones.
_FINER = re.compile(r" *[^\W\d_]+|\n| *(?:[^\w \n]|[\d_])+| +")
_LETTER = re.compile(r"[^\W\d_]")

codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))


class Bpe:
    """A SentencePiece model of BPE kind with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses a word's start")
        mixed = any(len(_LETTER.findall(p.replace(SPACE, ""))) not in (0, len(p.replace(SPACE, ""))) for p in self.ids)
        self.chunks = (_CHUNK if mixed else _FINER).findall
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if p.strip(SPACE):
                self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[str, str], bool] = {}
        self.spaces: dict[int, list[int]] = {}
        self.memory: dict[str, bytes] = {}
        self.remembered, self.pairs = REMEMBERED, PAIRS
        #: The text of each id. A byte above 127 stands as the lone surrogate that surrogateescape turns into it.
        self.texts = [p.replace(SPACE, " ") for p in self.pieces]
        for b, i in self.bytes.items():
            self.texts[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        for i in range(size):
            if model.is_control(i):
                self.texts[i] = ""
            elif model.is_unknown(i):
                self.texts[i] = " ⁇ "
        self.texts = np.array(self.texts, object)

    def merged(self, text: str) -> list[str]:
        """The pieces left when the best adjacent pair (highest score, then leftmost) is merged again and again:
        the definition, used for pairs of pieces and for runs of spaces."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the two pieces, side by side, are what their text is encoded as."""
        key = left, right
        if (known := self.compatible.get(key)) is None:
            if len(self.compatible) > self.pairs:
                self.compatible.clear()
            known = self.compatible[key] = self.merged(left + right) == [left, right]
        return known

    def word(self, text: str) -> list[int]:
        """The ids of a text with a space mark at its start at most. last[e] is the last piece of the encoding of
        text[:e]: of the pieces that end at e, the only one that is compatible with the last piece before it."""
        n = len(text)
        last: list[str | None] = [None] * (n + 1)
        known = self.compatible
        for end, (piece, size) in self.automaton.iter(text):  # by their ends
            if last[end + 1] is not None:
                continue
            s = end + 1 - size
            if s:
                key = last[s] or text[s - 1], piece
                if (ok := known.get(key)) is None:
                    ok = self.fits(*key)
                if ok:
                    last[end + 1] = piece
            elif self._whole(piece):
                last[end + 1] = piece
        out: list[int] = []
        e = n
        while e:
            piece = last[e] or text[e - 1]  # a character without a piece, or a space mark
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            else:
                out.extend(self.bytes[b] for b in reversed(piece.encode()))
            e -= len(piece)
        out.reverse()
        return out

    def _whole(self, piece: str) -> bool:
        """Whether the piece's own text is encoded as the piece."""
        key = piece, ""
        if (known := self.compatible.get(key)) is None:
            known = self.compatible[key] = self.merged(piece) == [piece]
        return known

    def run(self, n: int) -> list[int]:
        """The ids of n spaces in a row."""
        if n not in self.spaces:
            if n > 256:  # merges go from the left, so the run is cut into longest pieces
                head = self.run(256)
                whole = self.pieces[head[0]]
                k = (n - 256) // len(whole) + 1
                return [head[0]] * k + self.run(n - k * len(whole))
            self.spaces[n] = [self.ids[p] for p in self.merged(SPACE * n)]
        return self.spaces[n]

    def chunk(self, text: str) -> list[int]:
        """The ids of a chunk."""
        body = text.lstrip(" ")
        k = len(text) - len(body)
        if not body:
            return self.run(k)
        if k < 2:
            return self.word(SPACE * k + body)
        ids = self.word(SPACE + body)
        # marks are joined to letters before they are joined to each other
        return self.run(k - 1) + ids if ids[0] != self.ids[SPACE] else self.run(k) + ids[1:]

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers, one after another."""
        if not text:
            return b""
        parts = self.chunks(" " + text.replace(SPACE, " "))
        memory = self.memory
        found = list(map(memory.get, parts))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            c = parts[i]
            if (ids := memory.get(c)) is None:
                ids = np.array(self.chunk(c), "<i4").tobytes()
                if len(c) <= SHORT:
                    if len(memory) >= self.remembered:
                        memory.clear()
                    memory[c] = ids
            found[i] = ids
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """Pieces joined, space marks as spaces but for the dummy prefix, runs of bytes as UTF-8 with U+FFFD for
        each byte that is not part of a character."""
        text = "".join(self.texts[ids].tolist() if isinstance(ids, np.ndarray) else map(self.texts.__getitem__, ids))
        if len(ids) and self.pieces[ids[0]][:1] == SPACE:
            text = text[1:]
        if not text.isascii():
            try:
                text.encode()
            except UnicodeEncodeError:
                text = text.encode("utf-8", "surrogateescape").decode("utf-8", "one_by_one")
        return text


@functools.lru_cache(2)
def load(model_file: str, remembered: int = REMEMBERED, pairs: int = PAIRS) -> Bpe:
    bpe = Bpe(model_file)
    bpe.remembered, bpe.pairs = remembered, pairs
    return bpe


def encode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row: the ids of its whole text, without begin or end ids.

    A null text counts as empty and has no ids; ids of rows may be null or repeat; an empty table gives an empty
    result; other columns are not read. model_file is read on each executor."""
    kind = df.schema[id_col].dataType

    return documents_select(df, id_col, text_col).mapInArrow(task(_encoder(model_file, False)), f"id {kind.simpleString()}, ids array<int>")


def encode_decode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED, pairs: int = PAIRS) -> DataFrame:
    """(id, ids, text) for every row: decode(encode()), in one worker, so that ids travel once. A null text counts as empty and has no
    ids and an empty text; repeated rows give equal results; an empty table gives an empty one; other columns are not read. A worker remembers
    `remembered` chunks and `pairs` pairs of pieces at most; the result does not depend on them."""
    kind = df.schema[id_col].dataType
    return documents_select(df, id_col, text_col).mapInArrow(task(_encoder(model_file, True, remembered, pairs)), f"id {kind.simpleString()}, ids array<int>, text string")


def _encoder(model_file: str, back: bool, remembered: int = REMEMBERED, pairs: int = PAIRS):
    def run(batches):
        bpe = load(model_file, remembered, pairs)
        for b in batches:
            raw = utf8(b.column(1))
            for i, j in chunks(raw):
                ids = [np.frombuffer(bpe.packed(t.decode()), "<i4") for t in raw[i:j]]
                texts = [bpe.decode(x) for x in ids] if back else []
                columns = [b.column(0).slice(i, j - i), list_array(np.concatenate(ids), np.cumsum([0, *map(len, ids)]))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], ["id", "ids", "text"]) if back else pa.RecordBatch.from_arrays(columns, ["id", "ids"])
        bpe.memory.clear()  # the worker outlives the task

    return run


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(id, ids, text) for every row of encode()'s result; null ids count as none."""
    kind = encoded.schema["id"].dataType

    def run(batches):
        bpe = load(model_file)
        for b in batches:
            ids = b.column(1)
            flat, at = ids.flatten().to_numpy(), np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())))
            texts = [bpe.decode(flat[s:e]) for s, e in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(texts, pa.string())], ["id", "ids", "text"])

    return encoded.select("id", "ids").mapInArrow(task(run), f"id {kind.simpleString()}, ids array<int>, text string")
