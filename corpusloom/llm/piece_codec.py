"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's characters are symbols; the agenda holds the adjacent pairs whose joined symbol is a piece, best score first and the leftmost of equal scores first. The top
pair is joined, its new neighbours are put on the agenda, and entries whose symbols have changed since are passed over. Nothing can be joined across a place that no
piece spans: before a space mark that follows another character (unless some piece holds both), and at characters in no piece. The stretches between
those places are encoded for themselves, each distinct one once; the agendas of a batch's short stretches advance in step as arrays, a long stretch has a heap.
Texts are cut, put together from their stretches' ids and decoded as arrays: Python meets a distinct stretch of a batch, never each of its places.
Each Arrow batch is checked against the sentencepiece library: a difference is an error and never a result.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import read_table
from ._text import chunks

SPACE = "▁"
#: Fixed values of the model format: kinds of pieces and of models, and the text of an unknown piece.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
UNKNOWN_TEXT = " ⁇ "
#: Characters of the stretches whose ids a Python worker remembers, beyond which it begins anew; those of an agenda that is held in arrays; bytes of text in a step.
CACHE_CHARS = 1 << 24
SHORT = 32
STEP_BYTES = 1 << 22
#: New stretches in one text for the library; stretches whose agendas advance together.
CHECKED = 128
ABREAST = 1 << 14
NONE = np.int32(2**31 - 1)
HASHED = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of characters where texts are cut: in no piece, in pieces, the mark if no piece has it behind another character.
STRANGE, KNOWN, MARK = 0, 1, 2
CODES = "doc_id long, ids array<int>, decoded string"


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a serialised message: integers, bytes or 4-byte floats."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            at += size
            yield key >> 3, data[at - size : at]
        else:
            size = 4 if key & 7 == 5 else 8
            at += size
            yield key >> 3, struct.unpack("<f" if size == 4 else "<d", data[at - size : at])[0]


def one_bad_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("piece_codec.bytes", one_bad_byte)


def packed(ids: tuple[int, ...]) -> bytes:
    return np.array(ids, dtype=np.int32).tobytes()


class Vocabulary:
    """Pieces of a model file with scores and kinds; encodes normalised texts and decodes ids."""

    def __init__(self, model: bytes, cache_chars: int = CACHE_CHARS):
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.unused: set[str] = set()
        self.byte_id: list[int] = [-1] * 256
        self.unknown, self.strip, self.strip_all = 0, True, True
        self.table: list[bytes] = []
        self.kinds: list[int] = []
        self.user_id: dict[str, int] = {}
        kind_of_model = 1
        for number, value in fields(model):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in fields(value):
                    piece, score, kind = (v.decode() if k == 1 else piece), (v if k == 2 else score), (v if k == 3 else kind)
                self._add(piece, score, kind)
            elif number == 2:
                kind_of_model = dict(fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(fields(value))
                self.strip_all = bool(spec.get(4, 1))
                self.strip = bool(spec.get(3, 1)) or self.strip_all
        if kind_of_model != MERGES:
            raise ValueError("the model's vocabulary is not of the merge type")
        self.fallback = min(self.byte_id) >= 0
        self.user = re.compile("|".join(map(re.escape, sorted(self.user_id, key=len, reverse=True)))) if self.user_id else None
        letters = set(chain.from_iterable(self.score)) - {SPACE}
        known = "".join(map(re.escape, sorted(letters)))
        apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        own = f"{SPACE}*[{known}]+|{SPACE}+" if apart else f"[{known}{SPACE}]+"
        self.stretches = re.compile(f"{own}|[^{known}{SPACE}]+" if known else r"(?s:.)+")
        self.kind_of_char = np.full(0x110000, STRANGE, dtype=np.uint8)
        self.kind_of_char[[ord(c) for c in letters]] = KNOWN
        self.kind_of_char[ord(SPACE)] = (MARK if apart else KNOWN) if known else STRANGE
        self.ids: dict[str, bytes] = {}  # 4 bytes an id
        self.limit, self.chars = cache_chars, 0
        self._pairs()
        self._texts()

    def _add(self, piece: str, score: float, kind: int) -> None:
        number = len(self.table)
        self.kinds.append(kind)
        if kind == BYTE:
            value = int(piece[3:5], 16)
            self.byte_id[value] = number
            self.table.append(bytes([value]))
        elif kind == CONTROL:
            self.table.append(b"")
        elif kind == UNKNOWN:
            self.unknown = number
            self.table.append(UNKNOWN_TEXT.encode())
        else:
            self.table.append(piece.replace(SPACE, " ").encode())
            self.score[piece], self.id_of[piece] = score, number
            if kind == USER_DEFINED:
                self.user_id[piece] = number
            if kind == UNUSED:
                self.unused.add(piece)

    def merged(self, stretch: str) -> tuple[int, ...]:
        """Ids of a stretch of characters: joins by the agenda until no pair is left on it."""
        symbols: list[str | None] = list(stretch)
        n, score = len(symbols), self.score
        following, leading = list(range(1, n + 1)), list(range(-1, n - 1))
        parts: dict[str, tuple[str, str]] = {}  # of pieces that may be joined, but not stay
        agenda: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            joined = symbols[left] + symbols[right]
            s = score.get(joined)
            if s is not None:
                heapq.heappush(agenda, (-s, left, right, len(joined)))
                if joined in self.unused:
                    parts[joined] = (symbols[left], symbols[right])

        for left in range(n - 1):
            offer(left, left + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != size:
                continue
            symbols[left], symbols[right] = a + b, None
            after = following[left] = following[right]
            if after < n:
                leading[after] = left
                offer(left, after)
            if leading[left] >= 0:
                offer(leading[left], left)
        return tuple(chain.from_iterable(self._ids(s, parts) for s in symbols if s is not None))

    def _ids(self, symbol: str, parts: dict[str, tuple[str, str]]) -> list[int]:
        out, waiting = [], [symbol]
        while waiting:
            s = waiting.pop()
            if s in parts:
                waiting += reversed(parts[s])
            elif s in self.id_of:
                out.append(self.id_of[s])
            elif self.fallback:
                out += [self.byte_id[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def _pairs(self) -> None:
        """Symbols as numbers, and for each pair of symbols that makes a piece its number and the rank of its score, times SHORT."""
        names = list(self.score) + sorted(set(chain.from_iterable(self.score)) - self.score.keys())
        number = {s: k for k, s in enumerate(names)}
        rank = {v: k * SHORT for k, v in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        for s, k in number.items():
            if len(s) == 1:
                self.of_char[ord(s)] = k
        self.piece_id = np.array([self.id_of.get(s, -1) for s in names] + [-1], dtype=np.int32)
        rows = [(number[p[:k]] * len(names) + number[p[k:]], rank[v], number[p]) for p, v in self.score.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        table = np.array(rows + [(-1, 0, 0)], dtype=np.int64)
        self.pair_keys = np.ascontiguousarray(table[:, 0])
        self.pair_ranks, self.pair_numbers = (table[:, k].astype(np.int32) for k in (1, 2))
        self.n_symbols = len(names)
        self.bits = max(8, len(rows).bit_length() + 4)
        self.slots = np.full((1 << self.bits) + len(table), len(rows), dtype=np.int32)
        waiting, slots = np.arange(len(rows)), self._slots(self.pair_keys)
        while len(waiting):
            free = waiting[self.slots[slots[waiting]] == len(rows)]
            self.slots[slots[free]] = free
            waiting = waiting[self.slots[slots[waiting]] != waiting]
            slots[waiting] += 1

    def _texts(self) -> None:
        """Bytes of the pieces, and those of a piece that begins a text; which pieces leave it open where the text begins."""
        bare = [t[1:] if self.strip and kind not in (BYTE, UNKNOWN, CONTROL) and t[:1] == b" " else t for t, kind in zip(self.table, self.kinds, strict=True)]
        self.pieces = pa.array(self.table + bare, pa.large_binary())
        self.open = np.array([self.strip and (kind == CONTROL or self.strip_all and not t) for t, kind in zip(bare, self.kinds, strict=True)], dtype=bool)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where the numbers of pairs begin to be looked for: there, or in the next slots until one is free."""
        return (keys.astype(np.uint64) * HASHED >> np.uint64(64 - self.bits)).astype(np.int64)

    def _looked_up(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places on the agenda (NONE where the pair makes no piece) and numbers of joined pairs."""
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.n_symbols + right, -2)
        slots = self._slots(keys)
        at = self.slots[slots]
        hit = self.pair_keys[at] == keys
        others = np.flatnonzero(~hit & (at < len(self.pair_keys) - 1))
        while len(others):
            slots[others] += 1
            at[others] = found = self.slots[slots[others]]
            hit[others] = self.pair_keys[found] == keys[others]
            others = others[~hit[others] & (found < len(self.pair_keys) - 1)]
        return np.where(hit, self.pair_ranks[at] + place, NONE), self.pair_numbers[at]

    def _abreast(self, stretches: list[str]) -> list[bytes]:
        """Ids of stretches of at most SHORT characters: a column each, of a cell a character; every round joins the top of each column's agenda."""
        sizes = np.fromiter(map(len, stretches), dtype=np.int64, count=len(stretches))
        n, height = len(stretches), int(sizes.max()) + 1  # the last row stays without symbols
        symbols = np.full((n, height), -1, dtype=np.int32)
        symbols[np.arange(height) < sizes[:, None]] = self.of_char[np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        strange = (symbols >= 0).sum(axis=1) < sizes
        symbols = np.ascontiguousarray(symbols.T).reshape(-1)
        cells = np.arange(len(symbols))
        place = (cells // n).astype(np.int32)
        following, leading = cells + n, cells - n
        leading[:n] += len(cells)
        agenda, joined = np.full(len(cells), NONE), np.zeros(len(cells), dtype=np.int32)
        agenda[:-n], joined[:-n] = self._looked_up(symbols[:-n], symbols[n:], place[:-n])
        while True:
            top = agenda.reshape(height, n).min(axis=0)
            column = np.flatnonzero(top < NONE)
            if not len(column):
                break
            left = top[column] % SHORT * np.int64(n) + column
            right = following[left]
            after, before = following[right], leading[left]
            symbols[left], symbols[right], agenda[right] = joined[left], -1, NONE
            following[left], leading[after] = after, left
            agenda[left], joined[left] = self._looked_up(symbols[left], symbols[after], place[left])
            agenda[before], joined[before] = self._looked_up(symbols[before], symbols[left], place[before])
        symbols = symbols.reshape(height, n).T
        left = symbols >= 0
        ids, ends = self.piece_id[symbols[left]], np.append(0, np.cumsum(left.sum(axis=1)))
        strange[np.searchsorted(ends, np.flatnonzero(ids < 0), "right") - 1] = True
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [packed(self.merged(s)) if odd else data[a:b] for s, odd, a, b in zip(stretches, strange.tolist(), ends[:-1], ends[1:], strict=True)]

    def merged_in_step(self, stretches: list[str]) -> list[tuple[int, ...]]:
        """``merged`` of stretches of at most SHORT characters."""
        return [tuple(np.frombuffer(x, dtype=np.int32).tolist()) for x in self._abreast(stretches)]

    def learn(self, stretches: list[str]) -> list[str]:
        """Encode the distinct stretches that are not remembered; returns them."""
        new = [s for s in stretches if s not in self.ids]
        self.chars += sum(map(len, new)) + 16 * len(new)
        if self.chars > self.limit:
            self.ids.clear()
            new = list(stretches)
            self.chars = sum(map(len, new)) + 16 * len(new)
        short = sorted((s for s in new if len(s) <= SHORT and s not in self.user_id and not self.unused), key=len)
        for k in range(0, len(short), ABREAST):
            self.ids.update(zip(short[k : k + ABREAST], self._abreast(short[k : k + ABREAST]), strict=True))
        for s in new:
            if s not in self.ids:
                self.ids[s] = packed((self.user_id[s],) if s in self.user_id else self.merged(s))
        return new

    def cut(self, normal: str) -> list[str]:
        """The stretches of a normalised text; what the user defined is one by itself."""
        if self.user is None:
            return self.stretches.findall(normal)
        out, at = [], 0
        for found in chain(self.user.finditer(normal), [None]):
            out += self.stretches.findall(normal, at, found.start() if found else len(normal))
            if found:
                out.append(found[0])
                at = found.end()
        return out

    def _cut_all(self, normal: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
        """Stretches of all texts, and the number of the first one of each text."""
        if self.user is not None:
            lists = [self.cut(t) for t in normal]
            return pa.array(list(chain.from_iterable(lists)), pa.large_string()), np.append(0, np.cumsum([len(x) for x in lists], dtype=np.int64))
        text = "".join(normal)
        data = text.encode()
        kinds = self.kind_of_char[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
        ends = np.append(0, np.cumsum([len(t) for t in normal], dtype=np.int64))
        begins = np.ones(len(kinds) + 1, dtype=bool)
        begins[1:-1] = (kinds[1:] != kinds[:-1]) & ((kinds[:-1] != MARK) | (kinds[1:] != KNOWN))
        begins[ends] = True
        at = np.flatnonzero(begins)
        offsets = np.append(np.flatnonzero(np.frombuffer(data, dtype=np.uint8) & 0xC0 != 0x80), len(data))[at]
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets), pa.py_buffer(data)), np.searchsorted(at, ends)

    def encoded(self, normal: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of normalised texts one after another, where those of each text begin, and the stretches that were encoded for them."""
        stretches, first = self._cut_all(normal)
        which = stretches.dictionary_encode()
        distinct = which.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = self.learn(distinct)
        held = list(map(self.ids.__getitem__, distinct))
        ends = np.append(0, np.cumsum([len(x) for x in held], dtype=np.int64)) // 4
        taken = pa.LargeListArray.from_arrays(ends, np.frombuffer(b"".join(held), dtype=np.int32)).take(which.indices)
        ids, offsets = taken.flatten().to_numpy(zero_copy_only=False), taken.offsets.to_numpy()[first]
        if not self.fallback:  # unknown characters in a row are one unknown piece
            kept = np.ones(len(ids), dtype=bool)
            kept[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
            kept[offsets[:-1][offsets[:-1] < len(ids)]] = True
            ids, offsets = ids[kept], np.append(0, np.cumsum(kept))[offsets]
        return ids, offsets, new

    def encode_all(self, normal: list[str]) -> tuple[list[list[int]], list[str]]:
        """Ids of normalised texts, and the stretches that were encoded for them."""
        ids, offsets, new = self.encoded(normal)
        return self.split(ids, offsets), new

    @staticmethod
    def split(ids: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
        numbers, ends = ids.tolist(), offsets.tolist()
        return [numbers[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the first space mark goes if encoding puts one there; bytes that are no UTF-8 give U+FFFD each."""
        table = list(map(self.table.__getitem__, ids))
        if self.strip:
            for k, i in enumerate(ids):
                if self.kinds[i] == CONTROL:
                    continue
                if self.kinds[i] not in (BYTE, UNKNOWN) and table[k][:1] == b" ":
                    table[k] = table[k][1:]
                    if self.strip_all and not table[k]:
                        continue
                break
        return b"".join(table).decode("utf-8", "piece_codec.bytes")

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """``decode`` of each text's ids."""
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        which = ids.copy()
        which[first] += len(self.table)
        pieces = self.pieces.take(pa.array(which))
        ends, data = np.frombuffer(pieces.buffers()[1], dtype=np.int64)[offsets].tolist(), memoryview(pieces.buffers()[2] or b"")
        out = [str(data[a:b], "utf-8", "piece_codec.bytes") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for k in np.flatnonzero(offsets[:-1] < offsets[1:])[self.open[ids[first]]].tolist():
            out[k] = self.decode(ids[offsets[k] : offsets[k + 1]].tolist())
        return out


@lru_cache(maxsize=2)
def loaded(model_path: str) -> tuple:
    """Vocabulary and library of a model file, once in a Python worker."""
    import sentencepiece

    model = Path(model_path).read_bytes()
    return Vocabulary(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def check(own: Vocabulary, library, texts: list[str]) -> None:
    """Raise unless ids and decoded texts are those of the library."""
    if not texts:  # the library decodes an empty list to an empty text, not to an empty list
        return
    expected = library.encode(texts, num_threads=1)
    ids, offsets, _ = own.encoded([library.normalize(t) for t in texts])
    if own.split(ids, offsets) != expected or own.decode_all(ids, offsets) != library.decode(expected, num_threads=1):
        raise RuntimeError("ids or decoded texts differ from the library's")


def coded(model_path: str, whole: bool):
    """Arrow function (doc_id, text) to ids and decoded texts. All stretches new to a worker are checked against the library, or each whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, library = loaded(model_path)
        for batch in batches:
            for part in chunks(batch, "text", STEP_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, offsets, new = own.encoded([library.normalize(t) for t in texts])
                check(own, library, texts if whole else ["".join(new[k : k + CHECKED]).replace(SPACE, " ") for k in range(0, len(new), CHECKED)])
                lists = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(own.decode_all(ids, offsets), pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def piece_codes(docs: DataFrame, model_path: str, check_whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row: the ids of its whole text without begin and end, and the text that they decode to.

    ``model_path`` is a model file of the merge type that every executor has under that path. Null and empty texts have no ids and decode to an empty text;
    white space and characters outside the vocabulary follow the model's rules (bytes or the unknown piece). Rows without an id and repeated
    rows are encoded each; other columns are not read. The job fails where the library differs: on the stretches that a Python worker meets for the first time
    (put together to a text for each batch), or with ``check_whole`` on every whole text, which costs about as much again.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(coded(model_path, check_whole), CODES)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = piece_codes(read_table(spark, sf_dir, "documents"), default_model())
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
