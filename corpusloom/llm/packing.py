"""Mixture-controlled packing by deficit round-robin.

Documents are tokenised once into a table in the shared folder and dealt to parts by the hash of their id,
so that each part holds every source in about its share. In a part, each source has a queue; each window of
``seq_len`` tokens credits every source with its target share and is filled from the queues of the largest
deficit. What a source was given too little or too much is carried into the next window, and, through sums
over all earlier parts, into the next part.
"""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import read_table, stored
from ._text import LOWER, chunks, looked_up, raw_bytes

EOS = 2
SEQ_LEN = 4096
#: Tokens of a part, about; a part is what one task packs.
PART_TOKENS = 1_000_000
#: Parts at most: beyond, they grow.
MAX_PARTS = 50_000
#: A task holds queues of about so many tokens, besides single longer documents.
BUFFER_TOKENS = 4_000_000
#: A source that is served gets so many tokens at least.
MIN_PIECE = 64
#: Distinct pieces that a worker remembers, at most; bytes of text that are encoded together.
CACHED_PIECES, TOGETHER = 1_000_000, 4 << 20
#: Words of letters that are encoded together.
LINE = 512
#: Classes of bytes: letters, digits, other ASCII signs, spaces and line feeds; 0 for others (other white space is the tokenizer's business).
LETTER, DIGIT, SIGN, BREAK = 1, 2, 3, 4
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[0x21:0x7F] = SIGN
KINDS[0x30:0x3A] = DIGIT
KINDS[0x41:0x5B] = KINDS[0x61:0x7B] = LETTER
KINDS[[0x20, 0x0A]] = BREAK
#: Whether a piece begins at a byte, by 8 times its class and the class of the byte before: after a break, where two known classes meet, at each digit.
BEGINS = np.zeros(256, dtype=bool)
for _now in range(4):
    for _before in range(5):
        BEGINS[8 * _now + _before] = _before == BREAK or _now and _before and (_now != _before or _now == DIGIT)
# The parts of a tokenizer's file under which a text may be cut at white space and between those classes.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUT_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUT_PRE_TOKENIZERS = [{"type": "Split", "pattern": {"Regex": CUT_PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def may_cut(spec: dict) -> bool:
    """Whether a tokenizer's file says that its tokens cross neither white space nor a change between letters, digits and signs."""
    model = spec.get("model") or {}
    return (
        (spec.get("normalizer") or {}).get("normalizers") == CUT_NORMALIZERS
        and (spec.get("pre_tokenizer") or {}).get("pretokenizers") == CUT_PRE_TOKENIZERS
        and model.get("type") == "BPE" and not model.get("dropout") and model.get("end_of_word_suffix") == "</w>"
        and not any(spec.get(k) for k in ("truncation", "padding", "post_processor"))
        and all("|" in x["content"] and not (x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] or set(x["content"]) & set(" \n")) for x in spec.get("added_tokens") or ())
    )


def pieces_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes without spaces and line feeds, A-Z in lower case; where their pieces begin in them, the end at last; the first piece of each text.

    Chunks with an apostrophe or a bar stay whole and keep their capitals. The two bytes of U+00C0 to U+00FF, but for the signs among them, are letters.
    """
    raw, offsets = raw_bytes(texts)
    if not len(raw):
        return raw, np.zeros(1, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    kinds = looked_up(raw, KINDS).copy()
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kinds[lead] = kinds[lead + 1] = LETTER
    before = np.empty_like(kinds)
    before[1:], before[0] = kinds[:-1], BREAK
    heads = offsets[:-1][np.diff(offsets) > 0]
    before[heads] = BREAK
    begins = looked_up((kinds << 3) + before, BEGINS).copy()
    data = looked_up(raw, LOWER).copy()
    special = np.flatnonzero((raw == 0x27) | (raw == 0x7C))
    if len(special):
        # the chunk around each such sign: from the last byte after a break to the next break or text
        edges = np.flatnonzero((before == BREAK) | (kinds == BREAK))
        at = np.searchsorted(edges, special, side="right")
        firsts, lasts = edges[at - 1], np.append(edges, len(raw))[at]
        for a, b in set(zip(firsts.tolist(), lasts.tolist(), strict=True)):
            begins[a + 1 : b], data[a:b] = False, raw[a:b]
    kept = kinds != BREAK
    place = np.cumsum(kept, dtype=np.int32 if len(kept) < 2**31 else np.int64)
    starts = np.flatnonzero(begins)
    return data[kept], np.append(place[starts] - 1, place[-1]).astype(np.int64), np.searchsorted(starts, offsets)


class Encoder:
    """Ids of texts.

    Where the tokenizer's file allows it (``may_cut``), a text is cut into pieces at white space and where classes of signs
    meet; each distinct piece, compared byte for byte, is encoded once and then looked up. Chunks with an apostrophe (contractions) or a bar
    (special tokens) stay whole; in all others A-Z is in lower case, as the vocabulary has it. With another tokenizer whole texts are encoded.
    """

    def __init__(self, path: str, eos: int):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer, self.eos, self.cuts = Tokenizer.from_file(path), eos, may_cut(spec)
        size = max([eos, *self.tokenizer.get_vocab().values()]) + 1
        # the same merges without normalisation, for words that are ASCII letters in lower case already
        self.light = Tokenizer(self.tokenizer.model)
        self.light.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.type = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends_word = np.zeros(size, dtype=bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.used = np.array([self.eos], dtype=self.type), 1
        self.starts, self.sizes, self.count = np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64), 1  # by entry; entry 0 is the end

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after another, and how many each has.

        Words of letters are encoded in lines: each has at least one token that ends a word, so a line of as many ends as words has
        one in each. Where a line has more, and for all other pieces, they are encoded one by one.
        """
        sizes, parts, order, alone = [], [], [], []
        kinds: dict[bool | None, list[int]] = {True: [], False: [], None: alone}
        for k, x in enumerate(pieces):
            kinds[x.isascii() if x.isalpha() else None].append(k)
        for letters, tokenizer in ((kinds[True], self.light), (kinds[False], self.tokenizer)):
            lines = [letters[i : i + LINE] for i in range(0, len(letters), LINE)]
            got = tokenizer.encode_batch_fast([" ".join([pieces[k] for k in own]) for own in lines], add_special_tokens=False)
            for own, line in zip(lines, (np.array(x.ids, dtype=self.type) for x in got), strict=True):
                ends = np.flatnonzero(self.ends_word[line]) + 1
                if len(ends) == len(own) and ends[-1] == len(line):
                    parts.append(line)
                    sizes.append(np.diff(ends, prepend=0))
                    order += own
                else:
                    alone += own
        for k in alone:
            parts.append(np.array(self.plain(pieces[k]), dtype=self.type))
        sizes.append(np.array([len(x) for x in parts[len(parts) - len(alone) :]], dtype=np.int64))
        order = np.array(order + alone, dtype=np.int64)
        size, start = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        size[order] = flat = np.concatenate(sizes)
        start[order] = np.cumsum(flat) - flat
        return gathered(np.concatenate([*parts, self.pool[:0]]), start, size), size

    def learn(self, pieces: list[bytes]) -> None:
        ids, sizes = self.encoded([x.decode() for x in pieces])
        self.known.update(zip(pieces, range(self.count, self.count + len(pieces)), strict=True))
        self.starts = grown(self.starts, self.count, self.used + np.cumsum(sizes) - sizes)
        self.sizes = grown(self.sizes, self.count, sizes)
        self.pool = grown(self.pool, self.used, ids)
        self.count, self.used = self.count + len(pieces), self.used + len(ids)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, each with the end at last, one after another, and where each text's begin and end."""
        if not self.cuts:
            rows = [np.array([*self.plain(x or ""), self.eos], dtype=self.type) for x in texts.to_pylist()]
            return np.concatenate([*rows, self.pool[:0]]), np.cumsum([0, *map(len, rows)])
        data, offsets, firsts = pieces_of(texts)
        if self.count > CACHED_PIECES:
            self.clear()
        pieces = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = bytes_of(pieces.dictionary)
        entry = np.fromiter(map(self.known.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        fresh = np.flatnonzero(entry < 0)
        if len(fresh):
            entry[fresh] = self.count + np.arange(len(fresh))
            self.learn([distinct[k] for k in fresh.tolist()])
        # entry 0 of this batch is the end
        starts, sizes = self.starts[np.append(0, entry)], self.sizes[np.append(0, entry)]
        rows = np.insert(np.asarray(pieces.indices).astype(np.int64) + 1, firsts[1:], 0)
        size = sizes[rows]
        bounds = np.concatenate([[0], np.cumsum(size)])
        return gathered(self.pool, starts[rows], size), bounds[np.concatenate([[0], firsts[1:] + np.arange(1, len(firsts))])]


def bytes_of(values: pa.Array) -> list[bytes]:
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    data = values.buffers()[2].to_pybytes() if values.buffers()[2] is not None else b""
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of all, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def grown(values: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``values`` with ``more`` from place ``used`` on; its room doubles when it is full."""
    if used + len(more) > len(values):
        values = np.concatenate([values[:used], np.zeros(used + len(more), dtype=values.dtype)])
    values[used : used + len(more)] = more
    return values


_encoders: dict[tuple[str, int], Encoder] = {}


def tokenise(path: str, eos: int):
    """Rows (doc_id, source, text) to (doc_id, source, n, ids); ids are little-endian with ``eos`` last, of 16 bits where the vocabulary allows it, else 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((path, eos)) or _encoders.setdefault((path, eos), Encoder(path, eos))
        width = encoder.type.itemsize
        for batch in batches:
            for part in chunks(batch, "text", TOGETHER):
                ids, bounds = encoder.batch(part.column(2))
                packed = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(bounds)), packed.cast(pa.binary())], names=["doc_id", "source", "n", "ids"])

    return run


class Packer:
    """Deficit round-robin over the source queues of one part."""

    def __init__(self, part: int, seq_len: int):
        self.part, self.seq_len = part, seq_len
        self.share: dict[str, float] = {}
        self.deficit: dict[str, float] = {}
        self.queues: dict[str, deque] = {}
        self.waiting = 0
        self.sequence = part << 32
        self.rows: list[tuple] = []

    def weigh(self, source: str, share: float, deficit: float) -> None:
        self.share[source], self.deficit[source] = share, deficit

    def put(self, source: str, doc_id: int | None, ids: np.ndarray) -> None:
        self.queues.setdefault(source, deque()).append([doc_id, ids, 0])
        self.deficit.setdefault(source, 0.0)
        self.waiting += len(ids)

    def fill(self, size: int) -> None:
        """One sequence of ``size`` tokens, from the queues of the largest deficit first."""
        for s, share in self.share.items():
            self.deficit[s] += size * share
        offset = 0
        while offset < size:
            active = sum(self.share.get(x, 0.0) for x in self.queues) or 1.0
            for s in sorted(self.queues, key=lambda x: (-self.deficit[x], x)):
                if offset == size:
                    break
                # its deficit, or its share of a window among the sources that have something left
                own = self.deficit[s] if self.deficit[s] >= MIN_PIECE else size * self.share.get(s, 0.0) / active
                offset += self.serve(s, min(size - offset, max(MIN_PIECE, int(own))), offset, size)
        self.sequence += 1

    def serve(self, source: str, quantum: int, offset: int, size: int) -> int:
        """Move up to ``quantum`` tokens of a source into the sequence; how many it had."""
        queue, given = self.queues[source], 0
        while queue and given < quantum:
            item = queue[0]
            doc_id, ids, start = item
            take = min(quantum - given, len(ids) - start)
            self.rows.append((doc_id, start, take, ids[start : start + take].astype("<u4").tobytes(), len(ids), source, self.sequence, offset + given, size))
            item[2] = start + take
            given += take
            if item[2] == len(ids):
                queue.popleft()
        if not queue:
            del self.queues[source]
        self.deficit[source] -= given
        self.waiting -= given
        return given

    def drain(self, keep: int) -> None:
        """Full sequences while more than ``keep`` tokens wait; at the end (0) the rest in sequences that are powers of two."""
        while self.waiting > max(keep, self.seq_len - 1):
            self.fill(self.seq_len)
        while keep == 0 and self.waiting:
            self.fill(1 << (self.waiting.bit_length() - 1))


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, source string, sequence_id long, offset long, sequence_length long"


def pack_parts(seq_len: int):
    """Rows (part, kind, ..) sorted by part and kind: first the sources' shares and deficits, then documents."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    types = [pa.binary() if n == "ids" else pa.string() if n == "source" else pa.int64() for n in names]

    def emit(packer: Packer) -> pa.RecordBatch:
        rows, packer.rows = packer.rows, []
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                cut = batch.slice(i, 512)
                for part, kind, source, share, deficit, doc_id, n, ids in zip(*(cut.column(k).to_pylist() for k in range(8)), strict=True):
                    if packer is None or packer.part != part:
                        if packer is not None:
                            packer.drain(0)
                            yield emit(packer)
                        packer = Packer(part, seq_len)
                    if kind == 0:
                        packer.weigh(source, share, deficit)
                        continue
                    packer.put(source, doc_id, np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4"))
                    if packer.waiting > BUFFER_TOKENS:
                        packer.drain(BUFFER_TOKENS // 2)
                if packer is not None and packer.rows:
                    yield emit(packer)
        if packer is not None:
            packer.drain(0)
            yield emit(packer)

    return run


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, weights: dict[str, float] | None = None, part_tokens: int = PART_TOKENS, eos: int = EOS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids (32-bit little-endian), doc_tokens, source, sequence_id, offset, sequence_length.

    Each document gives its ids and ``eos``; each id lies in exactly one piece. Every sequence is full: it holds
    ``seq_len`` tokens, or, at a part's end, a smaller power of two, so that nothing is padded. ``weights`` are
    target shares of tokens by source (not below 0); by default a source's share of all tokens. A source that has
    nothing left gives its share to the others, so all documents are packed once whatever the weights are.
    Null and empty texts are ``eos`` alone; rows without an id or a source are packed like others (the
    source counts as empty); repeated rows are packed each. No rows give no pieces.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    table = stored(base.mapInArrow(tokenise(tokenizer_path, eos), "doc_id long, source string, n long, ids binary"), "tokens")
    total = table.agg(F.sum("n")).first()[0] or 0
    parts = min(MAX_PARTS, max(1, -(-total // part_tokens)))
    part_of = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.when(F.col("doc_id").isNull(), F.xxhash64("ids"))), F.lit(parts)).cast("int")

    sums = stored(table.groupBy(part_of.alias("part"), "source").agg(F.sum("n").alias("n")), "part-sums")
    shares = sums.groupBy("source").agg(F.sum("n").alias("all"))
    if weights:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        shares = shares.join(given, "source", "left").select("source", F.coalesce("weight", F.lit(0.0)).alias("w"))
    else:
        shares = shares.select("source", F.col("all").cast("double").alias("w"))
    norm = shares.agg(F.sum("w")).first()[0] or 1.0
    shares = shares.select("source", (F.col("w") / F.lit(norm)).alias("share"))
    # tokens before each part, of all sources and of each: a source's deficit when the part begins
    everything = sums.groupBy("part").agg(F.sum("n").alias("n"))
    before = everything.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each part
    own = Window.partitionBy("source").orderBy("part")
    start = sums.withColumn("had", F.sum("n").over(own) - F.col("n")).join(before, "part").join(shares, "source")
    start = start.select("part", F.lit(0).alias("kind"), "source", "share", (F.col("share") * F.col("before") - F.col("had")).alias("deficit"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("ids"))
    rows = table.select(part_of.alias("part"), F.lit(1).alias("kind"), "source", F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("deficit"), "doc_id", "n", "ids")
    rows = start.unionByName(rows).repartitionById(parts, "part").sortWithinPartitions("part", "kind", "doc_id", F.xxhash64("ids"))
    return rows.mapInArrow(pack_parts(seq_len), PIECES)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(pieces: DataFrame) -> DataFrame:
    out = pieces.select(*[F.crc32("ids").alias("ids_crc32") if c == "ids" else c for c in pieces.columns])
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "sequence_length")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(read_table(spark, sf_dir, "documents"), default_tokenizer()))
