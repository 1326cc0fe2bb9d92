import hashlib
import random
import struct

import pytest
import sentencepiece

from corpusloom.llm import piece_codec as pc
from corpusloom.llm.piece_codec import Vocabulary, check, loaded, piece_codes

CHARS = ["a", "b", "c", " ", "  ", "the", "ing", "▁", "\n", "\x00", "é", "😀", "漢", "字", "<s>", "<0x41>", "�", "\xa0", "ﬁ", "\r\n", "\t", "ab", "<u>"]


def texts(n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(CHARS) for _ in range(rng.randrange(size))) for _ in range(n)]


def naive(own, stretch):
    """Join the best pair, the leftmost of equal ones, until there is none."""
    symbols = list(stretch)
    while True:
        best = max(((own.score[a + b], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in own.score), default=None)
        if best is None:
            return tuple(i for s in symbols for i in own._ids(s, {}))
        k = -best[1]
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]


def test_agendas_equal_their_definition():
    own = loaded(pc.default_model())[0]
    rng = random.Random(4)
    stretches = ["".join(rng.choice("▁theinga bcdé漢\n<>0x41") for _ in range(rng.randrange(1, pc.SHORT + 1))) for _ in range(500)] + ["a", "▁" * 32, "x" * 32]
    assert own.merged_in_step(stretches) == [own.merged(s) for s in stretches] == [naive(own, s) for s in stretches]


def test_ids_and_texts_equal_the_librarys():
    own, library = loaded(pc.default_model())
    check(own, library, texts(1500, 40, 1) + ["", " ", "x" * 100_000, "漢字" * 20_000, " " * 5000, "\n" * 300])
    rng = random.Random(2)
    for _ in range(1500):  # ids that no text gives, broken bytes among them
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(259), rng.randrange(259, 280)]) for _ in range(rng.randrange(9))]
        assert own.decode(ids) == library.decode(ids)


def message(*parts):
    """Fields of a serialised message: (number, int, float, str or bytes)."""
    out = b""

    def varint(x):
        done = b""
        while x > 127:
            done += bytes([x & 127 | 128])
            x >>= 7
        return done + bytes([x])

    for number, value in parts:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def model(pieces, dummy=1, extra=0):
    return message(*((1, message((1, p), (2, float(s)), (3, k))) for p, s, k in pieces), (2, message((3, 2), (4, len(pieces)))), (3, message((1, "identity"), (3, dummy), (4, extra))))


@pytest.mark.parametrize(("dummy", "extra"), [(1, 0), (0, 0), (1, 1)])
def test_other_vocabularies(dummy, extra):
    """Unknown pieces, pieces of the user, pieces that are joined only on the way, equal scores, pieces across a space."""
    fixed = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)]
    plain = [("ab", -1, 1), ("bc", -1, 1), ("abc", -2, 5), ("▁a", -3, 1), ("ca", -1, 1), ("aab", -5, 1), ("the", -4, 1), ("th", -6, 5), ("e", -9, 1), ("a", -9, 1), ("b", -9, 1), ("▁", -9, 1), ("t", -9, 1)]
    for own_pieces in (fixed + plain, fixed + plain + [("<u>", 0, 4), ("<u>a", 0, 4)], fixed + plain + [("b▁a", -1, 1)]):
        data = model(own_pieces, dummy, extra)
        library = sentencepiece.SentencePieceProcessor(model_proto=data)
        own = Vocabulary(data)
        check(own, library, texts(400, 25, 3) + ["the abc abcab caab", " ", ""])


def test_rows(spark):
    library = loaded(pc.default_model())[1]
    rows = [(i, t, "x") for i, t in enumerate(texts(60, 80, 5) + [None, "", "long " * 40_000, "y" * 50_000])] + [(0, "again", "x"), (0, "again", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for whole in (False, True):
        got = piece_codes(docs, pc.default_model(), check_whole=whole).collect()
        assert sorted((r.doc_id is None, r.doc_id, r.ids) for r in got) == sorted((i is None, i, library.encode(t or "")) for i, t, _ in rows)
        assert all(r.decoded == library.decode(r.ids) for r in got)
    assert piece_codes(docs.limit(0), pc.default_model()).count() == 0


def test_a_difference_is_an_error():
    own, library = Vocabulary(model([("<unk>", 0, 2), ("a", -1, 1)])), loaded(pc.default_model())[1]
    with pytest.raises(RuntimeError):
        check(own, library, ["a the"])
    with pytest.raises(ValueError):
        Vocabulary(message((1, message((1, "a"), (2, -1.0))), (2, message((3, 1)))))


def test_batches_without_new_stretches():
    library = loaded(pc.default_model())[1]
    batches = [pc.pa.record_batch({"doc_id": [1, 2], "text": pc.pa.array(x, pc.pa.string())}) for x in ([None, ""], ["the same", "the"], ["the", "the same"], ["", None])]
    got = [b.column("ids").to_pylist() for b in pc.coded(pc.default_model(), False)(batches)]
    assert got == [library.encode([t or "" for t in b.column("text").to_pylist()]) for b in batches]


def test_worker_forgets_and_stays_right():
    library = loaded(pc.default_model())[1]
    own = Vocabulary(open(pc.default_model(), "rb").read(), cache_chars=300)
    for t in texts(200, 60, 6):
        assert own.encode_all([library.normalize(t)])[0] == [library.encode(t)]


class Counted(dict):
    asked = 0

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_python_meets_distinct_stretches_only():
    """A batch of 60,000 words costs Python what its three distinct ones cost."""
    library = loaded(pc.default_model())[1]
    own = Vocabulary(open(pc.default_model(), "rb").read())
    own.ids = Counted()
    batch = ["the cat and " * 5000] * 4
    assert own.encode_all([library.normalize(t) for t in batch])[0] == library.encode(batch)
    assert own.ids.asked <= 10


USERS = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("<u>", 0, 4), ("▁a", -3, 1), ("ab", -1, 1), ("a", -9, 1), ("b", -9, 1), ("▁", -9, 1)]


def test_pieces_of_the_user_are_known_after_forgetting():
    data = model(USERS)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), Vocabulary(data, cache_chars=60)
    for t in texts(300, 25, 7):
        check(own, library, [t])


def test_texts_are_cut_as_by_the_pattern():
    for own in (loaded(pc.default_model())[0], Vocabulary(model([p for p in USERS if p[0] != "<u>"] + [("b▁a", -1, 1)])), Vocabulary(model(USERS[:3]))):
        for batch in (texts(300, 30, 8), ["", ""], ["▁▁a▁\n▁b", "", "▁", "a", "\n"], []):
            batch = [t.replace(" ", "▁") for t in batch]
            stretches, first = own._cut_all(batch)
            assert [stretches.to_pylist()[a:b] for a, b in zip(first[:-1], first[1:])] == [own.cut(t) for t in batch]


@pytest.mark.parametrize("extra", [0, 1])
def test_decoding_as_arrays_equals_decoding_by_row(extra):
    rng = random.Random(9)
    for own in (loaded(pc.default_model())[0], Vocabulary(model(USERS, 1, extra))):
        n = len(own.table)
        rows = [[], [0], [1], [1, 1], [n - 1, n - 1]] + [[rng.choice([rng.randrange(n), rng.randrange(min(n, 300))]) for _ in range(rng.randrange(7))] for _ in range(1000)]
        for batch in (rows, [[]], [[], []], []):
            ids = pc.np.array([i for x in batch for i in x], dtype=pc.np.int32)
            offsets = pc.np.append(0, pc.np.cumsum([len(x) for x in batch], dtype=pc.np.int64))
            assert own.decode_all(ids, offsets) == [own.decode(x) for x in batch]


def test_query_digests(spark, sf):
    library = loaded(pc.default_model())[1]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = {r.doc_id: library.encode(r.text or "") for r in docs}
    got = pc.op12_piece_codec(spark, sf).collect()
    assert {tuple(r) for r in got} == {(i, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, x in ids.items()} and len(got) == len(docs)
