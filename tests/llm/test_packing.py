import zlib
from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import packing as m

pytest.importorskip("public_tokenizers")


def round_trip(pieces, texts, seq_len):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(m.default_tokenizer())
    by, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in texts.items():
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, m.EOS], dtype="<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.length > 0) == (at, len(ids), True)
            assert bytes(r.ids) == ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *[r.length for r in rows[:-1]]]).tolist()
        size = sum(r.length for r in rows)
        assert size == seq_len or size < seq_len and size & (size - 1) == 0
    return sequences


def test_each_id_is_packed_once(spark):
    texts = {i: " ".join(f"Word{(i * k) % 97} élan, it's <|endoftext|> x{k}" for k in range(i % 50)) for i in range(120)}
    texts |= {900: None, 901: "", 902: "a" * 5000, 903: "x y\tz\r\n w", 904: "İSTANBUL Σίσυφος é " * 40}
    rows = [(i, t, f"s{i % 3}" if i < 900 else None, "clash") for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, ids string")
    pieces = m.pack(df, m.default_tokenizer(), seq_len=256, part_tokens=3000).collect()
    round_trip(pieces, texts, 256)


def test_windows_follow_the_mixture(spark):
    rows = [(i, "some plain words to pack " * 40, "big" if i % 10 < 8 else "small") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sequences = round_trip(m.pack(df, m.default_tokenizer(), seq_len=1024, part_tokens=20_000).collect(), {i: t for i, t, _ in rows}, 1024)
    shares = [sum(r.length for r in s if r.source == "small") / 1024 for s in sequences.values() if sum(r.length for r in s) == 1024]
    assert abs(np.median(shares) - 0.2) < 0.03
    weighted = m.pack(df, m.default_tokenizer(), seq_len=1024, weights={"big": 0.5, "small": 0.5}, part_tokens=10**7).collect()
    sequences = round_trip(weighted, {i: t for i, t, _ in rows}, 1024)
    first = [sum(r.length for r in sequences[k] if r.source == "small") / 1024 for k in sorted(sequences)[:10]]
    assert abs(np.mean(first) - 0.5) < 0.05


def test_repeated_rows_missing_ids_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c", None)], "doc_id long, text string, source string")
    pieces = m.digest(m.pack(df, m.default_tokenizer())).collect()
    assert sum(r.length for r in pieces) == sum({(r.doc_id, r.start, r.sequence_id, r.offset): r.length for r in pieces}.values()) == 3 + 3 + 2
    assert all(r.ids_crc32 >= 0 for r in pieces) and zlib.crc32(b"") == 0
    assert m.pack(df.limit(0), m.default_tokenizer()).count() == 0


def test_cached_pieces_equal_the_tokenizer():
    import pyarrow as pa
    from hypothesis import given, settings
    from hypothesis import strategies as st

    encoder = m.Encoder(m.default_tokenizer(), m.EOS)
    letters = st.sampled_from(list("aBz09.,'|<>%-\t\n  éÉßΣσςİi̇́　…·١日😀") + ["'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "abc", "ABC", "12", " \n", "é", "क़"])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(letters, max_size=12).map("".join), max_size=4))
    def same(texts):
        ids, bounds = encoder.batch(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, m.EOS]

    same()


def test_another_vocabulary_encodes_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = m.Encoder(path, 7)
    assert not encoder.cuts and m.Encoder(m.default_tokenizer(), m.EOS).cuts
    texts = ["Two  words, it's 12345", None, "", "A\nb é"]
    pieces = m.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source"), path, eos=7).orderBy("doc_id", "start").collect()
    plain = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        ids = b"".join(bytes(r.ids) for r in pieces if r.doc_id == i)
        assert np.frombuffer(ids, dtype="<u4").tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 7]


def test_vocabulary_beyond_16_bits_and_forgotten_pieces(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["aa bb 12 cc's", None, "aa ÉTÉ, été", ""], pa.string())
    usual = m.Encoder(m.default_tokenizer(), m.EOS)
    wide = m.Encoder(m.default_tokenizer(), 70_000)
    assert usual.type == "<u2" and wide.type == "<u4"
    ids, bounds = usual.batch(texts)
    more, same = wide.batch(texts)
    assert more.tolist() == [70_000 if i in bounds[1:] - 1 else x for i, x in enumerate(ids.tolist())] and bounds.tolist() == same.tolist()
    monkeypatch.setattr(m, "CACHED_PIECES", 1)
    assert usual.batch(texts)[0].tolist() == ids.tolist() and usual.count < 12


def test_text_longer_than_a_buffer(spark, monkeypatch):
    monkeypatch.setattr(m, "BUFFER_TOKENS", 500)
    texts = {1: "long words of a text " * 900, 2: "short one", 3: "long words of another " * 700}
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in texts.items()], "doc_id long, text string, source string")
    round_trip(m.pack(df, m.default_tokenizer(), seq_len=64).collect(), texts, 64)
