import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import periodic_runs as pr
from corpusloom.llm.periodic_runs import collapsed, periodic_runs, runs_of


def brute(words, min_length=24, min_exp=3):
    """Every lag's comparison, word by word; a stretch counts unless a smaller period fits all of it."""
    out, n = [], len(words)
    for q in range(1, n // min_exp + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_length, min_exp * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng, size):
    """Random words with repeated parts in them, nested ones too."""
    letters = "ab" if rng.random() < 0.3 else "abcdefghijkl"
    out = [rng.choice(letters) for _ in range(rng.randrange(size))]
    for _ in range(rng.randrange(4)):
        part = [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.4:
            part = part * rng.randrange(1, 9) + [rng.choice(letters) for _ in range(rng.randrange(3))]
        at = rng.randrange(len(out) + 1)
        out[at:at] = (part * rng.randrange(2, 12))[: rng.randrange(5, 120)]
    return out


@pytest.mark.parametrize(("min_length", "min_exp"), [(24, 3), (8, 2), (1, 2), (5, 4), (40, 3)])
def test_runs_equal_brute_force(min_length, min_exp):
    rng = random.Random(min_length)
    found = 0
    for _ in range(150):
        words = random_words(rng, 120)
        got = runs_of(words, min_length=min_length, min_exp=min_exp)
        assert got == brute(words, min_length, min_exp), words
        found += len(got)
        parts, n = [], len(words)
        for low in range(1, n + 1, 7):  # ranges of lags on their own
            parts += runs_of(words, low, low + 6, min_length, min_exp)
        assert sorted(parts, key=lambda r: (r[0], r[2])) == got
    assert found


def test_long_texts_take_few_comparisons():
    for words in (["x"] * 300_000, ["a", "b", "c", "d"] * 60_000, [str(k % 50_000) for k in range(200_000)], [str(k) for k in range(200_000)]):
        runs = runs_of(words)
        assert len(runs) <= 1 and all(s == 0 and n == len(words) for s, n, _ in runs)
    rng = np.random.default_rng(1)
    words = [str(x) for x in rng.integers(0, 3, 50_000)]  # most short groups of words repeat
    assert all(n >= max(24, 3 * q) for _, n, q in runs_of(words))


def test_collapsed_words():
    words = [*"xyabcabcabcz", *"qqqq"]
    runs = [(2, 9, 3), (12, 4, 1)]
    assert collapsed(words, runs) == "x y a b c z q" and collapsed([], []) == "" and collapsed(words, []) == " ".join(words)


def answers(doc_id, text):
    """The query's row, written out."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = (zlib.crc32(str(doc_id).encode()), len(words)) if doc_id is not None else (1, 0)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    some = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *some, sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))


@pytest.mark.parametrize("budget", [pr.BUDGET, 300])
def test_rows_and_query_equal_brute_force(spark, tmp_path, budget, monkeypatch):
    monkeypatch.setattr(pr.periodic_runs, "__defaults__", (pr.MIN_LENGTH, pr.MIN_EXP, budget, "doc_id", "text"))
    rng = random.Random(9)
    texts = [" ".join(random_words(rng, 150)) for _ in range(120)] + [None, "", " \n", "w\t" * 900, "one", "a\x1fb é\xa0漢 " * 30]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 2), (0, texts[1], 3), (None, "w " * 50, 4), (5, texts[123], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = periodic_runs(docs).collect()
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    expected = [(i, len(w), brute(w), collapsed(w, brute(w))) for (i, _, _), w in zip(rows, split, strict=True)]
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str) == sorted(expected, key=str)
    assert periodic_runs(docs.limit(0)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    done = pr.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in done if r.doc_id is not None} == {answers(i, t) for i, t, _ in rows if i is not None} and len(done) == len(rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and answers(i, t)[1] for i, t, _ in rows if i is not None)


def test_settings_are_checked(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        periodic_runs(docs, min_exp=1)
