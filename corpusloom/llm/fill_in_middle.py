"""Fill-in-middle transformation over run-length encoded character classes.

A text is held as its maximal runs of one character class, each with the units that lie before it. The place of a cut after k units is found by a
binary search for the run that holds unit k; inside the run all units have one width, so the offset follows by arithmetic. Units are words (white space goes
with the word after it), characters, or UTF-8 bytes (a cut inside a character moves to its start). Only counts and offsets are computed in Arrow batches; the texts
are cut and joined by Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import free_name, read_table

#: Sentinels before the prefix, the suffix and the middle; share of transformed texts and share of those that begin with the suffix, in percent.
SENTINELS = ("<P>", "<S>", "<M>")
RATE, SUFFIX_FIRST, SEED = 50, 80, "42"
UNITS = ("word", "char", "byte")
CUTS = "struct<n:bigint,prefix_chars:bigint,middle_chars:bigint>"


class Runs:
    """Maximal runs of a character class: where each starts, its characters, and the units before and after it."""

    __slots__ = ("starts", "lengths", "before", "after", "total")

    def __init__(self, text: str, unit: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if unit == "word":
            kind = ((codes == 0x20) | (codes - np.uint32(9) < 5)).view(np.uint8)  # 1: white space
        elif unit == "byte":
            kind = 1 + (codes > 0x7F).view(np.uint8) + (codes > 0x7FF) + (codes > 0xFFFF)  # bytes of a character
        else:
            kind = np.zeros(len(codes), dtype=np.uint8)
        self.starts = np.append(0, np.flatnonzero(kind[1:] != kind[:-1]) + 1) if len(codes) else np.zeros(0, dtype=np.int64)
        self.lengths = np.diff(np.append(self.starts, len(codes)))
        if unit == "word":
            units = 1 - kind[self.starts].astype(np.int64)
            units[-1:] = 1  # white space at the end is a unit of its own
        else:
            units = self.lengths * np.maximum(kind[self.starts], 1)
        self.after = np.cumsum(units)
        self.before = self.after - units
        self.total = int(self.after[-1]) if len(codes) else 0

    def offset(self, k: int) -> int:
        """The character after the first ``k`` units."""
        if k <= 0:
            return 0
        run = int(np.searchsorted(self.after, k))
        return int(self.starts[run] + (k - self.before[run]) * self.lengths[run] // (self.after[run] - self.before[run]))


def cuts(unit: str):
    """Arrow function (text, h1, h2) to the units of the text and the characters of prefix and middle."""

    def run(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        rows = []
        for t, a, b in zip(text, first.to_pylist(), second.to_pylist(), strict=True):  # one text at a time
            runs = Runs(t.as_py() or "", unit)
            low, high = sorted((a % (runs.total + 1), b % (runs.total + 1)))
            begin = runs.offset(low)
            rows.append((runs.total, begin, runs.offset(high) - begin))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["n", "prefix_chars", "middle_chars"])

    return F.arrow_udf(run, CUTS)


def draw(id_col: Column, seed: str, k: int) -> Column:
    """The k-th 8-digit group of the hex SHA-256 of ``seed:id`` as an unsigned number, from 1."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 8 * k - 7, 8), 16, 10).cast("long")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from a transformed one. A text with a sentinel stays plain, so the sentinels of ``output`` are the three that were put in."""
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def fill_in_middle(docs: DataFrame, unit: str = "word", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row: its units, and the text with its middle moved to the end.

    ``form`` is plain (the text as it is), psm (prefix, suffix, middle) or spm (suffix, prefix, middle), drawn from the id and the seed only, so that a
    rerun gives the same. Empty texts and those that contain a sentinel are plain; a null text is empty. Cuts may coincide or lie
    at an end: parts may be empty. Rows without an id are drawn alike; repeated rows give repeated rows; other columns are not read.
    No sentinel may be empty, begin inside another one, or occur in one: the text could not be told from its output.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    if len(set(sentinels)) != 3 or not all(sentinels) or any(s[-k:] == z[:k] for s in sentinels for z in sentinels for k in range(1, min(len(s), len(z)) + (s != z))) or any(s != z and s in z for s in sentinels for z in sentinels):
        raise ValueError("sentinels must be three texts that neither overlap nor contain each other")
    begin, after, middle = (F.lit(s) for s in sentinels)
    cut = free_name(docs, "_cut")[0]
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(key.cast("long").alias("doc_id"), text.alias("text"), cuts(unit)(text, draw(key, seed, 1), draw(key, seed, 2)).alias(cut))
    plain = (F.col("text") == "") | F.greatest(*[F.col("text").contains(s) for s in sentinels]) | (draw(F.col("doc_id"), seed, 3) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(F.col("doc_id"), seed, 4) % 100 < suffix_first, "spm").otherwise("psm")
    out = rows.select("doc_id", "text", F.col(f"{cut}.n").alias("n"), form.alias("form"), F.col(f"{cut}.prefix_chars").alias("p"), F.col(f"{cut}.middle_chars").alias("m"))
    whole = F.col("text")
    parts = [F.substring(whole, F.lit(1), F.col("p")), F.substring(whole, F.col("p") + F.col("m") + 1, F.length(whole)), F.substring(whole, F.col("p") + 1, F.col("m"))]
    output = F.when(F.col("form") == "plain", whole).when(F.col("form") == "psm", F.concat(begin, parts[0], after, parts[1], middle, parts[2])).otherwise(F.concat(after, parts[1], begin, parts[0], middle, parts[2]))
    moved = F.col("form") != "plain"
    return out.select("doc_id", "n", "form", F.when(moved, F.col("p")).alias("prefix_chars"), F.when(moved, F.col("m")).alias("middle_chars"), output.alias("output"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(read_table(spark, sf_dir, "documents"))
    digest = [F.sha2(x.cast("binary"), 256) for x in (F.col("output"), restored(F.col("output"), F.col("form")))]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest[0].alias("output_sha256"), digest[1].alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents),
r AS (
  SELECT doc_id, text, tokens, CAST(len(tokens) AS BIGINT) AS n, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) AS h1, CAST(('0x' || substr(h, 9, 8)) AS BIGINT) AS h2,
         CAST(('0x' || substr(h, 17, 8)) AS BIGINT) AS h3, CAST(('0x' || substr(h, 25, 8)) AS BIGINT) AS h4
  FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM r),
p AS (
  SELECT *, array_to_string(tokens[1:a], '') AS pre, array_to_string(tokens[a + 1:b], '') AS mid, array_to_string(tokens[b + 1:], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""
