"""Language by Bayesian fusion of evidence.

Four sources are multiplied: the text's likelihood under byte-trigram models, the language that markup
declares, weighed by how often such declarations are right, and the prior of the host, which is smoothed
towards that of its address suffix and that towards all documents. The counts come from grouped aggregation over all documents.
Next to the known languages stands another one whose trigrams are all alike; a text that it explains better is in none of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import read_table, stored
from ._text import LOWER, chunks, looked_up, raw_bytes
from .html_text import html_text
from .toxicity import bounded_sample

LANGUAGES = ("de", "en", "es", "fr")
#: Documents with a declared language that the text models are fitted on, at most: those of the smallest hash of the id.
MAX_TRAIN = 3_000
#: Bins of hashed trigrams; what one trigram counts, as trigrams overlap; the most that a text's evidence may say.
BINS, TEMPER, MOST = 1 << 15, 0.3, 40.0
#: Trigrams that a single text counts for, at most; trigrams that the models should have seen before unknown ones mean much.
PER_TEXT, ENOUGH = 4_000, 50_000
#: The most that one trigram may speak for no known language, so that a key or an address in a text does not decide.
ODD = 2.0
#: Documents that a suffix and all documents weigh in a host's and a suffix's prior.
HOST_PRIOR, SUFFIX_PRIOR, DECLARED_PRIOR = 20.0, 50.0, 2.0
#: Hosts that are broadcast at most; more are joined by shuffle.
MAX_BROADCAST_HOSTS = 200_000
#: A document is accepted from this posterior on.
ACCEPT = 0.5
#: Share of documents that are expected in no known language, and how they are named.
OTHER_PRIOR, OTHER = 0.01, "other"
#: Rejected ids that are broadcast at most; more are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bins of each byte's trigram with its two predecessors, digits and signs as spaces, and the texts' bounds."""
    raw, offsets = raw_bytes(texts)
    low = looked_up(raw, LOWER).astype(np.uint32)
    low[(low < 0x61) | ((low > 0x7A) & (low < 0x80))] = 0x20
    one, two = np.full(len(low), 0x20, np.uint32), np.full(len(low), 0x20, np.uint32)
    one[1:], two[2:] = low[:-1], low[:-2]
    # a text's first bytes do not see the text before
    heads = offsets[:-1][np.diff(offsets) > 0]
    one[heads] = two[heads] = 0x20
    two[heads[np.isin(heads + 1, offsets, invert=True)] + 1] = 0x20
    code = (two * np.uint32(0x9E3779B1) ^ one * np.uint32(0x85EBCA77) ^ low * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    code ^= code >> np.uint32(15)
    spaces = (two == 0x20) & (one == 0x20) & (low == 0x20)
    return np.where(spaces, BINS, code % np.uint32(BINS)).astype(np.int32), offsets


def fit(texts: pa.Array, declared: list[str], languages: tuple[str, ...]) -> tuple[np.ndarray, float]:
    """(languages + 1, BINS + 1) log-probabilities of trigrams against their mean, the last bin (no letters) 0, and how far to trust the last row.

    The last row is the language in which all trigrams are alike; the less text the others have seen, the less it means that it explains
    a text better. A language without texts is a little less likely than the least likely one with texts.
    """
    counts = np.zeros((len(languages), BINS + 1))
    at = 0
    for part in chunks(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        codes, offsets = trigrams(part.column(0))
        for i, j in zip(offsets[:-1], offsets[1:], strict=True):
            if declared[at] in languages and j > i:
                counts[languages.index(declared[at])] += np.bincount(codes[i:j], minlength=BINS + 1) * min(1.0, PER_TEXT / (j - i))
            at += 1
    counts[:, BINS] = 0
    shared = counts.sum(axis=0) + 0.5
    shared /= shared.sum()
    known = counts.sum(axis=1, keepdims=True)
    out = np.zeros((len(languages) + 1, BINS + 1))
    if known.any():
        out[:-1] = np.log((counts + 200 * shared) / (known + 200)) - np.log(shared)
        out[:-1] = np.where(known > 0, out[:-1], out[:-1][known[:, 0] > 0].min(axis=0) - 0.1)
        out[-1] = np.minimum(-np.log(BINS) - np.log(shared), out[:-1].max(axis=0) + ODD)
    out[:, BINS] = 0
    return out, float(known.sum() / (known.sum() + ENOUGH))


def likelihoods(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, trust = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                codes, offsets = trigrams(part.column(3))
                logs = np.zeros((len(table), part.num_rows))
                for k, row in enumerate(table):
                    sums = np.concatenate([[0.0], np.cumsum(row[codes])])
                    logs[k] = TEMPER * (sums[offsets[1:]] - sums[offsets[:-1]])
                odd = np.clip(trust * (logs[-1] - logs[:-1].max(axis=0)), -MOST, MOST)
                logs = np.maximum(logs[:-1] - logs[:-1].max(axis=0), -MOST)
                letters = np.concatenate([[0], np.cumsum(codes != BINS)])
                flat = pa.array(logs.T.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(logs)), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists, pa.array(odd), pa.array(letters[offsets[1:]] - letters[offsets[:-1]])], names=["oid", "host", "declared", "logs", "odd", "letters"])

    return run


def suffix_of(host: Column) -> Column:
    """The last label of a host name; '' for one without a dot."""
    return F.when(F.contains(host, F.lit(".")), F.element_at(F.split(host, r"\."), -1)).otherwise("")


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def normal(logs: Column) -> Column:
    """Probabilities of unnormalised logarithms."""
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _added(size: int, values: Column) -> list[Column]:
    return [F.sum(F.get(values, k)).alias(f"s{k}") for k in range(size)]


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", languages: tuple[str, ...] = LANGUAGES, accept: float = ACCEPT, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, lang, confidence, p, declared, host, accepted) of every row.

    ``lang`` is the language of the largest posterior (ties: the first of ``languages``), OTHER for a text in none of them, null for one
    without letters; ``accepted`` holds for a known language with a posterior of at least ``accept``. ``declared_col`` and ``host_col`` may be None; a null,
    empty or unknown declaration says nothing, and a null host is a host '' of its own. Text models are fitted on at most
    ``max_train`` documents with a declaration; without any, texts say nothing. Null and empty texts are not accepted.
    Repeated rows are judged each; other columns are not read; an empty table gives no rows.
    """
    spark, size = docs.sparkSession, len(languages)
    declared = F.lower(F.substring(F.col(declared_col), 1, 2)) if declared_col else F.lit(None).cast("string")
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")) if host_col else F.lit("")
    base = docs.select(F.col(id_col).cast("long").alias("oid"), host.alias("host"), F.when(declared.isin(*languages), declared).alias("declared"), F.col(text_col).alias("text"))
    rows = base.where("declared is not null and oid is not null").select(F.col("oid").alias("sid"), F.coalesce("text", F.lit("")).alias("text"), "declared")
    chosen = rows.select("sid").distinct().orderBy(F.md5(F.col("sid").cast("string")), "sid").limit(max_train)
    sample = bounded_sample(rows.join(F.broadcast(chosen), "sid", "left_semi"), max_train, "declared")
    model = spark.sparkContext.broadcast(fit(sample.column("text").combine_chunks(), sample.column("declared").to_pylist(), tuple(languages)))
    schema = "oid long, host string, declared string, logs array<double>, odd double, letters long"
    table = stored(base.mapInArrow(likelihoods(model), schema), "likelihoods").withColumn("own", F.when((F.col("letters") > 0) & (F.col("odd") <= 0), normal(F.col("logs"))))

    # soft counts of texts alone, by host, suffix and declared language
    sums = stored(table.where("own is not null").groupBy("host", "declared").agg(*_added(size, F.col("own"))), "host-sums")
    all_row = sums.agg(*[F.sum(f"s{k}") for k in range(size)]).first()
    everything = [(x or 0.0) + 1.0 for x in all_row]
    overall = [x / sum(everything) for x in everything]
    suffixes = sums.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(size)])
    total = sum((F.col(f"s{k}") for k in range(size)), F.lit(0.0))
    suffixes = suffixes.select("suffix", F.array(*[(F.col(f"s{k}") + SUFFIX_PRIOR * overall[k]) / (total + SUFFIX_PRIOR) for k in range(size)]).alias("up"))
    hosts = sums.groupBy("host").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(size)]).withColumn("suffix", suffix_of(F.col("host"))).join(suffixes, "suffix")
    hosts = stored(hosts.select("host", F.array(*[f"s{k}" for k in range(size)]).alias("had"), "up"), "hosts")
    # how often a declaration stands by a text of each language: at most size * size numbers
    said = {r[0]: [x or 0.0 for x in r[1:]] for r in sums.where("declared is not null").groupBy("declared").agg(*[F.sum(f"s{k}") for k in range(size)]).collect()}
    rates = {}
    for name in languages:
        rates[name] = [(said.get(name, [0.0] * size)[k] + DECLARED_PRIOR * (3.0 if name == languages[k] else 1.0)) / (sum(said.get(x, [0.0] * size)[k] for x in languages) + DECLARED_PRIOR * (size + 2)) for k in range(size)]

    held = F.broadcast(hosts) if hosts.count() <= MAX_BROADCAST_HOSTS else hosts.hint("merge")
    joined = table.join(held, "host", "left")
    own = lambda k: F.coalesce(F.get("own", k), F.lit(0.0))  # noqa: E731  a document is no evidence for its own prior
    rest = F.coalesce(F.aggregate("had", F.lit(0.0), lambda a, b: a + b), F.lit(0.0)) - F.when(F.col("own").isNull(), 0.0).otherwise(1.0)
    prior = [(F.coalesce(F.get("had", F.lit(k)), F.lit(0.0)) - own(F.lit(k)) + HOST_PRIOR * F.coalesce(F.get("up", F.lit(k)), F.lit(overall[k]))) / (rest + HOST_PRIOR) for k in range(size)]
    says = [F.coalesce(*[F.when(F.col("declared") == name, F.lit(float(np.log(rates[name][k])))) for name in languages], F.lit(0.0)) for k in range(size)]
    joined = joined.withColumn("p", normal(F.array(*[F.get("logs", F.lit(k)) + F.log(F.greatest(prior[k], F.lit(1e-9))) + says[k] for k in range(size)])))
    none = F.lit(1.0) / (1 + F.exp(-F.col("odd")) * (1 / OTHER_PRIOR - 1))  # posterior of no known language
    joined = joined.withColumn("none", none).withColumn("best", F.array_max("p") * (1 - none))
    odd = F.col("none") > F.col("best")
    lang = F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position("p", F.array_max("p")).cast("int"))
    lang = F.when(F.col("letters") > 0, F.when(odd, F.lit(OTHER)).otherwise(lang))
    accepted = (F.col("letters") > 0) & ~odd & (F.col("best") >= accept)
    return joined.select(F.col("oid").alias("doc_id"), lang.alias("lang"), F.when(odd, F.col("none")).otherwise(F.col("best")).alias("confidence"), "p", "declared", "host", accepted.alias("accepted"))


def page_language_id(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """language_id of web pages: the page's main text, the language its markup declares (the lang attribute of html) and its URL's host with the address suffix.

    Null pages and URLs, pages without a declaration and repeated rows are as in language_id; other columns are not read.
    """
    tag = F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)
    # each row keeps its own host and declaration: they go through the extraction in the place of the address, so ids need be neither there nor distinct
    marks = F.to_json(F.struct(F.nullif(tag, F.lit("")).alias("declared"), host_of(F.col(url_col)).alias("host")))
    rows = pages.select(F.col(id_col).alias("page_id"), marks.alias("marks"), F.col(html_col).alias("html"))
    texts = html_text(rows, "page_id", "marks", "html").select("page_id", "text", F.from_json("url", "declared string, host string").alias("m"))
    return language_id(texts.select("page_id", "text", "m.declared", "m.host"), "page_id", "text", "declared", "host", **options)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lang", F.round("confidence", 6).alias("confidence"), "accepted")


def keep_known(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that language_id rejects; rows that share an id go if all of them are rejected.

    The rejected ids are broadcast while they are at most MAX_BROADCAST_IDS and joined by shuffle beyond that.
    """
    judged = language_id(docs, id_col=id_col, **options).groupBy(F.col("doc_id").alias("gone")).agg(F.max("accepted").alias("ok"))
    gone = stored(judged.where("not ok").select("gone"), "rejected")
    held = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_IDS else gone.hint("merge")
    return docs.join(held, docs[id_col].cast("long").eqNullSafe(gone["gone"]), "left_anti")
