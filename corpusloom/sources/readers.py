"""Sources and sinks."""

from __future__ import annotations

import json
import os
import random
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import canonical_hash, file_index

TEXT_NAMES = ("text", "texto", "content", "abstract")  # fixed values: columns tried in order
URL_NAMES = ("url", "metadata", "source")  # fixed values

RECORD_SCHEMA = (
    "arxiv_id string, oai_identifier string, datestamp string, created string, updated string, title string, abstract string, authors array<string>, categories array<string>, "
    "primary_category string, license string, doi string, journal_ref string, comments string, msc_class string, acm_class string"
)
# Fixed value: license of a record that names none.
DEFAULT_LICENSE = "http://arxiv.org/licenses/nonexclusive-distrib/1.0/"


def table(spark: SparkSession, path: str, *columns: str, schema: str | None = None) -> DataFrame:
    """Parquet with a projection that reaches the scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def recursive_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All Parquet files below a folder, whatever its layout; unreadable files are skipped."""
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    return (reader.schema(schema) if schema else reader).parquet(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def slice_columns(df: DataFrame) -> DataFrame:
    """(texto, url) from whichever of the usual columns there are."""
    names = {c.lower(): c for c in df.columns}
    text = next((names[c] for c in TEXT_NAMES if c in names), None)
    if text is None:
        raise ValueError(f"no text column among {df.columns}")
    url = next((names[c] for c in URL_NAMES if c in names), None)
    return df.select(F.col(text).alias("texto"), (F.col(url).cast("string") if url else F.lit(None).cast("string")).alias("url"))


OAI_ROW = (
    "header struct<_status:string,identifier:string,datestamp:string>, metadata struct<arXiv:struct<id:string,created:string,updated:string,title:string,abstract:string,"
    "authors:struct<author:array<struct<keyname:string,forenames:string>>>,categories:string,license:string,doi:string,`journal-ref`:string,comments:string,`msc-class`:string,`acm-class`:string>>"
)


def oai_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of captured OAI pages (XML), flat; deleted ones go."""
    raw = spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", "true").schema(OAI_ROW).load(path)
    return flat_records(raw)


def flat_records(raw: DataFrame) -> DataFrame:
    m = lambda name: F.nullif(F.trim(F.col(f"metadata.arXiv.`{name}`")), F.lit(""))
    live = raw.where("metadata.arXiv is not null and coalesce(header._status, '') <> 'deleted'")
    full = lambda a: F.trim(F.concat_ws(" ", F.trim(a["forenames"]), F.trim(a["keyname"])))
    authors = F.filter(F.transform(F.coalesce("metadata.arXiv.authors.author", F.array().cast("array<struct<keyname:string,forenames:string>>")), full), lambda a: a != "")
    categories = F.filter(F.split(F.coalesce(m("categories"), F.lit("")), r"\s+"), lambda c: c != "")
    return live.select(
        m("id").alias("arxiv_id"), F.trim("header.identifier").alias("oai_identifier"), F.trim("header.datestamp").alias("datestamp"), m("created").alias("created"), m("updated").alias("updated"), m("title").alias("title"), m("abstract").alias("abstract"),
        authors.alias("authors"), categories.alias("categories"), F.try_element_at(categories, F.lit(1)).alias("primary_category"), F.coalesce(m("license"), F.lit(DEFAULT_LICENSE)).alias("license"),
        m("doi").alias("doi"), m("journal-ref").alias("journal_ref"), m("comments").alias("comments"), m("msc-class").alias("msc_class"), m("acm-class").alias("acm_class"),
    )


def source_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(path, files): the texts in source archives (tar, gzip or plain), as a map of names to texts."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", unpacked("content").alias("files"))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def unpacked(contents):
    import gzip
    import io
    import tarfile

    import pandas as pd

    def one(data: bytes) -> dict[str, str]:
        try:
            with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                return {m.name: tar.extractfile(m).read().decode("utf-8", "replace") for m in tar if m.isfile() and m.name.lower().endswith((".tex", ".ltx", ".sty", ".bbl"))}
        except tarfile.TarError:
            pass
        try:
            data = gzip.decompress(data)
        except OSError:
            pass
        return {"main.tex": data.decode("utf-8", "replace")}

    return pd.Series([one(bytes(c)) for c in contents])


def _replaced(df: DataFrame, path: str, write) -> None:
    """``write`` a new folder next to ``path``, then put it in its place: until it is whole, readers see the old table."""
    spark = df.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    place = make(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    new, old = (make(f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    write(new.toString())
    had = files.exists(place)
    if had and not files.rename(place, old):
        raise OSError(f"cannot move {path} away")
    if not files.rename(new, place):
        if had:
            files.rename(old, place)
        raise OSError(f"cannot put the new table in the place of {path}")
    if had:
        files.delete(old, True)


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """Parquet with zstd; a failed write leaves the old table as it was, and a finished one takes its place by renaming."""
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    _replaced(df, path, (writer.partitionBy(*partition_by) if partition_by else writer).parquet)


def write_json(df: DataFrame, path: str) -> None:
    _replaced(df, path, df.write.mode("errorifexists").json)


def pending_units(units: DataFrame, done: DataFrame, unit: str) -> DataFrame:
    """Input units that no manifest row marks as done; output files never count."""
    return units.join(done.select(unit).distinct(), unit, "left_anti")


def done_units(text: str | None) -> set:
    """Units in a resume manifest's JSON, under its present or its old name; unreadable manifests hold none."""
    try:
        data = json.loads(text or "")
        return set(data.get("unidades", data.get("shards", [])))
    except (ValueError, AttributeError, TypeError):
        return set()


def acquisition_problems(manifest: dict) -> dict[str, list[str]]:
    """What blocks the start (an unresolved license) and the completion (failures that can be tried again) of an acquisition."""
    start = [] if manifest.get("license_status") == "resolved" else ["license"]
    complete = [f["unit"] for f in manifest.get("failures", []) if f.get("retryable")]
    return {"start": start, "complete": complete}


class AcquisitionManifest:
    """What is known of an acquisition, as a JSON file: license, pinned revision of the source, units done and failures."""

    def __init__(self, path: str, license_status: str = "unknown", revision: str | None = None):
        self.path = path
        self.data: dict = {"license_status": license_status, "revision": revision, "units": [], "failures": [], "complete": False}

    @classmethod
    def load(cls, path: str) -> AcquisitionManifest:
        """The saved manifest; one that is absent or cannot be read is new."""
        out = cls(path)
        try:
            with open(path, encoding="utf-8") as file:
                saved = json.load(file)
        except (OSError, ValueError):
            return out
        out.data |= saved if isinstance(saved, dict) else {}
        return out

    def save(self) -> None:
        """Written aside and renamed, so that no reader sees half of it."""
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        aside = f"{self.path}.{uuid.uuid4().hex}"
        with open(aside, "w", encoding="utf-8") as file:
            json.dump(self.data, file, sort_keys=True, indent=1)
        os.replace(aside, self.path)

    def can_start(self) -> bool:
        return not acquisition_problems(self.data)["start"]

    def can_resume(self, revision: str | None) -> bool:
        """A run goes on only from the revision it began with."""
        return self.data["revision"] in (None, revision)

    def can_complete(self) -> bool:
        return not acquisition_problems(self.data)["complete"]

    def mark_complete(self, force: bool = False) -> None:
        """An error while failures can be tried again; ``force`` overrides it and is recorded."""
        if not force and not self.can_complete():
            raise ValueError(f"units to try again: {acquisition_problems(self.data)['complete']}")
        self.data |= {"complete": True, "forced": force and not self.can_complete()}
        self.save()


def retry_delay(attempt: int, base: float = 1.0, most: float = 600.0, retry_after: float | None = None, seed: int = 17) -> float:
    """Seconds before a try: what the server asks for, or doubling delays with up to a quarter of jitter."""
    if retry_after is not None:
        return min(most, max(0.0, retry_after))
    return min(most, base * 2**attempt) * (1 + 0.25 * random.Random(seed * 1000 + attempt).random())


def may_retry(status: int | None) -> bool:
    """Time-outs (None), 429 and 5xx are tried again; other answers are final."""
    return status is None or status == 429 or 500 <= status < 600


def training_package(df: DataFrame, path: str, n: int, *order: str) -> dict:
    """The first n rows in an explicit order as Parquet, and a manifest with each file's hash."""
    write_table(df.orderBy(*order).limit(n), path)
    files = {r.path: r.sha256 for r in file_index(df.sparkSession, path).orderBy("path").collect()}  # as many as output files
    return {"rows": n, "files": files, "identity": canonical_hash(files)}
