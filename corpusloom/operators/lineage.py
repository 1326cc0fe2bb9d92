"""Content manifests of stages and their verification (H1 to H7)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that are no part of a stage's content.
IGNORED = ("_SUCCESS", "*.crc", "*.tmp", "_manifest.json")
#: Keys of a manifest that are no part of its identity.
VOLATILE = ("created", "started", "finished", "duration_s", "seal")


def canonical_hash(obj: object) -> str:
    """SHA-256 of JSON with sorted keys."""
    return hashlib.sha256(json.dumps(obj, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str).encode()).hexdigest()


def file_index(spark: SparkSession, folder: str, deep: bool = True) -> DataFrame:
    """(path, size, sha256) of the files below a folder, by executors; sha256 is null where ``deep`` is false (contents stay unread)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    relative = F.regexp_replace(F.col("path"), "^.*?" + _quoted(folder.rstrip("/").split(":")[-1].lstrip("/")) + "/", "")
    digest = F.sha2(F.col("content"), 256) if deep else F.lit(None).cast("string")
    out = files.select(relative.alias("path"), F.col("length").alias("size"), digest.alias("sha256"))
    for name in IGNORED:
        pattern = "(^|/)" + name.replace(".", r"\.").replace("*", "[^/]*") + "$"
        out = out.where(~F.col("path").rlike(pattern))
    return out


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def index_root(index: DataFrame) -> DataFrame:
    """(root, files, bytes): a hash over the sorted lines of an index.

    Lines are hashed in groups by their path's hash first, so no task holds the whole index.
    """
    line = F.sha2(F.concat_ws("|", "path", F.col("size").cast("string"), F.coalesce("sha256", F.lit(""))), 256)
    groups = index.select(F.substring(F.md5("path"), 1, 3).alias("g"), line.alias("l"), "size").groupBy("g")
    parts = groups.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("h"), F.count("*").alias("n"), F.sum("size").alias("b"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: F.concat(x["g"], x["h"])), "\n"), 256).alias("root"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))


def stage_manifest(spark: SparkSession, name: str, folder: str, parameters: dict, inputs: dict[str, str]) -> dict:
    """A sealed manifest: content root, parameters and the identities of the inputs."""
    root = index_root(file_index(spark, folder)).first()
    return sealed({"stage": name, "root": root.root, "files": root.files, "bytes": root.bytes, "parameters": parameters, "inputs": inputs})


def identity(manifest: dict) -> str:
    """Hash of everything but times and the seal."""
    return canonical_hash({k: v for k, v in manifest.items() if k not in VOLATILE})


def sealed(manifest: dict) -> dict:
    return {**manifest, "seal": identity(manifest)}


def root_manifest(stages: dict[str, dict], declared: list[str]) -> dict:
    """The manifest over all declared stages, by name; a missing one is an error."""
    missing = sorted(set(declared) - set(stages))
    if missing:
        raise ValueError(f"no manifest of stages {missing}")
    return sealed({"stages": {name: identity(stages[name]) for name in sorted(stages)}})


def divergences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, kind) of files that are absent, altered or extra; a null hash on either side compares sizes only."""
    both = expected.alias("e").join(found.alias("f"), "path", "full_outer")
    changed = (F.col("e.size") != F.col("f.size")) | (F.col("e.sha256") != F.col("f.sha256"))
    kind = F.when(F.col("f.size").isNull(), "absent").when(F.col("e.size").isNull(), "extra").when(F.coalesce(changed, F.lit(False)), "altered")
    return both.select("path", kind.alias("kind")).where("kind is not null")


def broken_seals(stages: dict[str, dict], root: dict) -> list[tuple[str, str]]:
    """(name, kind) of stage manifests that were edited or differ from the root, and of an edited root."""
    out = [(name, "manifest") for name, m in sorted(stages.items()) if m.get("seal") != identity(m)]
    out += [(name, "stage") for name, seal in sorted(root["stages"].items()) if name not in stages or identity(stages[name]) != seal]
    return out + ([("", "root")] if root.get("seal") != identity(root) else [])


def preserved(old: dict | None, new: dict) -> dict:
    """The manifest to keep: one captured when the stage ran, as long as its content is still the same."""
    if old and old.get("captured") == "execution" and old.get("root") == new.get("root"):
        return old
    return new
