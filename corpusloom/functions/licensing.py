"""License routing: raw license strings to SPDX ids and training partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Key, SPDX id, may be trained on, may be redistributed, commercial use, attribution, share-alike, non-commercial.
CATALOG = [
    ("CC0-1.0", "CC0-1.0", True, True, True, False, False, False),
    ("CC-BY-4.0", "CC-BY-4.0", True, True, True, True, False, False),
    ("CC-BY-SA-4.0", "CC-BY-SA-4.0", True, True, True, True, True, False),
    ("CC-BY-NC-SA-4.0", "CC-BY-NC-SA-4.0", False, False, False, True, True, True),
    ("CC-BY-NC-ND-4.0", "CC-BY-NC-ND-4.0", False, False, False, True, False, True),
    ("arXiv-1.0", "LicenseRef-arXiv-perpetual-nonexclusive", True, False, True, False, False, False),
    ("US-PD", "LicenseRef-US-Government-Work", True, True, True, False, False, False),
    ("PD-old", "LicenseRef-Public-Domain", True, True, True, False, False, False),
    ("COPYRIGHTED", "LicenseRef-All-Rights-Reserved", False, False, False, False, False, False),
    ("UNKNOWN", "NOASSERTION", True, False, False, False, False, False),
]

# Patterns in order, each with its key; the first match wins. No lookaround, so that other engines agree.
RULES = [
    (r"creativecommons\.org/publicdomain/zero", "CC0-1.0"),
    (r"creativecommons\.org/licenses/by-nc-nd", "CC-BY-NC-ND-4.0"),
    (r"creativecommons\.org/licenses/by-nc-sa", "CC-BY-NC-SA-4.0"),
    (r"creativecommons\.org/licenses/by-nc([^-a-z]|$)", "CC-BY-NC-SA-4.0"),
    (r"creativecommons\.org/licenses/by-sa", "CC-BY-SA-4.0"),
    (r"creativecommons\.org/licenses/by([^-a-z]|$)", "CC-BY-4.0"),
    (r"arxiv\.org/licenses/nonexclusive-distrib", "arXiv-1.0"),
    (r"^arxiv-perpetual-nonexclusive$", "arXiv-1.0"),
]
DEFAULT, UNKNOWN = "arXiv-1.0", "UNKNOWN"

TRAIN_OPEN, TRAIN_ONLY, EVAL_ONLY = "train_open", "train_only", "eval_only"
#: Worth of a partition when one of several copies is chosen.
PARTITION_VALUE = {TRAIN_OPEN: 3, TRAIN_ONLY: 2, EVAL_ONLY: 1, "excluded": 0}


def partition_of(train: bool, redistribute: bool) -> str:
    return EVAL_ONLY if not train else TRAIN_OPEN if redistribute else TRAIN_ONLY


def license_key(raw: Column) -> Column:
    """Catalog key of a raw license: the default for null or empty, UNKNOWN where no rule matches; never null."""
    low = F.lower(raw)
    out = F.when(raw.isNull() | (raw == ""), DEFAULT)
    for pattern, key in RULES:
        out = out.when(low.rlike(pattern), key)
    return out.otherwise(UNKNOWN)


def _looked_up(key: Column, values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])[key]


def spdx_id(raw: Column) -> Column:
    return _looked_up(license_key(raw), {r[0]: r[1] for r in CATALOG})


def partition(raw: Column) -> Column:
    return _looked_up(license_key(raw), {r[0]: partition_of(r[2], r[3]) for r in CATALOG})


def partition_value(part: Column) -> Column:
    return F.coalesce(_looked_up(part, PARTITION_VALUE), F.lit(0))


def catalog(spark: SparkSession) -> DataFrame:
    names = "license_key string, spdx_id string, train_ok boolean, redistributable boolean, commercial_ok boolean, attribution_required boolean, share_alike boolean, non_commercial boolean"
    return spark.createDataFrame(CATALOG, names)
