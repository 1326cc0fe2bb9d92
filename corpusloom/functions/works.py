"""Bibliographic works: preprint ids, parsed records and the loose filter before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import short_id

# Preprint ids, old and new form.
ID = r"(?:[a-z][a-z-]*(?:\.[A-Za-z]{2})?/\d{7}|\d{4}\.\d{4,5})"
IN_URL = rf"(?i)arxiv\.org/abs/({ID})"
IN_DOI = rf"(?i)10\.48550/arxiv\.({ID})"

SCHEMA = (
    "id string, doi string, title string, publication_year int, publication_date date, type string, language string, cited_by_count int, "
    "locations array<struct<landing_page_url:string,source:struct<display_name:string>>>, referenced_works array<string>, "
    "open_access struct<is_oa:boolean,oa_status:string>, primary_topic struct<display_name:string,field:struct<display_name:string>>"
)


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit(""))


def preprint_id(doi: Column, locations: Column) -> Column:
    """Id in the DOI, or in the first landing page that has one; version suffixes are no part of it."""
    urls = F.filter(F.transform(locations, lambda x: _found(x["landing_page_url"], IN_URL)), lambda x: x.isNotNull())
    return F.coalesce(_found(doi, IN_DOI), F.try_element_at(urls, F.lit(1)))


def maybe_preprint(doi: Column, locations: Column) -> Column:
    """A cheap test that is true for every row of which preprint_id is not null."""
    return F.coalesce(F.lower(doi).contains("arxiv"), F.lit(False)) | F.coalesce(F.exists(locations, lambda x: F.lower(x["landing_page_url"]).contains("arxiv")), F.lit(False))


def parse_works(works: DataFrame, only_preprints: bool = False) -> DataFrame:
    """Flat works. ``n_references`` counts references before null ones go, ``referenced_works`` has them after."""
    if only_preprints:
        works = works.where(maybe_preprint(F.col("doi"), F.col("locations")))
    refs = F.transform(F.coalesce("referenced_works", F.array().cast("array<string>")), lambda r: F.nullif(short_id(r), F.lit("")))
    out = works.select(
        short_id(F.col("id")).alias("openalex_id"),
        preprint_id(F.col("doi"), F.col("locations")).alias("arxiv_id"),
        F.nullif(F.replace(F.col("doi"), F.lit("https://doi.org/"), F.lit("")), F.lit("")).alias("doi"),
        "title",
        "publication_year",
        F.date_format("publication_date", "yyyy-MM-dd").alias("publication_date"),
        "type",
        "language",
        F.col("open_access.is_oa").alias("is_oa"),
        F.col("open_access.oa_status").alias("oa_status"),
        "cited_by_count",
        F.size(refs).alias("n_references"),
        F.filter(refs, lambda r: r.isNotNull()).alias("referenced_works"),
        F.col("primary_topic.field.display_name").alias("openalex_field"),
        F.col("primary_topic.display_name").alias("openalex_topic"),
    )
    return out.where("arxiv_id is not null") if only_preprints else out
