"""Subject categories: modern archives, family membership and subfields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Archives that were absorbed, with their modern archive.
LEGACY = {
    "chao-dyn": "nlin", "solv-int": "nlin", "patt-sol": "nlin", "comp-gas": "nlin", "adap-org": "nlin",
    "acc-phys": "physics", "ao-sci": "physics", "atom-ph": "physics", "bayes-an": "physics", "chem-ph": "physics", "plasm-ph": "physics",
    "mtrl-th": "cond-mat", "supr-con": "cond-mat",
    "q-alg": "math", "alg-geom": "math", "dg-ga": "math", "funct-an": "math",
    "cmp-lg": "cs",
}

# Archives of the family with their subfields, and the subfield of all others.
SUBFIELDS = {
    "astro-ph": "Astrofísica e Cosmologia", "cond-mat": "Matéria Condensada",
    "gr-qc": "Relatividade e Gravitação", "hep-th": "Teoria de Campos e Cordas",
    "hep-ph": "Partículas (fenomenologia)", "hep-ex": "Partículas (experimental)",
    "hep-lat": "QCD na rede", "nucl-th": "Física Nuclear (teoria)",
    "nucl-ex": "Física Nuclear (experimental)", "quant-ph": "Mecânica Quântica",
    "math-ph": "Física Matemática", "nlin": "Dinâmica Não-Linear",
    "physics": "Física (diversos)",
}
OTHER = "Outro"

# Whole categories of supporting mathematics.
MATH_SUPPORT = ("math.AP", "math.CA", "math.DG", "math.OC", "math.PR", "math.ST", "math.NA", "math.RA", "math.FA", "math.DS", "funct-an", "dg-ga")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])


def archive(category: Column) -> Column:
    """What stands before the first dot, with absorbed archives under their modern name."""
    head = F.split(category, r"\.")[0]
    return F.coalesce(_map(LEGACY)[head], head)


def archives(categories: Column) -> Column:
    """Distinct archives of a list of categories, sorted."""
    return F.array_sort(F.array_distinct(F.transform(categories, archive)))


def is_physics(categories: Column) -> Column:
    """Whether any category's archive is of the family."""
    return F.exists(archives(categories), lambda a: a.isin(*SUBFIELDS))


def is_math_support(categories: Column) -> Column:
    return F.arrays_overlap(categories, F.array(*[F.lit(c) for c in MATH_SUPPORT]))


def subfield(arch: Column) -> Column:
    return F.coalesce(_map(SUBFIELDS)[arch], F.lit(OTHER))


def primary_has_prefix(primary: Column, prefixes: tuple[str, ...] = tuple(SUBFIELDS)) -> Column:
    """Whether the primary category begins with one of the prefixes; unlike is_physics it sees no other category."""
    out = F.lit(False)
    for p in prefixes:
        out = out | primary.startswith(p)
    return F.coalesce(out, F.lit(False))


def lenient_year(date: Column) -> Column:
    """The first four characters as a number, null where they are none."""
    return F.substring(date, 1, 4).try_cast("int")


def recover_subfield(df: DataFrame, subfield_col: str = "subfield", category_col: str = "primary_category") -> DataFrame:
    """Raise OTHER to a known subfield by the modern archive; never lowers; unchanged without the columns."""
    if subfield_col not in df.columns or category_col not in df.columns:
        return df
    return df.withColumn(subfield_col, F.when(F.col(subfield_col) == OTHER, subfield(archive(F.col(category_col)))).otherwise(F.col(subfield_col)))
