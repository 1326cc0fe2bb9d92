"""Verification of claims: verdict algebra, conservation by join, and formula verifiers.

Narrower than a computer algebra system: exact forms are quotients of polynomials, numbers are real, limits are taken
along a converging sequence. What they cannot decide is "inconclusive" and never "pass".
"""

from __future__ import annotations

import json
import random
import signal
import sys
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formula as fm

PASS, FAIL, INCONCLUSIVE, ERROR = "pass", "fail", "inconclusive", "error"
HIGH_CONFIDENCE = 0.9


def reward(verdict: Column, confidence: Column) -> Column:
    """+1 and -1 for decided verdicts, 0 for the others, times the confidence."""
    return F.when(verdict == PASS, 1.0).when(verdict == FAIL, -1.0).otherwise(0.0) * confidence


def combined(results: DataFrame, claim: str = "claim_id", order: str = "ord") -> DataFrame:
    """(claim, verdict, confidence) from rows (claim, ord, verdict, confidence).

    Pass against fail is an error and never a vote; errors count only if nothing was decided; a failure has the
    confidence of the first sure one, or else the first; a pass has the least confidence, less 15 % for each of up to three inconclusive results.
    """
    is_ = lambda v: F.col("verdict") == v
    sure = is_(FAIL) & (F.col("confidence") >= HIGH_CONFIDENCE)
    out = results.groupBy(claim).agg(
        *[F.count_if(is_(v)).alias(v) for v in (PASS, FAIL, INCONCLUSIVE, ERROR)],
        F.min(F.when(is_(PASS), F.col("confidence"))).alias("least"),
        F.coalesce(F.min_by(F.when(sure, F.col("confidence")), F.when(sure, F.col(order))), F.min_by(F.when(is_(FAIL), F.col("confidence")), F.when(is_(FAIL), F.col(order)))).alias("failing"),
    )
    p, f, i, e = (F.col(v) for v in (PASS, FAIL, INCONCLUSIVE, ERROR))
    verdict = F.when((f > 0) & (p > 0), ERROR).when(f > 0, FAIL).when(p > 0, PASS).when(e > 0, ERROR).otherwise(INCONCLUSIVE)
    confidence = F.when((f > 0) & (p > 0), 0.0).when(f > 0, F.col("failing")).when(p > 0, F.round(F.col("least") * (1 - 0.15 * F.least(i, F.lit(3))), 3)).otherwise(0.0)
    return out.select(claim, verdict.alias("verdict"), confidence.alias("confidence"))


# Particle, charge, baryon number, electron, muon and tau lepton numbers.
PARTICLES = [
    ("gamma", 0, 0, 0, 0, 0), ("g", 0, 0, 0, 0, 0), ("Z0", 0, 0, 0, 0, 0), ("W+", 1, 0, 0, 0, 0), ("W-", -1, 0, 0, 0, 0), ("H", 0, 0, 0, 0, 0),
    ("e-", -1, 0, 1, 0, 0), ("e+", 1, 0, -1, 0, 0), ("mu-", -1, 0, 0, 1, 0), ("mu+", 1, 0, 0, -1, 0), ("tau-", -1, 0, 0, 0, 1), ("tau+", 1, 0, 0, 0, -1),
    ("nu_e", 0, 0, 1, 0, 0), ("nu_e_bar", 0, 0, -1, 0, 0), ("nu_mu", 0, 0, 0, 1, 0), ("nu_mu_bar", 0, 0, 0, -1, 0), ("nu_tau", 0, 0, 0, 0, 1), ("nu_tau_bar", 0, 0, 0, 0, -1),
    ("p", 1, 1, 0, 0, 0), ("p_bar", -1, -1, 0, 0, 0), ("n", 0, 1, 0, 0, 0), ("n_bar", 0, -1, 0, 0, 0), ("Lambda0", 0, 1, 0, 0, 0),
    ("Sigma+", 1, 1, 0, 0, 0), ("Sigma0", 0, 1, 0, 0, 0), ("Sigma-", -1, 1, 0, 0, 0), ("Xi0", 0, 1, 0, 0, 0), ("Xi-", -1, 1, 0, 0, 0), ("Omega-", -1, 1, 0, 0, 0),
    ("pi+", 1, 0, 0, 0, 0), ("pi-", -1, 0, 0, 0, 0), ("pi0", 0, 0, 0, 0, 0), ("K+", 1, 0, 0, 0, 0), ("K-", -1, 0, 0, 0, 0), ("K0", 0, 0, 0, 0, 0), ("K0_bar", 0, 0, 0, 0, 0),
    ("eta", 0, 0, 0, 0, 0), ("rho+", 1, 0, 0, 0, 0), ("rho-", -1, 0, 0, 0, 0), ("rho0", 0, 0, 0, 0, 0),
]
NUMBERS = ("q", "b", "le", "lmu", "ltau")


def particles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARTICLES, "particle string, q int, b int, le int, lmu int, ltau int")


def conserved(reactions: DataFrame, claim: str = "claim_id", before: str = "before", after: str = "after") -> DataFrame:
    """(claim, verdict, confidence) of reactions: a join with the particle table (fixed size) and sums, no Python.

    "2gamma" counts twice, "Z:A" is a nucleus; an unknown particle or an empty side is inconclusive.
    """
    spark = reactions.sparkSession
    side = lambda col, sign: reactions.select(claim, F.explode(F.coalesce(col, F.array().cast("array<string>"))).alias("name"), F.lit(sign).alias("sign"))
    rows = side(before, -1).unionByName(side(after, 1)).withColumn("name", F.trim("name"))
    many = F.col("name").rlike("^[1-9][^0-9]") & ~F.contains(F.col("name"), F.lit(":"))
    rows = rows.select(claim, "sign", F.when(many, F.substring("name", 1, 1).cast("int")).otherwise(1).alias("times"), F.when(many, F.expr("substring(name, 2)")).otherwise(F.col("name")).alias("particle"))
    nucleus = F.regexp_extract(F.col("particle"), r"^\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*$", 0) != ""
    part = lambda i: F.regexp_extract(F.col("particle"), r"^\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*$", i).try_cast("int")
    rows = rows.join(F.broadcast(particles(spark)), "particle", "left")
    given = {"q": F.coalesce("q", F.when(nucleus, part(1))), "b": F.coalesce("b", F.when(nucleus, part(2)))}
    for c in ("le", "lmu", "ltau"):
        given[c] = F.coalesce(c, F.when(nucleus, F.lit(0)))
    rows = rows.withColumns(given)
    sums = rows.groupBy(claim).agg(
        F.count_if(F.col("q").isNull()).alias("unknown"), F.count_if(F.col("sign") < 0).alias("n_before"), F.count_if(F.col("sign") > 0).alias("n_after"),
        *[F.sum(F.col(c) * F.col("sign") * F.col("times")).alias(f"d_{c}") for c in NUMBERS],
    )
    out = reactions.select(claim).join(sums, claim, "left")
    open_ = F.coalesce((F.col("unknown") > 0) | (F.col("n_before") == 0) | (F.col("n_after") == 0), F.lit(True))
    equal = F.lit(True)
    for c in NUMBERS:
        equal = equal & (F.col(f"d_{c}") == 0)
    verdict = F.when(open_, INCONCLUSIVE).when(equal, PASS).otherwise(FAIL)
    return out.select(claim, verdict.alias("verdict"), F.when(open_, 0.0).otherwise(1.0).alias("confidence"))


# ---- verifiers of formulas: (lhs, rhs, context) to (verdict, confidence, evidence), or None where one does not apply
Result = tuple[str, float, str]
MARKERS = ("\\hat", "\\mathbf", "\\vec", "\\boldsymbol", "\\bm", "\\times", "\\dagger", "\\otimes", "[")
SAMPLES, DIGITS, TOLERANCE = 20, 50, Decimal("1e-35")


def noncommutative(lhs: str, rhs: str | None, context: dict) -> bool:
    return bool(context.get("noncommutative")) or any(m in (lhs or "") + (rhs or "") for m in MARKERS)


def _both(lhs: str, rhs: str | None, context: dict) -> tuple | None:
    names = frozenset(context.get("dimensions") or {})
    a, b = fm.parse(lhs, names), fm.parse(rhs, names)
    return None if a is None or b is None else (a, b)


def symbolic(lhs: str, rhs: str | None, context: dict) -> Result | None:
    if rhs is None:
        return None
    both = _both(lhs, rhs, context)
    if both is None or noncommutative(lhs, rhs, context):
        return INCONCLUSIVE, 0.0, "not covered by exact forms"
    same = fm.equal_forms(*both)
    if same:
        return PASS, 0.99, "equal exact forms"
    if same is False:
        return FAIL, 0.95, "different exact forms"
    return INCONCLUSIVE, 0.0, "exact forms do not tell"


def numeric(lhs: str, rhs: str | None, context: dict) -> Result | None:
    """Values at positive points away from 0 and 1, to 50 digits; claims about complex numbers are left open."""
    if rhs is None or noncommutative(lhs, rhs, context):
        return None
    both = _both(lhs, rhs, context)
    if both is None or context.get("complex"):
        return INCONCLUSIVE, 0.0, "not covered by real numbers"
    names, rng = sorted(fm.symbols(both[0]) | fm.symbols(both[1])), random.Random(17)
    good = bad = 0
    for _ in range(SAMPLES if names else 1):
        at = {s: Decimal(rng.choice([rng.randint(200, 899), rng.randint(1101, 5000)])) / 1000 for s in names}
        x, y = (fm.evaluated(t, at, DIGITS + 10) for t in both)
        if x is None or y is None:
            continue
        if abs(x - y) / max(abs(x), abs(y), Decimal(1)) < TOLERANCE:
            good += 1
        else:
            bad += 1
    if good + bad < (SAMPLES // 2 if names else 1):
        return INCONCLUSIVE, 0.0, "too few points have a value"
    if bad:
        return FAIL, 0.95 if names else 1.0, f"differ at {bad} of {good + bad} points"
    return PASS, 0.9 if names else 0.95, f"agree at {good} points"


def dimensional(lhs: str, rhs: str | None, context: dict) -> Result | None:
    """Dimensions in declared units; declared before known symbols, ambiguous ones never resolved."""
    if rhs is None and "+" not in lhs and "-" not in lhs:
        return None
    system = context.get("unit_system")
    if system not in ("SI", "natural", "hep"):
        return INCONCLUSIVE, 0.0, f"no table for units {system}"
    known = dict(fm.SYMBOLS)
    for name, spec in (context.get("dimensions") or {}).items():
        if isinstance(spec, str) and spec not in fm.QUANTITIES:
            return INCONCLUSIVE, 0.0, f"unknown quantity {spec}"
        known[name] = fm.QUANTITIES[spec] if isinstance(spec, str) else fm.dim(**spec)
    names = frozenset(context.get("dimensions") or {})
    sides, natural = [], system != "SI"
    for text in (lhs, rhs):
        if text is None:
            continue
        tree = fm.parse(text, names)
        if tree is None:
            return INCONCLUSIVE, 0.0, "not in the language"
        try:
            sides.append(fm.dimension(tree, known))
        except fm.Unknown as e:
            sides.append(e)
        except fm.Clash as e:
            if natural and fm.mass_power(e.sides[0]) == fm.mass_power(e.sides[1]):
                return INCONCLUSIVE, 0.0, "terms differ only by powers of hbar and c"
            return FAIL, 0.98, "sum of different dimensions"
    unknown = [x for x in sides if isinstance(x, Exception)]
    if unknown:
        return INCONCLUSIVE, 0.0, f"dimension of {unknown[0]} is not known"
    if len(sides) == 1:
        return PASS, 0.9, "all terms of one dimension"
    if natural:
        same = fm.mass_power(sides[0]) == fm.mass_power(sides[1])
        return (PASS, 0.75, "equal powers of energy") if same else (FAIL, 0.95, "different powers of energy")
    return (PASS, 0.95, "equal dimensions") if sides[0] == sides[1] else (FAIL, 0.98, "different dimensions")


# Named reductions, their variable, its limit and how they are judged.
REDUCTIONS = {
    "v/c->0": ("v", "0", "dominante"), "hbar->0": ("hbar", "0", "auto"), "campo-fraco": ("v", "0", "dominante"), "T->inf": ("T", "inf", "limite"),
    "T->0": ("T", "0", "limite"), "r->inf": ("r", "inf", "limite"), "N->inf": ("N", "inf", "limite"), "acoplamento->0": ("g", "0", "auto"),
}
APPROACH = ("1e-1", "1e-2", "1e-3", "1e-4", "1e-6", "1e-9", "1e-12")


def limits(lhs: str, rhs: str | None, context: dict) -> Result | None:
    """Values along a sequence to the limit, with the other symbols fixed: the difference (or, for a dominant term, the ratio's distance from 1) must vanish."""
    spec = context.get("limit")
    if not isinstance(spec, dict) or not (spec.get("expected") or rhs):
        return None
    if spec.get("name"):
        if spec["name"] not in REDUCTIONS:
            return INCONCLUSIVE, 0.0, "unknown reduction"
        var, to, mode = REDUCTIONS[spec["name"]]
        spec = {"var": var, "to": to, "mode": mode} | spec
    expr, expected = fm.parse(lhs), fm.parse(str(spec.get("expected") or rhs))
    if "var" not in spec or expr is None or expected is None or spec["var"] not in fm.symbols(expr):
        return INCONCLUSIVE, 0.0, "no limit to take"
    var, mode = spec["var"], spec.get("mode", "auto")
    infinite = str(spec.get("to", "0")) in ("inf", "oo", "+inf")
    others = sorted((fm.symbols(expr) | fm.symbols(expected)) - {var})
    fixed = {s: Decimal(p) / 7 for s, p in zip(others, (3, 5, 11, 13, 17, 19, 23, 29, 31, 37), strict=False)}
    if len(fixed) < len(others):
        return INCONCLUSIVE, 0.0, "too many symbols"
    gaps, ratios = [], []
    for eps in APPROACH:
        at = fixed | {var: 1 / Decimal(eps) if infinite else Decimal(str(spec.get("to", "0"))) + Decimal(eps)}
        x, y = fm.evaluated(expr, at, 80), fm.evaluated(expected, at, 80)
        if x is None or y is None:
            return INCONCLUSIVE, 0.0, "no value near the limit"
        gaps.append(abs(x - y) / max(abs(x), abs(y), Decimal(1)))
        ratios.append(abs(x / y - 1) if y else Decimal(1))
    falls = lambda v: v[-1] < Decimal("1e-9") and v[-1] <= v[0]
    if mode in ("limite", "auto") and falls(gaps) or mode in ("dominante", "auto") and falls(ratios):
        return PASS, 0.7, "agrees along the sequence"
    settled = abs(gaps[-1] - gaps[-2]) < Decimal("1e-6") and gaps[-1] > Decimal("1e-3")
    if settled and ratios[-1] > Decimal("1e-3"):
        return FAIL, 0.9, "tends to something else"
    return INCONCLUSIVE, 0.0, "the sequence does not decide"


def constant_in_time(lhs: str, rhs: str | None, context: dict) -> Result | None:
    """A quantity along a declared solution: constant in its exact form, or at sampled times."""
    spec = context.get("conserved")
    if not isinstance(spec, dict):
        return None
    if spec.get("quantity") in ("unitaridade", "unitarity", "norma"):
        return INCONCLUSIVE, 0.0, "integrals are not covered"
    tree, var = fm.parse(str(spec.get("expr") or lhs)), spec.get("var", "t")
    solution = {k: fm.parse(str(v)) for k, v in (spec.get("solution") or {}).items()}
    if tree is None or None in solution.values():
        return INCONCLUSIVE, 0.0, "not in the language"
    tree = fm.substituted(tree, solution)
    if var not in fm.symbols(tree):
        return PASS, 0.85, "does not depend on the variable"
    form = fm.quotient(tree)
    if form and fm.equal_forms(tree, fm.substituted(tree, {var: ("num", Fraction(7, 5))})):
        return PASS, 0.95, "constant in its exact form"
    others = sorted(fm.symbols(tree) - {var})
    fixed = {s: Decimal(p) / 7 for s, p in zip(others, (3, 5, 11, 13, 17, 19, 23), strict=False)}
    points = [fm.evaluated(tree, fixed | {var: Decimal(a) / b}, 60) for a, b in ((1, 3), (7, 5), (11, 4), (17, 3), (23, 2))]
    if len(fixed) < len(others) or None in points:
        return INCONCLUSIVE, 0.0, "no values"
    spread = max(abs(p - points[0]) for p in points) / max(max(abs(p) for p in points), Decimal(1))
    return (PASS, 0.75, "constant at five times") if spread < Decimal("1e-12") else (FAIL, 0.9, "varies")


VERIFIERS: dict[str, Callable[[str, str | None, dict], Result | None]] = {
    "symbolic": symbolic, "numeric": numeric, "dimensional": dimensional, "limits": limits, "conservation": constant_in_time,
}


#: Seconds that a verifier may take for a claim, and calls that may nest in it: a sum of n terms nests n deep.
SECONDS, NESTING = 5.0, 20_000


class TooLong(Exception):
    pass


@contextmanager
def time_limit(seconds: float) -> Iterator[None]:
    """TooLong after so many seconds; without effect outside a process's main thread, where signals do not arrive."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_: object) -> None:
        raise TooLong

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def run_all(lhs: str, rhs: str | None, context: dict) -> list[tuple[int, str, str, float, str]]:
    """(ord, verifier, verdict, confidence, evidence) of all that apply; an exception is an error and ends nothing.

    What takes too long or nests too deeply is undecided, with that as its evidence.
    """
    out, before = [], sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, NESTING))
    for i, (name, verifier) in enumerate(VERIFIERS.items()):
        try:
            with time_limit(SECONDS):
                got = verifier(lhs, rhs, context)
        except TooLong:
            got = INCONCLUSIVE, 0.0, f"no answer in {SECONDS:g} s"
        except RecursionError:
            got = INCONCLUSIVE, 0.0, "nested too deeply"
        except Exception as e:
            got = ERROR, 0.0, f"{type(e).__name__}: {e}"[:300]
        if got is not None:
            out.append((i, name, *got))
    sys.setrecursionlimit(before)
    return out


RESULTS = T.ArrayType(T.StructType().add("ord", T.IntegerType()).add("verifier", T.StringType()).add("verdict", T.StringType()).add("confidence", T.DoubleType()).add("evidence", T.StringType()))


@F.pandas_udf(RESULTS)
def verified(lhs: pd.Series, rhs: pd.Series, context: pd.Series) -> pd.Series:
    names = ("ord", "verifier", "verdict", "confidence", "evidence")
    return pd.Series([[dict(zip(names, r, strict=True)) for r in run_all(a or "", b, json.loads(c) if c else {})] for a, b, c in zip(lhs, rhs, context, strict=True)])


def check_claims(claims: DataFrame, claim: str = "claim_id", lhs: str = "lhs", rhs: str = "rhs", context: str = "context") -> DataFrame:
    """(claim, verdict, confidence, reward): every applicable verifier, then the verdict algebra; context is JSON."""
    rows = claims.select(claim, F.explode(verified(lhs, rhs, context)).alias("r")).select(claim, "r.*")
    out = claims.select(claim).join(combined(rows, claim), claim, "left")
    out = out.select(claim, F.coalesce("verdict", F.lit(INCONCLUSIVE)).alias("verdict"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return out.withColumn("reward", reward(F.col("verdict"), F.col("confidence")))
