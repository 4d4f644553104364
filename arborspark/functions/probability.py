"""Probability rules of the topic segmentation, as column expressions."""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborspark.functions.arrays import let


def logistic(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


#: Steps of the table of powers of two: what each is as a double, and the relative rest.
STEPS = 128
with localcontext(prec=50):
    _EXACT = [Decimal(2) ** (Decimal(i) / STEPS) for i in range(STEPS)]
    _POWERS = [float(x) for x in _EXACT]
    _RESTS = [float(x / Decimal(p) - 1) for x, p in zip(_EXACT, _POWERS, strict=True)]
#: Logarithm of two over ``STEPS`` in two parts, and the polynomial of the exponential of what is left.
_HIGH, _LOW = float.fromhex("0x1.62e42fefa0000p-8"), float.fromhex("0x1.cf79abc9e3b39p-47")
_C2, _C3, _C4, _C5 = map(float.fromhex, ("0x1.ffffffffffdbdp-2", "0x1.555555555543cp-3", "0x1.55555cf172b91p-5", "0x1.1111167a4d017p-7"))


def exponential(x: Column) -> Column:
    """``exp`` within 0.52 units of the last place, as C libraries have it; the built-in one errs by almost a whole unit.

    For arguments up to 700 in size.
    """
    table = lambda values, k: F.get(F.lit(values), F.pmod(k, F.lit(STEPS)))

    def near(k: Column) -> Column:
        return let(x - k * _HIGH - k * _LOW, lambda r: let(k.cast("int"), lambda i: made(r, i)))

    def made(r: Column, i: Column) -> Column:
        tail = table(_RESTS, i) + r + r * r * (_C2 + r * _C3) + (r * r) * (r * r) * (_C4 + r * _C5)
        scale = table(_POWERS, i) * F.pow(F.lit(2.0), F.floor(i / F.lit(STEPS)).cast("double"))
        return scale + scale * tail

    return let(F.rint(x * (STEPS / math.log(2))), near)


#: Logarithms of the 128ths from 1/2 to 3/2 and of two, each as a multiple of 2^-44 and the rest.
_FIRST = 64
with localcontext(prec=50):
    _LOGS = [(Decimal(i) / STEPS).ln() for i in range(_FIRST, 3 * _FIRST + 1)]
    _SPLIT = lambda x: (lambda high: (high, float(x - Decimal(high))))(float(round(x * 2**44)) / 2**44)
    _LOG_HIGH, _LOG_LOW = (list(v) for v in zip(*map(_SPLIT, _LOGS), strict=True))
    _TWO_HIGH, _TWO_LOW = _SPLIT(Decimal(2).ln())


def logarithm(x: Column) -> Column:
    """``ln`` of a positive number within 0.6 units of the last place, as C libraries have it; the built-in one errs by almost a whole unit."""

    def scaled(e: Column) -> Column:
        return let(x * F.pow(F.lit(2.0), -e), lambda z: let(F.rint(z * STEPS), lambda k: let((z - k / STEPS) / (k / STEPS), lambda r: made(e, k.cast("int") - _FIRST, r))))

    def made(e: Column, i: Column, r: Column) -> Column:
        series = r * r * (-0.5 + r * (1 / 3 + r * (-0.25 + r * (0.2 + r * (-1 / 6 + r / 7)))))
        low = e * _TWO_LOW + F.get(F.lit(_LOG_LOW), i)
        return let(e * _TWO_HIGH + F.get(F.lit(_LOG_HIGH), i), lambda high: let(high + r, lambda w: w + ((high - w) + r + low + series)))

    return let(F.rint(F.log2(x)), scaled)


def posterior_same(score: Column, prior: float = 0.7, same: tuple[float, float] = (2.0, 1.0), different: tuple[float, float] = (1.0, 2.0)) -> Column:
    """Bayes' rule with a Beta likelihood of the score for either case.

    Cuts compare posteriors with round numbers, so that scores like 1/20 tie. The odds are
    therefore added up as the SQL twins do, term by term: terms that cancel are left out, one
    less the prior is that of decimals, and logarithms and exponentials are rounded as theirs.
    """
    s = F.least(F.greatest(score, F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = F.lit(math.log(prior) - math.log(float(1 - Decimal(str(prior)))))
    for power, log in ((same[0] - different[0], logarithm(s)), (same[1] - different[1], logarithm(1 - s))):
        odds = odds + power * log if power else odds
    constant = lambda a, b: math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    shift = constant(*same) - constant(*different)
    return 1 / (1 + exponential(-(odds + shift if shift else odds)))


def adjust_probability(p: Column, prior: float = 0.7, reference: float = 0.5) -> Column:
    """Odds moved from one prior to another; certain values stay."""
    shift = math.log(prior) - math.log1p(-prior) - math.log(reference) + math.log1p(-reference)
    return F.when((p == 0) | (p == 1), p).otherwise(logistic(F.ln(p) - F.log1p(-p) + shift))


def separation(cross: Column, within: Column, parent: Column, threshold: float, least_parent: float = 0.05) -> dict[str, Column]:
    """Contrast of a group against its parent's; no score where the parent's is too weak."""
    weak = parent < least_parent
    raw = F.when(~weak, (cross - within) / parent)
    score = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    return {
        "leaf_signal": cross - within,
        "raw_ratio": raw,
        "score": F.when(~weak, score),
        "accept_split": F.when(~weak, score <= threshold),
        "status": F.when(weak, "insufficient_parent_reference").otherwise("scored"),
    }
