"""Tail probabilities that have no built-in, as column expressions and as the same SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rational approximation of the normal tail below 5 * sqrt(2), highest power first,
# and the constants of the continued fraction beyond it.
_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_SPLIT, _ROOT, _END, _LAST = 7.07106781186547, 2.506628274631, 37.0, 0.65
#: The exact distribution is made for so many differences at most.
EXACT = 50


def normal_upper(z: Column | str) -> Column:
    """P(Z > z), to about fourteen digits."""
    z = F.col(z) if isinstance(z, str) else z
    a = F.abs(z)
    poly = lambda cs: reduce(lambda s, c: s * a + F.lit(c), cs[1:], F.lit(cs[0]))
    far = a + F.lit(_LAST)
    for k in (4.0, 3.0, 2.0, 1.0):
        far = a + F.lit(k) / far
    e = F.exp(-a * a / 2.0)
    tail = F.when(a > _END, 0.0).when(a < _SPLIT, e * poly(_TOP) / poly(_BOTTOM)).otherwise(e / far / _ROOT)
    return F.when(z > 0, tail).otherwise(1.0 - tail)


def normal_upper_sql(z: str) -> str:
    a = f"abs({z})"
    poly = lambda cs: reduce(lambda s, c: f"({s} * {a} + {c!r}e0)", cs[1:], f"{cs[0]!r}e0")
    far = f"({a} + {_LAST!r}e0)"
    for k in (4, 3, 2, 1):
        far = f"({a} + {k}.0e0 / {far})"
    e = f"exp(-{a} * {a} / 2.0e0)"
    tail = f"case when {a} > {_END!r}e0 then 0.0e0 when {a} < {_SPLIT!r}e0 then {e} * {poly(_TOP)} / {poly(_BOTTOM)} else {e} / {far} / {_ROOT!r}e0 end"
    return f"case when {z} > 0 then {tail} when {z} <= 0 then 1.0e0 - {tail} end"


def signed_rank_upper(w: Column | str, n: Column | str, most: int = EXACT) -> Column:
    """Exact P(W+ >= w) for n untied differences, from the counts of rank subsets by sum; null for more than ``most``."""
    w, n = (F.col(c) if isinstance(c, str) else c for c in (w, n))
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    fits = (n >= 1) & (n <= most)
    size = F.when(fits, n).otherwise(1).cast("int")
    # each rank is in the subset or not
    ways = F.aggregate(F.sequence(F.lit(1), size), F.array(F.lit(1.0)), lambda s, r: F.zip_with(F.concat(s, zeros(r)), F.concat(zeros(r), s), lambda a, b: a + b))
    above = F.aggregate(F.slice(ways, F.ceil(w).cast("int") + 1, F.size(ways)), F.lit(0.0), lambda a, b: a + b)
    return F.when(fits & w.isNotNull(), above / F.pow(F.lit(2.0), size))


#: ``signed_rank(n, w, ways)``: the number of subsets of the ranks 1 to n by their sum, as a recursion.
SIGNED_RANK_SQL = f"""
signed_rank(n, w, ways) as (select 0::bigint, 0::bigint, 1.0::double union all
  select n + 1, w + take * (n + 1), sum(ways) from signed_rank, (values (0), (1)) x(take) where n < {EXACT} group by 1, 2)
"""


def chi2_upper_2(x: Column) -> Column:
    """P(chi-square with two degrees of freedom > x)."""
    return F.exp(-x / 2.0)
