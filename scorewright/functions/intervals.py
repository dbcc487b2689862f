"""Intervals and detectable differences as column expressions, with the constants that fix them."""

from __future__ import annotations

Z_95 = 1.959963984540054
Z_POWER = 0.8416212335729143


def wilson(k: str, n: str) -> tuple[str, str]:
    """SQL for the bounds of the Wilson interval of k of n: null for n <= 0, exactly 0 at k = 0 and 1 at k = n, an error
    for a k outside 0 to n."""
    z2 = f"{Z_95 * Z_95!r}D"
    p = f"(({k}) / CAST(({n}) AS DOUBLE))"
    centre = f"({p} + {z2} / (2 * ({n})))"
    half = f"({Z_95!r}D * sqrt({p} * (1 - {p}) / ({n}) + {z2} / (4.0D * ({n}) * ({n}))))"
    width = f"(1 + {z2} / ({n}))"
    wrong = f"WHEN ({k}) < 0 OR ({k}) > ({n}) THEN CAST(raise_error('a count lies outside 0 to its total') AS DOUBLE)"
    low = f"CASE WHEN ({n}) <= 0 THEN NULL {wrong} WHEN ({k}) = 0 THEN 0.0D ELSE greatest(0.0D, ({centre} - {half}) / {width}) END"
    high = f"CASE WHEN ({n}) <= 0 THEN NULL {wrong} WHEN ({k}) = ({n}) THEN 1.0D ELSE least(1.0D, ({centre} + {half}) / {width}) END"
    return low, high


def normal(centre: str, se: str) -> tuple[str, str]:
    return f"({centre} - {Z_95!r}D * ({se}))", f"({centre} + {Z_95!r}D * ({se}))"


def detectable(se: str) -> str:
    """The smallest true difference found with 80 % power at the 5 % level."""
    return f"({Z_95 + Z_POWER!r}D * ({se}))"


def rate(k: str, n: str) -> str:
    """A proportion as every check reports it: affected, measured and the interval at four decimals."""
    low, high = wilson(k, n)
    return f"named_struct('affected', {k}, 'measured', {n}, 'low', round({low}, 4), 'high', round({high}, 4))"
