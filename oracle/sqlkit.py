"""SQL text helpers for exact decimal rounding in DuckDB.

DuckDB turns decimal division into DOUBLE, and rounding a double can land on
the wrong side of a half (1.005 is stored as 1.00499...). The helpers below
scale both operands to integers (HUGEINT) and round the quotient with integer
arithmetic, half away from zero:

    round(a / b, s) = sign(a*b) * ((2*|a|*10^s + |b|) // (2*|b|)) / 10^s

The result is returned as DOUBLE (the integer divided by 10^s).
"""

from __future__ import annotations


def scaled_int(expr: str, scale: int) -> str:
    """Exact decimal (or integer) expression with at most ``scale`` decimals, times 10^scale."""
    if scale == 0:
        return f"CAST(({expr}) AS HUGEINT)"
    return f"CAST(({expr}) * {10 ** scale} AS HUGEINT)"


def round_int_ratio(a: str, b: str, s: int) -> str:
    """HUGEINT ``round(a / b, s) * 10^s`` for integer expressions a, b (NULL if b = 0)."""
    q = f"((2 * abs({a}) * {10 ** s} + abs({b})) // (2 * abs({b})))"
    sign = f"(CASE WHEN ({a} < 0) <> ({b} < 0) THEN -1 ELSE 1 END)"
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE {sign} * {q} END)"


def int_ratio(a: str, b: str, s: int) -> str:
    """DOUBLE ``round(a / b, s)`` for integer expressions a, b."""
    return f"(CAST({round_int_ratio(a, b, s)} AS DOUBLE) / {10 ** s})"


def rdiv(n: str, d: str, s: int, *, ns: int = 2, ds: int = 2, pct: bool = False) -> str:
    """DOUBLE ``round(n / d, s)`` (``100 * n / d`` when pct) for exact decimals.

    ``ns`` / ``ds`` are the numbers of decimals of n and d (0 for counts).
    NULL when d is 0 or either side is NULL.
    """
    a = f"({scaled_int(n, ns)} * {10 ** ds * (100 if pct else 1)})"
    b = f"({scaled_int(d, ds)} * {10 ** ns})"
    return int_ratio(a, b, s)


def ravg(col: str, s: int, *, cs: int = 2) -> str:
    """DOUBLE ``round(avg(col), s)`` computed as an exact sum / count."""
    return rdiv(f"SUM({col})", f"COUNT({col})", s, ns=cs, ds=0)


def fixed(total: str, count: str, *, ts: int = 2) -> str:
    """HUGEINT M with ``total / count`` = M / 10^16, rounded half away from zero at 16 decimals."""
    return round_int_ratio(f"({scaled_int(total, ts)})", f"({scaled_int(count, 0)} * {10 ** ts})", 16)


def fixed_avg(col: str, *, cs: int = 2) -> str:
    return fixed(f"SUM({col})", f"COUNT({col})", ts=cs)


def fixed_round(m: str, s: int) -> str:
    """DOUBLE ``round(M / 10^16, s)`` for a fixed-point HUGEINT M."""
    return int_ratio(f"({m})", str(10 ** 16), s)


def dbl(expr: str) -> str:
    """Exact decimal with at most the wanted decimals, as DOUBLE."""
    return f"CAST(({expr}) AS DOUBLE)"


def rnd(expr: str, s: int, *, xs: int) -> str:
    """DOUBLE ``round(expr, s)`` of an exact decimal with ``xs`` decimals."""
    if xs <= s:
        return dbl(expr)
    return rdiv(expr, "1", s, ns=xs, ds=0)


def month(col: str) -> str:
    return f"CAST(date_trunc('month', {col}) AS DATE)"


def quarter(col: str) -> str:
    return f"CAST(date_trunc('quarter', {col}) AS DATE)"


def year(col: str) -> str:
    return f"CAST(date_trunc('year', {col}) AS DATE)"


# The labels of a comparison.
ABOVE, BELOW, EQUAL = "Above Average", "Below Average", "Equal to Average"


def compared(a: str, b: str) -> str:
    """Label of a against b; a null comparison counts as equal."""
    return f"CASE WHEN {a} > {b} THEN '{ABOVE}' WHEN {a} < {b} THEN '{BELOW}' ELSE '{EQUAL}' END"


def label(col: str) -> str:
    """'Mon-YYYY' text of a date."""
    return f"strftime({col}, '%b-%Y')"
