"""SQL expressions of the normal, gamma, beta and Student integrals, by their series of positive terms."""

from __future__ import annotations

TERMS = 400


def _sum(term: str) -> str:
    return f"list_sum(list_transform(range({TERMS}), lambda k: exp({term})))"


def gamma(a: str, x: str) -> str:
    """Regularised lower incomplete gamma integral, for a up to some 50; beyond 250 it is 1."""
    at = f"least(greatest({x}, 1e-300), 250.0)"
    return f"CASE WHEN {x} > 0 THEN least(1.0, {_sum(f'({a} + k) * ln({at}) - {at} - lgamma({a} + k + 1)')}) ELSE 0.0 END"


def normal(z: str) -> str:
    return f"(0.5 + 0.5 * sign({z}) * {gamma('0.5', f'(({z}) * ({z}) / 2)')})"


def beta_series(a: str, b: str, x: str, rest: str) -> str:
    """Regularised incomplete beta integral at ``x``, where ``rest`` is 1 - x; quick while x is below its mean."""
    return _sum(f"lgamma({a} + {b} + k) - lgamma({a} + 1 + k) - lgamma({b}) + ({a} + k) * ln(greatest({x}, 1e-300)) + {b} * ln(greatest({rest}, 1e-300))")


def beta(a: str, b: str, x: str) -> str:
    return f"""CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {x} <= ({a} + 1) / ({a} + {b} + 2) THEN {beta_series(a, b, x, f'(1 - {x})')}
ELSE 1 - {beta_series(b, a, f'(1 - {x})', x)} END"""


def student(z: str, df: str) -> str:
    tail = f"0.5 * ({beta(f'({df} / 2)', '0.5', f'({df} / ({df} + ({z}) * ({z})))')})"
    return f"CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END"


def student_p(t: str, df: str) -> str:
    """Two-sided p-value, for any degrees of freedom; from |t| = 20 on that of 20."""
    square = f"least(({t}) * ({t}), 400.0)"
    return f"greatest(0.0, 1 - {beta_series('0.5', f'({df} / 2)', f'({square} / ({df} + {square}))', f'({df} / ({df} + {square}))')})"


def f_p(f: str, d1: str, d2: str) -> str:
    """Upper p-value of moderate F values, for any degrees of freedom."""
    return f"greatest(0.0, 1 - {beta_series(f'({d1} / 2)', f'({d2} / 2)', f'({d1} * {f} / ({d1} * {f} + {d2}))', f'({d2} / ({d1} * {f} + {d2}))')})"


def kolmogorov(counts: str, cdf: str) -> str:
    """(n, statistic, p_value) of a table of (x, n, parameters ..) against the distribution function ``cdf`` of x."""
    return f"""SELECT CAST(total AS BIGINT) AS n, statistic, CASE WHEN statistic * sqrt(total) < 0.05 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * statistic * statistic * total))))) END AS p_value
FROM (SELECT max(total) AS total, max(greatest(abs(upto / total - c), abs(c - (upto - n) / total))) AS statistic
FROM (SELECT n, CAST(sum(n) OVER (ORDER BY x) AS DOUBLE) AS upto, CAST(sum(n) OVER () AS DOUBLE) AS total, {cdf} AS c FROM {counts}))"""
