"""Chi-square tail probability as a SQL text, applied to one-row results only."""

from __future__ import annotations

TERMS = 200


def _sum_of_powers(half: str, first: str, offset: str, n: str) -> str:
    """The sum of exp(first), then of terms each ``half`` / (i + offset) times the last; n terms.

    Terms are kept as logarithms, so a small factor in front does not lose them.
    """
    step = f"acc.log + ln({half}) - ln(i + {offset})"
    start = f"named_struct('log', {first}, 'total', exp({first}))"
    return (
        f"aggregate(sequence(1, CAST({n} AS INT)), {start}, (acc, i) -> if(i < {n},"
        f" named_struct('log', {step}, 'total', acc.total + exp({step})), acc), acc -> acc.total)"
    )


def erfc_of_root(half: str) -> str:
    """erfc(sqrt(half)): 1 - erf by its series of positive terms, a continued fraction beyond 2."""
    series = _sum_of_powers(half, f"0.5D * ln({half}) - {half} - ln(sqrt(pi()) / 2)", "0.5D", "80")
    fraction = (
        f"aggregate(sequence({TERMS}, 1, -1), 1D, (f, i) -> 1 + i / (2 * {half}) / f)"
    )
    tail = f"exp(-{half}) / sqrt(pi() * {half}) / {fraction}"
    return f"if({half} < 2, 1 - {series}, {tail})"


def chi_square_p(x: str, dof: str) -> str:
    """P(X >= x) for a whole number of degrees of freedom; 1 where there are none.

    The finite sum for even dof, and erfc plus a finite sum for odd dof: all terms are positive, so
    tiny probabilities keep their digits. Stays inside Spark: nothing has to be on the workers.
    """
    half = f"({x} / 2D)"
    even = _sum_of_powers(half, f"-{half}", "0", f"({dof} div 2)")
    odd = _sum_of_powers(half, f"0.5D * ln({half}) - {half} - ln(sqrt(pi()) / 2)", "0.5D", f"({dof} div 2)")
    return (
        f"CASE WHEN {x} IS NULL OR {dof} IS NULL OR {dof} < 0 THEN NULL"
        f" WHEN {dof} = 0 OR {x} <= 0 THEN 1D"
        f" WHEN {dof} % 2 = 0 THEN least(1D, {even})"
        f" WHEN {dof} = 1 THEN {erfc_of_root(half)}"
        f" ELSE least(1D, {erfc_of_root(half)} + {odd}) END"
    )
