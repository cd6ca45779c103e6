"""IEEE arithmetic and special functions as native Column expressions.

Spark SQL has no ``lgamma``, ``digamma``, ``trigamma`` or normal distribution
function, raises on division by zero under ANSI mode and returns null for
``ln(0)``. These helpers stay inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.959963984540054  # 97.5% point of the standard normal distribution
HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)

_INF = float("inf")
_NAN = float("nan")
_SHIFT = 7  # small arguments are raised by this much before the asymptotic series
_LARGE = 16  # arguments from here on take the series as they are


def num(value: Column | float | str) -> Column:
    """Double column from a column, a column name or a number."""
    if isinstance(value, str):
        return F.col(value).cast("double")
    if isinstance(value, Column):
        return value.cast("double")
    return F.lit(float(value))


def safe_div(a: Column | float, b: Column | float) -> Column:
    """Division by IEEE rules: x/0 is a signed infinity, 0/0 is NaN, null stays null."""
    a, b = num(a), num(b)
    at_zero = (
        F.when(F.isnan(a) | (a == 0.0), F.lit(_NAN))
        .when(a > 0.0, F.lit(_INF))
        .when(a < 0.0, F.lit(-_INF))
    )
    return F.when(b == 0.0, at_zero).otherwise(F.try_divide(a, b))


def safe_log(x: Column | float) -> Column:
    """Natural logarithm with ln(0) = -Infinity and NaN below zero."""
    x = num(x)
    return F.when(x == 0.0, F.lit(-_INF)).when(x < 0.0, F.lit(_NAN)).otherwise(F.ln(x))


def _lit(x: float) -> str:
    return f"({float(x)!r}D)"


def _horner(x: str, coefficients: list[float]) -> str:
    acc = _lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        acc = f"({acc} * {x} + {_lit(c)})"
    return acc


def _rising(coefficients: list[float]) -> list[float]:
    """Coefficients (low order first) of (x + 1) ... (x + shift - 1) times the given polynomial."""
    for k in range(1, _SHIFT):
        shifted = [0.0, *coefficients]
        coefficients = [k * c + s for c, s in zip([*coefficients, 0.0], shifted)]
    return coefficients


def _derivative(coefficients: list[float]) -> list[float]:
    return [k * c for k, c in enumerate(coefficients)][1:]


# x (x + 1) ... (x + shift - 1) and its derivatives: the recurrences below take
# one division each instead of one per step.
_RISING = _rising([0.0, 1.0])
_RISING_1 = _derivative(_RISING)
_RISING_2 = _derivative(_RISING_1)


def solid(x: Column) -> Column:
    """Null as NaN. The result is not nullable, so generated code for long
    polynomials carries no null checks and stays small enough to be compiled."""
    return F.coalesce(x, F.lit(_NAN))


def _solid(x: str) -> str:
    return f"coalesce({x}, double('NaN'))"


# The functions below take a column name or SQL text and hand one SQL text to
# Spark: built operator by operator, such long expressions take seconds of
# driver time.


def raised_inverse(x: str) -> Column:
    """1 / (x + shift). Project it once and pass its name as ``r`` below to keep plans small."""
    return F.expr(_raised_inverse(x))


def _raised_inverse(x: str) -> str:
    return _solid(f"1D / {_raised(x)}")


def _small(x: str, value: str) -> str:
    """The correction for the shift; large arguments are not shifted and need none."""
    return f"CASE WHEN {x} < {_lit(_LARGE)} THEN {value} ELSE 0D END"


def _raised(x: str) -> str:
    return f"({x} + {_small(x, _lit(_SHIFT))})"


def lgamma(x: str, r: str | None = None) -> Column:
    """log Gamma(x) for x > 0: shifted Stirling series."""
    r = r or _raised_inverse(x)
    y = _raised(x)
    tail = f"{r} * {_horner(f'({r} * {r})', [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156])}"
    rising = _small(x, _solid(f"ln({_horner(f'({x})', _RISING)})"))
    return F.expr(f"({y} - 0.5D) * {_solid(f'ln({y})')} - {y} + {_lit(HALF_LOG_2PI)} + {tail} - {rising}")


def digamma(x: str, r: str | None = None) -> Column:
    """Derivative of log Gamma for x > 0."""
    r = r or _raised_inverse(x)
    square = f"({r} * {r})"
    tail = f"{square} * {_horner(square, [1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760, 1 / 12])}"
    below = _small(x, _solid(f"{_horner(f'({x})', _RISING_1)} / {_horner(f'({x})', _RISING)}"))
    return F.expr(f"-{_solid(f'ln({r})')} - {r} * 0.5D - {tail} - {below}")


def trigamma(x: str, r: str | None = None) -> Column:
    """Second derivative of log Gamma for x > 0."""
    r = r or _raised_inverse(x)
    square = f"({r} * {r})"
    tail = f"{r} * {square} * {_horner(square, [1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6])}"
    product, slope, bend = (_horner(f"({x})", c) for c in (_RISING, _RISING_1, _RISING_2))
    below = _small(x, _solid(f"({slope} * {slope} - {product} * {bend}) / ({product} * {product})"))
    return F.expr(f"{r} + {square} * 0.5D + {tail} + {below}")


# Rational Chebyshev coefficients of the normal distribution
# function published by W. J. Cody (Math. Comp. 23, 1969).
_CENTRE_NUM = [18154.981253343561249, 1067.6894854603709582, 161.02823106855587881, 2.2352520354606839287,
               0.065682337918207449113]
_CENTRE_DEN = [45507.789335026729956, 10260.932208618978205, 976.09855173777669322, 47.20258190468824187, 1.0]
_MIDDLE_NUM = [9842.7148383839780218, 11602.651437647350124, 6848.1904505362823326, 2494.5375852903726711,
               597.27027639480026226, 93.506656132177855979, 8.8831497943883759412, 0.39894151208813466764,
               1.0765576773720192317e-8]
_MIDDLE_DEN = [19685.429676859990727, 38912.003286093271411, 34900.952721145977266, 18615.571640885098091,
               6485.558298266760755, 1519.377599407554805, 235.38790178262499861, 22.266688044328115691, 1.0]
_TAIL_NUM = [2.9112874951168792e-5, 0.001421619193227893466, 0.022235277870649807, 0.1274011611602473639,
             0.21589853405795699, 0.02307344176494017303]
_TAIL_DEN = [7.29751555083966205e-5, 0.00378239633202758244, 0.0659881378689285515, 0.468238212480865118,
             1.28426009614491121, 1.0]
_CENTRE_END = 0.67448975
_MIDDLE_END = math.sqrt(32.0)


def norm_cdf(z: str) -> Column:
    """Standard normal distribution function, about 15 significant digits in both tails."""
    a, square = f"abs({z})", f"(({z}) * ({z}))"
    density = f"exp({square} * -0.5D)"
    centre = f"0.5D + ({z}) * {_solid(f'{_horner(square, _CENTRE_NUM)} / {_horner(square, _CENTRE_DEN)}')}"
    middle = f"{density} * {_solid(f'{_horner(a, _MIDDLE_NUM)} / {_horner(a, _MIDDLE_DEN)}')}"
    inverse = _solid(f"try_divide(1D, {square})")
    ratio = f"{inverse} * {_solid(f'{_horner(inverse, _TAIL_NUM)} / {_horner(inverse, _TAIL_DEN)}')}"
    outer = f"{density} * {_solid(f'try_divide({_lit(1.0 / math.sqrt(2.0 * math.pi))} - {ratio}, {a})')}"
    upper = f"CASE WHEN {a} <= {_lit(_MIDDLE_END)} THEN {middle} ELSE {outer} END"
    return F.expr(
        f"CASE WHEN isnan({z}) THEN double('NaN') "
        f"WHEN {a} = double('Infinity') THEN CASE WHEN {z} > 0D THEN 1D ELSE 0D END "
        f"WHEN {a} <= {_lit(_CENTRE_END)} THEN {centre} "
        f"WHEN {z} > 0D THEN 1D - ({upper}) ELSE {upper} END"
    )
