"""NumPy ufuncs as Catalyst expressions, with NumPy's answers where Spark's differ: zero divisors, logarithms out of
their domain, NaN in comparisons, wrapping integers.  A ufunc that is not here is applied by Arrow batches instead."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rowforge.functions.dtypes import spark_type, working, wrapped

NAN, INF = float("nan"), float("inf")


def _nan(x: Column) -> Column:
    return F.isnan(x)


def _negative(x: Column) -> Column:
    """The sign bit, of zeros too."""
    return (x < 0) | ((x == 0) & (F.pow(x, F.lit(-1.0)) < 0))


def _divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def _remainder(a: Column, b: Column) -> Column:
    plain = a % b
    bad = (b == 0) | _nan(a) | _nan(b) | (F.abs(a) == INF)
    return F.when(bad, F.lit(NAN)).when((plain != 0) & ((b < 0) != (plain < 0)), plain + b).otherwise(plain)


def _floor_divide(a: Column, b: Column) -> Column:
    toward = F.when((a != 0) & ((a < 0) != (b < 0)), F.lit(-1.0)).otherwise(F.lit(0.0))
    return (
        F.when(b == 0, _divide(a, b))
        .when((F.abs(a) == INF) | _nan(a) | _nan(b), F.lit(NAN))
        .when(F.abs(b) == INF, toward)
        .otherwise(F.rint((a - _remainder(a, b)) / b))
    )


def _power(a: Column, b: Column) -> Column:
    one = (a == 1) | ((a == -1) & (F.abs(b) == INF))
    return F.when(one, F.lit(1.0)).otherwise(F.pow(a, b))


def _from(least: float, f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A logarithm: -inf at the edge of its domain, NaN outside."""
    return lambda x: F.when(_nan(x), x).when(x > least, f(x)).when(x == least, F.lit(-INF)).otherwise(F.lit(NAN))


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Rounding through bigint, for numbers that have a fraction at all."""
    return lambda x: F.when(F.abs(x) < F.lit(2.0**52), F.when(_negative(x) & (f(x) == 0), F.lit(-0.0)).otherwise(f(x).cast("double"))).otherwise(x)


def _minimum(a: Column, b: Column) -> Column:
    return F.when(_nan(a) | _nan(b), F.lit(NAN)).otherwise(F.least(a, b))


def _fmax(a: Column, b: Column) -> Column:
    return F.when(_nan(a), b).when(_nan(b), a).otherwise(F.greatest(a, b))


def _arctan2(a: Column, b: Column) -> Column:
    straight = F.when(_negative(b), F.lit(np.pi)).otherwise(F.lit(0.0))
    return F.when((a == 0) & ~_nan(b), F.when(_negative(a), -straight).otherwise(straight)).otherwise(F.atan2(a, b))


def _logaddexp(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.when(_nan(a) | _nan(b), F.lit(NAN)).when(a == b, a + F.lit(float(np.log(2)))).otherwise(top + F.log1p(F.exp(-F.abs(a - b))))


def _logaddexp2(a: Column, b: Column) -> Column:
    two = float(np.log(2))
    return _logaddexp(a * two, b * two) / two


#: Of doubles.
FLOAT: dict[str, Callable] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": _divide,
    "floor_divide": _floor_divide,
    "remainder": _remainder,
    "fmod": lambda a, b: F.when(b == 0, F.lit(NAN)).otherwise(a % b),
    "power": _power,
    "float_power": _power,
    "maximum": lambda a, b: F.greatest(a, b),
    "minimum": _minimum,
    "fmax": _fmax,
    "fmin": lambda a, b: F.least(a, b),
    "arctan2": _arctan2,
    "hypot": lambda a, b: F.hypot(a, b),
    "copysign": lambda a, b: F.when(_negative(b), -F.abs(a)).otherwise(F.abs(a)),
    "heaviside": lambda a, b: F.when(_nan(a), a).when(a == 0, b).when(a < 0, F.lit(0.0)).otherwise(F.lit(1.0)),
    "logaddexp": _logaddexp,
    "logaddexp2": _logaddexp2,
    "equal": lambda a, b: (a == b) & ~_nan(a),
    "not_equal": lambda a, b: (a != b) | _nan(a),
    "greater": lambda a, b: (a > b) & ~_nan(a),
    "greater_equal": lambda a, b: (a >= b) & ~_nan(a),
    "less": lambda a, b: (a < b) & ~_nan(b),
    "less_equal": lambda a, b: (a <= b) & ~_nan(b),
    "logical_and": lambda a, b: (a != 0) & (b != 0),
    "logical_or": lambda a, b: (a != 0) | (b != 0),
    "logical_xor": lambda a, b: (a != 0) != (b != 0),
    "logical_not": lambda x: x == 0,
    "log1p": _from(-1.0, F.log1p),
    "log": _from(0.0, lambda x: F.log(x)),
    "log2": _from(0.0, F.log2),
    "log10": _from(0.0, F.log10),
    "exp": F.exp,
    "exp2": lambda x: F.pow(F.lit(2.0), x),
    "expm1": F.expm1,
    "sqrt": F.sqrt,
    "cbrt": F.cbrt,
    "square": lambda x: x * x,
    "reciprocal": lambda x: F.pow(x, F.lit(-1.0)),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "arcsin": F.asin,
    "arccos": F.acos,
    "arctan": F.atan,
    "arcsinh": F.asinh,
    "arccosh": F.acosh,
    "arctanh": F.atanh,
    "degrees": F.degrees,
    "rad2deg": F.degrees,
    "radians": F.radians,
    "deg2rad": F.radians,
    "absolute": F.abs,
    "fabs": F.abs,
    "negative": lambda x: -x,
    "positive": lambda x: x,
    "conjugate": lambda x: x,
    "sign": F.signum,
    "rint": F.rint,
    "floor": _whole(lambda x: F.floor(x)),
    "ceil": _whole(lambda x: F.ceil(x)),
    "trunc": _whole(lambda x: x.cast("bigint")),
    "isnan": _nan,
    "isinf": lambda x: F.abs(x) == INF,
    "isfinite": lambda x: (F.abs(x) < INF) & ~_nan(x),
    "signbit": _negative,
}


def _wide(x: Column) -> Column:
    """A decimal modulo 2**64, as a bigint."""
    span, half = F.lit("18446744073709551616").cast("decimal(20,0)"), F.lit("9223372036854775808").cast("decimal(20,0)")
    low = F.pmod(x, span)
    return F.when(low >= half, low - span).otherwise(low).cast("decimal(20,0)").cast("bigint")


def _turning(safe: Callable, exact: Callable) -> Callable:
    """An integer operation that wraps where the plain one would overflow."""
    return lambda a, b: F.coalesce(safe(a, b), _wide(exact(a.cast("decimal(19,0)"), b.cast("decimal(19,0)"))))


def _mod_int(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0)).otherwise(F.when((a % b != 0) & ((a < 0) != (b < 0)), a % b + b).otherwise(a % b)).cast("bigint")


def _floor_int(a: Column, b: Column) -> Column:
    quotient = F.call_function("div", a, b)
    least = F.coalesce(F.try_subtract(F.lit(0), a), a)
    return F.when(b == 0, F.lit(0)).when(b == -1, least).otherwise(F.when((a % b != 0) & ((a < 0) != (b < 0)), quotient - 1).otherwise(quotient)).cast("bigint")


def _shift(name: str, past: Callable[[Column], Column]) -> Callable:
    return lambda a, b: F.when((b < 0) | (b > 63), past(a)).otherwise(F.call_function(name, a, b.cast("int")))


#: Of bigints.
INTEGER: dict[str, Callable] = {
    "add": _turning(F.try_add, lambda a, b: a + b),
    "subtract": _turning(F.try_subtract, lambda a, b: a - b),
    "multiply": _turning(F.try_multiply, lambda a, b: a * b),
    "floor_divide": _floor_int,
    "remainder": _mod_int,
    "fmod": lambda a, b: F.when(b == 0, F.lit(0)).otherwise(a % b).cast("bigint"),
    "maximum": lambda a, b: F.greatest(a, b),
    "minimum": lambda a, b: F.least(a, b),
    "fmax": lambda a, b: F.greatest(a, b),
    "fmin": lambda a, b: F.least(a, b),
    "equal": lambda a, b: a == b,
    "not_equal": lambda a, b: a != b,
    "greater": lambda a, b: a > b,
    "greater_equal": lambda a, b: a >= b,
    "less": lambda a, b: a < b,
    "less_equal": lambda a, b: a <= b,
    "logical_and": FLOAT["logical_and"],
    "logical_or": FLOAT["logical_or"],
    "logical_xor": FLOAT["logical_xor"],
    "logical_not": FLOAT["logical_not"],
    "absolute": lambda x: F.coalesce(F.when(x < 0, F.try_subtract(F.lit(0), x)).otherwise(x), x),
    "negative": lambda x: F.coalesce(F.try_subtract(F.lit(0), x), x),
    "positive": lambda x: x,
    "conjugate": lambda x: x,
    "square": lambda x: INTEGER["multiply"](x, x),
    "sign": lambda x: F.signum(x).cast("bigint"),
    "floor": lambda x: x,
    "ceil": lambda x: x,
    "trunc": lambda x: x,
    "invert": F.bitwise_not,
    "bitwise_and": lambda a, b: a.bitwiseAND(b),
    "bitwise_or": lambda a, b: a.bitwiseOR(b),
    "bitwise_xor": lambda a, b: a.bitwiseXOR(b),
    "bitwise_count": lambda x: F.bit_count(F.coalesce(F.when(x < 0, F.try_subtract(F.lit(0), x)).otherwise(x), x)).cast("bigint"),
    "left_shift": _shift("shiftleft", lambda a: F.lit(0)),
    "right_shift": _shift("shiftright", lambda a: F.when(a < 0, F.lit(-1)).otherwise(F.lit(0))),
    "isnan": lambda x: x.isNull(),
    "isinf": lambda x: x.isNull(),
    "isfinite": lambda x: x.isNotNull(),
}

#: Of booleans.
BOOLEAN: dict[str, Callable] = {
    "logical_and": lambda a, b: a & b,
    "logical_or": lambda a, b: a | b,
    "logical_xor": lambda a, b: a != b,
    "logical_not": lambda x: ~x,
    "bitwise_and": lambda a, b: a & b,
    "bitwise_or": lambda a, b: a | b,
    "bitwise_xor": lambda a, b: a != b,
    "invert": lambda x: ~x,
    "add": lambda a, b: a | b,
    "multiply": lambda a, b: a & b,
    "maximum": lambda a, b: a | b,
    "minimum": lambda a, b: a & b,
    "absolute": lambda x: x,
    "equal": lambda a, b: a == b,
    "not_equal": lambda a, b: a != b,
    "greater": lambda a, b: a & ~b,
    "greater_equal": lambda a, b: a | ~b,
    "less": lambda a, b: ~a & b,
    "less_equal": lambda a, b: ~a | b,
}

_TABLES = {"f": FLOAT, "i": INTEGER, "u": INTEGER, "b": BOOLEAN}


def loop_dtypes(ufunc: np.ufunc, dtypes: list) -> tuple[np.dtype, ...]:
    """Input and output dtypes of the loop NumPy would run; Python scalars come as their types."""
    return ufunc.resolve_dtypes((*dtypes, *[None] * ufunc.nout))


def has_expression(ufunc: np.ufunc, dtypes: list) -> bool:
    """Whether there is an expression for the loop over these dtypes."""
    if ufunc.nout != 1:
        return False
    loop = loop_dtypes(ufunc, dtypes)
    return all(d.kind == loop[0].kind for d in loop[: ufunc.nin]) and ufunc.__name__ in _TABLES.get(loop[0].kind, {}) and loop[0].str[1:] != "u8" and loop[-1].str[1:] != "u8"


def expression(ufunc: np.ufunc, columns: list[Column], dtypes: list) -> Column:
    """ufunc of columns held for dtypes, in the Spark type of its result."""
    loop = loop_dtypes(ufunc, dtypes)
    held = [np.dtype(d) for d in dtypes]
    out = _TABLES[loop[0].kind][ufunc.__name__](*[working(c, d, to) for c, d, to in zip(columns, held, loop, strict=False)])
    if loop[-1].kind in "iu":
        return wrapped(out.cast("bigint"), loop[-1])
    return out.cast(spark_type(loop[-1]))
