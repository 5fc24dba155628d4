"""The same expressions over columns of any DataFrame, a streaming one included: they keep no state."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions import ufuncs
from rowforge.functions.dtypes import numpy_dtype


def apply(df: DataFrame, ufunc: np.ufunc, *operands: str | float | int, name: str) -> DataFrame:
    """df with column `name`: ufunc of columns (by name) and Python numbers."""
    kinds = dict(df.dtypes)
    columns: list[Column] = [F.col(o) if isinstance(o, str) else F.lit(o).cast("double" if isinstance(o, float) else "bigint") for o in operands]
    dtypes = [numpy_dtype(kinds[o]) if isinstance(o, str) else type(o) for o in operands]
    if not ufuncs.has_expression(ufunc, dtypes):
        raise TypeError(f"{ufunc.__name__} has no expression for these types")
    held = [np.dtype(np.int64) if d is int else np.dtype(np.float64) if d is float else d for d in dtypes]
    loop = ufuncs.loop_dtypes(ufunc, dtypes)
    given = [loop[k] if dtypes[k] in (int, float) and loop[k].kind == held[k].kind else held[k] for k in range(len(held))]
    return df.withColumn(name, ufuncs.expression(ufunc, columns, given))
