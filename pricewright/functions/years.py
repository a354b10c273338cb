from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pricewright.functions.text import _col

YEAR_MIN, YEAR_MAX = 1980, 2030  # fixed values: valid model-year window
INT_LITERAL = r"^\s*[+-]?[0-9]+\s*$"


def clean_year(c, dtype=None) -> Column:
    """int() conversion kept only inside 1980..2030, else null.

    Strings must be integer literals ("2017.0" -> null, quirk Q6); numbers
    truncate toward zero as Python ``int`` does."""
    c = _col(c)
    if dtype is None or isinstance(dtype, StringType) or dtype == "string":
        s = c.cast("string")
        y = F.when(s.rlike(INT_LITERAL), F.trim(s).try_cast("int"))
    else:
        y = c.try_cast("int")
    return F.when(y.between(YEAR_MIN, YEAR_MAX), y).cast("int")
