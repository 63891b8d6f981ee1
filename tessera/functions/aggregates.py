"""The dialect's aggregates as built-in Spark functions. VARIANCE and STDDEV are those of a population."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "COUNT": F.count,
    "SUM": F.sum,
    "AVG": F.avg,
    "MIN": F.min,
    "MAX": F.max,
    "VARIANCE": F.var_pop,
    "STDDEV": F.stddev_pop,
    # names of the plan API
    "VAR": F.var_pop,
    "VAR_POP": F.var_pop,
    "VAR_SAMP": F.var_samp,
    "STDDEV_POP": F.stddev_pop,
    "STDDEV_SAMP": F.stddev_samp,
}
NUMERIC = AGGREGATES.keys() - {"COUNT", "MIN", "MAX"}


def is_aggregate(name: str) -> bool:
    return name.upper() in AGGREGATES
