"""Circular statistics of half-turn angles in degrees, as aggregate or window expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _of_distinct(fn: Callable[[float], float], x: pa.Array) -> pa.Array:
    """``fn`` of every value, called once a distinct one; null stays null, and what is not finite becomes NaN."""
    held = x.dictionary_encode()
    known = [fn(v) if math.isfinite(v) else math.nan for v in held.dictionary.to_pylist()]
    return pc.take(pa.array(known, pa.float64()), held.indices)


@F.arrow_udf(T.DoubleType())
def sine(x: pa.Array) -> pa.Array:
    """Sine as the C library rounds it: the JVM's is one unit off now and then, and where directions cancel that unit is the mean."""
    return _of_distinct(math.sin, x)


@F.arrow_udf(T.DoubleType())
def cosine(x: pa.Array) -> pa.Array:
    """Cosine as the C library rounds it."""
    return _of_distinct(math.cos, x)


def _resultant(deg: Column, over: Callable[[Column], Column]) -> tuple[Column, Column]:
    twice = F.radians(deg * 2.0)
    return over(F.avg(sine(twice))), over(F.avg(cosine(twice)))


def circ_mean_deg(deg: Column, over: Callable[[Column], Column] = lambda c: c) -> Column:
    s, c = _resultant(deg, over)
    return F.coalesce(F.degrees(F.atan2(s, c)) / 2.0, F.lit(0.0))


def circ_std_deg(deg: Column, over: Callable[[Column], Column] = lambda c: c) -> Column:
    """0 below two samples, 90 when the directions cancel."""
    s, c = _resultant(deg, over)
    n = over(F.count(deg))
    size = F.least(F.lit(1.0), F.sqrt(s * s + c * c))
    spread = F.degrees(F.sqrt(F.lit(-2.0) * F.log(size))) / 2.0
    return F.when(n < 2, F.lit(0.0)).when(size <= 1e-9, F.lit(90.0)).otherwise(F.abs(spread))
