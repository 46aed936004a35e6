"""The numeric filters as Spark columns, so that Catalyst and code generation see them, and codec chains as columns.

Each filter has two implementations of the same rule: ``sql`` (columns over cells) and ``udf`` (the numpy codec over
chunks). Which one runs is chosen by argument, then by the process-wide override, then by the filter's default, in
:func:`filter_cells` and :func:`shuffle_bytes`; the column functions between them are the ``sql`` forms themselves.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ndgrid.functions.checksums import adler32 as _adler32
from ndgrid.functions.checksums import crc32c as _crc32c
from ndgrid.functions.codecs import MANTISSA, Chain, make
from ndgrid.operators.cells import chunk_of, position_in
from ndgrid.runtime import ship

_DEFAULTS = {"delta": "sql", "fixedscaleoffset": "sql", "bitround": "sql", "shuffle": "udf"}
_SUPPORTED = {"delta": ("sql", "udf"), "fixedscaleoffset": ("sql", "udf"), "bitround": ("sql", "udf"), "shuffle": ("sql", "udf")}
_overrides: dict[str, str] = {}


def set_overrides(overrides: dict[str, str] | None) -> None:
    """Replace the process-wide choices."""
    _overrides.clear()
    _overrides.update(overrides or {})


def get_overrides() -> dict[str, str]:
    return dict(_overrides)


def resolve(name: str, impl: str | None = None) -> str:
    choice = impl or _overrides.get(name) or _DEFAULTS[name]
    if choice not in _SUPPORTED[name]:
        raise ValueError(f"{name} has no implementation {choice!r}; there are {', '.join(_SUPPORTED[name])}")
    return choice


def delta_encode(v: Column, chunk: list[Column], pos: Column) -> Column:
    """The first value of a chunk and then differences."""
    return v - F.lag(v, 1, 0).over(W.partitionBy(*chunk).orderBy(pos))


def delta_decode(d: Column, chunk: list[Column], pos: Column) -> Column:
    """Running sum within a chunk."""
    return F.sum(d).over(W.partitionBy(*chunk).orderBy(pos).rowsBetween(W.unboundedPreceding, 0))


def wrap_int(x: Column, bits: int) -> Column:
    """A bigint taken modulo 2**bits into the signed range, as fixed-width integers wrap (ANSI mode raises instead)."""
    half, mask = 1 << (bits - 1), (1 << bits) - 1
    return (x + F.lit(half)).bitwiseAND(F.lit(mask)) - F.lit(half)


def fso_encode(v: Column, offset: float, scale: float, astype: str = "int") -> Column:
    """(v - offset) * scale, rounded half to even only if it is stored as an integer."""
    x = (v.cast("double") - F.lit(float(offset))) * F.lit(float(scale))
    return (F.rint(x) if astype in ("tinyint", "smallint", "int", "bigint") else x).cast(astype)


def fso_decode(q: Column, offset: float, scale: float) -> Column:
    return q.cast("double") / F.lit(float(scale)) + F.lit(float(offset))


def bitround(v: Column, keepbits: int, dtype: str) -> Column:
    """``v`` with its first ``keepbits`` mantissa bits, rounded half to even, in arithmetic on doubles.

    The exponent comes from a logarithm, corrected by one where that was rounded over a power of two. Zeros, NaN and
    infinities stay as they are. It holds for normal numbers whose scaled value is finite; numpy's bits, the ``udf``
    form, decide outside of that.
    """
    if dtype not in ("float", "double"):
        raise TypeError(f"bits of {dtype} are not rounded; only floating-point numbers are")
    if keepbits >= MANTISSA["float32" if dtype == "float" else "float64"]:
        return v
    x = v.cast("double")
    size = F.abs(x)
    guess = F.floor(F.log2(size)).cast("int")
    two = lambda e: F.pow(F.lit(2.0), e)
    e = F.when(size >= two(guess + 1), guess + 1).when(size < two(guess), guess - 1).otherwise(guess)
    rounded = F.rint(x * two(F.lit(keepbits) - e)) * two(e - F.lit(keepbits))
    return F.when((x == 0) | F.isnan(x) | (size == float("inf")), v).otherwise(rounded.cast(dtype))


def shuffle_sql(payload: Column, width: int) -> Column:
    """Byte transpose of a binary column in SQL functions alone; slow, and an independent check of the codec. Null stays null."""
    n = F.length(payload) / F.lit(width)
    digits = F.hex(payload)
    plane = lambda k: F.array_join(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.substring(digits, i * (2 * width) + 2 * k + 1, F.lit(2))), "")
    planes = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), plane), ""))
    return F.when(F.length(payload) > 0, planes).otherwise(payload)


#: Spark's names of the dtypes that filters store.
_SPARK = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double"}


def filter_cells(cells: DataFrame, codec: dict, chunk_shape: tuple[int, ...], dtype: str, *, decode: bool = False, impl: str | None = None) -> DataFrame:
    """Cells (c0 .., v) with a filter applied to each chunk's values, or undone. ``dtype`` is that of decoded values.

    Integers wrap at their width in both forms. Values that single precision rounds on the way may differ in the last
    bit between the two, as the ``sql`` form calculates in doubles.
    """
    own, name = make(codec), codec["name"]
    kind = np.dtype(dtype)
    to = kind if decode else own.stored(kind)
    if resolve(name, impl) == "udf":
        return _filter_chunks(cells, own, chunk_shape, kind, to, decode)
    at, place, v = chunk_of(chunk_shape), position_in(chunk_shape), F.col("v")
    if name == "delta":
        wide = v.cast("bigint") if to.kind == "i" else v
        out = (delta_decode if decode else delta_encode)(wide, at, place)
        out = wrap_int(out, 8 * to.itemsize) if to.kind == "i" and to.itemsize < 8 else out
    elif name == "fixedscaleoffset":
        out = fso_decode(v, own.offset, own.scale) if decode else fso_encode(v, own.offset, own.scale, _SPARK[to.name])
        out = F.rint(out) if decode and to.kind == "i" else out
    else:
        out = v if decode else bitround(v, own.keepbits, _SPARK[kind.name])
    return cells.withColumn("v", out.cast(_SPARK[to.name]))


def _filter_chunks(cells: DataFrame, codec, chunk_shape: tuple[int, ...], kind: np.dtype, to: np.dtype, decode: bool) -> DataFrame:
    """The numpy codec on the values of each chunk, in C order; a chunk's cells meet in one task."""
    ship(cells.sparkSession)
    names = [f"c{i}" for i in range(len(chunk_shape))]

    def run(table: pa.Table) -> pa.Table:
        place = np.zeros(table.num_rows, dtype=np.int64)
        for n, k in zip(names, chunk_shape):
            place = place * k + table.column(n).to_numpy() % k
        table = table.take(pa.array(np.argsort(place, kind="stable")))
        held = table.column("v").to_numpy().astype(codec.stored(kind) if decode else kind)
        return pa.table([*(table.column(n) for n in names), pa.array((codec.decode if decode else codec.encode)(held).astype(to))], names=[*names, "v"])

    schema = ", ".join(f"{n} bigint" for n in names) + f", v {_SPARK[to.name]}"
    return cells.select(*names, "v").groupBy(*chunk_of(chunk_shape)).applyInArrow(run, schema)


def encode_values(values: Column, codecs: list[dict], dtype: str, shape: tuple[int, ...] | None = None) -> Column:
    """array<number> in C order -> payload. Null stays null.

    Without ``shape`` a chunk is as long as its values, which are fewer at an edge or where cells are missing.
    """

    def run(chunks: pd.Series) -> pd.Series:
        chain = Chain(codecs, dtype, shape or ())
        return chunks.map(lambda c: None if c is None else chain.encode(np.asarray(c, dtype=dtype).reshape(-1 if shape is None else shape)))

    return F.pandas_udf(run, "binary")(values)


def decode_values(payload: Column, codecs: list[dict], dtype: str, count: Column, element: str) -> Column:
    """payload -> array<element> of ``count`` values in C order; any other number of them raises. Null stays null."""

    def run(chunks: pd.Series, counts: pd.Series) -> pd.Series:
        chain = functools.cache(lambda n: Chain(codecs, dtype, (n,)))
        return pd.Series([None if c is None else chain(n).decode(bytes(c)) for c, n in zip(chunks, counts)], dtype=object)

    return F.pandas_udf(run, f"array<{element}>")(payload, count)


def on_bytes(f, kind: str):
    """A function of byte strings as one of binary columns. Null stays null."""

    def run(chunks: pd.Series) -> pd.Series:
        return chunks.map(lambda c: None if c is None else f(bytes(c)))

    return lambda payload: F.pandas_udf(run, kind)(payload)


def crc32c(payload: Column) -> Column:
    """Castagnoli; Spark's own ``crc32`` is the sum that gzip uses."""
    return on_bytes(_crc32c, "bigint")(payload)


def adler32(payload: Column) -> Column:
    return on_bytes(_adler32, "bigint")(payload)


def shuffle_bytes(payload: Column, width: int, impl: str | None = None) -> Column:
    from ndgrid.functions.blosc import shuffle_bytes as numpy_shuffle

    if resolve("shuffle", impl) == "sql":
        return shuffle_sql(payload, width)
    return on_bytes(lambda data: numpy_shuffle(data, width), "binary")(payload)
