"""Row-wise work on texts: one row out for each row in, without a shuffle and in bounded memory."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ndgrid.runtime import lean, ship

#: Bytes of text that a worker turns into Python objects at a time; a longer single text is taken alone.
SLICE_BYTES = 8 << 20


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """(first, length) of runs of texts with at most ``most`` bytes each, or of one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, out, lo = np.concatenate(([0], np.cumsum(sizes))), [], 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        out.append((lo, hi - lo))
        lo = hi
    return out


def map_texts(docs: DataFrame, text: str, keep: list[str] | None, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], fields: str) -> DataFrame:
    """``keep`` (default: all columns of ``docs``) in a struct ``row``, and the columns ``fields`` made from the text.

    ``make`` is called once in each task and gives the function from an Arrow array of texts to Arrow columns. The
    kept columns stay inside ``row``, so their names cannot clash with those of ``fields``.
    """
    ship(docs.sparkSession)
    kept = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    inside = kept.index(text) if text in kept else None
    rows = docs.select(row) if inside is not None else docs.select(row, F.col(f"`{text}`").alias("text"))
    out = T.StructType([rows.schema["row"], *T.StructType.fromDDL(fields).fields])
    names = out.names

    def run(batches):
        work = make()
        for batch in batches:
            texts = batch.column(0).field(inside) if inside is not None else batch.column(1)
            for lo, n in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), *work(texts.slice(lo, n))], names=names)

    return rows.mapInArrow(lean(run), out)
