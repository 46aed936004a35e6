"""Queries over chunks that are not whole: the table ends inside a chunk, rows are missing, vectors are short or long."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from conftest import same_rows
from ndgrid import catalog

NAMES = [
    "checksums",
    "codec_gzip",
    "codec_native_bitpack",
    "codec_native_gdeflate",
    "codec_zstd",
    "codec_blosc_read",
    "codec_lz4",
    "codec_native_cascaded",
    "codec_native_snappy",
    "shuffle_bytes",
    "codec_crc32c_zstd",
    "codec_native_balanced",
    "codec_native_deflate",
    "codec_zlib_shuffle",
]


def _write(folder, ids, lengths):
    rng = np.random.default_rng(5)
    vectors = [rng.standard_normal(n).astype("float32") for n in lengths]
    rows = {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())}
    pq.write_table(pa.table(rows), folder / "embeddings.parquet")


@pytest.fixture(scope="module", params=["edge", "holes"])
def ragged(request, tmp_path_factory):
    """A table whose last chunk has 6 of 50 rows; and one with missing rows, a row below 0, a chunk of one value, and other lengths."""
    folder = tmp_path_factory.mktemp(request.param)
    if request.param == "edge":
        _write(folder, list(range(106)), [64] * 106)
    else:
        ids = [i for i in range(130) if i % 7 and not 50 <= i < 100] + [-3, 310]
        _write(folder, ids, [(64, 37, 0, 70)[i % 4] for i in range(len(ids) - 1)] + [1])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_ragged_chunks(spark, ragged, name):
    folder, con = ragged
    same_rows(catalog.QUERIES[name](spark, folder).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df())
