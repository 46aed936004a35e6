"""Queries over chunks with cells that hold null, which is neither a missing cell nor NaN."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ndgrid import catalog

NAMES = [
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


@pytest.fixture(scope="module")
def nulls(tmp_path_factory):
    """First, last and other cells are null, a row, a chunk of nothing else, and the last cells of a whole chunk; one is NaN."""
    folder = tmp_path_factory.mktemp("nulls")
    rows = np.random.default_rng(6).standard_normal((110, 64)).astype("float32").tolist()
    for i, j in [(0, 0), (3, 5), (49, 47), (109, 63), *((20, j) for j in range(64)), *((i, j) for i in range(50, 100) for j in range(16, 32))]:
        rows[i][j] = None
    rows[30][7] = float("nan")
    pq.write_table(pa.table({"vec_id": pa.array(range(110), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_null_cells(spark, nulls, name):
    folder, con = nulls
    theirs = con.execute(catalog.ORACLE_SQL[name]).fetchall()
    assert sorted(map(repr, map(tuple, catalog.QUERIES[name](spark, folder).collect()))) == sorted(map(repr, theirs))
