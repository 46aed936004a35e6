"""Inputs of benchmarks and tests: arrays of seeded noise, and Blosc containers as other writers make them."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ndgrid.functions.blosc import shuffle_bits, shuffle_bytes
from ndgrid.operators.cells import grid
from ndgrid.plans.meta import ArrayMeta
from ndgrid.sources import datasource

_ZSTD = 4


def noise_cells(spark: SparkSession, shape: tuple[int, ...], seed: int = 0) -> DataFrame:
    """Whole numbers from 0 to 1023 that depend on place and seed alone; they compress to about half as 16-bit floats."""
    names = [f"c{i}" for i in range(len(shape))]
    return grid(spark, tuple((0, n) for n in shape)).select(*names, F.pmod(F.xxhash64(F.lit(seed), *names), F.lit(1024)).cast("float").alias("v"))


def noise_array(spark: SparkSession, root: str, shape: tuple[int, ...], chunks: tuple[int, ...], codecs: list[dict], *, seed: int = 0, **metadata) -> ArrayMeta:
    return datasource.write_cells(noise_cells(spark, shape, seed), root, shape=shape, dtype="float32", chunks=chunks, codecs=codecs, **metadata)


def blosc_container(data: bytes, width: int, block_size: int, shuffle: str | None) -> bytes:
    """A Blosc 1 container of zstd blocks. The library reads these and does not write them."""
    import zstandard

    compressor, blocks = zstandard.ZstdCompressor(level=1), []
    for i in range(0, len(data), block_size):
        block = data[i : i + block_size]
        if shuffle == "byte":
            block = shuffle_bytes(block, width)
        elif shuffle == "bit":
            whole = len(block) // (8 * width) * 8 * width
            block = shuffle_bits(block[:whole], width) + block[whole:]
        packed = compressor.compress(block)
        blocks.append(struct.pack("<i", len(packed)) + packed)
    head = 16 + 4 * len(blocks)
    starts = head + np.cumsum([0, *map(len, blocks)])
    flags = _ZSTD << 5 | 0x10 | {None: 0, "byte": 0x01, "bit": 0x04}[shuffle]
    return b"".join([bytes([2, 1, flags, width]), struct.pack("<iii", len(data), block_size, int(starts[-1])), struct.pack(f"<{len(blocks)}i", *starts[:-1].tolist()), *blocks])


def blosc_store(spark: SparkSession, root: str, shape: tuple[int, ...], chunk: tuple[int, ...], *, seed: int = 0) -> ArrayMeta:
    """An array of noise whose chunks are bit-shuffled Blosc containers, written chunk by chunk on the executors."""
    from ndgrid.functions import filters
    from ndgrid.operators import cells as ops
    from ndgrid.runtime import ship

    ship(spark)
    meta = datasource.create(root, shape=shape, dtype="float32", chunks=chunk, codecs=[{"name": "blosc", "configuration": {"cname": "zstd", "shuffle": "bitshuffle", "typesize": 4}}])
    packed = ops.pack(noise_cells(spark, shape, seed), chunk)
    raw = packed.select(*[f"g{i}" for i in range(len(shape))], filters.encode_values(F.col("vals"), [], "float32", chunk).alias("raw"))
    contained = filters.on_bytes(lambda data: blosc_container(data, 4, 1 << 18, "bit"), "binary")
    datasource.write_chunks(raw.withColumn("payload", contained(F.col("raw"))).drop("raw"), meta)
    return meta
