"""Array metadata (Zarr v3 ``zarr.json``): parsed, checked and cached. Nothing here needs Spark."""

from __future__ import annotations

import functools
import json
import math
from dataclasses import dataclass, field

import numpy as np

from ndgrid.plans.store import open_store

#: Plans that are held; the least recently used go first.
PLAN_CACHE_SIZE = 32
#: Marks an absent unit in a shard's index: fixed value of the format.
ABSENT = 2**64 - 1

_SPECIAL = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}


def parse_dtype(data_type) -> np.dtype:
    """A fixed-width numeric dtype; of the mapping form only the name counts."""
    name = data_type["name"] if isinstance(data_type, dict) else data_type
    try:
        dtype = np.dtype(name)
    except TypeError as e:
        raise NotImplementedError(f"data type {name!r} is not a fixed-width number") from e
    if dtype.kind not in "biufc":
        raise NotImplementedError(f"data type {name!r} is not a fixed-width number")
    return dtype


def parse_fill(value):
    if isinstance(value, str):
        if value not in _SPECIAL:
            raise NotImplementedError(f"fill value {value!r}")
        return _SPECIAL[value]
    return 0 if value is None else value


def codec_configuration(codec: dict) -> dict:
    """The codec's parameters, given under ``configuration`` or beside the name."""
    own = codec.get("configuration")
    if own is None:
        return {k: v for k, v in codec.items() if k not in ("name", "configuration")}
    if not isinstance(own, dict):
        raise TypeError(f"the configuration of {codec.get('name')!r} is not a mapping")
    return dict(own)


@dataclass(frozen=True)
class Sharding:
    """Units of ``unit_shape`` within each chunk file, and how the file's index is stored."""

    unit_shape: tuple[int, ...]
    at_start: bool
    index_crc: bool


@dataclass(frozen=True)
class ArrayMeta:
    """What is known of an array before any chunk is read."""

    root: str
    shape: tuple[int, ...]
    dtype: np.dtype
    chunk_shape: tuple[int, ...]  # of a file
    codecs: tuple[dict, ...]  # of a unit, in the order of encoding
    fill_value: object
    sharding: Sharding | None = None
    separator: str = "/"
    prefix: str = "c"
    attributes: dict = field(default_factory=dict, hash=False, compare=False)
    raw: dict = field(default_factory=dict, hash=False, compare=False)

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def unit_shape(self) -> tuple[int, ...]:
        """Shape of what is decoded at a time: the inner chunk if sharded, else the chunk."""
        return self.sharding.unit_shape if self.sharding else self.chunk_shape

    @property
    def grid_shape(self) -> tuple[int, ...]:
        """Number of units along each axis."""
        return tuple(-(-n // k) for n, k in zip(self.shape, self.unit_shape))

    @property
    def units_per_file(self) -> tuple[int, ...]:
        return tuple(c // u for c, u in zip(self.chunk_shape, self.unit_shape))

    @property
    def unit_nbytes(self) -> int:
        return math.prod(self.unit_shape) * self.dtype.itemsize

    def chunk_key(self, coords: tuple[int, ...]) -> str:
        """Place of a chunk file below the root."""
        return self.separator.join([*([self.prefix] if self.prefix else []), *map(str, coords)]) or "0"


def from_metadata(metadata: dict, root: str) -> ArrayMeta:
    """Check a parsed document. No file is touched."""
    if metadata.get("zarr_format") != 3 or metadata.get("node_type") != "array":
        raise ValueError("not the metadata of a version 3 array")
    grid = metadata["chunk_grid"]
    if grid.get("name") != "regular":
        raise NotImplementedError(f"chunk grid {grid.get('name')!r}")
    shape = tuple(int(n) for n in metadata["shape"])
    chunk_shape = tuple(int(n) for n in codec_configuration(grid)["chunk_shape"])
    if len(shape) != len(chunk_shape):
        raise ValueError("the chunks have another number of dimensions than the array")
    keys = metadata.get("chunk_key_encoding", {"name": "default"})
    kind = keys.get("name", "default")
    if kind not in ("default", "v2"):
        raise NotImplementedError(f"chunk key encoding {kind!r}")
    separator = codec_configuration(keys).get("separator", "/" if kind == "default" else ".")
    codecs, sharding = list(metadata.get("codecs", [])), None
    if codecs and codecs[0].get("name") == "sharding_indexed":
        c = codec_configuration(codecs[0])
        unit = tuple(int(n) for n in c["chunk_shape"])
        if len(unit) != len(chunk_shape) or any(a % b for a, b in zip(chunk_shape, unit)):
            raise ValueError(f"shards of {chunk_shape} do not divide into chunks of {unit}")
        index = [x.get("name") for x in c.get("index_codecs", [])]
        sharding = Sharding(unit, c.get("index_location", "end") == "start", "crc32c" in index)
        codecs = list(c.get("codecs", []))
    return ArrayMeta(
        root=root.rstrip("/"),
        shape=shape,
        dtype=parse_dtype(metadata["data_type"]),
        chunk_shape=chunk_shape,
        codecs=tuple(codecs),
        fill_value=parse_fill(metadata.get("fill_value", 0)),
        sharding=sharding,
        separator=separator,
        prefix="c" if kind == "default" else "",
        attributes=dict(metadata.get("attributes", {})),
        raw=metadata,
    )


@functools.lru_cache(maxsize=PLAN_CACHE_SIZE)
def _parsed(root: str, signature: tuple) -> ArrayMeta:
    return from_metadata(json.loads(open_store(root).get("zarr.json")), root)


def open_meta(root: str, *, cached: bool = True) -> ArrayMeta:
    """The metadata of ``root``. With ``cached`` it is parsed anew only if the file's size, time or inode has changed."""
    root = str(root).rstrip("/")
    signature = open_store(root).signature("zarr.json")
    if signature is None:
        raise FileNotFoundError(f"{root}/zarr.json")
    return _parsed(root, signature) if cached else _parsed.__wrapped__(root, signature)


def clear_plan_cache() -> None:
    _parsed.cache_clear()


def plan_cache_len() -> int:
    return _parsed.cache_info().currsize


def make_metadata(*, shape, dtype, chunks, codecs=(), shards=None, fill_value=0, attributes=None, key_encoding: str = "default", index_location: str = "end", index_crc: bool = True) -> dict:
    """The document of a new array. With ``shards`` the chunks become units within files of that shape."""
    little = {"name": "bytes", "configuration": {"endian": "little"}}
    chain = list(codecs)
    if not any(c["name"] == "bytes" for c in chain):
        # Filters work on elements, compressors on bytes; the serializer stands between them.
        n = next((i for i, c in enumerate(chain) if c["name"] not in ("delta", "fixedscaleoffset", "bitround")), len(chain))
        chain.insert(n, little)
    if shards is not None:
        index = [little, *([{"name": "crc32c"}] if index_crc else [])]
        chain = [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(chunks), "codecs": chain, "index_codecs": index, "index_location": index_location}}]
    if isinstance(fill_value, float) and not math.isfinite(fill_value):
        fill_value = next(k for k, v in _SPECIAL.items() if v == fill_value or (math.isnan(v) and math.isnan(fill_value)))
    return {
        "zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": np.dtype(dtype).name,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(shards if shards is not None else chunks)}},
        "chunk_key_encoding": {"name": key_encoding, "configuration": {"separator": "/" if key_encoding == "default" else "."}},
        "fill_value": fill_value, "codecs": chain, "attributes": dict(attributes or {}),
    }
