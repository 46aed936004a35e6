"""Named queries over the test tables and, for each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ndgrid.functions import filters
from ndgrid.operators import cells as ops
from ndgrid.operators import ranges
from ndgrid.operators.tables import CHUNK, EVENT_CHUNK, SHARD, embedding_cells, event_cells, table
from ndgrid.plans.selection import Stepped, int_axes, normalize, orthogonal
from ndgrid.runtime import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Cells of the embeddings array in SQL.
_E = "WITH e AS (SELECT vec_id AS c0, CAST(p - 1 AS BIGINT) AS c1, embedding[p] AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings))"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _size(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1


def _select(sel) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shape = (_size(spark, sf_dir), 64)
        return ops.box(embedding_cells(spark, sf_dir), normalize(sel, shape), drop=())

    return run


@query(f"{_E} SELECT c0 - 10 AS c0, c1 - 8 AS c1, v FROM e WHERE c0 >= 10 AND c0 < 120 AND c1 >= 8 AND c1 < 24")
def sel_box(spark, sf_dir):
    return _select(np_index[10:120, 8:24])(spark, sf_dir)


@query(f"{_E} SELECT c0 - 5 AS c0, c1, v FROM e WHERE c0 = 5")
def sel_int_keepdim(spark, sf_dir):
    return _select(np_index[5])(spark, sf_dir)


@query(f"{_E} SELECT c1 AS c0, v FROM e WHERE c0 = 5")
def sel_int_squeeze(spark, sf_dir):
    sel = np_index[5]
    shape = (_size(spark, sf_dir), 64)
    return ops.box(embedding_cells(spark, sf_dir), normalize(sel, shape), drop=int_axes(sel, 2))


@query(f"{_E} SELECT c0 - (SELECT max(c0) - 3 FROM e) AS c0, c1, v FROM e WHERE c0 >= (SELECT max(c0) - 3 FROM e) AND c0 < (SELECT max(c0) FROM e)")
def sel_negative(spark, sf_dir):
    return _select(np_index[-4:-1])(spark, sf_dir)


@query(f"{_E} SELECT c0, c1, v FROM e WHERE c1 = 0")
def sel_ellipsis(spark, sf_dir):
    return _select(np_index[..., 0])(spark, sf_dir)


@query(f"{_E} SELECT c0, c1, v FROM e WHERE c0 < 0")
def sel_empty(spark, sf_dir):
    return _select(np_index[5:2])(spark, sf_dir)


def _take(sel):
    def run(spark, sf_dir):
        shape = (_size(spark, sf_dir), 64)
        return ops.take(embedding_cells(spark, sf_dir), orthogonal(sel, shape), drop=int_axes(sel, 2))

    return run


@query(f"{_E} SELECT c0 // 2 AS c0, c1, v FROM e WHERE c0 % 2 = 0")
def sel_strided(spark, sf_dir):
    return _take(np_index[::2])(spark, sf_dir)


@query(f"{_E}, m AS (SELECT vec_id AS old, row_number() OVER (ORDER BY vec_id) - 1 AS new FROM embeddings WHERE label = 3) SELECT m.new AS c0, c1, v FROM e JOIN m ON e.c0 = m.old")
def sel_mask(spark, sf_dir):
    """The mask comes from a table, and its positions are numbered there."""
    at = ops.numbered(table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("old")))
    return ops.take(embedding_cells(spark, sf_dir), (at, Stepped(0, 64)))


@query(f"{_E}, m AS (SELECT * FROM (VALUES (2, 0), (0, 1), (2, 2)) t(old, new)) SELECT CAST(m.new AS BIGINT) AS c0, c1, v FROM e JOIN m ON e.c0 = m.old")
def sel_fancy(spark, sf_dir):
    return _take(([2, 0, 2],))(spark, sf_dir)


@query(f"{_E} SELECT DISTINCT c0 // 150 AS g0, c1 // 20 AS g1 FROM e WHERE c0 >= 100 AND c0 < 400 AND c1 >= 10 AND c1 < 40")
def selected_units(spark, sf_dir):
    return ops.selected_units(embedding_cells(spark, sf_dir), (150, 20), ((100, 400), (10, 40)))


@query(f"{_E} SELECT c0 // 50 AS g0, c1 // 16 AS g1, count(*) AS n, min(v) AS min_v, max(v) AS max_v FROM e GROUP BY ALL")
def chunk_stats(spark, sf_dir):
    return ops.chunk_stats(embedding_cells(spark, sf_dir), CHUNK)


@query(f"{_E} SELECT c0 - 450 AS c0, c1 - 60 AS c1, v FROM e WHERE c0 // 150 = 3 AND c1 // 20 = 3")
def chunk_edge(spark, sf_dir):
    return ops.one_chunk(embedding_cells(spark, sf_dir), (150, 20), (3, 3))


@query("SELECT g.i AS c0, coalesce(CASE WHEN event_id < 4000 THEN value END, -1) AS v FROM (SELECT unnest(range(0, 9000)) AS i) g LEFT JOIN events ON event_id = g.i")
def fill_missing(spark, sf_dir):
    return ops.fill(event_cells(spark, sf_dir).where("c0 < 4000"), ((0, 9000),), -1.0)


def _units(spark, sf_dir):
    """The embeddings' stored chunks by shard; a chunk's size stands in for its encoded bytes."""
    per = tuple(s // c for s, c in zip(SHARD, CHUNK))
    counted = embedding_cells(spark, sf_dir).groupBy(*ops.chunk_of(CHUNK)).agg((F.count("*") * 4).alias("nbytes"))
    return counted.select(F.expr(f"g0 div {per[0]}").alias("s0"), F.expr(f"g1 div {per[1]}").alias("s1"), F.expr(f"cast(g0 % {per[0]} * {per[1]} + g1 % {per[1]} as int)").alias("u"), "nbytes")


_UNITS = f"{_E}, n AS (SELECT (c0 // 50) // 5 AS s0, (c1 // 16) // 2 AS s1, CAST((c0 // 50) % 5 * 2 + (c1 // 16) % 2 AS INTEGER) AS u, count(*) * 4 AS nbytes FROM e GROUP BY c0 // 50, c1 // 16), i AS (SELECT *, CAST(coalesce(sum(nbytes) OVER (PARTITION BY s0, s1 ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM n)"


@query(f"{_UNITS} SELECT s0, s1, u, nbytes, off FROM i")
def shard_index(spark, sf_dir):
    return ranges.shard_index(_units(spark, sf_dir), ["s0", "s1"])


_HELD = f"{_UNITS}, h AS (SELECT * FROM i WHERE u NOT IN (3, 7))"


@query(f"{_HELD}, m AS (SELECT *, CASE WHEN off > max(off + nbytes) OVER (PARTITION BY s0, s1 ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM h), k AS (SELECT *, sum(new) OVER (PARTITION BY s0, s1 ORDER BY off) AS island FROM m) SELECT s0, s1, min(off) AS off, max(off + nbytes) AS fin, count(*) AS k FROM k GROUP BY s0, s1, island")
def coalesce_ranges(spark, sf_dir):
    held = ranges.shard_index(_units(spark, sf_dir), ["s0", "s1"]).where("u not in (3, 7)")
    return ranges.islands(held, ["s0", "s1"])


@query(
    f"WITH RECURSIVE {_HELD.removeprefix('WITH ')}, r AS (SELECT *, row_number() OVER (PARTITION BY s0, s1 ORDER BY off, u) AS i FROM h), "
    "w AS (SELECT s0, s1, i, off AS lo, off + nbytes AS hi, 1 AS win FROM r WHERE i = 1 UNION ALL "
    "SELECT r.s0, r.s1, r.i, CASE WHEN r.off <= w.hi AND greatest(w.hi, r.off + r.nbytes) - w.lo <= 8192 THEN w.lo ELSE r.off END, "
    "CASE WHEN r.off <= w.hi AND greatest(w.hi, r.off + r.nbytes) - w.lo <= 8192 THEN greatest(w.hi, r.off + r.nbytes) ELSE r.off + r.nbytes END, "
    "CASE WHEN r.off <= w.hi AND greatest(w.hi, r.off + r.nbytes) - w.lo <= 8192 THEN w.win ELSE w.win + 1 END "
    "FROM w JOIN r ON r.s0 = w.s0 AND r.s1 = w.s1 AND r.i = w.i + 1) "
    "SELECT s0, s1, min(lo) AS off, max(hi) AS fin, count(*) AS k FROM w GROUP BY s0, s1, win"
)
def coalesce_capped(spark, sf_dir):
    held = ranges.shard_index(_units(spark, sf_dir), ["s0", "s1"]).where("u not in (3, 7)")
    return ranges.capped(held, ["s0", "s1"], max_fused_bytes=8192)


def _ints(spark, sf_dir):
    """Event values as whole hundredths, so that sums do not depend on their order."""
    return event_cells(spark, sf_dir).select("c0", F.rint(F.col("v") * 100).cast("bigint").alias("v"))


_V = "WITH x AS (SELECT event_id AS c0, CAST(round_even(value * 100, 0) AS BIGINT) AS v FROM events)"
_CHUNK_KEY = f"c0 div {EVENT_CHUNK}"


@query(f"{_V} SELECT c0, v - coalesce(lag(v) OVER (PARTITION BY c0 // 1000 ORDER BY c0), 0) AS d FROM x")
def delta_encode(spark, sf_dir):
    return _ints(spark, sf_dir).select("c0", filters.delta_encode(F.col("v"), [F.expr(_CHUNK_KEY)], F.col("c0")).alias("d"))


@query(f"{_V} SELECT c0, v FROM x")
def delta_decode(spark, sf_dir):
    return delta_encode(spark, sf_dir).select("c0", filters.delta_decode(F.col("d"), [F.expr(_CHUNK_KEY)], F.col("c0")).alias("v"))


@query("SELECT l_orderkey, l_linenumber, CAST(round_even((l_extendedprice - 1000) * 0.5, 0) AS INTEGER) AS q FROM lineitem")
def fso_encode(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", filters.fso_encode(F.col("l_extendedprice"), 1000, 0.5).alias("q"))


@query("SELECT event_id AS c0, CAST(CAST(round_even((value - 10) * 4, 0) AS INTEGER) AS DOUBLE) / 4 + 10 AS v FROM events")
def fso_decode(spark, sf_dir):
    q = event_cells(spark, sf_dir).select("c0", filters.fso_encode(F.col("v"), 10, 4).alias("q"))
    return q.select("c0", filters.fso_decode(F.col("q"), 10, 4).alias("v"))


def _bitround_sql(x: str, k: int) -> str:
    e0 = f"CAST(floor(log2(abs({x}))) AS INTEGER)"
    e = f"CASE WHEN abs({x}) >= pow(2::DOUBLE, {e0} + 1) THEN {e0} + 1 WHEN abs({x}) < pow(2::DOUBLE, {e0}) THEN {e0} - 1 ELSE {e0} END"
    return f"CASE WHEN {x} = 0 THEN {x} ELSE round_even({x} * pow(2::DOUBLE, {k} - ({e})), 0) * pow(2::DOUBLE, ({e}) - {k}) END"


@query(f"SELECT event_id AS c0, {_bitround_sql('value', 12)} AS v FROM events")
def bitround_f64(spark, sf_dir):
    return event_cells(spark, sf_dir).select("c0", filters.bitround(F.col("v"), 12, "double").alias("v"))


@query(f"{_E} SELECT c0, c1, CAST({_bitround_sql('CAST(v AS DOUBLE)', 8)} AS FLOAT) AS v FROM e")
def bitround_f32(spark, sf_dir):
    return embedding_cells(spark, sf_dir).select("c0", "c1", filters.bitround(F.col("v"), 8, "float").alias("v"))


@query(f"{_E} SELECT c0, c1, CASE WHEN c0 >= 100 AND c0 < 130 AND c1 >= 4 AND c1 < 12 THEN CAST(c0 * 64 + c1 AS FLOAT) ELSE v END AS v FROM e")
def region_write(spark, sf_dir):
    patch = ops.grid(spark, ((100, 130), (4, 12))).select("c0", "c1", (F.col("c0") * 64 + F.col("c1")).cast("float").alias("v"))
    return ops.overwrite(embedding_cells(spark, sf_dir), patch, 2)


@query("SELECT event_type, median(value) AS median_v FROM events GROUP BY event_type")
def bench_median(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.median("value").alias("median_v"))


@query(f"{_E}, s AS (SELECT c0 // 50 AS g0, c1 // 16 AS g1, min(v) AS lo, max(v) AS hi FROM e GROUP BY ALL) SELECT e.c0, e.c1, e.v FROM e JOIN s ON e.c0 // 50 = s.g0 AND e.c1 // 16 = s.g1 WHERE s.hi >= 0.3 AND e.v >= 0.3")
def zone_map_scan(spark, sf_dir):
    """A limit on values: written chunks have zone maps, and those that cannot hold such a value are not read."""
    root = _stored(spark, sf_dir, shards=SHARD, zones=True)
    return spark.read.format("ndgrid").load(root).where("v >= 0.3")


def _encoded(spark, sf_dir, codecs: list[dict]):
    """The embeddings' chunks as payloads, with the number of values in each, their places, and the number of null cells."""
    ship(spark)
    packed = ops.pack(embedding_cells(spark, sf_dir), CHUNK)
    return packed.select("g0", "g1", "places", "nulls", F.size("vals").alias("n"), filters.encode_values(F.col("vals"), codecs, "float32").alias("payload"))


def _decoded(encoded, codecs: list[dict]):
    values = filters.decode_values(F.col("payload"), codecs, "float32", F.col("n"), "float")
    return ops.unpack(encoded.select("g0", "g1", "places", "nulls", values.alias("vals")), CHUNK)


def _round_trip(codecs: list[dict]):
    def run(spark, sf_dir):
        return _decoded(_encoded(spark, sf_dir, codecs), codecs)

    return run


_SHUFFLE = {"name": "shuffle", "configuration": {"elementsize": 4}}
_CHAINS = {
    "codec_zlib_shuffle": [_SHUFFLE, {"name": "zlib"}],
    "codec_gzip": [{"name": "gzip"}],
    "codec_zstd": [{"name": "zstd", "configuration": {"level": 3}}],
    "codec_lz4": [{"name": "lz4"}],
    "codec_crc32c_zstd": [{"name": "zstd"}, {"name": "crc32c"}],
    "codec_native_balanced": [{"name": "ndgrid.balanced"}],
    "codec_native_bitpack": [{"name": "ndgrid.bitpack"}],
    "codec_native_cascaded": [{"name": "ndgrid.cascaded"}],
    "codec_native_snappy": [{"name": "ndgrid.snappy"}],
    "codec_native_deflate": [{"name": "ndgrid.deflate"}],
    "codec_native_gdeflate": [{"name": "ndgrid.gdeflate"}],
}
for _name, _chain in _CHAINS.items():
    QUERIES[_name] = _round_trip(_chain)
    ORACLE_SQL[_name] = f"{_E} SELECT c0, c1, v FROM e"


def _raw(spark, sf_dir):
    return _encoded(spark, sf_dir, [])


@query(f"{_E} SELECT c0, c1, v FROM e")
def codec_blosc_read(spark, sf_dir):
    """Containers as other writers make them, decoded by our reader."""
    from ndgrid.bench.fixtures import blosc_container

    contained = filters.on_bytes(lambda b: blosc_container(b, 4, 1024, "bit"), "binary")
    return _decoded(_raw(spark, sf_dir).withColumn("payload", contained(F.col("payload"))), [{"name": "blosc"}])


#: Bytes of each chunk of the embeddings, in order: the bits of a float as a number, cut into four.
_B = f"{_E}, u AS (SELECT c0 // 50 AS g0, c1 // 16 AS g1, (c0 % 50) * 16 + c1 % 16 AS p, CAST(CAST(CAST(v AS FLOAT) AS BIT) AS INTEGER)::BIGINT & 4294967295 AS x FROM e), b AS (SELECT g0, g1, p, k, (x >> (8 * k)) & 255 AS b FROM u, (SELECT unnest(range(0, 4)) AS k))"


@query(f"{_B} SELECT g0, g1, string_agg(printf('%02X', b), '' ORDER BY k, p) AS shuffled FROM b GROUP BY g0, g1")
def shuffle_bytes(spark, sf_dir):
    """A null cell has no bytes, and a chunk of nothing else has null."""
    planes = F.hex(filters.shuffle_bytes(F.col("payload"), 4))
    return _raw(spark, sf_dir).select("g0", "g1", F.when(F.col("n") > 0, planes).alias("shuffled"))


def _crc_table(name: str, polynomial: int) -> str:
    """A common table with one row: what eight steps of a reflected CRC make of each byte."""
    return f"{name} AS MATERIALIZED (SELECT list(t ORDER BY i) AS {name} FROM (WITH RECURSIVE s AS (SELECT i, i AS t, 0 AS n FROM (SELECT unnest(range(0, 256)) AS i) UNION ALL SELECT i, CASE WHEN t & 1 = 1 THEN xor(t >> 1, {polynomial}) ELSE t >> 1 END, n + 1 FROM s WHERE n < 8) SELECT i, t FROM s WHERE n = 8))"


def _crc_sql(name: str) -> str:
    return f"CAST(xor(list_reduce(l, lambda r, b: xor(r >> 8, {name}[1 + xor(r & 255, b)]), 4294967295), 4294967295) AS BIGINT)"


@query(
    f"{_B}, {_crc_table('zip', 0xEDB88320)}, {_crc_table('castagnoli', 0x82F63B78)}, l AS (SELECT g0, g1, list(b ORDER BY p, k) AS l FROM b GROUP BY g0, g1) "
    f"SELECT g0, g1, {_crc_sql('zip')} AS crc32, {_crc_sql('castagnoli')} AS crc32c, "
    "CAST(((len(l) + list_sum(list_transform(l, lambda b, i: b * (len(l) - i + 1)))) % 65521) * 65536 + (1 + list_sum(l)) % 65521 AS BIGINT) AS adler32 FROM l, zip, castagnoli"
)
def checksums(spark, sf_dir):
    p = F.col("payload")
    return _raw(spark, sf_dir).select("g0", "g1", F.crc32(p).alias("crc32"), filters.crc32c(p).alias("crc32c"), filters.adler32(p).alias("adler32"))


def _stored(spark, sf_dir, **metadata) -> str:
    """The embeddings written as an array to the shared folder."""
    from ndgrid.runtime import shared_path
    from ndgrid.sources.datasource import write_cells

    root = shared_path(spark, "embeddings-array")
    size = _size(spark, sf_dir)
    write_cells(embedding_cells(spark, sf_dir), root, shape=(size, 64), dtype="float32", chunks=CHUNK, codecs=[_SHUFFLE, {"name": "zstd", "configuration": {"level": 1}}], **metadata)
    return root


@query(f"{_E} SELECT c0 - 10 AS c0, c1 - 8 AS c1, v FROM e WHERE c0 >= 10 AND c0 < 120 AND c1 >= 8 AND c1 < 24")
def source_pushdown(spark, sf_dir):
    from ndgrid.array import Array

    return Array.open(_stored(spark, sf_dir, shards=SHARD), spark=spark)[10:120, 8:24]


@query(f"{_E} SELECT c0 // 3 AS c0, v FROM e WHERE c0 % 3 = 0 AND c0 < 100 AND c1 = 7")
def source_drop_in(spark, sf_dir):
    from ndgrid.array import open_array

    return open_array(_stored(spark, sf_dir), spark=spark)[0:100:3, 7]


@query(f"{_E} SELECT c0, c1, CASE WHEN c0 >= 100 AND c0 < 130 AND c1 >= 4 AND c1 < 12 THEN CAST(1.5 AS FLOAT) ELSE v END AS v FROM e")
def source_region_write(spark, sf_dir):
    from ndgrid.array import open_array

    a = open_array(_stored(spark, sf_dir, shards=SHARD), spark=spark)
    a[100:130, 4:12] = 1.5
    return a[...]


@query("SELECT CAST(i // 4 AS BIGINT) AS c0, CAST(i % 4 AS BIGINT) AS c1, CAST(CASE WHEN i // 4 < 8 THEN i ELSE -1 END AS FLOAT) AS v FROM (SELECT unnest(range(0, 60)) AS i)")
def source_fill(spark, sf_dir):
    """Half of the rows were never written, and the last chunk is cut by the edge."""
    from ndgrid.array import Array
    from ndgrid.runtime import shared_path
    from ndgrid.sources.datasource import write_cells

    root = shared_path(spark, "ragged-array")
    cells = ops.grid(spark, ((0, 8), (0, 4))).select("c0", "c1", (F.col("c0") * 4 + F.col("c1")).cast("float").alias("v"))
    write_cells(cells, root, shape=(15, 4), dtype="float32", chunks=(4, 4), fill_value=-1, codecs=[{"name": "zstd"}])
    return Array.open(root, spark=spark)[...]


class _Index:
    """np_index[10:20, ..., 3] is the selection between the brackets."""

    def __getitem__(self, sel):
        return sel


np_index = _Index()
