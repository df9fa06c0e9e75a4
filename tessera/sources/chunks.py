"""Arrays in chunks: shapes of chunks and buffers, and a batch source that reads tiles in parallel."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.position import POS

CHUNK_MB, BUFFER_GB = 10.0, 1.0
PART = 1_000_000  # positions whose islands one task finds


def chunk_shape(shape: Sequence[int], itemsize: int, chunk_mb: float = CHUNK_MB) -> tuple[int, ...]:
    """The largest chunk of about the array's proportions that fits into chunk_mb megabytes."""
    if chunk_mb <= 0:
        raise ValueError("chunk_mb must be positive")
    ratio = [n // min(shape) for n in shape]
    room = chunk_mb * 1e6 / itemsize
    while math.prod(ratio) > room and any(r > 1 for r in ratio):
        least = min(r for r in ratio if r > 1)
        ratio = [max(1, r // least) if r > 1 else r for r in ratio]
    scale = math.floor((room / math.prod(ratio)) ** (1 / len(ratio)))
    return tuple(min(scale * r, n) for r, n in zip(ratio, shape))


def buffer_shape(shape: Sequence[int], chunks: Sequence[int], itemsize: int, buffer_gb: float = BUFFER_GB) -> tuple[int, ...]:
    """The same number of chunks along each axis, within buffer_gb gigabytes and the array."""
    if buffer_gb <= 0 or any(c <= 0 for c in chunks):
        raise ValueError("buffer_gb and chunk lengths must be positive")
    scale = math.floor((buffer_gb * 1e9 / (math.prod(chunks) * itemsize)) ** (1 / len(chunks)))
    return tuple(min(max(scale * c, c), n) for c, n in zip(chunks, shape))


def tiles(shape: Sequence[int], tile: Sequence[int]) -> Iterator[tuple[tuple[int, int], ...]]:
    """(start, stop) along each axis of every tile."""
    return itertools.product(*[[(a, min(a + t, n)) for a in range(0, n, t)] for n, t in zip(shape, tile)])


def n_tiles(shape: Sequence[int], tile: Sequence[int]) -> int:
    return math.prod(-(-n // t) for n, t in zip(shape, tile))


class _Tile(InputPartition):
    def __init__(self, bounds):
        self.bounds = bounds


class ArraySource(DataSource):
    """`spark.read.format("array_tiles")`: one input partition for each tile of an N-d array.

    `get` is a callable from (start, stop) pairs to a numpy array. Options: `shape` and `tile` as
    comma-separated lengths. Rows are (tile, start, stop, index, value), index counting through the tile.
    """

    get: Callable | None = None

    @classmethod
    def name(cls) -> str:
        return "array_tiles"

    def schema(self) -> str:
        return "tile array<long>, start array<long>, stop array<long>, index long, value double"

    def reader(self, schema):
        numbers = lambda key: tuple(int(x) for x in self.options[key].split(","))
        return _TileReader(type(self).get, numbers("shape"), numbers("tile"))


class _TileReader(DataSourceReader):
    def __init__(self, get, shape, tile):
        self.get, self.shape, self.tile = get, shape, tile

    def partitions(self):
        return [_Tile(t) for t in tiles(self.shape, self.tile)]

    def read(self, partition):
        bounds = partition.bounds
        values = self.get(bounds).ravel()
        start, stop = [a for a, _ in bounds], [b for _, b in bounds]
        number = [a // t for a, t in zip(start, self.tile)]
        for i, v in enumerate(values.tolist()):
            yield number, start, stop, i, float(v)


def source_of(get: Callable) -> type[ArraySource]:
    """A source class for `spark.dataSource.register` that reads through `get`."""
    return type("ArrayTiles", (ArraySource,), {"get": staticmethod(get)})


def blocks(df: DataFrame, column: str, size: int, by: Sequence[str] = ()) -> DataFrame:
    """(start, stop, n) of the chunks that buffering `size` elements makes of a stream with gaps.

    Elements stand at `_pos`; positions that are absent or null are gaps. A chunk ends with its
    buffer or at a gap.
    """
    there = df.where(F.col(column).isNotNull())
    w = Window.partitionBy(*by, "_part").orderBy(POS)
    # islands within parts of the positions, so that no task holds them all
    part = there.withColumn("_part", F.floor(F.col(POS) / F.lit(PART)))
    runs = part.withColumn("_run", F.col(POS) - F.row_number().over(w)).groupBy(*by, "_part", "_run").agg(F.min(POS).alias("start"), (F.max(POS) + 1).alias("stop"))
    # only those that touch an edge of their part, two a part at most, can go on in the next
    edge = (F.col("start") == F.col("_part") * PART) | (F.col("stop") == (F.col("_part") + 1) * PART)
    over = Window.partitionBy(*by).orderBy("start")
    open_runs = runs.where(edge).withColumn("_new", (F.col("start") != F.lag("stop", 1, -1).over(over)).cast("int"))
    joined = open_runs.withColumn("_g", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    islands = runs.where(~edge).select(*by, "start", "stop").unionByName(joined.select(*by, "start", "stop"))
    cut = islands.select(*by, "stop", F.explode(F.sequence("start", F.col("stop") - 1, F.lit(size).cast("long"))).alias("start"))
    return cut.select(*by, "start", F.least("stop", F.col("start") + size).alias("stop")).withColumn("n", F.col("stop") - F.col("start"))


def bounds(chunks: DataFrame) -> DataFrame:
    """The least shape that holds all chunks: the largest stop along each axis."""
    return chunks.select(F.posexplode("stop").alias("axis", "s")).groupBy("axis").agg(F.max("s").alias("bound"))
