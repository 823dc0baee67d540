"""What the operators share: tables, the shared folder, worker caches and token hashing."""

from __future__ import annotations

import contextlib
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import filesystem, shared_dir

U64 = np.uint64
#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_of(docs: DataFrame, *without: str) -> Column:
    """The columns of a row as one struct _row, so that none clashes with what an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without]).alias("_row")


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes the tables of frames that written() gave. Nothing that is still to run may read them."""
    for df in frames:
        if df is not None:
            fs, inner = filesystem(df._written_to)
            fs.delete_dir(inner)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    return vars(sys.modules.setdefault("_marlspike_worker_cache", types.ModuleType("_marlspike_worker_cache"))).setdefault("kept", {})


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (splitmix64)."""
    x = np.array(x, dtype=U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random_u64(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def lut(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of true bytes; a run never crosses rows."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A 64-bit multilinear hash of each run: the sum of values[byte] * factors[place], mixed with its length.

    values: 256 random uint64; factors: random odd uint64, longer runs use it again from the start
    with the value of their place added in. What a run hashes to never depends on the other runs.
    """
    if not len(starts):
        return np.zeros(0, dtype=U64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    at = place + np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        terms = values[data[at]] * factors[place % len(factors)]
        longer = lengths > len(factors)
        if longer.any():
            again = np.repeat(longer, lengths)
            terms[again] = mix64(terms[again] + (place[again] // len(factors)).astype(U64))
        return mix64(np.add.reduceat(terms, first) + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))


def word_values(lower: bool, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Tables for run_hashes; with lower, A-Z hash as a-z."""
    values, factors = random_u64(256, seed), random_u64(256, seed + 1) | U64(1)
    if lower:
        values = values.copy()
        values[65:91] = values[97:123]
    return values, factors


def pack(a: np.ndarray) -> bytes:
    """Integers as bytes: planes of equal significance together, compressed."""
    import zstandard

    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    import zstandard

    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8), np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).reshape(-1).view(dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a.astype(U64), prepend=U64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, U64), dtype=U64)


def give_back() -> None:
    """Returns memory that the worker holds but does not use: it lives on beside the other workers after its task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sliced(batches, column: str, limit: int = 2_000_000):
    """The record batches cut so that each part has about limit bytes of the text column at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_bytes(batch.column(batch.schema.get_field_index(column)))[1])
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    give_back()


def portions(batches, limit: int = 400_000):
    """The record batches cut so that each part has about limit bytes of the last column, of binary, at most (one row at least)."""
    for batch in batches:
        if batch.num_rows:
            sizes = pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0)
            part = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // limit
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                yield batch.slice(a, b - a)
    give_back()
