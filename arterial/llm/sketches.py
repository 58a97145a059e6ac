"""Summaries of fixed size over all rows: counters of hashed keys, and Bloom filters."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import blob
from .kernels import U64, mix

SLICES = 8


def _pack(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    if len(at) * 8 < len(counts) * 2:
        return b"s" + zlib.compress(blob(at.astype(np.uint32)) + blob(counts[at].astype(np.uint64)), 1)
    kind = np.uint16 if counts.max() < 1 << 16 else np.uint64
    return (b"2" if kind is np.uint16 else b"8") + zlib.compress(blob(counts.astype(kind)), 1)


def _unpack(raw: bytes, size: int) -> np.ndarray:
    body = zlib.decompress(raw[1:])
    if raw[:1] == b"s":
        n = len(body) // 12
        out = np.zeros(size, np.uint64)
        out[np.frombuffer(body[: 4 * n], np.uint32)] = np.frombuffer(body[4 * n :], np.uint64)
        return out
    return np.frombuffer(body, np.uint16 if raw[:1] == b"2" else np.uint64).astype(np.uint64)


def _counter(keys_of, width: int):
    def count(batches):
        total = np.zeros(width, np.uint32)
        for batch in batches:
            for keys in keys_of(batch):
                np.add.at(total, (keys & U64(width - 1)).astype(np.int64), np.uint32(1))
        size = width // SLICES
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array([_pack(total[i * size : (i + 1) * size]) for i in range(SLICES)], pa.binary())})

    return count


def _adder(size: int, finish=None):
    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint64)
        for raw in table.column("counts"):
            total += _unpack(raw.as_py(), size)
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([finish(total) if finish else _pack(total)], pa.binary())})

    return add


def _slices(df: DataFrame, keys_of, width: int, finish) -> list[bytes]:
    """The added-up counters of each slice, finished on the executors.

    Tasks are added up in groups of about the square root of their number, then all.
    """
    size = width // SLICES
    tasks = df.rdd.getNumPartitions()
    parts = df.mapInArrow(_counter(keys_of, width), "slice int, counts binary").withColumn("part", (F.spark_partition_id() / max(1, int(tasks**0.5))).cast("int"))
    parts = parts.groupBy("slice", "part").applyInArrow(_adder(size), "slice int, counts binary")
    rows = parts.groupBy("slice").applyInArrow(_adder(size, finish), "slice int, counts binary").collect()
    return [bytes(r["counts"]) for r in sorted(rows, key=lambda r: r["slice"])]


def key_counts(df: DataFrame, keys_of, width: int) -> np.ndarray:
    """Counts of all keys modulo width, a power of two, up to 2**32 - 1; keys_of yields arrays of hashes for a batch."""
    found = _slices(df, keys_of, width, lambda total: blob(np.minimum(total, 0xFFFFFFFF).astype(np.uint32)))
    return np.concatenate([np.frombuffer(x, np.uint32) for x in found]) if found else np.zeros(width, np.uint32)


BLOOM_BITS = 1 << 23  # one megabyte; more keys than it can tell apart only let more rows through


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = mix(keys + U64(0xB10))
    return (keys & U64(BLOOM_BITS - 1)).astype(np.int64), (other & U64(BLOOM_BITS - 1)).astype(np.int64)


def bloom(df: DataFrame, column: str) -> bytes:
    """A Bloom filter of a bigint column."""

    def places(batch):
        for at in _places(batch.column(0).to_numpy(zero_copy_only=False).view(U64)):
            yield at.astype(U64)

    found = _slices(df.select(column).where(F.col(column).isNotNull()), places, BLOOM_BITS, lambda total: blob(np.packbits(total > 0)))
    return b"".join(found) if found else bytes(BLOOM_BITS // 8)


def maybe_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """May each key be in the filter? bits: np.unpackbits of its bytes."""
    a, b = _places(keys)
    return (bits[a] & bits[b]).astype(bool)
