"""How blobs of keys travel between groups of documents and shards of the key space.

A group is some megabytes of text, chosen by a hash of the document. It sends each
key once, whatever number of its documents have it, so a key that a third of all
rows share reaches its shard in as many rows as there are groups. A shard answers
each group in the order of that group's sorted keys, so keys travel one way only.
Only parts that hold keys are sent: rows are never more than keys.

Inside a shard a key is known by 40 bits. Shards grow in number with the input, not
in size, so of the some ten million keys of a shard a few in a million coincide with
another, at any size. What must not coincide at all is verified by longer hashes.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import U64

GROUP_BYTES = 8 << 20  # of compressed input in a group or shard
MAX_PIECES = 1 << 23  # a bound of the keys' layout, at 64 TB of compressed input
MAX_PARTITIONS = 50_000  # more groups than that share partitions, one after the other
KEY_BITS = 40


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate for a scan of files, without a job; what else there may be is measured."""
    plan = df._jdf.queryExecution().optimizedPlan()
    estimate = int(str(plan.stats().sizeInBytes()))
    if plan.collectLeaves().size() == 1 and estimate < 1 << 60:
        return estimate
    strings = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    return df.select(sum(strings, F.lit(8 * len(df.columns))).cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 2


def pieces(df: DataFrame, per: int = GROUP_BYTES) -> int:
    """How many groups: of `per` bytes, or smaller ones while there are fewer of them than shuffle partitions."""
    size = size_in_bytes(df)
    wanted = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (256 << 10)))
    return int(min(max(1, wanted, -(-size // per)), MAX_PIECES))


def small_batches(spark: SparkSession) -> None:
    """Long texts: hand Python at most 512 rows at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def grouped(df: DataFrame, columns: list, n: int) -> DataFrame:
    """The columns plus `g`, dealt out by g; the key mixes id and text, so equal or null ids don't pile up."""
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("g")
    return df.select(*columns, key).repartition(min(n, MAX_PARTITIONS), "g")


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit hash; it rises with the hash."""
    return (h >> U64(KEY_BITS)) * U64(shards) >> U64(64 - KEY_BITS)


def placed(h: np.ndarray, shards: int) -> np.ndarray:
    """Keys that sort by shard: the shard's number, then the 40 bits that tell keys of a shard apart."""
    return shard_of(h, shards) << U64(KEY_BITS) | h & U64((1 << KEY_BITS) - 1)


def parts(shard: np.ndarray) -> list[tuple[int, slice]]:
    """The shards that have keys, with their range, of sorted shard numbers."""
    if not len(shard):
        return []
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    return [(int(shard[i]), slice(i, j)) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(shard)], strict=True)]


def pack_keys(keys: np.ndarray) -> bytes:
    """The 40 bits of placed keys, high bytes last: those are runs, if the keys are sorted."""
    return blob(keys.astype(np.uint32)) + blob((keys >> U64(32)).astype(np.uint8))


def unpack_keys(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return np.frombuffer(raw, np.uint32, n).astype(U64) | np.frombuffer(raw, np.uint8, n, 4 * n).astype(U64) << U64(32)


def pack_counts(counts: np.ndarray) -> bytes:
    """In as few bytes a count as the greatest needs."""
    top = int(counts.max()) if len(counts) else 0
    return blob(counts.astype(next(t for t in (np.uint8, np.uint16, np.uint32, U64) if top <= np.iinfo(t).max)))


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def totals(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the index of each sent key, and their summed counts."""
    keys = np.concatenate(parts) if parts else np.zeros(0, U64)
    c = np.concatenate(counts).astype(np.float64) if counts else np.zeros(0)
    distinct, where = np.unique(keys, return_inverse=True)
    return where, np.bincount(where, weights=c, minlength=len(distinct)).astype(np.int64)

