"""Vectorised numpy kernels over the UTF-8 bytes of Arrow string columns.

Words are maximal runs of bytes outside ``0x20, 0x09-0x0D``; as those are all
ASCII, splitting bytes equals splitting code points. Every hash here is a pure
function of content, so a retried task on another executor gives equal keys.
"""

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 17  # of text handled at once: bounds the memory of a kernel
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, 9, 10, 11, 12, 13]] = False


def splitmix(n: int, seed: int) -> np.ndarray:
    """The first n outputs of the public SplitMix64 generator."""
    with np.errstate(over="ignore"):
        z = U64(seed) + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a permutation in which every input bit reaches every output bit."""
    y = x >> U64(32)
    y ^= x
    y *= U64(0xD6E8FEB86659FD93)
    t = y >> U64(32)
    y ^= t
    y *= U64(0xD6E8FEB86659FD93)
    t = y >> U64(32)
    y ^= t
    return y


_cache: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    base = 0x2545F4914F6CDD1B
    have = _cache.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        size = 1 << (size - 1).bit_length()
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(1, U64)
            while len(p) < size:
                p = np.concatenate([p, p * U64(pow(b, len(p), 1 << 64))])
            out.append(p)
        have = _cache["powers"] = (out[0], out[1])
    return have


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of texts of about `limit` bytes together; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def in_word(data: np.ndarray) -> np.ndarray:
    """Is each byte part of a word?"""
    return IN_WORD[data]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = in_word(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros after the end; one more than there are bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span [s, e).

    Eight bytes at a time pass through the finaliser together with their place, and the
    results are added up, so texts of a regular structure collide no more than others.
    """
    n = e - s
    eight = eights(data)
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
    total = mix((eight[s] & masks[np.minimum(n, 8)]) + U64(0x5EED))
    long = np.flatnonzero(n > 8)
    if len(long):
        more = (n[long] - 1) >> 3  # eights after the first
        ends = np.cumsum(more)
        k = np.arange(int(ends[-1])) - np.repeat(ends - more, more) + 1
        x = eight[np.repeat(s[long], more) + 8 * k]
        x[ends - 1] &= masks[n[long] - 8 * more]
        total[long] += np.add.reduceat(mix(x ^ mix(k.astype(U64) * U64(0x9E3779B97F4A7C15))), ends - more)
    return mix(total + n.astype(U64) * U64(0xA24BAED4963EE407))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


def window_hashes(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of each k consecutive values; len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    factors = splitmix(k, seed) | U64(1)
    acc = np.zeros(n, U64)
    for i in range(k):
        acc += words[i : i + n] * factors[i]
    return mix(acc)


def long_window_hashes(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """As window_hashes, by prefix sums: the cost doesn't depend on k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    p, inverse = _powers(len(words) + 1)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(mix(words + U64(seed)) * p[: len(words)], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[:n])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one range after the other."""
    lengths = np.maximum(lengths, 0)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct k-word shingles of each text, sorted by both.

    A text with fewer words, but some, has its whole sequence as its one shingle.
    """
    n = np.diff(first)
    all_windows = window_hashes(words, k)
    at = ragged(first[:-1], n - k + 1)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))
    h = all_windows[at] if len(at) else np.zeros(0, U64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.array([window_hashes(words[first[d] : first[d + 1]], int(n[d]), 7)[0] for d in short], U64)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, own])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
    return doc, h


def signed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit hashes as Spark's bigint."""
    return np.ascontiguousarray(x).view(np.int64)
