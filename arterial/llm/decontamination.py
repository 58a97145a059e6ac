"""Benchmark decontamination: SimHash windows, multi-index Hamming search, exact similarity.

Texts are lower-cased and cut into words of letters and digits. For each item length m a
window is m consecutive words of a document; its shingles are its 5-word sequences,
each weighing the bytes of its words. A window matches an item of its length if the
weighted Jaccard similarity of their shingle multisets is at least 0.8. A document of
fewer words than an item is its own, only window for that item.

1. Windows are scanned at every word. The weight of a window's shingles that occur in
   any item at all bounds its similarity to each of them from above, so windows under
   the threshold by that bound are dropped; that loses nothing.
2. The others get a 64-bit SimHash of their weighted shingles. Fingerprints within the
   radius of 19 bits agree with an item in one of four 16-bit blocks up to 4 bits; for
   each block a table holds, for all 65,536 values, the items that near. The union of
   four look-ups holds every item within the radius; then the distance is counted.
   At similarity 0.8 the expected distance is 10 bits.
3. What is left is verified exactly.

The blocks of bits find all fingerprints within the radius; a window of similarity 0.8
whose fingerprint lies farther away than that is missed. ``tests`` measure the share.

Items are a query set: one index holds up to 4,096 of them and 4 MB of text, which the
driver passes to the tasks; documents are scanned once and aren't shuffled. A larger
benchmark is dealt with in such blocks, one scan each, whose matches are saved before
the driver reads the next block.

Items and windows of fewer than 5 words have one shingle, all their words. Null or
empty items and texts match nothing; a null id is an id like any other. Equal items
match alike, and so do repeated rows; of equally similar windows the first counts.
Whole texts are scanned. Empty tables give empty results, and an empty benchmark leaves
all documents. Other columns may have any name.
"""

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import small_batches
from .kernels import U64, slices, span_hashes, utf8, window_hashes
from .storage import saved

K, THRESHOLD, RADIUS = 5, 0.8, 19
BLOCK_ITEMS, BLOCK_BYTES = 4096, 1 << 22
MATCH = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def _word_bytes() -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in ((48, 58), (97, 123), (128, 256)):
        t[a:b] = True
    return t


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and size of each word, and the index of each text's first one."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = _word_bytes()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return span_hashes(data, s, e), e - s, np.searchsorted(s, off)


def _shingles(words: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of the shingle that starts at each word; the last k - 1 have none."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return window_hashes(words, k, 100 + k), (total[k:] - total[:-k]) if len(words) >= k else np.zeros(0, np.int64)


def simhash_sums(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums, for each of 64 bits, of the weights with the bit's sign."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    return np.concatenate([np.zeros((1, 64), np.int64), np.cumsum((2 * bits - 1) * weights[:, None], axis=0)])


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).reshape(-1, 8).copy().view(U64)[:, 0]


class Items:
    """A block of benchmark items, ready to be looked up."""

    def __init__(self, rows: list[tuple[int, str]]):
        data, off = utf8(pc.utf8_lower(pa.array([t for _, t in rows], pa.string())))
        words, sizes, first = _words(data, off)
        self.ids, self.length, self.shingles, prints = [], [], [], []
        # items of a length stand together, so that few chunks are looked up for a window
        for at in np.argsort(np.diff(first), kind="stable").tolist():
            item, a, b = rows[at][0], first[at], first[at + 1]
            if a == b:
                continue
            h, w = _shingles(words[a:b], sizes[a:b], min(K, b - a))
            self.ids.append(item)
            self.length.append(int(b - a))
            self.shingles.append(Counter())
            for x, y in zip(h.tolist(), w.tolist(), strict=True):
                self.shingles[-1][x] += y
            prints.append(fingerprints(simhash_sums(h, w)[-1:])[0])
        self.prints = np.array(prints, U64)
        self.known = np.unique(np.array([x for s in self.shingles for x in s], U64))
        self.of_length: dict[int, np.ndarray] = {}
        for m in set(self.length):
            self.of_length[m] = self._bitset([i for i, n in enumerate(self.length) if n == m])
        self.tables = None

    def _bitset(self, members: list[int]) -> np.ndarray:
        out = np.zeros(-(-len(self.ids) // 64), U64)
        for i in members:
            out[i // 64] |= U64(1) << U64(i % 64)
        return out

    def near(self) -> list[list[np.ndarray]]:
        """[chunk of 64 items][block of 16 bits][value]: the items whose block is within RADIUS // 4 bits of the value."""
        if self.tables is None:
            ball = np.array([v for v in range(1 << 16) if v.bit_count() <= RADIUS // 4], np.int64)
            self.tables = [[np.zeros(1 << 16, U64) for _ in range(4)] for _ in range(-(-len(self.ids) // 64))]
            for i, p in enumerate(self.prints.tolist()):
                for b in range(4):
                    self.tables[i // 64][b][ball ^ (p >> (16 * b) & 0xFFFF)] |= U64(1) << U64(i % 64)
        return self.tables

    def candidates(self, prints: np.ndarray, m: int) -> Iterator[tuple[int, int]]:
        """(window, item) within the radius, among items of m words."""
        tables = self.near()
        for c, chunk in enumerate(tables):
            if not self.of_length[m][c]:
                continue
            found = np.zeros(len(prints), U64)
            for b in range(4):
                found |= chunk[b][((prints >> U64(16 * b)) & U64(0xFFFF)).astype(np.int64)]
            found &= self.of_length[m][c]
            for w in np.flatnonzero(found):
                bits = int(found[w])
                while bits:
                    i = 64 * c + (bits & -bits).bit_length() - 1
                    bits &= bits - 1
                    if (int(prints[w]) ^ int(self.prints[i])).bit_count() <= RADIUS:
                        yield int(w), i


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets; the values are summed weights."""
    low = sum(min(w, b[x]) for x, w in a.items() if x in b)
    return low / (a.total() + b.total() - low)


def matches(items: Items, words: np.ndarray, sizes: np.ndarray) -> dict[int, tuple[float, int, int]]:
    """For each item that a document's words contain: similarity, first word and length of its best window (the first of equals)."""
    best: dict[int, tuple[float, int, int]] = {}
    for k in sorted({min(K, m) for m in items.of_length}):
        if len(words) < k:
            continue
        h, w = _shingles(words, sizes, k)
        at = np.minimum(np.searchsorted(items.known, h), len(items.known) - 1)
        hit = items.known[at] == h
        if not hit.any():
            continue
        all_weight, hit_weight = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(w * hit)])
        sums = None
        for m in items.of_length:
            if min(K, m) != k:
                continue
            size = min(m, len(words))
            n = size - k + 1
            possible = np.flatnonzero(hit_weight[n:] - hit_weight[:-n] >= THRESHOLD * (all_weight[n:] - all_weight[:-n]))
            if not len(possible):
                continue
            sums = simhash_sums(h, w) if sums is None else sums
            for i, item in items.candidates(fingerprints(sums[possible + n] - sums[possible]), m):
                s = int(possible[i])
                window: Counter = Counter()
                for x, y in zip(h[s : s + n].tolist(), w[s : s + n].tolist(), strict=True):
                    window[x] += y
                value = similarity(window, items.shingles[item])
                if value >= THRESHOLD and (item not in best or value > best[item][0]):
                    best[item] = (value, s, size)
    return best


def _scan(items: Items, texts) -> Iterator[tuple[int, dict[int, tuple[float, int, int]]]]:
    """(row, matches) of each text that has some."""
    data, off = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    for i, j in slices(off):
        words, sizes, first = _words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        some = np.zeros(len(words) + 1, np.int64)
        for k in {min(K, m) for m in items.of_length}:
            h = window_hashes(words, k, 100 + k)
            at = np.minimum(np.searchsorted(items.known, h), len(items.known) - 1)
            some[1 : len(h) + 1] += items.known[at] == h
        some = np.cumsum(some)
        for d in np.flatnonzero(some[first[1:]] > some[first[:-1]]):
            if found := matches(items, words[first[d] : first[d + 1]], sizes[first[d] : first[d + 1]]):
                yield i + int(d), found


def _finder(rows: list[tuple[int, str]]):
    def find(batches: Iterable[pa.RecordBatch]):
        items = Items(rows)
        for batch in batches:
            found = [(d, i, *m) for d, ms in (_scan(items, batch.column(1)) if items.ids else ()) for i, m in ms.items()]
            doc = batch.column(0).take(pa.array([d for d, *_ in found], pa.int64()))
            columns = zip(*((items.ids[i], *m) for _, i, *m in found), strict=True) if found else ([], [], [], [])
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([doc, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return find


def _dropper(rows: list[tuple[int, str]], column: int):
    def drop(batches: Iterable[pa.RecordBatch]):
        items = Items(rows)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for d, _ in _scan(items, batch.column(column)) if items.ids else ():
                keep[d] = False
            yield batch.filter(pa.array(keep))

    return drop


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded number and bytes; the driver holds one block at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null").toLocalIterator()
    for r in rows:
        if block and (len(block) == BLOCK_ITEMS or size + len(r.t) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    if block:
        yield block


def contaminated(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row, as MATCH, for each document and item that it contains."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out, before = df.sparkSession.createDataFrame([], MATCH), None
    for rows in item_blocks(benchmark):
        out, before = out.union(saved(before)) if before else out, docs.mapInArrow(_finder(rows), MATCH)
    return out.union(before) if before else out


def decontaminated(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """df without the documents that contain an item; no shuffle."""
    small_batches(df.sparkSession)
    column, schema, first = df.columns.index(text), df.schema, True
    for rows in item_blocks(benchmark):
        df, first = (df if first else saved(df)).mapInArrow(_dropper(rows, column), schema), False
    return df
