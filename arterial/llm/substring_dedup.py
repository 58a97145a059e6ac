"""Substring dedup by recompression.

Rounds name runs and pairs of symbols until equal stretches of text carry equal
high-level symbols. First, short runs of one token are symbols. Then each pairing splits
all names by a hash into left and right ones and replaces each pair of a left one
followed by a right one, no longer than the pairing's limit, with a new symbol. Whether
a pair is merged depends on that pair alone: at an end of a repeated stretch a pairing
can upset one symbol, nothing further in. A margin adds up the worst case, so symbols
that cover the words of a window between its margins are the same wherever it occurs.

After every two pairings a Spark round names symbols globally. Groups of documents send
their distinct symbols to shards, which answer what occurs in two documents or more:
only that gets a name. What has no name is a dead end that no later symbol holds, and a
window with a nameless symbol between its margins repeats nowhere. Later rounds ask for
symbols of the windows that are left alone, so what is sent falls to the repeats there
are, and a window that survives the last round lies under high-level symbols that all
occur elsewhere. A proposed name is a hash of its parts, so equal parts are proposed
alike by all groups and no dictionary is handed out, only who has a name.

1. The rounds, as above: each a pass over the documents, which are dealt out once.
2. Surviving windows send the 96-bit hash of their words with the least doc_id; a shard
   answers with those that start in a smaller document elsewhere. That verifies each
   window exactly.
3. Each group removes the words under windows that a smaller doc_id has.

A doc_id that is null counts as greater than all others; rows with equal ids don't
remove each other's words. Null and empty texts have no words. Texts shorter than a
window are left whole, and texts of any length are read whole. Repeated rows give equal
rows. An empty table gives an empty result. Columns other than id and text don't matter.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import KEY_BITS, blob, grouped, pack_keys, parts, pieces, placed, shard_of, small_batches, totals, unpack_keys
from .kernels import U64, long_window_hashes, mix, ragged, slices, span_hashes, utf8, word_bounds

RUN_LIMIT = 3  # words
PAIRINGS_A_ROUND = 2
LAST_ID = np.iinfo(np.int64).max


def rounds_for(window: int) -> list[tuple[int, int]]:
    """For each naming round the pairings so far and their margin; the last leaves a word in the middle of a window."""
    margins = [0]
    while True:
        r = len(margins)
        # pairing r merges up to r + 1 words, so what it upsets is a symbol of r words at most
        more = margins[-1] + r + (RUN_LIMIT if r == 1 else 0)
        if 2 * more >= window:
            last = r - 1
            return [(r, margins[r]) for r in range(last + 1) if r == last or (r and r % PAIRINGS_A_ROUND == 0)]
        margins.append(more)


class Symbols:
    """The symbols of a group's texts; none crosses a text's end. live: not known to be without a name."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        self.names, self.sizes, self.live, self.pairings = words.copy(), np.ones(len(words), np.int64), np.ones(len(words), bool), 0
        opens = np.zeros(len(words) + 1, bool)
        opens[first] = True
        self.opens = opens[:-1]

    def _keep(self, keep: np.ndarray) -> None:
        self.names, self.sizes, self.opens, self.live = self.names[keep], self.sizes[keep], self.opens[keep], self.live[keep]

    def _runs(self) -> None:
        new = self.opens.copy()
        new[:1] = True
        new[1:] |= self.names[1:] != self.names[:-1]
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(new)))
        named = (length > 1) & (length <= RUN_LIMIT)
        self.names[at[named]] = mix(self.names[at[named]] * U64(0xA24BAED4963EE407) + length[named].astype(U64))
        self.sizes[at[named]] = length[named]
        keep = np.ones(len(new), bool)
        keep[ragged(at[named] + 1, length[named] - 1)] = False
        self._keep(keep)

    def pair(self, pairings: int) -> None:
        """On to this number of pairings."""
        for r in range(self.pairings + 1, pairings + 1):
            if r == 1:
                self._runs()
            right = (mix(self.names + U64(r)) >> U64(63)).astype(bool)
            merge = ~right[:-1] & right[1:] & ~self.opens[1:] & self.live[:-1] & self.live[1:] & (self.sizes[:-1] + self.sizes[1:] <= r + 1)
            at = np.flatnonzero(merge)
            self.names[at] = mix(self.names[at] * U64(0x9FB21C651E98DF25) + mix(self.names[at + 1] + U64(0x51)))
            self.sizes[at] += self.sizes[at + 1]
            keep = np.ones(len(self.names), bool)
            keep[at + 1] = False
            self._keep(keep)
        self.pairings = pairings

    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


class _Words:
    """The words of a group's documents, in the order of their ids."""

    def __init__(self, docs: pa.Table):
        ids = docs.column("doc_id").fill_null(LAST_ID).to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.docs = docs.take(pa.array(self.order))
        self.data, off = utf8(self.docs.column("text"))
        hashes, starts, ends, counts = [], [], [], []
        for i, j in slices(off):
            part = self.data[off[i] : off[j]]
            s, e, first = word_bounds(part, off[i : j + 1] - off[i])
            hashes.append(span_hashes(part, s, e))
            starts.append(s + off[i])
            ends.append(e + off[i])
            counts.append(np.diff(first))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.words, self.starts, self.ends, self.counts = join(hashes, U64), join(starts, np.int64), join(ends, np.int64), join(counts, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and document of each window, by document."""
        n = np.maximum(self.counts - size + 1, 0)
        return ragged(self.first[:-1], n), np.repeat(np.arange(len(n)), n)


class _Round:
    """What a group knows before naming round k: its symbols, the windows still possible, and the symbols to ask for."""

    def __init__(self, docs: pa.Table, answers: pa.Table | None, k: int, rounds: list[tuple[int, int]], window: int, shards: int):
        self.words = _Words(docs)
        self.symbols = Symbols(self.words.words, self.words.first)
        self.start, self.doc = self.words.windows(window)
        for r, (pairings, margin) in enumerate(rounds[: k + 1]):
            self.symbols.pair(pairings)
            self._ask(margin, window, shards)
            if r < k:
                self._name(answers.filter(pc.equal(answers.column("round"), r)), margin, window)

    def _ask(self, margin: int, window: int, shards: int) -> None:
        """asked: symbols with a word between the margins of a possible window; keys: the distinct ones, at: theirs."""
        edge = np.zeros(len(self.words.words) + 1, np.int64)
        np.add.at(edge, self.start + margin, 1)
        np.add.at(edge, self.start + window - margin, -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        begin = self.symbols.starts()
        self.asked = np.flatnonzero(self.symbols.live & (inside[begin + self.symbols.sizes] > inside[begin]))
        self.keys, self.at = np.unique(placed(self.symbols.names[self.asked], shards), return_inverse=True)

    def _name(self, answers: pa.Table, margin: int, window: int) -> None:
        where, named = dict(parts(self.keys >> U64(KEY_BITS))), np.zeros(len(self.keys), bool)
        for s, bits in zip(answers.column("shard").to_pylist(), answers.column("named").to_pylist(), strict=True):
            named[where[s]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=where[s].stop - where[s].start).astype(bool)
        live = np.zeros(len(self.symbols.live), bool)
        live[self.asked] = named[self.at]
        self.symbols.live = live
        under = np.concatenate([[0], np.cumsum(np.repeat(live, self.symbols.sizes))])
        left = under[self.start + window - margin] - under[self.start + margin] == window - 2 * margin
        self.start, self.doc = self.start[left], self.doc[left]


def _send_symbols(k: int, rounds: list[tuple[int, int]], window: int, shards: int):
    def send(docs: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        x, group = _Round(docs, answers, k, rounds, window, shards), docs.column("g")[0].as_py() if docs.num_rows else 0
        doc = np.repeat(np.arange(len(x.words.counts)), x.words.counts)[x.symbols.starts()[x.asked]]
        low, high = np.full(len(x.keys), len(x.words.counts)), np.zeros(len(x.keys), np.int64)
        np.minimum.at(low, x.at, doc)
        np.maximum.at(high, x.at, doc)
        several = (low < high).astype(np.uint8) + np.uint8(1)
        ranges = parts(x.keys >> U64(KEY_BITS))
        return pa.table({"shard": pa.array([s for s, _ in ranges], pa.int32()), "g": pa.array([group] * len(ranges), pa.int32()), "keys": pa.array([pack_keys(x.keys[p]) for _, p in ranges], pa.binary()), "n": pa.array([blob(several[p]) for _, p in ranges], pa.binary())})

    return send


def _name(k: int):
    def name(asked: pa.Table) -> pa.Table:
        """A bit for each key of each group, in the order asked: does it occur in two documents?"""
        keys = [unpack_keys(x) for x in asked.column("keys").to_pylist()]
        where, total = totals(keys, [np.frombuffer(x, np.uint8) for x in asked.column("n").to_pylist()])
        named = np.split(total[where] >= 2, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"g": asked.column("g").cast(pa.int32()), "round": pa.array([k] * len(keys), pa.int32()), "shard": asked.column("shard").cast(pa.int32()), "named": pa.array([blob(np.packbits(p)) for p in named], pa.binary())})

    return name


def _send_windows(rounds: list[tuple[int, int]], window: int, shards: int):
    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        r, group = _Round(docs, answers, len(rounds), rounds, window, shards), docs.column("g")[0].as_py() if docs.num_rows else 0
        x, start, doc = r.words, r.start, r.doc
        h, g = long_window_hashes(x.words, window, 1)[start], long_window_hashes(x.words, window, 2)[start]
        h, once = np.unique(h, return_index=True)  # documents stand in the order of their ids: the first has the least
        more, ids, ranges = (g[once] >> U64(32)).astype(np.uint32), x.ids[doc[once]], parts(shard_of(h, shards))
        return pa.table({"shard": pa.array([s for s, _ in ranges], pa.int32()), "g": pa.array([group] * len(ranges), pa.int32()), "keys": pa.array([blob(h[p]) for _, p in ranges], pa.binary()), "more": pa.array([blob(more[p]) for _, p in ranges], pa.binary()), "ids": pa.array([blob(ids[p]) for _, p in ranges], pa.binary())})

    return send


def _smaller_elsewhere(asked: pa.Table) -> pa.Table:
    """For each group the windows that start in a smaller document of another group."""
    read = lambda name, kind: [np.frombuffer(x, kind) for x in asked.column(name).to_pylist()]
    keys, more, ids = read("keys", U64), read("more", np.uint32), read("ids", np.int64)
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    k, m, i = np.concatenate(keys), np.concatenate(more), np.concatenate(ids)
    order = np.lexsort((i, m, k))
    k, m, i, row = k[order], m[order], i[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    least = i[new][np.cumsum(new) - 1]
    late = i > least
    by = np.argsort(row[late], kind="stable")
    cuts = np.searchsorted(row[late][by], np.arange(len(keys) + 1))
    k, m = k[late][by], m[late][by]
    rows = [r for r in range(len(keys)) if cuts[r] < cuts[r + 1]]
    g = asked.column("g").to_pylist()
    return pa.table({"g": pa.array([g[r] for r in rows], pa.int32()), "keys": pa.array([blob(k[cuts[r] : cuts[r + 1]]) for r in rows], pa.binary()), "more": pa.array([blob(m[cuts[r] : cuts[r + 1]]) for r in rows], pa.binary())})


def _remove(window: int):
    def remove(docs: pa.Table, late: pa.Table) -> pa.Table:
        x = _Words(docs)
        start, doc = x.windows(window)
        h, g = long_window_hashes(x.words, window, 1)[start], (long_window_hashes(x.words, window, 2)[start] >> U64(32)).astype(np.uint32)
        gone = np.zeros(len(start), bool)
        if len(start):
            keys, first, at = np.unique(h, return_index=True, return_inverse=True)
            least = x.ids[doc[first]]
            gone = (x.ids[doc] > least[at]) & (g == g[first][at])
            if late.num_rows:
                k = np.concatenate([np.frombuffer(v, U64) for v in late.column("keys").to_pylist()])
                m = np.concatenate([np.frombuffer(v, np.uint32) for v in late.column("more").to_pylist()])
                place = np.searchsorted(keys, k)
                other = np.full(len(keys), -1, np.int64)
                found = (place < len(keys)) & (keys[np.minimum(place, len(keys) - 1)] == k)
                other[place[found]] = m[found]
                gone |= other[at] == g
        edge = np.zeros(len(x.words) + 1, np.int64)
        np.add.at(edge, start[gone], 1)
        np.add.at(edge, start[gone] + window, -1)
        keep = np.cumsum(edge[:-1]) == 0
        per_doc = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[x.first])
        kept, size = per_doc(keep.astype(np.int64)), (x.ends - x.starts + 1) * keep
        raw = np.append(x.data, np.uint8(32))[ragged(x.starts[keep], size[keep])]
        raw[np.cumsum(size[keep]) - 1] = 32
        # each kept word stands with a space after it; the last space of a document is left out
        bytes_of = per_doc(size)
        ends = np.cumsum(bytes_of)
        solid = np.ones(len(raw), bool)
        solid[ends[bytes_of > 0] - 1] = False
        offsets = np.concatenate([[0], np.cumsum(bytes_of - (bytes_of > 0))])
        text = pa.LargeStringArray.from_buffers(len(kept), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw[solid].tobytes()))
        return pa.table({"doc_id": x.docs.column("doc_id"), "n_words": pa.array(x.counts, pa.int64()), "n_removed": pa.array(x.counts - kept, pa.int64()), "text": text.cast(pa.string())})

    return remove


def remove_repeats(df: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and text, the kept words joined by one space: one row a document."""
    rounds = rounds_for(window)
    small_batches(df.sparkSession)
    n = pieces(df)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = grouped(docs, ["doc_id", "text"], n)
    by_group, sent, answers = docs.groupBy("g"), "shard int, g int, keys binary, n binary", None
    for k in range(len(rounds)):
        asked = by_group.cogroup(answers.groupBy("g")).applyInArrow(_send_symbols(k, rounds, window, n), sent) if answers else by_group.applyInArrow(_first(_send_symbols(0, rounds, window, n)), sent)
        named = asked.groupBy("shard").applyInArrow(_name(k), "g int, round int, shard int, named binary")
        answers = answers.union(named) if answers else named
    windows = by_group.cogroup(answers.groupBy("g")).applyInArrow(_send_windows(rounds, window, n), "shard int, g int, keys binary, more binary, ids binary")
    late = windows.groupBy("shard").applyInArrow(_smaller_elsewhere, "g int, keys binary, more binary")
    return by_group.cogroup(late.groupBy("g")).applyInArrow(_remove(window), "doc_id long, n_words long, n_removed long, text string")


def _first(send):
    """With one argument, as Spark tells kernels apart by their number of arguments."""
    return lambda docs: send(docs)
