"""Line dedup: MinHash over character shingles, exact verification, union-find.

A line with a word is compared by its set of 10-character shingles, A-Z lower-cased (a
shorter line has one shingle, itself). Lines are linked at a Jaccard similarity of 0.8
or more, and of each connected component of lines one occurrence stays: the first by
doc_id, then by place. Lines without a word always stay.

Equal lines are one line from the start, by a 64-bit hash. Twelve bands of four minima
each find a pair of similarity 0.8 with probability 0.998. In a bucket of up to 16
lines all pairs are candidates; in a larger one each line is paired with two hubs and
its neighbour in hash order, and lines that are still in different components afterwards
once more with new hubs. The lines of buckets that even then lie in several components
are compared exactly: two linked lines share one of their rarest shingles, so lines of
different components meet at each such shingle, agree in length and place there, and are
verified in the task that lists them, which only returns links. A shingle of many lines
is dealt out in blocks. So a group of copies costs pairs in proportion to its lines, and
no pair of a large bucket is lost. Verification is on whole lines; union-find is distributed.

Null and empty texts have no lines. A null doc_id counts as greater than all others;
rows that agree in id and text are one document. Lines, like texts, have any length.
An empty table gives an empty result. Other columns may have any name.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .exact_links import MOST_PAIRS, exact_links
from .exchange import blob, parts, pieces, small_batches
from .frames import fresh, whole_row
from .kernels import U64, eights, in_word, lower_ascii, mix, ragged, signed, slices, span_hashes, splitmix, utf8
from .sketches import bloom, maybe_in
from .storage import saved

SHINGLE, BANDS, ROWS = 10, 12, 4
GRAM = 4  # characters of 16 bits in a word
FULL_BUCKET = 16
SIGNED_AT_ONCE = 1 << 15  # shingles
BYTES_AT_ONCE = 1 << 15  # of lines that are cut into shingles: their hashes fit the processor's cache
LINES_AT_ONCE = 1 << 16  # whose bands a task gathers before it sends them
PLACES_AT_ONCE = 1 << 18  # that a task gathers before it sends the first and last of each line
LAST_ID = 2**63 - 1


def line_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each line that has a word, its text and its number in that text."""
    z = np.zeros(0, np.int64)
    if not len(data):
        return z, z, z, z
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([off[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    doc = np.searchsorted(off, starts, "right") - 1
    ends = ends - (data[ends - 1] == 10)
    has = in_word(data[starts]) & (ends > starts)
    blank = np.flatnonzero(~has & (ends > starts))  # only lines that begin with white space are searched further
    n = ends[blank] - starts[blank]
    if 8 * n.sum() > len(data):
        solid = np.concatenate([[0], np.cumsum(in_word(data), dtype=np.int32)])
        has[blank] = solid[ends[blank]] > solid[starts[blank]]
    elif len(blank):
        has[blank] = np.logical_or.reduceat(in_word(data[ragged(starts[blank], n)]), np.cumsum(n) - n)
    # empty texts share their start with the next one; a text's first line is the one at its offset
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, off[doc])
    return starts[has], ends[has], doc[has], number[has]


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the four characters from each character on, zeros after the end; some more than there are characters."""
    if not (data >= 0xC0).any():
        units = astral = data
    elif not (data >= 0xF0).any():
        units = astral = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-16-le"), np.uint16)
    else:
        astral = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        units = astral.astype(np.uint16)
    padded = np.zeros(len(units) + SHINGLE, np.uint16)
    padded[: len(units)] = units
    grams = mix(np.ascontiguousarray(np.ndarray((len(units) + SHINGLE - GRAM,), "<u8", padded, 0, (2,))))
    if astral.dtype == np.uint32:  # four units of 16 bits can't tell these grams apart
        begins = astral > 0xFFFF
        begins[:-1] |= begins[1:]
        begins[:-2] |= begins[2:]
        at, points = np.flatnonzero(begins), np.append(astral, np.zeros(GRAM, np.uint32))
        grams[at] = mix(sum(mix(points[at + j] + U64(j << 32)) for j in range(GRAM)))
    return grams


def shingles(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each line's shingles, with repetitions, and how many each line has (one at least).

    A shingle is hashed by three of its grams of four characters, which cover it.
    Lines come in the order of their places and aren't empty.
    """
    grams = _grams(data)
    size = len(grams) - SHINGLE + GRAM
    h = grams[GRAM : GRAM + size] * U64(0x9E3779B97F4A7C15)
    h += grams[SHINGLE - GRAM :] * U64(0xD1342543DE82EF95)
    h += grams[:size]
    first, last = s, e
    if size < len(data):
        later = np.flatnonzero((data & 0xC0) == 0x80)
        first, last = s - np.searchsorted(later, s), e - np.searchsorted(later, e)
    n = np.maximum(last - first - SHINGLE + 1, 1)
    after = np.append(0, first + n)
    kept = np.ones(size, bool)
    kept[ragged(after, np.append(first, size) - after)] = False
    out = h[kept]
    short = np.flatnonzero(last - first < SHINGLE)
    if len(short):
        out[(np.cumsum(n) - n)[short]] = span_hashes(data, s[short], e[short])
    return out, n


def signatures(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The band keys of each line, one row a line."""
    factors = (splitmix(BANDS * ROWS, 0x11) >> U64(32)).astype(np.uint32) | np.uint32(1)
    keys, ends = np.zeros((len(n), BANDS), U64), np.cumsum(n)
    i = 0
    while i < len(n):  # what fits the processor's cache at once
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + SIGNED_AT_ONCE, "right")))
        start = ends[i:j] - n[i:j] - (ends[i] - n[i])
        short = (h[ends[i] - n[i] : ends[j - 1]] >> U64(32)).astype(np.uint32)
        turned, lows = np.empty_like(short), np.empty((BANDS * ROWS, j - i), np.uint32)
        for k in range(BANDS * ROWS):
            np.multiply(short, factors[k], out=turned)  # hashes are mixed, so odd factors order them anew
            np.minimum.reduceat(turned, start, out=lows[k])
        mixed = mix(lows.astype(U64) + np.arange(1, 2 * BANDS * ROWS, 2, dtype=U64)[:, None]).reshape(BANDS, ROWS, j - i)
        for r in range(ROWS):
            keys[i:j] = keys[i:j] * U64(0x9E3779B97F4A7C15) + mixed[:, r].T
        i = j
    return mix(keys + np.arange(BANDS, dtype=U64))


def line_signatures(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The band keys of lines that come in the order of their places, some kilobytes of lines after the other."""
    keys, i = [np.zeros((0, BANDS), U64)], 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + BYTES_AT_ONCE, "right")))
        keys.append(signatures(*shingles(data[s[i] : e[j - 1]], s[i:j] - s[i], e[i:j] - s[i])))
        i = j
    return np.concatenate(keys)


def _lines(column):
    """Slice by slice: lower-cased bytes, bounds, document, number and key of the lines."""
    data, off = utf8(column)
    for i, j in slices(off):
        part = lower_ascii(data[off[i] : off[j]])
        s, e, doc, number = line_bounds(part, off[i : j + 1] - off[i])
        yield i, part, s, e, doc, number, span_hashes(part, s, e) if len(s) else np.zeros(0, U64)


def _band_keys(shards: int):
    """The bands of the lines of a task, a bounded number at a time; a line that comes again isn't signed again."""

    def message(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bands = np.concatenate([b for _, b in held]).ravel()
        line = np.repeat(np.concatenate([k for k, _ in held]), BANDS)
        shard = (bands >> U64(32)).astype(np.int64) * shards >> 32
        order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
        bands, line, ranges = bands[order].astype(np.uint32), line[order], parts(shard[order])
        arrays = [pa.array([blob(c[p]) for _, p in ranges], pa.binary()) for c in (bands, line)]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in ranges], pa.int32()), *arrays], ["shard", "band", "line"])

    def send(batches):
        held, seen = [], set()
        for batch in batches:
            for _, part, s, e, _, _, all_keys in _lines(batch.column(0)):
                key, once = np.unique(all_keys, return_index=True)
                new = np.array([k not in seen for k in key.tolist()], bool)
                if not new.any():
                    continue
                once = np.sort(once[new])
                key = all_keys[once]
                seen.update(key.tolist())
                held.append((key, line_signatures(part, s[once], e[once])))
                if len(seen) > LINES_AT_ONCE:
                    yield message(held)
                    held, seen = [], set()
        if held:
            yield message(held)

    return send


def _in_groups(band: np.ndarray) -> np.ndarray:
    """Is a neighbour in this order equal?"""
    several = np.zeros(len(band), bool)
    several[1:] = band[1:] == band[:-1]
    several[:-1] |= several[1:]
    return several


def _buckets(table: pa.Table) -> pa.Table:
    """The buckets of two lines or more."""
    band, line = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("band", np.uint32), ("line", U64)))
    order = np.argsort(band)
    band = band[order]
    order, band = (x[_in_groups(band)] for x in (order, band))  # most bands have one line
    line = line[order]
    order = np.lexsort((line, band))
    band, line = band[order], line[order]
    new = np.ones(len(band), bool)
    new[1:] = (band[1:] != band[:-1]) | (line[1:] != line[:-1])
    band, line = band[new], line[new]
    several = _in_groups(band)
    return pa.table({"shard": table.column("shard")[:1], "band": pa.array([blob(band[several])], pa.binary()), "line": pa.array([blob(line[several])], pa.binary())})


def _spread(band: np.ndarray, line: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket's lines with its two hubs and with their neighbours, in an order that depends on bucket and seed."""
    order = np.lexsort((mix(line ^ mix(band.astype(U64) + U64(seed))), band))
    band, line = band[order], line[order]
    start = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]])) if len(band) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(band)))
    hub = np.repeat(start, length)
    second = np.repeat(np.minimum(start + 1, start + length - 1), length)
    before = np.maximum(np.arange(len(band)) - 1, hub)
    return np.concatenate([line[hub], line[second], line[before]]), np.concatenate([line, line, line])


def _ordered(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = signed(np.ascontiguousarray(a)), signed(np.ascontiguousarray(b))
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    new &= a != b
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])


def _sizes(band: np.ndarray) -> np.ndarray:
    start = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]])) if len(band) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(band)))
    return np.repeat(length, length)


def _first_pairs(batches):
    for batch in batches:
        for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            band, line = np.frombuffer(x, np.uint32), np.frombuffer(y, U64)
            large = _sizes(band) > FULL_BUCKET
            a, b = _spread(band[large], line[large], 0)
            a, b = [a], [b]
            band, line = band[~large], line[~large]
            for d in range(1, FULL_BUCKET):
                i = np.flatnonzero(band[d:] == band[:-d])
                a.append(line[i])
                b.append(line[i + d])
            yield _ordered(np.concatenate(a), np.concatenate(b))


def _large(batches):
    for batch in batches:
        for shard, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            band, line = np.frombuffer(x, np.uint32), np.frombuffer(y, U64)
            large = _sizes(band) > FULL_BUCKET
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(large.sum()), shard, np.int64) << 32 | band[large].astype(np.int64)), pa.array(signed(line[large]))], ["bucket", "line"])


def _again(table: pa.Table) -> pa.Table:
    """New hubs for the lines of an open bucket; pairs within a component are left out."""
    bucket, line, root = (table.column(c).to_numpy() for c in ("bucket", "line", "root"))
    root_of = dict(zip(line.tolist(), root.tolist(), strict=True))
    pairs = _ordered(*_spread(bucket, line.view(U64), 1))
    keep = [root_of[a] != root_of[b] for a, b in zip(*(c.to_pylist() for c in pairs.columns), strict=True)]
    return pa.Table.from_batches([pairs.filter(pa.array(keep, pa.bool_()))])


SURVEY = "line long, bytes binary, ids binary, hashes binary, numbers binary, keys binary"


def _survey(wanted: bytes):
    """In one scan the bytes of the lines that may be in a Bloom filter, once a task, and the places of all lines, a row a slice."""

    def survey(batches):
        bits = np.unpackbits(np.frombuffer(wanted, np.uint8))
        seen: set[int] = set()
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lines, texts, places = [], [], []
            for i, part, s, e, doc, number, key in _lines(batch.column(2)):
                if not len(key):
                    continue
                places.append((blob(ids[doc + i]), blob(hashes[doc + i]), blob(number.astype(np.int32)), blob(key)))
                for j in np.flatnonzero(maybe_in(bits, key)):
                    if (k := int(key[j])) not in seen:
                        seen.add(k)
                        lines.append(key[j])
                        texts.append(part[s[j] : e[j]].tobytes())
            found, none = signed(np.array(lines, U64)).tolist(), [None] * len(places)
            columns = [pa.array(found + none, pa.int64()), pa.array(texts + none, pa.binary()), *(pa.array([None] * len(found) + [x[c] for x in places], pa.binary()) for c in range(4))]
            yield pa.RecordBatch.from_arrays(columns, ["line", "bytes", "ids", "hashes", "numbers", "keys"])

    return survey


def similarities(left: list[bytes], right: list[bytes], percent: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of the shingle sets of each pair of lines, 4,096 at most; the intersection is left at 0 where the sets' sizes rule out that percentage.

    The set of a line that is in several pairs is made once. A pair's number and 51 bits of a shingle's hash share a word.
    """
    number: dict[bytes, int] = {}
    a, b = (np.array([number.setdefault(x, len(number)) for x in side], np.int64) for side in (left, right))
    e = np.cumsum([len(x) for x in number])
    h, n = shingles(np.frombuffer(b"".join(number), np.uint8), e - [len(x) for x in number], e)
    own = np.sort(np.repeat(np.arange(len(number), dtype=U64) << U64(51), n) | (h >> U64(13)))
    own = own[np.append(True, own[1:] != own[:-1])]
    first = np.searchsorted(own, np.arange(len(number), dtype=U64) << U64(51))
    size = np.diff(np.append(first, len(own)))
    own &= U64((1 << 51) - 1)
    x, y = size[a], size[b]
    close = np.flatnonzero(100 * np.minimum(x, y) >= percent * np.maximum(x, y))
    keys = [np.repeat(close.astype(U64) << U64(51), size[side[close]]) | own[ragged(first[side[close]], size[side[close]])] for side in (a, b)]
    keys = np.sort(np.concatenate(keys), kind="stable")  # two sorted runs
    both = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> U64(51)).astype(np.int64), minlength=len(left))
    return both, x + y - both


def _similar(left: list[bytes], right: list[bytes], percent: int) -> np.ndarray:
    """Is each pair of lines linked?"""
    keep, at = [np.zeros(0, bool)], 0
    while at < len(left):
        end, size = at, 0
        while end < len(left) and end - at < MOST_PAIRS and (size < BYTES_AT_ONCE or end == at):
            size += len(left[end]) + len(right[end])
            end += 1
        both, either = similarities(left[at:end], right[at:end], percent)
        keep.append(100 * both >= percent * either)
        at = end
    return np.concatenate(keep)


def _verify(percent: int):
    def verify(batches):
        for batch in batches:
            keep = _similar(batch.column(2).to_pylist(), batch.column(3).to_pylist(), percent)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep))

    return verify


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    both = pairs.select("a", "b").join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    return saved(both.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long"))


def _sets(column):
    """For each slice of a column of lines: its first row, line and hash of each distinct shingle, set sizes."""
    data, off = utf8(column.cast(pa.string()))
    for i, j in slices(off):
        h, n = shingles(data[off[i] : off[j]], off[i:j] - off[i], off[i + 1 : j + 1] - off[i])
        row = np.repeat(np.arange(j - i), n)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        row, h = row[new], h[new]
        yield i, row, h, np.bincount(row, minlength=j - i)


def _open_lines(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, line, root) of the large buckets whose lines lie in several components."""
    rooted = large.join(roots.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
    still = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    return rooted.join(still, "bucket")


def line_components(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """(node, root) of the lines that are linked to another, a node being a line's key, the places of all lines, and how many shards of keys there are. docs: id, th, text."""
    small_batches(docs.sparkSession)
    texts = docs.select("text")
    n = pieces(texts)
    sent = texts.mapInArrow(_band_keys(n), "shard int, band binary, line binary")
    buckets = saved(sent.groupBy("shard").applyInArrow(_buckets, "shard int, band binary, line binary"))
    pairs = saved(buckets.mapInArrow(_first_pairs, "a long, b long").distinct())
    large = saved(buckets.mapInArrow(_large, "bucket long, line long"))
    wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("line")).union(large.select("line")).distinct())
    survey = saved(docs.select("id", "th", "text").mapInArrow(_survey(bloom(wanted, "line")), SURVEY))
    places = survey.where("line is null").select("ids", "hashes", "numbers", "keys")
    texts = saved(survey.where("line is not null").select("line", "bytes").join(wanted, "line", "left_semi").dropDuplicates(["line"]))
    first = _links(pairs, texts, percent)
    if large.isEmpty():
        return components(first), places, n
    more = _open_lines(large, components(first)).groupBy("bucket").applyInArrow(_again, "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
    links = first.union(_links(more, texts, percent))
    roots = components(links)
    left = saved(_open_lines(large, roots).select("line", "root").distinct())
    if left.isEmpty():
        return roots, places, n
    return components(links.union(exact_links(left.join(texts, "line").toDF("node", "root", "value"), percent, _sets, _similar))), places, n


def _columns(places) -> list[np.ndarray]:
    """Id, hash, number and key of the places in a batch or table."""
    kinds = {"ids": np.int64, "hashes": np.int64, "numbers": np.int32, "keys": U64}
    return [np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in places.column(c).to_pylist())]) for c, kind in kinds.items()]


def _in_order(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Places by key, id, hash and number, and which of them are the first and the last of their key."""
    order = np.lexsort((columns[2], columns[1], columns[0], columns[3]))
    columns = [c[order] for c in columns]
    first, last = np.ones(len(order), bool), np.ones(len(order), bool)
    first[1:] = last[:-1] = columns[3][1:] != columns[3][:-1]
    return columns, first, last


def _ends(shards: int):
    """The first and the last place of each line of a task, a bounded number of places at a time."""

    def message(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns, first, last = _in_order([np.concatenate(c) for c in zip(*held, strict=True)])
        columns = [c[first | last] for c in columns]
        ranges = parts((columns[3] >> U64(32)).astype(np.int64) * shards >> 32)
        arrays = [pa.array([blob(c[x]) for _, x in ranges], pa.binary()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in ranges], pa.int32()), *arrays], ["shard", "ids", "hashes", "numbers", "keys"])

    def send(batches):
        held, size = [], 0
        for batch in batches:
            held.append(_columns(batch))
            size += len(held[-1][3])
            if size > PLACES_AT_ONCE:
                yield message(held)
                held, size = [], 0
        if size:
            yield message(held)

    return send


PLACE = ("id", "th", "number")


def _repeated(places: pa.Table, roots: pa.Table) -> pa.Table:
    """Root, first and last place of the lines of a shard that are linked to another or have several places."""
    columns, node, root = _columns(places), roots.column("node").to_numpy(), roots.column("root").to_numpy()
    order = np.argsort(columns[3])
    key = columns[3][order]
    order = order[_in_groups(key) | np.isin(signed(key), node)]
    columns, first, last = _in_order([c[order] for c in columns])
    line = signed(columns[3][first])
    by = np.argsort(node)
    at = np.searchsorted(node, line, sorter=by)
    linked = np.isin(line, node)
    out = line.copy()
    out[linked] = root[by[at[linked]]]
    kept = linked | np.any([c[first] != c[last] for c in columns[:3]], axis=0)
    ends = {f"{end}_{c}": pa.array(x[which][kept].astype(np.int64)) for end, which in (("first", first), ("last", last)) for c, x in zip(PLACE, columns[:3], strict=True)}
    return pa.table({"line": pa.array(line[kept]), "root": pa.array(out[kept]), **ends})


def _occurrences(wanted: bytes):
    """A row for each place of the lines that may be in a Bloom filter."""

    def find(batches):
        bits = np.unpackbits(np.frombuffer(wanted, np.uint8))
        for batch in batches:
            columns = _columns(batch)
            hit = maybe_in(bits, columns[3])
            ids, hashes, number, key = (c[hit] for c in columns)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes), pa.array(number.astype(np.int64)), pa.array(signed(key))], ["id", "th", "number", "line"])

    return find


def _cut(column: int, removed: int):
    def cut(batches):
        for batch in batches:
            data, off = utf8(batch.column(column))
            lines = [np.zeros(0, np.int64), *(np.bincount(line_bounds(data[off[i] : off[j]], off[i : j + 1] - off[i])[2], minlength=j - i) for i, j in slices(off))]
            gone = [set(numbers or ()) for numbers in batch.column(removed).to_pylist()]
            at = np.array([bool(x) for x in gone], bool)
            texts, kept = batch.column(column), []
            for i in np.flatnonzero(at).tolist():
                kept.append("\n".join(x for k, x in enumerate(texts[i].as_py().split("\n")) if k not in gone[i]))
            if kept:
                texts = pc.replace_with_mask(texts, pa.array(at), pa.array(kept, texts.type))
            columns = [texts if i == column else c for i, c in enumerate(batch.columns[:removed])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(lines)), pa.array([len(x) for x in gone], pa.int64())], [*batch.schema.names[:removed], "n_lines", "n_removed"])

    return cut


def dedup_lines(df: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with its text cut, plus n_lines (lines with a word) and n_removed; columns of df with these names are replaced."""
    df = df.drop("n_lines", "n_removed")
    small_batches(df.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    identity = [F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(t).alias("th")]
    roots, places, n = line_components(df.select(*identity, t.alias("text")), percent)
    ends = places.mapInArrow(_ends(n), "shard int, ids binary, hashes binary, numbers binary, keys binary")
    of = roots.withColumn("of", F.expr(f"cast(shiftright(shiftrightunsigned(node, 32) * {n}L, 32) as int)"))
    schema = ", ".join(["line long", "root long", *(f"{end}_{c} long" for end in ("first", "last") for c in PLACE)])
    lines = ends.groupBy("shard").cogroup(of.groupBy("of")).applyInArrow(_repeated, schema)
    first, last = (F.struct(*(F.col(f"{end}_{c}").alias(c) for c in PLACE)).alias(end) for end in ("first", "last"))
    lines = saved(lines.select("line", "root", first, last))
    kept = lines.groupBy("root").agg(F.min("first").alias("keep"), F.max("last").alias("last")).where("keep <> last").select("root", "keep")
    drop = saved(lines.select("line", "root").join(kept, "root").select("line", "keep"))
    found = places.mapInArrow(_occurrences(bloom(drop, "line")), "id long, th long, number long, line long")
    gone = found.join(drop, "line").where(F.struct(*PLACE) != F.col("keep")).groupBy("id", "th").agg(F.collect_set("number").alias("gone"))
    joined = df.select(*identity, whole_row(df)).join(gone, ["id", "th"], "left")
    schema = T.StructType([*df.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.select("row.*", F.col("gone").alias(fresh(df, "gone"))).mapInArrow(_cut(df.columns.index(text), len(df.columns)), schema)
