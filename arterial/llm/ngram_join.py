"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct 4-word shingles; two sets link when
100 * intersection >= 85 * union. All shingles are ordered by their estimated document
frequency, rare ones first, then by hash. If two sets link, then for any l the first
``size - least overlap + l`` shingles of both have l in common. Each document chooses
its own l: a longer prefix has more postings to scan but asks for more shared shingles
before a pair is verified; the estimated cost of both decides. A pair needs the smaller l
of its two documents. As in the usual refinement, the smaller set of a pair need only
look at its shorter index prefix.

Frequencies are estimated from a sketch of all shingles of all documents, which has a
fixed size; it steers costs only, any order gives the same links.

Equal sets are one class from the start, known by a 64-bit hash of the set. Rare
shingles have short posting lists, whose pairs are listed at once. Long lists, as of
large groups of near copies, are first linked as stars around their most central
classes. A linked pair that lies in different components even then shares as many
shingles as it needs at places where both fit. So the classes that have partners of other
components at so many places, short lists counted in, are compared exactly, in the tasks
that list them, which return links only (``exact_links``): none is lost, no pairs are
written, and a group of near copies costs rows in proportion to its size. Whole sets are
sent only where counts of both sets' hashes by cells allow a link. Verification is
exact, on the whole sets of shingle hashes.

Null and empty texts, and texts without words, have an empty set and link with
nothing; texts of fewer words than a shingle have one shingle, all their words. Null
ids can link but are never a component's id, unless all its ids are null. Repeated rows
give equal rows; texts of any length are read whole. An empty table gives an empty
result. Other columns may have any name.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .exact_links import SKETCH, Overlap, Similar, cells_of, estimates, exact_links, partner_counts
from .exchange import blob, parts, pieces, small_batches
from .frames import whole_row
from .kernels import U64, lower_ascii, mix, shingle_sets, signed, slices, span_hashes, utf8, word_bounds
from .sketches import bloom, key_counts, maybe_in
from .storage import saved

SHORT_LIST = 16
MAX_MATCH = 8
POSTINGS_AT_ONCE = 1 << 20  # that a task gathers before it sends them
VERIFY_COST = 20.0  # in postings scanned
CELLS = 256  # of the counts that tell whether two sets can share enough
COUNTED = 65535  # members of a set that has counts; larger sets are always verified
CHANCE = 0.05  # candidates that any shingle may bring, however rare it looks in the sketch
PAIR = "a long, b long, need int, n int"


def _sets(column, k: int):
    """For each slice of a batch: its first row, document and hash of each distinct shingle, set sizes."""
    data, off = utf8(column)
    for i, j in slices(off):
        part = lower_ascii(data[off[i] : off[j]])
        s, e, first = word_bounds(part, off[i : j + 1] - off[i])
        doc, h = shingle_sets(span_hashes(part, s, e), first, k)
        yield i, doc, h, np.bincount(doc, minlength=j - i)


def _classes(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h + U64(0xC1A55)))])
    ends = np.cumsum(sizes)
    return signed(mix(total[ends] - total[ends - sizes] + sizes.astype(U64) * U64(0x9E3779B97F4A7C15)))


def _describe(k: int):
    def describe(batches):
        for batch in batches:
            sizes, classes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, doc, h, n in _sets(batch.column(1), k):
                sizes.append(n)
                classes.append(_classes(doc, h, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(classes), pa.int64())], ["doc_id", "n_shingles", "cls"])

    return describe


def choose_match(q: np.ndarray, start: np.ndarray, sizes: np.ndarray, bound: Overlap, chance: float = 0.0) -> np.ndarray:
    """For each set the number of shared prefix shingles to ask for, by estimated cost."""
    scan = np.concatenate([[0.0], np.cumsum(np.exp2(q / 4.0) - 1 + chance)])
    best, cost = np.ones(len(sizes), np.int64), np.full(len(sizes), np.inf)
    for match in range(1, MAX_MATCH + 1):
        postings = scan[start + np.minimum(bound.probe(sizes, match), sizes)] - scan[start]
        # a candidate takes up `match` postings at least
        now = np.where((match == 1) | (sizes >= 10 * match), postings + VERIFY_COST * postings / match, np.inf)
        best, cost = np.where(now < cost, match, best), np.minimum(now, cost)
    return best


def _postings(k: int, percent: int, sketch: np.ndarray, shards: int):
    bound = Overlap(percent)

    def message(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        shard = (columns[0] >> U64(32)).astype(np.int64) * shards >> 32
        order = np.argsort(shard, kind="stable")
        ranges = parts(shard[order])
        arrays = [pa.array([blob(c[p]) for _, p in ranges], pa.binary()) for c in (c[order] for c in columns)]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in ranges], pa.int32()), *arrays], ["shard", *FIELDS])

    def post(batches):
        held, size = [], 0
        for batch in batches:
            for _, doc, h, sizes in _sets(batch.column(0), k):
                if not len(h):
                    continue
                classes = _classes(doc, h, sizes)
                q = sketch[(h & U64(SKETCH - 1)).astype(np.int64)]
                order = np.lexsort((h, q, doc))
                h, q = h[order], q[order]
                start = np.cumsum(sizes) - sizes
                match = choose_match(q, start, sizes, bound, CHANCE)
                rank = np.arange(len(h)) - start[doc]
                inside = rank < np.minimum(bound.probe(sizes, match), sizes)[doc]
                doc, h, rank = doc[inside], h[inside], rank[inside]
                held.append((h, classes[doc], sizes[doc].astype(np.uint32), rank.astype(np.uint32), match[doc].astype(np.uint8)))
                size += len(h)
                if size > POSTINGS_AT_ONCE:
                    yield message(held)
                    held, size = [], 0
        if held:
            yield message(held)

    return post


FIELDS = ("token", "cls", "size", "rank", "need")
KINDS = (U64, np.int64, np.uint32, np.uint32, np.uint8)
LIST = "shard int, token binary, cls binary, size binary, rank binary, need binary"


def _read(table: pa.Table) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x, kind) for x in table.column(f).to_pylist()] or [np.zeros(0, kind)]).astype(kind if kind is U64 else np.int64) for f, kind in zip(FIELDS, KINDS, strict=True)]


def _shared(percent: int):
    """Of a shard's postings the lists of two classes or more, sorted by shingle and size, a class once."""

    def lists(table: pa.Table) -> pa.Table:
        token, cls, size, rank, need = _read(table)
        order = np.lexsort((cls, size, token))
        token, cls, size, rank, need = (c[order] for c in (token, cls, size, rank, need))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls, size, rank, need = (c[new] for c in (token, cls, size, rank, need))
        several = np.zeros(len(token), bool)
        several[1:] = token[1:] == token[:-1]
        several[:-1] |= several[1:]
        columns = [c[several].astype(k) for c, k in zip((token, cls, size, rank, need), KINDS, strict=True)]
        return pa.table({"shard": table.column("shard")[:1], **{f: pa.array([blob(c)], pa.binary()) for f, c in zip(FIELDS, columns, strict=True)}})

    return lists


def _bounds(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each list."""
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(token)))


def _pairs(a, b, need) -> pa.RecordBatch:
    """Distinct pairs with the number of times they were listed."""
    if len(a):
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(a)))
        a, b, need = a[at], b[at], need[at]
    else:
        n = np.zeros(0, np.int64)
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "need": pa.array(need, pa.int32()), "n": pa.array(n, pa.int32())})


def _within(bound: Overlap, token, cls, size, rank, need):
    """Feasible pairs of members of the same list, one of SHORT_LIST members at most."""
    out = [(np.zeros(0, np.int64),) * 3]
    for d in range(1, SHORT_LIST):
        i = np.flatnonzero(token[d:] == token[:-d])
        j = i + d
        ok = bound.feasible(size[i], rank[i], need[i], rank[i], size[j], rank[j], rank[j])
        i, j = i[ok], j[ok]
        out.append((cls[i], cls[j], np.minimum(need[i], need[j])))
    return _pairs(*(np.concatenate(c) for c in zip(*out, strict=True)))


def _first_pairs(percent: int):
    """All pairs of short lists; of long ones the stars around their two most central members, marked by need 0."""
    bound = Overlap(percent)

    def pairs(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                token, cls, size, rank, need = _read(pa.Table.from_batches([batch.slice(r, 1)]))
                start, length = _bounds(token)
                short = np.repeat(length <= SHORT_LIST, length)
                yield _within(bound, *(c[short] for c in (token, cls, size, rank, need)))
                for s, n in zip(start[length > SHORT_LIST], length[length > SHORT_LIST], strict=True):
                    part = slice(s, s + n)
                    hubs = np.lexsort((cls[part], rank[part]))[:2]
                    for hub in hubs:
                        other = np.delete(np.arange(n), hub)
                        low, high = np.minimum(other, hub), np.maximum(other, hub)
                        c, z, p, m = cls[part], size[part], rank[part], need[part]
                        ok = bound.feasible(z[low], p[low], m[low], p[low], z[high], p[high], p[high])
                        yield _pairs(c[low[ok]], c[high[ok]], np.zeros(int(ok.sum()), np.int64))

    return pairs


def _rows(batches):
    """Every posting of the shared lists, with the length of its list."""
    for batch in batches:
        for r in range(batch.num_rows):
            token, cls, size, rank, need = _read(pa.Table.from_batches([batch.slice(r, 1)]))
            _, length = _bounds(token)
            yield pa.RecordBatch.from_arrays([pa.array(signed(token)), *(pa.array(c, pa.int64()) for c in (cls, size, rank, need, np.repeat(length, length)))], ["token", "node", "size", "rank", "need", "length"])


def _cell_counts(h: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of CELLS cells; empty if the set is too large for the counters."""
    if len(h) > COUNTED:
        return b""
    return blob(np.bincount((h >> U64(20)).astype(np.int64) & (CELLS - 1), minlength=CELLS).astype(np.uint16))


def _fetch(k: int, wanted: bytes, form: Callable[[np.ndarray], bytes]):
    def fetch(batches):
        bits = np.unpackbits(np.frombuffer(wanted, np.uint8))
        seen: set[int] = set()
        for batch in batches:
            found = []
            for _, doc, h, sizes in _sets(batch.column(0), k):
                classes = _classes(doc, h, sizes)
                ends = np.cumsum(sizes)
                for d in np.flatnonzero(maybe_in(bits, classes.view(U64)) & (sizes > 0)):
                    if (c := int(classes[d])) not in seen:
                        seen.add(c)
                        found.append((c, form(h[ends[d] - sizes[d] : ends[d]])))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["cls", "members"])

    return fetch


def _members(column: pa.Array):
    """The elements of sets that are blobs of sorted hashes, as exact_links reads them."""
    sets = [np.frombuffer(x, U64) for x in column.to_pylist()]
    n = np.array([len(x) for x in sets], np.int64)
    yield 0, np.repeat(np.arange(len(sets)), n), np.concatenate([*sets, np.zeros(0, U64)]), n


def _similar(left: list[bytes], right: list[bytes], percent: int) -> np.ndarray:
    """Is each pair of sets linked?"""
    keep = np.zeros(len(left), bool)
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        a, b = np.frombuffer(x, U64), np.frombuffer(y, U64)
        if len(a) > len(b):
            a, b = b, a
        place = np.minimum(np.searchsorted(b, a), len(b) - 1)
        common = int((b[place] == a).sum())
        keep[i] = 100 * common >= percent * (len(a) + len(b) - common)
    return keep


def _may_link(left: list[bytes], right: list[bytes], percent: int) -> np.ndarray:
    """Can each pair of sets be linked, by their counts? Two sets share at most the lesser count of each cell."""
    keep = np.ones(len(left), bool)
    known = np.array([len(x) > 0 and len(y) > 0 for x, y in zip(left, right, strict=True)], bool)
    if known.any():
        a, b = (np.frombuffer(b"".join(x for x, ok in zip(side, known, strict=True) if ok), np.uint16).reshape(-1, CELLS).astype(np.int64) for side in (left, right))
        keep[known] = np.minimum(a, b).sum(1) >= Overlap(percent).pair(a.sum(1), b.sum(1))
    return keep


def _verify(percent: int, similar: Similar):
    def verify(batches):
        for batch in batches:
            keep = similar(batch.column(2).to_pylist(), batch.column(3).to_pylist(), percent)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep))

    return verify


def _sets_of(wanted: DataFrame, text: DataFrame, k: int, form: Callable[[np.ndarray], bytes] = blob) -> DataFrame:
    """(cls, members) of the wanted classes, which one more scan of the texts brings. wanted: cls, distinct."""
    sets = text.mapInArrow(_fetch(k, bloom(wanted, "cls"), form), "cls long, members binary")
    return sets.join(wanted, "cls", "left_semi").dropDuplicates(["cls"])


def _similar_pairs(pairs: DataFrame, text: DataFrame, k: int, percent: int, form: Callable[[np.ndarray], bytes], similar: Similar) -> DataFrame:
    sets = _sets_of(saved(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()), text, k, form)
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    return saved(both.select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent, similar), "a long, b long"))


def _links(pairs: DataFrame, text: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the whole sets of their classes; only sets are sent whose counts allow a link."""
    possible = _similar_pairs(saved(pairs.select("a", "b")), text, k, percent, _cell_counts, _may_link)
    return _similar_pairs(possible, text, k, percent, blob, _similar)


def jaccard_classes(docs: DataFrame, k: int, percent: int, id_type: str = "long") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, cls) of each document, and (node, root) of the classes that have links. docs: doc_id, text."""
    small_batches(docs.sparkSession)
    described = docs.mapInArrow(_describe(k), f"doc_id {id_type}, n_shingles long, cls long")
    shards = pieces(docs)
    text = docs.select("text")
    counts = key_counts(text, lambda batch: (h for _, _, h, _ in _sets(batch.column(0), k)), SKETCH)
    lists = text.mapInArrow(_postings(k, percent, estimates(counts), shards), LIST).groupBy("shard").applyInArrow(_shared(percent), LIST)
    lists = saved(lists)
    pairs = saved(lists.mapInArrow(_first_pairs(percent), PAIR).groupBy("a", "b").agg(F.max("need").alias("need"), F.min("need").alias("star"), F.sum("n").alias("n")))
    # of the shingles before a posting, only those that another set has posted too can be in both sets of a pair
    before = F.row_number().over(Window.partitionBy("node").orderBy("rank")).cast("long") - 1
    long = lists.mapInArrow(_rows, "token long, node long, size long, rank long, need long, length long").withColumn("before", before)
    long = saved(long.where(F.col("length") > SHORT_LIST).drop("length"))
    # n counts stars as well; a pair that shares too little in short lists can only link by a long one
    first = _links(pairs.where((F.col("star") == 0) | (F.col("n") >= F.col("need"))), text, k, percent)
    roots = components(first)
    if long.isEmpty():
        return described, roots
    rooted = long.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # a pair not verified yet shares fewer than it needs in short lists, and the rest at places of long ones where both fit
    sides = pairs.where((F.col("star") > 0) & (F.col("n") < F.col("need"))).select(F.explode(F.array("a", "b")).alias("node"), "n")
    short = sides.groupBy("node").agg(F.max("n").alias("short"))
    left = partner_counts(cells_of(rooted), percent).join(short, "node", "left")
    left = saved(left.where(F.col("shared") + F.coalesce("short", F.lit(0)) >= F.col("need")).select("node"))
    if left.isEmpty():
        return described, roots
    left = left.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sets = left.join(_sets_of(left.select(F.col("node").alias("cls")), text, k).toDF("node", "value"), "node")
    return described, components(first.union(exact_links(saved(sets), percent, _members, _similar)))


def jaccard_components(df: DataFrame, k: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and component (its key; null for an empty set): one row a document."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    described, roots = jaccard_classes(docs, k, percent)
    described = saved(described)
    full, empty = described.where("n_shingles > 0"), described.where("n_shingles = 0")
    least = full.groupBy("cls").agg(F.min("doc_id").alias("low")).join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = saved(least)
    ids = least.select("cls", "root").join(least.groupBy("root").agg(F.min("low").alias("component_id")), "root")
    found = full.join(ids, "cls").select("doc_id", "n_shingles", "component_id", F.col("root").alias("component"))
    return found.union(empty.select("doc_id", "n_shingles", "doc_id", F.lit(None).cast("long")))


def one_per_component(df: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one document of each component: the smallest by id (null last), then by a hash of its text.

    Rows that agree in id and text are one document. Documents without words all stay.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    key = [F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(t).alias("th")]
    described, roots = jaccard_classes(df.select(F.struct(*key).alias("doc_id"), t.alias("text")), k, percent, "struct<id:bigint,th:bigint>")
    described = saved(described)
    least = described.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("low")).join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    keepers = least.groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("low").alias("low")).select("low.id", "low.th")
    empty = described.where("n_shingles = 0").select("doc_id.id", "doc_id.th").distinct()
    named = df.select(*key, whole_row(df))
    kept = named.join(keepers, ["id", "th"]).dropDuplicates(["id", "th"])
    return kept.unionByName(named.join(empty, ["id", "th"], "left_semi")).select("row.*")
