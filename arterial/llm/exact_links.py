"""Exact links between sets that candidate search has left in different components.

Two linked sets share one of their rarest elements, so sets of different components meet
at each such element, agree in size and place there, and are verified in the task that
lists them, which only returns links. An element of many sets is dealt out in blocks, so
no list has to fit one task, and a task joins components as it finds links: pairs that
are connected already aren't compared again. Elements whose lists begin with the same set
go to the same task, so copies that share many elements are sent and compared once.
Elements are ordered by a sketch of fixed
size of how frequent they are; it steers costs only, any order gives the same links.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import U64, signed
from .sketches import key_counts
from .storage import saved

SKETCH = 1 << 21
BLOCK = 512  # sets with an element that meet in one cell
CELL_ROWS = 1 << 17  # of cells that one task holds, about
CELL_BYTES = 1 << 26  # of the sets that it holds, about
MOST_PAIRS = 1 << 12  # compared at once
#: For a column of values: first row, row and hash of each distinct element, sorted by both, and set sizes, slice by slice.
Sets = Callable[[pa.Array], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]
#: Is each pair of values linked?
Similar = Callable[[list[bytes], list[bytes], int], np.ndarray]


class Overlap:
    """Integer bounds of the Jaccard threshold percent / 100."""

    def __init__(self, percent: int):
        self.p = percent

    def pair(self, x, y):
        """The least intersection of linked sets of these sizes."""
        return -(-self.p * (x + y) // (100 + self.p))

    def any(self, x):
        """The least intersection of a set of this size with any set."""
        return -(-self.p * x // 100)

    def probe(self, x, match):
        return x - self.any(x) + match

    def index(self, x, match):
        return x - self.pair(x, x) + match

    def feasible(self, x_size, x_rank, x_need, x_before, y_size, y_rank, y_before):
        """Can a smaller set x and a larger y, both with an element at these ranks, be linked, and is x's in its index prefix?

        before: how many earlier elements of a set may be in the other at all. The order is
        global, so common ones before this one stand in both prefixes, and only posted
        elements that another set posted too count.
        """
        least = self.pair(x_size, y_size)
        most = np.minimum(x_before, y_before) + np.minimum(x_size - x_rank, y_size - y_rank)
        return (x_rank < self.index(x_size, x_need)) & (100 * x_size >= self.p * y_size) & (most >= least)


def estimates(counts: np.ndarray) -> np.ndarray:
    """The sketch as one byte a counter: 4 * log2 of the count above what chance collisions explain."""
    mean = counts.sum() / len(counts)
    excess = np.maximum(counts.astype(np.float64) - (mean + 5 * mean**0.5 + 4), 0)
    return np.minimum(np.ceil(4 * np.log2(1 + excess)), 255).astype(np.uint8)


def _rarest(sets: Sets, percent: int, counts: np.ndarray):
    """A row for each element that a set can share first with a linked one: rare ones by the sketch come first, what occurs once is left out."""
    bound, sketch, several = Overlap(percent), estimates(counts), counts > 1

    def rarest(batches):
        for batch in batches:
            for i, row, h, n in sets(batch.column(2)):
                order = np.lexsort((h, sketch[(h & U64(SKETCH - 1)).astype(np.int64)], row))
                rank = np.arange(len(h)) - (np.cumsum(n) - n)[row]
                h = h[order]
                inside = (rank < bound.probe(n, 1)[row]) & several[(h & U64(SKETCH - 1)).astype(np.int64)]
                row, h, rank = row[inside], h[inside], rank[inside]
                at = pa.array(row + i)
                columns = [pa.array(signed(h)), batch.column(0).take(at), batch.column(1).take(at), pa.array(n[row]), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns, ["token", "node", "root", "size", "rank"])

    return rarest


class _Cells:
    """The rows of some cells, sorted by cell and size, with their sets and components numbered."""

    def __init__(self, table: pa.Table, percent: int):
        columns = [table.column(c).to_numpy() for c in ("token", "node", "root", "size", "rank", "need", "before", "part", "low", "high")]
        token, node, _, size, *_, low, high = columns
        order = np.lexsort((node, size, high, low, token))
        token, node, root, self.size, self.rank, self.need, self.before, self.part, self.low, self.high = (c[order] for c in columns)
        self.token = token
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (self.low[1:] != self.low[:-1]) | (self.high[1:] != self.high[:-1])
        self.end = np.append(np.flatnonzero(new)[1:], len(token))[np.cumsum(new) - 1]
        self.nodes, once, self.node = np.unique(node, return_index=True, return_inverse=True)
        roots, self.of_node = np.unique(root[once], return_inverse=True)
        self.up, self.bound = np.arange(len(roots)), Overlap(percent)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of sets that meet in a cell, lie in different components so far and can be linked, distance by distance."""
        i, d = np.arange(len(self.node)), 0
        while True:
            d += 1
            i = i[i + d < self.end[i]]
            if not len(i):
                return
            j = i + d
            ok = (self.up[self.of_node[self.node[i]]] != self.up[self.of_node[self.node[j]]]) & ((self.low[i] == self.high[i]) | (self.part[i] != self.part[j]))
            x, y = i[ok], j[ok]
            ok = self.bound.feasible(self.size[x], self.rank[x], self.need[x], self.before[x], self.size[y], self.rank[y], self.before[y])
            yield x[ok], y[ok]


def _with_partners(percent: int):
    """The sets that some other one of their cells may be linked with; of all others the elements needn't be sent."""

    def find(cells: pa.Table) -> pa.Table:
        x = _Cells(cells, percent)
        found = np.zeros(len(x.nodes), bool)
        for a, b in x.pairs():
            found[x.node[a]] = found[x.node[b]] = True
        return pa.table({"shard": pa.array([cells.column("shard")[0].as_py()] * int(found.sum()), pa.int64()), "node": pa.array(x.nodes[found], pa.int64())})

    return find


def _partner_needs(percent: int):
    """The elements at which a set may be linked with one of another component, and the least number of elements that a partner there asks for."""
    most = np.iinfo(np.int64).max

    def find(cells: pa.Table) -> pa.Table:
        x = _Cells(cells, percent)
        least = np.full(len(x.node), most)
        for i, j in x.pairs():
            need = np.minimum(x.need[i], x.need[j])
            np.minimum.at(least, i, need)
            np.minimum.at(least, j, need)
        found = least < most
        return pa.table({"token": pa.array(x.token[found], pa.int64()), "node": pa.array(x.nodes[x.node[found]], pa.int64()), "need": pa.array(least[found], pa.int64())})

    return find


def _cross_links(similar: Similar, percent: int):
    """Links between the sets of a cell that lie in different components; those that the links found before connect are left out."""

    def cross(cells: pa.Table, values: pa.Table) -> pa.Table:
        x = _Cells(cells, percent)
        value = dict(zip(values.column("key").to_pylist(), values.column("value").to_pylist(), strict=True))
        seen, waiting, links = np.zeros(0, np.int64), [], []

        def settle() -> None:
            nonlocal seen
            pairs = np.setdiff1d(np.concatenate(waiting), seen) if waiting else seen[:0]
            for at in range(0, len(pairs), MOST_PAIRS):
                a, b = np.divmod(pairs[at : at + MOST_PAIRS], len(x.nodes))
                apart = x.up[x.of_node[a]] != x.up[x.of_node[b]]
                a, b = a[apart], b[apart]
                linked = similar([value[k] for k in x.nodes[a].tolist()], [value[k] for k in x.nodes[b].tolist()], percent)
                for i, j in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
                    p, q = int(x.of_node[i]), int(x.of_node[j])
                    while x.up[p] != p:
                        p = int(x.up[p])
                    while x.up[q] != q:
                        q = int(x.up[q])
                    if p != q:
                        x.up[max(p, q)] = min(p, q)
                        links.append((x.nodes[i], x.nodes[j]))
                while (jumped := x.up[x.up]).tobytes() != x.up.tobytes():
                    x.up = jumped
            seen = np.union1d(seen, pairs) if len(seen) < 1 << 22 else pairs
            waiting.clear()

        for i, j in x.pairs() if len(value) else ():
            a, b = x.node[i], x.node[j]
            waiting.append(np.minimum(a, b) * len(x.nodes) + np.maximum(a, b))
            if sum(map(len, waiting)) > 1 << 16:
                settle()
        settle()
        return pa.table({"a": pa.array([int(i) for i, _ in links], pa.int64()), "b": pa.array([int(j) for _, j in links], pa.int64())})

    return cross


def cells_of(posted: DataFrame) -> DataFrame:
    """The cells, dealt to shards, of the elements that lie in several components. posted: token, node, root, size, rank; perhaps need (else 1) and before."""
    shared = posted.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count("*") / BLOCK).alias("blocks"), F.min(F.xxhash64("node")).alias("family")).where("x <> y").select("token", "blocks", "family")
    cells = posted.join(shared, "token").withColumn("part", F.expr("pmod(xxhash64(node), blocks)"))
    if "need" not in posted.columns:
        cells = cells.withColumn("need", F.lit(1).cast("long"))
    if "before" not in posted.columns:
        cells = cells.withColumn("before", F.row_number().over(Window.partitionBy("node").orderBy("rank")).cast("long") - 1)
    cells = cells.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("blocks", "other")
    cells = saved(cells)
    rows, elements = cells.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n = max(int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // CELL_ROWS, 8 * elements // CELL_BYTES)
    return cells.withColumn("shard", F.pmod(F.xxhash64("family", "low", "high"), F.lit(n)))


def with_partners(cells: DataFrame, percent: int) -> DataFrame:
    """(shard, node) of the sets that another one of their cell and of another component may be linked with."""
    return cells.groupBy("shard").applyInArrow(_with_partners(percent), "shard long, node long")


def partner_counts(cells: DataFrame, percent: int) -> DataFrame:
    """(node, shared, need): at how many elements a set may be linked with one of another component, and how many a partner asks for at least."""
    found = cells.groupBy("shard").applyInArrow(_partner_needs(percent), "token long, node long, need long")
    return found.groupBy("node", "token").agg(F.min("need").alias("need")).groupBy("node").agg(F.count("*").alias("shared"), F.min("need").alias("need"))


def exact_links(nodes: DataFrame, percent: int, sets: Sets, similar: Similar) -> DataFrame:
    """Links (a, b) that connect all sets of different components with a similarity of percent. nodes: node, root, value; a node once."""
    nodes = nodes.select("node", "root", "value")
    counts = key_counts(nodes.select("value"), lambda batch: (h for _, _, h, _ in sets(batch.column(0))), SKETCH)
    cells = cells_of(saved(nodes.mapInArrow(_rarest(sets, percent, counts), "token long, node long, root long, size long, rank long")))
    values = with_partners(cells, percent).join(nodes.select("node", "value"), "node").toDF("key", "of", "value")
    return saved(cells.groupBy("shard").cogroup(values.groupBy("of")).applyInArrow(_cross_links(similar, percent), "a long, b long"))
