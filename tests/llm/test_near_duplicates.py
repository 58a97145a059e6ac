import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from arterial.llm import exact_links, line_dedup, ngram_join
from arterial.llm.components import components
from arterial.llm.line_dedup import dedup_lines, shingles, signatures, similarities
from arterial.llm.ngram_join import jaccard_components, one_per_component

from .cases import SCHEMA, awkward, frame, key, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute_components(rows, k, percent):
    sets = []
    for r in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = roots(len(rows), links)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None)))
    return sorted(out, key=key)


def near_copies(n, words, edits, seed, first_id):
    r = random.Random(seed)
    base = prose(seed, words).split()
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"edit{r.random()}"
        rows.append((first_id + i, " ".join(w), "en", "s", 1))
    return rows


@pytest.mark.parametrize("percent", [50, 85])
def test_components_against_brute_force(spark, percent):
    rows = awkward() + near_copies(60, 100, 5, 77, 1000) + near_copies(40, 30, 2, 78, 2000) + near_copies(9, 300, 12, 79, 3000)
    got = sorted((tuple(r)[:3] for r in jaccard_components(frame(spark, rows), 4, percent).collect()), key=key)
    assert got == brute_components(rows, 4, percent)


@pytest.mark.parametrize("block", [exact_links.BLOCK, 9])
def test_one_large_group_of_near_copies(spark, monkeypatch, block):
    """Copies of one text with own edits: most pairs share their rarest shingles, some link, many don't."""
    monkeypatch.setattr(exact_links, "BLOCK", block)
    rows = near_copies(300, 120, 9, 91, 1000) + near_copies(150, 120, 2, 92, 2000)
    got = sorted((tuple(r)[:3] for r in jaccard_components(frame(spark, rows)).collect()), key=key)
    want = brute_components(rows, 4, 85)
    assert got == want and 2 < len({w[2] for w in want}) < 300


def test_components_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r)[:3] for r in jaccard_components(docs).collect()), key=key)
    assert got == brute_components(rows, 4, 85)


def test_frequent_shingles_ask_for_longer_prefixes():
    import numpy as np

    bound = ngram_join.Overlap(85)
    rare, frequent = np.zeros(200, np.uint8), np.full(200, 40, np.uint8)
    chosen = ngram_join.choose_match(np.concatenate([rare, frequent]), np.array([0, 200]), np.array([200, 200]), bound)
    assert chosen[0] == 1 and chosen[1] > 1


def test_counts_by_cells_lose_no_link():
    import numpy as np

    r, linked, passed = np.random.default_rng(1), 0, 0
    for _ in range(1000):
        n = int(r.integers(1, 900))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([r.permutation(a)[: int(n * r.uniform(0.5, 1))], r.integers(0, 2**63, n // 9).astype(np.uint64)]))
        may = ngram_join._may_link([ngram_join._cell_counts(a), b""], [ngram_join._cell_counts(b), b"x"], 85)
        does = ngram_join._similar([a.tobytes()], [b.tobytes()], 85)[0]
        assert may[1] and (may[0] or not does)
        linked, passed = linked + does, passed + may[0]
    assert 0 < linked <= passed < 900


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("finish", [2_000_000, 20])
def test_components_of_paths_stars_and_cliques(spark, finish):
    links = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 700)] + [(800 + i, 800 + j) for i in range(8) for j in range(i)] + [(900, 900), (None, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), finish).collect()}
    groups = [range(201), range(500, 700), range(800, 808)]
    assert set(got) == {x for g in groups for x in g}
    assert all(len({got[x] for x in g}) == 1 for g in groups) and len({got[g[0]] for g in groups}) == 3


def test_one_document_of_each_component_stays(spark):
    rows = awkward() + near_copies(60, 100, 5, 77, 1000)
    left = one_per_component(frame(spark, rows), 4, 85).collect()
    parts = {}
    for (i, n, c), r in zip(brute_components(rows, 4, 85), sorted(rows, key=key), strict=True):
        parts.setdefault((c, r[1] if c is None else "") if n else None, []).append(i)
    assert sorted(str(r.doc_id) for r in left if WORD.findall(r.text or "")) == sorted(str(min(v, key=lambda x: (x is None, x))) for k, v in parts.items() if k)
    assert sum(not WORD.findall(r.text or "") for r in left) == len(parts[None])


def brute_lines(rows, percent):
    """doc_id, lines, removed and the text of each row, by comparing all lines."""
    lower = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    occurrences = []
    for d, r in enumerate(rows):
        for i, x in enumerate((r[1] or "").split("\n")):
            if WORD.search(x):
                x = lower(x)
                shingles = {x[j : j + 10] for j in range(len(x) - 9)} or {x}
                occurrences.append(((r[0] if r[0] is not None else 1 << 63, r[1]), i, d, shingles))
    links = [(i, j) for i, a in enumerate(occurrences) for j, b in enumerate(occurrences[:i]) if 100 * len(a[3] & b[3]) >= percent * len(a[3] | b[3])]
    root = roots(len(occurrences), links)
    first = {}
    for o, r in sorted(zip(occurrences, root, strict=True), key=lambda x: (x[0][0][0], x[0][1])):
        first.setdefault(r, o[:2])
    gone = {}
    for o, r in zip(occurrences, root, strict=True):
        if first[r] != o[:2]:
            gone.setdefault(o[2], set()).add(o[1])
    out = []
    for d, r in enumerate(rows):
        lines = (r[1] or "").split("\n")
        out.append((r[0], sum(bool(WORD.search(x)) for x in lines), len(gone.get(d, ())), "\n".join(x for i, x in enumerate(lines) if i not in gone.get(d, ()))))
    return sorted(out, key=key)


def line_rows():
    r = random.Random(4)
    base = [prose(300 + i, 25) for i in range(6)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(r.randrange(1, 6)):
            w = r.choice(base).split()
            if r.random() < 0.7:
                w[r.randrange(len(w))] = f"e{r.random()}"
            lines.append(" ".join(w) if r.random() < 0.8 else prose(r.randrange(10**6), 20))
        rows.append((5000 + d, "\n".join([*lines, "", "tail"]), "en", "s", 1))
    return rows


def test_lines_against_brute_force(spark):
    rows = awkward() + line_rows()
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text or "") for r in dedup_lines(frame(spark, rows)).collect()), key=key)
    want = brute_lines(rows, 80)
    assert [g[:3] for g in got] == [w[:3] for w in want] and got == want


def family_rows():
    """A notice with own tails, at 0.7 to each other, of which some have a copy at 0.85 to 0.9."""
    r = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz "
    head = "".join(r.choice(letters) for _ in range(250))
    tails = ["".join(r.choice(letters) for _ in range(52)) for _ in range(500)]
    lines = [head + t for t in tails] + [head + t[:32] + "".join(r.choice(letters) for _ in range(20)) for t in tails[:120]]
    r.shuffle(lines)
    return [(8000 + i, "\n".join(lines[i : i + 10]), "en", "s", 1) for i in range(0, len(lines), 10)]


def test_pairs_in_a_family_of_similar_lines(spark, monkeypatch):
    rows = family_rows()
    want = brute_lines(rows, 80)
    assert 110 < sum(w[2] for w in want) < 130
    for block in (exact_links.BLOCK, 7):
        monkeypatch.setattr(exact_links, "BLOCK", block)
        got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text or "") for r in dedup_lines(frame(spark, rows)).collect()), key=key)
        assert got == want


def test_line_similarity_is_exact():
    import numpy as np

    a, b = "the quick brown fox jumps över the lazy dog", "the quick brown fox jumps över the lazy cat"
    pairs = [(a, b), (a, a), ("short", "short"), ("short", "other"), (a, "short")]
    both, either = similarities([x.encode() for x, _ in pairs], [y.encode() for _, y in pairs])
    for (x, y), n, m in zip(pairs, both, either, strict=True):
        s, t = ({z[i : i + 10] for i in range(len(z) - 9)} or {z} for z in (x, y))
        assert (n, m) == (len(s & t), len(s | t))
    h, n = shingles(np.frombuffer((a + b).encode(), np.uint8), np.array([0, len(a.encode())]), np.array([len(a.encode()), len((a + b).encode())]))
    assert signatures(h, n).shape == (2, 12)


def test_a_line_of_many_pairs_is_cut_into_shingles_once(monkeypatch):
    hub, others = prose(1, 20).encode(), [prose(i, 20).encode() for i in range(2, 102)] + [prose(1, 20).encode()[:-4] + b"abcd", prose(3, 5).encode()]
    seen = []
    monkeypatch.setattr(line_dedup, "shingles", lambda data, s, e, f=line_dedup.shingles: (seen.append(len(s)), f(data, s, e))[1])
    both, either = similarities([hub] * len(others), others)
    assert sum(seen) == len(others) + 1
    near, either_near = similarities([hub] * len(others), others, 80)
    assert (either >= either_near).any() and near[100] == both[100] > 0.8 * either[100]
    assert (line_dedup._similar([hub] * len(others), others, 80) == (100 * both >= 80 * either)).all()


def test_lines_are_cut_into_shingles_some_kilobytes_at_once(monkeypatch):
    seen = []
    monkeypatch.setattr(line_dedup, "shingles", lambda data, s, e, f=line_dedup.shingles: (seen.append(len(data)), f(data, s, e))[1])
    lines = [prose(i, 60) for i in range(1000)]
    sent = list(line_dedup._band_keys(1)([pa.RecordBatch.from_arrays([pa.array(["\n".join(lines)])], ["text"])]))
    assert sum(len(x.as_py()) for batch in sent for x in batch.column(1)) == 4 * 12 * len(lines)
    assert len(seen) > 1 and max(seen) < 1 << 16
    seen.clear()
    line_dedup._similar([x.encode() for x in lines[:500]], [x.encode() for x in lines[500:]], 80)
    assert len(seen) > 1 and max(seen) < 1 << 16


def test_bands_of_a_line_do_not_depend_on_what_stands_beside_it(monkeypatch):
    lines = ["über den Fluß " * 3, "short", "plain words of ascii only", "ab\U0001f600" * 9, "\U0001f601b\U0001f600" * 9, "€", "x" * 300, "Ελληνικά γράμματα εδώ"]
    alone = [signatures(*shingles(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x.encode())])))[0].tolist() for x in lines]
    assert len({tuple(x) for x in alone}) == len(lines)
    data = "\n\n".join(lines).encode()
    starts = np.cumsum([0, *(len(x.encode()) + 2 for x in lines[:-1])])
    for limit in (1, 40, 1 << 15):
        monkeypatch.setattr(line_dedup, "BYTES_AT_ONCE", limit)
        together = line_dedup.line_signatures(np.frombuffer(data, np.uint8), starts, starts + [len(x.encode()) for x in lines])
        assert together.tolist() == alone


def test_shingles_are_told_apart_by_all_their_characters():
    rng, hash_of = random.Random(4), {}
    for alphabet in ("ab", "aé", "a€é", "a\U0001f600\uf600", "\U0001f600\U0001f601b"):
        text = "".join(rng.choices(alphabet, k=5000))
        h, n = shingles(np.frombuffer(text.encode(), np.uint8), np.array([0]), np.array([len(text.encode())]))
        assert n.tolist() == [len(h)] == [len(text) - 9]
        for i, x in enumerate(h.tolist()):
            assert hash_of.setdefault(text[i : i + 10], x) == x
    assert len(set(hash_of.values())) == len(hash_of)


def test_a_task_sends_two_places_of_a_line_at_most(monkeypatch):
    rng = random.Random(6)
    places = [(rng.randrange(-5, 40), rng.randrange(-9, 9), rng.randrange(50), rng.choice((3, 1 << 63, (1 << 64) - 1, 77 << 40, rng.getrandbits(64)))) for _ in range(3000)]
    kinds = (np.int64, np.int64, np.int32, np.uint64)
    rows = [[np.array(c, kind).tobytes() for c, kind in zip(zip(*places[i : i + 100], strict=True), kinds, strict=True)] for i in range(0, 3000, 100)]
    batches = [pa.RecordBatch.from_arrays([pa.array([row[c]], pa.binary()) for c in range(4)], ["ids", "hashes", "numbers", "keys"]) for row in rows]
    roots = {line_dedup.signed(np.array([k], np.uint64))[0].item(): 5 for k in (3, places[0][3])}
    want = {}
    for *place, key in places:
        want.setdefault(line_dedup.signed(np.array([key], np.uint64))[0].item(), set()).add(tuple(place))
    want = {(k, roots.get(k, k), *min(v), *max(v)) for k, v in want.items() if len(v) > 1 or k in roots}
    for limit in (1 << 18, 500):
        monkeypatch.setattr(line_dedup, "PLACES_AT_ONCE", limit)
        sent = list(line_dedup._ends(4)(iter(batches)))
        assert sum(len(x.as_py()) for b in sent for x in b.column("keys")) <= 8 * (sum(len(set(p[3] for p in places[i : i + 600])) for i in range(0, 3000, 600)) + 4 * 6)
        table, found = pa.Table.from_batches(sent), []
        for shard in range(4):
            part = table.filter(pa.compute.equal(table.column("shard"), shard))
            of = [k for k in roots if (k % (1 << 64) >> 32) * 4 >> 32 == shard]
            found += [tuple(r.values()) for r in line_dedup._repeated(part, pa.table({"node": pa.array(of, pa.int64()), "root": pa.array([5] * len(of), pa.int64())})).to_pylist()]
        assert len(found) == len(want) and set(found) == want


def test_lines_that_begin_with_white_space():
    rng = random.Random(8)
    for _ in range(300):
        texts = ["".join(rng.choices(" \t\nab", (4, 1, 2, 1, 1), k=rng.randrange(12))) for _ in range(6)] + ["x" * rng.randrange(200)]
        rng.shuffle(texts)
        data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
        found = [bytes(data[s:e]).decode() for s, e in zip(*line_dedup.line_bounds(data, off)[:2], strict=True)]
        assert found == [line for t in texts for line in t.split("\n") if line.strip(" \t")]


def test_no_lines(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, "a\na", 7, "x")], "doc_id long, text string, n_lines long, root string")
    assert [tuple(r) for r in dedup_lines(clash).collect()] == [(1, "a", "x", 2, 1)]
