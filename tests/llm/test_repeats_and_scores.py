import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from arterial.llm.kernels import U64, span_hashes, utf8, word_bounds
from arterial.llm.lm_scoring import lm_scores
from arterial.llm.substring_dedup import Symbols, remove_repeats, rounds_for

from .cases import SCHEMA, awkward, frame, key, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_match_the_pattern():
    import pyarrow as pa

    texts = [r[1] for r in awkward()]
    data, off = utf8(pa.array(texts))
    s, e, first = word_bounds(data, off)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)] == [w for t in texts for w in WORD.findall(t or "")]
    assert list(np.diff(first)) == [len(WORD.findall(t or "")) for t in texts]
    h = span_hashes(data, s, e)
    words = [w for t in texts for w in WORD.findall(t or "")]
    assert len(set(h.tolist())) == len(set(words)) == len(set(zip(h.tolist(), words)))


def brute_repeats(rows, window):
    docs = [(r[0] if r[0] is not None else 1 << 62, WORD.findall(r[1] or ""), r[0]) for r in rows]
    least = {}
    for i, words, _ in docs:
        for j in range(len(words) - window + 1):
            g = tuple(words[j : j + window])
            least[g] = min(i, least.get(g, i))
    out = []
    for i, words, real in docs:
        gone = set()
        for j in range(len(words) - window + 1):
            if least[tuple(words[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((real, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=key)


def ours(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in df.collect()), key=key)


@pytest.mark.parametrize("window", [12, 50])
def test_repeats_against_brute_force(spark, window):
    rows = awkward()
    assert ours(remove_repeats(frame(spark, rows), window)) == brute_repeats(rows, window)


def test_repeats_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert ours(remove_repeats(docs)) == brute_repeats(rows, 50)


def test_margin_holds_for_random_surroundings():
    """Symbols between a window's margins are the same whatever surrounds it, also if others have lost their names."""
    rng = np.random.default_rng(0)
    for window in (12, 50):
        for _ in range(60):
            alphabet = rng.integers(2, 30)
            inside = rng.integers(0, alphabet, window).astype(U64)
            seen = []
            for _ in range(2):
                left, right = (rng.integers(0, alphabet, rng.integers(0, 40)).astype(U64) for _ in range(2))
                x, covers = Symbols(np.concatenate([left, inside, right]), np.array([0, len(left) + window + len(right)])), []
                for pairings, margin in rounds_for(window):
                    x.pair(pairings)
                    covers.append(np.repeat(x.names, x.sizes)[len(left) + margin : len(left) + window - margin].tolist())
                    begin = x.starts()
                    outside = (begin + x.sizes <= len(left) + margin) | (begin >= len(left) + window - margin)
                    x.live &= ~outside | (rng.random(len(outside)) < 0.5)
                seen.append(covers)
            assert seen[0] == seen[1] and seen[0][-1]


def test_rounds_send_less_and_less(spark):
    """Without repeats no window is left to verify."""
    import pyarrow as pa

    from arterial.llm import substring_dedup as sd

    texts = [prose(500 + i, 400, 60) for i in range(30)] + [prose(500, 400, 60)[-500:] + prose(900, 100, 60)]
    docs, rounds = pa.table({"doc_id": range(len(texts)), "text": texts, "g": pa.array([0] * len(texts), pa.int32())}), rounds_for(50)
    answers, left = pa.table({"round": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "named": pa.array([], pa.binary())}), []
    for k in range(len(rounds)):
        asked = sd._send_symbols(k, rounds, 50, 4)(docs, answers)
        left.append(len(sd._Round(docs, answers, k, rounds, 50, 4).start))
        if asked.num_rows:
            named = pa.concat_tables(sd._name(k)(asked.filter(pa.compute.equal(asked.column("shard"), s))) for s in set(asked.column("shard").to_pylist()))
            answers = pa.concat_tables([answers, named.select(["round", "shard", "named"])])
    x = sd._Round(docs, answers, len(rounds), rounds, 50, 4)
    assert left[0] == 30 * 351 + len(texts[-1].split()) - 49 and left[-1] < 200 and 100 < len(x.start) < 120
    assert {0, 30} >= set(x.words.ids[x.doc].tolist())


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert remove_repeats(none).count() == 0
    assert lm_scores(none).count() == 0


def brute_scores(rows, mu):
    """The backoff model by its recursive formula, from dictionaries of all n-grams."""
    docs = []
    for r in rows:
        held = True if r[0] is None else zlib.crc32(str(r[0]).encode()) % 10 == 0
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        docs.append((r[0], held, WORD.findall(low) + ["</s> end"]))
    grams = Counter()
    for _, held, t in docs:
        if not held:
            padded = ["<s> start", *t]
            grams["<s> start",] += 1
            for i in range(1, len(padded)):
                grams.update(tuple(padded[j : i + 1]) for j in range(max(0, i - len(mu)), i + 1))
    uni = {g[0]: c for g, c in grams.items() if len(g) == 1 and g[0] != "<s> start"}
    n, v, once = sum(uni.values()), len(uni), sum(c == 1 for c in uni.values())
    unseen = min(max(once, 1) / (n + 1), 0.5) if n else 1.0

    def p(w, h):
        if not h:
            return (1 - unseen) * uni[w] / n if w in uni else unseen
        below = p(w, h[1:])
        return (grams[(*h, w)] + mu[len(h) - 1] * below) / (grams[h] + mu[len(h) - 1]) if grams[h] >= 2 else below

    out = []
    for i, held, t in docs:
        base = sum(math.log10((uni.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        padded = ["<s> start", *t]
        score = sum(math.log10(p(padded[j], tuple(padded[max(0, j - len(mu)) : j]))) for j in range(1, len(padded)))
        out.append((i, held, len(t), sum(w in uni for w in t), n, round(base, 6), round(score, 6)))
    return sorted(out, key=key)


@pytest.mark.parametrize("mu", [(3.0,), (3.0, 1.5), (4.0, 2.0, 1.0)])
def test_scores_against_brute_force(spark, mu):
    rows = awkward() + [(60 + i, prose(80 + i % 3, 700, 30), "en", "s", 1) for i in range(9)]
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_scores(frame(spark, rows), mu).collect()]
    for a, b in zip(sorted(got, key=key), brute_scores(rows, mu), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-5)


@pytest.mark.parametrize("rows", [[(3, "one", "en", "s", 1)], [(3, "a b a b", "en", "s", 1), (3, "a b a b", "en", "s", 1)], [(None, None, None, None, None)]])
def test_few_rows_and_one_partition(spark, rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, int(before)):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = [(r.doc_id, r.n_tokens, r.train_tokens, round(r.score, 6)) for r in lm_scores(frame(spark, rows), (3.0, 2.0)).collect()]
        assert got == [(b[0], b[2], b[4], pytest.approx(b[6], abs=1e-5)) for b in brute_scores(rows, (3.0, 2.0))]
        assert ours(remove_repeats(frame(spark, rows), 4)) == brute_repeats(rows, 4)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_model_beats_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm_scores(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r.s > r.b


def test_arcs_of_a_state_sum_to_one():
    """Over all words, unseen ones together, the probabilities of the walk after a history add up to 1."""
    import pyarrow as pa

    from arterial.llm.lm_scoring import Automaton, _Ngrams

    corpus = ["a b a c a b", "a b b c", "c a b a", "b a b"]
    n = Counter(w for t in corpus for w in [*t.split(), "end"])
    train = {"docs": len(corpus), "tokens": sum(n.values()), "types": len(n), "once": sum(c == 1 for c in n.values())}
    for history in ("", "a", "a b", "b a", "c c"):
        probes = [f"{history} {w}".strip() for w in "abc"] + [f"{history} unseen".strip(), history]
        x = _Ngrams(pa.table({"text": corpus + probes, "held_out": [False] * len(corpus) + [True] * len(probes)}), 1)
        for level in (1, 2, 3):
            x.add_level(x.states_of(level, train) >= 2 if level == 3 else None)
            x.counts.append(x.training_counts(level))
        automaton = Automaton(x, train, (2.0, 1.0))
        first, size = x.first[len(corpus) :], x.sizes[len(corpus) :]
        whole, without = automaton.walk(first, size - 1), automaton.walk(first, np.maximum(size - 2, 0))
        steps = [*(10 ** (whole[:4] - without[:4])), 10 ** (automaton.walk(first, size)[4] - whole[4])]
        assert sum(steps) == pytest.approx(1), history


def test_scoring_a_group_takes_little_memory():
    """Two groups are scored at once in an executor: bytes a token, without the texts."""
    import tracemalloc

    import pyarrow as pa

    from arterial.llm import lm_scoring

    rows = 300
    docs = pa.table({"doc_id": range(rows), "text": [prose(i, 1000) for i in range(rows)], "held_out": [i % 10 == 0 for i in range(rows)], "g": pa.array([0] * rows, pa.int32())})
    tokens = len(lm_scoring.tokens_of(docs.column("text"))[0])
    train = {"docs": rows, "tokens": tokens, "types": 401, "once": 1}
    answers = lm_scoring._add_up(lm_scoring._ask(1)(docs))
    answers = pa.concat_tables([answers, lm_scoring._add_up(lm_scoring._ask_longer(1, 3, train)(docs, answers))])
    tracemalloc.start()
    try:
        found = lm_scoring._score(1, 3, train, (8.0, 2.0))(docs, answers)
        assert tracemalloc.get_traced_memory()[1] / tokens < 150
    finally:
        tracemalloc.stop()
    assert sum(found.column("n_tokens").to_pylist()) == tokens


def test_structured_texts_have_different_hashes():
    a, b = b"a", b"b"
    for _ in range(12):
        a, b = a + b, b + a
        h = span_hashes(np.frombuffer(a + b, np.uint8), np.array([0, len(a)]), np.array([len(a), 2 * len(a)]))
        assert h[0] != h[1]
