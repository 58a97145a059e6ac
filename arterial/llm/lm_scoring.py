"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model of a given order (3), with Dirichlet smoothing over a
unigram model whose mass for unseen words is the share of words seen once (Good-Turing):

    p(w)     = (1 - u) * c(w) / N,  or u for the one symbol of all unseen words
    p(w | h) = (c(h w) + mu * p(w | h')) / (c(h) + mu),   h' = h without its first word

As an automaton: each history h of up to order - 1 words that training has at least
twice is a state, the start of a text and the empty history, the root, are others. Each
word seen after h is an arc, of weight log10 p(w | h), that leads to the longest
history which ends in w and is a state. The failure arc of h leads to h' and weighs
log10(mu / (c(h) + mu)). A history seen once is no state, so its longest suffix that is
one speaks for it; the weights of a state's arcs add up to a probability of 1.

Scoring walks a text from left to right, once. It carries the state, pays a failure
arc for each state that has no arc for the next word, then takes the arc. The root has
an arc for every word, unseen ones too. The texts of a group are walked side by side;
pieces of a long text are walked at the same time, each after a run-up over the
order - 1 words before it, after which the state doesn't depend on what came earlier.

The model grows with the corpus and is never in one place. Groups of documents send
their distinct n-grams with training counts to shards of the key space, which add up
and answer in the same order: words and pairs first, then level by level the longer
ones whose history is a state. So each group holds exactly that part of the automaton
which its own texts can reach.

Null text: empty, scored as its end token. Null doc_id: held out. Repeated rows are
documents of their own. An empty table gives an empty result. Without training tokens
every probability is 1.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import KEY_BITS, grouped, pack_counts, pack_keys, parts, pieces, placed, small_batches, totals, unpack_counts, unpack_keys
from .kernels import U64, lower_ascii, mix, slices, span_hashes, utf8, word_bounds

END, START = U64(0xE0D), U64(0x57A)
LEAST_HISTORY = 2  # training occurrences that make a history a state
PIECE = 256  # tokens of a text walked in one go
MOST_KEYS = 1 << 21  # that a task gathers before it sends them
SENT = "shard int, g int, level int, keys binary, n binary"
ANSWER = "g int, shard int, level int, n binary"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def tokens_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, the end of each text included, and each text's number of tokens."""
    data, off = utf8(column)
    tokens, sizes = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for i, j in slices(off):
        part = lower_ascii(data[off[i] : off[j]])
        s, e, first = word_bounds(part, off[i : j + 1] - off[i])
        n = np.diff(first)
        out = np.full(len(s) + j - i, END, U64)
        out[np.arange(len(s)) + np.repeat(np.arange(j - i), n)] = span_hashes(part, s, e)
        tokens.append(out)
        sizes.append(n + 1)
    return np.concatenate(tokens), np.concatenate(sizes)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As np.unique with the first index of each key and each one's key, in a third of the memory."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    keys = keys[new]
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    at = np.empty(len(order), np.int32)
    at[order] = number
    return keys, order[new], at


class _Ngrams:
    """A group's tokens and, level by level, its distinct n-grams with the one that ends at each token (-1: none)."""

    def __init__(self, docs: pa.Table, shards: int):
        self.tokens, self.sizes = tokens_of(docs.column("text"))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.tokens), dtype=np.int32)
        self.place -= np.repeat(self.first.astype(np.int32), self.sizes)
        self.learn = np.repeat(~np.asarray(docs.column("held_out").to_numpy(zero_copy_only=False), bool), self.sizes)
        self.shards = shards
        self.hashes = mix(self.tokens + U64(1))
        self.keys: list[np.ndarray] = []
        self.last: list[np.ndarray] = []  # a token at which each n-gram ends
        self.at: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add_level(self, only: np.ndarray | None = None) -> None:
        """The next longer n-grams; only: at these tokens."""
        level = len(self.keys) + 1
        if level > 1:
            before = np.empty_like(self.hashes)
            before[1:] = self.hashes[:-1]
            before[self.first] = START
            before *= U64(0x9E3779B97F4A7C15)
            before += self.tokens
            before += U64(level)
            self.hashes = mix(before)
            del before
        there = self.place >= level - 2
        if only is not None:
            there &= only
        keys, last, at = _distinct(placed(self.hashes[there], self.shards))
        self.keys.append(keys)
        self.last.append(np.flatnonzero(there)[last])
        self.at.append(np.full(len(self.tokens), -1, np.int32))
        self.at[-1][there] = at

    def training_counts(self, level: int) -> np.ndarray:
        at = self.at[level - 1][self.learn]
        return np.bincount(at[at >= 0], minlength=len(self.keys[level - 1]))

    def read(self, answers: pa.Table, level: int) -> None:
        """The counts that shards have sent for a level."""
        keys = self.keys[level - 1]
        where, out = dict(parts(keys >> U64(KEY_BITS))), np.zeros(len(keys), np.int64)
        mine = answers.filter(pc.equal(answers.column("level"), level))
        for s, raw in zip(mine.column("shard").to_pylist(), mine.column("n").to_pylist(), strict=True):
            out[where[s]] = unpack_counts(raw, where[s].stop - where[s].start)
        self.counts.append(out)

    def states_of(self, level: int, train: dict) -> np.ndarray:
        """For each token, how often training has the history of level - 1 words (or the start) before it; 0 if there is none."""
        n = np.zeros(len(self.tokens), np.int64)
        if level == 2:
            n[1:] = self.counts[0][self.at[0][:-1]]
            n[self.first] = train["docs"]
        else:
            at = self.at[level - 2][:-1]
            n[1:][at >= 0] = self.counts[level - 2][at[at >= 0]]
            n[self.first] = 0
        return n

    def grow(self, answers: pa.Table, levels: int, train: dict) -> None:
        """All levels up to this one with their counts; n-grams without a state are left out from level 3 on."""
        for level in range(1, levels + 1):
            self.add_level(self.states_of(level, train) >= LEAST_HISTORY if level > 2 else None)
            self.read(answers, level)

    def only_counts(self) -> None:
        """Leave what only further levels need."""
        self.hashes = self.place = self.learn = self.keys = None

    def request(self, group: int, levels: list[int]) -> pa.Table:
        rows = []
        for level in levels:
            keys, n = self.keys[level - 1], self.training_counts(level)
            rows += [(s, level, pack_keys(keys[p]), pack_counts(n[p])) for s, p in parts(keys >> U64(KEY_BITS))]
        shard, level, keys, n = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"shard": pa.array(shard, pa.int32()), "g": pa.array([group] * len(rows), pa.int32()), "level": pa.array(level, pa.int32()), "keys": pa.array(keys, pa.binary()), "n": pa.array(n, pa.binary())})


def _ask(shards: int):
    def ask(docs: pa.Table) -> pa.Table:
        x = _Ngrams(docs, shards)
        x.add_level()
        x.add_level()
        return x.request(docs.column("g")[0].as_py(), [1, 2])

    return ask


def _ask_longer(shards: int, level: int, train: dict):
    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        x = _Ngrams(docs, shards)
        if not docs.num_rows:
            return x.request(0, [])
        x.grow(answers, level - 1, train)
        x.add_level(x.states_of(level, train) >= LEAST_HISTORY)
        return x.request(docs.column("g")[0].as_py(), [level])

    return ask


def _add_up(asked: pa.Table) -> pa.Table:
    """The summed count of each key of each group and level, in the order asked."""
    out = [None] * asked.num_rows
    levels, keys, counts = (asked.column(c).to_pylist() for c in ("level", "keys", "n"))
    for level in set(levels):
        rows = [r for r, x in enumerate(levels) if x == level]
        own = [unpack_keys(keys[r]) for r in rows]
        where, total = totals(own, [unpack_counts(counts[r], len(k)) for r, k in zip(rows, own, strict=True)])
        for r, w in zip(rows, np.split(where, np.cumsum([len(k) for k in own])[:-1]), strict=True):
            out[r] = pack_counts(total[w])
    return pa.table({"g": asked.column("g").cast(pa.int32()), "shard": asked.column("shard").cast(pa.int32()), "level": asked.column("level").cast(pa.int32()), "n": pa.array(out, pa.binary())})


class Automaton:
    """States and arcs that a group's texts can reach; arcs are listed by the token at which a text could take them."""

    def __init__(self, x: _Ngrams, train: dict, mu: tuple[float, ...]):
        n, once = train["tokens"], train["once"]
        unseen = min(max(once, 1) / (n + 1), 0.5) if n else 1.0
        p = np.where(x.counts[0] > 0, (1 - unseen) * x.counts[0] / max(n, 1), unseen)
        levels = len(x.counts)
        # states: the root, the start of a text, then the n-grams of each level but the last
        base = np.cumsum([2, *map(len, x.counts)])
        state = [np.where(c >= LEAST_HISTORY, base[k] + np.arange(len(c)), -1).astype(np.int32) for k, c in enumerate(x.counts[: levels - 1])]
        self.start = 1 if levels > 1 and train["docs"] >= LEAST_HISTORY else 0
        size = int(base[max(levels - 1, 0)])
        self.depth, self.fail_to, self.fail_weight = np.zeros(size, np.int8 if levels < 128 else np.int64), np.zeros(size, np.int32), np.zeros(size)
        if levels > 1:
            self.depth[1], self.fail_weight[1] = 1, np.log10(mu[0] / (train["docs"] + mu[0]))
        longest, reached = np.zeros(len(x.tokens), np.int32), []  # for each token the longest history of up to k words that is a state
        for k in range(levels - 1):
            own = slice(base[k], base[k + 1])
            self.depth[own] = k + 1
            self.fail_weight[own] = np.log10(mu[k] / (x.counts[k] + mu[k]))
            self.fail_to[own] = longest[x.last[k]]  # the longest shorter history that is a state
            here = x.at[k] >= 0
            found = state[k][x.at[k][here]]
            longest[here] = np.where(found >= 0, found, longest[here])
            del here, found
            reached.append(longest.copy())
        # arcs: those of the root, then of each level's histories; -1 where a text finds none
        del longest, state
        arc_base = np.cumsum([0, *map(len, x.counts)])
        self.arc_weight, self.arc_to = np.zeros(arc_base[-1]), np.zeros(arc_base[-1], np.int32)
        self.arc_at = np.full((levels, len(x.tokens)), -1, np.int32)
        for k in range(levels):
            if k:
                history = x.states_of(k + 1, train)[x.last[k]]
                p = p[x.at[k - 1][x.last[k]]]
                p *= mu[k - 1]
                p += x.counts[k]
                p /= history + mu[k - 1]
                there = (x.counts[k] > 0) & (history >= LEAST_HISTORY)
            else:
                there = np.ones(len(p), bool)
            own = slice(arc_base[k], arc_base[k + 1])
            self.arc_weight[own], self.arc_to[own] = np.log10(p), reached[min(k, levels - 2)][x.last[k]]
            here = np.flatnonzero(x.at[k] >= 0)
            here = here[there[x.at[k][here]]]
            self.arc_at[k, here] = arc_base[k] + x.at[k][here]

    def walk(self, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The log10 probability of each text, given by its first token and size."""
        run_up = len(self.arc_at) - 1
        per = -(-sizes // PIECE)
        doc = np.repeat(np.arange(len(sizes)), per)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        begin = first[doc] + PIECE * number
        end = np.minimum(begin + PIECE, (first + sizes)[doc])
        at = np.where(number > 0, begin - run_up, begin)
        order = np.argsort(at - end, kind="stable")  # the longest first, so those still under way are the first ones
        at, begin, length = at[order], begin[order], (end - at)[order]
        state = np.where(number[order] > 0, 0, self.start)
        score = np.zeros(len(at))
        arcs, width = self.arc_at.ravel(), np.int64(self.arc_at.shape[1])
        for step in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -step))
            i, s, weight = at[:n] + step, state[:n], np.zeros(n)
            arc = arcs[self.depth[s] * width + i]
            stuck = np.flatnonzero(arc < 0)
            while len(stuck):
                here = s[stuck]
                weight[stuck] += self.fail_weight[here]
                s[stuck] = self.fail_to[here]
                arc[stuck] = arcs[self.depth[s[stuck]] * width + i[stuck]]
                stuck = stuck[arc[stuck] < 0]
            score[:n] += np.where(i >= begin[:n], weight + self.arc_weight[arc], 0.0)
            state[:n] = self.arc_to[arc]
        return np.bincount(doc[order], weights=score, minlength=len(sizes))


def _score(shards: int, levels: int, train: dict, mu: tuple[float, ...]):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        x = _Ngrams(docs, shards)
        x.grow(answers, levels, train)
        x.only_counts()
        rows, n, v, first, sizes = docs.num_rows, train["tokens"], train["types"], x.first, x.sizes
        add = lambda values: np.add.reduceat(values[x.at[0]], first) if rows else np.zeros(0)
        known, base = add((x.counts[0] > 0).astype(np.int64)), add(np.log10((x.counts[0] + 0.1) / (n + 0.1 * (v + 1))))
        automaton = Automaton(x, train, mu)
        del x, add
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array([n] * rows, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(automaton.walk(first, sizes), pa.float64()),
            }
        )

    return score


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _words(shards: int):
    """Distinct words of training texts with their counts, a bounded number at a time; shard -1 counts texts."""

    def words(batches):
        texts, gathered, size = 0, [], 0

        def send():
            keys, at = np.unique(np.concatenate([k for k, _ in gathered]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in gathered])).astype(np.int64)
            ranges = parts(keys >> U64(KEY_BITS))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in ranges], pa.int32()), pa.array([pack_keys(keys[p]) for _, p in ranges], pa.binary()), pa.array([pack_counts(n[p]) for _, p in ranges], pa.binary())], ["shard", "keys", "n"])

        for batch in batches:
            texts += batch.num_rows
            tokens, _ = tokens_of(batch.column(0))
            keys, n = np.unique(placed(mix(tokens + U64(1)), shards), return_counts=True)
            gathered.append((keys, n))
            size += len(keys)
            if size > MOST_KEYS:
                yield send()
                gathered, size = [], 0
        if size:
            yield send()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([pack_counts(np.array([texts]))], pa.binary())], ["shard", "keys", "n"])

    return words


def _sum_words(sent: pa.Table) -> pa.Table:
    counts = sent.column("n").to_pylist()
    if sent.column("shard")[0].as_py() < 0:
        found = {"docs": int(sum(unpack_counts(c, 1)[0] for c in counts)), "tokens": 0, "types": 0, "once": 0}
    else:
        own = [unpack_keys(k) for k in sent.column("keys").to_pylist()]
        _, total = totals(own, [unpack_counts(c, len(k)) for c, k in zip(counts, own, strict=True)])
        found = {"docs": 0, "tokens": int(total.sum()), "types": len(total), "once": int((total == 1).sum())}
    return pa.table({k: pa.array([v], pa.int64()) for k, v in found.items()})


def training_totals(texts: DataFrame, shards: int) -> dict[str, int]:
    """Numbers of texts, tokens, distinct tokens and tokens seen once; texts: one column."""
    sums = texts.mapInArrow(_words(shards), "shard int, keys binary, n binary").groupBy("shard").applyInArrow(_sum_words, "docs long, tokens long, types long, once long")
    return sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns)).first().asDict()


def lm_scores(df: DataFrame, mu: tuple[float, ...] = (8.0, 2.0), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document, as RESULT; scores are log10 probabilities of the whole text with its end.

    mu: the smoothing weight of histories of one word, two words, and so on; it sets the order, len(mu) + 1, which is 2 at least.
    """
    small_batches(df.sparkSession)
    n = pieces(df)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    train = training_totals(docs.where(~F.col("held_out")).select("text"), n)
    docs = grouped(docs, ["doc_id", "text", "held_out"], n)
    add_up = lambda sent: sent.groupBy("shard").applyInArrow(_add_up, ANSWER)
    answers = add_up(docs.groupBy("g").applyInArrow(_ask(n), SENT))
    for level in range(3, len(mu) + 2):
        answers = answers.union(add_up(docs.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_ask_longer(n, level, train), SENT)))
    return docs.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_score(n, len(mu) + 1, train, mu), RESULT)


def best_first(scores: DataFrame) -> DataFrame:
    """Documents by their mean log10 probability a token, best first."""
    return scores.withColumn("per_token", F.col("score") / F.col("n_tokens")).orderBy(F.desc("per_token"), "doc_id")
