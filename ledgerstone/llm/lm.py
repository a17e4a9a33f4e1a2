"""Op 7: language-model scores by a weighted backoff automaton.

States are the known contexts of up to two tokens, the text's start among them: every word that
was seen in training, and every pair seen at least `SEEN` times.  From a state h an arc for each
token w seen after it carries log p(w | h) and leads to the longest known suffix of hw; for all
other tokens the failure arc leads to the context one token shorter at the weight
log(a / (c(h) + a)), with
    p(w | h) = (c(hw) + a * p(w | shorter h)) / (c(h) + a),
so the arcs and the failure arc of a state share exactly the mass 1.  The empty context holds the
add-one unigram distribution and an arc for every token, unknown ones included.  The strength a of
an order is fitted to the corpus: a context that goes on with something new with the chance
a / (i + a) after i continuations has as many different ones, in expectation and over all
contexts, as were counted (an end that follows a word counts as a context here).

A text is read once from left to right: the state is carried from token to token, failure arcs
are followed until the state has an arc for the token, and the weights on the way add up.  The
texts of a bucket are read in step.  A long text is read in pieces of `PIECE` tokens, each of which
starts in the state the piece before ends in: it follows from the last two tokens.

The automaton of the whole corpus is never in one place.  Texts lie in buckets by a hash of
doc_id; a bucket builds just the states and arcs its own texts can take.  It sends each distinct
n-gram with its training count to the n-gram's partition and gets the corpus count back, in the
order it asked: first words and pairs, then triples whose first two tokens are a state.  A
frequent n-gram is one entry a bucket, so no key is hot.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerstone.llm.blocks import U, chunks, dump, load, mix, word_hashes, words
from ledgerstone.llm.repeats import SCHEMA, exchange, rows

END, START, STEP = U(0x51ED270B7F3A9C01), U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25)
LOW40 = U((1 << 40) - 1)
SEEN = 2
PIECE = 512
BUCKET = 8 << 20  # bytes of texts in a bucket: the larger, the fewer n-grams are sent twice
STRENGTHS = 2.0 ** np.arange(-4, 18, 1.5)  # between which that of an order is interpolated


def held_out(doc_id: int | None) -> bool:
    """The test fold; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def short(counts: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes; where and what those are that need more than one."""
    big = np.flatnonzero(counts >= 255)
    return [np.minimum(counts, 255), big, counts[big]]


def whole(low: np.ndarray, big: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = low.astype(np.int64)
    out[big.astype(np.int64)] = values.astype(np.int64)
    return out


def _digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out -= np.where(small, 1 / x, 0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def kinds(counts: np.ndarray) -> np.ndarray:
    """For each of STRENGTHS the expected number of different continuations of contexts with these counts."""
    c, times = np.unique(counts, return_counts=True)
    a = STRENGTHS[:, None]
    return (a * (_digamma(a + c) - _digamma(a + 0 * c)) * times).sum(1) if len(c) else np.zeros(len(STRENGTHS))


def strength(expected: np.ndarray, counted: int) -> float:
    """The strength at which as many are expected as were counted; both grow together, so logarithms are interpolated."""
    if not counted or not expected[-1]:
        return 1.0
    return float(np.exp(np.interp(np.log(counted), np.log(expected), np.log(STRENGTHS))))


class Order:
    """The distinct n-grams of a bucket in the order (partition, key), and which one each token ends."""

    def __init__(self, gram: np.ndarray, valid: np.ndarray, train: np.ndarray, parts: int) -> None:
        at = np.flatnonzero(valid)
        name = gram[at]
        name = ((name >> U(40)) % U(parts)) << U(40) | (name & LOW40)  # one sort puts n-grams in order of partition and key
        name, first, inverse = np.unique(name, return_index=True, return_inverse=True)
        part = (name >> U(40)).astype(np.int64)
        self.key, self.first = name & LOW40, at[first]
        self.id = np.full(len(gram), len(name))  # len(name): none
        self.id[at] = inverse
        self.seen = np.bincount(self.id[at], train[at].astype(np.float64), len(name)).astype(np.int64)
        self.edges = np.searchsorted(part, np.arange(parts + 1))

    def request(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Steps between keys, and counts."""
        s = slice(self.edges[p], self.edges[p + 1])
        return np.diff(self.key[s], prepend=U(0)), self.seen[s]

    def take(self, replies: dict[int, np.ndarray]) -> np.ndarray:
        """Corpus counts from the replies of the partitions; one more 0 for `none`."""
        out = np.zeros(len(self.key) + 1, np.int64)
        for p, counts in replies.items():
            out[self.edges[p] : self.edges[p + 1]] = counts
        return out


class Grams:
    """The tokens of a bucket's texts, each text being its lower-cased words and one end."""

    def __init__(self, table: pa.Table) -> None:
        toks, lens = [], []
        for a, b, buf, offs in chunks(table["text"]):
            start, end, counts = words(buf, offs)
            tok = np.full(len(start) + b - a, END)
            tok[np.arange(len(start)) + np.repeat(np.arange(b - a), counts)] = word_hashes(buf, start, end, lower=True)
            toks.append(tok)
            lens.append(counts + 1)
        self.tok, self.lens = np.concatenate(toks), np.concatenate(lens)
        self.first = np.cumsum(self.lens) - self.lens
        self.held = np.array([held_out(x) for x in table["doc_id"].to_pylist()], bool)
        self.train = np.repeat(~self.held, self.lens)
        self.place = np.arange(len(self.tok)) - np.repeat(self.first, self.lens)

    def after(self, gram: np.ndarray) -> np.ndarray:
        before = np.append(START, gram[:-1])
        before[self.first] = START
        return mix(before * STEP + self.tok)

    def two(self, parts: int) -> tuple[Order, Order]:
        every = np.ones(len(self.tok), bool)
        return Order(self.tok, every, self.train, parts), Order(self.after(self.tok), every, self.train, parts)

    def three(self, parts: int, pairs: Order, counts: np.ndarray) -> Order:
        """Triples whose first two tokens are a state."""
        known = np.append(False, (counts >= SEEN)[pairs.id[:-1]])
        return Order(self.after(self.after(self.tok)), known & (self.place > 0), self.train, parts)


def traverse(g: Grams, one: Order, two: Order, three: Order, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, total: int, distinct: int, a2: float, a3: float) -> np.ndarray:
    """log10 of the probability of each token, by the automaton of these n-grams.

    States: 0 is the empty context, 1 + i the word i, the start after the last word, then pairs.
    """
    start, pair = 1 + len(one.key), 2 + len(one.key)
    texts = c1[one.id[g.first[0] + g.lens[0] - 1]]  # every training text has one end, hence one start
    level = np.concatenate([[0], np.ones(pair - 1, np.int8), np.full(len(two.key) + 1, 2, np.int8)])
    word_state = np.append(np.where(c1[:-1] > 0, 1 + np.arange(len(one.key)), 0), 0)
    last = one.id[two.first]  # the last word of each pair
    pair_state = np.append(np.where(c2[:-1] >= SEEN, pair + np.arange(len(two.key)), word_state[last]), 0)
    fail = np.concatenate([np.zeros(pair, np.int64), word_state[last], [0]])
    with np.errstate(divide="ignore"):
        weight = np.concatenate([[0.0], np.log10(a2 / (c1[:-1] + a2)), [np.log10(a2 / (texts + a2))], np.log10(a3 / (c2 + a3))])
    # arcs: those of the empty context by word, of words by pair, of pairs by triple
    p1 = (c1 + 1.0) / (total + distinct + 1.0)
    at = two.first
    context = np.where(g.place[at] == 0, texts, c1[one.id[at - 1]])
    p2 = np.append((c2[:-1] + a2 * p1[one.id[at]]) / (context + a2), 1.0)
    at = three.first
    p3 = np.append((c3[:-1] + a3 * p2[two.id[at]]) / (c2[two.id[at - 1]] + a3), 1.0)
    logs = [np.log10(p) for p in (p1, p2, p3)]
    to = [word_state, pair_state, np.append(pair_state[two.id[at]], 0)]
    has2, has3 = c2 > 0, c3 > 0

    pieces = -(-g.lens // PIECE)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(g.first, pieces) + nth * PIECE
    size = np.minimum(PIECE, np.repeat(g.lens, pieces) - nth * PIECE)
    o = np.argsort(-size, kind="stable")
    begin, size, nth = begin[o], size[o], nth[o]
    state = np.where(nth > 0, pair_state[two.id[begin - 1]], start if texts else 0)
    out = np.zeros(len(g.tok))
    for t in range(int(size.max(initial=0))):
        m = int(np.searchsorted(-size, -t, "left"))  # pieces longer than t
        pos = begin[:m] + t
        s, i1, i2, i3 = state[:m], one.id[pos], two.id[pos], three.id[pos]
        log = np.zeros(m)
        lost = (level[s] == 2) & ~has3[i3]
        log[lost] += weight[s[lost]]
        s = np.where(lost, fail[s], s)
        lost = (level[s] == 1) & ~has2[i2]
        log[lost] += weight[s[lost]]
        s = np.where(lost, fail[s], s)
        depth = level[s]
        out[pos] = log + np.choose(depth, [logs[0][i1], logs[1][i2], logs[2][i3]])
        state[:m] = np.choose(depth, [to[0][i1], to[1][i2], to[2][i3]])
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    Counts are over the training fold of all rows.  A null or empty text is the end token alone;
    repeated rows count as often as they come; texts of any length are read whole; other columns
    are ignored; an empty table gives no rows.
    """
    base, names = exchange(docs, BUCKET)
    parts, number = len(names), {name: i for i, name in enumerate(names)}

    def sent(table: pa.Table, kind: int, orders: list[Order]) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        return rows(names, [bucket] * parts, kind, [dump(*[x for order in orders for x in order.request(p)]) for p in range(parts)])

    def totals(table: pa.Table, n: int) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
        """(corpus counts of the distinct n-grams, replies to each bucket) by order."""
        got = [load(x) for x in table["payload"].to_pylist()]
        counts, replies = [], [[] for _ in got]
        for k in range(n):
            asked = [np.cumsum(x[2 * k].astype(U), dtype=U) for x in got]
            key, inverse = np.unique(np.concatenate(asked), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([x[2 * k + 1] for x in got]).astype(np.float64), len(key)).astype(np.int64)
            counts.append(total)
            for reply, part in zip(replies, np.split(total[inverse], np.cumsum([len(x) for x in asked])[:-1]), strict=True):
                reply.append(part)
        return counts, replies

    def answered(table: pa.Table, kind: int, stats: np.ndarray, replies: list[list[np.ndarray]]) -> pa.Table:
        return rows([table["p"][0].as_py()] * len(table), table["bucket"].to_pylist(), kind, [dump(stats.astype(np.float64).view(U), *[part for counts in x for part in short(counts)]) for x in replies])

    def read(replies: pa.Table, kind: int) -> tuple[np.ndarray, list[dict[int, np.ndarray]]]:
        """(statistics summed over partitions, for each order the counts by partition)."""
        stats, out = [], []
        for k, p, blob in sorted(zip(replies["kind"].to_pylist(), (number[p] for p in replies["p"].to_pylist()), replies["payload"].to_pylist(), strict=True), key=lambda x: x[:2]):
            if k == kind:
                head, *got = load(blob)
                stats.append(head.astype(U).view(np.float64))
                out.append((p, [whole(*got[i : i + 3]) for i in range(0, len(got), 3)]))
        return np.sum(stats, 0), [{p: got[n] for p, got in out} for n in range(len(out[0][1]))]

    def ask(table: pa.Table) -> pa.Table:
        return sent(table, 0, list(Grams(table).two(parts)))

    def answer(table: pa.Table) -> pa.Table:
        (c1, c2), replies = totals(table, 2)
        stats = np.concatenate([[c1.sum(), (c1 > 0).sum(), (c2 > 0).sum()], kinds(c1[c1 > 0]), kinds(c2[c2 >= SEEN])])
        return answered(table, 0, stats, replies)

    def show(table: pa.Table, replies: pa.Table) -> pa.Table:
        g = Grams(table)
        _, two = g.two(parts)
        return sent(table, 1, [g.three(parts, two, two.take(read(replies, 0)[1][1]))])

    def settle(table: pa.Table) -> pa.Table:
        (c3,), replies = totals(table, 1)
        return answered(table, 1, np.array([(c3 > 0).sum()]), replies)

    def end(table: pa.Table, replies: pa.Table) -> pa.Table:
        g = Grams(table)
        one, two = g.two(parts)
        stats, counts = read(replies, 0)
        c1, c2 = one.take(counts[0]), two.take(counts[1])
        three = g.three(parts, two, c2)
        (triples,), (counts,) = read(replies, 1)
        c3 = three.take(counts)
        trained, distinct, pairs = (int(x) for x in stats[:3])
        a2, a3 = strength(stats[3 : 3 + len(STRENGTHS)], pairs), strength(stats[3 + len(STRENGTHS) :], int(triples))
        log = traverse(g, one, two, three, c1, c2, c3, trained, distinct, a2, a3)
        total = lambda x: np.add.reduceat(x, g.first)
        seen, lowest = c1[one.id], np.log10((c1 + 1.0) / (trained + distinct + 1.0))[one.id]
        return pa.table([table["doc_id"].cast(pa.int64()), pa.array(g.held), pa.array(g.lens, pa.int64()), pa.array(total((seen > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(g.lens), trained), pa.int64()), pa.array(total(lowest)), pa.array(total(log))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    by = base.groupBy("bucket")
    replies = by.applyInArrow(ask, SCHEMA).groupBy("p").applyInArrow(answer, SCHEMA)
    asked = by.cogroup(replies.groupBy("bucket")).applyInArrow(show, SCHEMA)
    settled = asked.groupBy("p").applyInArrow(settle, SCHEMA)
    return by.cogroup(replies.unionByName(settled).groupBy("bucket")).applyInArrow(end, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
