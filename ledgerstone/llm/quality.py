"""Op 2: quality classifier by co-training.

Two views of a document: its content (which words, beginnings of words and runs of symbols
occur, and which do so often) and its page metadata (language, source, length and layout).  Each
view has its own logistic model over hashed presence features.  In each round both models score
every unlabelled document, in a pass over all of them, and those of each class that one view is
surest of, a `SHARE` of all but no more than `PICKS`, join the training set of the other.  A held-out part of the labelled rows then
calibrates each view and the weights of their combination, which scores all documents.

A document is good if its label says quality 1 and toxic 0.  Models are fitted on a bounded
sample of labelled rows: at most `LABELLED` rows, those with the smallest hashes of doc_id, and of
these as many as have `FIT_BYTES` of features together; a row of more than `ROW_FEATURES` content
features is fitted by those with the smallest hashes.  Scores use all features of whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm.blocks import U, Rolling, _lowered, _space, chunks, tidy
from ledgerstone.llm.common import cut, drop

LABELLED, FIT_BYTES, ROW_FEATURES = 10_000, 48 << 20, 20_000
ROUNDS, SURE, SHARE, PICKS = 3, 0.97, 0.1, 400
FOLDS = 5  # one of so many labelled rows calibrates
TEXT_BITS, META_BITS = 20, 12
PART = 1 << 18  # features that one step of the fit looks at
STEMS, MANY = (5, 7), 3  # bytes of a word's beginning; times from which a feature counts again
APART = 4.5
THRESHOLD = 0.5

_letter = np.zeros(256, bool)
_letter[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def _runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text, is a word) of maximal runs of letters or of symbols."""
    kind = np.where(_space[buf], 0, np.where(_letter[buf], 1, 2)).astype(np.int8)
    edge = np.zeros(len(buf) + 1, bool)
    edge[[0, len(buf)]] = True
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offs] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(offs, start, "right") - 1, kind[start] == 1


def _category(names: list[str]) -> np.ndarray:
    """Feature numbers of a metadata value, by name."""
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") >> (64 - META_BITS) for x in names], np.int64)


def features(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, row and number of each text feature, metadata features of each row)."""
    lang, source = batch["lang"].to_pylist(), batch["source"].to_pylist()
    names: dict[str, int] = {}

    def number(name: str) -> int:
        if name not in names:
            names[name] = int(_category([name])[0])
        return names[name]

    for a, b, buf, offs in chunks(batch["text"]):
        start, end, row, word = _runs(buf, offs) if len(buf) else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        roll = Rolling(_lowered[buf])
        found = [(row, roll.of(start, end))]
        for size in STEMS:  # compounds share their beginnings
            long = end - start > size
            found.append((row[long], roll.of(start[long], start[long] + size) ^ U(size)))
        r, h = (np.concatenate(x) for x in zip(*found, strict=True))
        pair, times = np.unique((r.astype(U) << U(TEXT_BITS)) | (h >> U(65 - TEXT_BITS)), return_counts=True)
        many = pair[times >= MANY] | U(1 << TEXT_BITS - 1)  # in the upper half
        distinct = np.bincount((np.unique((row.astype(U) << U(40)) | (found[0][1] >> U(24))) >> U(40)).astype(np.int64), minlength=b - a)
        pair = np.sort(np.concatenate([pair, many]))
        n = b - a
        count = lambda m: np.bincount(row[m], minlength=n)
        tokens, words, symbols = np.bincount(row, minlength=n), count(word), count(~word)
        lines = np.add.reduceat(np.append(buf, 0) == 10, offs[:-1]) * (np.diff(offs) > 0) if n else np.zeros(0)
        size = np.diff(offs)
        tenth = lambda x, y: np.minimum(10, (10 * x) // np.maximum(1, y)).astype(int)
        stats = (("length", np.log2(size + 1).astype(int)), ("distinct", tenth(distinct, tokens)), ("symbols", tenth(symbols, words)), ("letters", np.minimum(12, size // np.maximum(1, words))), ("lines", np.log2(lines + 1).astype(int)), ("line length", np.log2(size / (lines + 1) + 1).astype(int)))
        meta = np.array([[number(f"lang {x}"), number(f"source {y}"), *(number(f"{name} {v[i]}") for name, v in stats)] for i, (x, y) in enumerate(zip(lang[a:b], source[a:b], strict=True))], np.int64).reshape(n, -1)
        yield a, b, (pair >> U(TEXT_BITS)).astype(np.int64), (pair & U((1 << TEXT_BITS) - 1)).astype(np.int64), meta


def _probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Logistic regression over presence features, full-batch AdaGrad."""

    def __init__(self, bits: int) -> None:
        self.w, self.bias = np.zeros(1 << bits), 0.0

    def __getstate__(self):  # most weights are 0
        at = np.flatnonzero(self.w)
        return len(self.w), at.astype(np.int32), self.w[at], self.bias

    def __setstate__(self, state) -> None:
        n, at, w, self.bias = state
        self.w = np.zeros(n)
        self.w[at] = w

    def sums(self, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        used = (self.w != 0)[col]
        return np.bincount(row[used], self.w[col[used]], n)

    def logits(self, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        return self.sums(row, col, n) + self.bias

    def fit(self, row, col, y, weight, apart: float = 0.0, **how) -> Model:
        return self.fit_parts(lambda: _slices(row, col), y, weight, apart, **how)

    def fit_parts(self, parts, y, weight, apart: float = 0.0, rounds: int = 120, rate: float = 0.3, l2: float = 1e-5) -> Model:
        """parts(): (row, feature) arrays, in the order of rows; they are gone through twice, and only what is fitted on is held.

        apart: features whose share of good and of bad rows differs by fewer standard errors are left out.
        """
        n, size = len(y), len(self.w)
        good, bad = np.zeros(size, np.int32), np.zeros(size, np.int32)
        for r, c in parts():
            yes = (y > 0)[r]
            np.add.at(good, c[yes], 1)
            np.add.at(bad, c[~yes], 1)
        n1, n0 = max(1.0, y.sum()), max(1.0, n - y.sum())
        wanted = np.zeros(size, bool)
        for s in (slice(i, i + PART) for i in range(0, size, PART)):
            p = np.clip((good[s] + bad[s]) / max(1, n), 1e-12, 1 - 1e-12)
            z = (good[s] / n1 - bad[s] / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
            wanted[s] = (np.abs(z) >= apart) & (good[s] + bad[s] > 0)
        count = int((good[wanted].astype(np.int64) + bad[wanted]).sum())
        ids, number = np.flatnonzero(wanted), np.cumsum(wanted, dtype=np.int32) - np.int32(1)
        del good, bad
        row, at, end = np.empty(count, np.int32), np.empty(count, np.int32), 0
        for r, c in parts():
            keep = wanted[c]
            begin, end = end, end + int(keep.sum())
            row[begin:end], at[begin:end] = r[keep], number[c[keep]]
        w, g2, b, b2 = np.zeros(len(ids)), np.full(len(ids), 1e-8), 0.0, 1e-8
        for _ in range(rounds):
            x, g = np.zeros(n), np.zeros(len(ids))
            for r, k in _slices(row, at):
                np.add.at(x, r, w[k])
            e = (_probability(x + b) - y) * weight / n
            for r, k in _slices(row, at):
                np.add.at(g, k, e[r])
            g += l2 * w / n
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
            b2 += e.sum() ** 2
            b -= rate * e.sum() / np.sqrt(b2)
        self.w[:] = 0
        self.w[ids], self.bias = w, b
        return self


def _balance(y: np.ndarray) -> np.ndarray:
    good = y.mean() if len(y) else 0.5
    return np.where(y > 0, 0.5 / max(good, 1e-9), 0.5 / max(1 - good, 1e-9)) if 0 < good < 1 else np.ones(len(y))


def _platt(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of a small logistic regression, the last for the bias; Newton steps with a prior."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _probability(x @ w)
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w)), x.T @ (p - y) + 1e-2 * w)
    return w


def _slices(row: np.ndarray, col: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs some at a time: no mask or copy of all of them at once."""
    for i in range(0, len(row), PART):
        yield row[i : i + PART], col[i : i + PART]


def held_rows(label: np.ndarray, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(rows that calibrate, rows that train) of the labelled ones: crc32 of the id mod FOLDS is 0 or is not.

    Each class must be on both sides: a class with no row on a side sends its row of the smallest
    (to calibrate) or largest crc32 there; a class of one row serves both.
    """
    crc = np.array([crc32(str(x).encode()) for x in ids], np.int64)
    held = (label >= 0) & (crc % FOLDS == 0)
    used = (label >= 0) & ~held
    for value in (0, 1):
        mine = np.flatnonzero(label == value)
        for side, other, best in ((held, used, np.argmin), (used, held, np.argmax)):
            if len(mine) and not side[mine].any():
                row = mine[best(crc[mine])]
                side[row] = True
                other[row] = len(mine) == 1
    return held, used


class Views:
    """What the driver fits on: some documents' features by view, labels, and pseudo-labels by view."""

    def __init__(self, text: tuple, meta: np.ndarray, ids: list[int], good: dict[int, int]) -> None:
        self.good, self.given = good, [{}, {}]
        self.text, self.meta, self.ids = [text], meta, ids  # text: pieces of (number of features of each row, features)
        self.models = [Model(TEXT_BITS), Model(META_BITS)]

    def more(self, text: tuple, meta: np.ndarray, ids: list[int]) -> None:
        self.text, self.meta, self.ids = [*self.text, text], np.concatenate([self.meta, meta]), [*self.ids, *ids]

    def label(self) -> np.ndarray:
        return np.array([self.good.get(x, -1) for x in self.ids], np.int64)

    def parts(self, view: int, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, feature) arrays of some rows, numbered among them: some PART features at a time, in order."""
        if view == 1:
            yield from _slices(np.repeat(np.arange(len(rows)), self.meta.shape[1]), self.meta[rows].reshape(-1))
            return
        new = np.full(len(self.ids), -1, np.int32)
        new[rows] = np.arange(len(rows))
        base = 0
        for counts, col in self.text:
            at, lo = np.append(0, np.cumsum(counts)), 0
            while lo < len(counts):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PART, "right")) - 1)
                row = np.repeat(new[base + lo : base + hi], counts[lo:hi])
                yield row[row >= 0], col[at[lo] : at[hi]][row >= 0]
                lo = hi
            base += len(counts)

    def fit(self) -> None:
        label = self.label()
        _, used = held_rows(label, self.ids)
        for view, (model, given, apart) in enumerate(zip(self.models, self.given, (APART, 0.0), strict=True)):
            y = np.where(used, label, np.array([given.get(x, -1) for x in self.ids], np.int64))
            rows = np.flatnonzero((y >= 0) & (used | (label < 0)))
            y = y[rows].astype(float)
            model.fit_parts(lambda view=view, rows=rows: self.parts(view, rows), y, _balance(y), apart)

    def exchange(self, sure: list[dict[int, int]]) -> bool:
        """Give each view what the other is sure of; whether that is anything new."""
        after = [{**self.given[0], **sure[1]}, {**self.given[1], **sure[0]}]
        new, self.given = after != self.given, after
        return new

    def calibrated(self):
        """(text model, metadata model, text calibration, metadata calibration, combination)."""
        label = self.label()
        test = np.flatnonzero(held_rows(label, self.ids)[0])
        y = label[test].astype(float)
        logits = np.column_stack([sum((m.sums(r, c, len(test)) for r, c in self.parts(view, test)), np.zeros(len(test))) + m.bias for view, m in enumerate(self.models)])
        each = [_platt(logits[:, [k]], y) for k in (0, 1)]
        both = _platt(np.column_stack([logits[:, k] * each[k][0] + each[k][1] for k in (0, 1)]), y)
        return *self.models, *each, both


def picks(unlabelled: int) -> int:
    return max(1, min(PICKS, int(SHARE * unlabelled)))


def surest(strength: list[tuple[float, int, int]], most: int) -> list[int]:
    """Ids of the largest (strength, hash, id) of at least SURE; ties go to the smaller hash, then id."""
    return [x[2] for x in sorted((x for x in strength if x[0] >= SURE), key=lambda x: (-x[0], x[1], x[2]))[:most]]


def _gather(docs: DataFrame) -> tuple[tuple, np.ndarray, list[int]]:
    """((features of each, features), metadata, ids) of a bounded set of documents, on the driver: those with the smallest hashes of doc_id, FIT_BYTES in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, col, meta in features(batch):
                at = np.searchsorted(row, np.arange(b - a + 1))
                text = [np.sort(col[at[i] : at[i + 1]]).astype(np.int32)[:ROW_FEATURES].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(text, pa.binary()), pa.array([x.astype(np.int16).tobytes() for x in meta], pa.binary())], ["doc_id", "text", "meta"])

    table = cut(docs.mapInArrow(run, "doc_id long, text binary, meta binary").withColumn("h", F.xxhash64("doc_id")), "features")
    sizes = table.groupBy("h", "doc_id").agg(F.sum(F.length("text")).alias("n")).orderBy("h", "doc_id").collect()  # a bounded set of ids
    enough = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), FIT_BYTES, "right")) if sizes else 0
    if enough < len(sizes):
        last = sizes[max(0, enough - 1)]
        table = table.where((F.col("h") < last["h"]) | ((F.col("h") == last["h"]) & (F.col("doc_id") <= last["doc_id"])))
    got = table.select("doc_id", "text", "meta").toArrow()
    drop(table)
    order = pc.sort_indices(got, sort_keys=[("doc_id", "ascending"), ("text", "ascending"), ("meta", "ascending")]).to_numpy()
    n, texts = len(got), got["text"]
    counts = pc.binary_length(texts).to_numpy()[order].astype(np.int64) // 4
    col, at = np.empty(int(counts.sum()), np.int32), 0
    for i, size in zip(order.tolist(), counts.tolist(), strict=True):
        col[at : at + size] = np.frombuffer(texts[i].as_buffer(), np.int32)
        at += size
    meta = np.array([np.frombuffer(x, np.int16) for x in got["meta"].to_pylist()], np.int64).reshape(n, -1)[order] if n else np.zeros((0, 8), np.int64)
    ids = got["doc_id"].take(pa.array(order)).to_pylist()
    del got, texts
    tidy()
    return (counts, col), meta, ids


def _both_views(docs: DataFrame, known: DataFrame, models: list[Model]) -> list[dict[int, int]]:
    """What each view is sure of, of all documents without a label: {doc_id: class}, PICKS a class at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, col, meta in features(batch):
                n = b - a
                pt = _probability(models[0].logits(row, col, n))
                pm = _probability(models[1].logits(np.repeat(np.arange(n), meta.shape[1]), meta.reshape(-1), n))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, n), pa.array(pt), pa.array(pm)], ["doc_id", "p0", "p1"])

    p = docs.where("doc_id is not null").mapInArrow(run, "doc_id long, p0 double, p1 double").join(known.select("doc_id"), "doc_id", "left_anti")
    # rows of one doc_id are as sure as the least sure of them
    p = cut(p.groupBy("doc_id").agg(*[f(f"p{k}").alias(f"{side}{k}") for k in (0, 1) for f, side in ((F.min, "lo"), (F.max, "hi"))]), "views")
    sure: list[dict[int, int]] = [{}, {}]
    most = picks(p.count())
    for k, pick in enumerate(sure):
        for value, strength in ((1, F.col(f"lo{k}")), (0, 1 - F.col(f"hi{k}"))):
            best = p.select(strength.alias("s"), F.xxhash64("doc_id").alias("h"), "doc_id").where(F.col("s") >= SURE).orderBy(F.desc("s"), "h", "doc_id").limit(most)
            pick |= {i: value for i in surest([tuple(r) for r in best.collect()], most)}
    drop(p)
    return sure


def fit(docs: DataFrame, labels: DataFrame):
    """The two models and their calibration; None if no documents of both classes are labelled."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
    d = docs.select("doc_id", "text", "lang", "source")
    ids = d.select("doc_id").distinct()
    sample = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).collect()
    good = {r["doc_id"]: r["good"] for r in sample}
    if len(set(good.values())) < 2:
        return None

    def some(wanted) -> tuple:  # LABELLED, or 4 PICKS, ids at most
        return _gather(d.join(F.broadcast(spark.createDataFrame([(x,) for x in wanted], "doc_id long")), "doc_id", "left_semi"))

    views = Views(*some(good), good)
    if len(set(views.label().tolist())) < 2:
        return None
    for _ in range(ROUNDS):
        views.fit()
        tidy()
        sure = _both_views(d, known, views.models)
        if not views.exchange(sure):
            break
        new = sorted({*sure[0], *sure[1]} - set(views.ids))
        if new:
            views.more(*some(new))
    views.fit()
    fitted = views.calibrated()
    del views
    tidy()
    return fitted


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept; one row per input row; kept: score >= THRESHOLD.

    Scores are probabilities of a good document.  Null language or source is a value of its own,
    a null text is empty; a null doc_id is scored and trains nothing; repeated rows of one doc_id
    are scored each for itself.  Texts of any length are scored whole.  Without labelled documents
    of both classes nothing is known: all scores are 0.5 and every document is kept.  An empty
    table gives no rows.  Other columns are ignored.
    """
    return docs.select("doc_id", "text", "lang", "source").mapInArrow(_scorer(fit(docs, labels)), "doc_id long, text_score double, meta_score double, score double, kept boolean")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score() keeps, in one pass over them."""
    scorer = _scorer(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [x["kept"] for x in scorer(iter([batch]))]
            yield batch.filter(pa.concat_arrays(kept) if kept else pa.array([], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _scorer(fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, col, meta in features(batch):
                n = b - a
                if fitted is None:
                    each = [np.full(n, 0.5)] * 3
                else:
                    text_model, meta_model, ct, cm, both = fitted
                    lt = text_model.logits(row, col, n) * ct[0] + ct[1]
                    lm = meta_model.logits(np.repeat(np.arange(n), meta.shape[1]), meta.reshape(-1), n) * cm[0] + cm[1]
                    each = [_probability(x) for x in (lt, lm, both[0] * lt + both[1] * lm + both[2])]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, n), *[pa.array(x) for x in each], pa.array(each[2] >= THRESHOLD)], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return run
