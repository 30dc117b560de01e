"""Quality classifier: a generalised additive model with pairwise interactions.

Text statistics are cut into quantile bins.  Training cycles over the features; each
step fits a tree of at most four leaves on one feature's histogram of residuals and
adds it, slowed, to that feature's lookup table.  Then the pairs that best explain the
rest get tables over two coarser binnings, boosted in turn the same way.  A score is
the logistic of a sum of table entries, looked up for whole batches at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, documents, fold_of, labelled_sample, release

#: At most this many labelled rows train the model.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 64, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAST_LEAF, PULL = 250, 80, 0.08, 8, 2.0

NAMES = (
    "log_words", "log_lines", "word_length", "word_length_spread", "upper", "digits", "spaces", "punctuation", "symbols", "pipes", "exclamations",
    "non_ascii", "distinct_words", "top_word", "repeated_bigrams", "short_words", "capitalised", "ends_in_stop", "line_words", "repeated_lines",
    "stops_per_word", "commas_per_word", "compressed", "longest_word", "symbol_ended",
)

_UPPER, _DIGIT, _SPACE = np.zeros(256), np.zeros(256), np.zeros(256)
_UPPER[65:91], _DIGIT[48:58], _SPACE[[9, 10, 11, 12, 13, 32]] = 1, 1, 1
_PUNCTUATION, _SYMBOL, _HIGH = np.zeros(256), np.zeros(256), np.zeros(256)
_PUNCTUATION[[ord(c) for c in ".,;:?!'\"()-"]] = 1
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 1
_HIGH[128:] = 1
_CLASSES = np.stack((_UPPER, _DIGIT, _SPACE, _PUNCTUATION, _SYMBOL, _HIGH))
_SYMBOLS = frozenset(b"#$%&*+/<=>@[\\]^_`{|}~")


def statistics(text: bytes | None) -> np.ndarray:
    """The features of a text; all 0 for null and empty ones."""
    out = np.zeros(len(NAMES))
    if not text:
        return out
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digits, spaces, punctuation, symbols, high = _CLASSES @ counts / n
    words, lines = text.split(), text.split(b"\n")
    k = max(1, len(words))
    lengths = np.array([len(w) for w in words] or [0])
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    full = [x for x in lines if x]
    out[:] = (
        np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), upper, digits, spaces, punctuation, symbols, counts[124] / n, counts[33] / n,
        high, len(distinct) / k, max(distinct.values(), default=0) / k, 1 - pairs / max(1, len(words) - 1), (lengths <= 3).mean(), sum(65 <= w[0] <= 90 for w in words) / k,
        sum(x[-1:] in b".!?" for x in full) / max(1, len(full)), np.log1p(k / max(1, len(full))), 1 - len(set(full)) / max(1, len(full)),
        counts[46] / k, counts[44] / k, len(zlib.compress(text, 1)) / n, np.log1p(lengths.max()), sum(w[-1] in _SYMBOLS for w in words) / k,
    )
    return out


def _leaves(gradient: np.ndarray, weight: np.ndarray, count: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values, per bin, of a shallow tree on a histogram of residuals."""
    out = np.zeros(len(gradient))

    def split(a: int, b: int, left: int) -> None:
        g, w, c = gradient[a:b], weight[a:b], count[a:b]
        if left and b - a > 1:
            gl, wl, cl = np.cumsum(g)[:-1], np.cumsum(w)[:-1], np.cumsum(c)[:-1]
            gr, wr, cr = g.sum() - gl, w.sum() - wl, c.sum() - cl
            gain = np.where((cl >= LEAST_LEAF) & (cr >= LEAST_LEAF), gl**2 / (wl + PULL) + gr**2 / (wr + PULL), -1)
            k = int(gain.argmax())
            if gain[k] > g.sum() ** 2 / (w.sum() + PULL) + 1e-9:
                split(a, a + k + 1, left - 1)
                split(a + k + 1, b, left - 1)
                return
        out[a:b] = g.sum() / (w.sum() + PULL)

    split(0, len(gradient), depth)
    return out


class AdditiveModel:
    """Lookup tables of single features and of pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base, self.edges, self.tables, self.pair_edges, self.pairs = 0.0, [], [], [], []
        n = len(y)
        positive = float(y.sum()) if n else 0.0
        self.base = float(np.log((positive + 0.5) / (n - positive + 0.5)))
        if not n or positive in (0.0, float(n)):
            return
        quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        bins = self.bins(x, self.edges)
        score = np.full(n, self.base)
        sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, self.tables)]
        for _ in range(ROUNDS):
            for b, table, size in zip(bins, self.tables, sizes):
                p = 1 / (1 + np.exp(-score))
                step = RATE * _leaves(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)), size)
                table += step
                score += step[b]
        coarse = np.linspace(0, 1, PAIR_BINS + 1)[1:-1]
        self.pair_edges = [np.unique(np.quantile(x[:, j], coarse)) for j in range(x.shape[1])]
        bins = self.bins(x, self.pair_edges)
        p = 1 / (1 + np.exp(-score))
        found = []
        for i in range(x.shape[1]):
            for j in range(i):
                cell, width = self._cell(bins, i, j)
                g, w = np.bincount(cell, y - p, width), np.bincount(cell, p * (1 - p), width)
                found.append(((g**2 / (w + PULL)).sum(), i, j))
        for _, i, j in sorted(found, reverse=True)[:PAIRS]:
            self.pairs.append((i, j, np.zeros(self._cell(bins, i, j)[1])))
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                cell, width = self._cell(bins, i, j)
                p = 1 / (1 + np.exp(-score))
                step = RATE * self._grid(np.bincount(cell, y - p, width), np.bincount(cell, p * (1 - p), width), np.bincount(cell, minlength=width), len(self.pair_edges[j]) + 1)
                table += step
                score += step[cell]

    @staticmethod
    def _grid(g: np.ndarray, w: np.ndarray, c: np.ndarray, columns: int) -> np.ndarray:
        """A tree of two levels over a grid: the better first axis, then the other one on each side."""
        g, w, c = (a.reshape(-1, columns) for a in (g, w, c))
        best, chosen = -1.0, None
        for axis in (0, 1):
            gg, ww, cc = (a if axis == 0 else a.T for a in (g, w, c))
            first = _leaves(gg.sum(1), ww.sum(1), cc.sum(1), 1)
            cut = int(np.argmax(first != first[0])) if (first != first[0]).any() else 0
            out = np.zeros(gg.shape)
            for part in (slice(0, cut), slice(cut, None)):
                if len(gg[part]):
                    out[part] = _leaves(gg[part].sum(0), ww[part].sum(0), cc[part].sum(0), 1)
            gain = float((out * gg).sum() - 0.5 * (out**2 * ww).sum())
            if gain > best:
                best, chosen = gain, out if axis == 0 else out.T
        return chosen.reshape(-1)

    @staticmethod
    def bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]

    def _cell(self, bins: list[np.ndarray], i: int, j: int) -> tuple[np.ndarray, int]:
        columns = len(self.pair_edges[j]) + 1
        return bins[i] * columns + bins[j], (len(self.pair_edges[i]) + 1) * columns

    def __call__(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for b, table in zip(self.bins(x, self.edges), self.tables):
            score += table[b]
        if self.pairs:
            bins = self.bins(x, self.pair_edges)
            for i, j, table in self.pairs:
                score += table[self._cell(bins, i, j)[0]]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> AdditiveModel:
    """Fit on at most ``sample`` labelled rows outside the held-out fold."""

    def measure(batches):
        for batch in batches:
            x = [statistics(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([r.tolist() for r in x], pa.list_(pa.float64()))], names=["label", "h", "x"])

    rows = labelled_sample(docs.sparkSession, docs, labels, label, sample)
    # ``h`` fixes the order of the sums, so that reruns agree.
    rows = rows.select(F.col("text").cast("binary").alias("t"), "label", F.xxhash64("doc_id", "text").alias("h")).mapInArrow(measure, "label int, h long, x array<double>").toPandas().sort_values(["h", "label"])
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(NAMES))
    return AdditiveModel(x, (rows["label"].to_numpy(float) > 0).astype(float))


def quality_scores(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep`` (default: the id) and ``score``, the probability of label 1, for every row.

    Null and empty texts have all statistics 0 and are scored like any other; very long
    texts are measured whole; repeated rows score alike, and equal statistics give equal
    scores; without labels, or with one class only, all rows score the smoothed base
    rate; an empty table gives an empty one.  Columns of ``docs`` outside ``keep`` are
    ignored; a kept column named ``score`` is replaced by the score.
    """
    keep = [c for c in keep or [id_col] if c != "score"]
    bounded_batches(docs.sparkSession)
    # A few hundred short tables, whatever the input.
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels))

    def score(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(0).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.value(x))], names=[*keep, "score"])
        release()

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(text_col).cast("binary").alias("__sl_text"), *keep).mapInArrow(score, f"{kinds}, score double")


def op6_additive_model(spark, sf_dir: str) -> DataFrame:
    scored = quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
