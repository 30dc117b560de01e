"""Toxicity from class-conditional Kneser-Ney language models.

Two interpolated bigram models, toxic and ordinary, back off to class unigrams and these
to one distribution that both share.  Bigrams have raw counts (a repeated text of the
labelled sample counts once); class unigrams and the shared distribution have
Kneser-Ney continuation counts: how many distinct words precede a word, in the class
and anywhere in the corpus.  The absolute discounts of counts 1, 2 and 3 or more are
estimated, per class and order, from the counts of counts.  A document's evidence is
its length-normalised difference of log-likelihoods, and one logistic variable turns it
into a probability.

Two things are chosen by log loss on a fold that the counts don't include, from fixed
lists: how many times over the discounts are taken (``STRENGTHS``; the toxic class is
small, and an expression seen there a few times by chance must not tip the balance, so
it gets its share of the shared counts instead), and over how many of a text's words,
the most toxic ones, the difference is normalised (``SPANS``; 0: all).

The shared counts cover all documents and are exact: distinct pairs of a preceding
word's 64-bit hash and a word of the model's vocabulary (all other words are one),
packed and counted by slices of the preceding word.  A pair lies in one slice, so the
slices' counts add up, and a frequent word is spread over all of them.  The vocabulary
holds the words that keep a count in a class; of the others the shared probability is
the same on both sides and cancels.  Class counts come from at most ``SAMPLE`` labelled
documents, and so does the size of the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, bounded_batches, column, documents, fold_of, labelled_sample, materialize, release
from .decontaminate import words_of
from ..sources.scratch import discard

SAMPLE = 20_000
CALIBRATION = 6_000
CLASSES = ("ordinary", "toxic")
#: Tokens and distinct words a worker gathers before it packs their pairs, and bytes of input a slice.
GATHERED = (1 << 20, 120_000)
SLICE_BYTES = 8 << 20
#: Multiples of the discounts, of words and of bigrams (infinite: bigrams back off wholly).
STRENGTHS = (2.0, 4.0, 8.0), (2.0, 4.0, 8.0, float("inf"))
#: Numbers of words whose mean difference can be the evidence; 0: the whole text.
SPANS = (0, 16, 8, 4, 3, 2, 1)
RIDGE = 1.0

_U = np.uint64
_HASHES: list[WordHashes] = []


def hashes() -> WordHashes:
    if not _HASHES:
        _HASHES.append(WordHashes())
    return _HASHES[0]


def pair_keys(lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
    x = lefts * _U(0x9E3779B97F4A7C15) ^ rights
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class WordNumbers(dict):
    """Numbers of words in order of appearance; 0 stands for the start of a text."""

    def __init__(self):
        super().__init__({None: 0})

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found

    def hashes(self) -> np.ndarray:
        import xxhash

        return np.frombuffer(bytes(8) + b"".join(map(xxhash.xxh3_64_digest, list(self)[1:])), np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted; for large arrays sorting is faster than numpy's hash table."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1]))]


def pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress better."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def slice_bits(docs: DataFrame) -> int:
    """Of the preceding word's hash, so that slices are of like size whatever the input's size; steers cost only."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max((size // SLICE_BYTES).bit_length(), 4), 24)


def places(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of each word its place in the sorted table; the table's length where it isn't there."""
    if not len(table):
        return np.zeros(len(words), np.int64)
    at = np.searchsorted(table, words)
    return np.where(table[np.minimum(at, len(table) - 1)] == words, at, len(table))


def shared_contexts(docs: DataFrame, vocabulary: np.ndarray, text_col: str = "text") -> DataFrame:
    """``word, n``: how many distinct words (or the start) precede each word, over all rows.

    ``vocabulary`` holds sorted 64-bit hashes; ``word`` is a place in it, its length for all
    other words together.  Words that never occur have no row.
    """
    shift = _U(64 - slice_bits(docs.select(text_col)))
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def packed(numbers, words, before):
        found = numbers.hashes()
        order = np.argsort(found, kind="stable")
        rank = np.empty(len(found), np.uint64)
        rank[order] = np.arange(len(found), dtype=np.uint64)
        place = places(known.value, found).astype(np.uint64)
        codes = distinct(rank[np.concatenate(before)] << _U(32) | place[np.concatenate(words)])
        prev, word = found[order][(codes >> _U(32)).astype(np.int64)], (codes & _U(0xFFFFFFFF)).astype(np.uint32)
        part = (prev >> shift).astype(np.int32)
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        columns = [[] for _ in range(4)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            starts = np.flatnonzero(np.concatenate(([True], prev[lo + 1 : hi] != prev[lo : hi - 1])))
            steps = np.diff(word[lo:hi], prepend=np.uint32(0))
            steps[starts] = word[lo:hi][starts]
            sizes = np.diff(np.append(starts, hi - lo)).astype(np.uint32)
            for values, x in zip(columns, (int(part[lo]), pack(prev[lo:hi][starts]), pack(sizes), pack(steps))):
                values.append(x)
        for at in range(0, len(columns[0]), 256):
            yield pa.RecordBatch.from_arrays([pa.array(columns[0][at : at + 256], pa.int32()), *(pa.array(c[at : at + 256], pa.binary()) for c in columns[1:])], names=["part", "prevs", "sizes", "steps"])

    def scan(batches):
        numbers, words, before, tokens = WordNumbers(), [], [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = words_of(text)
                if not found:
                    continue
                ids = np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found))
                words.append(ids), before.append(np.concatenate((np.zeros(1, np.uint32), ids[:-1])))
                tokens += len(ids)
                if tokens >= GATHERED[0] or len(numbers) >= GATHERED[1]:
                    yield from packed(numbers, words, before)
                    numbers, words, before, tokens = WordNumbers(), [], [], 0
        if words:
            yield from packed(numbers, words, before)
        del numbers, words, before
        release()

    def count(table):
        prevs = [unpack(x, np.uint64) for x in table.column("prevs").to_pylist()]
        every = distinct(np.concatenate(prevs))
        kept, waiting, held = np.empty(0, np.uint64), [], 0
        for k, p in enumerate(prevs):
            sizes, steps = unpack(table.column("sizes")[k].as_py(), np.uint32).astype(np.int64), unpack(table.column("steps")[k].as_py(), np.uint32)
            run = np.cumsum(steps, dtype=np.uint64)
            starts = np.cumsum(sizes) - sizes
            word = run - np.repeat(run[starts] - steps[starts].astype(np.uint64), sizes)
            waiting.append(np.repeat(np.searchsorted(every, p).astype(np.uint64) << _U(32), sizes) | word)
            held += len(word)
            if held >= max(GATHERED[0], len(kept)) or k == len(prevs) - 1:
                kept, waiting, held = distinct(np.concatenate((kept, *waiting))), [], 0
        word, n = np.unique(kept & _U(0xFFFFFFFF), return_counts=True)
        return pa.table({"word": pa.array(word.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    rows = docs.select(F.col(text_col).cast("binary")).mapInArrow(scan, "part int, prevs binary, sizes binary, steps binary")
    return rows.groupBy("part").applyInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: In place of the word before the first and after the last.
START, END = 0, 1
#: Kinds of rows of ``class_counts``.
TOTALS, WORDS, BIGRAMS, LAST = range(4)


def _bigrams(lefts, rights, counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams by second, then first word, with their summed counts."""
    order = np.lexsort((lefts, rights))
    lefts, rights, counts = lefts[order], rights[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(lefts), 1), bool), (lefts[1:] != lefts[:-1]) | (rights[1:] != rights[:-1]))))
    return lefts[first], rights[first], np.add.reduceat(counts, first) if len(first) else counts


def class_counts(sample: DataFrame) -> DataFrame:
    """Counts of words and bigrams by class, of labelled ``text, label`` rows, in one table.

    ``kind, w0, w1, ordinary, toxic, raw_ordinary, raw_toxic``.  WORDS: distinct words
    before ``w1``, and raw counts; BIGRAMS: raw counts, of those found twice in a class; LAST:
    texts that end in ``w0``; TOTALS: parts of sums, ``w0`` 0 for words and 1 for bigrams,
    ``w1`` 0 for how many there are and 1 to 4 for how many have that count.  Rows
    equal in text and label count once.
    """

    def scan(batches):
        hashed, seen = hashes(), set()
        held, tokens = ([], [], []), 0

        def packed():
            lefts, rights, counts = _bigrams(*map(np.concatenate, held))
            return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (lefts, rights)), *(pa.array(counts[:, c]) for c in (0, 1))], names=["w0", "w1", *CLASSES])

        for batch in batches:
            for text, label, h in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = words_of(text)
                if not words or (h, label) in seen:
                    continue
                seen.add((h, label))
                x = np.concatenate((np.full(1, START, _U), hashed(words), np.full(1, END, _U)))
                counts = np.zeros((len(x) - 1, 2), np.int64)
                counts[:, label] = 1
                for values, new in zip(held, (x[:-1], x[1:], counts)):
                    values.append(new)
                tokens += len(words)
                if tokens >= 1 << 19:
                    yield packed()
                    held, tokens = ([], [], []), 0
        if tokens:
            yield packed()
        held = seen = None
        release()

    def tally(batches):
        parts = [[b.column(k).to_numpy() for k in range(4)] for b in batches if b.num_rows]
        if not parts:
            return
        lefts, rights, *counts = (np.concatenate(x) for x in zip(*parts))
        lefts, rights, counts = _bigrams(lefts, rights, np.stack(counts, axis=1))
        last = rights == END
        rows = [[LAST, lefts[last], rights[last], counts[last], counts[last]]]
        lefts, rights, counts = lefts[~last], rights[~last], counts[~last]
        first = np.flatnonzero(np.concatenate((np.ones(min(len(rights), 1), bool), rights[1:] != rights[:-1])))
        if len(first):
            before, raw = np.add.reduceat((counts > 0).astype(np.int64), first), np.add.reduceat(counts, first)
            keep = raw.max(axis=1) > 1
            rows.append([WORDS, lefts[first][keep], rights[first][keep], before[keep], raw[keep]])
            keep = counts.max(axis=1) > 1
            rows.append([BIGRAMS, lefts[keep], rights[keep], counts[keep], counts[keep]])
            for order, n in enumerate((before, counts)):
                sums = np.stack([(n > 0).sum(axis=0), *((n == k).sum(axis=0) for k in (1, 2, 3, 4))])
                rows.append([TOTALS, np.full(5, order), np.arange(5), sums, sums])
        for kind, w0, w1, n, raw in rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w0), kind, np.int8)), *(pa.array(x.astype(np.int64)) for x in (w0, w1, n[:, 0], n[:, 1], raw[:, 0], raw[:, 1]))], names=names)
        del parts, rows
        release()

    names = ["kind", "w0", "w1", *CLASSES, *(f"raw_{c}" for c in CLASSES)]
    rows = sample.select(F.col("text").cast("binary").alias("text"), (F.col("label") > 0).cast("int").alias("label"))
    # Equal texts meet in one partition, then all bigrams of a second word; the sample is bounded.
    rows = rows.withColumn("h", F.xxhash64("text")).repartition("h").mapInArrow(scan, "w0 long, w1 long, ordinary long, toxic long")
    return rows.repartition("w1").mapInArrow(tally, "kind tinyint, " + ", ".join(f"{c} long" for c in names[1:]))


def discounts_of(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more; 0.75 where the counts of counts are too few."""
    out = np.array([0.0, 0.75, 0.75, 0.75])
    if min(n) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        out[1:] = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k) for k in (1, 2, 3)]
    return out


def _keeps(discounts: list[np.ndarray], strength: float):
    """Rows that keep a count in a class."""
    out = F.lit(False)
    for c, d in zip(CLASSES, discounts):
        n = F.col(c)
        out = out | ((n > 1) & (n > strength * F.when(n == 2, F.lit(float(d[2]))).otherwise(F.lit(float(d[3])))))
    return out


def kept_counts(counts: np.ndarray, discounts: np.ndarray, strength: float) -> np.ndarray:
    """Counts less their discounts, 0 at least; a count of 1 keeps nothing."""
    taken = np.where(counts > 1, discounts[np.minimum(counts, 3).astype(np.int64)], 1.0) * strength
    return np.maximum(counts - taken, 0.0)


@dataclass
class Counts:
    """What both models are made of; rows of two are ordinary, toxic."""

    vocabulary: np.ndarray  #: sorted word hashes
    shared: np.ndarray  #: distinct words before each, one place more for all other words
    words: np.ndarray  #: distinct words before each, by class
    word_totals: np.ndarray  #: kinds of bigrams by class
    contexts: np.ndarray  #: sorted word hashes of the bigrams' first words
    context_totals: np.ndarray  #: bigrams that start with each, by class
    keys: np.ndarray  #: sorted keys of bigrams
    bigrams: np.ndarray  #: counts by class
    context_of: np.ndarray  #: place of each bigram's first word
    word_discounts: list
    bigram_discounts: list

    def find(self, words: np.ndarray):
        """Places of a text's words, of their contexts and of their bigrams."""
        h = np.concatenate((np.zeros(1, _U), words))
        return places(self.vocabulary, words), places(self.contexts, h[:-1]), places(self.keys, pair_keys(h[:-1], h[1:]))


def word_table(counts: Counts, strength: float) -> np.ndarray:
    """Unigram probabilities by class."""
    shared = counts.shared / max(counts.shared.sum(), 1.0)
    unigram = np.zeros((2, len(counts.vocabulary) + 1))
    for c in (0, 1):
        kept = kept_counts(counts.words[c], counts.word_discounts[c], strength)
        total = max(counts.word_totals[c], 1.0)
        unigram[c] = np.append(kept, 0.0) / total + (1.0 - kept.sum() / total) * shared
    return unigram


def bigram_tables(counts: Counts, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """By class what each context leaves to the unigrams, and the share that each bigram keeps."""
    contexts = len(counts.contexts)
    freed, seen = np.ones((2, contexts + 1)), np.zeros((2, len(counts.keys) + 1))
    for c in (0, 1):
        kept = kept_counts(counts.bigrams[c], counts.bigram_discounts[c], strength)
        n = np.maximum(counts.context_totals[c], 1.0)
        seen[c, :-1] = kept / n[counts.context_of] if len(kept) else kept
        freed[c, :-1] = np.where(counts.context_totals[c] > 0, 1.0 - np.bincount(counts.context_of, kept, contexts) / n, 1.0)
    return freed, seen


class KneserNey:
    """Both class models under given strengths of the discounts; the last place of each table stands for all others.

    ``tables``: by their strength those that other models have made, for models to share.
    """

    def __init__(self, counts: Counts, word_strength: float, bigram_strength: float, tables: dict | None = None):
        tables = {} if tables is None else tables
        for key, make in ((("words", word_strength), word_table), (("bigrams", bigram_strength), bigram_tables)):
            if key not in tables:
                tables[key] = make(counts, key[1])
        self.unigram, (self.freed, self.seen) = tables["words", word_strength], tables["bigrams", bigram_strength]

    def log_probabilities(self, found) -> np.ndarray:
        word, context, bigram = found
        return np.log(np.maximum(self.seen[:, bigram] + self.freed[:, context] * self.unigram[:, word], 1e-30))

    def evidence(self, found) -> np.ndarray:
        """Toxic minus ordinary log-probability of each word after the one before."""
        logs = self.log_probabilities(found)
        return logs[1] - logs[0]


def span_means(evidence: np.ndarray, spans=SPANS) -> list[float]:
    """Mean evidence over the whole text, or over so many of its words, the most toxic ones."""
    n = len(evidence)
    if not n:
        return [0.0] * len(spans)
    most = min(n, max(spans))
    top = np.cumsum(np.sort(np.partition(evidence, n - most)[n - most :])[::-1]) if most else None
    return [float(top[min(k, n) - 1] / min(k, n)) if k else float(evidence.mean()) for k in spans]


class Calibration:
    """A ridge logistic fit of one standardised variable, and its mean log loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        # The smoothed base rate: a quarter without labels, so that a lack of them rejects nothing.
        w = np.array([np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5)), 0.0])
        self.middle, self.scale, self.weights, self.loss = 0.0, 1.0, w, float("inf")
        if not len(y):
            return
        self.middle, self.scale = float(x.mean()), float(x.std() + 1e-9)
        z = np.stack((np.ones(len(x)), (x - self.middle) / self.scale), axis=1)
        if y.min() != y.max():
            pull = np.diag([1e-6, RIDGE])
            for _ in range(100):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + pull, z.T @ (y - p) - pull @ w)
                w = w + np.clip(step, -2, 2)
                if np.abs(step).max() < 1e-8:
                    break
        self.weights = w
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        self.loss = float(-np.log(np.where(y > 0, p, 1 - p)).mean())

    def __call__(self, x):
        """The probability, of an array or as a column."""
        slope = float(self.weights[1] / self.scale)
        z = (x - self.middle) * slope + float(self.weights[0])
        if isinstance(x, np.ndarray):
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def count_classes(docs: DataFrame, sample: DataFrame) -> Counts:
    """The counts of both models: classes from the labelled sample, the shared ones from all of ``docs``."""
    counted = materialize(class_counts(sample), "bigrams")
    of_kind = lambda kind: counted.where(F.col("kind") == kind)
    sums = {(r.w0, r.w1): [r[c] for c in CLASSES] for r in of_kind(TOTALS).groupBy("w0", "w1").agg(*(F.sum(c).alias(c) for c in CLASSES)).collect()}
    of_words, of_bigrams = ([discounts_of([sums.get((order, k), [0, 0])[c] for k in (1, 2, 3, 4)]) for c in (0, 1)] for order in (0, 1))
    # What the weakest discount takes whole in both classes is scored as if it were absent.
    words = of_kind(WORDS).where(_keeps(of_words, STRENGTHS[0][0])).select(F.col("w1").alias("word"), *CLASSES).toArrow()
    kept = of_kind(BIGRAMS).where(_keeps(of_bigrams, STRENGTHS[1][0])).select("w0", "w1", *CLASSES)
    bigrams = kept.toArrow()
    # A word starts as many bigrams as it has occurrences that don't end a text; every text starts one after the start.
    raw = [F.col(f"raw_{c}").alias(c) for c in CLASSES]
    texts = of_kind(LAST).groupBy().agg(*(F.sum(c).alias(c) for c in CLASSES)).select(F.lit(START).cast("long").alias("w0"), *CLASSES)
    starts = of_kind(WORDS).select(F.col("w1").alias("w0"), *raw).unionByName(of_kind(LAST).select("w0", *((-F.col(c)).alias(c) for c in CLASSES))).unionByName(texts)
    lefts = starts.join(kept.select("w0").distinct(), "w0", "left_semi").groupBy("w0").agg(*(F.sum(c).alias(c) for c in CLASSES)).toArrow()
    discard(counted)
    keys = lambda t, c: t[c].to_numpy().view(_U)
    both = lambda t, order: np.stack([t[c].to_numpy()[order] for c in CLASSES]).astype(float)
    vocabulary, contexts, pairs = keys(words, "word"), keys(lefts, "w0"), pair_keys(keys(bigrams, "w0"), keys(bigrams, "w1"))
    by_value = [np.argsort(x) for x in (vocabulary, contexts, pairs)]
    vocabulary, contexts, pairs = (x[o] for x, o in zip((vocabulary, contexts, pairs), by_value))
    shared = np.zeros(len(vocabulary) + 1)
    found = shared_contexts(docs, vocabulary).toArrow()
    shared[found["word"].to_numpy()] = found["n"].to_numpy()
    return Counts(
        vocabulary, shared, both(words, by_value[0]), np.array(sums.get((1, 0), [0, 0]), float), contexts, both(lefts, by_value[1]),
        pairs, both(bigrams, by_value[2]), places(contexts, keys(bigrams, "w0")[by_value[2]]), of_words, of_bigrams,
    )


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, calibration: int = CALIBRATION):
    """Fit both models; returns the broadcast counts, the strengths, the span and the calibration."""
    spark = docs.sparkSession
    bounded_batches(spark)
    counts = count_classes(docs, labelled_sample(spark, docs, labels, label, sample, (1, 2, 3)))
    choices = [(a, b) for a in STRENGTHS[0] for b in STRENGTHS[1]]
    # One broadcast: each is a file on the driver and on every executor.  Workers make the models from it.
    sent = spark.sparkContext.broadcast(counts)
    held = labelled_sample(spark, docs, labels, label, calibration, (4,))
    rows = _span_means(held.select("text", "label"), sent, choices, SPANS, ["label"]).toArrow()
    y = (rows["label"].to_numpy() > 0).astype(float)
    x = np.array(rows["__sl_x"].to_pylist(), float).reshape(len(y), len(choices), len(SPANS))
    fits = [(Calibration(x[:, i, k], y), choices[i], SPANS[k]) for i in range(len(choices)) for k in range(len(SPANS))]
    fit, strengths, span = min(fits, key=lambda f: f[0].loss)
    return sent, strengths, span, fit


def _span_means(rows: DataFrame, counts, choices, spans, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and ``__sl_x``: of the model of each choice of strengths in turn the means of ``spans``."""
    own = text_col in keep
    sent = [column(c) for c in keep] + ([] if own else [column(text_col).alias("__sl_text")])
    at = keep.index(text_col) if own else len(keep)

    def score(batches):
        hashed, c, tables = hashes(), counts.value, {}
        every = [KneserNey(c, *x, tables) for x in choices]
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                piece, x = batch.slice(start, 512), []
                for text in piece.column(at).cast(pa.binary()).to_pylist():
                    found = c.find(hashed(words)) if (words := words_of(text)) else None
                    for m in every:
                        x += span_means(m.evidence(found) if found else np.empty(0), spans)
                ends = pa.array(np.arange(piece.num_rows + 1) * len(every) * len(spans), pa.int32())
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(keep)], pa.ListArray.from_arrays(ends, pa.array(x, pa.float64()))], names=[*keep, "__sl_x"])
        hashed.clear(), tables.clear(), every.clear()
        release()

    sent_rows = rows.select(*sent)
    schema = T.StructType([*sent_rows.schema.fields[: len(keep)], T.StructField("__sl_x", T.ArrayType(T.DoubleType()))])
    return sent_rows.mapInArrow(score, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, text_col: str = "text", id_col: str = "doc_id", score_col: str = "score") -> DataFrame:
    """``keep`` (default: the id) and ``score_col``, the probability of label 1, for every row.

    Null, empty and wordless texts have no evidence and get the score of a text whose
    evidence is 0; a very long text is scored whole; repeated rows score alike, and equal
    evidence gives equal scores; an empty table gives an empty result.  Without labels, or
    with one class only, all rows score the smoothed base rate (no labels: 0.25).
    Columns of ``docs`` outside ``keep`` are ignored; a kept column of the name
    ``score_col`` is replaced by the score.
    """
    keep = [c for c in keep or [id_col] if c != score_col]
    plain = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    counts, strengths, span, fit = train(plain, labels)
    rows = _span_means(docs, counts, [strengths], (span,), keep, text_col)
    return rows.withColumn(score_col, fit(F.get("__sl_x", F.lit(0)))).drop("__sl_x")


def op9_kneser_ney(spark, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
