"""Benchmark decontamination by Wu-Manber multi-pattern search.

The alphabet is words.  Every benchmark item gives windows of 13 consecutive words
(or one shorter window); windows of like length are searched together.  A table over
blocks of two words says how far the search may skip; where it says 0, the block is
the suffix of some window's first ``m`` words, the bucket of that suffix and the
window's first word names the candidates, and a direct comparison confirms them.
Words absent from the benchmark never stop a skip.

A benchmark is cut into blocks of about ``BLOCK_WORDS`` words (one item more at most).
A benchmark of one block, the usual case, is broadcast and searched in one pass.  A
larger one is searched a block a pass, so that a worker holds one block at a time and the driver
two; the passes' hits, few, are joined by document at the end.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, column, documents, materialize, release

WINDOW = 13
BLOCK_WORDS = 1_000_000
#: A document is contaminated when hit words times this reach its words.
SHARE = 20

# Word bytes are 0-9, a-z and all of UTF-8 beyond ASCII; upper case folds to lower.
_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WordSearch:
    """Wu-Manber over word ids for patterns of one length class."""

    def __init__(self, patterns: list[tuple[int, ...]], base: int):
        self.m = min(map(len, patterns))
        self.b = min(2, self.m)
        self.base = base
        self.skip_all = self.m - self.b + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[tuple[int, int], list[int]] = {}
        self.patterns = patterns
        for k, p in enumerate(patterns):
            for end in range(self.b - 1, self.m):
                block = p[end] if self.b == 1 else p[end - 1] * base + p[end]
                far = self.m - 1 - end
                if far < self.shift.get(block, self.skip_all):
                    self.shift[block] = far
                if not far:
                    self.bucket.setdefault((block, p[0]), []).append(k)

    def search(self, ids: list[int]):
        """Yield (pattern, start) of every occurrence."""
        m, base, shift, skip_all, pairs, named = self.m, self.base, self.shift.get, self.skip_all, self.b == 2, self.bucket.get
        at, n = m - 1, len(ids)
        while at < n:
            block = ids[at - 1] * base + ids[at] if pairs else ids[at]
            far = shift(block, skip_all)
            if far:
                at += far
                continue
            start = at - m + 1
            for k in named((block, ids[start]), ()):
                p = self.patterns[k]
                if tuple(ids[start : start + len(p)]) == p:
                    yield k, start
            at += 1


class Matcher:
    """All windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [number(w, len(self.vocabulary) + 1) for w in words]
            for start in range(max(1, len(ids) - window + 1)):
                owners.setdefault(tuple(ids[start : start + window]), set()).add(item)
        owners.pop((), None)
        base = len(self.vocabulary) + 2
        self.classes = []
        for full in (True, False):
            patterns = [p for p in owners if (len(p) == window) == full]
            if patterns:
                self.classes.append((WordSearch(patterns, base), [owners[p] for p in patterns]))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        known = self.vocabulary.get
        # An unknown word makes every block with it unknown: no such id is ever a table key.
        unknown = -(len(self.vocabulary) + 2) ** 2
        ids = [known(w, unknown) for w in words]
        spans, items = [], set()
        for searcher, owners in self.classes:
            for k, start in searcher.search(ids):
                spans.append((start, start + len(searcher.patterns[k])))
                items |= owners[k]
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    held, size = [], 0
    for row in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("binary")).toLocalIterator():
        words = words_of(bytes(row[1]) if row[1] is not None else None)
        if words:
            held.append((row[0], words))
            size += len(words)
        if size >= block_words:
            yield held
            held, size = [], 0
    if held:
        yield held


_MATCHERS: dict = {}


def _matcher(name: str, block, window: int) -> Matcher:
    """Built once per Python worker and block; the last one only is kept."""
    key = (name, window)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(block.value, window)
    return _MATCHERS[key]


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("past", T.LongType())]))
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _SPANS)]
_ARROW_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))


def _search(rows: DataFrame, kept: int, at: int, block, window: int) -> DataFrame:
    """The first ``kept`` columns of ``rows`` and what one block finds in the text, column number ``at``."""
    names, name = rows.columns[:kept], uuid.uuid4().hex  # workers live on between queries: a block's name must be its own

    def search(batches):
        m = _matcher(name, block, window) if block is not None else None
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                piece = batch.slice(start, 512)
                counts, spans, items = [], [], []
                for text in piece.column(at).cast(pa.binary()).to_pylist():
                    words = words_of(text)
                    s, i = m.find(words) if words and m else ((), ())
                    counts.append(len(words)), spans.append(merged(s)), items.append(sorted(i))
                yield pa.RecordBatch.from_arrays(
                    [
                        *piece.columns[:kept],
                        pa.array(counts, pa.int64()),
                        pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                        pa.array(items, pa.list_(pa.string())),
                        pa.array([[{"first": a, "past": b} for a, b in s] for s in spans], _ARROW_SPANS),
                    ],
                    names=[*names, "n_words", "n_hit", "items", "spans"],
                )
        release()

    return rows.mapInArrow(search, T.StructType([*rows.schema.fields[:kept], *_FOUND]))


def _joined(spans):
    """Overlapping or touching stretches made one; ``spans`` is sorted."""
    last = lambda a: F.element_at(a, -1)
    longer = lambda a, x: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["first"].alias("first"), F.greatest(last(a)["past"], x["past"]).alias("past"))))
    return F.aggregate(spans, F.array().cast(_SPANS), lambda a, x: F.when((F.size(a) > 0) & (x["first"] <= F.try_element_at(a, F.lit(-1))["past"]), longer(a, x)).otherwise(F.concat(a, F.array(x))))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: ``id_col``), ``n_words``, ``n_hit``, ``items`` (sorted) and ``spans`` of each row of ``docs``.

    ``spans`` are the hit stretches as [first word, one past the last).  Null, empty
    and wordless texts have 0 words and no hits; very long texts are searched whole;
    null or wordless items have no windows, and items equal in id count as one; a
    window of several items names them all; repeated rows are answered each.  An empty
    benchmark hits nothing, an empty table gives an empty result.  Other columns of
    ``docs`` are ignored; names in ``keep`` that clash with the four result columns are
    an error.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = keep or [id_col]
    if clash := {"n_words", "n_hit", "items", "spans"} & set(keep):
        raise ValueError(f"columns to keep clash with results: {sorted(clash)}")
    own = text_col in keep
    rows = docs.select(*map(column, keep), *([] if own else [column(text_col).alias("__sl_text")]))
    at = keep.index(text_col) if own else len(keep)
    blocks = _blocks(benchmark, item_col, text_col, block_words)
    block, following = next(blocks, None), next(blocks, None)
    if following is None:
        return _search(rows, len(keep), at, spark.sparkContext.broadcast(block) if block else None, window)
    # Several blocks: number the rows once, search a block a pass, and put the hits together by number.
    numbered = materialize(rows.withColumn("__sl_row", F.monotonically_increasing_id()), "benchmark-documents")
    text = numbered.columns[at]
    slim, found = numbered.select("__sl_row", text), None
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        hits = materialize(_search(slim, 1, 1, shared, window).where("n_hit > 0").select("__sl_row", "items", "spans"), "benchmark-hits")
        shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
        block, following = following, next(blocks, None)
    merged_hits = found.groupBy("__sl_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _joined(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"))
    counted = _search(numbered.select("__sl_row", *(numbered.columns[: len(keep)]), *([] if own else [text])), len(keep) + 1, at + 1, None, window)
    out = counted.drop("n_hit", "items", "spans").join(merged_hits, "__sl_row", "left")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["past"] - x["first"])
    none = F.array()
    return out.select(*map(column, keep), "n_words", F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none.cast("array<string>")).alias("items"), F.coalesce("spans", none.cast(_SPANS)).alias("spans"))


def contaminated(n_hit="n_hit", n_words="n_words", share: int = SHARE):
    return (F.col(n_hit) > 0) & (F.lit(share) * F.col(n_hit) >= F.col(n_words))


def op3_wu_manber(spark, sf_dir: str) -> DataFrame:
    found = find_benchmark(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS s
       FROM (SELECT doc_id, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM t, ls WHERE len(w) >= l)),
hit AS (SELECT doc_id, item_id, i, dw.l FROM dw JOIN bw ON dw.s = bw.s AND dw.l = bw.l),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM t LEFT JOIN n ON t.doc_id = n.doc_id LEFT JOIN it ON t.doc_id = it.doc_id
"""
