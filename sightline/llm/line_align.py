"""Line dedup by pairwise alignment.

Later exact copies go first: a text that an earlier document holds too is emptied
without any alignment.  Of the other documents two overlap where they share a line hash of
a run: of consecutive lines, the shortest that starts at a given line and has
``BLOCK_WORDS`` words.  A run's later holders are each paired with the first one, so a
run in n documents makes n - 1 pairs, never all; pairs grow with the holders, so
no frequency limit is needed, and frequent passages are deleted like rare ones.  A pair's
line hashes are aligned by patience diff: lines unique in both are anchors, their
longest increasing chain is kept, and the gaps between anchors are aligned the same way.
Aligned blocks of ``BLOCK_WORDS`` words or more are deleted from the later document, and
what is left is aligned again.  A chain maximises lines, not words, so short lines can
displace a moved block: where an alignment has no long block, the lines covered by any
run that both documents hold are deleted instead, until they share none.

Only hashes are exchanged for all this; texts are joined once, with the lines to drop.
The lines of a first holder are sent to its pairs by salted keys, ``PAIRS_A_TASK`` pairs
to a key, so that one document with many later copies is no hot key.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard
from .common import WordHashes, bounded_batches, column, documents, materialize, release

BLOCK_WORDS = 50
PAIRS_A_TASK = 256

_HASHES: list[WordHashes] = []


def line_table(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash (0 for blank) and word count of each line; white space at line ends is ignored."""
    if not _HASHES:
        _HASHES.append(WordHashes(20_000))
    lines = [x.strip() for x in text.split(b"\n")]
    hashes = _HASHES[0](lines).view(np.int64).copy()
    words = np.array([len(x.split()) for x in lines], np.int32)
    hashes[words == 0] = 0
    return hashes, words


def runs_of(hashes: np.ndarray, words: np.ndarray, least: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line that starts a run of ``least`` words its shortest such run: start, end and hash."""
    total = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    starts = np.flatnonzero(words > 0)
    ends = np.searchsorted(total, total[starts] + least)
    starts, ends = starts[ends <= len(words)], ends[ends <= len(words)]
    # Blank lines have hash 0 and don't count, so they neither make nor break a run.
    filled = hashes.view(np.uint64)
    place = np.cumsum(words > 0).astype(np.uint64)
    power = np.power(np.uint64(0x9E3779B97F4A7C15), place)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(filled * power)))
    # Both ends are compared at the same power: scale by the inverse of the first one's.
    inverse = np.power(np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), place)
    x = (sums[ends] - sums[starts]) * inverse[starts]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return starts, ends, (x ^ (x >> np.uint64(29))).view(np.int64)


def run_hashes(hashes: np.ndarray, words: np.ndarray, least: int = BLOCK_WORDS) -> np.ndarray:
    """A hash per line that starts a run of ``least`` words: of its shortest such run."""
    return np.unique(runs_of(hashes, words, least)[2])


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs increasing on both sides (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[at], piles[at] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned index pairs of two sequences."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i1, j, j1 = todo.pop()
        while i < i1 and j < j1 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i1 and j < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i >= i1 or j >= j1:
            continue
        once_a: dict = {}
        for k in range(i, i1):
            once_a[a[k]] = -1 if a[k] in once_a else k
        once_b: dict = {}
        for k in range(j, j1):
            once_b[b[k]] = -1 if b[k] in once_b else k
        anchors = _chain([(k, once_b[x]) for x, k in once_a.items() if k >= 0 and once_b.get(x, -1) >= 0])
        if not anchors:
            # Lines that repeat: pair their first, second, ... occurrences.
            seen: dict = {}
            places: dict = {}
            for k in range(j, j1):
                places.setdefault(b[k], []).append(k)
            paired = []
            for k in range(i, i1):
                n = seen.get(a[k], 0)
                seen[a[k]] = n + 1
                if n < len(places.get(a[k], ())):
                    paired.append((k, places[a[k]][n]))
            out += _chain(paired)
            continue
        before = (i, j)
        for x, y in anchors:
            todo.append((before[0], x, before[1], y))
            out.append((x, y))
            before = (x + 1, y + 1)
        todo.append((before[0], i1, before[1], j1))
    return sorted(out)


def shared_runs(a: np.ndarray, b: np.ndarray, words: np.ndarray, least: int) -> list[int]:
    """Places in ``b`` covered by runs of ``least`` words that ``a`` holds too, wherever; no blank lines."""
    sizes = dict(zip(b.tolist(), words.tolist()))
    # A line that ``b`` lacks is in no shared run, whatever its size.
    starts, ends, keys = runs_of(a, np.array([sizes.get(x, 1) for x in a.tolist()], np.int32), least)
    held = {k: (i, i1) for i, i1, k in zip(starts.tolist(), ends.tolist(), keys.tolist())}
    covered = np.zeros(len(b), bool)
    for j, j1, k in zip(*(x.tolist() for x in runs_of(b, words, least))):
        if k in held and np.array_equal(a[slice(*held[k])], b[j:j1]):
            covered[j:j1] = True
    return np.flatnonzero(covered).tolist()


def common_lines(a: np.ndarray, b: np.ndarray, words: np.ndarray, least: int = BLOCK_WORDS) -> list[int]:
    """Lines of ``b`` in aligned blocks of ``least`` words or more; blank lines are passed over."""
    left, right = np.flatnonzero(a).tolist(), np.flatnonzero(b).tolist()
    one, two, sizes = a.tolist(), b.tolist(), words.tolist()
    dropped: list[int] = []
    while left and right:
        pairs = patience([one[k] for k in left], [two[k] for k in right])
        block, found, used = [], [], []
        for p in [*pairs, (-1, -1)]:
            if block and (p[0] != block[-1][0] + 1 or p[1] != block[-1][1] + 1):
                if sum(sizes[right[j]] for _, j in block) >= least:
                    found += [right[j] for _, j in block]
                    used += [j for _, j in block]
                block = []
            block.append(p)
        if not found:
            used = shared_runs(a[left], b[right], words[right], least)
            found = [right[j] for j in used]
        if not found:
            break
        dropped += found
        gone = set(used)
        # A gap stays where a block was: lines on its two sides aren't neighbours.
        right = [k for j, k in enumerate(right) if j not in gone]
    return sorted(dropped)


def dedup_lines(docs: DataFrame, least: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated blocks deleted from ``text_col``, plus ``n_lines`` and ``n_dropped``.

    The earlier document is the one with the lesser id (then the lesser text hash).  A
    block stays in its first holder.  Rows equal in id and text are one document and
    change alike; rows with null id or text, empty texts and texts below ``least`` words
    are left as they are.  A later exact copy loses all lines but blank ones.  Very long texts
    are aligned whole.  Other columns pass through (those named like the counts are
    replaced); an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                hashes, words, runs = [], [], []
                for text in piece.column(2).to_pylist():
                    h, w = line_table(text)
                    hashes.append(h), words.append(w), runs.append(run_hashes(h, w, least))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(runs, pa.list_(pa.int64()))], names=["id", "h", "lines", "words", "runs"])
        release()

    text_hash = F.xxhash64(column(text_col).cast("binary"))
    whole = docs.where(column(id_col).isNotNull() & column(text_col).isNotNull()).select(column(id_col).alias("id"), text_hash.alias("h"), column(text_col).cast("binary"))
    lines = materialize(whole.mapInArrow(scan, f"id {id_type}, h long, lines array<long>, words array<int>, runs array<long>").where(F.size("runs") > 0), "line-runs")
    # Texts held by several ids: the least keeps it.
    held = lines.select("id", "h").distinct()
    several = held.groupBy("h").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = materialize(held.join(several, "h").where(F.col("id") != F.col("least")).select("id", "h"), "line-copies")
    table = lines.join(copies, ["id", "h"], "left_anti").select(F.struct("id", "h").alias("me"), "lines", "words", "runs").dropDuplicates(["me"])
    table = materialize(table, "line-tables")
    holders = table.select("me", F.explode("runs").alias("run"))
    first = holders.groupBy("run").agg(F.min("me").alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = holders.join(first, "run").where(F.col("me") != F.col("first")).groupBy("first", "me").agg(F.max("n").alias("n"))
    pairs = materialize(pairs.withColumn("tasks", F.ceil(F.col("n") / F.lit(PAIRS_A_TASK)).cast("int")), "line-pairs")
    salts = pairs.groupBy("first").agg(F.max("tasks").alias("tasks"))
    earlier = salts.join(table.select(F.col("me").alias("first"), F.col("lines").alias("earlier")), "first").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    salted = pairs.select("first", "me", F.pmod(F.xxhash64("me"), F.col("tasks")).cast("int").alias("salt"))
    met = salted.join(table.select("me", "lines", "words"), "me").join(earlier, ["first", "salt"])

    def align(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                out = [common_lines(np.array(a, np.int64), np.array(b, np.int64), np.array(w, np.int32), least) for a, b, w in zip(*(piece.column(k).to_pylist() for k in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(out, pa.list_(pa.int32()))], names=["id", "h", "gone"])
        release()

    gone = met.select("me.id", "me.h", "earlier", "lines", "words").mapInArrow(align, f"id {id_type}, h long, gone array<int>")
    gone = gone.where(F.size("gone") > 0).groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    marks = gone.unionByName(copies.withColumn("gone", F.lit(None).cast("array<int>")))
    marks = materialize(marks.select(F.col("id").alias("__sl_id"), F.col("h").alias("__sl_h"), F.col("gone").alias("__sl_gone"), F.col("gone").isNull().alias("__sl_copy")), "line-marks")
    discard(lines, table, pairs, copies)
    rows = docs.drop("n_lines", "n_dropped").withColumn("__sl_text_hash", text_hash)
    # The same plan at every size: marks grow with the rows, so they aren't broadcast while they happen to be few.
    rows = rows.join(marks.hint("merge"), (column(id_col) == F.col("__sl_id")) & (F.col("__sl_text_hash") == F.col("__sl_h")), "left")
    split = F.split(column(text_col), "\n", -1)
    # Without the gone ones' numbers, in order; a copy keeps its blank lines.
    every = F.sequence(F.lit(0), F.size(split) - 1)
    blank = F.filter(every, lambda i: ~F.get(F.col("__sl_split"), i).rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.withColumn("__sl_split", F.when(F.col("__sl_copy").isNotNull(), split)).withColumn("__sl_left", F.when(F.col("__sl_copy"), blank).when(F.col("__sl_gone").isNotNull(), F.array_except(every, F.col("__sl_gone"))))
    left = F.array_join(F.transform("__sl_left", lambda i: F.get(F.col("__sl_split"), i)), "\n")
    n_lines = F.coalesce(F.size(split), F.lit(0)).cast("long")
    rows = rows.withColumns({"n_lines": n_lines, "n_dropped": F.when(F.col("__sl_left").isNotNull(), F.size("__sl_split") - F.size("__sl_left")).otherwise(F.lit(0)).cast("long"), text_col: F.when(F.col("__sl_left").isNull(), column(text_col)).otherwise(left)})
    return rows.drop("__sl_id", "__sl_h", "__sl_gone", "__sl_copy", "__sl_text_hash", "__sl_split", "__sl_left")


def op8_patience_lines(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
