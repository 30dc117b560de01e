"""Sharding by histogram sort.

Rows are ordered by (hash of the text, hash of the id).  The driver keeps a
histogram of that key space: exact bytes and rows between candidate boundaries,
summed across all partitions.  Where a cell still straddles a shard boundary by
more than the tolerance, or is too heavy for one task, new probes are laid
inside it and only its rows are counted again.  When every splitter meets the
tolerance the rows are exchanged once, by cell, and numbered inside their shard.

Only DataFrame functions run here; what reaches the driver is one row per
occupied probe interval: of the first round ``FIRST_PROBES`` at least and one per
``TASK_BYTES`` of text, ``MOST_PROBES`` at most, then ``PROBES`` per refined one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, documents, hash62, materialize

FIRST_PROBES = 4096
MOST_PROBES = 1 << 18
PROBES = 256
#: Heavier cells are cut, so that no task numbers more rows than this.
TASK_BYTES = 1 << 30
#: Bins of an interval in a cell's code.
BINS = 1 << 19
TOP = (1 << 62) - 1


@dataclass
class Interval:
    """A stretch of the key space cut by equally spaced probes."""

    lo: int
    hi: int
    text_hash: int | None  # set: the stretch lies inside one text hash, probes cut the id hash
    width: int

    @classmethod
    def over(cls, lo: int, hi: int, text_hash: int | None, probes: int) -> "Interval":
        return cls(lo, hi, text_hash, max(1, -(-(hi - lo + 1) // probes)))

    def holds(self, h, g):
        if self.text_hash is None:
            return h.between(self.lo, self.hi)
        return (h == self.text_hash) & g.between(self.lo, self.hi)


@dataclass
class Cell:
    interval: int
    bin: int
    bytes: int
    rows: int
    h: tuple[int, int]
    g: tuple[int, int]


@dataclass
class Splits:
    """Where the histogram ended: intervals, leaf cells in key order, shard of each."""

    intervals: list[Interval]
    leaves: list[Cell]
    shard_of: list[int]
    first_slot: list[int]
    total: int
    rounds: int


def _cell_of(intervals: list[Interval], h, g):
    """The leaf of a row as ``interval * BINS + bin``; later intervals lie inside earlier ones."""
    code = None
    for k, x in enumerate(intervals):
        key = "h" if x.text_hash is None else "g"
        here = F.lit(k * BINS).cast("long") + F.expr(f"(__sl_{key} - {x.lo}L) div {x.width}L")
        code = here if code is None else F.when(x.holds(h, g), here).otherwise(code)
    return code


def _count(light: DataFrame, intervals: list[Interval], new: list[int]) -> dict[int, list[Cell]]:
    """Exact bytes and rows of every occupied cell of the new intervals."""
    h, g = F.col("__sl_h"), F.col("__sl_g")
    rows = light
    if new != [0]:
        wanted = F.lit(False)
        for k in new:
            wanted = wanted | intervals[k].holds(h, g)
        rows = light.where(wanted)
    found = (
        rows.withColumn("__sl_cell", _cell_of(intervals, h, g))
        .groupBy("__sl_cell")
        .agg(F.sum("__sl_size").alias("b"), F.count("*").alias("n"), F.min("__sl_h").alias("h0"), F.max("__sl_h").alias("h1"), F.min("__sl_g").alias("g0"), F.max("__sl_g").alias("g1"))
        .collect()
    )
    out: dict[int, list[Cell]] = {k: [] for k in new}
    for r in found:
        k, b = divmod(r["__sl_cell"], BINS)
        if k in out:
            out[k].append(Cell(k, b, r["b"], r["n"], (r["h0"], r["h1"]), (r["g0"], r["g1"])))
    for cells in out.values():
        cells.sort(key=lambda c: c.bin)
    return out


def find_splitters(light: DataFrame, shards: int, tolerance: float, task_share: float) -> Splits:
    """Refine probes until each splitter is within ``tolerance`` of a shard's bytes.

    ``light`` has ``__sl_h``, ``__sl_g`` and ``__sl_size``.  A cell of one row, or of
    rows equal in both hashes, can't be cut; then the nearer of its ends is taken.
    """
    wanted = -(-(light.agg(F.sum("__sl_size")).first()[0] or 0) // TASK_BYTES)
    intervals = [Interval.over(0, TOP, None, min(max(FIRST_PROBES, 1 << wanted.bit_length()), MOST_PROBES))]
    leaves = _count(light, intervals, [0])[0]
    total, rows = sum(c.bytes for c in leaves), sum(c.rows for c in leaves)
    rounds = 1
    while True:
        slack, before, cut = tolerance * total / shards, 0, []
        for at, c in enumerate(leaves):
            after = before + c.bytes
            # The shard ends that fall inside this cell, and how far the worst is from the cell's nearer end.
            ends = [k * total / shards for k in range(before * shards // max(total, 1) + 1, -(-after * shards // max(total, 1)))]
            off = max((min(t - before, after - t) for t in ends), default=0)
            divisible = c.h[0] < c.h[1] or c.g[0] < c.g[1]
            if divisible and (off > slack or c.bytes > min(task_share * total, TASK_BYTES) or c.rows > task_share * rows):
                cut.append(at)
            before = after
        if not cut:
            break
        new = []
        for at in cut:
            c = leaves[at]
            alone = c.h[0] == c.h[1]
            new.append(len(intervals))
            intervals.append(Interval.over(*(c.g if alone else c.h), c.h[0] if alone else None, PROBES))
        counted = _count(light, intervals, new)
        for at, k in reversed(list(zip(cut, new))):
            leaves[at : at + 1] = counted[k]
        rounds += 1
    shard_of, first_slot, before, rows_in = [], [], 0, [0] * shards
    for c in leaves:
        middle = before + c.bytes / 2
        s = min(shards - 1, int(middle * shards // total)) if total else 0
        s = max(s, shard_of[-1] if shard_of else 0)
        shard_of.append(s)
        first_slot.append(rows_in[s])
        rows_in[s] += c.rows
        before += c.bytes
    return Splits(intervals, leaves, shard_of, first_slot, total, rounds)


def histogram_shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.005, task_share: float = 1 / 400, id_col: str = "doc_id", text_col: str = "text", order: tuple | None = None) -> DataFrame:
    """Add ``shard`` (0..shards-1, near equal bytes) and ``slot`` (gapless from 0) to ``docs``.

    A row weighs its text's UTF-8 bytes plus 1 (null text: 1, as an empty one).  Equal
    texts stand side by side and stay in one shard; only where all rows of one text
    weigh more than ``2 * tolerance`` of a shard may a splitter fall among them, by id.
    A very long text is one row like any other, and a shard may be off by its weight.
    Columns of ``docs`` named ``shard`` or ``slot`` are replaced; an empty table
    gives an empty result; a null id is a value like any other; rows equal in id
    and text are kept, each with its own slot, in no particular order.

    ``order``, two columns (a bucket of bounded rows, a place in it), numbers the slots of a
    shard by them instead of by key.
    """
    text, ident = F.coalesce(column(text_col), F.lit("")), column(id_col)
    keyed = {"__sl_h": hash62(text), "__sl_g": hash62(F.lit(7), ident), "__sl_size": (F.octet_length(text) + F.lit(1)).cast("long")}
    if order:
        keyed |= {"__sl_bucket": F.coalesce(order[0], F.lit(-1)).cast("long"), "__sl_place": order[1]}
    light = materialize(docs.select(*(c.alias(n) for n, c in keyed.items() if n != "__sl_place")), "shard-keys")
    found = find_splitters(light, shards, tolerance, task_share)
    spark = docs.sparkSession
    # One row per leaf cell, of three numbers; see the module's bound.
    table = spark.createDataFrame(
        [(c.interval * BINS + c.bin, s, f) for c, s, f in zip(found.leaves, found.shard_of, found.first_slot)],
        T.StructType([T.StructField("__sl_cell", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("__sl_first", T.LongType())]),
    )
    cell = _cell_of(found.intervals, F.col("__sl_h"), F.col("__sl_g"))
    rows = docs.drop("shard", "slot") if not order else docs.select("*", *(c.alias(n) for n, c in keyed.items())).drop("shard", "slot")
    rows = (rows if order else rows.withColumns(keyed)).withColumn("__sl_cell", cell)
    if not order:
        within = Window.partitionBy("__sl_cell").orderBy("__sl_h", "__sl_g", column(id_col), "__sl_size")
        numbered = rows.withColumn("__sl_n", F.row_number().over(within)).join(F.broadcast(table), "__sl_cell")
    else:
        known = F.broadcast(table.drop("__sl_first"))
        counts = light.withColumn("__sl_cell", cell).join(known, "__sl_cell").groupBy("shard", "__sl_bucket").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("shard").orderBy("__sl_bucket").rowsBetween(Window.unboundedPreceding, -1))
        firsts = counts.select("shard", "__sl_bucket", F.coalesce(before, F.lit(0)).alias("__sl_first"))
        within = Window.partitionBy("shard", "__sl_bucket").orderBy("__sl_place", "__sl_h", "__sl_g")
        numbered = rows.join(known, "__sl_cell").join(firsts, ["shard", "__sl_bucket"]).withColumn("__sl_n", F.row_number().over(within))
    out = numbered.withColumn("slot", F.col("__sl_first") + F.col("__sl_n") - 1)
    return out.select(*(column(c) for c in docs.columns if c not in ("shard", "slot")), "shard", "slot")


def op7_histogram_sort(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "text")
    return histogram_shard(docs).select(
        "doc_id", (F.col("n") + 1).cast("long").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
