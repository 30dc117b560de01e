"""Mixing sources to target weights along a time-varying curriculum.

Each source owns a share of the training tokens (``source_targets``).  Its weight
over training time ``u`` in [0, 1] is a piecewise-linear schedule.  Integrating the
schedule gives the source's cumulative token demand; a document covers a stretch of
that demand, and inverting the integral turns the stretch's middle into a training
position.  Passes over a source repeat while they fit its demand whole; of the last,
partial pass the documents that end before the demand does are used, and the gap left is
closed by the one document that comes nearest (the next one, or a later one of about the
gap's size), or by none.  A source misses its target by less than half of the next
document, and by the nearest size of a later one at most.  A document is used at most
``max_repeats`` times.  Documents are then range-sorted by position.

Order within a source is the md5 of the id, so that reruns agree.  The running token
count is a sum over (source, hash cell) totals plus a window inside one cell; cells have
about ``CELL_WORDS`` words whatever the input's size, so that a source with a third of
all rows is spread over as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, column, documents, materialize

#: Weights of the sources in code-point order, repeating.
CYCLE = (5, 2, 1)
MAX_REPEATS = 3
CELL_WORDS = 1 << 20
#: Schedules in turn, like CYCLE: (time, relative weight) knots; early, steady and late emphasis.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.6, 0.75), (1.0, 2.0)),
)


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle=CYCLE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: its size, weight, place in the order and target.

    ``sizes`` has ``source_key`` and ``source_size``.  Targets share all sizes by
    weight, stop at ``max_repeats`` times the source's size, and the excess goes to
    the others by weight until none is above: sources fill up in ascending order of
    limit over weight, which a running sum decides in one pass.
    """
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), (place % len(cycle) + 1).cast("int"))
    rows = sizes.select("source_key", "source_size", place.alias("place"), weight.alias("weight"))
    limit = F.lit(max_repeats) * F.col("source_size")
    rows = rows.withColumns({"limit": limit, "ratio": limit / F.col("weight"), "all_size": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything)})
    earlier = everything.orderBy("ratio", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("all_size") - F.coalesce(F.sum("limit").over(earlier), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    rows = rows.withColumn("full", F.col("ratio") <= level)
    left = F.col("all_size") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(everything)
    over = F.col("all_weight") - F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0.0)).over(everything)
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("weight") * left / F.when(over > 0, over))
    return rows.select("source_key", "source_size", "place", "weight", target.alias("target"))


def position_of(share, place, schedules=SCHEDULES):
    """Training time at which a source has asked for ``share`` (0..1) of its tokens."""
    out = None
    for k, knots in enumerate(schedules):
        area, pieces = 0.0, []
        for (u0, w0), (u1, w1) in zip(knots, knots[1:]):
            pieces.append((u0, u1, w0, w1, area))
            area += (w0 + w1) / 2 * (u1 - u0)
        found = F.lit(float(knots[-1][0]))
        for u0, u1, w0, w1, before in reversed(pieces):
            ask = share * area - before
            slope = (w1 - w0) / (u1 - u0)
            here = F.lit(u0) + (2 * ask / (w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * ask))))
            end = before + (w0 + w1) / 2 * (u1 - u0)
            found = F.when(share * area <= end, F.least(F.lit(u1), here)).otherwise(found)
        out = found if out is None else F.when(place % len(schedules) == k, found).otherwise(out)
    return out


def _starts(rows: DataFrame, digits: int, cells: DataFrame) -> DataFrame:
    """``rows`` with ``__sl_start``: the words of their source before them."""
    within = Window.partitionBy("__sl_source", "__sl_cell").orderBy("__sl_md5", "__sl_size", "__sl_tie")
    placed = rows.withColumn("__sl_cell", F.substring("__sl_md5", 1, digits)).join(cells, ["__sl_source", "__sl_cell"])
    start = F.col("__sl_before") + F.sum("__sl_size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sl_size")
    return placed.withColumn("__sl_start", start)


def _partial_pass(slim: DataFrame, digits: int, cells: DataFrame) -> DataFrame:
    """Of each source ``__sl_last``: the start of the document that closes the gap of its partial pass, or null.

    The documents that end by the rest of the target are used anyway.  Rows are only ever
    keyed by (source, cell); what is keyed by source are sums and the table of cells.
    """
    size, start, rest = F.col("__sl_size"), F.col("__sl_start"), F.col("__sl_rest")
    end = start + size
    filled = _starts(slim, digits, cells).groupBy("__sl_source").agg(F.max(F.when((size > 0) & (end <= rest), end)).alias("__sl_filled"))
    gap = F.col("__sl_rest") - F.coalesce(F.col("__sl_filled"), F.lit(0))
    with_gap = cells.join(filled, "__sl_source").withColumn("__sl_gap", gap).drop("__sl_filled")
    after = _starts(slim, digits, with_gap).where((size > 0) & (end > rest))
    off = F.abs(F.col("__sl_gap") - size)
    best = after.groupBy("__sl_source", "__sl_gap").agg(F.min(F.struct(off.alias("off"), start.alias("start"))).alias("best"))
    return best.select("__sl_source", F.when(F.col("best.off") < F.col("__sl_gap"), F.col("best.start")).alias("__sl_last"))


def mix(docs: DataFrame, cycle=CYCLE, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, cell_words: int = CELL_WORDS) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``times``, ``taken`` and ``positions``.

    ``times`` is how often the mix uses the document, ``taken`` the words that makes,
    ``positions`` the training time of each use.  A null source is a source of its
    own, last in order; null, empty and blank texts have size 0 and are used 0 times; very
    long texts count whole; a null id has the md5 of an empty text; rows equal in id are
    ordered by size, then text, and those equal in every column follow one another and
    are counted each; an empty table gives an empty result.  Columns of ``docs`` with
    these six names are replaced.  With ``size_col`` (words of the text, counted
    beforehand) the text isn't read.
    """
    ours = ("size", "source_size", "target", "times", "taken", "positions")
    key = F.when(column(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), column(source_col)))
    digest = F.md5(F.coalesce(column(id_col).cast("string"), F.lit("")).cast("binary"))
    # Everything that needs the text is computed before the exchange.
    size = F.coalesce(column(size_col).cast("long"), F.lit(0)) if size_col else word_count(column(text_col))
    tie = [column(text_col)] if text_col in docs.columns else []
    rows = docs.withColumns({"__sl_size": size, "__sl_source": key, "__sl_md5": digest, "__sl_tie": F.xxhash64(column(id_col), *tie)}).drop(*ours)
    slim = materialize(rows.select("__sl_source", "__sl_md5", "__sl_size", "__sl_tie"), "mix-sizes")
    words, digits = slim.agg(F.sum("__sl_size")).first()[0] or 0, 1
    while words > cell_words * 16**digits and digits < 8:
        digits += 1
    cells = slim.groupBy("__sl_source", F.substring("__sl_md5", 1, digits).alias("__sl_cell")).agg(F.sum("__sl_size").alias("__sl_in_cell"))
    before = F.sum("__sl_in_cell").over(Window.partitionBy("__sl_source").orderBy("__sl_cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cells.select("__sl_source", "__sl_cell", F.coalesce(before, F.lit(0)).alias("__sl_before"))
    sizes = cells.groupBy(F.col("__sl_source").alias("source_key")).agg(F.sum("__sl_in_cell").alias("source_size"))
    targets = source_targets(sizes, cycle, max_repeats).select(F.col("source_key").alias("__sl_source"), "source_size", "target", F.col("place").alias("__sl_place"))
    passes = F.coalesce(F.least(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(max_repeats)), F.lit(0)).cast("long")
    targets = targets.withColumn("__sl_passes", passes).withColumn("__sl_rest", F.col("target") - F.col("__sl_passes") * F.col("source_size"))
    # One row per occupied (source, cell).
    offsets = materialize(offsets.join(targets, "__sl_source"), "mix-cells")
    last = _partial_pass(slim, digits, offsets)
    placed = _starts(rows, digits, materialize(offsets.join(last, "__sl_source", "left"), "mix-cells"))
    size, start = F.col("__sl_size"), F.col("__sl_start")
    partial = (start + size <= F.col("__sl_rest")) | F.coalesce(start == F.col("__sl_last"), F.lit(False))
    times = F.when(size > 0, F.col("__sl_passes") + partial.cast("long")).otherwise(F.lit(0)).cast("int")
    # A use's place in the source's demand; the document that closes the gap comes at the demand's end.
    moved = F.col("__sl_rest") < start + size
    middle = lambda k: F.least(F.when(moved & (k == F.col("__sl_passes")), F.col("target")).otherwise(start + size / F.lit(2.0) + k * F.col("source_size")), F.col("target"))
    uses = [F.when(times > k, position_of(middle(F.lit(k)) / F.col("target"), F.col("__sl_place"), schedules)) for k in range(max_repeats)]
    spots = F.filter(F.array(*uses), lambda x: x.isNotNull())
    placed = placed.withColumns({"size": size, "times": times, "taken": size * times, "positions": spots})
    return placed.drop("__sl_size", "__sl_source", "__sl_place", "__sl_md5", "__sl_cell", "__sl_tie", "__sl_before", "__sl_start", "__sl_passes", "__sl_rest", "__sl_last")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per use of a document, with ``position``, range-sorted by it."""
    uses = mixed.withColumn("position", F.explode("positions")).drop("positions")
    return uses.repartitionByRange(F.col("position")).sortWithinPartitions("position")


def op10_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    """One row per document, in the order of its first use; unused ones come last, by id."""
    # Texts are read once, for their size.
    sized = materialize(documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("text")), "mix-documents")
    mixed = mix(sized, size_col="words")
    rows = mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.try_element_at("positions", F.lit(1)).alias("first"))
    order = [F.col("first").asc_nulls_last(), F.col("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("first")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, md5(coalesce(doc_id::VARCHAR, '')) AS m, text
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT k, source_size, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY k) - 1) % 3) + 1]::DOUBLE AS w FROM s),
r AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS t, sum(w) OVER () AS ws FROM w),
f AS (SELECT *, cap / w <= (t - coalesce(sum(cap) OVER o, 0)) / (ws - coalesce(sum(w) OVER o, 0)) AS sat
      FROM r WINDOW o AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT k, source_size, CASE WHEN sat THEN cap::DOUBLE ELSE
        w * (t - sum(CASE WHEN sat THEN cap ELSE 0 END) OVER ()) / nullif(ws - sum(CASE WHEN sat THEN w ELSE 0 END) OVER (), 0) END AS target FROM f),
p AS (SELECT d.*, source_size, target, least(floor(target / nullif(source_size, 0)), 3)::BIGINT AS passes,
      sum(size) OVER (PARTITION BY d.k ORDER BY m, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN g ON d.k = g.k),
q AS (SELECT *, target - passes * source_size AS rest FROM p),
h AS (SELECT k, any_value(rest) - coalesce(max(start + size) FILTER (start + size <= rest), 0) AS gap FROM q WHERE size > 0 GROUP BY k),
l AS (SELECT k, CASE WHEN off < gap THEN start END AS last FROM (
        SELECT q.k, gap, abs(gap - size) AS off, start, row_number() OVER (PARTITION BY q.k ORDER BY abs(gap - size), start) AS n
        FROM q JOIN h ON q.k = h.k WHERE size > 0 AND start + size > rest) WHERE n = 1)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
       (CASE WHEN size > 0 THEN size * (passes + (start + size <= rest OR coalesce(start = last, false))::INT) ELSE 0 END)::BIGINT AS taken
FROM q LEFT JOIN l ON q.k = l.k
"""
