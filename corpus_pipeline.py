"""A training corpus from ``documents``, in five stages.

Each stage takes what its predecessor kept, is written as Parquet and read again.
Documents judged toxic go; one document of each group of near copies stays;
contaminated documents go; the mix repeats or leaves out documents by source; the last
stage adds shard, slot and training position.

Of every stage: all columns pass through whatever their names (but for ``shard``, ``slot``
and ``position``, which the last one replaces), rows equal in all columns are treated
alike unless said otherwise, texts are read whole whatever their length, and an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import curriculum, decontaminate, jaccard, shards, toxicity
from sightline.llm.common import documents, scratch_path
from sightline.sources.scratch import discard

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below ``TOXIC``.

    Null, empty and wordless texts have no evidence: they go only if the calibration
    puts a text without evidence at ``TOXIC`` or above.  Repeated rows and equal texts
    score alike; a null id is scored like any other and has no label.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.toxicity_scores(docs, labels, keep=docs.columns, score_col="__sl_score")
    return scored.where(F.col("__sl_score") < TOXIC).drop("__sl_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies.

    Null, empty and blank texts are near copies of nothing and stay; rows equal in id and
    text stay once; of rows equal in id but not in text, those with the least id of
    their group stay each; among null ids a group keeps its rows of null id
    only if it has no other.
    """
    return jaccard.one_per_group(docs, jaccard.near_duplicates(docs)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are hit by benchmark windows for less than their share.

    Null, empty and wordless texts have no hits and stay; ids play no part, so null and
    repeated ones are kept each.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # Under names of our own, so that no column of ours meets one of theirs.
    rows = docs.select(*(F.col(c).alias(f"__sl_{c}") for c in docs.columns))
    found = decontaminate.find_benchmark(rows, benchmark.withColumnRenamed("text", "__sl_text"), text_col="__sl_text", keep=rows.columns)
    return found.where(~decontaminate.contaminated()).select(*(F.col(f"__sl_{c}").alias(c) for c in docs.columns))
    return found.where(~decontaminate.contaminated()).select("__sl_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per use, in training order: the order of files, and of rows in a file.

    Null, empty and blank texts have no words and are used 0 times; a null source is a
    source of its own; null ids come in the order of an empty id, ties by size and text.
    """
    row = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("__sl_row"))
    return curriculum.training_order(curriculum.mix(row)).select("__sl_row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``shard``, ``slot`` and ``position``; slots follow the training order inside a shard.

    ``position`` grows with the training order and has gaps: the number of the file that
    the previous stage wrote, then that of the row.  A table that isn't read from
    such files has no order; its positions are null and slots follow the key.  Null and empty texts weigh 1
    byte and stand together; null ids and repeated rows each have a slot.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return shards.histogram_shard(docs.drop("position")).withColumn("position", F.lit(None).cast("long"))
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.coalesce(F.try_to_number(F.regexp_extract(name, pattern, 1), F.lit("9999999999")), F.lit(0)).cast("long")
    file = F.call_function("shiftleft", number(r"^part-(\d+)"), F.lit(10)) + number(r"-c(\d+)\.")
    place = F.col("_metadata.row_index")
    placed = docs.select(*(c for c in docs.columns if c != "position"), file.alias("__sl_file"), place.alias("__sl_row"))
    sharded = shards.histogram_shard(placed, order=(F.col("__sl_file"), F.col("__sl_row")))
    return sharded.withColumn("position", F.call_function("shiftleft", F.col("__sl_file"), F.lit(32)) + F.col("__sl_row")).drop("__sl_file", "__sl_row")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("contamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The language models of the first stage can't be said in SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path, read = scratch_path(spark, f"pipeline-{name}"), docs
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        docs._scratch = path
        discard(read)
    return docs
