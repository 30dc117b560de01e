from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_joins_and_search import components
from test_models_and_mixing import plain_mix, plain_targets

from sightline.llm import decontaminate, toxicity
from sightline.llm.common import documents

SF = "/root/testdata/sf0.001"


def plain_contaminated(text, items):
    """By the contract: words in a benchmark window are a twentieth of all or more."""
    words, hit = decontaminate.words_of(text.encode() if text else None), set()
    for w in items:
        for p in {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else ():
            for k in range(len(words) - len(p) + 1):
                if words[k] == p[0] and tuple(words[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_stages_and_run(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    kept = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1].withColumn("slot", kept[-1].doc_id) if k == 1 else kept[-1], SF)
        if k == 1:
            assert out.columns == [*columns, "slot"]
            out = out.drop("slot")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        kept.append(spark.createDataFrame([tuple(r) for r in out.collect()], out.schema))
    rows = [k.collect() for k in kept]
    assert len(rows[0]) > len(rows[1]) > len(rows[2]) >= len(rows[3]) > 0
    # Stage by stage against plain programs.
    toxic = {r.doc_id for r in toxicity.op9_kneser_ney(spark, SF).collect() if r.predicted}
    assert {r.doc_id for r in rows[1]} == {r.doc_id for r in rows[0]} - toxic
    assert sorted(r.doc_id for r in rows[2]) == sorted({c for _, _, c in components([(r.doc_id, r.text) for r in rows[1]])})
    items = [decontaminate.words_of((r.text or "").encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in rows[3]} == {r.doc_id for r in rows[2] if not plain_contaminated(r.text, items)}
    sizes = Counter()
    plain = [(r.doc_id, r.text, r.source) for r in rows[3]]
    for _, t, s in plain:
        sizes[s] += len((t or "").split())
    uses = Counter(r.doc_id for r in rows[4])
    words = {i: len((t or "").split()) for i, t, _ in plain}
    assert plain_mix(plain, plain_targets(sizes)) == sorted((i, n * uses[i]) for i, n in words.items())
    assert Counter(r.doc_id for r in rows[5]) == uses and all(r.position is None for r in rows[5])
    ran = corpus_pipeline.run(spark, SF)
    assert ran.columns == [*columns, "shard", "slot", "position"]
    final = ran.collect()
    assert Counter(r.doc_id for r in final) == uses and len({r.position for r in final}) == len(final)
    by_shard, shard_of = defaultdict(list), defaultdict(set)
    for r in final:
        by_shard[r.shard].append((r.slot, r.position))
        shard_of[r.text].add(r.shard)
    for slots in by_shard.values():
        slots.sort()
        assert [s for s, _ in slots] == list(range(len(slots))) and [p for _, p in slots] == sorted(p for _, p in slots)
    # Positions are those of the mix: every document's uses lie in the order that its schedule gives.
    order = [r.doc_id for r in sorted(final, key=lambda r: r.position)]
    mixed = corpus_pipeline.mix_sources(spark, kept[3], SF)
    assert order == [r.doc_id for r in mixed.collect()]


def test_empty_table(spark):
    docs = documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_odd_rows_in_every_stage(spark):
    """Null, empty, long, tied and repeated rows, and columns named like those of the operators."""
    long_text = " ".join(f"w{k % 5000}" for k in range(120_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n ", None), (4, long_text, "b"), (4, long_text, "b"), (None, "some words of a text without id", "b"), (None, None, None), (7, "one two three four five six", "a"), (8, "one two three four five six", "a")]
    docs = documents(spark, SF)
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string")
    odd = odd.select(*((F.col(c) if c in odd.columns else F.lit(None).cast(docs.schema[c].dataType)).alias(c) for c in docs.columns))
    clash = {c: F.lit(k) for k, c in enumerate(("size", "target", "positions", "n_words", "n_hit", "items", "spans", "score", "component_id", "label", "h", "word", "shard", "slot", "position", "kind", "n"))}
    odd = odd.withColumns(clash)
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd, SF)
        counts.append(out.count())
        if k < 4:
            assert out.columns == odd.columns
            first = out.select(*clash).distinct().collect()
            assert [tuple(r) for r in first] == [tuple(range(len(clash)))]
    assert counts[0] == counts[2] == counts[4] == len(rows) and counts[1] == len(rows) - 2
