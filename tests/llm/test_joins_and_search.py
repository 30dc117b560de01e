import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import decontaminate, jaccard, line_align
from sightline.llm.common import documents


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def components(docs):
    """All pairs, for (id, text) rows."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(n)]
    out = [" ".join(base)]
    for e in edits:
        copy = list(base)
        for _ in range(e):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy))
    return out


def corpus():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    texts = [None, "", "  \t", "one", "One", "one two", "a b c d e", "A B C D E", "a b c d e f"]
    for n in (5, 6, 8, 9, 12, 20, 33, 40, 70, 140, 300):
        texts += family(rng, words, n, [0, 1, 1, 2, 3, max(1, n // 40), max(1, n // 25)])
    # Many copies around the threshold, so that a group falls apart into several components.
    texts += family(rng, words, 60, [rng.randrange(1, 7) for _ in range(40)])
    # A common passage in otherwise different texts.
    passage = " ".join(rng.choice(words) for _ in range(15))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60))) for _ in range(40)]
    texts += ["same text here for all of them"] * 30
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("blocks", [None, 7])
def test_join_equals_all_pairs(spark, monkeypatch, blocks):
    if blocks:  # tiny limits take every path: frequent signatures, large groups, blocks of a family, joins for texts
        for name, value in (("SMALL_GROUP", 2), ("FAMILY_BLOCK", blocks), ("HELD_SIGNATURES", 500), ("PACKED_SIGNATURES", 500), ("BITMAP_ITEMS", 1)):
            monkeypatch.setattr(jaccard, name, value)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, node string, component_id int").repartition(5)
    got = jaccard.near_duplicates(docs)
    assert sorted(tuple(r)[:3] for r in got.collect()) == components(rows)


def test_join_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(empty).count() == 0
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, None), (None, None)]
    got = sorted((tuple(r)[:3] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (None, 2, 3), (9, 0, 9), (None, 0, None)], key=str)
    docs = spark.createDataFrame([*rows, (1, "a b c d e f")], "doc_id long, text string")
    kept = jaccard.one_per_group(docs, jaccard.near_duplicates(docs))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 9, None]


@pytest.mark.parametrize("items", [0, 1 << 24])
def test_null_ids_are_linked_at_every_size(spark, monkeypatch, items):
    monkeypatch.setattr(jaccard, "BITMAP_ITEMS", items)
    words = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(words)), (7, " ".join([*words[:-1], "x"])), (8, "something else")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    labels = {r[0]: r[2] for r in got}
    assert len(got) == 3 and labels[None] == labels[7] == 7 and labels[8] == 8


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(0, 40), st.randoms(use_true_random=False))
def test_similar_sets_share_a_signature(n, extra, rng):
    """The pigeonhole bound itself, with a frequency table that reorders units."""
    universe = np.unique(np.array([rng.getrandbits(64) for _ in range(n + extra + 5)], np.uint64))
    a = universe[: n or 1]
    b = np.sort(np.concatenate((a[rng.randrange(0, max(1, n // 8) + 1) :], universe[n : n + rng.randrange(0, max(1, n // 8) + 1)])))
    if not len(b):
        return
    inside = len(np.intersect1d(a, b))
    if 4 * inside < 3 * (len(a) + len(b) - inside):
        return
    some = jaccard.signatures_of(a, (3, 4), None)[::2]
    table = jaccard.Frequent(np.unique(some), np.arange(len(np.unique(some))) % 9 + 1, np.zeros(len(np.unique(some)), np.int64))
    assert len(np.intersect1d(jaccard.signatures_of(a, (3, 4), table), jaccard.signatures_of(b, (3, 4), table)))


def plain_hits(text, items, window=13):
    words = decontaminate.words_of(text.encode() if text else None)
    hit, found = set(), set()
    for item, t in items:
        w = decontaminate.words_of(t.encode() if t else None)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            p = w[s : s + window]
            for k in range(len(words) - len(p) + 1):
                if words[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_search_equals_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["a", "b", "c", "Der", "é", "x1"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([1, 2, 3, 5, 12, 13, 14, 20, 30, 40])] + [(50, None), (51, " ,. "), (7, "q r s")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [None, "", "!!", "A" * 3000, f"x {items[8][1].upper()}! {items[9][1]}", items[7][1].replace(" ", "-")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for benchmark in ([i for i in items if not i[1] or len(i[1].split()) >= 12], items):
        bench = spark.createDataFrame(benchmark, "item_id long, text string")
        for block in (1, 10_000):
            got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in decontaminate.find_benchmark(docs, bench, block_words=block).collect()}
            assert got == {k: plain_hits(t, benchmark) for k, t in enumerate(texts)}
    none = decontaminate.find_benchmark(docs, bench.limit(0)).agg({"n_hit": "sum"}).first()[0]
    assert none == 0 and decontaminate.find_benchmark(docs.limit(0), bench).count() == 0
    with pytest.raises(ValueError):
        decontaminate.find_benchmark(docs.withColumnRenamed("doc_id", "n_hit"), bench, id_col="n_hit")


def test_query_digest(spark):
    row = next(r for r in spark_query(spark, "op3_wu_manber") if r.n_items)
    assert len(row.items_sha256) == 64 and row.contaminated == (20 * row.n_hit >= row.n_words)
    blank = next(r for r in spark_query(spark, "op3_wu_manber") if not r.n_items)
    assert blank.items_sha256 == hashlib.sha256(b"").hexdigest()


def spark_query(spark, name):
    from sightline.llm.queries import queries

    return queries()[name](spark, "/root/testdata/sf0.001").collect()


def test_line_alignment_against_runs(spark):
    rng = random.Random(6)
    line = lambda n=9: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    block, other = [line(20) for _ in range(3)], [line(60)]
    texts = ["\n".join([line(), *block, line()]), "\n".join([line(), line(), *block]), "\n".join([*other, line(), *block, line(), *other]), "\n".join([*block[:2], line()]), "\n".join(["", *block[:1], "", *block[1:]])]
    texts += [texts[0], None, "", "short"]
    rows = list(enumerate(texts))
    out = {r.doc_id: r for r in line_align.dedup_lines(spark.createDataFrame([(i, t, i) for i, t in rows] + [(0, texts[0], 0), (None, texts[0], 9)], "doc_id long, text string, lines int").repartition(4)).collect()}
    assert out[0].text == texts[0] and out[0].n_dropped == 0
    assert out[1].text == "\n".join(texts[1].split("\n")[:2])
    assert out[2].text == "\n".join([other[0], *(x for x in texts[2].split("\n")[1:] if x not in block)])  # a first holder keeps its own repeats
    assert out[3].text == texts[3] and out[3].n_dropped == 0  # 40 words are below the limit
    assert out[4].text.strip() == "" and out[4].n_dropped == 3
    assert out[5].text == "" and out[6].text is None and out[7].text == "" and out[8].text == "short"
    assert out[None].text == texts[0]
    assert line_align.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_patience_gives_a_common_subsequence(a, b):
    pairs = line_align.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    if a == b:
        assert len(pairs) == len(a)


def test_crossed_short_lines_do_not_hide_a_passage():
    p, q, s, r = [[(k, 30), (k + 1, 30)] for k in (10, 20)] + [[(1, 2)], [(2, 3)]]
    cases = [
        ([(10, 60)] + s, s + [(10, 60)], [1]),
        (p + s + r + [(3, 1)], s + r + [(3, 1)] + p, [3, 4]),  # three short lines outweigh two long ones
        (p + s + q, q + s + p, [0, 1, 3, 4]),
        (p + s + r, s + p[:1] + r + p[1:], []),  # the halves aren't neighbours
        (p + s + p, s + p + s + p, [1, 2, 3, 4, 5]),
    ]
    for a, b, gone in cases:
        hashes, other = (np.array([x for x, _ in side], np.int64) for side in (a, b))
        assert line_align.common_lines(hashes, other, np.array([n for _, n in b], np.int32)) == gone


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=14), st.lists(st.integers(1, 6), max_size=14))
def test_no_common_run_is_left(a, b):
    size = lambda side: np.array([9 * x for x in side], np.int32)
    gone = line_align.common_lines(np.array(a, np.int64), np.array(b, np.int64), size(b))
    left = [x for k, x in enumerate(b) if k not in gone]
    runs = [set(line_align.run_hashes(np.array(side, np.int64), size(side)).tolist()) for side in (a, left)]
    assert not runs[0] & runs[1]


def test_no_run_is_left_on_the_test_table(spark):
    out = line_align.dedup_lines(documents(spark, "/root/testdata/sf0.001").select("doc_id", "text")).orderBy("doc_id").collect()
    seen = {}
    for r in out:
        for x in line_align.run_hashes(*line_align.line_table(r.text.encode())).tolist():
            assert seen.setdefault(x, r.doc_id) == r.doc_id


def plain_dedup(rows, least=50):
    """Each document's kept text, by a loop over earlier holders of whole runs of lines."""
    lines = {i: [x.strip() for x in t.split("\n")] for i, t in rows}

    def runs(i):
        out, full = {}, [k for k, x in enumerate(lines[i]) if x.split()]
        for a in range(len(full)):
            n = 0
            for b in range(a, len(full)):
                n += len(lines[i][full[b]].split())
                if n >= least:
                    out.setdefault(tuple(lines[i][k] for k in full[a : b + 1]), None)
                    break
        return set(out)

    found, texts, first, kept = {i: runs(i) for i, _ in rows}, {}, {}, {}
    for i, t in sorted(rows):
        texts.setdefault(t, i)
    originals = [i for i, t in sorted(rows) if texts[t] == i or not found[i]]
    for i in originals:
        for r in found[i]:
            first.setdefault(r, i)
    number = {x: k for k, x in enumerate(sorted({x for v in lines.values() for x in v if x.split()}), 1)}
    coded = {i: np.array([number.get(x, 0) for x in v], np.int64) for i, v in lines.items()}
    for i, t in rows:
        if i not in originals:
            gone = {k for k, x in enumerate(lines[i]) if x.split()}
        else:
            words = np.array([len(x.split()) for x in lines[i]], np.int32)
            gone = set()
            for other in {first[r] for r in found[i]} - {i}:
                gone |= set(line_align.common_lines(coded[other], coded[i], words, least))
        kept[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return kept


def test_line_dedup_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(line_align, "PAIRS_A_TASK", 3)
    rng = random.Random(11)
    line = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    passages = [[line(rng.randrange(5, 30)) for _ in range(6)] for _ in range(5)]
    rows = []
    for k in range(120):
        parts = [line(rng.randrange(1, 20)) for _ in range(rng.randrange(1, 5))]
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = p if rng.random() < 0.6 else p[: rng.randrange(1, 6)] + [""] + p[3:]
        rows.append((k, "\n".join(parts)))
    rows += [(200 + k, rows[k % 7][1]) for k in range(30)] + [(300, ""), (301, "\n\n"), (302, line(3)), (303, line(3))]
    rng.shuffle(rows)
    got = line_align.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {r.doc_id: r.text for r in got} == plain_dedup(rows)
    texts = dict(rows)
    assert all(r.n_lines == len(texts[r.doc_id].split("\n")) and (r.n_dropped > 0) == (r.text != texts[r.doc_id]) for r in got)
