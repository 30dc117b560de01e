import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import curriculum, pseudonyms, quality, shards, toxicity
from sightline.llm.common import labelled_sample


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.binary(max_size=8), st.data())
def test_feistel_is_a_permutation(n, key, data):
    f = pseudonyms.Feistel(key, "t", n)
    x = data.draw(st.integers(0, n - 1))
    assert 0 <= f.forward(x) < n and f.backward(f.forward(x)) == x


def test_feistel_reaches_everything():
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(map(pseudonyms.Feistel(b"k", "t", n).forward, range(n))) == list(range(n))


VALID = {
    "card": ["4111 1111 1111 1111", "4952935900253052", "378282246310005"], "phone": ["+1 (974) 555-3436", "212-555-0100"], "ip": ["169.122.221.182", "0.0.0.0"],
    "ssn": ["123-45-6789", "665-01-0001"], "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"], "email": ["the.72@mail3.example.com"],
    "date": ["2021-02-28", "31.12.1999", "3/4/2020", "05/13/2001"],
}
INVALID = ["4111-1111-1111-1112", "999.1.1.1", "000-12-3456", "666-12-3456", "DE88370400440532013000", "2021-02-30", "2/30/2020", "1.2.3.4.5", "1850-01-01", "(012) 555-0100", "token = 4111111111111111a"]


@pytest.mark.parametrize("kind", VALID)
def test_formats_stay_valid_and_reversible(kind):
    hide, show = pseudonyms.Pseudonyms(b"secret"), pseudonyms.Pseudonyms(b"secret", True)
    for value in VALID[kind]:
        text, found = hide(f"see {value}, and {value}!! end")
        assert found == {kind: 2} and value not in text
        first, second = re.fullmatch(r"see (.+), and (.+)!! end", text).groups()
        digits = r"\d+" if kind == "ip" else r"\d"  # octets have no fixed width
        shape = lambda v: re.sub(digits, "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", v)))  # noqa: E731,B023
        assert first == second and shape(first) == shape(value)
        again, refound = hide(first)  # a pseudonym is itself a valid value
        assert refound == {kind: 1}
        assert show(text)[0] == f"see {value}, and {value}!! end"
        assert pseudonyms.Pseudonyms(b"other")(value)[0] != hide(value)[0]


def test_invalid_values_stay():
    for text in INVALID:
        assert pseudonyms.Pseudonyms(b"secret")(text) == (text, {})


def test_pseudonyms_link_documents(spark):
    card = VALID["card"][1]
    rows = [(1, f"a {card}", "x"), (2, f"{card} b", "y"), (2, f"{card} b", "y"), (3, None, None), (4, "", "z"), (5, "x" * 50_000 + " " + card, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_card string").repartition(3)
    out = pseudonyms.pseudonymise(docs, b"secret")
    got = [(r.doc_id, r.text, r.n_card) for r in out.orderBy("doc_id").collect()]
    new = got[0][1][2:]
    assert new != card and pseudonyms.luhn(new[:-1]) == int(new[-1])
    assert got == [(1, f"a {new}", 1), (2, f"{new} b", 1), (2, f"{new} b", 1), (3, None, 0), (4, "", 0), (5, "x" * 50_000 + " " + new, 1)]
    assert pseudonyms.pseudonymise(docs.limit(0)).count() == 0
    back = pseudonyms.pseudonymise(out.select("doc_id", "text"), b"secret", restore=True)
    assert {r.text for r in back.collect()} == {r[1] for r in rows}


def shard_rows(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(4)
    out = shards.histogram_shard(docs, **options).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.text) for r in out) == Counter((a, b) for a, b, _ in rows)
    return out


def weights(out):
    size = Counter()
    for r in out:
        size[r.shard] += len((r.text or "").encode()) + 1
    return size


def test_shards_near_equal(spark):
    rng = random.Random(1)
    rows = [(k, "x" * rng.randrange(200) + str(k), None) for k in range(3000)]
    size = weights(shard_rows(spark, rows))
    mean = sum(size.values()) / 16
    assert len(size) == 16 and all(abs(s - mean) <= 0.005 * mean + 2 * 205 for s in size.values())


def test_shards_with_a_hot_text_ties_and_nulls(spark):
    hot = [(k, "the same text", "s") for k in range(1500)] + [(7, "the same text", "s")] * 5
    rows = hot + [(k, f"other {k}", None) for k in range(1500)] + [(None, None, None), (None, "", None), (None, "n", "q")]
    size = weights(shard_rows(spark, rows, shards=8))
    mean = sum(size.values()) / 8
    assert len(size) == 8 and all(abs(s - mean) <= 0.005 * mean + 150 for s in size.values())


def test_small_groups_stay_together_and_edges(spark):
    rows = [(k, f"text {k // 4}", None) for k in range(2000)]
    groups = defaultdict(set)
    for r in shard_rows(spark, rows, tolerance=0.05, task_share=0.05):
        groups[r.text].add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) <= 15
    assert shard_rows(spark, []) == []
    assert len(shard_rows(spark, [(1, "alone", None)])) == 1
    assert len(shard_rows(spark, [(1, "twice", None)] * 2, shards=1)) == 2


def plain_targets(sizes, cycle=(5, 2, 1)):
    weight = {k: cycle[n % 3] for n, k in enumerate(sorted(sizes, key=lambda k: (k is None, (k or "").encode())))}
    left, open_, target = float(sum(sizes.values())), set(sizes), {}
    while open_:
        share = {k: left * weight[k] / sum(weight[j] for j in open_) for k in open_}
        over = {k for k in open_ if share[k] >= 3 * sizes[k]}
        if not over:
            return target | share
        for k in over:
            target[k] = 3.0 * sizes[k]
            left -= target[k]
        open_ -= over
    return target


def plain_mix(rows, targets):
    """(id, words taken) of every row, one source after the other, in md5 order."""
    out = []
    for source in {r[2] for r in rows}:
        own = sorted(((hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest(), len((r[1] or "").split()), r[0] or 0) for r in rows if r[2] == source))
        total = sum(n for _, n, _ in own)
        passes = min(int(targets[source] // total), 3) if total else 0
        rest, extra, at = targets[source] - passes * total, set(), 0
        later = []
        for k, (_, n, _) in enumerate(own):
            if n and at + n <= rest:
                extra.add(k)
            elif n:
                later.append((k, n))
            at += n
        gap = rest - sum(own[k][1] for k in extra)
        if later:
            k, n = min(later, key=lambda x: (abs(gap - x[1]), x[0]))
            if abs(gap - n) < gap:
                extra.add(k)
        out += [(i, n * (passes + (k in extra)) if n else 0) for k, (_, n, i) in enumerate(own)]
    return sorted(out)


def test_mix_targets_and_repeats(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randrange(1, 30), rng.choice(["b", "b", "b", "a", "Z", "é", None, ""]), k) for k in range(900)]
    rows += [(5000, "w " * 40, "tiny", 0), (5001, None, "tiny", 0), (5002, " ", "tiny", 0), (None, "w w", "a", 0)] + [(6000, "same", "a", 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = curriculum.mix(docs).collect()
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want, taken = plain_targets(sizes), Counter()
    for r in out:
        assert r.size == len((r.text or "").split()) and r.taken == r.times * r.size <= 3 * r.size and len(r.positions) == r.times
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
        taken[r.source] += r.taken
    # A later document of about its size closes the gap.
    assert all(abs(taken[s] - want[s]) <= 3 for s in sizes), sorted((str(s), taken[s], want[s], n) for s, n in sizes.items())
    assert sorted((r.doc_id or 0, r.taken) for r in out) == plain_mix(rows, want)
    assert sorted(map(str, out)) == sorted(map(str, curriculum.mix(docs, cell_words=50).collect()))
    assert sorted(map(str, out)) == sorted(map(str, curriculum.mix(docs.repartition(7)).collect()))
    assert curriculum.mix(docs.limit(0)).count() == 0
    order = [r.position for r in curriculum.training_order(curriculum.mix(docs)).collect()]
    assert order == sorted(order) and len(order) == sum(r.times for r in out)


def test_positions_follow_the_schedule(spark):
    from pyspark.sql import functions as F

    for k, knots in enumerate(curriculum.SCHEDULES):
        area = sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in zip(knots, knots[1:]))
        times = np.linspace(0, 1, 41)
        fine = np.linspace(0, 1, 100_001)
        demand = np.concatenate(([0], np.cumsum(np.interp((fine[1:] + fine[:-1]) / 2, *zip(*knots)) / 100_000))) / area
        rows = spark.createDataFrame([(float(t), float(np.interp(t, fine, demand))) for t in times], "t double, share double")
        got = rows.select("t", curriculum.position_of(F.col("share"), F.lit(k)).alias("p")).collect()
        assert all(abs(r.t - r.p) < 1e-3 for r in got)


def labelled(spark, n=700):
    """Toxic documents hold two of a few rude words; poor ones are full of symbols."""
    rng = random.Random(9)
    words, rude = [f"w{k}" for k in range(300)], [f"rude{k}" for k in range(6)]
    docs, labels = [], []
    for k in range(n):
        toxic, poor = rng.random() < 0.3, rng.random() < 0.3
        t = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        for _ in range(3 * toxic):
            t.insert(rng.randrange(len(t)), rng.choice(rude))
        docs.append((k, " ".join(f"{w}##" if poor and rng.random() < 0.5 else w for w in t) + ".", "en"))
        labels.append((k, int(not poor), int(toxic)))
    docs += [(n, None, "en"), (n + 1, "", "en"), (n + 2, "one", None), (n + 2, "one", None), (None, "w1 w2", "de"), (n + 3, "w1 " * 40_000, "en")]
    labels += [(0, *labels[0][1:]), (None, 1, 1), (n, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def accuracy(rows, labels, column, threshold):
    truth = {r[0]: r[column] for r in labels if r[0] is not None and r[column] is not None}
    held = [(truth[r.doc_id], r.score >= threshold) for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80
    return sum(a == b for a, b in held) / len(held)


@pytest.mark.parametrize("score, column, threshold", [(toxicity.toxicity_scores, 2, 0.5), (quality.quality_scores, 1, 0.3)])
def test_classifiers_on_the_held_out_fold(spark, score, column, threshold):
    docs, table, labels = labelled(spark)
    rows = score(docs, table).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, labels, column, threshold) > 0.93
    again = {str(r.doc_id): r.score for r in score(docs.repartition(2), table).collect()}
    assert all(again[str(r.doc_id)] == pytest.approx(r.score, abs=1e-9) for r in rows)


def test_shared_contexts_are_exact(spark):
    rng = random.Random(12)
    texts = [" ".join(f"p{rng.randrange(9000)} the" for _ in range(900)) + f" only{k} x" for k in range(12)] + [None, "", "the", "The the"]
    known = ["the", "x", "never", "p7", "p8"]
    hashed = toxicity.hashes()([w.encode() for w in known])
    vocabulary = np.sort(hashed)
    preceding = defaultdict(set)
    for text in texts:
        before = None
        for w in (text or "").lower().split():
            preceding[w if w in known else None].add(before)
            before = w
    assert len(preceding["the"]) > 5000 and len(preceding[None]) > 1
    place = dict(zip(known, np.searchsorted(vocabulary, hashed).tolist())) | {None: len(known)}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for some in (docs.repartition(5), docs.repartition(1)):
        got = {r.word: r.n for r in toxicity.shared_contexts(some, vocabulary).collect()}
        assert got == {place[w]: len(p) for w, p in preceding.items()}
    assert toxicity.shared_contexts(docs.limit(0), vocabulary).count() == 0
    assert [(r.word, r.n) for r in toxicity.shared_contexts(docs, np.empty(0, np.uint64)).collect()] == [(0, len(set().union(*preceding.values())))]


@pytest.mark.parametrize("strengths", [(2.0, 2.0), (4.0, 2.0), (2.0, float("inf"))])
def test_kneser_ney_against_brute_force(spark, strengths):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    texts = [" ".join(words[k * 40 : k * 40 + 40]) for k in range(100)]
    rows = [(t, int(k % 3 == 0)) for k, t in enumerate(texts)] + [(texts[0], 1)] * 5 + [(None, 1), ("", 0)]
    everything = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)] + [(1000, "w1 w3 new words w1 w9 w1")], "doc_id long, text string")
    counts = toxicity.count_classes(everything, spark.createDataFrame(rows, "text string, label int").repartition(3))
    model = toxicity.KneserNey(counts, *strengths)
    # Plainly, with dictionaries and words.
    pairs = [Counter(), Counter()]
    for t, y in set(rows):
        w = (t or "").split()
        pairs[y].update(zip([None, *w], w))
    corpus = {(a, b) for t in [*texts, "w1 w3 new words w1 w9 w1"] for a, b in zip([None, *t.split()], t.split())}
    discount = lambda n: lambda k: toxicity.discounts_of([sum(v == i for v in n.values()) for i in (1, 2, 3, 4)])[min(k, 3)]
    preceded = [Counter(b for _, b in p) for p in pairs]
    kept = lambda n, strength: {w: max(k - strength * discount(n)(k), 0.0) if k > 1 and strength < 1e9 else 0.0 for w, k in n.items()}
    of_words, of_pairs = [kept(n, strengths[0]) for n in preceded], [kept(n, strengths[1]) for n in pairs]
    weakest = [kept(n, 2.0) for n in preceded]
    vocabulary = {w for n in weakest for w, k in n.items() if k > 0}
    named = lambda w: w if w in vocabulary else None
    before = defaultdict(set)
    for a, b in corpus:
        before[named(b)].add(a)
    shared = {w: len(x) / sum(map(len, before.values())) for w, x in before.items()}

    def probability(c, a, b):
        n = sum(preceded[c].values())
        p = (of_words[c].get(b, 0.0) if b in vocabulary else 0.0) / n + (1 - sum(of_words[c].values()) / n) * shared[named(b)]
        h = sum(k for (x, _), k in pairs[c].items() if x == a)
        if not h:
            return p
        held = {y: k for (x, y), k in of_pairs[c].items() if x == a}
        return held.get(b, 0.0) / h + (1 - sum(held.values()) / h) * p

    text = "w1 w2 w1 unseen w3 w1 w1 w40 new w2 w2".split()
    found = counts.find(toxicity.hashes()([w.encode() for w in text]))
    want = [[math.log(probability(c, a, b)) for a, b in zip([None, *text], text)] for c in (0, 1)]
    got = model.log_probabilities(found)
    assert np.allclose(got, want, atol=1e-9) and np.allclose(model.evidence(found), np.subtract(want[1], want[0]), atol=1e-9)
    # Each class distributes one over the vocabulary and the other words, after any word; others can have counts of their own after it.
    others = {b for p in pairs for _, b in p} - vocabulary
    whole = lambda c, a: sum(probability(c, a, b) for b in [*vocabulary, "other"]) + sum(probability(c, a, b) - probability(c, a, "other") for b in others)
    assert all(whole(c, a) == pytest.approx(1) for c in (0, 1) for a in (None, "w1", "other"))


def test_models_share_tables_and_one_broadcast(spark, monkeypatch):
    docs, table, _ = labelled(spark, 60)
    sent = []
    real = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or real(self, value))
    assert toxicity.toxicity_scores(docs, table).count() == docs.count()
    # The vocabulary and the counts; each broadcast is a file on every executor, and twelve models were most of the disk.
    assert [type(x) for x in sent] == [np.ndarray, toxicity.Counts]
    counts, tables = sent[1], {}
    for strengths in [(a, b) for a in toxicity.STRENGTHS[0] for b in toxicity.STRENGTHS[1]]:
        one, shared = toxicity.KneserNey(counts, *strengths), toxicity.KneserNey(counts, *strengths, tables)
        assert all(np.array_equal(getattr(one, k), getattr(shared, k)) for k in ("unigram", "freed", "seen"))
    assert len(tables) == len(toxicity.STRENGTHS[0]) + len(toxicity.STRENGTHS[1])


def test_spans():
    x = np.array([3.0, -1.0, 1.0, 1.0])
    assert toxicity.span_means(x, (0, 1, 2, 16)) == [1.0, 3.0, 2.0, 1.0] and toxicity.span_means(x[:0], (0, 3)) == [0.0, 0.0]


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality.quality_scores])
def test_classifiers_without_two_classes(spark, score):
    docs, table, _ = labelled(spark, 60)
    for some in (table.limit(0), table.where("quality = 1 and toxic = 0")):
        assert all(0 <= r.score <= 1 for r in score(docs, some).collect())
    assert score(docs.limit(0), table).count() == 0


def plain_statistics(text):
    """The features by their names, with plain loops over the decoded bytes."""
    data, words, lines = text, text.split(), text.split(b"\n")
    n, k, full = len(data), max(1, len(text.split())), [x for x in text.split(b"\n") if x]
    share = lambda keep: sum(map(keep, data)) / n
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / len(lengths)
    punctuation, symbols = b".,;:?!'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~"
    return {
        "log_words": math.log1p(len(words)), "log_lines": math.log1p(len(lines)), "word_length": mean, "word_length_spread": (sum((x - mean) ** 2 for x in lengths) / len(lengths)) ** 0.5,
        "upper": share(lambda b: 65 <= b <= 90), "digits": share(lambda b: 48 <= b <= 57), "spaces": share(lambda b: b in b"\t\n\x0b\x0c\r "), "punctuation": share(lambda b: b in punctuation),
        "symbols": share(lambda b: b in symbols), "pipes": share(lambda b: b == 124), "exclamations": share(lambda b: b == 33), "non_ascii": share(lambda b: b > 127),
        "distinct_words": len(set(words)) / k, "top_word": max(Counter(words).values(), default=0) / k, "repeated_bigrams": 1 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1),
        "short_words": sum(x <= 3 for x in lengths) / len(lengths), "capitalised": sum(65 <= w[0] <= 90 for w in words) / k, "ends_in_stop": sum(x.endswith((b".", b"!", b"?")) for x in full) / max(1, len(full)),
        "line_words": math.log1p(k / max(1, len(full))), "repeated_lines": 1 - len(set(full)) / max(1, len(full)), "stops_per_word": data.count(b".") / k, "commas_per_word": data.count(b",") / k,
        "compressed": len(zlib.compress(data, 1)) / n, "longest_word": math.log1p(max(lengths)), "symbol_ended": sum(w[-1] in symbols for w in words) / k,
    }


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aB1 \n\t.,!?|#é$", min_size=1, max_size=60))
def test_statistics_against_plain_loops(text):
    want = plain_statistics(text.encode())
    assert list(want) == list(quality.NAMES) and np.allclose(quality.statistics(text.encode()), list(want.values()))


def test_additive_model_against_plain_sums():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.AdditiveModel(x, y)
    got, parts = model(x), []
    for row in x:
        total = model.base + sum(table[sum(e < v for e in edges)] for v, edges, table in zip(row, model.edges, model.tables))
        for i, j, table in model.pairs:
            at = [sum(e < row[k] for e in model.pair_edges[k]) for k in (i, j)]
            total += table[at[0] * (len(model.pair_edges[j]) + 1) + at[1]]
        parts.append(1 / (1 + math.exp(-total)))
    assert np.allclose(got, parts) and ((got > 0.5) == (y > 0)).mean() > 0.95
    # The first cut of a tree is the best of all cuts.
    g, w, c = rng.normal(size=12), rng.uniform(5, 9, 12), np.full(12, 20)
    tree = quality._leaves(g, w, c, 1)
    gain = lambda k: g[:k].sum() ** 2 / (w[:k].sum() + quality.PULL) + g[k:].sum() ** 2 / (w[k:].sum() + quality.PULL)
    k = max(range(1, 12), key=gain)
    want = np.repeat([g[:k].sum() / (w[:k].sum() + quality.PULL), g[k:].sum() / (w[k:].sum() + quality.PULL)], [k, 12 - k])
    assert np.allclose(tree, want)


def luhn(digits):
    total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def test_pseudonyms_against_plain_checks(spark):
    """Planted values in many texts: the rest stays, values stay valid, and the mapping is one to one."""
    import datetime

    rng, values = random.Random(8), {"card": [], "date": [], "ssn": []}
    for _ in range(40):
        d = [4, *(rng.randrange(10) for _ in range(14))]
        values["card"].append("".join(map(str, [*d, next(x for x in range(10) if luhn([*d, x]))])))
        values["date"].append((datetime.date(1990, 1, 1) + datetime.timedelta(rng.randrange(12000))).isoformat())
        values["ssn"].append(f"{rng.randrange(100, 600):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}")
    rows, planted = [], []
    for k in range(300):
        kind = rng.choice(list(values))
        value, left, right = rng.choice(values[kind]), f"about {k} words ", f" and {k} more"
        planted.append((kind, value, left, right))
        rows.append((k, left + value + right, -1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_replaced int").repartition(5)
    out = {r.doc_id: r for r in pseudonyms.pseudonymise(docs, b"secret").collect()}
    mapped = {}
    for k, (kind, value, left, right) in enumerate(planted):
        text = out[k].text
        assert text.startswith(left) and text.endswith(right) and out[k].n_replaced == out[k][f"n_{kind}"] == 1
        new = text[len(left) : len(text) - len(right)]
        assert mapped.setdefault((kind, value), new) == new and new != value
        if kind == "card":
            assert len(new) == 16 and new[0] == value[0] and luhn([int(x) for x in new])
        elif kind == "date":
            assert datetime.date.fromisoformat(new)
        else:
            assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", new)
    assert len(set(mapped.values())) == len(mapped)
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymise(spark.createDataFrame([(k, r.text) for k, r in out.items()], "doc_id long, text string"), b"secret", restore=True).collect()}
    assert back == {k: t for k, t, _ in rows}


def test_shards_against_a_plain_sort(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(k, f"text {rng.randrange(900)} " * rng.randrange(1, 9)) for k in range(2500)] + [(k, "hot " * 30) for k in range(9000, 9600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = {r.doc_id: (r.h, r.g) for r in docs.select("doc_id", shards.hash62(F.col("text")).alias("h"), shards.hash62(F.lit(7), F.col("doc_id")).alias("g")).collect()}
    got = sorted(shards.histogram_shard(docs, 16).collect(), key=lambda r: keyed[r.doc_id])
    total = sum(len(t) + 1 for _, t in rows)
    # In key order shards don't fall, and slots count from 0 in each.
    at, before, place = 0, 0, Counter()
    for r in got:
        assert r.shard >= at and r.slot == place[r.shard]
        at = r.shard
        place[r.shard] += 1
        before += len(r.text) + 1
        assert abs(before - (r.shard + 0.5) * total / 16) <= (0.5 + 0.01) * total / 16 + 400
    parted = defaultdict(set)
    for r in got:
        parted[r.text].add(r.shard)
    weight = Counter(t for _, t in rows)
    assert all(len(s) == 1 for t, s in parted.items() if weight[t] * (len(t) + 1) <= 2 * 0.005 * total / 16)


def test_sample_is_bounded_and_stable(spark):
    docs, table, _ = labelled(spark)
    ids = lambda n, t=table: {r.doc_id for r in labelled_sample(spark, docs, t, "toxic", n).collect()}
    assert ids(50) == ids(50, table.repartition(9)) and len(ids(50)) == 50 and ids(50) < ids(200)
    assert all(zlib.crc32(str(k).encode()) % 5 for k in ids(10_000))
