"""Exact n-gram Jaccard join by partitioning the token universe.

Method.  Two sets with Jaccard similarity at least t differ in at most
H = (1 - t) / (1 + t) * (|a| + |b|) tokens.  For each size class of the larger set the
universe of token hashes is cut into W units, W > H.  A unit compared exactly can be
missed only if it holds a difference; two units fused into one segment and compared
up to one difference (a one-deletion neighbourhood) can be missed only if they hold
two.  So by the pigeonhole principle a pair that shares no signature has more than H
differences.  A set signs the classes its possible partners can define: its own, and
the next where sizes allow.

Cost-based allocation, first by class: units are fused where a cost model of emitted
signatures and chance collisions says so (short sets).  Then by set: of its exact
units a set leaves out as many as the bound spares, those that a global order puts
last: signatures frequent in the corpus, then small ones.  Both sides of a match see
the same order, so the first match in that order is always kept by both.

Frequent signatures are counted in a first pass over all documents.  In the second
pass they pair each holder with one pivot on the spot, so that no task gathers them;
rare ones meet in hash buckets.  Candidates are cut by an exact bound from parity
bitmaps, then verified on the token sets.  Large groups around one pivot make a family;
where it did not fall into one component, all its pairs across components are put to
the same bound, in blocks of fixed size, and what passes is verified too, so no link
between components is lost.

Sets are named by 128-bit digests; tokens are compared as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard
from .common import WordHashes, bounded_batches, documents, materialize, release

NGRAM = 5
SIMILARITY = (3, 4)
#: A signature is frequent if a pack of documents holds it this often; the most frequent ones are kept.
FREQUENT = 4
FREQUENT_KEPT = 1 << 17
#: Groups up to this size are paired in full at once.
SMALL_GROUP = 6
BUCKET_BYTES = 12 << 20
#: A worker counts, and packs, so many signatures at a time.
HELD_SIGNATURES = 1 << 19
PACKED_SIGNATURES = 1 << 18
#: Fewest 64-bit words of a parity bitmap; it has 2 to 4 bits a token.
SKETCH_WORDS = 16
#: Members of a family compared at a time, on either side.
FAMILY_BLOCK = 4096
#: Parts of a large group's key.
SALTS = 16
#: Up to this many wanted texts are found by a broadcast bitmap of 16 bits each (32 MB), more by a join.
BITMAP_ITEMS = 1 << 24

_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finalizer on 64-bit words."""
    x = x + _U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text."""

    def __init__(self, n: int = NGRAM):
        self.n, self.words = n, WordHashes()
        self.odd = [int(_ODD[k % 6]) * (2 * k + 1) & (1 << 64) - 1 for k in range(n)]

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, _U)
        ids = self.words(words)
        n = min(self.n, len(ids))
        count = len(ids) - n + 1
        sums = ids[:count] * _U(self.odd[0])
        for k in range(1, n):
            sums += ids[k : k + count] * _U(self.odd[k])
        tokens = mixed(sums, n)
        tokens.sort()
        if count > 1:
            fresh = np.empty(count, bool)
            fresh[0] = True
            np.not_equal(tokens[1:], tokens[:-1], out=fresh[1:])
            tokens = tokens[fresh]
        return tokens


@dataclass(frozen=True)
class Scheme:
    """The partition for pairs whose larger set has ``lo..hi`` tokens."""

    number: int
    lo: int
    hi: int
    fused: int
    exact: int

    @property
    def units(self) -> int:
        return 2 * self.fused + self.exact


def class_of(n: int) -> int:
    """Size classes: 1, 2-3, 4-5, 6-7, then one per power of two."""
    return n.bit_length() if n <= 5 else n.bit_length() + 1


def allocate(number: int, similarity=SIMILARITY) -> Scheme:
    """Exact units or one-deletion segments for a size class, whichever is cheaper.

    The model's constants steer cost alone: ``shared`` is the chance that a token of
    such a set also occurs in an unrelated one (short texts are more formulaic), a
    chance collision costs ``100`` signatures, and the choice among units is worth a
    quarter token.  Any result of it is exact.
    """
    num, den = similarity
    lo, hi = [(1, 1), (2, 3), (4, 5), (6, 7)][number - 1] if number < 5 else (1 << (number - 2), (1 << (number - 1)) - 1)
    most = 2 * hi * (den - num) // (den + num)
    units = most + 1 + -(-(most + 1) * 15 // 100) * (most > 0)
    fused = (most + 2) // 2
    shared, tokens, whole = 0.2 + 0.3 * math.exp(-hi / 32), 0.75 * hi / units, 0.75 * hi / fused
    by_exact = (most + 1) * (1 + 100 * shared ** (tokens + 0.25))
    by_fused = fused * (1 + whole + 100 * (shared**whole + whole * shared ** (whole - 1)))
    return Scheme(number, lo, hi, fused, 0) if most and by_fused < by_exact else Scheme(number, lo, hi, 0, units)


_SCHEMES: dict = {}


def scheme(number: int, similarity) -> Scheme:
    if (number, similarity) not in _SCHEMES:
        _SCHEMES[number, similarity] = allocate(number, similarity)
    return _SCHEMES[number, similarity]


def schemes_of(n: int, similarity) -> list[tuple[Scheme, int]]:
    """The schemes a set of ``n`` tokens signs, with the most differences of its pairs there."""
    num, den = similarity
    own, top = scheme(class_of(n), similarity), n * den // num
    out = [(own, (n + min(own.hi, top)) * (den - num) // (den + num))]
    if top > own.hi:
        out.append((scheme(class_of(n) + 1, similarity), (n + top) * (den - num) // (den + num)))
    return out


_FRAMES: dict = {}


def frame_of(s: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit edges in the hash range, and a salt for each exact unit and fused segment."""
    if s not in _FRAMES:
        edges = np.array([(k << 64) // s.units for k in range(s.units)], _U)
        exact = mixed(np.arange(s.exact, dtype=_U) + _U(s.number << 32), 5)
        fused = mixed(np.arange(s.fused, dtype=_U) + _U(s.number << 32 | 1 << 31), 5)
        _FRAMES[s] = edges, exact, fused
    return _FRAMES[s]


def signatures_of(tokens: np.ndarray, similarity, frequent: "Frequent | None") -> np.ndarray:
    """All signatures of a set; with ``frequent`` None also the units it may leave out.

    An exact unit has one; a fused segment has its own and those of all its
    one-deletion neighbours.  Tokens are sorted, so units are stretches of them.
    """
    out = []
    digests = mixed(tokens, 77)
    sums = np.zeros(len(tokens) + 1, _U)
    np.cumsum(digests, out=sums[1:])
    for s, most in schemes_of(len(tokens), similarity):
        edges, exact_salt, fused_salt = frame_of(s)
        starts = np.append(np.searchsorted(tokens, edges), len(tokens))
        at_start = sums[starts]
        if s.fused:
            cut = starts[: 2 * s.fused + 1 : 2]
            whole = at_start[2 : 2 * s.fused + 1 : 2] - at_start[: 2 * s.fused : 2] + fused_salt
            segment = np.repeat(np.arange(s.fused), np.diff(cut))
            out.append(mixed(np.concatenate((whole, whole[segment] - digests[: len(segment)]))))
        keep = most + 1 - 2 * s.fused
        if s.exact and keep > 0:
            first = 2 * s.fused
            found = mixed(at_start[first + 1 :] - at_start[first:-1] + exact_salt)
            if frequent is not None and keep < len(found):
                # Rarest first, then the units with most tokens, then by signature: the same total order on both sides of a match.
                found = found[np.lexsort((found, -np.diff(starts[first:]), frequent.count_of(found)))[:keep]]
            out.append(found)
    return np.concatenate(out) if out else np.empty(0, _U)


class Frequent:
    """The frequent signatures with their counts and pivots."""

    def __init__(self, signatures: np.ndarray, counts: np.ndarray, pivots: np.ndarray):
        order = np.argsort(signatures)
        self.signatures, self.counts, self.pivots = signatures[order], np.minimum(counts[order], (1 << 30) - 1), pivots[order]

        # A first look by 20 leading bits spares most searches.
        self.leading = np.zeros(1 << 20, bool)
        self.leading[(self.signatures >> _U(44)).astype(np.int64)] = True

    def find(self, signatures: np.ndarray) -> np.ndarray:
        """Place in the table, or -1."""
        out = np.full(len(signatures), -1)
        if len(self.signatures):
            maybe = np.flatnonzero(self.leading[(signatures >> _U(44)).astype(np.int64)])
            if len(maybe):
                at = np.minimum(np.searchsorted(self.signatures, signatures[maybe]), len(self.signatures) - 1)
                same = self.signatures[at] == signatures[maybe]
                out[maybe[same]] = at[same]
        return out

    def count_of(self, signatures: np.ndarray) -> np.ndarray:
        at = self.find(signatures)
        return np.where(at >= 0, self.counts[at], 0) if len(self.counts) else np.zeros(len(at), np.int64)


def node_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def sketch_of(tokens: np.ndarray) -> list[int]:
    """Parity bits, a power of two of them: two sets differ in at least as many tokens as bits."""
    bits = max(64 * SKETCH_WORDS, 1 << (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((mixed(tokens, 99) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def halved(sketch: np.ndarray) -> np.ndarray:
    """The bitmap of half as many bits: parities of the same hashes under the shorter mask."""
    half = sketch.shape[-1] // 2
    return sketch[..., :half] ^ sketch[..., half:]


_SHINGLERS: dict = {}


def shingler(n: int) -> Shingler:
    return _SHINGLERS.setdefault(n, Shingler(n))


def _scan(rows: DataFrame, n: int, similarity, id_type: str) -> DataFrame:
    """First pass: every document's set (kind 0) and each pack's frequent signatures (kind 1)."""

    names = ["kind", "doc_id", "text_hash", "size", "node", "key", "sketch", "signature", "n"]

    def often(signed, owners, id_kind):
        signatures, keys = np.concatenate(signed), np.concatenate(owners)
        order = np.argsort(signatures)
        signatures, keys = signatures[order], keys[order]
        first = np.flatnonzero(np.concatenate(([True], signatures[1:] != signatures[:-1])))
        counts = np.diff(np.append(first, len(signatures)))
        many = counts >= FREQUENT
        k = int(many.sum())
        blank = [pa.nulls(k, id_kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())]
        found = [pa.array(np.minimum.reduceat(keys, first)[many]), pa.nulls(k, pa.list_(pa.int64())), pa.array(signatures[first[many]].view(np.int64)), pa.array(counts[many].astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int8)), *blank, *found], names=names)

    def scan(batches):
        shingles = shingler(n)
        signed, owners, held, seen = [], [], 0, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                sizes, nodes, keys, sketches = [], [], [], []
                for text in piece.column(1).to_pylist():
                    tokens = shingles(text)
                    sizes.append(len(tokens))
                    if not len(tokens):
                        nodes.append(None), keys.append(None), sketches.append(None)
                        continue
                    node = node_of(tokens)
                    key = int.from_bytes(node[:8], "little", signed=True)
                    nodes.append(node), keys.append(key), sketches.append(sketch_of(tokens))
                    if key not in seen:
                        seen.add(key)
                        found = signatures_of(tokens, similarity, None)
                        signed.append(found)
                        owners.append(np.full(len(found), key, np.int64))
                        held += len(found)
                k = len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int8)), piece.column(0), piece.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
                if held >= HELD_SIGNATURES:
                    yield often(signed, owners, batch.column(0).type)
                    signed, owners, held, seen = [], [], 0, set()
        if held:
            yield often(signed, owners, batch.column(0).type)
        signed = owners = seen = None
        release()

    return rows.mapInArrow(scan, f"kind tinyint, doc_id {id_type}, text_hash long, size long, node binary, key long, sketch array<long>, signature long, n long")


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _emit(rows: DataFrame, n: int, similarity, frequent, buckets: int) -> DataFrame:
    """Second pass: signatures packed by bucket; frequent ones already paired with their pivot."""

    def packed(signed, owners, table):
        sig, own = np.concatenate(signed), np.concatenate(owners)
        at = table.find(sig)
        hot = at >= 0
        # Rare signatures meet by signature, so sorting them sorts the buckets; frequent ones are spread by owner.
        cold_sig, cold_own = sig[~hot], own[~hot]
        order = np.argsort(cold_sig)
        cold_sig, cold_own = cold_sig[order], cold_own[order]
        hot_sig, hot_own, hot_pivot = sig[hot], own[hot], table.pivots[at[hot]] if hot.any() else np.empty(0, np.int64)
        place = _bucket(mixed(hot_own.view(_U)), buckets)
        order = np.argsort(place, kind="stable")
        hot_sig, hot_own, hot_pivot = hot_sig[order], hot_own[order], hot_pivot[order]
        cold_place, hot_place = _bucket(cold_sig, buckets), place[order]
        used = np.unique(np.concatenate((cold_place, hot_place)))
        ends = [np.searchsorted(x, used, side=side).tolist() for x in (cold_place, hot_place) for side in ("left", "right")]
        out = []
        for k, a, b, c, d in zip(used.tolist(), *ends):
            out.append((k, cold_sig[a:b].tobytes() + hot_sig[c:d].tobytes(), cold_own[a:b].tobytes() + hot_own[c:d].tobytes(), hot_pivot[c:d].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "signatures", "owners", "pivots"])

    def emit(batches):
        shingles, table = shingler(n), Frequent(*frequent.value)
        signed, owners, held, seen = [], [], 0, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for text in batch.column(0).slice(at, 512).to_pylist():
                    tokens = shingles(text)
                    if len(tokens):
                        key = int.from_bytes(node_of(tokens)[:8], "little", signed=True)
                        if key not in seen:
                            seen.add(key)
                            found = signatures_of(tokens, similarity, table)
                            signed.append(found)
                            owners.append(np.full(len(found), key, np.int64))
                            held += len(found)
                if held >= PACKED_SIGNATURES:
                    yield packed(signed, owners, table)
                    signed, owners, held, seen = [], [], 0, set()
        if held:
            yield packed(signed, owners, table)
        signed = owners = seen = table = None
        release()

    return rows.mapInArrow(emit, "bucket int, signatures binary, owners binary, pivots binary")


def _pairs(packed: DataFrame) -> DataFrame:
    """Candidate pairs (kind 0: a < b) and members of large groups (kind 1: signature, owner)."""

    def group(table: pa.Table) -> pa.Table:
        def gathered(name, kind):
            return np.frombuffer(b"".join(x for x in table.column(name).to_pylist()), kind)

        sig, own, pivot = gathered("signatures", _U), gathered("owners", np.int64), gathered("pivots", np.int64)
        hot = np.zeros(len(sig), bool)
        end = 0
        for s, p in zip(table.column("signatures").to_pylist(), table.column("pivots").to_pylist()):
            end += len(s) // 8
            hot[end - len(p) // 8 : end] = True
        left, right = [np.minimum(own[hot], pivot)], [np.maximum(own[hot], pivot)]
        members = [(sig[hot].view(np.int64), own[hot])]
        sig, own = sig[~hot], own[~hot]
        order = np.argsort(sig)
        sig, own = sig[order], own[order]
        if len(sig):
            # Few signatures repeat: only those need their owners in order.
            twice = np.concatenate((sig[1:] == sig[:-1], [False]))
            twice[1:] |= twice[:-1].copy()
            sig, own = sig[twice], own[twice]
            order = np.lexsort((own, sig))
            sig, own = sig[order], own[order]
        if len(sig):
            fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])))
            sig, own = sig[fresh], own[fresh]
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            count = np.diff(np.append(first, len(sig)))
            for k in range(2, SMALL_GROUP + 1):
                at = first[count == k]
                for i in range(k):
                    for j in range(i + 1, k):
                        left.append(own[at + i])
                        right.append(own[at + j])
            large = count > SMALL_GROUP
            lead, size = np.repeat(first[large], count[large]), count[large]
            inside = lead + np.arange(len(lead)) - np.repeat(np.cumsum(size) - size, size)
            left.append(own[lead])
            right.append(own[inside])
            members.append((sig[inside].view(np.int64), own[inside]))
        a, b = np.concatenate(left), np.concatenate(right)
        keep = a != b
        pairs = np.unique(np.stack((a[keep], b[keep]), axis=1), axis=0)
        groups = np.unique(np.stack([np.concatenate(x) for x in zip(*members)], axis=1), axis=0)
        kinds = np.concatenate((np.zeros(len(pairs), np.int8), np.ones(len(groups), np.int8)))
        return pa.table({"kind": kinds, "a": np.concatenate((pairs[:, 0], groups[:, 0])), "b": np.concatenate((pairs[:, 1], groups[:, 1]))})

    return packed.groupBy("bucket").applyInArrow(group, "kind tinyint, a long, b long")


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``text`` of the rows whose id is wanted, and maybe of a few others; texts aren't shuffled."""
    hashed = wanted.select(F.xxhash64("doc_id").alias("h")).distinct()
    count = hashed.count()
    if count > BITMAP_ITEMS:
        # By the hash, as the bitmap does: null ids are found too.
        return texts.select(F.xxhash64("doc_id").alias("h"), "text").join(hashed, "h", "left_semi").select("text")
    bits = max(16, (16 * count).bit_length())
    place = F.shiftrightunsigned("h", 64 - bits)
    words = hashed.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("m")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def chosen(batches):
        held = shared.value.view(_U)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(_U) >> _U(64 - bits)
            mask = (held[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1)
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(mask.astype(bool)))], names=["text"])

    return texts.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(chosen, "text binary")


def _salted_join(rows: DataFrame, facts: DataFrame, on: str) -> DataFrame:
    """``rows`` with the ``facts`` of their group, one row a group, without a hot key: by the group and a salt of ``key``.

    Groups here have more than ``SMALL_GROUP`` rows, so that ``SALTS`` copies of their
    facts are of the order of the rows.
    """
    copies = facts.withColumn("__sl_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__sl_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(copies, [on, "__sl_salt"]).drop("__sl_salt")


def _family_pairs(members: DataFrame, similarity) -> DataFrame:
    """Pairs (a < b) of each family, across labels, that the exact bounds let pass.

    ``members``: ``family, blocks, key, label, size, sketch``.  Families are cut into blocks,
    and each task compares two blocks, so memory doesn't grow with a family.
    """
    num, den = similarity
    rows = members.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("family", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "key", "label", "size", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        mine = table.column("mine").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        key, size = table.column("key").to_numpy(), table.column("size").to_numpy()
        _, label = np.unique(np.array(table.column("label").to_pylist(), object), return_inverse=True)
        rows_of, place, sketch = {}, np.zeros(len(key), np.int64), table.column("sketch").to_pylist()
        lengths = np.array([len(x) for x in sketch])
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            place[at] = np.arange(len(at))
            rows_of[n] = np.array([sketch[k] for k in at], np.int64).view(_U)
        folded = {n: halved(m) for n, m in rows_of.items() if n > SKETCH_WORDS}
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        out = [np.empty((0, 2), np.int64)]
        for a in left:
            near = right[(label[right] != label[a]) & ((key[right] > key[a]) if i == j else True)]
            near = near[np.minimum(size[near], size[a]) * den >= np.maximum(size[near], size[a]) * num]
            n = int(lengths[a])
            # Sizes within the similarity differ by less than a factor of two, so do bitmaps by one halving at most.
            for m in (n // 2, n, 2 * n):
                b = near[lengths[near] == m]
                if len(b):
                    short = min(n, m)
                    own = (rows_of if n == short else folded)[n][place[a]]
                    apart = np.bitwise_count((rows_of if m == short else folded)[m][place[b]] ^ own).sum(axis=1, dtype=np.int64)
                    b = b[apart * (den + num) <= (size[b] + size[a]) * (den - num)]
                    out.append(np.stack((np.minimum(key[b], key[a]), np.maximum(key[b], key[a])), axis=1))
        pairs = np.concatenate(out)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, similarity) -> DataFrame:
    """The pairs (keys a, b) that reach the similarity, as node digests u, v."""
    num, den = similarity
    one = nodes.select(*(F.col(c).alias(f"{c}_a") for c in ("key", "node", "size", "sketch", "doc_id")))
    two = nodes.select(*(F.col(c).alias(f"{c}_b") for c in ("key", "node", "size", "sketch", "doc_id")))
    met = pairs.join(one, F.col("a") == F.col("key_a")).join(two, F.col("b") == F.col("key_b"))
    half = lambda c: F.zip_with(F.slice(c, F.lit(1), (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2).cast("int") + 1, (F.size(c) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
    one_sketch = F.when(F.size("sketch_a") > F.size("sketch_b"), half(F.col("sketch_a"))).otherwise(F.col("sketch_a"))
    two_sketch = F.when(F.size("sketch_b") > F.size("sketch_a"), half(F.col("sketch_b"))).otherwise(F.col("sketch_b"))
    apart = F.aggregate(F.zip_with(one_sketch, two_sketch, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.col("size_a") + F.col("size_b")
    met = met.where(F.least("size_a", "size_b") * den >= F.greatest("size_a", "size_b") * num)
    met = met.where(apart * (den + num) <= both * (den - num))
    met = materialize(met.select("node_a", "node_b", "doc_id_a", "doc_id_b"), "jaccard-candidates")
    wanted = met.select(F.col("doc_id_a").alias("doc_id"), F.col("node_a").alias("node")).union(met.select("doc_id_b", "node_b")).distinct()

    def tokens(batches):
        shingles = shingler(n)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingles(t) for t in batch.column(0).slice(at, 256).to_pylist()]
                found = [x for x in found if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "tokens"])

    # The id finds the text; its digest says whether it is the one meant, as ids may repeat.
    sets = _texts_of(texts, wanted.select("doc_id")).mapInArrow(tokens, "node binary, tokens binary")
    held = materialize(sets.join(wanted.select("node").distinct(), "node", "left_semi"), "jaccard-sets")
    sets = held.dropDuplicates(["node"])

    def verify(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                inside = int((both[1:] == both[:-1]).sum())
                good.append(den * inside >= num * (len(both) - inside))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    shipped = met.join(sets.withColumnsRenamed({"node": "node_a", "tokens": "tokens_a"}), "node_a").join(sets.withColumnsRenamed({"node": "node_b", "tokens": "tokens_b"}), "node_b")
    links = materialize(shipped.select("node_a", "node_b", "tokens_a", "tokens_b").mapInArrow(verify, "u binary, v binary"), "jaccard-links")
    discard(met, held)
    return links


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the least node reachable.  Label passing with pointer jumping, one table a round."""
    both = materialize(links.union(links.select("v", "u")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("l")), "v").groupBy(F.col("u").alias("node")).agg(F.min("l").alias("l"))
        passed = labels.join(near, "node").select("node", F.least("label", "l").alias("label"), F.col("label").alias("old"))
        jump = passed.select(F.col("node").alias("label"), F.col("label").alias("root"))
        fresh = materialize(passed.join(jump, "label", "left").select("node", F.coalesce(F.least("root", "label"), "label").alias("label"), "old"), "labels")
        discard(labels)
        labels = fresh.select("node", "label")
        labels._scratch = fresh._scratch
        if fresh.where(F.col("label") != F.col("old")).isEmpty():
            discard(both)
            return labels


def near_duplicates(docs: DataFrame, ngram: int = NGRAM, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, text_hash`` for every row of ``docs``.

    ``component_id`` is the least id reachable through links.  A text with fewer than
    ``ngram`` words is one shingle; null and blank texts have none and are linked with
    nothing.  A very long text's set is built whole.  Rows with equal sets are one node,
    however many, with their least id, so repeated rows and ties have one answer; null
    ids are ignored when the least is sought (all null: null).  An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    bounded_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    scanned = materialize(_scan(texts.withColumn("text_hash", F.xxhash64("text")), ngram, similarity, id_type), "jaccard-scan")
    counted = scanned.where("kind = 1").groupBy("signature").agg(F.sum("n").alias("n"), F.min("key").alias("pivot"))
    top = counted.orderBy(F.desc("n"), "signature").limit(FREQUENT_KEPT).toPandas()
    frequent = sc.broadcast((top["signature"].to_numpy(np.int64).view(_U), top["n"].to_numpy(np.int64), top["pivot"].to_numpy(np.int64)))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-size // BUCKET_BYTES))
    found = materialize(_pairs(_emit(texts.select("text"), ngram, similarity, frequent, int(buckets))), "jaccard-pairs")
    own = scanned.where("kind = 0").select("doc_id", "text_hash", "size", "node", "key", "sketch")
    nodes = own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("key").alias("key"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes, "jaccard-nodes")
    pairs = found.where("kind = 0").select("a", "b").distinct()
    links = _links(pairs, nodes, texts, ngram, similarity)
    labels = components(links)
    # Groups that did not fall into one component: compare across components.
    where = nodes.select("key", "node").join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("label"))
    held = found.where("kind = 1").select(F.col("a").alias("signature"), F.col("b").alias("key")).distinct().join(where, "key")
    held = materialize(held, "jaccard-groups")
    lead = held.groupBy("signature").agg(F.min("key").alias("family"))
    members = _salted_join(held, lead, "signature").select("family", "key", "label").distinct()
    open_ = members.groupBy("family").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.ceil(F.count("*") / FAMILY_BLOCK).cast("int").alias("blocks"))
    members = _salted_join(members, open_.where("l0 <> l1").select("family", "blocks"), "family").join(nodes.select("key", "size", "sketch"), "key")
    cross = _family_pairs(members, similarity).join(pairs, ["a", "b"], "left_anti")
    cross = materialize(cross, "jaccard-cross")
    discard(found, held)
    if not cross.isEmpty():
        more = _links(cross, nodes, texts, ngram, similarity)
        if not more.isEmpty():
            discard(labels)
            labels = components(links.union(more))
    reach = nodes.select("node", "doc_id").join(labels, "node")
    least = reach.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = nodes.select("node", F.col("doc_id").alias("own")).join(labels, "node", "left").join(least, "label", "left").select("node", F.coalesce("component_id", "own").alias("component_id"))
    out = own.select("doc_id", "text_hash", "size", "node").join(of_node, "node", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_hash")


def one_per_group(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's; a repeated row (same id and text) stays once.

    Null, empty and blank texts are alone in their groups and stay; rows of one id with
    different texts stay each if it is their group's; a null id stays where its group has
    no other; an empty table gives an empty one; all columns pass through.

    ``groups`` is what ``near_duplicates`` returns for ``docs``.
    """
    kept = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__sl_id"), F.col("text_hash").alias("__sl_kept")).distinct()
    rows = docs.withColumn("__sl_hash", F.xxhash64(F.col(text_col).cast("binary")))
    rows = rows.join(kept, F.col(id_col).eqNullSafe(F.col("__sl_id")) & (F.col("__sl_hash") == F.col("__sl_kept")), "left_semi")
    return rows.dropDuplicates([id_col, "__sl_hash"]).drop("__sl_hash")


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).drop("text_hash")


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS m FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.m)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(c.m, t.doc_id)) AS component_id
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) c ON c.doc_id = t.doc_id
"""
