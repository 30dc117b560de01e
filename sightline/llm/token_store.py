"""Token-id output: Parquet list columns, ordered by document id.

``write_tokens`` lays documents out in ascending id order and writes one list column
of ids.  Ids take dictionary encoding (a vocabulary fits one dictionary page), the
numeric metadata takes delta encoding (format version 2, dictionary off), row groups
and pages have a set size, and Parquet's page index lets a reader that asks for few
documents or only for metadata skip the other pages (``read_tokens``).
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, documents, release, scratch_path

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
#: Size of the encoder's table of units met before.
TABLE_BYTES = 16 << 20
#: Texts in a batch of ids.
ROWS = 256
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#start_in_part": "false",
}

#: A control character, its own word to the tokenizer; pieces that hold it are encoded singly.
MARK = "\x01"
#: The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LEVEL = np.arange(256, dtype="<u4")
BYTE_LEVEL[[b for b in range(256) if b not in _PRINTABLE]] = 256 + np.arange(256 - len(_PRINTABLE))
BYTE_LEVEL[32] = 32  # here the space parts words
#: A lower-case Latin word or none; a run of ASCII punctuation or none and what parts pieces.
SIMPLE = r"^(?P<word>[a-zªµºß-öø-ÿ]*)(?P<tail>[!-/:-@\[-`{-~]*[ \n])$"

_ENCODERS: dict = {}


# The tokenizer settings under which a space parts a text.
NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _parts(setting: dict | None, within: str) -> list[dict]:
    """A setting's steps, of a sequence or alone."""
    if setting is None:
        return []
    return setting[within] if setting["type"] == "Sequence" else [setting]


def splits_at_spaces(settings: dict) -> bool:
    """Whether a text's ids are those of its space-separated pieces in turn, by a tokenizer file's settings.

    The normalizer may compose (NFC never joins across a space), fold white space and
    lower-case code point by code point; the splitter has to be the word pattern that
    drops white space, followed by the byte-level alphabet without a pattern of its own;
    no id is added around a text or after truncation; added tokens neither hold a space or line end
    nor reach for the white space around them; the model is plain BPE without dropout.
    """
    model, normalizers, splitters = settings["model"], _parts(settings["normalizer"], "normalizers"), _parts(settings["pre_tokenizer"], "pretokenizers")
    split = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
    return (
        all(x in NORMALIZERS for x in normalizers)
        and len(splitters) == 2
        and splitters[0] == split
        and (splitters[1]["type"], splitters[1]["add_prefix_space"], splitters[1]["use_regex"]) == ("ByteLevel", False, False)
        and settings.get("truncation") is None
        and settings.get("padding") is None
        and not any({" ", "\n"} & set(t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in settings["added_tokens"])
        and (model["type"], model.get("dropout"), model.get("continuing_subword_prefix")) == ("BPE", None, None)
    )


def _pick(ids: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen runs of ids in turn, and their ends; runs are held as all ids in turn and each run's end."""
    counts = np.diff(ends, prepend=0)[which]
    stops = np.cumsum(counts)
    at = np.repeat(ends[which] - stops, counts)
    at += np.arange(len(at))
    return ids[at], stops


def _joined(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, "<i4"), *runs]), np.cumsum([len(x) for x in runs], dtype=np.int64)


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class Encoder:
    """A tokenizer; where its settings allow, each distinct unit of a batch of texts is encoded once.

    The settings in the file decide (``splits_at_spaces``); under any others, and
    with ``whole``, texts are encoded whole.  A unit is a space-separated piece with what
    ends it (a space, at a text's end a line end), or either part of a piece that is a
    Latin word and punctuation.  Units met lately are kept in a table of bounded size.
    """

    def __init__(self, path: str, end_id: int, whole: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.end = np.array([end_id], "<i4")
        self.whole = whole or not splits_at_spaces(settings)
        if self.whole:
            return
        self.units, self.ids, self.ends = pa.array([], pa.large_string()), np.empty(0, "<i4"), np.empty(0, np.int64)
        # The mark must be one id of its own that leaves its neighbours as they are; else pieces are encoded singly.
        mark = self._flat(MARK)
        self.mark_id = mark[0] if len(mark) == 1 and self._flat(f"a {MARK} b") == self._flat("a") + mark + self._flat("b") else None
        # A lower-case Latin word is one pre-token of this splitter and no normalizer changes it: the model alone gives
        # its ids, many words in a call, and an end-of-word suffix tells where one ends.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        suffix, vocab = settings["model"].get("end_of_word_suffix"), settings["model"]["vocab"]
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[k for t, k in vocab.items() if suffix and t.endswith(suffix)]] = True
        # Added tokens are found before anything else: none may lie within a word and its punctuation, or appear by folding.
        added = [t["content"] for t in settings["added_tokens"]]
        self.simple = not any(re.match(SIMPLE, t.lower() + " ") for t in added)
        self.added = [t.lower() for t in added]
        self.folds = NORMALIZERS[2] in _parts(settings["normalizer"], "normalizers")

    def _flat(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _ids(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<i4") for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pieces: those without the mark as one text with a mark between them, cut at the mark's id."""
        plain = [p for p in pieces if MARK not in p] if self.mark_id is not None else []
        found = {}
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(self._flat(f" {MARK} ".join(some)), "<i4")
            marks = np.flatnonzero(ids == self.mark_id)
            found.update(zip(some, (ids[a:b] for a, b in zip([0, *(marks + 1)], [*marks, len(ids)])), strict=True))
        rest = [p for p in pieces if p not in found]
        found.update(zip(rest, self._ids(rest)))
        return [found[p] for p in pieces]

    def _learn_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words."""
        ids, ends, n = [], [], 0
        for at in range(0, len(words), ROWS):
            some = words[at : at + ROWS]
            text = " ".join(some)
            if not text.isascii():
                text = BYTE_LEVEL[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")
            coded = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<i4")
            stops = np.flatnonzero(self.last[coded]) + 1
            # A word has at most one such id, its last: as many as words are one each.
            if len(stops) != len(some):
                coded, stops = _joined(self._ids(some))
            ids.append(coded), ends.append(stops + n)
            n += len(coded)
        return np.concatenate([np.empty(0, "<i4"), *ids]), np.concatenate([np.empty(0, np.int64), *ends])

    def _encode_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, from the table where it has them; they are the table's newest from then on."""
        found = pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(found < 0)
        names = units.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist()
        # Words first: of a piece and of a tail the last character only says whether a text ends.
        of_word = np.array([u[-1] not in " \n" for u in names], bool)
        pieces = [u for u in names if u[-1] in " \n"]
        coded = [self._learn_words([u for u in names if u[-1] not in " \n"])]
        coded.append(_joined([np.concatenate((x, self.end)) if u[-1] == "\n" else x for u, x in zip(pieces, self._learn([u[:-1] for u in pieces]))]))
        ids, ends = self.ids, self.ends
        for more, stops in coded:
            ids, ends = np.concatenate((ids, more)), np.concatenate((ends, stops + len(ids)))
        found[new[of_word]] = len(self.ends) + np.arange(of_word.sum())
        found[new[~of_word]] = len(self.ends) + of_word.sum() + np.arange(len(pieces))
        older = np.ones(len(self.ends), bool)
        older[found[found < len(older)]] = False
        kept, rest = pa.concat_arrays([units, self.units.filter(pa.array(older))]), np.flatnonzero(older)
        which = np.concatenate((found, rest))
        sizes = np.cumsum(pc.binary_length(kept).to_numpy() + 4 * np.diff(ends, prepend=0)[which] + 16)
        n = int(np.searchsorted(sizes, TABLE_BYTES, "right"))
        self.units = pa.concat_arrays([kept[:n]])
        self.ids, self.ends = _pick(ids, ends, which[:n])
        return _pick(ids, ends, found)

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces.  A Latin word and the punctuation after it are learnt apart."""
        if not self.simple:
            return self._encode_units(pieces)
        parts = pc.extract_regex(pieces, SIMPLE)
        word, tail = (pc.struct_field(parts, name) for name in ("word", "tail"))
        # Two units a piece: the word, or null if there is none, and its tail or the whole piece.
        whole = pc.is_null(parts)
        word = pc.if_else(pc.or_(whole, pc.equal(word, "")), None, word)
        units = pa.concat_arrays([word.cast(pa.large_string()), pc.if_else(whole, pieces, tail).cast(pa.large_string())]).dictionary_encode()
        ids, ends = self._encode_units(units.dictionary)
        none = len(ends)
        which = pc.fill_null(units.indices, none).to_numpy().reshape(2, -1).T.ravel()
        ids, ends = _pick(ids, np.append(ends, ends[-1:]), which)
        return ids, ends[1::2]

    def _fold(self, text: str) -> str:
        """The text with spaces for line ends; in lower case if that changes no id."""
        text = text.replace("\n", " ")
        if self.folds and _latin(text):
            low = text.lower()
            if not any(t in low for t in self.added):
                return low
        return text

    def batches(self, texts: list[str | None]):
        """Ids of ``ROWS`` texts after another, each text with the end id, and the number of ids up to each text's end."""
        if self.whole:
            for at in range(0, len(texts), ROWS):
                yield _joined([np.concatenate((x, self.end)) for x in self._ids([t or "" for t in texts[at : at + ROWS]])])
            return
        data = "".join([self._fold(t) + "\n" if t else "\n" for t in texts]).encode()
        chars = np.frombuffer(data, np.uint8)
        stops = np.flatnonzero((chars == 32) | (chars == 10))
        last = np.flatnonzero(chars[stops] == 10) + 1
        bounds = pa.py_buffer(np.concatenate(([0], stops + 1)))
        coded = pa.Array.from_buffers(pa.large_string(), len(stops), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        ids, ends = self._encode_pieces(coded.dictionary)
        kinds, first = coded.indices.to_numpy(), 0
        del texts, data, chars, stops, bounds, coded
        for at in range(0, len(last), ROWS):
            some = last[at : at + ROWS]
            found, stops = _pick(ids, ends, kinds[first : some[-1]])
            yield found, stops[some - first - 1]
            first = some[-1]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [ids[a:b] for ids, ends in self.batches(texts) for a, b in zip([0, *ends[:-1]], ends)]


def _encoder(path: str, end_id: int, whole: bool) -> Encoder:
    key = (path, end_id, whole)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, end_id, whole)
    return _ENCODERS[key]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", whole: bool = False, layout: dict | None = None) -> None:
    """Write ``doc_id, part, start_in_part, n_tokens, tokens`` under ``path``.

    Files follow one another in ascending id order (nulls first, ties by text).
    Null and empty texts have the end id alone; very long texts are encoded whole, one
    list each (at most 2**31 - 1 ids); repeated rows are written each; an empty table
    writes no rows; other columns are ignored, whatever their names.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        coder = _encoder(tokenizer, end_id, whole)
        for rows in batches:
            at = 0
            for ids, ends in coder.batches(rows.column(1).to_pylist()):
                n, ends = len(ends), np.concatenate(([0], ends))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0)[at : at + n], pa.array(np.full(n, part, np.int32)), pa.array(start + ends[:-1]), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "tokens"],
                )
                start, at = start + int(ends[-1]), at + n
        release()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__sl_text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("__sl_text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    coded = ordered.mapInArrow(encode, f"doc_id {id_type}, part int, start_in_part long, n_tokens long, tokens array<int>")
    coded.write.options(**(LAYOUT | (layout or {}))).parquet(path)


def read_tokens(spark: SparkSession, path: str, first=None, last=None, columns: tuple[str, ...] = ("doc_id", "n_tokens", "tokens")) -> DataFrame:
    """A selective read: an id range is pushed to row groups and pages, unread columns stay on disk."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.select(*columns)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids in all files before each file: one row per written file, from the metadata columns."""
    sums = sorted(spark.read.parquet(path).groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens"))).collect())
    rows, before = [], 0
    for part, n in sums:
        rows.append((part, before))
        before += n
    return spark.createDataFrame(rows, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType())]))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the written files."""
    rows = spark.read.parquet(path)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def digest(batches):
        for batch in batches:
            lists = batch.column(3)
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    read = rows.select("doc_id", "part", "start_in_part", "tokens").mapInArrow(digest, f"doc_id {id_type}, part int, start_in_part long, n_tokens long, ids_crc32 long")
    # One row per file: bounded by the number of files.
    return read.join(F.broadcast(part_starts(spark, path)), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_store(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_digests(spark, path)
