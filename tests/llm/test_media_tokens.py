import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import tiff, token_store

CODECS = (tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 70), st.integers(2, 256), st.randoms(use_true_random=False))
def test_every_codec_layout_and_predictor_round_trips(h, w, levels, rng):
    pixels = np.array([[rng.randrange(levels) for _ in range(w)] for _ in range(h)], np.uint8)
    pages = [{"pixels": pixels, "codec": c, "predictor": p, **layout} for c in CODECS for p in (1, 2) for layout in ({"rows_per_strip": 7}, {"tile": (16, 32)})]
    got = list(tiff.read_tiff(tiff.write_tiff(pages)))
    assert [g["error"] for g in got] == [None] * len(pages)
    assert all(g["pixels"] == pixels.tobytes() for g in got)


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=3000))
def test_byte_codecs(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    assert tiff.unpackbits(tiff.packbits_row(data), len(data)) == data


def test_lzw_passes_table_resets():
    data = np.random.default_rng(0).integers(0, 256, 60_000).astype(np.uint8).tobytes() + b"a" * 50_000
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_big_endian_and_broken_files():
    entries = [(256, 3, 4), (257, 3, 2), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (278, 3, 2), (279, 4, 8)]
    body = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in entries)
    data = b"MM\0*" + struct.pack(">I", 16) + b"abcdefgh" + struct.pack(">H", len(entries)) + body + bytes(4)
    (page,) = tiff.read_tiff(data)
    assert page["error"] is None and page["pixels"] == b"abcdefgh"
    for bad in (b"", b"II*", b"hello world", data[:40], data.replace(struct.pack(">HHIHH", 258, 3, 1, 8, 0), struct.pack(">HHIHH", 258, 3, 1, 16, 0))):
        assert [p["error"] is not None for p in tiff.read_tiff(bad)] == [True]
    loop = bytearray(tiff.write_tiff([{"pixels": np.zeros((2, 2), np.uint8), "codec": tiff.PLAIN}]))
    (first,) = struct.unpack_from("<I", loop, 4)
    struct.pack_into("<I", loop, first + 2 + 12 * struct.unpack_from("<H", loop, first)[0], first)
    assert [p["error"] for p in tiff.read_tiff(bytes(loop))][-1] == "image directories form a loop"


TEXTS = [None, "", "a", "a", "x" * 576, "é" * 400 + "\n" + "word " * 30_000, "tail\xff"]


def test_pages_and_digests(spark):
    docs = spark.createDataFrame([(k, t, "u") for k, t in enumerate(TEXTS)] + [(None, "z", "u")], "doc_id long, text string, page_no string")
    media = tiff.text_media(docs.select("doc_id", "text"))
    pages = tiff.tiff_pages(media)
    assert {r.codec for r in pages.select("codec").distinct().collect()} == {"deflate", "packbits", "lzw"}
    got = {r.doc_id: r for r in tiff.page_digests(pages, ["doc_id", "n_bytes"]).collect()}
    for k, t in [*enumerate(TEXTS), (None, "z")]:
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert got[2].feature == got[3].feature
    assert tiff.tiff_pages(spark.createDataFrame([(1, None), (2, b"")], "k int, content binary")).select("k", "error").collect()[0].k == 2
    assert tiff.page_digests(tiff.tiff_pages(tiff.text_media(docs.limit(0).select("doc_id", "text"))), ["doc_id"]).count() == 0


def tokenizer():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    return path, Tokenizer.from_file(path)


ODD = ["a<|endoftext|>b c", "x\x01 \x01y", " ", "x y\t\tq\r\n's don't", "A\x1cB  é É ﬁ İ ΑΣ ΑΣ.", "e ̸= =", "Word, word!! (x) #$%  1,000.5 a1b2 <x>", "你好 안녕 🙂"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabAé'’sd0٣́!?<|>#ÅΣ你‍한\x01.", max_size=50), max_size=4))
def test_pieces_encode_like_whole_texts(texts):
    path, whole = tokenizer()
    coder = token_store._encoder(path, 1, False)
    for t, ids in zip([*texts, *ODD], coder.encode([*texts, *ODD])):
        assert np.frombuffer(ids, "<i4").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1]


def test_other_settings_are_encoded_whole(tmp_path):
    import json

    path, whole = tokenizer()
    settings = json.loads(whole.to_str())
    assert token_store.splits_at_spaces(settings) and not token_store._encoder(path, 1, False).whole
    for change in (
        {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFKC"}]}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
        {"added_tokens": [{**settings["added_tokens"][0], "lstrip": True}]},
    ):
        assert not token_store.splits_at_spaces(settings | change)
    other = tmp_path / "other.json"
    other.write_text(json.dumps(settings | {"normalizer": {"type": "NFC"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}))
    from tokenizers import Tokenizer

    plain, coder = Tokenizer.from_file(str(other)), token_store.Encoder(str(other), 1)
    for t, ids in zip(ODD, coder.encode(ODD)):
        assert np.frombuffer(ids, "<i4").tolist() == [*plain.encode(t, add_special_tokens=False).ids, 1]


def test_words_are_tokenized_many_in_a_call():
    path, whole = tokenizer()
    coder = token_store.Encoder(path, 1)

    class Counted:
        def __init__(self, model):
            self.inner, self.calls = model, 0

        def __getattr__(self, name):
            self.calls += 1
            return getattr(self.inner, name)

    coder.model = Counted(coder.model)
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(map(chr, rng.choice([*range(97, 123), 223, 233, 246], 8))) + "," * (k % 2) for k in range(500)) for _ in range(10)]
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1]
    assert coder.model.calls < 50


@pytest.mark.parametrize("content", ["foo", "?!", "b,", "É"])
def test_added_tokens_within_words(tmp_path, content):
    import json

    from tokenizers import Tokenizer

    path, whole = tokenizer()
    settings = json.loads(whole.to_str())
    other = tmp_path / "other.json"
    other.write_text(json.dumps(settings | {"added_tokens": [*settings["added_tokens"], {**settings["added_tokens"][0], "id": 49408, "content": content}]}))
    plain, coder = Tokenizer.from_file(str(other)), token_store.Encoder(str(other), 1)
    texts = ["a foo, xfoox Foo FOO?!", "what?! ab, b,c B,", "É é ÉÉ caféÉ", "你 foo b, É"]
    assert not coder.whole
    assert not token_store.splits_at_spaces(settings | {"added_tokens": [{**settings["added_tokens"][0], "content": "\n\n"}]})
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == [*plain.encode(t, add_special_tokens=False).ids, 1]


def test_encoder_table_is_bounded(monkeypatch):
    path, whole = tokenizer()
    coder = token_store.Encoder(path, 1)
    monkeypatch.setattr(token_store, "TABLE_BYTES", 400, raising=False)
    for k in range(6):
        texts = [*ODD, None, "", " ".join(f"w{chr(97 + (k + j) % 26)}x, Ünd Word" for j in range(20)), "x" * 500]
        for t, ids in zip(texts, coder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<i4").tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        assert coder.units.nbytes < 800
    assert coder.encode([]) == []


def test_store_and_selective_read(spark, tmp_path):
    path, whole = tokenizer()
    rows = [(k * 3 % 101, f"word{k} " * (k % 7)) for k in range(100)] + [(200, None), (200, None), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = str(tmp_path / "tokens")
    token_store.write_tokens(docs, out, path, 1)
    got = sorted(token_store.token_digests(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    start, texts = 0, dict(rows)
    for r in got:
        ids = [*whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.doc_id for r in token_store.read_tokens(spark, out, 10, 12, ("doc_id",)).orderBy("doc_id").collect()] == [10, 11, 12]
    import pyarrow.parquet as pq

    metadata = pq.ParquetFile(next(f for f in sorted((tmp_path / "tokens").glob("part-*")) if pq.ParquetFile(f).metadata.num_rows)).metadata
    columns = {metadata.row_group(0).column(k).path_in_schema: metadata.row_group(0).column(k) for k in range(metadata.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    empty = str(tmp_path / "none")
    token_store.write_tokens(docs.limit(0), empty, path, 1)
    assert token_store.token_digests(spark, empty).count() == 0
