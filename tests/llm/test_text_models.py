"""Tokens, records, packing, the piece codec, chat formatting: round trips and the libraries themselves."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexforge.llm import chat_format, packing, piece_codec, token_records
from lexforge.llm._tokens import encode_texts

HARD = [
    "", " ", "  a  b ", "\n\n x's  isn't\t\t", "a, b. c\nD.\nE, f", "a ,b .c", "a,b.c,d", "Ünï ﬁ é́ '\x00' \x01a <|endoftext|> b<|endoftext|>c", "日本 語　テキスト x  y", "a \n b",
    " lead", "trail ", "ΑΣ ΟΔΟΣ Ⅷ²³ x²", "don't  '''s I'LL '\n'", "\r\n a\rb\x1c c\x85d", "x" * 300 + " " + "é" * 200, "İstanbul ǅ ß", "one.two three,four 1.5 2,000", "😀 😀x", "▁x ▁▁ y", "<s> </s> [INST]", "...", "a. b.\n\nc",
    "hello <|endoftext|> there <unk> </s>", "<|endoftext|>", "<|startoftext|>a b<|startoftext|> c", "a <|ENDOFTEXT|> b", "plain words<|endoftext|>\n more. Words",
]


def model(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@pytest.mark.parametrize(("name", "split"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(st.characters(codec="utf-8"), max_size=40) | st.text("aB'.,\n é1|", max_size=40) | st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "a b", " ", ".", "\n"]), max_size=6).map("".join), max_size=5))
def test_encoding_equals_the_library(name, split, texts):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    texts = HARD + texts
    got = list(encode_texts(pa.array(texts), model(name), name, 4, split))
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_records(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "null id"), (3, None), (3, "again")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    manifest = token_records.write_records(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, folder=f"file://{tmp_path}/r")
    got = sorted(map(tuple, token_records.read_digests(manifest).drop("file", "record").collect()), key=lambda r: r[1])
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert got.pop(0) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    row = manifest.head()
    shuffled = list(token_records.read_shuffled(row.path, row.index_path, 5))
    assert len(shuffled) == row.n_records and sorted(len(x) for _, x in shuffled) == sorted(len(x) for _, x in token_records.read_shuffled(row.path, row.index_path, 6))
    empty = token_records.write_records(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    assert token_records.read_digests(empty).count() == 0


def test_damage_is_noticed():
    data = token_records.frame(b"payload") + token_records.frame(b"")
    assert list(token_records.unframe(io.BytesIO(data))) == [b"payload", b""]
    for at in (0, 9, 14, 20):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(token_records.unframe(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(token_records.unframe(io.BytesIO(data[:-5])))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(rule):
    lengths = np.random.default_rng(2).integers(1, 300, 800)
    bins, offsets = packing.best_fit(lengths, 512, 5, 100_000.0, (1.0, 0.2, 0.2), rule)
    for b in set(bins.tolist()):
        inside = np.flatnonzero(bins == b)
        order = inside[np.argsort(offsets[inside])]
        assert len(order) <= 5 and lengths[order].sum() <= 512 and (lengths[order].astype(float) ** 2).sum() <= 100_000
        assert offsets[order].tolist() == np.concatenate(([0], np.cumsum(lengths[order])[:-1])).tolist()
    with pytest.raises(ValueError):
        packing.best_fit(np.array([600]), 512, 5, 1e9)


def test_best_fit_is_near_the_bound():
    lengths = np.random.default_rng(3).integers(5, 1500, 5000)
    bins, _ = packing.best_fit(lengths, 4096, 1024, 4096.0**2)
    assert bins.max() + 1 <= -(-lengths.sum() // 4096) + 2
    # documents and attention take part in the choice of a bin, and the documents' capacity binds
    by_tokens, _ = packing.best_fit(lengths, 4096, 1024, 4096.0**2, (1.0, 0.0, 0.0))
    assert (bins != by_tokens).any() and by_tokens.max() == bins.max()
    short, _ = packing.best_fit(np.full(4000, 2), 4096, 1024, 4096.0**2)
    assert np.bincount(short).tolist() == [1024, 1024, 1024, 928]


def test_pack_documents(spark):
    rows = [(1, "word " * 9000), (2, None), (3, ""), (4, "a b"), (4, "a b"), (None, "x")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, shard int")
    got = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096).collect()
    whole, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, t in rows:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        pieces += [(i or -1, at // 4096, at, zlib.crc32(ids[at : at + 4096].tobytes())) for at in range(0, len(ids), 4096)]
    assert sorted(((r.doc_id or -1), r.piece, r.start, r.ids_crc32) for r in got) == sorted(pieces)
    assert sorted(((r.doc_id or -1), r.piece, r.length) for r in got) == [(-1, 0, 2), (1, 0, 4096), (1, 1, 4096), (1, 2, 809), (2, 0, 1), (3, 0, 1), (4, 0, 3), (4, 0, 3)]
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == 3
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096).count() == 0


@pytest.fixture(scope="module")
def codec():
    return piece_codec.PieceCodec(model("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.characters(codec="utf-8"), max_size=60) | st.text("abeht ▁\n.é", max_size=80))
def test_pieces_equal_the_library(codec, library, text):
    ids = library.encode(text)
    assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids)
    n, _, _ = next(iter(codec.digests(pa.array([text]))))
    assert n == len(ids)


def test_both_agendas_agree(codec):
    rng = random.Random(7)
    for _ in range(300):
        chunk = "▁" + "".join(rng.choice("abcdehilnorstu.é") for _ in range(rng.randrange(1, 24)))
        assert codec._short(chunk) == codec._long(chunk)


def test_piece_query_edges(spark, library):
    import hashlib

    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, None), (1, "x"), (1, "x")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, piece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)


PARTS = st.lists(st.sampled_from([*chat_format.CONTROL, "\\", "<", "[", "|im_end|>", "\n", "%0A", "%", "ok", "<\\|im_end|>", "s>", " "]), max_size=8).map("".join)


def test_chat_round_trip(spark):
    texts = []

    @settings(max_examples=300, deadline=None)
    @given(st.tuples(PARTS, PARTS))
    def gather(pair):
        texts.append(pair)

    gather()
    rows = [(i, 0, role, text) for i, (role, text) in enumerate(texts)] + [(i, 1, "assistant", text) for i, (_, text) in enumerate(texts)]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    loss = chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    got = {r.conv_id: r for r in out.select("*", loss.alias("loss")).collect()}
    for i, (role, text) in enumerate(texts):
        assert got[i].round_trip and [tuple(t) for t in got[i].turns] == [(role, text), ("assistant", text)]
        assert got[i].loss == (text if role == "assistant" else "") + text
        body = got[i].formatted.replace(chat_format.ChatTemplate().open, "").replace("<|im_end|>\n", "")
        assert not any(c in body for c in chat_format.CONTROL)


def test_chat_edges(spark):
    rows = [(1, None, "user", None), (1, 2, None, "b"), (1, 2, "assistant", "a"), (None, 0, "assistant", "é"), (2, 0, "system", "")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", ""), ("", "b"), ("assistant", "a")] and got[None].round_trip
    assert chat_format.format_conversations(df.limit(0)).count() == 0
