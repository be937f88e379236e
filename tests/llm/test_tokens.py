import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import bpe, packing, spans, token_store
from siltstone.llm.queries import BYTE_BPE

from .common import DATA, frame, stored, words


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("bits", [6, 16])
def test_ids_equal_the_library(reference, bits):
    encoder, rng = bpe.ByteBpe(BYTE_BPE, 2, bits), random.Random(3)
    letters = [*"aB é\n  \t'st1.,#ñß×…日d \x1c я", "<|endoftext|>", "don't", "we'll"]
    for _ in range(300):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 5))]
        ids, at = encoder.encode(*spans.text_buffer(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [reference(t) for t in texts]


def thue_morse(k, flip=False):
    s = "ba" if flip else "ab"
    for _ in range(k - 1):
        s += s.translate(str.maketrans("ab", "ba"))
    return s


@pytest.mark.parametrize("bits", [6, 16])
@pytest.mark.parametrize("kept", [64, 1 << 20])
def test_pre_tokens_of_equal_hash(reference, bits, kept, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", kept)
    texts = [thue_morse(k, f) for k in (10, 11, 12) for f in (False, True)]
    data, offsets = spans.text_buffer(pa.array(texts))
    keys = spans.hash_spans(data, offsets[:-1], offsets[1:])
    assert len(set(keys.tolist())) < len(texts)  # they do collide
    encoder = bpe.ByteBpe(BYTE_BPE, 2, bits)
    for some in ([texts[0]], texts, texts[::-1], texts):
        ids, at = encoder.encode(*spans.text_buffer(pa.array(some)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [reference(t) for t in some]


def test_added_tokens(reference):
    mark = "<|endoftext|>"
    texts = [mark, f"hello {mark} world", f"{mark}{mark}x", f"a  {mark}  b", f"<|endo", "ftext|>", f"it's{mark}'s don't", f"ß {mark}ß…", "<|endoftext|", f"<|{mark}|>", ""]
    encoder = bpe.ByteBpe(BYTE_BPE, 2, 10)
    for some in (texts, texts[::-1]):
        ids, at = encoder.encode(*spans.text_buffer(pa.array(some)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [reference(t) for t in some]
    assert reference(texts[1]) == [31373, 220, 50256, 995, 2]


def edge_rows():
    return [(3, " ".join(words(3000, 1))), (1, None), (2, ""), (5, "a"), (5, "a"), (4, "x" * 5000), (None, "no id"), (-7, "Übermaß, naïve"), (6, "a " * 700)]


def test_pieces_and_places(spark, reference):
    rows = edge_rows() + [(100 + i, " ".join(words(i % 37 + 1, i))) for i in range(300)]
    got = packing.pack_documents(frame(spark, rows), BYTE_BPE, 256).collect()
    want = []
    for doc, text in rows:
        ids = reference(text)
        n = -(-len(ids) // 256)
        head = len(ids) - (n - 1) * 256
        cuts = [0, *range(head, len(ids) + 1, 256)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want.append((doc is None, doc or 0, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans_ in places.values():
        at = 0
        for offset, length in sorted(spans_):
            assert offset == at
            at += length
        assert at <= 256
    assert len(places) <= -(-sum(x[4] for x in want) // 256) * 1.05 + 1


def test_no_documents(spark):
    assert packing.pack_documents(frame(spark, []), BYTE_BPE).count() == 0
    assert token_store.round_trip(frame(spark, []), BYTE_BPE).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_plan_equals_placing_one_by_one(counts):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [i for i, left in enumerate(rooms) if left >= length]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(64 - length)
    used, ranks = {}, {n: set() for n in counts}
    for length, rank, n, first, offset in packing.plan(counts, 64):
        for j in range(n):
            assert rank + j not in ranks[length]
            ranks[length].add(rank + j)
            used.setdefault(first + j, []).append((offset, length))
    assert all(ranks[n] == set(range(c)) for n, c in counts.items())
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert len(used) == len(rooms)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano(gaps):
    values = np.cumsum(np.array(gaps, np.int64))
    fano = token_store.EliasFano.of(values)
    assert fano.values().tolist() == values.tolist() == [fano.select(i) for i in range(len(values))]
    if len(values) > 64:
        assert len(fano.low) + len(fano.high) + 4 * len(fano.samples) < 8 * len(values)


def test_store_round_trip(spark, reference, monkeypatch, tmp_path):
    rows = edge_rows() + [(5, f"again {i} " * 60) for i in range(40)] + [(None, f"nameless {i}") for i in range(30)]
    monkeypatch.setattr(token_store, "BLOCK_IDS", 500)
    monkeypatch.setattr(token_store, "FILE_BLOCKS", 2)
    monkeypatch.setattr(token_store, "TASK_BYTES", 300)
    got = token_store.round_trip(stored(spark, tmp_path, rows), BYTE_BPE).collect()
    made = {}
    for r in got:
        made.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    at = 0
    for doc in sorted({r[0] for r in rows}, key=lambda d: (d is not None, d or 0)):
        want = sorted((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in (reference(t) for d, t in rows if d == doc))
        own = sorted(made[doc])
        assert sorted((n, c) for _, n, c in own) == want
        for start, n, _ in own:  # gapless, in any order among equal ids
            assert start == at
            at += n
    assert len(got) == len(rows)


def test_block_gets_documents():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 400, 300)
    ids = rng.integers(0, 60_000, int(lengths.sum())).astype(np.uint32)
    ends = np.cumsum(lengths)
    content = b"".join(token_store.block(3, i, list(range(300)), ids, ends) + b"\n" for i in range(2))
    for i, b in enumerate(token_store.blocks(memoryview(content))):
        assert (b.number, b.sequence, len(b)) == (3, i, 300)
        assert all(b.get(k).tolist() == ids[ends[k] - lengths[k] : ends[k]].tolist() for k in (0, 1, 63, 64, 65, 128, 299))


def test_store_whole_table(spark, reference):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.round_trip(rows, BYTE_BPE).collect()}
    at = 0
    for r in rows.orderBy("doc_id").collect():
        ids = reference(r.text)
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
