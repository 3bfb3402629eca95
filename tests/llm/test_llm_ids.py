import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward_rows, collected, docs_frame
from tokenizers import Tokenizer

from trailmarts.llm import id_files, packing, simple8b, tokens
from trailmarts.llm.queries import tokenizer_path
from trailmarts.session import fresh_dir

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.lists(st.integers(0, 64).flatmap(lambda b: st.integers(0, 2**b - 1)), max_size=3000))
@settings(max_examples=60, deadline=None)
def test_coding_round_trip(ids):
    packed = simple8b.encode(np.array(ids, np.uint64))
    assert simple8b.decode(packed).tolist() == ids
    for block in range(len(packed.blocks)):
        assert simple8b.decode(packed, block, block + 1).tolist() == ids[block * 1024:(block + 1) * 1024]


def test_words_are_filled():
    assert len(simple8b.encode(np.ones(6 * 1024, np.uint64)).words) == 6 * 18  # 60 to a word, 18 words to a block
    assert len(simple8b.encode(np.full(1024, 2**61, np.uint64)).exceptions) == 1024


PARTS = [*"aB.,' \n\t\r1!é日😀\x1c\xa0 <|>", "the", " the", " it.\n", "\nOn", "  ", "'s", "<|endoftext|>", "y" * 70]


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), max_size=8))
@settings(max_examples=150, deadline=None)
def test_cut_texts_encode_as_whole_ones(texts):
    whole = tokens.Encoder.of(PATH)
    assert whole_ids(whole, texts) == [[*whole.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in texts]


def whole_ids(encoder, texts):
    ids, edges = encoder.encode(pa.array(texts, pa.string()), 7)
    return [ids[a:b].tolist() for a, b in zip(edges, edges[1:])]


def test_steps_do_not_change_ids():
    texts = [t for _, t in awkward_rows(5, 30)]
    batches = [pa.record_batch([pa.array(range(i, min(i + 9, len(texts)))), pa.array(texts[i:i + 9], pa.string())], names=["k", "t"]) for i in range(0, len(texts), 9)]
    whole = tokens.Encoder.of(PATH)
    for step in (10, 500, 1 << 20):
        got = {}
        for keys, ids, edges in tokens.encoded(iter(batches), PATH, 7, step):
            got |= {k: ids[a:b].tolist() for k, a, b in zip(keys, edges, edges[1:])}
        assert got == dict(enumerate([*whole.tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in texts))


def test_store_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "ENTRIES", 5)
    own = tokens.Encoder(PATH)
    for text in ("a b c d e f g h", "a b c d e f g h i", "h i j " + "k" * 100):
        assert whole_ids(own, [text]) == [[*own.tokenizer.encode(text, add_special_tokens=False).ids, 7]]
        assert not [k for k in own.kept if len(k) > tokens.LONG]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


@pytest.mark.parametrize("segment,file", [(1 << 20, 64 << 20), (500, 3000)])
def test_files_give_back_all_ids(spark, tokenizer, monkeypatch, segment, file):
    monkeypatch.setattr(id_files, "SEGMENT_IDS", segment)
    monkeypatch.setattr(id_files, "FILE_BYTES", file)
    rows = [*awkward_rows(), (None, "no id"), (12, "twice"), (12, "twice"), (12, None)]
    want, start = [], 0
    for doc_id, text in by_id(rows):
        ids = plain_ids(tokenizer, text)
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert collected(id_files.round_trip(docs_frame(spark, rows), PATH)) == sorted(want, key=repr)


def test_broken_file_is_noticed(spark, tmp_path):
    name = tmp_path / "x.s8b"
    name.write_bytes(id_files.segment([1], [np.arange(9, dtype="<u4")])[:-3])
    with open(name, "rb") as stream, pytest.raises(ValueError, match="ends within"):
        list(id_files.segments(stream))


def test_no_documents(spark):
    none = docs_frame(spark, [])
    assert id_files.round_trip(none, PATH).collect() == []
    assert packing.pack(none, PATH).collect() == []


def test_packing_keeps_each_id_once(spark, tokenizer):
    rows = [*awkward_rows(3, 300), (None, "no id here")]
    found = packing.pack(docs_frame(spark, rows), PATH, with_ids=True).collect()
    ids = {doc_id: plain_ids(tokenizer, text) for doc_id, text in rows}
    pieces, sequences = {}, {}
    for r in found:
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert own == ids[r.doc_id][r.start:r.start + r.length] and r.ids_crc32 == crc(own) and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, own in pieces.items():
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == len(ids[doc_id])
    assert pieces.keys() == ids.keys()
    short = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
        short += at < 1024
    assert short <= 3  # one for each task


def test_lowest_cost_sequence_is_taken():
    placed, left = packing.balance([600, 500, 400, 300, 200], 2, 1024, 1.0, 1 / 1024)
    assert [(d, n, s) for d, _, n, s in placed] == [(0, 600, 0), (1, 500, 1), (2, 400, 1), (3, 300, 0), (4, 124, 1), (4, 76, 0)] and not left
    placed, left = packing.balance([1000, 1000, 1000], 2, 1024, 1.0, 1.0)
    assert sum(n for _, _, n, _ in placed) == 2048 and left == [(2, 48)]


def test_costs_are_even():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 1000, 3000).tolist()
    placed, _ = packing.balance(lengths, sum(lengths) // 1024, 1024, 1.0, 1 / 1024)
    cost = np.zeros(sum(lengths) // 1024)
    for _, _, n, s in placed:
        cost[s] += n + n * n / 1024
    assert cost.std() < 0.25 * cost.mean()
