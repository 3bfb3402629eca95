"""Ids are those of the tokenizer as loaded: the string of an added token is that token."""

import pyarrow as pa
from llm_cases import collected, docs_frame
from test_llm_ids import PATH, crc
from tokenizers import Tokenizer

from trailmarts.llm import id_files, packing, tokens

TEXTS = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>\n b", "two  spaces <|endoftext|>\n\nand more ", "<|endoftext|> x", "<|endoftext |> no token", "", "plain text", None]


def test_added_tokens_keep_their_ids(spark):
    loaded = Tokenizer.from_file(PATH)
    want = [loaded.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert want[1] == [64, 220, 50256, 275]
    ids, edges = tokens.Encoder(PATH).encode(pa.array(TEXTS, pa.string()), 7)
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [[*w, 7] for w in want]
    docs = docs_frame(spark, list(enumerate(TEXTS)))
    rows, start = [], 0
    for i, w in enumerate(want):
        rows.append((i, start, len(w) + 1, crc([*w, 0])))
        start += len(w) + 1
    assert collected(id_files.round_trip(docs, PATH)) == sorted(rows, key=repr)
    assert {(r.doc_id, r.doc_tokens) for r in packing.pack(docs, PATH).collect()} == {(i, len(w) + 1) for i, w in enumerate(want)}
