"""Token ids of whole texts by a byte-level BPE tokenizer, each distinct word encoded once per worker.

The tokenizer splits a text into words before it merges bytes, and a word with
its leading space never depends on its neighbours. So a text may be cut before
any single space, and at any single line break, that has no other white space
beside it; the pieces' ids, joined, are the text's ids. Texts that hold the
string of an added token are encoded whole, as the tokenizer does by default: the
string is that token. A batch is cut and its
distinct pieces are found in Arrow, and their ids come from a store of pieces
with a fixed number of entries: an Arrow array of pieces and one of all their ids,
so that a known piece never becomes a Python object. When it is full, the pieces
that were used last stay. A stop after a letter is a word of its own, so pieces
are looked up without it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ENTRIES = 1_000_000  # pieces in a worker's store, at most, when a step begins
LONG = 64  # pieces of more bytes are encoded but not kept
TOGETHER = 4096  # pieces encoded in one call
STEP_CHARS = 8_000_000  # bytes of text encoded in one step
GAP = re.compile(r"(?<=\S) (?=\S)")
#: White space that is not a single space or line break between words.
ODD = "  |\n\n| \n|\n |^[ \n]|[ \n]$|[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LETTERS = "\u0250"  # below, isalpha() is the tokenizer's own notion of a letter
#: The characters that stand for bytes in a byte-level vocabulary.
BYTES = dict(zip([b for b in range(256) if not chr(b).isprintable() or b == 32], range(256, 512)))
ENDED = r"\p{L}[.,]\z"  # a stop after a letter


class Encoder:
    """Texts to unsigned 32-bit ids."""

    _own: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        splits = self.tokenizer.pre_tokenizer
        #: A space and letters are one word of the byte-level split, which the model may merge at once.
        self.by_letters = self.tokenizer.normalizer is None and type(splits).__name__ == "ByteLevel" and splits.use_regex
        self.merge = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = pa.array([], pa.large_string())  # the store: pieces, where the ids of each begin, how many they are, all ids, the step of the last use
        self.begins, self.lengths, self.blob = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")
        self.used, self.step = np.empty(0, np.int64), 0
        self.line, self.stop, self.comma = (self._encode([c])[0] for c in "\n.,")

    @property
    def kept(self) -> list[str]:
        return self.words.to_pylist()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder for this file."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _encode(self, strings: list[str]) -> np.ndarray:
        return np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text's followed by ``end_id``, and where each text's begin (and the last ones end). Null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = self._holds_added(texts)
        odd = pc.or_(pc.match_substring_regex(texts, ODD), whole)
        # A line break in front makes the first piece like all others; its id is taken off again.
        plain = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), pc.if_else(odd, pa.scalar("", pa.large_string()), texts), pa.scalar("", pa.large_string()))
        pieces = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        ids, ends = self._ids(pieces.flatten())
        edges = ends[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
        ids = np.append(ids[1:], np.uint32(end_id))  # each text gives up its first id and gets an end
        ids[edges[1:] - 1] = end_id
        return self._with_odd(texts, odd, whole, ids, edges, end_id) if pc.any(odd).as_py() else (ids, edges)

    def _holds_added(self, texts: pa.Array) -> pa.Array:
        found = pa.array(np.zeros(len(texts), bool))
        for token in self.added:
            found = pc.or_(found, pc.match_substring(texts, token))
        return found

    def _with_odd(self, texts: pa.Array, odd: pa.Array, whole: pa.Array, ids: np.ndarray, edges: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Put in the texts with other white space, cut at single spaces only, and those with added tokens, not cut."""
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        cut = [[texts[i].as_py()] if whole[i].as_py() else GAP.split(texts[i].as_py()) for i in rows.tolist()]
        tails, ends = self._ids(pa.array([p for _, *rest in cut for p in rest], pa.large_string()))
        own, at = {}, 0
        for i, (head, *rest) in zip(rows.tolist(), cut, strict=True):
            own[i] = np.concatenate([self._encode([head]), tails[ends[at]:ends[at + len(rest)]], np.array([end_id], "<u4")])
            at += len(rest)
        parts = [own[i] if i in own else ids[edges[i]:edges[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, each with a leading space unless it begins with a line break or is empty; 0 and where each piece's end."""
        coded = pieces.dictionary_encode()
        place, distinct = coded.indices.to_numpy(), coded.dictionary
        ended = pc.match_substring_regex(distinct, ENDED)
        stems = pc.if_else(ended, pc.utf8_slice_codeunits(distinct, 0, -1), distinct).dictionary_encode()
        blob, begins, lengths = self._found(stems.dictionary)
        begins, lengths = begins[stems.indices.to_numpy()], lengths[stems.indices.to_numpy()]
        ended = ended.to_numpy(zero_copy_only=False)
        n = (lengths + ended)[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(begins[place] - ends[:-1], n)
        at += np.arange(ends[-1])
        ids = blob[at]  # the place after a stem is that of its stop
        last = np.where(pc.ends_with(distinct, ".").to_numpy(zero_copy_only=False), self.stop, self.comma)
        stops = ended[place]
        ids[ends[1:][stops] - 1] = last[place[stops]]
        return ids, ends

    def _found(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, one id more, and for each of these distinct pieces where its ids begin and how many they are. New ones join the store."""
        self._trim()
        self.step += 1
        at = pc.index_in(pieces, value_set=self.words)
        new = at.is_null()
        at = pc.fill_null(at, 0).to_numpy()
        rows = np.flatnonzero(new.to_numpy(zero_copy_only=False))
        missing = pieces.filter(new)
        ids, starts, lengths = self._coded(missing.to_pylist())
        starts += len(self.blob)
        self.used[np.delete(at, rows)] = self.step
        found = [np.empty(len(pieces), np.int64) if len(rows) == len(pieces) else column[at] for column in (self.begins, self.lengths)]
        found[0][rows], found[1][rows] = starts, lengths
        blob = np.concatenate([self.blob, ids, np.zeros(1, "<u4")])
        short = pc.less_equal(pc.binary_length(missing), LONG)
        stays = short.to_numpy(zero_copy_only=False)
        self.words = pa.concat_arrays([self.words, missing.filter(short)])
        self.begins, self.lengths = np.append(self.begins, starts[stays]), np.append(self.lengths, lengths[stays])
        self.used, self.blob = np.append(self.used, np.full(stays.sum(), self.step)), blob[:-1]
        return blob, *found

    def _trim(self) -> None:
        """Halve a store that is full, and let go of ids that no piece in it has."""
        if len(self.words) > ENTRIES:
            stay = np.sort(np.argsort(-self.used, kind="stable")[:ENTRIES // 2])
            self.words, self.begins, self.lengths, self.used = self.words.take(pa.array(stay)), self.begins[stay], self.lengths[stay], self.used[stay]
        ends = np.cumsum(self.lengths)
        total = int(ends[-1]) if len(ends) else 0
        if total < len(self.blob):
            self.blob = self.blob[np.repeat(self.begins - ends + self.lengths, self.lengths) + np.arange(total)]
            self.begins = ends - self.lengths

    def _coded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of these pieces, where each one's begin, and how many they are."""
        kinds: dict[str, list[str]] = {"letters": [], "word": [], "line": [], "rest": []}
        for p in pieces:
            if self.by_letters and p.isalpha() and (p.isascii() or max(p) < LETTERS):
                kinds["letters"].append(p)
            elif p:
                word = p[1:] if p[0] == "\n" else p
                kinds["rest" if " " in word or not word.isprintable() or not word else "word" if word is p else "line"].append(p)
        ids, lengths = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for at in range(0, len(kinds["letters"]), TOGETHER):
            merged = [self.merge("\u0120" + p if p.isascii() else f" {p}".encode().decode("latin-1").translate(BYTES)) for p in kinds["letters"][at:at + TOGETHER]]
            ids.append(np.fromiter(map(attrgetter("id"), chain.from_iterable(merged)), "<u4"))
            lengths.append(np.fromiter(map(len, merged), np.int64, len(merged)))
        for kind, front, between in (("word", " ", "\n "), ("line", "", "")):  # no other white space within: cut again at the line breaks
            for at in range(0, len(kinds[kind]), TOGETHER):
                part = self._encode([front + between.join(kinds[kind][at:at + TOGETHER])])
                breaks = part == self.line
                ids.append(part[~breaks] if between else part)
                lengths.append(np.diff(np.flatnonzero(np.concatenate([[True], breaks, [True]]))) - 1 if between else np.diff(np.flatnonzero(np.append(breaks, True))))
        for p in kinds["rest"]:
            ids.append(self._encode([p if p[0] == "\n" else " " + p]))
            lengths.append(np.array([len(ids[-1])]))
        lengths = np.concatenate(lengths)
        starts = np.cumsum(lengths) - lengths
        if len(kinds["letters"]) == len(pieces):
            return np.concatenate(ids), starts, lengths
        place = {p: i for i, p in enumerate(chain(*kinds.values()))}
        order = np.fromiter((place.get(p, -1) for p in pieces), np.int64, len(pieces))  # only the empty piece has no place
        return np.concatenate(ids), np.append(starts, 0)[order], np.append(lengths, 0)[order]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, step: int = STEP_CHARS) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Keys, ids and their edges of tables (key, text), in steps of about ``step`` bytes of text."""
    encoder, held, size = Encoder.of(path), [], 0
    for batch in batches:
        n, start = batch.num_rows, 0
        lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) if n else []
        while start < n:
            before = lengths[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(lengths, before + step - size, "right")))
            held.append(batch.slice(start, stop - start))
            size += int(lengths[stop - 1] - before)
            start = stop
            if size >= step or start < n:
                yield _step(encoder, held, end_id)
                held, size = [], 0
    if held:
        yield _step(encoder, held, end_id)


def _step(encoder: Encoder, held: list[pa.RecordBatch], end_id: int) -> tuple[list, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(held)
    ids, edges = encoder.encode(table.column(1).combine_chunks(), end_id)
    return table.column(0).to_pylist(), ids, edges
