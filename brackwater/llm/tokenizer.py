"""Encoding by a public byte-level BPE vocabulary with a tokenization automaton.

States are the last token emitted, arcs are labelled with tokens.  An arc from state s under token t exists exactly if
the gadgets of all merges, put in one after the other, leave it in place.  The gadget of the merge (u, v) -> uv adds an
arc uv beside every path u v and takes the arc v out of the state after u, from left to right.  Unrolled for one arc: the
later built of s and t is taken apart, and the two tokens that then meet must not be merged earlier than it was built
(nor by the same merge, if the right one was taken apart: the left merge would have come first).  Arcs are compiled that
way at first use and kept in the transition table; the complete table of 50,000 merges would have billions of cells.

A pre-split word is read once: every prefix has exactly one state, found by table transitions over the tokens that end
there.  Decoding emits the bytes of the arc labels.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
# Fixed value: the public pre-split pattern of byte-level BPE.
PRE_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS_KEPT, ARCS_KEPT = 400_000, 2_000_000  # sizes of the memory of words and arcs; beyond them it starts anew


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write the 256 bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        special = [k for k in model["vocab"] if any(c not in letters for c in k)]
        self.label = {i: to_bytes(k) for k, i in model["vocab"].items() if k not in special}
        self.token = {b: i for i, b in self.label.items()}
        self.token.pop(b"<|endoftext|>", None)
        self.halves: dict[int, tuple[int, int]] = {}
        self.built: dict[int, int] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            a, b = self.token[to_bytes(u)], self.token[to_bytes(v)]
            whole = self.token[self.label[a] + self.label[b]]
            if whole not in self.halves:
                self.halves[whole], self.built[whole] = (a, b), rank
            self.merge[a, b] = rank
        self.longest = max(map(len, self.token))
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PRE_SPLIT).findall

    def arc(self, s: int, t: int) -> bool:
        """Does the state after s have an arc t?"""
        key = s << 32 | t
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) > ARCS_KEPT:
                self.arcs.clear()
            known = self.arcs[key] = self._gadgets(s, t)
        return known

    def _gadgets(self, s: int, t: int) -> bool:
        built, merge, halves = self.built, self.merge, self.halves
        before = 1 << 60  # merges with a smaller rank than this have been put in
        while True:
            if merge.get((s, t), before) < before:
                return False
            at_s, at_t = built.get(s, -1), built.get(t, -1)
            if at_s < 0 and at_t < 0:
                return True
            if at_s > at_t:
                before, s = at_s, halves[s][1]
            else:
                before, t = at_t + 1, halves[t][0]

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        whole = self.token.get(word)
        if whole is not None:
            return [whole]
        state, start = [-1] * (n + 1), [0] * (n + 1)
        for j in range(n):
            if j and state[j] < 0:
                continue
            for i in range(j + 1, min(n, j + self.longest) + 1):
                if state[i] >= 0:
                    continue
                t = self.token.get(word[j:i])
                if t is not None and (not j or self.arc(state[j], t)):
                    state[i], start[i] = t, j
        out, i = [], n
        while i:
            out.append(state[i])
            i = start[i]
        return out[::-1]

    def encode(self, text: str, out: array) -> None:
        words = self.words
        for word in self.split(text):
            ids = words.get(word)
            if ids is None:
                if len(words) > WORDS_KEPT:
                    words.clear()
                ids = tuple(self.encode_word(word.encode()))
                if len(word) < 64:
                    words[word] = ids
            out.extend(ids)

    def decode(self, ids) -> bytes:
        return b"".join(self.label[i] for i in ids)


_loaded: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """One automaton a worker process."""
    if path not in _loaded:
        _loaded[path] = Automaton(path)
    return _loaded[path]


def _path(tokenizer_dir: str) -> str:
    return f"{tokenizer_dir}/{VOCABULARY}"


def _encoded(path: str, texts: pa.Array) -> tuple[array, np.ndarray]:
    a, flat = automaton(path), array("i")
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts.to_pylist()):
        if text:
            a.encode(text, flat)
        ends[i + 1] = len(flat)
    return flat, ends


def ids(documents: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of every row's whole text, without special tokens; null and empty texts give an empty list.

    Strings of special tokens in a text are ordinary text; rows stay as they are, repeated ids too.
    """
    path = _path(tokenizer_dir)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                flat, ends = _encoded(path, part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    slim = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(encode, "doc_id bigint, ids array<int>")


def counts(documents: DataFrame, columns: list[str], tokenizer_dir: str = TOKENIZER_DIR, text: str = "text") -> DataFrame:
    """`columns` of every row and n_tokens of its text."""
    path = _path(tokenizer_dir)
    slim = documents.select(*columns, F.col(text).alias("_text"))
    schema = slim.drop("_text").schema.add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                _, ends = _encoded(path, part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(ends))], names=[*columns, "n_tokens"])

    return slim.mapInArrow(count, schema)


def decoded(tokens: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the labels of the arcs, one after the other; an empty list gives an empty text."""
    path = _path(tokenizer_dir)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = automaton(path)
            texts = [a.decode(x or ()).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, text string")
