"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has one encoding, so its last token is unique. For each prefix, an automaton over the
vocabulary gives the tokens that end there, longest first. A token that is the prefix is its last token if
BPE makes it of its own symbols. Any other token is the last one if it is compatible with the last token of
the prefix before it: BPE, run on the two side by side, keeps them apart. Back-pointers from the end of the
word give the ids.

Compatibility of two tokens is decided from merge ranks alone, by undoing merges at the boundary from the
latest to the earliest: the pair that then touches must not merge before one of the two was consumed.
"""
from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .pretokens import ADDED, Memo, PreTokenizer, tokenizer_json

#: Added to the code point of a word's last symbol, where the vocabulary has a symbol of its own for it.
LAST = 0x1000
PAIRS = 2_000_000
UNITS = 250_000
WORDS = 150_000


class PrefixBpe:
    def __init__(self, content: str):
        model = json.loads(content)["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("a BPE model without byte fallback, prefixes, dropout or ignored merges is needed")
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.rank_of = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, (x, y) in enumerate(merges):
            made, a, b = vocab[x + y], vocab[x], vocab[y]
            self.rank[a, b] = r
            self.parts.setdefault(made, (a, b))
            self.rank_of.setdefault(made, r)
        self.made = {(a, b): vocab[x + y] for (x, y), (a, b) in zip(merges, self.rank)}
        self.by_symbols = {self.symbols(t): i for t, i in vocab.items()}
        self.text = {i: t for t, i in vocab.items()}
        self._apart: dict[int, dict[int, bool]] = {i: {} for i in self.text}
        self._pairs = 0
        # Only a token that BPE makes of its own symbols can stand in an encoding: both its parts are such
        # tokens, and they stay apart until the merge that makes it.
        whole = {i for s, i in self.by_symbols.items() if len(s) == 1}
        for (a, b), i in self.made.items():
            if a in whole and b in whole and self.parts[i] == (a, b) and self._stay_apart(a, b, self.rank[a, b]):
                whole.add(i)
        self.automaton = ahocorasick.Automaton()
        for s, i in self.by_symbols.items():
            if i in whole:
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()

    def forget(self) -> None:
        self._apart, self._pairs = {i: {} for i in self.text}, 0

    def symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + LAST)
        return token

    def word(self, pretoken: str) -> str:
        return pretoken[:-1] + chr(ord(pretoken[-1]) + LAST) if self.suffix else pretoken

    def plain(self, symbols: str) -> list[int]:
        """Merge after merge, as BPE is defined; for single tokens and for tests."""
        ids = [self.by_symbols[c] for c in symbols]
        while len(ids) > 1:
            r, at = min((self.rank.get(p, math.inf), i) for i, p in enumerate(zip(ids, ids[1:])))
            if r == math.inf:
                break
            ids[at : at + 2] = [self.made[ids[at], ids[at + 1]]]
        return ids

    def apart(self, x: int, y: int) -> bool:
        """Whether BPE leaves x and y, side by side, as they are."""
        if self._pairs >= PAIRS:
            self.forget()
        self._pairs += 1
        got = self._apart[x][y] = self._stay_apart(x, y)
        return got

    def _stay_apart(self, x: int, y: int, own: int = -1) -> bool:
        """own: the rank of the merge of x and y themselves, where it is allowed."""
        until, tie = math.inf, False  # the rank at which x or y is consumed; on equal ranks the left pair goes first
        while True:
            r = self.rank.get((x, y))
            if r is not None and r != own and (r < until or tie and r == until):
                return False
            rx, ry = self.rank_of.get(x, -1), self.rank_of.get(y, -1)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                until, tie, x = rx, False, self.parts[x][1]
            else:
                until, tie, y = ry, True, self.parts[y][0]

    def encode(self, pretoken: str) -> list[int]:
        symbols = self.word(pretoken)
        n = len(symbols)
        last, size, known = [-1] * n, [0] * n, self._apart
        for end, (token, k) in self.automaton.iter(symbols):
            if last[end] < 0:
                before = end - k
                if before >= 0:
                    x = last[before]
                    ok = known[x].get(token)
                    if ok is None:
                        ok = self.apart(x, token)
                    if not ok:
                        continue
                last[end], size[end] = token, k
        ids = []
        at = n - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids


class Codec:
    """Texts to (number of ids, ids in decimal, decoded text); units and words met lately are remembered."""

    def __init__(self, content: str):
        spec = json.loads(content)
        if spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("a decoder or post-processor isn't supported")
        self.pre, self.bpe = PreTokenizer(content), PrefixBpe(content)
        self.name = self.bpe.text | {i: t for t, i in self.pre.added.items()}
        self.added = {ADDED + t: (1, str(i), t) for t, i in self.pre.added.items()}
        self.forget()

    def forget(self) -> None:
        """Lets go of what is remembered: some 100 MB that a Python worker would else keep while it does other work."""
        self.words = Memo(self.word, WORDS)
        self.young: dict[bytes, tuple[int, str, str]] = {}
        self.old: dict[bytes, tuple[int, str, str]] = {}
        self.bpe.forget()

    def decode(self, ids: list[int]) -> str:
        """Without a decoder the library puts a blank between tokens."""
        return " ".join([self.name[i] for i in ids])

    def word(self, pretoken: str) -> tuple[int, str, str]:
        if pretoken in self.added:
            return self.added[pretoken]
        ids = self.bpe.encode(pretoken)
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def unit(self, unit: bytes) -> tuple[int, str, str]:
        parts = [self.words(p) for p in self.pre.of(unit)]
        if len(parts) == 1:
            return parts[0]
        return sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])

    def __call__(self, text: bytes) -> tuple[int, str, str]:
        if len(self.young) > UNITS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        units = self.pre.units(text)
        parts = list(map(young.get, units))
        if None in parts:
            for i, p in enumerate(parts):
                if p is None:
                    u = units[i]
                    parts[i] = young.get(u) or young.setdefault(u, old.get(u) or self.unit(u))
        if not all([p[0] for p in parts]):
            parts = [p for p in parts if p[0]]
        return sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])


@lru_cache(maxsize=1)
def shared_codec(content: str) -> Codec:
    return Codec(content)


def bpe_round_trip(docs: DataFrame, path: str | None = None, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row of docs; with keep also ids and decoded.

    Null texts count as empty (no ids, the digests of nothing); repeated and null doc_ids are kept as they are.
    Strings of added tokens inside a text become those tokens, as in the library. An empty table gives no rows.
    """
    content = tokenizer_json(path)
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(shared.value)
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    n, ids_sha, text_sha, ids, texts = [], [], [], [], []
                    for text in batch.column(1).to_pylist():
                        count, line, decoded = codec(text)
                        n.append(count)
                        ids_sha.append(hashlib.sha256(line.encode()).hexdigest())
                        text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                        if keep:
                            ids.append(np.array(line.split(), "<i4"))
                            texts.append(decoded)
                    columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())] if keep else []
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])
        finally:
            codec.forget()
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep)
