"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens, not characters, and accepts exactly the token sequences that
merging gives. It starts as one state with a loop for every base symbol. Each merge (u, v)
-> w, in order, adds a gadget: the state behind u is copied without its arc v, arcs u now
lead to the copy, and wherever u led to v there is an arc w to the state behind v. A merge
whose arc v is already gone adds nothing and its token is never made. All arcs of a token
lead to one state, so a state is known by the last token; a state's missing arcs are those
its gadgets took away, those taken from the right parts of its token before the token was
made, and what was later built on a missing arc.

Every prefix of a word has exactly one accepted sequence, so a word is encoded by walking
arcs that spell it, longest first, never entering a position twice. Transitions are kept in
a table once computed. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import map_slices
from fieldlens.llm.presplit import Presplit, ship_file

FOREVER = 1 << 40
#: Entries a task keeps of chunks and transitions before it starts over; bounds memory only.
KEPT_CHUNKS, KEPT_ARCS = 500_000, 1_000_000


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.vocab, self.end = vocab, end
        self.label = {i: s for s, i in vocab.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}                 # token -> number of the gadget that made it
        self.gadget: dict[tuple[int, int], int] = {}   # (u, v) -> number of the gadget that took arc v from behind u
        self.arcs: dict[int, bool] = {}
        for number, pair in enumerate(merges):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            self.add_gadget(number, vocab[a], vocab[b], vocab[a + b])
        self.start = {t for t in self.label if t in self.made or self.label[t] in self.base_symbols()}
        self.root: dict = {}                           # symbols to follow; "" holds the arc that ends here
        for t in self.start:
            node = self.root
            for c in self.symbols(self.label[t]):
                node = node.setdefault(c, {})
            node[""] = t

    def symbols(self, spelled: str) -> list[str]:
        """Letters; the last one and the mark that closes a word are one symbol."""
        if self.end and spelled.endswith(self.end) and spelled != self.end:
            return [*spelled[:-len(self.end) - 1], spelled[-len(self.end) - 1:]]
        return list(spelled)

    def base_symbols(self) -> set[str]:
        if not hasattr(self, "_base"):
            self._base = {s for s in self.vocab if len(s.removesuffix(self.end) if self.end else s) == 1}
        return self._base

    def add_gadget(self, number: int, u: int, v: int, w: int) -> None:
        known = all(t in self.made or self.label[t] in self.base_symbols() for t in (u, v))
        if not known or self.missing(u, v):
            return
        self.gadget[u, v] = number
        self.left[w], self.right[w], self.made[w] = u, v, number

    def missing(self, u: int, w: int) -> bool:
        """Whether the state behind u lacks arc w."""
        d, before = u, FOREVER
        while True:
            c, since = w, FOREVER
            while True:
                taken = self.gadget.get((d, c))
                # an arc equal to its own left part's gadget repeats one symbol: the left pair merges first
                if taken is not None and taken < before and taken <= since:
                    return True
                if c not in self.made:
                    break
                since, c = self.made[c], self.left[c]
            if d not in self.made:
                return False
            before, d = self.made[d], self.right[d]

    def step(self, u: int, w: int) -> bool:
        key = u << 24 | w
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= KEPT_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = not self.missing(u, w)
        return known

    def encode_word(self, word: str) -> list[int]:
        """The accepted tokens that spell a word given in base symbols."""
        whole = self.vocab.get(word + self.end)
        if whole in self.start:
            return [whole]
        symbols = self.symbols(word + self.end)
        n, root, step, known = len(symbols), self.root, self.step, self.arcs.get
        seen = bytearray(n + 1)
        path: list[int] = []
        left: list[tuple[list, int]] = []              # arcs not tried yet at each step of the path
        at, last = 0, -1
        while at < n:
            arcs, node = [], root
            for stop in range(at, n):
                node = node.get(symbols[stop])
                if node is None:
                    break
                token = node.get("")
                if token is not None:
                    arcs.append((token, stop + 1))
            while True:
                while arcs:                            # longest first
                    token, stop = arcs.pop()
                    if not seen[stop] and (last < 0 or known(last << 24 | token) or step(last, token)):
                        break
                else:
                    if not path:
                        raise ValueError(f"no accepted sequence spells {word!r}")
                    path.pop()
                    arcs, last = left.pop()
                    continue
                break
            seen[stop] = 1
            left.append((arcs, last))
            path.append(token)
            at, last = stop, token
        return path

    def decode(self, ids) -> list[str]:
        return [self.label[i] for i in ids]


class Encoder:
    """Encodes and decodes whole texts; keeps what a chunk gave while there is room."""

    def __init__(self, text_of_file: str):
        model = json.loads(text_of_file)["model"]
        self.split = Presplit(text_of_file)
        self.automaton = MergeAutomaton(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.label = {i: s.encode("utf-8") for s, i in (model["vocab"] | self.split.special).items()}
        self.kept: dict[str, tuple[bytes, bytes]] = {}

    def chunk(self, chunk: str) -> tuple[bytes, bytes]:
        if chunk in self.split.special:
            ids = [self.split.special[chunk]]
        else:
            ids = [i for w in self.split.words(chunk) for i in self.automaton.encode_word(w)]
        got = pack(f"<{len(ids)}I", *ids), b" ".join(map(self.label.__getitem__, ids))
        if len(self.kept) >= KEPT_CHUNKS:
            self.kept.clear()
        if len(chunk) <= 64:
            self.kept[chunk] = got
        return got

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and the labels of the arcs joined by spaces."""
        kept, chunk = self.kept, self.chunk
        got = [kept.get(c) or chunk(c) for c in self.split.chunks(text or "")]
        return b"".join([g[0] for g in got]), b" ".join([g[1] for g in got if g[0]])

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(text_of_file: str) -> Encoder:
    return Encoder(text_of_file)


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs(doc_id, text).

    Null text is empty: no tokens, digests of nothing. A special token's string in a text is
    that token. Repeated rows each give a row, doc_id may be null, other columns are ignored.
    """
    shipped = ship_file(docs.sparkSession, tokenizer_path)

    def make():
        code = encoder(shipped.value)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, back = [], [], []
            for text in part.column(1).to_pylist():
                got, labels = code.encode(text)
                n.append(len(got) // 4)
                ids.append(hashlib.sha256(got).hexdigest())
                back.append(hashlib.sha256(labels).hexdigest())
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)],
                                              ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return work
    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make,
                      "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """docs without text, with `ids` (array of int) and `n_tokens` in its place; other columns stay.

    A column of docs already named ids or n_tokens is replaced.
    """
    shipped = ship_file(docs.sparkSession, tokenizer_path)
    kept = [c for c in docs.columns if c not in ("text", "ids", "n_tokens")]
    source = docs.select("text", *kept)

    def make():
        code = encoder(shipped.value)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            got = [code.encode(t)[0] for t in part.column(0).to_pylist()]
            ends = np.cumsum([0] + [len(g) // 4 for g in got], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), "<i4")))
            return pa.RecordBatch.from_arrays([*part.columns[1:], ids, pa.array(np.diff(ends).astype(np.int64))], [*kept, "ids", "n_tokens"])
        return work
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return map_slices(source, make, f"{schema}, ids array<int>, n_tokens long" if kept else "ids array<int>, n_tokens long")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """`encoded` with a column `decoded`: the labels of its ids joined by spaces; null ids give null."""
    shipped = ship_file(encoded.sparkSession, tokenizer_path)
    kept = [c for c in encoded.columns if c != "decoded"]
    source = encoded.select(*kept)
    at = kept.index("ids")

    def make():
        code = encoder(shipped.value)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            text = [None if ids is None else code.decode(np.array(ids, "<u4").tobytes()).decode("utf-8") for ids in part.column(at).to_pylist()]
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], [*kept, "decoded"])
        return work
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return map_slices(source, make, f"{schema}, decoded string")
