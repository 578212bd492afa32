"""Greedy word-piece lengths in linear time, without building pieces.

The vocabulary is a trie with two roots, one for pieces that begin a word and one for pieces
that go on. A node's failure link leads to where matching goes on after the longest pieces on
the way to the node are popped, and the number of popped pieces is kept with the link. A word
then takes one pass: follow a child if there is one, else add the popped count and follow the
failure link. No link means no division into pieces: the word counts as one unknown piece.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import map_slices
from fieldlens.llm.presplit import Presplit, ship_file

#: Chunks a task keeps counts of before it starts over; bounds memory only.
KEPT_CHUNKS = 400_000


class LongestMatch:
    """Counts the pieces greedy longest match divides a word into.

    pieces: all pieces. With `going_on` (such as "##") a piece so prefixed follows another and
    the rest begin words; with `close` (such as "</w>") a piece so ended ends a word and all
    others may stand anywhere before. Without either any piece may stand anywhere.
    """

    def __init__(self, pieces, going_on: str = "", close: str = ""):
        self.close = close
        self.child: list[dict[str, int]] = [{}, {}]
        self.link: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        self.first, self.later = 0, 1 if going_on else 0
        ends: set[int] = set()
        for piece in pieces:
            root = self.first
            if going_on and piece.startswith(going_on):
                root, piece = self.later, piece[len(going_on):]
            marked = bool(close) and piece.endswith(close) and piece != close
            symbols = list(piece[:-len(close)] if marked else piece)
            if marked:                                      # the last letter and the mark are one symbol
                symbols[-1] += close
            node = root
            for c in symbols:
                nxt = self.child[node].get(c)
                if nxt is None:
                    nxt = len(self.child)
                    self.child.append({})
                    self.link.append(-1)
                    self.popped.append(0)
                    self.child[node][c] = nxt
                node = nxt
            if piece:
                ends.add(node)
        level = [self.first, self.later] if going_on else [self.first]
        while level:                                        # breadth first: links lead to shallower nodes
            below = []
            for u in level:
                for c, v in self.child[u].items():
                    if v in ends:
                        self.link[v], self.popped[v] = self.later, 1
                    else:
                        z, pops = self.link[u], self.popped[u]
                        while z >= 0 and c not in self.child[z]:
                            pops += self.popped[z]
                            z = self.link[z]
                        if z >= 0:
                            self.link[v], self.popped[v] = self.child[z][c], pops
                    below.append(v)
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word, 0 for an empty one, -1 if no greedy division exists."""
        if not word:
            return 0
        child, link, popped = self.child, self.link, self.popped
        u = self.first
        n = 0
        for c in (*word[:-1], word[-1] + self.close):
            nxt = child[u].get(c)
            while nxt is None:
                if link[u] < 0:
                    return -1
                n += popped[u]
                u = link[u]
                nxt = child[u].get(c)
            u = nxt
        while u != self.later:
            if link[u] < 0:
                return -1
            n += popped[u]
            u = link[u]
        return n


class Counter:
    def __init__(self, text_of_file: str):
        model = json.loads(text_of_file)["model"]
        self.split = Presplit(text_of_file)
        self.match = LongestMatch(model["vocab"], model["continuing_subword_prefix"] or "", model["end_of_word_suffix"] or "")
        self.kept: dict[str, tuple[int, int, int]] = {}

    def chunk(self, chunk: str) -> tuple[int, int, int]:
        if chunk in self.split.special:
            return 0, 1, 0
        counts = [self.match.count(w) for w in self.split.words(chunk)]
        got = len(counts), sum(abs(n) for n in counts), sum(n < 0 for n in counts)
        if len(self.kept) >= KEPT_CHUNKS:
            self.kept.clear()
        if len(chunk) <= 64:
            self.kept[chunk] = got
        return got

    def text(self, text: str | None) -> tuple[int, int, int]:
        kept, chunk = self.kept, self.chunk
        words = tokens = unknown = 0
        for c in self.split.chunks(text or ""):
            a, b, d = kept.get(c) or chunk(c)
            words += a
            tokens += b
            unknown += d
        return words, tokens, unknown


@lru_cache(maxsize=2)
def counter(text_of_file: str) -> Counter:
    return Counter(text_of_file)


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for every row of docs(doc_id, text).

    n_tokens is the number of greedy longest-match pieces of the file's vocabulary; a word
    without a division counts one and adds one to n_unknown. Null text is empty: zeros. A
    special token's string is one token and no word. Repeated rows each give a row, doc_id may
    be null, other columns are ignored.
    """
    shipped = ship_file(docs.sparkSession, tokenizer_path)

    def make():
        count = counter(shipped.value).text

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            got = [count(t) for t in part.column(1).to_pylist()]
            columns = [pa.array([g[i] for g in got], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_words", "n_tokens", "n_unknown"])
        return work
    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make,
                      "doc_id long, n_words long, n_tokens long, n_unknown long")
