"""Words of a text as a tokenizer file's normaliser and split pattern make them.

The file's rules: NFC, white space runs to one space, lower case by character, then the
pieces its pattern matches. No rule looks across white space, so a text is divided at white
space first and what a chunk gives can be kept by chunk.
"""

from __future__ import annotations

import json
import re
import unicodedata

import regex
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

#: What the split pattern matches; fixed values that must equal the file's.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space for Python's str.split that is none for the pattern.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def ship_file(spark: SparkSession, path: str):
    """A tokenizer file as a broadcast text: a vocabulary of fixed size, read once on the driver."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


class Presplit:
    """chunks(text), then words(chunk) in byte letters."""

    def __init__(self, text_of_file: str):
        data = json.loads(text_of_file)
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if split != PATTERN:
            raise ValueError(f"the file splits by another pattern: {split}")
        self.find = regex.compile(PATTERN).findall
        self.find_ascii = re.compile(PATTERN.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")).findall
        self.blank = regex.compile(r"\s+")
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.letters = byte_letters()
        self.table = {b: c for b, c in enumerate(self.letters)}
        self.library = Tokenizer.from_str(text_of_file)
        self.unassigned = regex.compile(r"\p{Cn}")

    def chunks(self, text: str) -> list[str]:
        """Divide at white space; a special token's string is a chunk of its own."""
        if self.cut is not None and "<|" in text and self.cut.search(text):
            return [c for part in self.cut.split(text) if part for c in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() or any(s in text for s in SEPARATORS):
            return [c for c in self.blank.split(text) if c] if any(s in text for s in SEPARATORS) else text.split()
        return text.split()

    def words(self, chunk: str) -> list[str]:
        if chunk.isascii() and chunk.isprintable():
            return self.find_ascii(chunk.lower())
        if self.unassigned.search(chunk) or any(unicodedata.category(c) == "Cn" for c in chunk):
            # a letter this Python's tables do not know yet: the library's own tables divide the chunk
            split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
            return [w for w, _ in split]
        plain = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return [w if w.isascii() and w.isprintable() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for w in self.find(plain)]
