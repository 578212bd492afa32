"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find base spans. The field tags words (B-, I- of each kind, or O) from the shapes
of a word and its two neighbours, is fitted by gradient ascent on the small table below, and is
decoded by Viterbi for all sentences of a slice at once. A field span is added if no base span
overlaps it and it has what its kind cannot lack (digits of a phone number, a card's check
digit, an address's parts), so it can add spans but never take one away.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import map_slices

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A digit within a run cannot begin a match its run's first digit did not, so only firsts are tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: The labelled table: [kind]words[/] is one span, all else is O.
LABELLED = """
call me at [phone](555) 010-2233[/] after noon
tel [phone]555-010-4477[/] or write
reach the desk on [phone](020) 7946-0958[/] today
my number is [phone]555-867-5309[/] thanks
phone [phone]800-555-0199[/] and ask for Ann
Fax: [phone](212) 555-0147[/]
The office, [phone](017) 555-7713[/], is open
ring [phone]415-555-2671[/] before ten
her cell [phone]303-555-0188[/] rang twice
that is [phone](377) 555-0271[/] for orders
dial [phone]1-800-555-0133[/] now
home [phone]1-212-555-0179[/] work [phone]1-646-555-0121[/]
call [phone]+1 (487) 555-7209[/] today
of the [phone]+1 (974) 555-3436[/] and of it
und [phone]+49 30 901820[/] oder
le [phone]+33 1 70 18 99 00[/] est
mail [email]ann.lee@example.com[/] for help
write to [email]bob@mail7.example.com[/] and wait
und [email]und.34@mail7.example.com[/] ist
user [email]root@localhost[/] logged in
from [email]admin@intranet[/] to all
ask [email]j.doe@server[/] about it
send it to [email]sales@shop.example[/] please
host [ip]192.168.0.17[/] is down
from [ip]97.51.17.173[/] came
at [ip]10.0.0.1[/] and [ip]10.0.0.2[/] only
address [ip]2001:db8:0:1:1:1:1:1[/] answers
ping [ip]fe80:0:0:0:204:61ff:fe9d:f156[/] first
card [card]4111 1111 1111 1111[/] expires soon
card [card]5500-0000-0000-0004[/] was used
paid with [card]4929348385146306[/] there
number [card]4012888888881881[/] on file
the cat sat on the mat
This is a plain sentence, with words.
And the theba of ention thanea the ereble
Und der die einung ist verlich nicht
Le chat de la maison est en haut
El perro de la casa no es grande
word | word | other | more |
STOP!! THE!! PRESS!! NOW!!
in%%% the*** of$$$ a&&& to###
see section 4.0. for the rest
Licensed under CC BY-NC 4.0.
version 3.1.2 was released
in 1999 about 300 people came
on 2024-01-02 at 10:30 we met
pages 12-14 and 20-25 of the book
it cost $4,500 or 3,20 in all
order 12345678 shipped to room 12
order 2390409500648960 shipped
ticket 9807915762804490 is closed
ISBN 978-3-16-148410-0 is out of print
score 3-2 after 90 minutes
the ratio is 16:9 or 4:3
id 550e8400-e29b-41d4-a716-446655440000 failed
key "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" is old
room (12) and room (14)
figures (1) to (3) show it
C++ and 1+1 are 2
follow @ann and @bob there
@ noon we eat
open 9-17 on 1-5 May
part no 100-200 or 44-10
zip 90210-1234 in town
built 1850-1900 by them
sum 1 2 3 4 5 6
a 1) b 2) c 3)
http://example.com/a/b is a page
at 12:30:45 it rang
"""
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in ("B", "I")]
SIZES = np.array([0, 1, 2, 3, 4, 5, 7, 10, 12, 16])            # lower ends of the digit-count classes


def tokenize(texts: list[str]):
    """Words of all texts: start, end (in the joined text), shape code, and whether a sentence ends with it."""
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    after = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    if not len(first):
        return first, after, first, np.zeros(0, bool)
    many = lambda mask: np.add.reduceat(mask.astype(np.int32), first)
    digits = many((data >= 48) & (data <= 57))
    upper = many((data >= 65) & (data <= 90))
    lower = many(((data >= 97) & (data <= 122)) | (data >= 128))
    last = data[after - 1]
    ends = (last == 46) | (last == 33) | (last == 63)
    code = np.searchsorted(SIZES, digits, side="right") - 1
    code = code * 4 + np.where(lower > 0, np.where(upper > 0, 2, 1), np.where(upper > 0, 3, 0))
    for flag in (many(data == 64) > 0, data[first] == 43, many((data == 40) | (data == 41)) > 0, many(data == 45) > 0,
                 many(data == 46) > (last == 46), many(data == 58) > 1, ends):
        code = code * 2 + flag
    return first, after, code, ends | (many(data == 10) > 0)


def shape_features() -> np.ndarray:
    """Features of every shape code: its parts, and digit class together with hyphen, dot, brackets and letters."""
    codes = np.arange(len(SIZES) * 4 * 128)
    size, letters, flags = codes // 512, codes // 128 % 4, codes[:, None] >> np.arange(6, -1, -1) & 1
    at, plus, bracket, hyphen, dot, colon, end = flags.T
    hot = lambda v, n: np.eye(n)[v]
    return np.concatenate([hot(size, 10), hot(letters, 4), flags, hot(size * 2 + hyphen, 20), hot(size * 2 + dot, 20), hot(size * 2 + bracket, 20),
                           hot(size * 4 + letters, 40), hot(at * 4 + letters, 8), hot(colon * 10 + size, 20)], 1)


FEATURES = shape_features()


class Field:
    """Emission weights for the previous, own and next shape, transitions, start and end."""

    def __init__(self):
        k = len(TAGS)
        self.w = np.zeros((3, FEATURES.shape[1], k))
        self.t, self.start, self.end = np.zeros((k, k)), np.zeros(k), np.zeros(k)
        self.tables()

    def tables(self):
        self.emit = FEATURES @ self.w

    def emissions(self, code: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Scores of the tags of each word; `opens` marks first words of sentences."""
        e = self.emit[1][code]
        inner = ~opens[1:]
        e[1:][inner] += self.emit[0][code[:-1][inner]]
        e[:-1][inner] += self.emit[2][code[1:][inner]]
        return e

    def fit(self, sentences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 400, rate: float = 0.05, decay: float = 0.002) -> Field:
        """Adam on the mean log-likelihood, all sentences at once."""
        n, longest, k = len(sentences), max(len(c) for c, _ in sentences), len(TAGS)
        size = np.array([len(c) for c, _ in sentences])
        code = np.concatenate([c for c, _ in sentences])
        tag = np.concatenate([y for _, y in sentences])
        at = np.concatenate([np.arange(s) for s in size])
        row = np.repeat(np.arange(n), size)
        opens, closes = at == 0, at == size[row] - 1
        x = FEATURES[code]
        before, behind = np.where(opens[:, None], 0, np.roll(x, 1, 0)), np.where(closes[:, None], 0, np.roll(x, -1, 0))
        parts = (before, x, behind)
        params = {"w": self.w, "t": self.t, "start": self.start, "end": self.end}
        m, v = ({p: np.zeros_like(a) for p, a in params.items()} for _ in range(2))
        own = np.eye(k)[tag]
        pair = np.zeros((k, k))
        np.add.at(pair, (tag[:-1][~opens[1:]], tag[1:][~opens[1:]]), 1)
        lse = lambda a, axis: a.max(axis) + np.log(np.exp(a - np.expand_dims(a.max(axis), axis)).sum(axis))
        for step in range(1, rounds + 1):
            e = np.zeros((n, longest, k))
            e[row, at] = sum(p @ w for p, w in zip(parts, self.w))
            alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
            alpha[:, 0] = self.start + e[:, 0]
            for i in range(1, longest):
                alpha[:, i] = lse(alpha[:, i - 1, :, None] + self.t, 1) + e[:, i]
            beta[np.arange(n), size - 1] = self.end
            for i in range(longest - 2, -1, -1):
                here = lse(self.t + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
                beta[:, i] = np.where((i < size - 1)[:, None], here, beta[:, i])
            z = lse(alpha[np.arange(n), size - 1] + self.end, 1)
            p = np.exp(alpha[row, at] + beta[row, at] - z[row, None])
            inner = np.flatnonzero(~opens)
            r, i = row[inner], at[inner]
            both = np.exp(alpha[r, i - 1][:, :, None] + self.t + (e[r, i] + beta[r, i])[:, None, :] - z[r, None, None]).sum(0)
            gap = (own - p) / n
            grad = {"w": np.stack([q.T @ gap for q in parts]), "t": (pair - both) / n, "start": gap[opens].sum(0), "end": gap[closes].sum(0)}
            for name, a in params.items():
                g = grad[name] - decay * a
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                a += rate * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.99 ** step)) + 1e-8)
        self.tables()
        return self

    def decode(self, code: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Best tags of all sentences; `closes` marks last words."""
        tags = np.zeros(len(code), np.int8)
        if not len(code):
            return tags
        starts = np.flatnonzero(np.r_[True, closes[:-1]])
        size = np.diff(np.r_[starts, len(code)])
        opens = np.zeros(len(code), bool)
        opens[starts] = True
        e = self.emissions(code, opens)
        order = np.argsort(-size, kind="stable")
        starts, size = starts[order], size[order]
        live = np.searchsorted(-size, -np.arange(size[0]), side="left")        # sentences longer than i
        best = self.start + e[starts]
        back = []                                               # longest sentences first: step i works on a leading part
        for i in range(1, size[0]):
            n = live[i]
            paths = best[:n, :, None] + self.t
            back.append(paths.argmax(1).astype(np.int8))
            best[:n] = paths.max(1) + e[starts[:n] + i]
        now = (best + self.end).argmax(1)
        tags[starts + size - 1] = now
        for i in range(size[0] - 1, 0, -1):
            n = live[i]
            now[:n] = back[i - 1][np.arange(n), now[:n]]
            tags[starts[:n] + i - 1] = now[:n]
        return tags


def labelled_sentences(table: str = LABELLED) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shape codes, tags) of each line of a labelled table."""
    out = []
    for line in table.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[(\w+)\](.*?)\[/\]", line):
            text += line[at:m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        text += line[at:]
        first, _, code, _ = tokenize([text])
        tags = np.zeros(len(first), int)
        for a, b, kind in spans:
            inside = np.flatnonzero((first >= a) & (first < b))
            tags[inside] = TAGS.index(f"I-{kind}")
            tags[inside[0]] = TAGS.index(f"B-{kind}")
        out.append((code, tags))
    return out


@lru_cache(maxsize=1)
def fitted() -> Field:
    return Field().fit(labelled_sentences())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and then start."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(DIGIT.findall(m[0])) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def sound(kind: int, span: str) -> bool:
    """Whether a field span has what its kind cannot lack."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 0:
        return re.fullmatch(r"[^\s@]+@[A-Za-z0-9][A-Za-z0-9.-]*", span) is not None
    if kind == 1:
        return re.fullmatch(r"[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{0,4}){3,7}", span) is not None
    if kind == 2:
        return 13 <= len(digits) <= 19 and re.fullmatch(r"[0-9 -]+", span) is not None and luhn(digits)
    return 10 <= len(digits) <= 15 and re.fullmatch(r"\+?[0-9() .-]+", span) is not None and re.search(r"[()-]", span) is not None


def find_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, both by kind and then start."""
    base = [base_spans(t) for t in texts]
    added: list[list] = [[] for _ in texts]
    first, after, code, closes = tokenize(texts)
    tags = field.decode(code, closes)
    used = np.flatnonzero(tags)
    if len(used):
        ends = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(ends, first[used], side="right")
        i = 0
        while i < len(used):
            j, kind = i, (int(tags[used[i]]) - 1) // 2
            while j + 1 < len(used) and used[j + 1] == used[j] + 1 and tags[used[j + 1]] == 2 * kind + 2 and doc[j + 1] == doc[i] and not closes[used[j]]:
                j += 1
            d = int(doc[i])
            shift = int(ends[d]) - len(texts[d]) - 1
            a, b = int(first[used[i]]) - shift, int(after[used[j]]) - shift
            text = texts[d]
            while b > a and text[b - 1] in ".,;:!?\"'%*$&#|":
                b -= 1
            while b > a and text[a] in "\"'<[":
                a += 1
            if text[a:a + 1] == "(" and ")" not in text[a:b]:
                a += 1
            if b > a and sound(kind, text[a:b]) and not any(x < b and a < y for _, x, y in base[d]):
                added[d].append((kind, a, b))
            i = j + 1
    return [(b, sorted(b + more)) for b, more in zip(base, added)]


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of every row of docs(doc_id, text), counted in code points, ends exclusive.

    Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added.
    Null text is empty: zeros, the digest of nothing, an empty list. Repeated rows each give a
    row, doc_id may be null, other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(fitted())

    def make():
        field = shipped.value

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            found = find_spans([t or "" for t in part.column(1).to_pylist()], field)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            digest = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            return pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(digest), pa.array([joined(s) for _, s in found]),
                                               pa.array([len(s) - len(b) for b, s in found], pa.int64())],
                                              ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
        return work
    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make,
                      "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans) -> str:
    """The text with each span replaced by its kind; spans that overlap are covered together."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if b <= at:
            continue
        out.append(text[at:max(a, at)])
        if a >= at:
            out.append(f"<{KINDS[kind].upper()}>")
        at = b
    return "".join(out) + text[at:]


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind, and n_chars, if there, counted anew; null text stays null."""
    shipped = docs.sparkSession.sparkContext.broadcast(fitted())
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def make():
        field = shipped.value

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column(at).to_pylist()
            found = find_spans([t or "" for t in texts], field)
            new = [t if t is None else masked(t, s) if s else t for t, (_, s) in zip(texts, found)]
            columns = list(part.columns)
            columns[at] = pa.array(new, part.schema.field(at).type)
            if size is not None:
                old = columns[size].to_pylist()
                columns[size] = pa.array([n if t == o else len(t) for n, t, o in zip(old, new, texts)], part.schema.field(size).type)
            return pa.RecordBatch.from_arrays(columns, schema=part.schema)
        return work
    return map_slices(docs, make, docs.schema)
