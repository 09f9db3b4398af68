"""Evaluation texts that leak into training text."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import jpath, scratch

#: Consecutive words of an item that make a leak.
WORDS = 13
#: Characters of items that one automaton is built of, and that are broadcast; more items are searched for in several scans.
BLOCK_CHARS = 4_000_000

# Commands that stand for letters, that put an accent on the next letter, and that make space.
LETTERS = {"i": "i", "j": "j", "ss": "ss", "ae": "ae", "AE": "ae", "oe": "oe", "OE": "oe", "o": "ø", "O": "ø", "l": "ł", "L": "ł", "aa": "a", "AA": "a", "dh": "ð", "DH": "ð", "th": "þ", "TH": "þ", "dj": "đ", "DJ": "đ", "ng": "ŋ", "NG": "ŋ"}
ACCENTS = {"v", "c", "u", "H", "k", "r", "b", "d", "t"}
ACCENT_SIGNS = "'\"`^~=."
SPACES = {"quad", "qquad", "enspace", "enskip", "thinspace", "medspace", "thickspace", "negthinspace", "space", "nobreakspace", "xspace", "smallskip", "medskip", "bigskip", "hfill", "vfill", "hfil", "vfil", "newline", "linebreak", "par", "hspace", "vspace", "hskip", "vskip"}
JOINED = "-/@"
LIGATURES = {"æ": "ae", "œ": "oe", "ĳ": "ij"}

#: A length without braces: a number with a unit or before a length's name.
LENGTH = r"[-+\s]*(?:\d+(?:[.,]\d*)?|[.,]\d+)\s*(?:true\s*)?(?:fil{1,3}|p[tc]|in|bp|[cm]m|[dc]d|cc|sp|e[xm]|mu|\\[A-Za-z]+)"
COMMAND = re.compile(
    r"\\(?:(?:[A-Za-z]*[cC]ite[A-Za-z]*|label)(?![A-Za-z])\*?(?:\s*\[[^\]]*\])*\s*\{[^{}]*\}"
    r"|([hv]s(?:pace|kip)\*?\s*\{[^{}]*(?:\{[^{}]*\}[^{}]*){0,3}\}|[hv]skip\s*" + LENGTH + r"(?:\s*(?:plus|minus)\s*" + LENGTH + r"){0,2})"
    r"|([A-Za-z]+)\*?|(.)|$)",
    re.S,
)
DEFINED = re.compile(r"\\(newcommand|renewcommand|providecommand|DeclareRobustCommand|DeclareMathOperator|def|gdef|edef|xdef|let)(?![A-Za-z])\*?\s*(?:\{\s*(\\[A-Za-z]+)\s*\}|(\\[A-Za-z]+))(\s*\[\s*0\s*\])?\s*=?\s*(\{|\\[A-Za-z]+)?")
#: A text without any of these has nothing that DEFINED matches.
DEFINES = ("command", "def", "\\let", "\\Declare")
MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
OTHER = re.compile(r"[\W_]+")
LIGATURE = re.compile("[æœĳ]")
ASCII = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def _group(text: str, at: int) -> int:
    """The end of the brace group that opens at text[at], -1 if it doesn't end."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return -1


def macros(text: str) -> tuple[dict[str, str], set[int]]:
    """The text's own macros without arguments as {name: what it stands for}, and where their names are defined."""
    found: dict[str, str] = {}
    places: set[int] = set()
    for m in DEFINED.finditer(text):
        how, name, at, body = m.group(1), m.group(2) or m.group(3), m.start(2) if m.group(2) else m.start(3), m.group(5)
        places.add(at)
        if body is None:
            continue
        if body == "{":
            if how == "let":
                continue
            end = _group(text, m.start(5))
            if end < 0:
                continue
            body = text[m.start(5) + 1 : end - 1]
        elif how != "let":
            if how in ("def", "gdef", "edef", "xdef"):
                continue
        else:
            places.add(m.start(5))
        if how == "providecommand" and name[1:] in found:
            continue
        found[name[1:]] = body
    return found, places


class Reader:
    """Commands of one text as the letters and spaces they stand for."""

    def __init__(self, text: str):
        self.own, self.places = macros(text) if any(d in text for d in DEFINES) else ({}, set())
        self.open: dict[str, str | None] = {}

    def value(self, name: str) -> str:
        """An own macro's body with its commands replaced; nothing for one that stands for itself."""
        if name not in self.open:
            self.open[name] = None
            self.open[name] = COMMAND.sub(lambda m: self.command(m, -1), self.own[name])
        return self.open[name] or ""

    def command(self, m: re.Match, at: int | None = None) -> str:
        if m.group(1) is not None:
            return " "
        name = m.group(2)
        if name is not None:
            if name in self.own and (at == -1 or m.start() not in self.places):
                return self.value(name)
            if name in LETTERS:
                return LETTERS[name]
            return " " if name in SPACES else ""
        c = m.group(3)
        if c is None or c in ACCENT_SIGNS or c in JOINED:
            return ""
        return " "


#: Spaces after a command that stands for or changes a letter belong to it.
SWALLOW = re.compile(r"(\\(?:[" + re.escape(ACCENT_SIGNS) + r"]|(?:" + "|".join(sorted([*LETTERS, *ACCENTS], key=len, reverse=True)) + r")(?![A-Za-z])))[ \t]+(?=[A-Za-z{\\])")
HAS_SWALLOW = re.compile(r"\\(?:[" + re.escape(ACCENT_SIGNS) + r"]|[a-zA-Z]{1,2}[ \t])")


def _letters(text: str) -> str:
    """Case, accents, ligatures, braces and comment marks removed; all that is no letter or digit as one space."""
    if text.isascii():
        return b" ".join(text.encode().translate(ASCII, b"{}%").split()).decode()
    t = text.replace("{", "").replace("}", "").replace("%", "")
    t = MARKS.sub("", unicodedata.normalize("NFD", t).casefold())
    if LIGATURE.search(t):
        for a, b in LIGATURES.items():
            t = t.replace(a, b)
    return OTHER.sub(" ", t).strip()


def normalise(text: str, latex: bool = True) -> str:
    """The words of text, parted by one space. latex: commands are read as said in TESTDATA.md; else text is plain."""
    if latex and "\\" in text:
        if HAS_SWALLOW.search(text):
            # escaped backslashes are set apart first, so that what follows them isn't taken for a command
            text = SWALLOW.sub(r"\1", text) if "\\\\" not in text else "\\\\".join(SWALLOW.sub(r"\1", p) for p in text.split("\\\\"))
        text = COMMAND.sub(Reader(text).command, text)
    return _letters(text)


@lru_cache(65_536)
def _folded(c: str) -> tuple[list[int], list[bool]]:
    """The code points that a character other than ASCII stands for, and which of them belong to words."""
    letters = "".join(LIGATURES.get(x, x) for x in MARKS.sub("", unicodedata.normalize("NFD", c).casefold()))
    return [ord(x) for x in letters], [OTHER.match(x) is None for x in letters]


#: Of each ASCII character what it is folded to, and whether it belongs to words.
PLAIN = np.array([ord(chr(c).lower()) for c in range(128)], np.uint32)
IN_WORDS = np.array([chr(c).isalnum() for c in range(128)])


def located(text: str) -> tuple[list[str], np.ndarray]:
    """The words that normalise gives, with (start, end) of each in text; a macro's words have the place of its name."""
    source = np.arange(len(text))
    plain = text
    if "\\" in text:
        keep = np.ones(len(text), bool)
        for m in SWALLOW.finditer(text):
            before = m.start()
            while before and text[before - 1] == "\\":
                before -= 1
            if not (m.start() - before) % 2:
                keep[m.end(1) : m.end()] = False
        if not keep.all():
            source = source[keep]
            plain = "".join(text[i] for i in source)
    reader, at = Reader(plain), 0
    parts: list[str] = []
    starts: list[np.ndarray] = []
    ends: list[np.ndarray] = []

    def as_is(a: int, b: int) -> None:
        parts.append(plain[a:b])
        starts.append(source[a:b])
        ends.append(source[a:b] + 1)

    for m in COMMAND.finditer(plain) if "\\" in plain else ():
        as_is(at, m.start())
        said, at = reader.command(m), m.end()
        if said:
            parts.append(said)
            starts.append(np.full(len(said), source[m.start()]))
            ends.append(np.full(len(said), source[m.end() - 1] + 1))
    as_is(at, len(plain))
    flat = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    keep = (flat != ord("{")) & (flat != ord("}")) & (flat != ord("%"))
    flat, start, end = flat[keep], np.concatenate(starts)[keep], np.concatenate(ends)[keep]
    other = np.flatnonzero(flat > 127)
    if len(other):
        stand = [_folded(chr(flat[i])) for i in other]
        counts = np.ones(len(flat), np.int64)
        counts[other] = [len(x) for x, _ in stand]
        flat, start, end = np.repeat(flat, counts), np.repeat(start, counts), np.repeat(end, counts)
        ascii_ = flat < 128
        letters, inside = flat.copy(), np.zeros(len(flat), bool)
        letters[~ascii_] = [x for xs, _ in stand for x in xs]
        inside[~ascii_] = [x for _, xs in stand for x in xs]
        letters[ascii_], inside[ascii_] = PLAIN[flat[ascii_]], IN_WORDS[flat[ascii_]]
    else:
        letters, inside = PLAIN[flat], IN_WORDS[flat]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2] - 1
    said = letters.astype("<u4").tobytes().decode("utf-32-le")
    return [said[a : b + 1] for a, b in zip(first, last)], np.stack([start[first], end[last]], 1) if len(first) else np.zeros((0, 2), np.int64)


class Finder:
    """One Aho-Corasick automaton over blocks of consecutive words of all items.

    A leak of n words of an item holds all of a block of (n + 1) // 2 words that begins at a multiple of that number;
    so the automaton has those blocks only, and each hit is extended to both sides, once for each diagonal (item,
    place in the item less place in the text): a hit within a run that is known already is passed over.
    """

    def __init__(self, items: Sequence[tuple[Any, str]], words: int = WORDS):
        import ahocorasick

        self.words, step = words, (words + 1) // 2
        self.items = [(i, normalise(t).split(" ")) for i, t in items if t]
        blocks: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, w) in enumerate(self.items):
            if len(w) >= words:
                for at in range(0, len(w) - step + 1, step):
                    blocks[f" {' '.join(w[at : at + step])} "].append((n, at))
        self.size = step
        self.automaton = ahocorasick.Automaton()
        for number, (text, where) in enumerate(blocks.items()):
            there = set(where)
            # after the same block just before, only these lie on diagonals that it hasn't shown
            heads = [(n, at) for n, at in where if (n, at - step) not in there]
            self.automaton.add_word(text, (number, len(text), where, heads))
        self.automaton.make_automaton()
        self.any = bool(blocks)

    def find(self, text: str) -> list[tuple[Any, int, int, int]]:
        """(item, first word in the item, first word in text, number of words) of each maximal run, of text's words."""
        if not self.any:
            return []
        norm = f" {normalise(text)} "
        hits = list(self.automaton.iter(norm))
        if not hits:
            return []
        w, step = norm.strip().split(" "), self.size
        found: list[tuple[int, int, int, int]] = []
        known: dict[tuple[int, int], int] = {}  # where the last run of a diagonal ends in the text
        last: dict[int, int] = {}  # where a block was seen last
        at = k = 0
        for end, (number, length, where, heads) in hits:
            begin = end - length + 1  # of the space before the block's first word
            k += norm.count(" ", at, begin) if begin >= at else -norm.count(" ", begin, at)
            at = begin
            for n, i in heads if last.get(number) == k - step else where:
                if known.get((n, i - k), 0) >= k + step:
                    continue
                item = self.items[n][1]
                back, on = _alike(item, i, w, k, -1), _alike(item, i + step, w, k + step, 1)
                known[n, i - k] = k + step + on
                if back + step + on >= self.words:
                    found.append((n, i - back, k - back, back + step + on))
            last[number] = k
        return [(self.items[n][0], a, b, size) for n, a, b, size in sorted(found)]


def _alike(a: list[str], i: int, b: list[str], j: int, step: int) -> int:
    """How many words of a and b are equal from i and j on (step 1), or before them (step -1): compared in slices that
    double, then halve."""
    most = min(len(a) - i, len(b) - j) if step > 0 else min(i, j)

    def same(n: int, m: int) -> bool:
        return a[i + n : i + n + m] == b[j + n : j + n + m] if step > 0 else a[i - n - m : i - n] == b[j - n - m : j - n]

    n, size = 0, 1
    while n < most and same(n, min(size, most - n)):
        n += min(size, most - n)
        size *= 2
    while size > 1:
        size //= 2
        if n + size <= most and same(n, size):
            n += size
    return n


def exists(spark, path: str) -> bool:
    fs, p = jpath(spark, path)
    return fs.exists(p)


@lru_cache(2)
def finder(block: str, items: tuple, words: int) -> Finder:
    return Finder(items, words)


def item_blocks(items: DataFrame, key: str, text: str, block_chars: int) -> Iterator[tuple[str, tuple]]:
    """(name, items as tuples of (key, text)) of each block of about block_chars characters at most (or one item). The
    items are written once, apart by block; the driver has one block at a time."""
    spark = items.sparkSession
    rows = items.select(F.col(key).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL AND t != ''")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = int(total // max(1, block_chars // 2)) + 1
    path = scratch(spark, "items")
    rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n))).write.partitionBy("block").parquet(path)
    for b in range(n):
        if exists(spark, f"{path}/block={b}"):
            part = spark.read.schema(rows.schema).parquet(f"{path}/block={b}")
            yield f"{path}/{b}", tuple(sorted((tuple(r) for r in part.collect()), key=repr))


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", words: int = WORDS, offsets: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item, item_word, n_words, start, end) of every maximal run of at least words consecutive words that a
    document shares with an item; start and end are characters of the document's text.

    Words are compared without case, accents and markup (normalise). Documents are scanned once where they are read,
    without an exchange, by one automaton of the items; items of more than block_chars characters go to several
    automata and as many scans. Null and empty texts, items shorter than words and empty tables find nothing; repeated
    rows find each their own. offsets false leaves start and end null, which spares locating the words.
    """
    docs = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL AND t != ''")
    kind, item_kind = docs.schema["k"].dataType.simpleString(), items.schema[item].dataType.simpleString()
    item_type = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
    schema = f"k {kind}, i {item_kind}, item_word int, n_words int, start bigint, end bigint"

    def scan(name: str, block: tuple):
        sent = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = finder(name, sent.value, words)
            for batch in batches:
                rows, take = [], []
                for r, t in enumerate(batch.column(1)):
                    t = t.as_py()
                    found = f.find(t)
                    if found:
                        where = located(t)[1] if offsets else None
                        for i, a, b, n in found:
                            take.append(r)
                            rows.append((i, a, n, int(where[b][0]) if offsets else None, int(where[b + n - 1][1]) if offsets else None))
                if rows:
                    cols = list(zip(*rows))
                    types = [item_type, pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), *(pa.array(c, t) for c, t in zip(cols, types))], names=["k", "i", "item_word", "n_words", "start", "end"])

        return run

    out = None
    for name, block in item_blocks(items, item, item_text, block_chars):
        part = docs.mapInArrow(scan(name, block), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = documents.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"k": key, "i": item})
