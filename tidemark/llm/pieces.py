"""Splitting of oversized texts at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import CHUNK, ROWS, SPACE, TOKENIZERS, Tokenizer, certain, tasks, tokenizer
from tidemark.session import stage

#: Tokens that a piece may have, and that it shares with the one before.
LIMIT, OVERLAP = 512, 64
#: Texts of more characters than this are cut by many tasks, in blocks of so many limits of tokens.
LONG, BLOCK = 1 << 20, 16
#: Characters beside a chunk that tell which boundaries lie at its ends.
CONTEXT = 256
#: Part of the limit that a piece should fill for a stronger boundary to be preferred to a later one.
FILL = 0.5
#: Kinds of cuts, weakest first.
KINDS = ("stretch", "word", "sentence", "formula", "paragraph", "section", "end")
STRETCH, WORD, SENTENCE, FORMULA, PARAGRAPH, SECTION, END = range(7)
#: Bytes between two cuts that are possible within a stretch without boundaries.
STEP = 16

BLANK, LETTER, DIGIT, SIGN = range(4)
# Bits that a character's kind has besides: it ends a sentence before white space, it may close one, it ends one by itself, it is an apostrophe.
STOP, CLOSER, FULL_STOP, APOSTROPHE = 4, 8, 16, 32
#: The characters with those bits.
SIGNS = {STOP: ".!?", CLOSER: "\"')]}»”", FULL_STOP: "。！？", APOSTROPHE: "'"}
#: Closing characters that may stand between a sentence's end and white space.
CLOSERS = 3
FORMULAS = re.compile(r"\\end\{[A-Za-z]+\*?\}|\\\]|\$\$")
BLANKS = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{SPACE}]", chr(c)))
PARAGRAPHS = re.compile(r"\n[ \t\r]*\n|\r[ \t]*\r")
SECTIONS = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|paragraph|appendix|bibliography|begin\{(?:document|abstract|thebibliography)\})(?![A-Za-z])")


@lru_cache(1)
def _classes() -> np.ndarray:
    """The kind of each code point: white space, letter, number or any other sign."""
    import unicodedata

    out = np.full(0x110000, SIGN, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = DIGIT
    out[[c for c in range(0x3001) if re.match(f"[{SPACE}]", chr(c))]] = BLANK
    for bit, signs in SIGNS.items():
        out[[ord(c) for c in signs]] |= bit
    return out


def _before_blank(found: Iterator[int], text: str) -> Iterator[int]:
    """The ends of what comes before the white space at each of the places found."""
    end = floor = 0
    for at in found:
        p = at
        while p > floor and text[p - 1] in BLANKS:
            p -= 1
        if p > floor or not floor:
            end = p
        floor = at
        yield end


def _bits(text: str) -> np.ndarray:
    """The kind of each character."""
    return _classes()[np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)]


def _kinds(text: str) -> np.ndarray:
    """The kind of cut before each character of text and at its end, by what the text says there."""
    bits = _bits(text)
    cls, kinds = bits & 3, np.full(len(bits) + 1, WORD, np.int8)
    stop = (bits & STOP) != 0
    closer = (bits & CLOSER) != 0
    for _ in range(CLOSERS):
        stop[1:] |= closer[1:] & stop[:-1]
    stop[:-1] &= cls[1:] == BLANK
    kinds[1:][stop | ((bits & FULL_STOP) != 0)] = SENTENCE
    for pattern, what in ((FORMULAS, FORMULA), (PARAGRAPHS, PARAGRAPH), (SECTIONS, SECTION)):
        at = (m.end() for m in pattern.finditer(text)) if what == FORMULA else _before_blank((m.start() for m in pattern.finditer(text)), text)
        kinds[list(at)] = what
    return kinds


class Cuts:
    """The places where a text may be cut: position in characters, kind, and the cost of the text before it in tokens.

    A place lies after a character that is no white space, where the tokenizer's pre-tokens part whatever comes before
    or after; so the tokens of a piece between two of them, encoded by itself, are as many as the costs differ. Where
    two such places are more than gap tokens apart, the stretch between gets further places, whose costs are estimates.
    """

    def __init__(self, text: str, tok: Tokenizer, ids: np.ndarray, gap: int, before: str = "", after: str | None = None):
        """before, after: what stands around the text, if it is part of another one; after None: the text ends here."""
        ends = tok.ends(ids)
        bits, offset = _bits(text), None
        if not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            offset = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=offset[1:])
        n = len(bits)
        cls = bits & 3
        part = (cls[1:] != cls[:-1]) & (cls[:-1] != BLANK)
        part &= ~((bits[:-1] >= APOSTROPHE) & (cls[1:] == LETTER))  # a pre-token may be an apostrophe with letters
        place = np.concatenate([[0], np.flatnonzero(part) + 1, [n]])
        byte = place if offset is None else offset[place]
        index = np.searchsorted(ends, byte, side="left") + 1  # tokens before the place
        index[0] = 0
        exact = np.concatenate([[True], ends[index[1:] - 1] == byte[1:]])
        place, cost = place[exact], index[exact].astype(np.int64)
        kinds = _kinds(before + text + (after or ""))[len(before) : len(before) + n + 1]
        if after is None:
            kinds[n] = END
        kind = kinds[place]
        if int(np.max(np.diff(cost))) > gap:
            place, cost, kind = self._stretches(text, ends, byte[exact], place, cost, kind, gap)
        self.place, self.cost, self.kind = place, cost, kind

    @staticmethod
    def _stretches(text: str, ends: np.ndarray, byte: np.ndarray, place: np.ndarray, cost: np.ndarray, kind: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places, costs, step = [], [], min(STEP, gap - 3)
        for i in np.flatnonzero(np.diff(cost) > gap):
            a, b = int(place[i]), int(place[i + 1])
            points = np.frombuffer(text[a:b].encode("utf-32-le"), np.uint32)
            after = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))  # bytes up to each character's end
            fits = np.flatnonzero(np.diff(after // step, prepend=0)[:-1] > 0) + 1
            places.append(a + fits)
            costs.append(np.searchsorted(ends, byte[i] + after[fits - 1], side="right"))
        inner = np.concatenate(places)
        place, cost = np.concatenate([place, inner]), np.concatenate([cost, *costs])
        kind = np.concatenate([kind, np.full(len(inner), STRETCH, np.int8)])
        order = np.argsort(place, kind="stable")
        return place[order], cost[order], kind[order]


def successors(cost: np.ndarray, kind: np.ndarray, limit: int, overlap: int, fill: float = FILL) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the piece that follows a cut at each place, as places.

    It begins at the last place with overlap tokens or more before the cut. It ends at the farthest place within limit
    that is of the strongest kind found there beyond fill of the limit; if only word boundaries are, at the farthest
    natural boundary before that, and if there is none, at the farthest place.
    """
    n = len(cost) - 1
    states = np.flatnonzero(kind >= SENTENCE)
    if states[0] != 0:
        states = np.concatenate([[0], states])
    begin, end, natural = _follow(cost, kind, states, limit, overlap, fill)
    if natural:  # no cut is ever between words: other places than natural ones are never reached
        all_begin, all_end = np.zeros(n + 1, np.int64), np.full(n + 1, n)
        all_begin[states], all_end[states] = begin, end
        return all_begin, all_end
    return _follow(cost, kind, np.arange(n + 1), limit, overlap, fill)[:2]


def _follow(cost: np.ndarray, kind: np.ndarray, here: np.ndarray, limit: int, overlap: int, fill: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """successors for the places here; whether all of them end at natural boundaries."""
    n = len(cost) - 1
    begin = np.maximum(np.searchsorted(cost, cost[here] - overlap, side="right") - 1, 0)
    far = np.searchsorted(cost, cost[begin] + limit, side="right") - 1
    low = np.maximum(here, np.searchsorted(cost, cost[begin] + int(limit * fill), side="left") - 1)
    end, undecided = far.copy(), np.ones(len(here), bool)
    for what in (END, SECTION, PARAGRAPH, FORMULA, SENTENCE):
        at = np.flatnonzero(kind >= what)
        latest = np.where(far >= at[0], at[np.maximum(np.searchsorted(at, far, side="right") - 1, 0)], -1) if len(at) else np.full(len(here), -1)
        good = undecided & (latest > low)
        end[good] = latest[good]
        undecided &= ~good
    good = undecided & (latest > here)
    end[good] = latest[good]
    undecided &= ~good & (here < n)
    return begin, np.minimum(np.maximum(end, here + 1), n), not undecided.any()


def refine(text: str, tok: Tokenizer, c: Cuts, j: int, begin: np.ndarray, end: np.ndarray, limit: int, overlap: int) -> None:
    """Corrects begin and end of place j where the piece begins, ends or is cut within a stretch, by encoding it."""
    memo: dict[tuple[int, int], int] = {}

    def count(a: int, b: int) -> int:
        if (a, b) not in memo:
            memo[a, b] = len(tok.encode(text[c.place[a] : c.place[b]]))
        return memo[a, b]

    b, e = int(begin[j]), int(end[j])
    if overlap and (c.kind[j] == STRETCH or c.kind[b] == STRETCH):
        while b > 0 and count(b, j) < overlap:
            b -= 1
        while b + 1 < j and count(b + 1, j) >= overlap:
            b += 1
    while e > j + 1 and count(b, e) > limit:
        e -= 1
    while b < j and count(b, e) > limit:
        b += 1
    begin[j], end[j] = b, e


def greedy_cuts(end: np.ndarray, stops: np.ndarray | None = None, correct: Callable[[int], None] | None = None) -> np.ndarray:
    """The cuts reached from place 0 by following end, by pointer doubling: each round squares the table of successors
    and doubles the cuts that are known.

    Of the places in stops end is only an estimate: the tables end at them, and where the cuts reach one, correct sets
    its end. So only the places that are reached are corrected.
    """
    n = len(end) - 1
    jump = end.copy()
    if stops is not None:
        jump[stops] = stops
    tables, known, cuts = [jump], [], 0
    while True:
        part, k = np.array([cuts], np.int64), 0
        while jump[part[-1]] != part[-1]:
            if k == len(tables):
                tables.append(tables[-1][tables[-1]])
            part = np.concatenate([part, tables[k][part]])
            k += 1
        part = part[: int(np.argmax(part == part[-1])) + 1]
        known.append(part)
        last = int(part[-1])
        if last == n or correct is None:
            return np.concatenate(known)
        correct(last)
        cuts = int(end[last])


def split(text: str, tok: Tokenizer, limit: int = LIMIT, overlap: int = OVERLAP, fill: float = FILL) -> list[tuple[int, int, int, int, str]] | None:
    """(start, end, tokens, tokens shared with the piece before, kind of cut) of each piece; None if text is within limit."""
    if len(text) <= limit // 4:  # a character has four bytes at most, a token one at least
        return None
    ids = tok.encode(text)
    if len(ids) <= limit:
        return None
    c = Cuts(text, tok, ids, (limit - overlap) // 2)
    begin, end = successors(c.cost, c.kind, limit, overlap, fill)
    inside = c.kind == STRETCH
    exact = not inside.any()
    if exact:
        cuts = greedy_cuts(end)
    else:
        stops = np.flatnonzero((inside | inside[begin] | inside[end])[:-1])
        cuts = greedy_cuts(end, stops, lambda j: refine(text, tok, c, j, begin, end, limit, overlap))
    count = (lambda a, b: int(c.cost[b] - c.cost[a])) if exact else (lambda a, b: len(tok.encode(text[c.place[a] : c.place[b]])))
    out = []
    for a, b in zip(cuts, cuts[1:]):
        s = begin[a] if out else 0
        out.append((int(c.place[s]), int(c.place[b]), count(s, b), count(s, a) if out else 0, KINDS[c.kind[b]]))
    return out


PIECE_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
PIECES = "piece_no int, n_pieces int, start bigint, end bigint, n_tokens int, overlap_tokens int, cut string, piece string"


def split_corpus(
    documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, fill: float = FILL, long_chars: int = LONG, chunk: int = CHUNK
) -> DataFrame:
    """(key, PIECES): the ordered pieces of every text of more than limit tokens; other texts, null and empty ones give none.

    Each piece, encoded by itself, has limit tokens at most. Pieces cover the text without gaps; each begins before the
    end of the last one, at the closest possible cut that makes the shared part overlap tokens or more (the whole text
    so far, if it has less), less than a pre-token above it. Cuts are at the end of a section, paragraph, formula or
    sentence where one is in reach, else between words, and only in a stretch without any boundary within it.
    start and end count characters; repeated rows give their pieces each.

    Texts of up to long_chars characters are cut where they are read, without an exchange. Longer ones are spread in
    chunks: every boundary is joined to its successor in blocks of tokens, and the successor tables are squared by joins
    over the blocks (split_long); for them the text column is read once more.
    """
    if overlap < 0 or limit - overlap < 16:
        raise ValueError("limit must be at least 16 more than overlap, overlap at least 0")
    docs = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > limit // 4)
    kind = docs.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder, name)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                take, rows = [], []
                for r, t in enumerate(part.column(1).to_pylist()):
                    found = split(t, tok, limit, overlap, fill)
                    for i, (s, e, n, o, cut) in enumerate(found or ()):
                        take.append(r)
                        rows.append((i, len(found), s, e, n, o, cut, t[s:e]))
                if rows:
                    names = ["k", *(x.split(" ")[0] for x in PIECES.split(", "))]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take)), *(pa.array(c, t) for c, t in zip(zip(*rows), PIECE_TYPES))], names=names)

    out = docs.where(F.length("t") <= long_chars).mapInArrow(run, f"k {kind}, {PIECES}")
    more = split_long(docs.where(F.length("t") > long_chars), limit, overlap, name, folder, fill, chunk)
    return (out if more is None else out.unionByName(more)).withColumnRenamed("k", key)


def split_long(docs: DataFrame, limit: int, overlap: int, name: str, folder: str, fill: float, chunk: int) -> DataFrame | None:
    """split_corpus for docs (k, t) of any length, each text by many tasks; None if there are none.

    1. A text is cut into chunks where pre-tokens part whatever is before and after, so their tokens are the text's; each
    is encoded and gives its places with their costs. 2. Places go to blocks of BLOCK limits of tokens, each with both its
    neighbours, in which every place is joined to its farthest legal successor, and by pointer doubling to the place where
    it leaves the block. 3. The table of these successors, of the places where a block may be entered, is squared by a join
    in each round, which doubles the blocks whose entry is known. 4. Every block cuts its pieces from its entry on.
    """
    size, gap = BLOCK * limit, (limit - overlap) // 2
    kind = docs.schema["k"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                t, at, i = batch.column(1)[n].as_py(), 0, 0
                while at < len(t):
                    m = certain().search(t, at + chunk) if at + chunk < len(t) else None
                    end = m.start() if m else len(t)
                    row = [pa.array([x]) for x in (i, at, t[at:end], t[max(0, at - CONTEXT) : at], t[end : end + CONTEXT], end == len(t))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(n, 1), batch.column(2).slice(n, 1), *row], names=["k", "r", "i", "at", "w", "before", "after", "last"])
                    at, i = end, i + 1

    chunks = stage(docs.withColumn("r", F.monotonically_increasing_id()).mapInArrow(cut, f"k {kind}, r long, i long, at long, w string, before string, after string, last boolean"), "chunks")
    if chunks.isEmpty():
        return None

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder, name)
        for batch in batches:
            for r, i, at, w, before, after, last in zip(*(c.to_pylist() for c in batch.columns)):
                ids = tok.encode(w)
                c = Cuts(w, tok, ids, gap, before, None if last else after)
                yield _row(PLACES, [r, i, at, len(ids), c.place + at, c.cost, c.kind, w])

    coded = stage(chunks.select("r", "i", "at", "w", "before", "after", "last").repartition(tasks(docs), "r", "i").mapInArrow(encode, PLACES), "places")
    ahead = Window.partitionBy("r").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    offsets = coded.select("r", "i", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("o"))  # one narrow row for each chunk

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                r, i, at, w, o = (batch.column(c)[n].as_py() for c in (0, 1, 2, 7, 8))
                first = 1 if i else 0  # a chunk's begin is the end of the one before
                place, cost, kinds = (_numbers(batch.column(c)[n])[first:] for c in (4, 5, 6))
                cost = cost + o
                edges = [0, *(np.flatnonzero(np.diff(cost // size)) + 1), len(place)]
                for a, b in zip(edges, edges[1:]):
                    begin = int(place[a - 1]) if a else at
                    yield _row(SLICES, [r, int(cost[a]) // size, begin, place[a:b], cost[a:b], kinds[a:b], w[begin - at : int(place[b - 1]) - at]])

    parts = coded.join(offsets, ["r", "i"]).select(*coded.columns, "o").mapInArrow(slices, SLICES)
    near = F.filter(F.array(F.col("blk") - 1, F.col("blk"), F.col("blk") + 1), lambda b: b >= 0)
    met = parts.withColumn("b", F.explode(near)).repartition(tasks(docs), "r", "b").groupBy("r", "b").agg(F.collect_list(F.struct("blk", "begin", "place", "cost", "kind", "w")).alias("parts"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder, name)
        for batch in batches:
            for n in range(batch.num_rows):
                r, b, met = batch.column(0)[n].as_py(), batch.column(1)[n].as_py(), batch.column(2)[n].values
                met = met.take(pc.array_sort_indices(met.field("begin")))
                blks, begins, ws = (met.field(x).to_pylist() for x in ("blk", "begin", "w"))
                place, cost, kinds = (np.concatenate([_numbers(x) for x in met.field(f)]) for f in ("place", "cost", "kind"))
                own = np.repeat(np.array(blks) == b, [len(x) for x in met.field("place")])
                if not own.any():
                    continue
                base, text = begins[0], "".join(ws)
                c = Block(place - base, cost, kinds)
                here = np.flatnonzero(own & (c.kind != END))
                begin, end = np.zeros(len(own), np.int64), np.arange(len(own))
                if len(here):
                    begin[here], end[here], _ = _follow(c.cost, c.kind, here, limit, overlap, fill)
                    inside = c.kind == STRETCH
                    for j in here[(inside[here] | inside[begin[here]] | inside[end[here]])]:
                        refine(text, tok, c, int(j), begin, end, limit, overlap)
                jump = end
                while (jump[jump] != jump).any():  # every place to where it leaves the block
                    jump = jump[jump]
                enter = here[c.cost[here] <= b * size + limit] if b else here[:1]
                yield _row(SOLVED, [r, b, base, text, c.place, c.cost, c.kind, begin, end, c.place[enter] + base, c.place[jump[enter]] + base])

    solved = stage(met.mapInArrow(solve, SOLVED), "solved")
    table = solved.select("r", "b", F.explode(F.arrays_zip("enter", "leave")).alias("e")).select("r", "b", F.col("e.enter").alias("p"), F.col("e.leave").alias("q"))
    jumps, known = stage(table.select("r", "p", "q"), "jumps"), solved.select("r", F.lit(0).cast("long").alias("p")).distinct()
    rounds = int(solved.agg(F.max("b")).first()[0] + 1).bit_length()
    for _ in range(rounds):
        known = stage(known.unionByName(known.join(jumps, ["r", "p"]).select("r", F.col("q").alias("p"))).distinct(), "known")
        then = jumps.select("r", F.col("p").alias("q"), F.col("q").alias("then"))
        jumps = stage(jumps.join(then, ["r", "q"], "left").select("r", "p", F.coalesce("then", "q").alias("q")), "jumps")
    entries = known.join(table, ["r", "p"]).select("r", "b", "p")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder, name)
        for batch in batches:
            for n in range(batch.num_rows):
                r, b, base, text, p = (batch.column(c)[n].as_py() for c in (0, 1, 2, 3, 9))
                place, cost, kinds, begin, end = (_numbers(batch.column(c)[n]) for c in range(4, 9))
                rows: list[tuple] = []
                j = int(np.searchsorted(place, p - base))
                while end[j] != j:
                    s, e = (int(begin[j]) if p or rows else j), int(end[j])
                    exact = STRETCH not in (kinds[s], kinds[j], kinds[e])
                    count = lambda x, y: int(cost[y] - cost[x]) if exact else len(tok.encode(text[place[x] : place[y]]))  # noqa: E731, B023
                    shared = count(s, j) if p or rows else 0
                    rows.append((r, b, len(rows), int(place[s]) + base, int(place[e]) + base, count(s, e), shared, KINDS[kinds[e]], text[place[s] : place[e]]))
                    j = e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), *PIECE_TYPES[1:]])], names=[x.split(" ")[0] for x in CUT.split(", ")])

    found = stage(solved.join(entries, ["r", "b"]).repartition(tasks(docs), "r", "b").select("r", "b", "base", "text", "place", "cost", "kind", "begin", "end", "p").mapInArrow(pieces, CUT), "pieces")
    counts = found.groupBy("r", "b").agg(F.count(F.lit(1)).alias("n"))
    doc = Window.partitionBy("r")
    counts = counts.select("r", "b", F.sum("n").over(doc).alias("n_pieces"), F.coalesce(F.sum("n").over(doc.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    keys = chunks.where("i = 0").select("r", "k")
    # a text within the limit is one piece, which is none
    out = found.join(counts, ["r", "b"]).join(keys, "r").where("n_pieces > 1")
    return out.select("k", (F.col("no") + F.col("o")).cast("int").alias("piece_no"), F.col("n_pieces").cast("int").alias("n_pieces"), "start", "end", "n_tokens", "overlap_tokens", "cut", "piece")


class Block:
    """Places of a block and its neighbours, as Cuts has them for a whole text."""

    def __init__(self, place: np.ndarray, cost: np.ndarray, kind: np.ndarray):
        self.place, self.cost, self.kind = place, cost, kind


#: Schemas of the tables that split_long goes through.
PLACES = "r long, i long, at long, n long, place array<long>, cost array<long>, kind array<long>, w string"
SLICES = "r long, blk long, begin long, place array<long>, cost array<long>, kind array<long>, w string"
SOLVED = "r long, b long, base long, text string, place array<long>, cost array<long>, kind array<long>, begin array<long>, end array<long>, enter array<long>, leave array<long>"
CUT = "r long, b long, no int, start long, end long, n_tokens int, overlap_tokens int, cut string, piece string"
KINDS_OF = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _numbers(x: pa.ListScalar) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False)


def _row(schema: str, values: list) -> pa.RecordBatch:
    columns = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v.astype(np.int64) if isinstance(v, np.ndarray) else v], KINDS_OF[k]) for v, (_, k) in zip(values, columns)], names=[n for n, _ in columns])
