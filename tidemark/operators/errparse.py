"""Rows that fail to parse: minimum-cost error parse of delimited records."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.clean import NULL_TOKENS
from tidemark.operators.skew import lookup_join

#: Delimiters in the order in which a header is searched for them.
DELIMITERS = (",", ";", "|", ":")
#: What a record of a file without header is read by.
DEFAULT_HEADER = ("id", "double_col", "varchar_col")

INTEGER = re.compile(r"[+-]?[0-9]+", re.A)
NUMBER = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?", re.A)

REASONS = ("quoting", "column_count", "invalid_id", "invalid_double_col", "invalid_varchar_col")

# States of the parse: at a cell's start, in a plain cell, in a quoted one, after a quote in it, after its end.
START, PLAIN, QUOTED, QUOTE, CLOSED = range(5)
STATES, ENDS = range(5), (START, PLAIN, QUOTE, CLOSED)


@lru_cache(64)
def _free(delimiter: str) -> tuple[re.Pattern, re.Pattern]:
    """The parse's zero-cost layer: a whole record, and one cell of it."""
    d = re.escape(delimiter)
    cell = f' *"(?:[^"]|"")*" *|(?! *")[^"{d}]*'
    return re.compile(f"(?:{cell})(?:{d}(?:{cell}))*", re.S), re.compile(f'(?: *"((?:[^"]|"")*)" *|((?! *")[^"{d}]*))(?:{d}|$)', re.S)


def split_free(line: str, delimiter: str) -> list[str] | None:
    """The cells of a record that parses at no cost, spaces around them removed; None if none such parse exists."""
    record, cell = _free(delimiter)
    if record.fullmatch(line) is None:
        return None
    if '"' not in line:
        return [c.strip(" ") for c in line.split(delimiter)]
    out, at = [], 0
    while True:
        m = cell.match(line, at)
        q = m.group(1)
        out.append((m.group(2) if q is None else q.replace('""', '"')).strip(" "))
        at = m.end()
        if at >= len(line) and not (at > m.start() and line[at - 1] == delimiter and m.end(1 if q is not None else 2) < at):
            return out


def _steps(state: int, symbol: str) -> tuple[int, int] | None:
    """(next state, cells ended) on reading symbol: q a quote, d a delimiter, s a space, o any other; None if it may not stand there."""
    if state == START:
        return {"s": (START, 0), "q": (QUOTED, 0), "d": (START, 1), "o": (PLAIN, 0)}[symbol]
    if state == PLAIN:
        return {"s": (PLAIN, 0), "q": None, "d": (START, 1), "o": (PLAIN, 0)}[symbol]
    if state == QUOTED:
        return (QUOTE, 0) if symbol == "q" else (QUOTED, 0)
    if state == QUOTE:
        return {"s": (CLOSED, 0), "q": (QUOTED, 0), "d": (START, 1), "o": None}[symbol]
    return {"s": (CLOSED, 0), "q": None, "d": (START, 1), "o": None}[symbol]


def error_parse(line: str, delimiter: str, cells: int | None) -> tuple[int, list[tuple[str, str, int]]]:
    """(cost, edits) of the cheapest way to make line a record of so many cells (None: of any number) by inserting or
    deleting quotes and delimiters, each at cost 1. edits: (insert or delete, character, position), in order.

    Dynamic programming over the line's symbols, runs of equal ones other than quotes and delimiters taken as one, by
    (cells ended, state). Equally cheap ways: the one found first, deletions before insertions.
    """
    symbols: list[tuple[str, int]] = []
    for i, c in enumerate(line):
        s = "q" if c == '"' else "d" if c == delimiter else "s" if c == " " else "o"
        if not (s in "so" and symbols and symbols[-1][0] == s):
            symbols.append((s, i))
    most = 0 if cells is None else cells - 1
    counted = cells is not None
    best: dict[tuple[int, int], int] = {(0, START): 0}
    trail: list[dict[tuple[int, int], tuple]] = []

    def insert(best: dict, at: int) -> dict:
        """Closes best over insertions before position at; what each entry comes from."""
        came: dict[tuple[int, int], tuple] = {}
        queue = sorted(best, key=best.get)
        while queue:
            k, s = node = queue.pop(0)
            for symbol in "qd":
                to = _steps(s, symbol)
                if to is None:
                    continue
                nk = k + to[1] if counted else 0
                if nk > most:
                    continue
                cost = best[node] + 1
                if cost < best.get((nk, to[0]), 1 << 60):
                    best[nk, to[0]] = cost
                    came[nk, to[0]] = (node, ("insert", '"' if symbol == "q" else delimiter, at))
                    queue.append((nk, to[0]))
        return came

    for symbol, at in symbols:
        came = insert(best, at)
        after: dict[tuple[int, int], int] = {}
        read: dict[tuple[int, int], tuple] = {}
        for (k, s), cost in best.items():
            to = _steps(s, symbol)
            if to is not None:
                nk = k + to[1] if counted else 0
                if nk <= most and cost < after.get((nk, to[0]), 1 << 60):
                    after[nk, to[0]] = cost
                    read[nk, to[0]] = ((k, s), None)
            if symbol in "qd" and cost + 1 < after.get((k, s), 1 << 60):
                after[k, s] = cost + 1
                read[k, s] = ((k, s), ("delete", line[at], at))
        trail += [came, read]
        best = after
    trail.append(insert(best, len(line)))
    cost, node = min((best[most if counted else 0, s], (most if counted else 0, s)) for s in ENDS if (most if counted else 0, s) in best)
    edits = []
    for i in range(len(trail) - 1, -1, -1):
        while i % 2 == 0 and node in trail[i]:  # insertions before a symbol
            node, edit = trail[i][node]
            edits.append(edit)
        if i % 2:
            node, edit = trail[i][node]
            if edit:
                edits.append(edit)
    return cost, edits[::-1]


def header_of(line: str | None) -> tuple[str, list[str]]:
    """(delimiter, column names) of a file's first line; the first of DELIMITERS in it, a comma if none is."""
    text = bare(line or "").strip(" ")
    if not text:
        return DELIMITERS[0], list(DEFAULT_HEADER)
    delimiter = next((d for d in DELIMITERS if d in text), DELIMITERS[0])
    return delimiter, split_free(text, delimiter) or [c.strip(' "') for c in text.split(delimiter)]


def bare(line: str) -> str:
    """line without a leading byte-order mark and one closing carriage return."""
    return line.removeprefix("\ufeff").removesuffix("\r")


def check_values(values: dict[str, str]) -> str | None:
    """The first of the cells that can't be loaded, as a reason. A missing column counts as empty."""
    v = values.get("id", "")
    digits = v.lstrip("+-").lstrip("0")
    if INTEGER.fullmatch(v) is None or len(digits) > 10 or not -(2**31) <= int(v[:1].strip("+0123456789") + (digits or "0")) < 2**31:
        return "invalid_id"
    v = values.get("double_col", "")
    if v not in ("", "None") and (NUMBER.fullmatch(v) is None or not math.isfinite(float(v))):
        return "invalid_double_col"
    v = values.get("varchar_col", "")
    if len(v) > 20 or "\ufffd" in v:
        return "invalid_varchar_col"
    return None


#: Records of up to so many cells are parsed many at once, wider ones one by one.
WIDE = 24
#: Bytes of the tables that a worker has at a time while it parses many.
TABLES = 64 << 20
FAR = 1 << 28
CODES = {"q": 0, "d": 1, "s": 2, "o": 3}


class Moves:
    """What may happen between two symbols of a record of so many cells, as tables: the costs of going from one node to
    another by reading or deleting a symbol, after any insertions, and what is inserted and deleted for that.

    Nodes are (cells ended, state), and the five states once more for the parse of any number of cells.
    """

    def __init__(self, cells: int):
        self.counted = n = 5 * cells
        self.size = size = n + 5
        self.cost = np.full((4, size, size), FAR, np.int32)
        self.how: dict[tuple[int, int, int], tuple[str, bool]] = {}

        def read(i: int, symbol: str) -> int:
            to = _steps(i % 5 if i < n else i - n, symbol)
            if to is None:
                return -1
            k = i // 5 + to[1]
            return n + to[0] if i >= n else k * 5 + to[0] if k < cells else -1

        self.end_cost, self.end_how = np.full(size, FAR, np.int32), [""] * size
        for i in range(size):
            near, queue = {i: ""}, [i]
            for m in queue:  # grows while it is read: by number of insertions
                for symbol in "qd":
                    j = read(m, symbol)
                    if j >= 0 and j not in near:
                        near[j] = near[m] + symbol
                        queue.append(j)
            for m, inserted in near.items():
                for symbol, code in CODES.items():
                    j, c = read(m, symbol), len(inserted)
                    if symbol in "qd" and c + 1 < self.cost[code, i, m]:
                        self.cost[code, i, m] = c + 1
                        self.how[code, i, m] = (inserted, True)
                    if j >= 0 and c < self.cost[code, i, j]:
                        self.cost[code, i, j] = c
                        self.how[code, i, j] = (inserted, False)
                if (m - n if m >= n else m % 5) in ENDS and (m >= n or m // 5 == cells - 1) and len(inserted) < self.end_cost[i]:
                    self.end_cost[i], self.end_how[i] = len(inserted), inserted


@lru_cache(WIDE)
def _moves(cells: int) -> Moves:
    return Moves(cells)


@lru_cache(16)
def _symbols(delimiter: str) -> re.Pattern:
    d = re.escape(delimiter)
    return re.compile(f'(")|({d})|( +)|([^" {d}]+)')


def error_parses(lines: Sequence[str], delimiters: Sequence[str], cells: int) -> list[tuple[int, int, list[tuple[str, str, int]]]]:
    """Of each line (cost over any number of cells, cost over so many, the edits of the latter): error_parse for many at
    once. The dynamic programme goes over the symbols of all lines together, a table of costs and one of predecessors
    for each."""
    if cells > WIDE:
        return [(error_parse(x, d, None)[0], *error_parse(x, d, cells)) for x, d in zip(lines, delimiters)]
    moves = _moves(cells)
    found = [[(m.lastindex - 1, m.start()) for m in _symbols(d).finditer(x)] for x, d in zip(lines, delimiters)]
    order = sorted(range(len(lines)), key=lambda r: -len(found[r]))
    out: list = [None] * len(lines)
    at = 0
    while at < len(order):
        longest = max(1, len(found[order[at]]))
        part = order[at : at + max(1, min(TABLES // (longest * moves.size), TABLES // (8 * moves.size**2)))]
        at += len(part)
        lengths = np.array([len(found[r]) for r in part])
        codes = np.zeros((len(part), longest), np.int8)
        for i, r in enumerate(part):
            codes[i, : lengths[i]] = [c for c, _ in found[r]]
        cost = np.full((len(part), moves.size), FAR, np.int32)
        cost[:, [0, moves.counted]] = 0
        came = np.zeros((len(part), longest, moves.size), np.uint8)
        for t in range(longest):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # lines with a symbol here
            go = cost[:n, :, None] + moves.cost[codes[:n, t]]
            came[:n, t] = go.argmin(1)
            cost[:n] = np.minimum(go.min(1), FAR)
        total = cost + moves.end_cost
        node = total[:, : moves.counted].argmin(1)
        best, free = total[np.arange(len(part)), node], total[:, moves.counted :].min(1)
        edits: list[list[tuple[str, str, int]]] = []
        for i, r in enumerate(part):
            edits.append([("insert", '"' if s == "q" else delimiters[r], len(lines[r])) for s in reversed(moves.end_how[node[i]])])
        for t in range(longest - 1, -1, -1):
            n = int(np.searchsorted(-lengths, -t, side="left"))
            back = came[np.arange(n), t, node[:n]]
            for i in np.flatnonzero(moves.cost[codes[:n, t], back, node[:n]]):
                r, code = part[i], int(codes[i, t])
                inserted, deleted = moves.how[code, int(back[i]), int(node[i])]
                place = found[r][t][1]
                if deleted:
                    edits[i].append(("delete", lines[r][place], place))
                edits[i] += [("insert", '"' if s == "q" else delimiters[r], place) for s in reversed(inserted)]
            node[:n] = back
        for i, r in enumerate(part):
            out[r] = (int(free[i]), int(best[i]), edits[i][::-1])
    return out


def reason_of(free: int, cost: int) -> str | None:
    """What edits of these costs mend: quotes, if no number of cells is free of them, else the number of cells."""
    return "quoting" if free else "column_count" if cost else None


def shown(edits: Sequence[tuple[str, str, int]]) -> str:
    return "; ".join(f"{how} {c} at {i}" for how, c, i in edits)


def parse_record(line: str, delimiter: str, columns: Sequence[str]) -> tuple[str | None, dict[str, str], str, int]:
    """(reason or None, cells by column, edits as text, cost) of one record's minimum-cost parse."""
    cells = split_free(line, delimiter)
    if cells is not None and len(cells) == len(columns):
        values = dict(zip(columns, cells))
        reason = check_values(values)
        return reason, values, f"replace {reason.removeprefix('invalid_')}" if reason else "", int(reason is not None)
    ((free, cost, edits),) = error_parses([line], [delimiter], len(columns))
    return reason_of(free, cost), {}, shown(edits), cost


HEADS = "file_id bigint, d string, n int, at_id int, at_double int, at_varchar int"
#: Columns that a record is loaded as.
COLUMNS = ("id", "double_col", "varchar_col")


def headers(lines: DataFrame) -> DataFrame:
    """(HEADS) per file: delimiter, number of columns, and the places of COLUMNS, null for one that it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for head in batch.column(1).to_pylist():
                d, names = header_of(head)
                rows.append((d, len(names), *({c: i for i, c in enumerate(names)}.get(c) for c in COLUMNS)))
            kinds = [pa.string(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds))], names=[x.split(" ")[0] for x in HEADS.split(", ")])

    return lines.where("line_no = 1").groupBy("file_id").agg(F.min("line").alias("head")).mapInArrow(run, HEADS)


def _by_delimiter(make: Callable[[str], Column]) -> Column:
    first, *rest = DELIMITERS
    out = F.when(F.col("d") == first, make(re.escape(first)))
    for d in rest:
        out = out.when(F.col("d") == d, make(re.escape(d)))
    return out


def _cells(text: Column) -> tuple[Column, Column]:
    """(whether the record parses at no cost, its cells as they stand): the zero-cost layer within the JVM. Its patterns
    never go back, so they take a time in proportion to the text's length."""
    quoted = ' *+"[^"]*+(?:""[^"]*+)*+" *+'
    plain = lambda d: f'(?! *+")[^"{d}]*+'
    sound = _by_delimiter(lambda d: text.rlike(f"\\A(?:{quoted}|{plain(d)})(?:{d}(?:{quoted}|{plain(d)}))*+\\z"))
    split = _by_delimiter(lambda d: F.split(text, d, -1))
    cut = _by_delimiter(lambda d: F.regexp_extract_all(F.concat(F.col("d"), text), F.lit(f"{d}({quoted}|{plain(d)})"), 1))
    has = F.contains(text, F.lit('"'))
    return ~has | sound, F.when(~has, split).otherwise(cut)


def _value(cells: Column, at: str) -> Column:
    """A cell without outer spaces and quotes; empty for a column that the file lacks."""
    c = F.trim(F.get(cells, F.col(at)))
    inner = F.trim(F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')))
    return F.coalesce(F.when(c.startswith('"'), inner).otherwise(c), F.lit(""))


def parse_lines(raw: DataFrame) -> DataFrame:
    """Every record of raw (file_id, line_no, line): loaded as (id, double_col, varchar_col) with reason null, or with
    the reason of REASONS, the edits that would make it a valid record and their number as cost.

    A record costs the fewest quotes and delimiters that have to be inserted or deleted to give it the header's number of
    soundly quoted cells, or, if none, the cells that have to be replaced to fit their column. Cost 0 loads; else the
    edits state the reason: quotes that no number of cells spares, the number of cells, or the first cell replaced.
    Parses at no such cost are found in the JVM; only the texts of other records go to the dynamic programme in Python.

    Line 1 of a file is its header (of several the smallest text), which gives delimiter and column order; files
    without one are read as DEFAULT_HEADER by comma. Header, blank and null lines are no records; repeated lines are
    records each. A null file_id has no header. Texts of any length are parsed whole.
    """
    lines = raw.select(F.col("file_id").cast("long"), F.col("line_no").cast("long"), "line").where("line IS NOT NULL")
    body = lines.where("line_no IS NULL OR line_no != 1")
    marked = F.when(F.startswith("line", F.lit("\ufeff")), F.substring("line", 2, 1 << 30)).otherwise(F.col("line"))
    text = F.when(F.endswith(marked, F.lit("\r")), F.substring(marked, F.lit(1), F.length(marked) - 1)).otherwise(marked)
    rows = lookup_join(body.withColumn("text", text).where("trim(text) != ''"), headers(lines), ["file_id"], "left")
    given = {"d": DELIMITERS[0], "n": len(DEFAULT_HEADER), **{f"at_{c.split('_')[0]}": i for i, c in enumerate(COLUMNS)}}
    rows = rows.withColumns({c: F.when(F.col("n").isNull(), F.lit(v)).otherwise(F.col(c)) for c, v in given.items()})
    sound, cells = _cells(F.col("text"))
    rows = rows.withColumn("cells", F.when(sound, cells))
    rows = rows.withColumn("fits", F.coalesce(F.size("cells") == F.col("n"), F.lit(False)))
    rows = rows.withColumns({f"c_{c}": F.when(F.col("fits"), _value(F.col("cells"), f"at_{c.split('_')[0]}")) for c in COLUMNS})
    i, x, v = (F.col(f"c_{c}") for c in COLUMNS)
    number = x.rlike(f"\\A(?:{NUMBER.pattern})\\z")
    bad = {
        "id": ~(i.rlike(f"\\A(?:{INTEGER.pattern})\\z") & i.try_cast("int").isNotNull()),
        "double_col": ~x.isin(*NULL_TOKENS) & ~(number & F.coalesce(F.abs(x.try_cast("double")) < float("inf"), F.lit(False))),
        "varchar_col": (F.length(v) > 20) | F.contains(v, F.lit("\ufffd")),
    }
    rows = rows.withColumns({f"bad_{c}": F.col("fits") & b for c, b in bad.items()})
    rows = rows.withColumn("fix", _fix(F.when(~F.col("fits"), F.col("text")), F.when(~F.col("fits"), F.col("d")), F.col("n")))
    wrong = [F.col(f"bad_{c}") for c in COLUMNS]
    kind = F.coalesce(*(F.when(w, f"invalid_{c}") for w, c in zip(wrong, COLUMNS)))
    replaced = F.concat_ws("; ", *(F.when(w, f"replace {c}") for w, c in zip(wrong, COLUMNS)))
    fits = F.col("fits")
    loads = fits & ~(wrong[0] | wrong[1] | wrong[2])
    return rows.select(
        "file_id",
        "line_no",
        "line",
        F.when(fits, kind).otherwise(F.col("fix.reason")).alias("reason"),
        F.when(~fits, F.col("fix.edits")).when(~loads, replaced).alias("edits"),
        F.when(fits, sum((w.cast("int") for w in wrong), F.lit(0))).otherwise(F.col("fix.cost")).alias("cost"),
        F.when(loads, i.try_cast("int")).alias("id"),
        F.when(loads & ~x.isin(*NULL_TOKENS), x.try_cast("double")).alias("double_col"),
        F.when(loads & ~v.isin(*NULL_TOKENS), v).alias("varchar_col"),
    )


@F.arrow_udf(T.StructType([T.StructField("reason", T.StringType()), T.StructField("edits", T.StringType()), T.StructField("cost", T.IntegerType())]))
def _fix(text: pa.Array, delimiter: pa.Array, cells: pa.Array) -> pa.Array:
    """The minimum-cost parse of the texts that aren't null."""
    of: dict[int, list[int]] = {}
    for r in np.flatnonzero(text.is_valid().to_numpy(False)):
        of.setdefault(cells[int(r)].as_py(), []).append(int(r))
    out: list[dict | None] = [None] * len(text)
    for n, rows in of.items():
        lines, ds = text.take(pa.array(rows)).to_pylist(), delimiter.take(pa.array(rows)).to_pylist()
        for r, (free, cost, edits) in zip(rows, error_parses(lines, ds, n)):
            out[r] = {"reason": reason_of(free, cost), "edits": shown(edits), "cost": cost}
    return pa.array(out, pa.struct([("reason", pa.string()), ("edits", pa.string()), ("cost", pa.int32())]))


# else a filter on the reason would go below it, and take all of the parse along a second time
_fix = _fix.asNondeterministic()


def rejects(parsed: DataFrame) -> DataFrame:
    """The records that can't be loaded, with their reason."""
    return parsed.where("reason IS NOT NULL").select("file_id", "line_no", "line", "reason", "edits", "cost")


def loaded(parsed: DataFrame) -> DataFrame:
    """The valid rows."""
    return parsed.where("reason IS NULL").select("file_id", "line_no", "id", "double_col", "varchar_col")
