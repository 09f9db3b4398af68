"""Encoding of the whole corpus with a public byte-level tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files, the same on every machine; a parameter wherever it is used.
TOKENIZERS = "/opt/tokenizers"
#: Texts longer than this many characters are encoded in chunks of that size.
CHUNK = 32_768
#: Characters that a chunk shares with the next one.
OVERLAP = 512
#: Texts that a worker encodes before it hands over their ids.
ROWS = 256

# White space as the tokenizer sees it, and its pre-token pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    """Byte-level BPE from a file of ranks."""

    def __init__(self, folder: str, name: str):
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.int32)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offsets at which the tokens end."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids) -> str:
        return self.encoding.decode_bytes(list(ids)).decode("utf-8")


@lru_cache(4)
def tokenizer(folder: str, name: str) -> Tokenizer:
    return Tokenizer(folder, name)


@lru_cache(1)
def _pre_tokens():
    import regex

    return regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


@lru_cache(1)
def certain():
    """Where every tokenisation has a boundary, wherever it began, as no pre-token goes across: before white space that
    follows other text, and where letters, digits and other signs meet, but for an apostrophe before a letter."""
    import regex

    letter, digit, sign = r"\p{L}", r"\p{N}", rf"[^{SPACE}\p{{L}}\p{{N}}]"
    return regex.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])|(?<={letter})(?={digit}|{sign})|(?<={digit})(?={letter}|{sign})|(?<={sign})(?={digit})|(?<={sign})(?<!')(?={letter})")


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, next start, end) of overlapping chunks. Each overlap holds a place where tokenisations from any start meet;
    a stretch without one stays in one chunk."""
    out, at, n = [], 0, len(text)
    while True:
        nxt = at + size
        if nxt + overlap < n:
            meet = certain().search(text, nxt + 1)
            if meet is not None:
                if meet.start() > nxt + overlap - 2:
                    nxt = meet.start() - overlap // 2
                end = nxt + overlap
                if end < n:
                    out.append((at, nxt, end))
                    at = nxt
                    continue
        out.append((at, n, n))
        return out


def boundaries(window: str, start: int, stop: int, whole: bool) -> list[int]:
    """Pre-token boundaries of window within [start, stop], from a tokenisation of it from its beginning.

    whole: the text ends with the window; else the last pre-token may go on and its end doesn't count."""
    at = 0
    if start:
        back = max(0, start - 256)
        while back >= 0:
            near = [m.start() for m in certain().finditer(window, back, start + 1) if m.start() <= start]
            if near:
                at = near[-1]
                break
            if back == 0:
                break
            back = max(0, back * 2 - start)
    out = [at] if at >= start else []
    for m in _pre_tokens().finditer(window, at):
        e = m.end()
        if e > stop or (e == len(window) and not whole):
            break
        if e >= start:
            out.append(e)
    return out


def _indices(window: str, ends: np.ndarray, places: list[int]) -> tuple[list[int], list[int]]:
    """Those of places that are token boundaries, and how many tokens come before each."""
    at = [len(window[:p].encode()) if not window.isascii() else p for p in places]
    index = np.searchsorted(ends, at, side="left") + 1
    keep = [(p, 0 if b == 0 else int(i)) for p, b, i in zip(places, at, index) if b == 0 or (i <= len(ends) and ends[i - 1] == b)]
    return [p for p, _ in keep], [i for _, i in keep]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()))


def tasks(df: DataFrame) -> int:
    """Tasks for work that is long for the bytes it moves, which are not to be merged for being small."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids) of every row: text unchanged as token ids, without special tokens; null and empty texts give the empty list.

    Texts of up to chunk characters are encoded where they are read, without an exchange. Longer ones are cut into
    overlapping chunks that are spread over all tasks; each is pre-tokenised and encoded from its own start, and two
    neighbours are stitched at the first pre-token boundary that both have in their overlap: from there on they agree,
    as no pre-token depends on what is before it. Overlaps lie where letters, digits, signs or white space meet; only a
    stretch of one kind stays in one chunk. Rows with equal keys, null too, come out each; other columns are dropped.
    """
    if not 2 <= overlap <= chunk:
        raise ValueError("overlap must be from 2 to chunk")
    docs = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    texts = docs.withColumn("h", F.xxhash64("t"))  # tells apart the texts of one key
    kind = docs.schema["k"].dataType.simpleString()
    is_long = F.length("t") > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder, name)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([tok.encode(t) for t in part.column(1).to_pylist()])], names=["k", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = batch.column(1)[i].as_py()
                for j, (a, b, e) in enumerate(chunks(t, chunk, overlap)):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([j], pa.int32()), pa.array([b - a], pa.int64()), pa.array([e == len(t)]), pa.array([t[a:e]])],
                        names=["k", "h", "i", "own", "last", "w"],
                    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder, name)
        for batch in batches:
            for r in range(batch.num_rows):
                i, own, last, w = (batch.column(c)[r].as_py() for c in range(2, 6))
                ids = tok.encode(w)
                ends = tok.ends(ids)
                head = _indices(w, ends, boundaries(w, 0, min(len(w), overlap), last)) if i else ([0], [0])
                tail = _indices(w, ends, boundaries(w, own, len(w), False)) if not last else ([], [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(r, 1), batch.column(1).slice(r, 1), pa.array([i], pa.int32()), _lists([ids])]
                    + [_lists([np.array(x, np.int32)]) for x in (head[0], head[1], [p - own for p in tail[0]], tail[1])],
                    names=["k", "h", "i", "ids", "hp", "hi", "tp", "ti"],
                )

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                given = batch.column(1)[r].as_py()
                parts = [c for _, c in sorted({c["i"]: c for c in given}.items())]
                copies = sum(c["i"] == 0 for c in given)
                out, begin = [], 0
                for a, b in zip(parts, parts[1:] + [None]):
                    stop = len(a["ids"])
                    after = 0
                    if b is not None:
                        ahead = dict(zip(b["hp"], b["hi"]))
                        met = next(((t, ahead[p]) for p, t in zip(a["tp"], a["ti"]) if p in ahead), None)
                        if met is None:
                            raise RuntimeError("two chunks share no pre-token boundary")
                        stop, after = met
                    out.append(np.array(a["ids"][begin:stop], np.int32))
                    begin = after
                row = pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), _lists([np.concatenate(out)])], names=["k", "ids"])
                yield from [row] * copies

    short = docs.where(~is_long).mapInArrow(whole, f"k {kind}, ids array<int>")
    cuts = texts.where(is_long).mapInArrow(cut, f"k {kind}, h bigint, i int, own bigint, last boolean, w string").repartition(tasks(docs), "k", "h", "i")
    coded = cuts.mapInArrow(encode, f"k {kind}, h bigint, i int, ids array<int>, hp array<int>, hi array<int>, tp array<int>, ti array<int>")
    grouped = coded.groupBy("k", "h").agg(F.collect_list(F.struct("i", "ids", "hp", "hi", "tp", "ti")).alias("c")).select("k", "c")
    return short.unionByName(grouped.mapInArrow(stitch, f"k {kind}, ids array<int>")).withColumnRenamed("k", key)


def decode_corpus(encoded: DataFrame, key: str = "doc_id", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text) from (key, ids): the tokens' raw bytes joined. Null ids give null text."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder, name)
        for batch in batches:
            texts = [None if i is None else tok.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    return encoded.select(F.col(key).alias("k"), "ids").mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
