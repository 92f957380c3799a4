"""Splitters that end chunks where statements or sentences end, and the choice between them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import document_type
from ..runtime import ship

CODE_RATIO, TEXT_RATIO = 0.75, 0.8
_WORDS = re.compile(r"\S+\s*|\s+")
_SENTENCE_END = re.compile(r"[.!?][\"')\]]*(?=\s|$)")


def statement_ends(text: str) -> list[int]:
    """Offsets after lines where no bracket is open and that the next line doesn't continue."""
    out, depth, at = [], 0, 0
    for line in text.splitlines(keepends=True):
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*|#.*", "", line)
        depth = max(0, depth + sum(bare.count(c) for c in "([") - sum(bare.count(c) for c in ")]"))
        at += len(line)
        if depth == 0 and bare.strip() and not bare.rstrip().endswith(("\\", ",", "=", "+", "&&", "||", ".")):
            out.append(at)
    return out


def sentence_ends(text: str) -> list[int]:
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    return ends or [m.end() for m in re.finditer("\n", text)]


def snapped(text: str, ends: list[int], size: int, overlap: int, ratio: float) -> list[tuple[int, int]]:
    """(begin, end) of chunks of up to ``size`` words.

    A chunk ends at the last boundary that leaves it ``ratio * size`` words or more, else at ``size`` words; the next
    begins ``overlap`` words earlier, moved on to the first boundary in that stretch. Every character is in a chunk.
    """
    words = [m.span() for m in _WORDS.finditer(text)]
    out, first = [], 0
    boundary = sorted(set(ends))
    while first < len(words):
        last = min(first + size, len(words))
        if last < len(words):
            low, high = words[first + max(1, int(size * ratio)) - 1][1], words[last - 1][1]
            fit = [b for b in boundary if low <= b <= high]
            if fit:
                last = next(k for k in range(first, last) if words[k][1] >= fit[-1]) + 1
        out.append((words[first][0], words[last - 1][1]))
        if last >= len(words):
            break
        nxt = max(first + 1, last - overlap) if overlap else last
        if overlap:
            start = [b for b in boundary if words[nxt][0] <= b < words[last - 1][1]]
            if start:
                nxt = next(k for k in range(nxt, last + 1) if k == last or words[k][1] > start[0])
        first = nxt
    return out


def _split(docs: DataFrame, ends: Callable[[str], list[int]], size: int, overlap: int, ratio: float) -> DataFrame:
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for i, t in zip(f["doc_id"], f["text"]):
                spans = snapped(t, ends(t), size, overlap, ratio) if t else []
                rows += [(i, n, t[a:b], t.count("\n", 0, a), t.count("\n", 0, b)) for n, (a, b) in enumerate(spans) if t[a:b].strip()]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "text", "start_line", "end_line"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, ord int, text string, start_line int, end_line int")


def split_code(docs: DataFrame, size: int = 256, overlap: int = 32, ratio: float = CODE_RATIO) -> DataFrame:
    """Chunks that end with statements; blank ones are dropped."""
    return _split(docs, statement_ends, size, overlap, ratio)


def split_text(docs: DataFrame, size: int = 256, overlap: int = 32, ratio: float = TEXT_RATIO) -> DataFrame:
    """Chunks that end with sentences; blank ones are dropped."""
    return _split(docs, sentence_ends, size, overlap, ratio)


def split_dynamic(docs: DataFrame, size: int = 256, overlap: int = 32) -> DataFrame:
    """Code by statements and text by sentences, as ``ext`` says; what is neither is taken as text."""
    kind = document_type(F.col("ext"))
    return split_code(docs.where(kind == "code"), size, overlap).unionByName(split_text(docs.where(kind != "code"), size, overlap))


def assign_tokens(chunks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each token ``(doc_id, token, line, col)`` with the first chunk whose lines reach it."""
    spans = chunks.select("doc_id", "ord", "start_line", "end_line")
    near = tokens.join(spans, "doc_id").where("line BETWEEN start_line AND end_line")
    return near.groupBy("doc_id", "token", "line", "col").agg(F.min("ord").alias("ord"))
