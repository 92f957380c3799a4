"""Chunks of code that don't cut typed tokens, with numbered lines and the tokens that begin in each."""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..runtime import blocks, ship
from .chunks import SEPARATORS

#: Text bytes whose chunks a worker holds at once.
PART_BYTES = 1 << 19
#: Units a chunk is extended by, at most, to finish a token.
LOOK_AHEAD = 100
_LINES = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")


def placed_units(text: str, separator: str) -> list[tuple[str, int, int]]:
    """(unit, line, byte column) of the text cut at the separator, without an empty unit at its end."""
    parts = text.split(separator) if separator else list(text)
    if parts and parts[-1] == "":
        parts.pop()
    out, line, col = [], 0, 0
    for p in parts:
        out.append((p, line, col))
        whole = p + separator
        breaks = whole.count("\n")
        line += breaks
        col = len(whole[whole.rfind("\n") + 1 :].encode()) + (0 if breaks else col)
    return out


def numbered(text: str, start: int) -> str:
    return "\n".join(f"{start + k}: {x}" if x else "" for k, x in enumerate(text.split("\n")))


def _extended(units: list, end: int, by_line: dict[int, list[tuple[int, int]]]) -> int:
    """``end``, or as many units later as it takes to finish a token that the last unit ends inside of."""
    unit, line, col = units[end - 1]
    last = col + len(unit.encode()) - 1
    on = by_line.get(line, [])
    k = bisect_right(on, (last, -1)) - 1
    if "\n" in unit or k < 0 or not on[k][0] < last < on[k][1]:
        return end
    for more in range(end, min(end + LOOK_AHEAD, len(units))):
        u, at, c = units[more]
        if at != line or c + len(u.encode()) - 1 >= on[k][1]:
            return more + 1
    return end


def code_chunks(text: str, tokens: list[tuple[str, int, int]], size: int = 256, overlap: int = 0, split_by: str = "word") -> list[dict]:
    """Chunks of one document; ``tokens`` are (token, line, byte column).

    A chunk ends after ``size`` units, or later if a token would be cut; the next one begins ``size - overlap`` units
    after its start all the same. A chunk that begins in the line where the one before ended is led by as many spaces
    as its column. A token belongs to the first chunk that ends after the token's start.
    """
    sep = SEPARATORS[split_by]
    units = placed_units(text, sep) if text else []
    step = size - overlap if size > overlap else size
    ordered = sorted(tokens, key=lambda t: (t[1], t[2]))
    by_line: dict[int, list[tuple[int, int]]] = {}
    for name, line, col in ordered:
        by_line.setdefault(line, []).append((col, col + len(name[name.find("]") + 1 :].encode()) - 1))
    out, at, used = [], 0, 0
    ended: tuple[int, int] | None = None
    while at < len(units):
        end = _extended(units, min(at + size, len(units)), by_line)
        _, line, col = units[at]
        lead = col if ended and line == ended[0] and col > ended[1] else 0
        body = sep.join(u for u, _, _ in units[at:end])
        if units[at][0] == "" and not lead:
            body = sep + body
        if sep == ".":
            body += sep
        original = " " * lead + body
        last, last_line, last_col = units[end - 1]
        ended = (last_line, last_col + len(last.encode()))
        tail = last.rfind("\n")
        limit = (last_line + last.count("\n"), len(last[tail + 1 :].encode()) + (last_col if tail < 0 else 0))
        mine = used
        while used < len(ordered) and (ordered[used][1], ordered[used][2]) < limit:
            used += 1
        own = numbered(original, line)
        pieces = _LINES.split(own)
        n = len(pieces) - (pieces[-1] == "")
        out.append({"ord": len(out), "text": own, "original_text": original, "start_line": line, "end_line": line + max(n, 1) - 1, "position_restoration_spaces": lead, "tokens": ordered[mine:used]})
        if at + size >= len(units):
            break
        at += step
    return out


_SCHEMA = "ord int, text string, original_text string, start_line int, end_line int, position_restoration_spaces int, tokens array<struct<token:string,line:int,col:int>>"


def split_code_chunks(docs: DataFrame, size: int = 256, overlap: int = 0, split_by: str = "word") -> DataFrame:
    """Chunks of ``(doc_id, text, tokens)``, ``tokens`` being an array of (token, line, col) or null."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    *plain, _ = StructType.fromDDL(_SCHEMA)
    item = [pa.field("token", pa.string()), pa.field("line", pa.int32()), pa.field("col", pa.int32())]

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(1), PART_BYTES):
                part = batch.slice(a, b - a)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)).tolist()
                flat = pc.list_flatten(part.column(2))
                # by column: a Python object for each field of each token takes most of the time
                tokens = list(zip(*[pc.struct_field(flat, f.name).to_numpy(zero_copy_only=False).tolist() for f in item]))
                at, rows = [], []
                for k, (text, start, end) in enumerate(zip(part.column(1).to_pylist(), [0, *ends], ends)):
                    own = code_chunks(text, tokens[start:end], size, overlap, split_by) if text else []
                    at += [k] * len(own)
                    rows += own
                mine = [t for c in rows for t in c["tokens"]]
                columns = zip(*mine) if mine else ((),) * 3
                cuts = pa.array(np.concatenate(([0], np.cumsum([len(c["tokens"]) for c in rows]))).astype(np.int32))
                listed = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(columns, item)], fields=item))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *[pa.array([c[f.name] for c in rows], to_arrow_type(f.dataType)) for f in plain], listed], names=["doc_id", *[f.name for f in plain], "tokens"])

    return docs.select("doc_id", "text", "tokens").mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")
