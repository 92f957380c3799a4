"""Typed tokens of source code: ``[FUNCDEF]name`` and the like, with 0-based line and byte column.

A small lexer and one pass of rules a language family, in Arrow batches. It needs no grammar and takes
incomplete code; what it can't tell apart from its neighbours it calls an identifier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import blocks, ship

#: Text bytes whose tokens a worker holds at once.
PART_BYTES = 1 << 19
TAGS = ("FUNCDEF", "FUNCDECL", "CLASS", "CALL", "IDENTIFIER", "PKG", "MODULE", "VARDECL", "OBJECTCREATION")
_PY = re.compile(r"""(?P<c>\#[^\n]*)|(?P<s>[rRbBuU]{0,2}(?P<f>[fF])?[rR]?(?:\"{3}.*?\"{3}|'{3}.*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'))|(?P<i>[^\W\d]\w*)|(?P<n>\d[\w.]*)|(?P<o>\*\*|->|==|!=|<=|>=|:=|[-+*/%&|^@]=|\n|[^\s\w])""", re.S)
_BRACE = re.compile(r"""(?P<c>//[^\n]*|/\*.*?\*/)|(?P<p>^[ \t]*\#[^\n]*)|(?P<s>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<i>~?[^\W\d]\w*)|(?P<n>\d[\w.]*)|(?P<o>::|->|==|!=|<=|>=|&&|\|\||\+\+|--|=>|[-+*/%&|^]=|[^\s\w])""", re.S | re.M)
_PY_WORDS = frozenset("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield True False None".split())
_FLOW = frozenset("if for while switch catch return throw else do case new delete sizeof emit revert assert_ typeof instanceof in co_return co_await using".split())
_MODIFIERS = frozenset("public private protected internal external static final abstract const constexpr inline virtual override synchronized volatile native mutable extern unsigned signed explicit friend typename view pure payable memory storage calldata indexed constant immutable anonymous default transient noexcept register thread_local struct".split())
_TYPES = frozenset("void int long short char float double boolean bool byte string address uint uint8 uint16 uint32 uint64 uint128 uint256 int8 int16 int32 int64 int128 int256 bytes bytes32 auto var mapping size_t wchar_t".split())
_SKIP = _FLOW | _MODIFIERS | _TYPES | frozenset("class interface enum union contract library function modifier event package import namespace template operator try finally throws extends implements is returns super true false null nullptr break continue goto this pragma require_ constructor fallback receive unchecked assembly error type".split())

Token = tuple[str, str, int]


def _lex(pattern: re.Pattern, code: str) -> list[tuple[str, str, int]]:
    """(kind, text, offset) without comments; kind is i, n, s, f (a string with expressions), p or o."""
    out = []
    for m in pattern.finditer(code):
        kind = m.lastgroup if m.lastgroup != "f" else "s"
        if kind == "c":
            continue
        if kind == "s" and "f" in m.groupdict() and m.group("f"):
            kind = "f"
        out.append((kind, m.group(), m.start()))
    return out


def _match(toks: list, at: int, open_: str = "(", close: str = ")") -> int:
    """Index of the bracket that closes the one at ``at``, or the last index."""
    depth = 0
    for k in range(at, len(toks)):
        depth += (toks[k][1] == open_) - (toks[k][1] == close)
        if depth == 0:
            return k
    return len(toks) - 1


def python_tokens(code: str, base: int = 0) -> Iterator[Token]:
    """(tag, name, offset) of Python code."""
    toks = _lex(_PY, code)
    text = [t[1] for t in toks]
    skip_to, n, k = -1, len(toks), 0
    start = True  # of a statement
    depth, blocks = 0, []
    params: dict[int, int] = {}
    while k < n:
        kind, t, at = toks[k]
        nxt = text[k + 1] if k + 1 < n else "\n"
        prev = text[k - 1] if k else "\n"
        if kind == "f":
            for m in re.finditer(r"\{([^{}]+?)(?:![rsa])?(?::[^{}]*)?\}", t):
                yield from python_tokens(m.group(1), base + at + m.start(1))
        elif kind == "o":
            depth += (t in "([{") - (t in ")]}")
            start = (t in ("\n", ";") and depth == 0) or (t == ":" and depth == 0)
            k += 1
            continue
        elif kind == "i":
            if t == "def" and k + 1 < n:
                yield "FUNCDEF", nxt, base + toks[k + 1][2]
                if k + 2 < n and text[k + 2] == "(":
                    end = _match(toks, k + 2)
                    params = {}
                    yield from _python_params(toks, k + 3, end, base)
                    k = end + 1
                    while k < n and text[k] not in (":", "\n"):
                        k += 1
                    continue
                k += 2
                continue
            if t == "class" and k + 1 < n:
                yield "CLASS", nxt, base + toks[k + 1][2]
                k += 2
                continue
            if t in ("import", "from") and start:
                end = k
                while end < n and text[end] not in ("\n", ";"):
                    end += 1
                yield from _python_imports(toks[k:end], base)
                k = end
                continue
            if t == "except":
                k += 1
                while k < n and text[k] not in ("as", ":", "\n"):
                    k += 1
                start = False
                continue
            if t == "raise":
                start = False
                k += 1
                while k < n and (toks[k][0] == "i" or text[k] == ".") and k + 1 < n:
                    k += 1
                continue
            if t in _PY_WORDS or (t.startswith("__") and False):
                start = start and t in ("async",)
                k += 1
                continue
            if prev == "@" and (k < 2 or text[k - 2] == "\n"):
                while k + 2 < n and text[k + 1] == ".":
                    yield "IDENTIFIER", text[k], base + toks[k][2]
                    k += 2
                yield "CALL", text[k], base + toks[k][2]
            elif nxt == "(":
                yield "CALL", t, base + at
            elif start and (nxt == "=" or (nxt == ":" and depth == 0 and k + 2 < n and toks[k + 2][0] == "i" and "=" in _line(text, k))):
                yield "VARDECL", t, base + at
                if nxt == ":":
                    while k + 1 < n and text[k + 1] not in ("=", "\n"):
                        k += 1
            else:
                yield "IDENTIFIER", t, base + at
        start = False
        k += 1


def _line(text: list[str], k: int) -> list[str]:
    end = k
    while end < len(text) and text[end] != "\n":
        end += 1
    return text[k:end]


def _python_params(toks: list, at: int, end: int, base: int) -> Iterator[Token]:
    depth, expect = 0, True
    k = at
    while k < end:
        kind, t, pos = toks[k]
        if t in "([{":
            depth += 1
        elif t in ")]}":
            depth -= 1
        elif depth == 0 and t == ",":
            expect = True
        elif depth == 0 and t == ":" and not expect:
            while k + 1 < end and not (depth == 0 and toks[k + 1][1] in ("=", ",")):
                k += 1
                depth += (toks[k][1] in "([{") - (toks[k][1] in ")]}")
        elif kind == "i" and expect:
            yield "VARDECL", t, base + pos
            expect = False
        elif kind == "i" and t not in _PY_WORDS:
            yield ("CALL" if k + 1 < end and toks[k + 1][1] == "(" else "IDENTIFIER"), t, base + pos
        k += 1


def _python_imports(toks: list, base: int) -> Iterator[Token]:
    names = [t for t in toks if t[1] not in ("(", ")")]
    cut = next((k for k, t in enumerate(names) if t[1] == "import"), None)
    if cut is None:
        return
    if names[0][1] == "from":
        part = names[1:cut]
        if part:
            yield "MODULE", "".join(t[1] for t in part), base + part[0][2]
    group: list = []
    for t in [*names[cut + 1 :], ("o", ",", 0)]:
        if t[1] == ",":
            if group:
                words = [g[1] for g in group]
                at = words.index("as") + 1 if "as" in words else 0
                yield "PKG", "".join(words[at:]), base + group[at][2]
            group = []
        else:
            group.append(t)


def _joined(toks: list) -> list:
    """With ``operator()`` and the like, and names with template arguments before a call, as one name each."""
    out, k, n = [], 0, len(toks)
    while k < n:
        kind, t, at = toks[k]
        if t == "operator" and k + 1 < n:
            j = k + 1
            name = "operator"
            while j < n and (name == "operator" or toks[j][1] != "("):
                name += toks[j][1]
                j += 1
                if name in ("operator(", "operator["):
                    name += toks[j][1] if j < n else ""
                    j += 1
            out.append(("i", name, at))
            k = j
            continue
        if kind == "i" and k + 3 < n and toks[k + 1][1] == "<" and t not in _SKIP and t not in ("static_cast", "dynamic_cast", "reinterpret_cast", "const_cast"):
            end = _match(toks, k + 1, "<", ">")
            inner = toks[k + 2 : end]
            if end + 1 < n and toks[end + 1][1] == "(" and inner and all(x[0] == "i" or x[1] in ("::", ",", "*", "&", "<", ">") for x in inner):
                out.append(("i", t + "".join(x[1] for x in toks[k + 1 : end + 1]), at))
                k = end + 1
                continue
        out.append(toks[k])
        k += 1
    return out


def brace_tokens(code: str, language: str) -> Iterator[Token]:
    """(tag, name, offset) of code of the C family, Java and Solidity."""
    toks = _lex(_BRACE, code)
    if language in ("c", "cpp"):
        toks = _joined(toks)
    text = [t[1] for t in toks]
    n, k = len(toks), 0
    classes: list[str] = []
    paren: list[bool] = []  # is an open parenthesis that of parameters?
    while k < n:
        kind, t, at = toks[k]
        prev, nxt = (text[k - 1] if k else ";"), (text[k + 1] if k + 1 < n else ";")
        if kind == "p":
            if m := re.match(r'\s*#\s*include\s*([<"][^>"]+[>"])', t):
                yield "PKG", m.group(1), at + m.start(1)
            k += 1
            continue
        if t == "(":
            paren.append(False)
        elif t == ")" and paren:
            paren.pop()
        if kind != "i":
            k += 1
            continue
        if t in ("import", "using", "package", "pragma") and prev in (";", "}", "{", ")"):
            end = k
            while end < n and text[end] != ";":
                end += 1
            if t == "import":
                part = [x for x in toks[k + 1 : end] if x[1] != "static"]
                if part:
                    quoted = [x for x in part if x[0] == "s"]
                    yield "PKG", (quoted[-1][1] if quoted else "".join(x[1] for x in part)), part[0][2]
            k = end
            continue
        if t in ("class", "interface", "struct", "union", "contract", "library") and k + 1 < n and toks[k + 1][0] == "i" and prev not in (".", "<", ",") and (k + 2 >= n or text[k + 2] in ("{", ":", "<", "extends", "implements", "is", ";", "final")):
            if not (k + 2 < n and text[k + 2] == ";"):
                yield "CLASS", nxt, toks[k + 1][2]
                classes.append(nxt)
                if t == "union" and k + 2 < n and text[k + 2] == "{":
                    k = _match(toks, k + 2, "{", "}")  # its members aren't emitted
                    continue
            k += 2
            while k < n and text[k] not in ("{", ";"):  # what it extends isn't emitted
                k += 1
            continue
        if t == "decltype" and nxt == "(" and (j := _match(toks, k + 1) + 1) < n and toks[j][0] == "i":
            yield "VARDECL", text[j], toks[j][2]
            k = j + 1
            continue
        if t == "enum":
            end = next((j for j in range(k, n) if text[j] == "}"), n)
            for x in toks[k + 1 : end]:
                if x[0] == "i" and x[1] not in ("class", "struct"):
                    yield "IDENTIFIER", x[1], x[2]
            k = end
            continue
        if t in ("function", "modifier", "constructor") and language == "solidity":
            name = t if t == "constructor" else nxt
            j = k + (t != "constructor")
            open_ = j + 1 if j + 1 < n and text[j + 1] == "(" else None
            close = _match(toks, open_) if open_ else j
            stop = next((x for x in range(close, n) if text[x] in ("{", ";")), n - 1)
            if t != "constructor":
                yield ("FUNCDEF" if text[stop] == "{" else "FUNCDECL"), name, toks[j][2]
            if open_:
                yield from _brace_params(toks, open_ + 1, close)
            returns = next((x for x in range(close, stop) if text[x] == "returns"), stop)
            for x in range(close + 1, returns):
                if toks[x][0] == "i" and text[x] not in _SKIP:
                    yield ("CALL" if x + 1 <= stop else "IDENTIFIER"), text[x], toks[x][2]
            k = stop
            continue
        if t in ("event", "emit") and language == "solidity":
            while k < n and text[k] != ";":
                k += 1
            continue
        if t == "throws":
            while k < n and text[k] not in ("{", ";"):
                k += 1
            continue
        if language == "solidity" and prev != "." and (end := _member_call(toks, k)) > k:
            # a member call's token is the whole expression
            yield "CALL", code[at : toks[end][2] + len(text[end])], at
            k = end + 1
            continue
        if t == "new" and k + 1 < n:
            if language == "solidity":
                yield "CALL", f"new {nxt}", at
                k += 2
                continue
            j, name = k + 1, ""
            while j < n and text[j] not in ("(", "[", "{", ";"):
                name += text[j]
                j += 1
            yield "OBJECTCREATION", name, toks[k + 1][2]
            k = j
            continue
        if t == "template" and nxt == "<":
            k = _match(toks, k + 1, "<", ">") + 1
            continue
        if t == "namespace" and k + 1 < n and toks[k + 1][0] == "i":
            k += 2
            continue
        if t == "typedef":
            while k < n and text[k] != ";":
                k += 1
            continue
        if t in _FLOW or t in ("try", "super", "this"):
            if t == "this" and language == "java" and nxt == "." and k + 3 < n and text[k + 3] != "(":
                yield "IDENTIFIER", t, at
            k += 1
            continue
        if t == "catch":
            k += 1
            continue
        if nxt == "(" and t not in _SKIP and t not in _TYPES:
            close = _match(toks, k + 1)
            after = close + 1
            while after < n and text[after] in ("const", "override", "noexcept", "final", "throws") or (after < n and toks[after][0] == "i" and "throws" in text[close:after]) or (after < n and text[after] == "," and "throws" in text[close:after]):
                after += 1
            follows = text[after] if after < n else ""
            if follows == "=" and after + 1 < n and text[after + 1] in ("default", "delete", "0"):
                follows = "{"
            typed = (k > 0 and toks[k - 1][0] == "i" and prev not in _FLOW) or (prev in (">", "]", "*", "&", "const") and _is_type_before(toks, k)) or (prev == "::" and _scope_typed(toks, k))
            ctor = bool(classes) and t.lstrip("~") == classes[-1] and prev in ("{", "}", ";", ":", "~", "public", "private", "protected", "explicit", "virtual")
            if (typed or ctor) and (follows in ("{", ":") or follows == ";" and _params_only(toks, k + 1, close)):
                yield ("FUNCDEF" if follows != ";" else "FUNCDECL"), t, at
                if prev == "::":
                    j = _qualified_from(toks, k)
                    yield ("FUNCDEF" if follows != ";" else "FUNCDECL"), "".join(text[j : k + 1]), toks[j][2]
                if not ctor or follows != ";":
                    yield from _brace_params(toks, k + 2, close)
                k = close + 1
                if follows == ":":  # members are initialised
                    while k < n and text[k] not in ("{", ";"):
                        k += 1
                continue
            yield "CALL", t, at
            if prev == "::" and (j := _qualified_from(toks, k)) < k:
                yield "CALL", "".join(text[j : k + 1]), toks[j][2]
            k += 1
            continue
        if _declares(toks, k):
            # the type that went before isn't emitted
            j = _name_after_type(toks, k)
            yield "VARDECL", text[j], toks[j][2]
            k = j + 1
            while k + 2 < n and text[k] == "," and toks[k + 1][0] == "i" and text[k + 2] in (",", ";", "=") and prev != "(":
                yield "VARDECL", text[k + 1], toks[k + 1][2]
                k += 2
            continue
        j = k + 1
        while j < n and text[j] in ("*", "&", "&&", "const"):
            j += 1
        if j + 1 < n and toks[j][0] == "i" and text[j + 1] in ("(", "::") and text[j] not in _SKIP and (prev in (";", "{", "}", ">") or prev in _MODIFIERS or (prev == ":" and text[k - 2] in ("public", "private", "protected"))):
            k = j  # a return type
            continue
        if prev == "<" and nxt == ">" and language == "java":
            k += 1
            continue
        if prev == "." and nxt == "class":
            k += 1
        if t not in _SKIP:
            if prev == "::" and language == "java":
                yield "CALL", t, at
            elif nxt != "::" or language == "java":
                yield "IDENTIFIER", t, at
        k += 1


def _member_call(toks: list, k: int) -> int:
    """Index of the last name of ``a.b(`` or ``a(x).b(`` that begins at ``k``; ``k`` when it is none."""
    n, j = len(toks), k
    while True:
        after = j + 1
        if after < n and toks[after][1] == "(":
            close = _match(toks, after)
            if close + 2 < n and toks[close + 1][1] == "." and toks[close + 2][0] == "i":
                j = close + 2
                continue
            return j
        if after + 1 < n and toks[after][1] == "." and toks[after + 1][0] == "i":
            j = after + 1
            continue
        return k


def _is_type_before(toks: list, k: int) -> bool:
    j = k - 1
    while j >= 0 and toks[j][1] in (">", "]", "*", "&", "[", "<", ",", "::") or (j >= 0 and toks[j][0] == "i" and toks[j][1] not in _FLOW and (toks[j + 1][1] in ("<", ">", ",", "*", "&", "[", "]", "::") or toks[j + 1][1] in ("const", "constexpr"))):
        j -= 1
    return j < 0 or toks[j][1] in (";", "{", "}", ")", ":") or toks[j][1] in _MODIFIERS


def _scope_typed(toks: list, k: int) -> bool:
    j = _qualified_from(toks, k) - 1
    return j >= 0 and (toks[j][0] == "i" and toks[j][1] not in _FLOW or toks[j][1] in (">", "*", "&", "}", ";"))


def _qualified_from(toks: list, k: int) -> int:
    """Index of the first name of ``a::b::c`` that ends at ``k``."""
    while k >= 2 and toks[k - 1][1] == "::" and toks[k - 2][0] == "i":
        k -= 2
    return k


def _params_only(toks: list, open_: int, close: int) -> bool:
    """Are these parameters of a declaration rather than arguments?"""
    inner = toks[open_ + 1 : close]
    return not inner or (inner[0][0] == "i" and all(x[0] != "s" and x[0] != "n" for x in inner) and (len(inner) > 1 or inner[0][1] in _TYPES))


def _brace_params(toks: list, at: int, end: int) -> Iterator[Token]:
    depth, last, some, done = 0, None, 0, False
    for x in [*toks[at:end], ("o", ",", 0)]:
        depth += (x[1] in "(<[{") - (x[1] in ")>]}" and x[1] != "->")
        if x[1] == "," and depth <= 0:
            if last and some > 1:
                yield "VARDECL", last[1], last[2]
            last, some, done, depth = None, 0, False, 0
        elif x[1] == "=":
            done = True
        elif x[0] == "i" and depth <= 0 and not done:
            some += 1
            if x[1] not in _MODIFIERS and x[1] not in _TYPES or some > 1 and x[1] not in _MODIFIERS:
                last = x


def _name_after_type(toks: list, k: int) -> int:
    """Index of the declared name when a type begins at ``k``, else -1."""
    n, j = len(toks), k + 1
    while j + 1 < n and toks[j][1] == "::" and toks[j + 1][0] == "i":
        j += 2
    if toks[k][1] == "mapping" and j < n and toks[j][1] == "(":
        j = _match(toks, j) + 1
    if j < n and toks[j][1] == "<":
        depth = 0
        while j < n:
            depth += (toks[j][1] == "<") - (toks[j][1] == ">")
            if toks[j][1] in (";", "(", "{", "&&", "||"):
                return -1
            j += 1
            if depth == 0:
                break
    while j < n and toks[j][1] in ("*", "&", "&&", "[", "]", "const", "constexpr") or (j < n and toks[j][0] == "n" and toks[j - 1][1] == "["):
        j += 1
    while j < n and toks[j][1] in _MODIFIERS:
        j += 1
    return j if j < n and toks[j][0] == "i" and toks[j][1] not in _SKIP else -1


def _declares(toks: list, k: int) -> bool:
    t = toks[k][1]
    if t in _FLOW or (t in _SKIP and t not in _TYPES):
        return False
    prev = toks[k - 1][1] if k else ";"
    if prev not in (";", "{", "}", "(", ":", ")", ">") and prev not in _MODIFIERS:
        return False
    j = _name_after_type(toks, k)
    if j < 0 or (j + 1 < len(toks) and toks[j + 1][1] not in ("=", ";", ",", "[", ":", ")", "{")):
        return False
    return not (toks[j - 1][1] in ("*", "&") and prev in ("(",) and toks[j + 1][1] == ")")


_XML = re.compile(r"""<(?:select|insert|update|delete|sql)\b[^>]*?\bid\s*=\s*["']([^"']*)["']""")


def typed_tokens(code: str, language: str) -> list[tuple[str, str, int, int]]:
    """(tag, name, line, byte column), by position. A language without rules gives untagged ASCII words (tag '')."""
    if language == "python":
        found = python_tokens(code)
    elif language in ("c", "cpp", "java", "solidity"):
        found = brace_tokens(code, language)
    elif language == "xml":
        found = (("FUNCDEF", m.group(1), m.start(1)) for m in _XML.finditer(code))
    else:
        found = (("", m.group(), m.start()) for m in re.finditer(r"\w+", code) if m.group().isascii())
    starts = [0, *[m.end() for m in re.finditer("\n", code)]]
    out, line = [], 0
    for tag, name, at in sorted(found, key=lambda x: x[2]):
        while line + 1 < len(starts) and starts[line + 1] <= at:
            line += 1
        out.append((tag, name.encode()[:255].decode(errors="ignore"), line, len(code[starts[line] : at].encode())))
    return out


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str = "programming_language") -> DataFrame:
    """``(doc_id, tag, name, token, line, col)`` of every document; null texts have none."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(1), PART_BYTES):
                part = batch.slice(a, b - a)
                at, rows = [], []
                for k, (text, lang) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    own = typed_tokens(text, lang or "") if text else []
                    at += [k] * len(own)
                    rows += own
                tag, name, line, col = zip(*rows) if rows else ((),) * 4
                token = [f"[{t}]{n}" if t else n for t, n in zip(tag, name)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *[pa.array(v, pa.string()) for v in (tag, name, token)], *[pa.array(v, pa.int32()) for v in (line, col)]], names=["doc_id", "tag", "name", "token", "line", "col"])

    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(language_col).alias("lang"))
    return some.mapInArrow(run, f"doc_id {kind}, tag string, name string, token string, line int, col int")


def listed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, tokens)`` of ``(doc_id, text, programming_language)``: the tokens of each row in their order, without a shuffle."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("token", pa.string()), ("line", pa.int32()), ("col", pa.int32())])

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(1), PART_BYTES):
                part = batch.slice(a, b - a)
                own = [typed_tokens(t, lang or "") if t else [] for t, lang in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32))
                rows = [x for some in own for x in some]
                values = pa.StructArray.from_arrays([pa.array([f"[{t}]{n}" if t else n for t, n, _, _ in rows], pa.string()), pa.array([x[2] for x in rows], pa.int32()), pa.array([x[3] for x in rows], pa.int32())], fields=list(item))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(ends, values)], names=["doc_id", "text", "tokens"])

    return docs.select("doc_id", "text", "programming_language").mapInArrow(run, f"doc_id {kind}, text string, tokens array<struct<token:string,line:int,col:int>>")
