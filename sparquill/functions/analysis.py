"""Rules that read single expressions, types and definitions. Each is a plain function and, by ``as_udf``, an Arrow UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPEN, _CLOSE = "(<[{", ")>]}"


def split_top(text: str, seps: tuple[str, ...]) -> list[str]:
    """Cut where a separator lies outside brackets and quotes; longer separators win."""
    out, depth, at, k, quote = [], 0, 0, 0, ""
    seps = tuple(sorted(seps, key=len, reverse=True))
    while k < len(text):
        c = text[k]
        if quote:
            k += 2 if c == "\\" else 1
            if c == quote:
                quote = ""
            continue
        hit = next((s for s in seps if depth == 0 and text.startswith(s, k)), None)
        if hit:
            out.append(text[at:k])
            k += len(hit)
            at = k
            continue
        if c in "\"'":
            quote = c
        elif c in _OPEN:
            depth += 1
        elif c in _CLOSE and text[k - 1 : k] not in ("-", "="):
            depth = max(0, depth - 1)
        k += 1
    out.append(text[at:])
    return [p.strip() for p in out]


_NUMBER = re.compile(r"\s*([0-9]+):[ \t]?")


def _numbered(line: str, otherwise: int) -> tuple[int, str]:
    """Number and rest of a numbered line."""
    m = _NUMBER.match(line)
    return (int(m[1]), line[m.end() :]) if m else (otherwise, line)


def base_class_name(name: str) -> dict:
    """Namespaces, base name and type arguments of a class name such as ``a::b::C<D, E<F>>``."""
    name = name.strip()
    head, args = name, []
    at = min((k for k in (name.find("<"), name.find("[")) if k >= 0), default=-1)
    if at >= 0 and name[-1] in ">]":
        head, inner = name[:at], name[at + 1 : -1]
        args = [a for a in split_top(inner, (",",)) if a]
    parts = [p for p in re.split(r"::|\.", head) if p]
    return {"namespaces": parts[:-1], "base_class_name": parts[-1] if parts else "", "type_arguments": args}


def call_name(call: str) -> dict:
    """Base name and type arguments of what is called."""
    chain = split_top(call.strip(), ("->", ".", "::"))
    last = chain[-1] if chain else ""
    depth, cut = 0, len(last)
    for k, c in enumerate(last):
        if c == "<":
            depth += 1
        elif c == ">":
            depth -= 1
        elif c == "(" and depth == 0:
            cut = k
            break
    found = base_class_name(last[:cut]) if cut else {"base_class_name": "", "type_arguments": []}
    return {"base_name": found["base_class_name"], "type_arguments": found["type_arguments"]}


_DEF = re.compile(r"^\s*(?:@\w[^\n]*\n\s*)*(?:async\s+)?(?:def|function|modifier|func|fn)\s+([\w$]+)|((?:\w+::)*operator\s*(?:\(\)|\[\]|[^\s\w(]+|\w+)|[~\w$]+(?:::[~\w$]+)*)\s*\(", re.S)


def definition_name(definition: str) -> str | None:
    """Name of the function that a definition defines."""
    code = re.sub(r"^\s*\d+:\s?", "", definition, flags=re.M)
    code = re.sub(r"template\s*<[^{;]*?>\s*(?=[\w~])", "", code)
    m = _DEF.search(code)
    return None if not m else (m.group(1) or m.group(2)).split("::")[-1]


def template_parameters(definition: str) -> list[str]:
    """Parameters of a template, a generic class, or ``Generic[...]``."""
    m = re.search(r"template\s*<(.*?)>\s*(?:class|struct|[\w:~&*<>, ]+\()", definition, re.S) or re.search(r"(?:class|interface|struct)\s+\w+\s*<([^{]*?)>\s*(?:extends|implements|\{|$)", definition, re.S) or re.search(r"Generic\s*\[([^\]]*)\]", definition) or re.search(r"^\s*(?:\w+\s+)*<([^>(]*)>\s*[\w<>\[\]]+\s+\w+\s*\(", definition, re.S)
    if not m:
        return []
    out = []
    for p in split_top(m.group(1), (",",)):
        p = re.sub(r"=.*", "", p).strip()
        words = re.findall(r"\w+", re.sub(r"\b(extends|super|implements)\b.*", "", p))
        words = [w for w in words if w not in ("typename", "class", "const")]
        if words:
            out.append(words[-1])
    return out


def substitute(type_: str, arguments: dict[str, str]) -> str:
    """Type parameters replaced by their arguments, all at once."""
    if not arguments:
        return type_
    return re.sub(r"\b(" + "|".join(map(re.escape, sorted(arguments, key=len, reverse=True))) + r")\b", lambda m: arguments[m.group(1)], type_)


def type_parameters(type_: str, known: list[str] | None = None) -> list[str]:
    """Identifiers of a type that are type parameters: those known, else single capitals with or without a digit."""
    names = dict.fromkeys(re.findall(r"[^\W\d]\w*", type_))
    return [n for n in names if (n in known if known else re.fullmatch(r"[A-Z]\d?", n))]


_MAPS = ("map", "unordered_map", "hashmap", "treemap", "dict", "mapping", "linkedhashmap", "concurrenthashmap", "defaultdict", "ordereddict", "multimap")


def element_type(compound: str) -> str | None:
    """Type of what indexing gives: the value of a map, the item of a list, the target of an array or a pointer."""
    t = re.sub(r"^(?:const|static|constexpr|volatile)\s+", "", compound.strip()).rstrip("&").strip()
    if m := re.fullmatch(r"mapping\s*\((.*?)=>(.*)\)", t):
        return m.group(2).strip()
    if t.endswith("]") and re.search(r"\[\d*\]$", t):
        return re.sub(r"\[\d*\]$", "", t).strip()
    if t.endswith("*"):
        return t[:-1].strip()
    found = base_class_name(t)
    args = found["type_arguments"]
    if found["base_class_name"].lower() in _MAPS:
        return args[1] if len(args) > 1 else None
    if found["base_class_name"].lower() in ("string", "str"):
        return "char" if found["base_class_name"] != "str" else "str"
    return args[0] if args else None


def chain_components(expr: str) -> list[dict]:
    """Components of a chained expression, with their kind and the operator before them."""
    out, op = [], ""
    for part in re.split(r"(->|::|\.)(?![^(]*\))", expr.strip()):
        if part in ("->", "::", "."):
            op = part
        elif part.strip():
            out.append({"component": part.strip(), "type": "function_call" if part.strip().endswith(")") else "scope", "operator": op})
    return out


def parse_chain(expr: str, language: str) -> list[dict] | None:
    """(name, type) of the components of a chained expression, by the rules of its language; None for a language without rules.

    C and C++: what stands before ``::`` is a namespace or class, what follows is called or accessed as a member.
    Languages with dots: a call, or a scope.
    """
    name = lambda p: re.split(r"[(\[]", p, maxsplit=1)[0].strip()
    if language in ("c", "cpp"):
        *scopes, rest = split_top(expr.strip(), ("::",))
        parts = [p for p in split_top(rest.replace("->", "\x01"), ("\x01", ".")) if p]
        return [{"name": s, "type": "namespace_or_class"} for s in scopes if s] + [{"name": name(p), "type": "function_call" if "(" in p else "member_access"} for p in parts]
    if language in ("python", "java", "solidity"):
        return [{"name": name(p), "type": "function_call" if "(" in p else "scope"} for p in split_top(expr.strip(), (".",)) if p]
    return None


def is_chained(expr: str) -> bool:
    """Two or more member operators outside brackets, or one after a call."""
    parts = split_top(expr, ("->", "."))
    return len(parts) > 2 or (len(parts) == 2 and parts[0].endswith(")"))


_LITERAL = re.compile(r"^(?:[\"'].*[\"']|[+-]?\d[\w.]*|true|false|True|False|null|None|nullptr)$", re.S)


def segments(expr: str) -> list[dict]:
    """Operands of an expression: literals, identifiers, and function calls, which end with a parenthesis."""
    out = []
    arrow = "\x01"  # not a minus
    for part in split_top(expr.replace("->", arrow), ("&&", "||", "==", "!=", "<=", ">=", "<<", ">>", " and ", " or ", "+", "-", "*", "/", "%", " < ", " > ", "?", " : ")):
        part = part.replace(arrow, "->").strip().lstrip("!").strip()
        while part.startswith("(") and part.endswith(")") and split_top(part[1:-1], (")",)) == [part[1:-1].strip()]:
            inner = segments(part[1:-1])
            out += inner
            part = ""
        if part:
            out.append({"text": part, "kind": "literal" if _LITERAL.match(part) else "function_call" if part.endswith(")") else "identifier"})
    return out


def latest_assignment(context: str, variable: str) -> dict | None:
    """The last right-hand side that the variable is given, and its line."""
    found = None
    for n, line in enumerate(context.split("\n")):
        number, code = _numbered(line, n)
        hit = re.search(rf"(?<![\w.])\*?{re.escape(variable)}\s*(?::[^=]+)?=(?!=)\s*(.+?)\s*;?\s*$", code)
        if hit:
            found = {"expression": hit.group(1), "line": number}
    return found


_SCORES = {
    "python": (r"\bdef \w+\(", r"^\s*import \w+", r":\s*$", r"\bself\b", r"\belif\b", r"\bNone\b"),
    "java": (r"\bpublic (static|class|void|final)\b", r"\bSystem\.out", r"\bimport java", r"\bextends\b", r"@Override", r"\bnew \w+<?"),
    "cpp": (r"#include", r"\bstd::", r"->", r"\btemplate\s*<", r"::", r"\bnullptr\b"),
    "solidity": (r"pragma solidity", r"\bcontract \w+", r"\buint256\b", r"\bmapping\s*\(", r"\bpayable\b", r"\bmsg\.sender\b"),
    "xml": (r"<\?xml", r"</\w+>", r"<mapper", r"xmlns"),
    "javascript": (r"\bfunction\b", r"\bconst \w+ =", r"=>", r"\bconsole\.log", r"\bvar \w+", r"\blet \w+"),
}


def detect_language(snippet: str) -> dict:
    """The language with most of its marks, and how sure that is."""
    score = {k: sum(bool(re.search(p, snippet, re.M)) for p in ps) for k, ps in _SCORES.items()}
    best = max(score, key=lambda k: score[k])
    top = score[best]
    if not snippet.strip() or not top:
        return dict.fromkeys(("language",), "unknown") | {"confidence": "low"}
    return {"language": best, "confidence": "high" if top > 2 else "medium" if top == 2 else "low"}


def class_body(code: str, name: str) -> str | None:
    """Source of the class of that name: to the brace that closes it, or by indentation."""
    m = re.search(rf"^[^\S\n]*(?:template\s*<[^\n]*>\s*)?(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|struct|interface|contract|library)\s+{re.escape(name)}\b", code, re.M)
    if not m:
        return None
    brace, stop = code.find("{", m.end()), code.find(":", m.end())
    if brace < 0 or (0 <= stop < brace and code[stop : stop + 2] == ":\n"):
        indent = len(m.group()) - len(m.group().lstrip())
        lines = code[m.start() :].split("\n")
        end = next((k for k in range(1, len(lines)) if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) <= indent), len(lines))
        return "\n".join(lines[:end]).rstrip()
    depth = 0
    for k in range(brace, len(code)):
        depth += (code[k] == "{") - (code[k] == "}")
        if depth == 0:
            return code[m.start() : k + 1]
    return None


def member_variables(class_def: str) -> list[dict]:
    """Fields of a class of the brace languages: name, type, access, default, static and const."""
    body = class_def[class_def.find("{") + 1 : class_def.rfind("}")]
    access = "private" if re.search(r"\bclass\b", class_def.split("{")[0]) else "public"
    out = []
    body = re.sub(r"\{[^{}]*\}", ";", re.sub(r"\{[^{}]*\}", ";", body))
    for part in re.split(r";", re.sub(r"\b(public|private|protected)\s*:", r"\1:;", body)):
        part = part.strip()
        if m := re.fullmatch(r"(public|private|protected):", part):
            access = m.group(1)
            continue
        m = re.fullmatch(r"((?:(?:public|private|protected|internal|static|const|final|constexpr|mutable|volatile|immutable|constant)\s+)*)([\w:]+(?:<.*>)?(?:\s*\([^)]*\))?[\s&*\[\]]*?)((?:\s+(?:public|private|internal|constant|immutable))*)\s+\**([\w]+)\s*(?:=\s*(.+))?", part, re.S)
        if not m or m.group(2).strip() in ("return", "using", "typedef", "event", "import", "emit"):
            continue
        words = (m.group(1) + " " + m.group(3)).split()
        own = next((w for w in words if w in ("public", "private", "protected", "internal")), access)
        out.append({"name": m.group(4), "type": m.group(2).strip(), "access": own, "default_value": m.group(5), "is_static": "static" in words, "is_const": bool({"const", "final", "constexpr", "immutable", "constant"} & {*words})})
    return out


_CALL = re.compile(r"((?:new\s+)?[~\w$]+(?:(?:->|::|\.)[~\w$]+)*(?:<[\w:, <>*&]*>)?)\s*\(")
_NOT_CALLS = frozenset("if for while switch catch return def function class elif with except and or not in sizeof modifier constructor lambda print_".split())


def call_expressions(body: str) -> list[dict]:
    """Calls in a body: the whole expression, and its line and 0-based column. ``n:`` prefixes give the lines."""
    out = []
    for n, line in enumerate(body.split("\n")):
        number, code = _numbered(line, n)
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", lambda q: q.group()[0] + "_" * (len(q.group()) - 2) + q.group()[0], re.sub(r"//.*$", "", code))
        for hit in _CALL.finditer(bare):
            name = hit.group(1)
            if name.split(" ")[0] in _NOT_CALLS or re.search(r"\b(def|function|func|fn|modifier|class)\s+$", bare[: hit.start()]):
                continue
            depth, end = 0, len(code)
            for k in range(hit.end() - 1, len(bare)):
                depth += (bare[k] == "(") - (bare[k] == ")")
                if depth == 0:
                    end = k + 1
                    break
            out.append({"call_expr": code[hit.start() : end], "line_number": number, "column_number": hit.start()})
    return out


def call_kind(call: str) -> dict:
    """What a call expression calls: its kind, the names it may be found under, its class and method."""
    expr = call.strip()
    bare = expr.split("(")[0].strip()
    found = call_name(expr)
    name, args = found["base_name"], found["type_arguments"]
    owner = ""
    if bare.startswith("new "):
        kind, owner, name = "constructor", base_class_name(bare[4:])["base_class_name"], base_class_name(bare[4:])["base_class_name"]
    elif name.startswith("~"):
        kind, owner = "destructor", name[1:]
    elif "->" in bare or "." in bare:
        kind = "member_method"
    elif "::" in bare:
        owner = bare.split("::")[-2].strip()
        kind = "constructor" if owner == name else "static_method"
    elif args:
        kind = "template_function"
    elif name.startswith("operator"):
        kind = "call_operator"
    elif name[:1].isupper():
        kind, owner = "constructor", name
    else:
        kind = "function"
    qualified = [bare.replace("->", "::").replace(".", "::")] if owner and kind != "constructor" else []
    return {"call_type": kind, "method_name": name, "class_name": owner, "qualified_names": [*qualified, name], "search_terms": [f"[FUNCDEF]{name}"], "template_arguments": args, "needs_class_definition": kind in ("member_method", "constructor", "destructor")}


def declared_type(context: str, variable: str) -> str | None:
    """Type that the context declares the variable with, or that its last literal or construction has."""
    v = re.escape(variable)
    found = None
    for m in re.finditer(rf"(?:^|[;{{(,\n])\s*(?:\d+:\s*)?((?:const\s+|static\s+|final\s+)*[A-Za-z_][\w:]*(?:<[^;()=]*>)?(?:\s*\[\])*[\s*&]+){v}\s*(?=[=;,)\[{{:])", context):
        t = m.group(1).strip()
        if t not in ("return", "new", "delete", "else", "in", "auto", "var", "let", "const"):
            found = t
    if m := re.search(rf"\b{v}\s*:\s*([\w.\[\], |]+?)\s*(?==|,|\)|$)", context, re.M):
        found = found or m.group(1)
    if found is None and (last := latest_assignment(context, variable)):
        expr = last["expression"]
        if m := re.match(r"(?:new\s+)?([A-Z]\w*(?:<[^()]*>)?)\s*\(", expr):
            found = m.group(1)
        elif _LITERAL.match(expr):
            found = "string" if expr[0] in "\"'" else "boolean" if expr.lower() in ("true", "false") else "float" if re.fullmatch(r"[+-]?\d*\.\d*", expr) else "integer" if expr[0].isdigit() or expr[0] in "+-" else None
    return found


def function_types(snippet: str) -> dict:
    """Parameter and return types in a function's header."""
    code = re.sub(r"^\s*\d+:\s?", "", snippet, flags=re.M).strip()
    at = code.find("(")
    if at < 0:
        return {"parameter_types": [], "return_types": []}
    depth, end = 0, len(code)
    for k in range(at, len(code)):
        depth += (code[k] == "(") - (code[k] == ")")
        if depth == 0:
            end = k
            break
    params = [p for p in split_top(code[at + 1 : end], (",",)) if p]
    head, rest = code[:at].strip(), code[end + 1 :]
    if re.match(r"(async\s+)?def\b", head):
        types = [p.split(":", 1)[1].split("=")[0].strip() if ":" in p else "" for p in params if p not in ("self", "cls", "*", "/")]
        ret = re.match(r"\s*->\s*([^:]+(?:\[[^\]]*\])?)\s*:", rest)
        return {"parameter_types": types, "return_types": [ret.group(1).strip()] if ret else []}
    if head.startswith("function"):
        types = [p.split()[0] for p in params]
        ret = re.search(r"returns\s*\(([^)]*)\)", rest)
        return {"parameter_types": types, "return_types": [r.split()[0] for r in split_top(ret.group(1), (",",)) if r] if ret else []}
    types = [re.sub(r"\s*=.*", "", p) for p in params]
    types = [re.sub(r"(?<=[\s*&>])\w+$", "", t).strip() if re.search(r"[\s*&>]\w+$", t) else t for t in types]
    words = re.sub(r"^(?:(?:public|private|protected|static|final|virtual|inline|constexpr|explicit|abstract|synchronized|override|extern)\s+)*", "", re.sub(r"^template\s*<[^{]*?>\s*", "", head))
    ret = re.sub(r"[~\w:]+$", "", words).strip()
    after = re.match(r"\s*(?:const\s*)?(?:noexcept\s*)?->\s*([\w:<>*& ,]+?)\s*[{;]", rest)
    return {"parameter_types": types, "return_types": [after.group(1)] if after else [ret] if ret else []}


def member_functions(class_def: str) -> list[dict]:
    """Functions in a class of the brace languages: name, definition, kind, and whether it has a body."""
    at = class_def.find("{")
    own = re.search(r"(?:class|struct|contract|interface|library)\s+(\w+)", class_def[: at + 1])
    out, k, begin, depth = [], at + 1, at + 1, 0
    while k < len(class_def):
        c = class_def[k]
        if depth == 0 and c in "{;":
            part = class_def[begin:k]
            end = k
            if c == "{":
                level = 0
                for end in range(k, len(class_def)):
                    level += (class_def[end] == "{") - (class_def[end] == "}")
                    if level == 0:
                        break
            head = re.sub(r"^\s*(public|private|protected)\s*:\s*", "", part).strip()
            name = definition_name(head + "{") if "(" in head and "=" not in head.split("(")[0].replace("operator=", "").replace("operator==", "") else None
            if name:
                kind = "destructor" if name.startswith("~") else "constructor" if (own and name == own.group(1)) or head.startswith("constructor") else "operator" if name.startswith("operator") else "static_method" if re.search(r"\bstatic\b", head.split("(")[0]) else "method"
                out.append({"name": name, "definition": (head + (" " if c == "{" else "") + class_def[k : end + 1]).strip(), "kind": kind, "is_complete": c == "{"})
            k = end
            begin = k + 1
        k += 1
    return out


_STRINGS = T.ArrayType(T.StringType())
RULES = {
    "base_class_name": (base_class_name, T.StructType([T.StructField("namespaces", _STRINGS), T.StructField("base_class_name", T.StringType()), T.StructField("type_arguments", _STRINGS)])),
    "call_name": (call_name, T.StructType([T.StructField("base_name", T.StringType()), T.StructField("type_arguments", _STRINGS)])),
    "definition_name": (definition_name, T.StringType()),
    "template_parameters": (template_parameters, _STRINGS),
    "type_parameters": (type_parameters, _STRINGS),
    "element_type": (element_type, T.StringType()),
    "segments": (segments, T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("kind", T.StringType())]))),
    "chain_components": (chain_components, T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("component", "type", "operator")]))),
    "is_chained": (is_chained, T.BooleanType()),
    "call_expressions": (call_expressions, T.ArrayType(T.StructType([T.StructField("call_expr", T.StringType()), T.StructField("line_number", T.IntegerType()), T.StructField("column_number", T.IntegerType())]))),
    "call_kind": (call_kind, T.StructType([T.StructField("call_type", T.StringType()), T.StructField("method_name", T.StringType()), T.StructField("class_name", T.StringType()), T.StructField("qualified_names", _STRINGS), T.StructField("search_terms", _STRINGS), T.StructField("template_arguments", _STRINGS), T.StructField("needs_class_definition", T.BooleanType())])),
    "function_types": (function_types, T.StructType([T.StructField("parameter_types", _STRINGS), T.StructField("return_types", _STRINGS)])),
    "detect_language": (detect_language, T.StructType([T.StructField("language", T.StringType()), T.StructField("confidence", T.StringType())])),
}


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])))
def parsed_chain(expr: pd.Series, language: pd.Series) -> pd.Series:
    """``parse_chain`` of two columns; null in either gives null."""
    return pd.Series([None if e is None or lang is None else parse_chain(e, lang) for e, lang in zip(expr, language)], dtype=object)


def as_udf(name: str):
    """The rule as a UDF of one string column; null gives null."""
    rule, kind = RULES[name]
    if isinstance(kind, T.StructType):

        @F.pandas_udf(kind)
        def udf(col: pd.Series) -> pd.DataFrame:
            rows = [rule(x) if x is not None else {} for x in col]
            return pd.DataFrame({f.name: [r.get(f.name) for r in rows] for f in kind.fields})

    else:

        @F.pandas_udf(kind)
        def udf(col: pd.Series) -> pd.Series:
            return pd.Series([rule(x) if x is not None else None for x in col])

    return udf
