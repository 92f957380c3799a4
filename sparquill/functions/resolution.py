"""Following a chained call through variables, classes and functions to what it calls and what that gives."""

from __future__ import annotations

import re

from . import analysis as A

#: What members of well-known containers give, by base name in lower case; ``{0}`` is the first type argument.
MEMBERS = {
    "vector": {"size": "size_t", "at": "{0}", "front": "{0}", "back": "{0}", "empty": "bool"},
    "list": {"get": "{0}", "size": "int", "isempty": "boolean", "index": "int"},
    "arraylist": {"get": "{0}", "size": "int", "isempty": "boolean"},
    "map": {"at": "{1}", "get": "{1}", "size": "size_t", "keyset": "Set<{0}>"},
    "hashmap": {"get": "{1}", "size": "int", "keyset": "Set<{0}>", "values": "Collection<{1}>"},
    "dict": {"get": "{1}", "keys": "list[{0}]", "values": "list[{1}]"},
    "string": {"length": "int", "size": "size_t", "substr": "string", "substring": "String", "c_str": "const char*"},
    "str": {"split": "list[str]", "upper": "str", "lower": "str", "join": "str", "strip": "str"},
    "unique_ptr": {"get": "{0}*"}, "shared_ptr": {"get": "{0}*"}, "optional": {"value": "{0}", "get": "{0}"},
}
_SMART = ("unique_ptr", "shared_ptr", "weak_ptr")


def header_names(header: str) -> dict:
    """Full and short name of the function that a header declares, without template arguments."""
    m = re.search(r"([~\w$]+(?:<[^()]*?>)?(?:(?:::|\.)[~\w$]+(?:<[^()]*?>)?)*|operator\s*[^\s(]+)\s*\(", header)
    full = re.sub(r"<[^()]*>", "", m.group(1)).strip() if m else ""
    return {"full_name": full, "short_name": re.split(r"::|\.", full)[-1]}


def constructor(class_def: str, name: str) -> str | None:
    """Definition of the constructor, the one with a body first."""
    own = sorted((f for f in A.member_functions(class_def) if f["name"] == name or f["kind"] == "constructor"), key=lambda f: not f["is_complete"])
    return own[0]["definition"] if own else None


def call_operator(class_def: str) -> str | None:
    """Definition of what calling an instance runs."""
    m = re.search(r"^([ \t]*)def\s+__call__\b", class_def, re.M)
    if m:
        lines = class_def[m.start() :].split("\n")
        end = next((k for k in range(1, len(lines)) if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) <= len(m.group(1))), len(lines))
        return "\n".join(lines[:end]).strip()
    return next((f["definition"] for f in A.member_functions(class_def) if f["name"].replace(" ", "").startswith("operator(")), None)


def nearest_definition(definitions: list[dict], line: int | None) -> dict | None:
    """Of definitions with a ``line``, the nearest to the one asked for; the first without one."""
    if not definitions:
        return None
    return definitions[0] if line is None else min(definitions, key=lambda d: abs(d["line"] - line))


def locate(numbered: str, element: str) -> tuple[int, str] | None:
    """(number, element as written) of the first numbered line that has the element, white space aside."""
    want = "".join(element.split())
    if not want:
        return None
    for n, line in enumerate(numbered.split("\n")):
        number, code = A._numbered(line, n)
        squeezed, at = "", []
        for k, c in enumerate(code):
            if not c.isspace():
                squeezed += c
                at.append(k)
        k = squeezed.find(want)
        if k >= 0:
            return number, code[at[k] : at[k + len(want) - 1] + 1]
    return None


def _bare(type_: str) -> dict:
    t = re.sub(r"\b(const|static|constexpr|volatile|final|mutable)\b", "", type_).strip(" &*")
    found = A.base_class_name(t)
    if found["base_class_name"] in _SMART and found["type_arguments"]:
        return _bare(found["type_arguments"][0])
    return found


def _member(owner: str, name: str, called: bool, classes: dict[str, str]) -> dict | None:
    """(type, definition) of a member of a value of type ``owner``."""
    base = _bare(owner)
    body = classes.get(base["base_class_name"])
    if body is None:
        found = MEMBERS.get(base["base_class_name"].lower(), {}).get(name.lower())
        args = base["type_arguments"]
        if found is None or any(f"{{{k}}}" in found and k >= len(args) for k in (0, 1)):
            return None
        return {"type": found.format(*args), "definition": None}
    swap = dict(zip(A.template_parameters(body), base["type_arguments"]))
    if called:
        for f in A.member_functions(body):
            if f["name"] == name:
                given = A.function_types(f["definition"])["return_types"]
                return {"type": A.substitute(given[0], swap) if given else None, "definition": f["definition"]}
    for v in A.member_variables(body):
        if v["name"] == name:
            return {"type": A.substitute(v["type"], swap), "definition": None}
    return None


def callee_info(expr: str, variables: dict[str, str], classes: dict[str, str], functions: dict[str, str]) -> dict | None:
    """Function that a chained call ends in: ``function_name``, ``return_type``, ``definition``.

    ``variables`` have types, ``classes`` and ``functions`` source. None when a component isn't known.
    """
    at: str | None = None
    definition = name = None
    parts = A.chain_components(expr)
    for k, part in enumerate(parts):
        text, called = part["component"], part["type"] == "function_call"
        name = text.split("(")[0].split("[")[0].strip()
        definition = None
        if k == 0 or at is None:
            bare = A.base_class_name(name)["base_class_name"]
            if called and bare in classes:
                at, definition = name, constructor(classes[bare], bare)
            elif called and bare in functions:
                definition = functions[bare]
                given = A.function_types(definition)["return_types"]
                at = given[0] if given else None
            elif name in variables:
                at = variables[name]
            elif bare in classes:
                at = name
            elif called or part is parts[-1]:
                return None
        else:
            found = _member(at, A.base_class_name(name)["base_class_name"], called, classes)
            if found is None:
                return None
            at, definition = found["type"], found["definition"]
        for _ in re.findall(r"\[[^\]]*\]", text.split("(")[0] if not called else text[text.rfind(")") :]):
            at = A.element_type(at) if at else None
    return {"function_name": name, "return_type": at, "definition": definition} if parts else None


def expression_type(expr: str, variables: dict[str, str], classes: dict[str, str], functions: dict[str, str]) -> str | None:
    """Type of an expression: boolean when it compares, else that of its operands, the widest number of them."""
    if re.search(r"==|!=|<=|>=|&&|\|\||\s[<>]\s|^\s*!", expr):
        return "boolean"
    kinds = []
    for s in A.segments(expr):
        if s["kind"] == "literal":
            t = s["text"]
            kinds.append("string" if t[0] in "\"'" else "boolean" if t.lower() in ("true", "false") else "float" if re.fullmatch(r"[+-]?\d*\.\d*(?:[eE].*)?[fFdD]?", t) else "null" if t in ("null", "None", "nullptr") else "integer")
        else:
            found = callee_info(s["text"], variables, classes, functions)
            kinds.append(found["return_type"] if found else None)
    for wide in ("string", "float", "double", "integer"):
        if wide in kinds and len(kinds) > 1:
            return wide
    return next((k for k in kinds if k), None)
