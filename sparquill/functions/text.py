"""Scalar functions over code and prose, as Column expressions: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}_]+"
NUMBERED = "^[ \\t]*[0-9]+:[ \\t]?"

LANGUAGES = {
    lang: exts.split()
    for lang, exts in {
        "python": "py pyi",
        "javascript": "js jsx",
        "typescript": "ts tsx",
        "java": "java",
        "c": "c h",
        "cpp": "cpp hpp cc cxx",
        "go": "go",
        "rust": "rs",
        "html": "html",
        "css": "css",
        "php": "php",
        "swift": "swift",
        "csharp": "cs",
        "solidity": "sol",
        "ocaml": "ml mli",
        "haskell": "hs lhs",
        "fsharp": "fs fsi fsx",
        "erlang": "erl hrl",
        "elixir": "ex exs",
        "clojure": "clj cljs cljc",
        "scheme": "scm ss",
        "lisp": "lisp lsp",
        "elm": "elm",
        "ruby": "rb",
        "perl": "pl pm",
        "scala": "scala sc",
        "kotlin": "kt kts",
        "dart": "dart",
        "lua": "lua",
        "r": "r",
        "objectivec": "m",
        "julia": "jl",
        "nim": "nim",
        "crystal": "cr",
        "zig": "zig",
        "vlang": "v",
        "systemverilog": "sv",
        "vhdl": "vhd vhdl",
        "assembly": "s asm",
        "shell": "sh bash zsh fish ps1 psm1 bat cmd",
        "ini": "toml ini cfg conf xaml proto graphql gql sql",
        "makefile": "mk cmake gradle sbt bazel bzl",
        "documentation": "md markdown mdown mkd mkdn rst txt json jsonl yaml yml xml",
    }.items()
}
LANGUAGES["scheme"] += LANGUAGES.pop("lisp")
NOT_CODE = tuple("documentation ini makefile shell unknown".split())


def programming_language(ext: Column) -> Column:
    """Language of an extension such as ``.py``, whatever its case; ``unknown`` when not listed."""
    pairs = [F.lit(x) for lang, exts in LANGUAGES.items() for e in exts for x in ("." + e, lang)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(ext)), F.lit("unknown"))


def file_extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1)


def is_code(language: Column) -> Column:
    return ~language.isin(*NOT_CODE)


def is_implementation(path: Column) -> Column:
    return ~(path.startswith("test_") | path.startswith("app_") | path.startswith("build")) & ~F.lower(path).contains("test")


def words(text: Column) -> Column:
    """All Unicode words, as they are written."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def ascii_words(text: Column) -> Column:
    """Words of ASCII letters, digits and underscores alone that touch no other letter."""
    return F.filter(words(text), lambda w: w.rlike("^[A-Za-z0-9_]+$"))


def number_lines(text: Column, start: Column) -> Column:
    """``n: line`` for every line that isn't empty; empty lines stay."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x, i: F.when(F.length(x) > 0, F.concat((start + i).cast("string"), F.lit(": "), x)).otherwise("")), "\n")


def line_and_column(text: Column, offset: Column) -> Column:
    """(line, column) of a byte offset, both from 0, the column in bytes."""
    before = F.substring(F.encode(text, "utf-8"), F.lit(1), offset).cast("string")
    line = F.octet_length(before) - F.octet_length(F.replace(before, F.lit("\n"), F.lit("")))
    return F.struct(line.cast("int").alias("line"), F.octet_length(F.substring_index(before, "\n", -1)).alias("col"))


def char_start(text: Column, at: Column) -> Column:
    """``safe_cut`` as a column: the greatest byte offset up to ``at`` that doesn't cut a character of the text."""
    raw = F.encode(text, "utf-8")
    place = F.greatest(F.least(at, F.octet_length(text)), F.lit(0)).cast("int")
    inside = lambda k: F.hex(F.substring(raw, place - k + 1, F.lit(1))).rlike("^[89AB]")
    back = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    return F.when(place >= F.octet_length(text), place).otherwise(place - back)


def safe_cut(data: bytes, at: int) -> int:
    """The greatest offset up to ``at`` that doesn't cut a UTF-8 character."""
    at = max(0, min(at, len(data)))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def cache_name(path: str, dual: bool = False, dynamic: bool = False, query_driven: bool = False, model: str = "") -> str:
    """File name of an index of the path with these options."""
    marks = [m for m, on in (("dual-vector", dual), ("dynamic-splitter", dynamic), ("query-driven", query_driven), (model, bool(model))) if on]
    return "-".join([path.strip().rstrip("/"), *marks]).replace("/", "#")


def has_line_numbers(text: Column) -> Column:
    return F.forall(F.split(text, "\n", -1), lambda x: (F.trim(x) == "") | x.rlike(NUMBERED))


def strip_line_numbers(text: Column) -> Column:
    """Without the prefixes, if every line that isn't blank has one."""
    bare = F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, NUMBERED, "")), "\n")
    return F.when(has_line_numbers(text), bare).otherwise(text)


def locate_line(text: Column, element: Column) -> Column:
    """(number, line) of the first numbered line that has the element; null when none has."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.regexp_extract(x, r"^\s*(\d+):", 1).try_cast("int").alias("number"), F.regexp_replace(x, NUMBERED, "").alias("line")))
    found = F.filter(lines, lambda s: (F.instr(s["line"], element) > 0) & s["number"].isNotNull())
    return F.when(F.length(element) > 0, F.get(found, F.lit(0)))


def column_of(line: Column, element: Column) -> Column:
    """0-based column of the element in the line, -1 when it isn't there."""
    return F.instr(line, element) - 1


def definition_hash(definition: Column) -> Column:
    return F.md5(definition)


def clean_type(name: Column) -> Column:
    """Without leading qualifiers and trailing references and pointers."""
    bare = F.regexp_replace(F.trim(name), r"^(?:(?:const|static|constexpr|volatile|final)\s+)+", "")
    return F.trim(F.regexp_replace(bare, r"[\s&*?]+$", ""))


def callee_name(call: Column) -> Column:
    """The last name before the parenthesis: ``a.b->c::d(x)`` gives ``d``."""
    return F.trim(F.regexp_extract(F.element_at(F.split(call, r"\("), 1), r"([^.>:]+)$", 1))


def dot_chain(expr: Column) -> Column:
    """Components of a chained expression of a language with dots: (name, type)."""
    return F.transform(F.split(expr, r"\."), lambda p: F.struct(F.element_at(F.split(p, r"\("), 1).alias("name"), F.when(F.instr(p, "(") > 0, "function_call").otherwise("scope").alias("type")))


def type_arguments(params: Column, args: Column) -> Column:
    """Map of type parameters to the arguments they stand for; what has no partner is left out."""
    n = F.least(F.size(params), F.size(args))
    return F.map_from_arrays(F.slice(params, 1, n), F.slice(args, 1, n))


def parameters_of(params: Column, args: Column) -> Column:
    """Map of arguments to the type parameters that they stand for, the first of each; the inverse of ``type_arguments``."""
    n = F.least(F.size(params), F.size(args))
    pairs = F.arrays_zip(F.slice(args, 1, n).alias("arg"), F.slice(params, 1, n).alias("param"))
    first = F.filter(pairs, lambda p, i: F.array_position(F.slice(args, 1, n), p["arg"]) == i + 1)
    return F.map_from_entries(first)


def complete_only(definitions: Column, flags: Column) -> Column:
    """The definitions whose flag is ``yes``, in their order."""
    return F.transform(F.filter(F.arrays_zip(definitions.alias("d"), flags.alias("f")), lambda x: F.lower(x["f"]) == "yes"), lambda x: x["d"])


def query_tokens(query: Column) -> Column:
    return F.split(query, r"\[TOKEN_SPLIT\]")


def untagged(token: Column) -> Column:
    """A typed token without its ``[TAG]``."""
    return F.regexp_replace(token, r"^[^\]]*\]", "")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def literal_type(text: Column) -> Column:
    """Type of a literal: string, integer, float, boolean, null or unknown."""
    t = F.trim(text)
    return (
        F.when(t.rlike("^(?s)([\"'`]).*\\1$"), "string")
        .when(t.rlike(r"^[+-]?(0[xX][0-9a-fA-F]+|0[bB][01]+|\d+)[uUlL]*$"), "integer")
        .when(t.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+(?=[eE]))([eE][+-]?\d+)?[fFdD]?$"), "float")
        .when(F.lower(t).isin("true", "false"), "boolean")
        .when(t.isin("null", "None", "nullptr", "NULL", "nil"), "null")
        .otherwise("unknown")
    )


CODE_EXTENSIONS = (".py", ".java", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".xml", ".sol")
TEXT_EXTENSIONS = (".txt",)


def document_type(ext: Column) -> Column:
    return F.when(F.lower(ext).isin(*CODE_EXTENSIONS), "code").when(F.lower(ext).isin(*TEXT_EXTENSIONS), "text").otherwise("unknown")


#: Marks of each kind of content, longest first; a kind's score is how many of its marks occur in the lower-case text.
MARKS = {
    "yaml": tuple('environment:¦metadata:¦networks:¦services:¦version:¦volumes:¦build:¦image:¦ports:¦data:¦kind:¦spec:¦---¦...¦- ¦: ¦&¦*¦>¦|'.split("¦")),
    "rst": tuple('.. autofunction::¦.. automodule::¦.. code-block::¦.. autoclass::¦.. toctree::¦.. warning::¦.. image::¦.. note::¦----¦====¦^^^^¦~~~~¦.. ¦:::¦::'.split("¦")),
    "json": tuple('"value":¦"data":¦"name":¦"type":¦"id":¦false¦null¦true¦",¦":¦[¦]¦{¦}'.split("¦")),
    "markdown": tuple('###### ¦##### ¦#### ¦- [ ]¦- [x]¦### ¦## ¦***¦---¦```¦~~~¦# ¦**¦> ¦](¦__¦| ¦*¦[¦_'.split("¦")),
    "code": tuple('public class¦namespace ¦protected ¦function ¦#include¦package ¦private ¦import ¦class ¦const ¦trait ¦<?php¦from ¦func ¦impl ¦def ¦let ¦var ¦#!/¦fn ¦->¦::¦;\n¦<%¦=>¦{¦}'.split("¦")),
    "text": tuple('https://¦http://¦### ¦## ¦1. ¦2. ¦3. ¦# ¦* ¦**¦- ¦](¦__¦*¦[¦_'.split("¦")),
}


def content_type(text: Column) -> Column:
    """The kind with the most marks; of equals the first named; ``unknown`` without any, or where all is blank.

    Braces beyond one in a hundred characters, or semicolons beyond two, count as two marks of code.
    """
    low = F.lower(text)
    count = lambda *marks: sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in marks), F.lit(0))
    score = {k: sum(((low.contains(m)).cast("int") for m in marks), F.lit(0)) for k, marks in MARKS.items()}
    score["code"] = score["code"] + 2 * ((count("{", "}") > F.length(text) * 0.01) | (count(";") > F.length(text) * 0.02)).cast("int")
    most = F.greatest(*score.values())
    out = F.when((F.trim(F.regexp_replace(text, r"\s", "")) == "") | (most == 0), "unknown")
    for k, s in score.items():
        out = out.when(s == most, k)
    return out


def min_max(score: Column, over) -> Column:
    """Scaled to [0, 1] within the window; a list of one is 1."""
    low, high, n = F.min(score).over(over), F.max(score).over(over), F.count(score).over(over)
    return F.when(n <= 1, F.lit(1.0)).otherwise((score - low) / (high - low + F.lit(1e-12)))


def z_score(score: Column, over) -> Column:
    return (score - F.avg(score).over(over)) / (F.stddev_pop(score).over(over) + F.lit(1e-12))
