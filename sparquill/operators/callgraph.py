"""Call graphs: reachability, chains and their differences, by rounds of joins with an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Rounds, stored

#: Paths, at least, for each task that extends them.
CHAIN_ROWS = 1 << 18


def _edges(calls: DataFrame) -> DataFrame:
    """Each call once; a function that calls itself adds nothing to chains and reachability."""
    return stored(calls.where("caller IS NOT NULL AND callee IS NOT NULL AND caller <> callee").select("caller", "callee").distinct(), "edges")


def _starts(roots: DataFrame) -> DataFrame:
    return roots.where("root IS NOT NULL").select("root").distinct()


def chains(calls: DataFrame, roots: DataFrame, max_depth: int = 1000, places: DataFrame | None = None) -> DataFrame:
    """``(root, path, depth)`` of every chain from a root to a leaf, or to where it would enter a cycle.

    ``calls`` has ``(caller, callee)``, ``roots`` has ``root``. A callee that is on the path already isn't entered
    again. A chain of ``max_depth`` nodes ends there. Repeated calls and repeated roots count once. Chains of one node aren't
    chains. With ``places(name, file, line)``, each name once, there is ``located`` too: the chain as ``file,line->file,line``.

    Each round stores the paths that it extends by a call and those that have ended, so all simple paths are listed,
    however many: they can be exponentially many in dense graphs. ``counted``, ``tree`` and ``reachable`` don't list them.
    """
    spark = calls.sparkSession
    edges, start = _edges(calls), _starts(roots)
    kind = start.schema["root"].dataType
    live = start.select("root", F.array("root").alias("path"), F.col("root").alias("node"))
    if places is not None:
        shown = places.select(F.col("name"), F.concat_ws(",", F.coalesce("file", F.lit("?")), F.coalesce(F.col("line").cast("string"), F.lit("?"))).alias("shown"))
        place = lambda df, name: df.join(shown, F.col(name) == F.col("name"), "left").withColumn("shown", F.coalesce("shown", F.lit("?,?"))).drop("name")
        edges = stored(place(edges, "callee"), "edges")
        live = place(live, "root").withColumnRenamed("shown", "located")
    rounds = Rounds(spark, "chains")
    for depth in range(max_depth):
        whole = depth + 1 == max_depth
        if whole:
            step = live.withColumn("ended", F.lit(True))
        else:
            # a path without a call to enter meets none
            met = live.join(edges, (F.col("node") == F.col("caller")) & ~F.array_contains("path", F.col("callee").cast(kind)), "left")
            ended = F.col("callee").isNull()
            located = [] if places is None else [F.when(ended, F.col("located")).otherwise(F.concat("located", F.lit("->"), "shown")).alias("located")]
            step = met.select("root", F.when(ended, F.col("path")).otherwise(F.array_append("path", F.col("callee").cast(kind))).alias("path"), F.col("callee").cast(kind).alias("node"), *located, ended.alias("ended"))
        kept = rounds.add(step)
        live = kept.where("NOT ended").drop("ended")
        n = 0 if whole else live.count()
        if not n:
            break
        tasks = min(-(-n // CHAIN_ROWS), 4 * spark.sparkContext.defaultParallelism)
        if len(kept.inputFiles()) < tasks:
            live = live.repartition(tasks, "path")
    found = rounds.all().where("ended AND size(path) > 1")
    return found.select("root", "path", (F.size("path") - 1).alias("depth"), *([] if places is None else ["located"]))


def reachable(calls: DataFrame, roots: DataFrame, max_depth: int = 1000) -> DataFrame:
    """``(root, node, depth)``: all that a root calls, at its least depth, breadth first.

    Each round joins the newest nodes alone and is stored: the plan doesn't grow with the depth.
    """
    return _reached(_edges(calls), _starts(roots), max_depth)


def _reached(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    rounds = Rounds(edges.sparkSession, "reached")
    kind = start.schema["root"].dataType
    new = rounds.add(start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    for depth in range(1, max_depth):
        step = new.join(edges, F.col("node") == F.col("caller")).select("root", F.col("callee").cast(kind).alias("node")).distinct()
        new = rounds.add(step.join(rounds.all(), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
    return rounds.all()


def _apart(edges: DataFrame, start: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """The roots that reach no cycle, and the others.

    Calls of leaves are cut off, again and again; what is left after that reaches a cycle, or is deeper than ``max_depth``.
    """
    left, n = edges, edges.count()
    for _ in range(max_depth):
        if not n:
            break
        left = stored(left.join(left.select(F.col("caller").alias("callee")).distinct(), "callee", "left_semi"), "left")
        before, n = n, left.count()
        if n == before:
            break
    known = left.select(F.col("caller").alias("root")).distinct()
    return start.join(known, "root", "left_anti"), start.join(known, "root", "left_semi")


def counted(calls: DataFrame, roots: DataFrame, max_depth: int = 1000) -> DataFrame:
    """``chain_counts`` of all ``chains``: ``(root, n_chains, deepest)``.

    A root that reaches no cycle has no chain that is cut, so the ways to a node add up, a depth at a time, and no chain is
    listed; the others' chains are.
    """
    edges = _edges(calls)
    plain, others = _apart(edges, _starts(roots), max_depth)
    kind = plain.schema["root"].dataType
    rounds = Rounds(calls.sparkSession, "ways")
    live = plain.select("root", F.col("root").alias("node"), F.lit(1).cast("long").alias("ways"))
    for depth in range(max_depth):
        if depth + 1 == max_depth:
            met = live.select("root", F.lit(None).cast(kind).alias("node"), "ways")
        else:
            met = live.join(edges, F.col("node") == F.col("caller"), "left").select("root", F.col("callee").cast(kind).alias("node"), "ways")
        # the ways that end have no node
        live = rounds.add(met.groupBy("root", "node").agg(F.sum("ways").alias("ways"), F.lit(depth).alias("depth"))).where("node IS NOT NULL")
        if live.isEmpty():
            break
    found = rounds.all().where("node IS NULL AND depth > 0").groupBy("root").agg(F.sum("ways").alias("n_chains"), F.max("depth").alias("deepest"))
    return found if others.isEmpty() else found.unionByName(chain_counts(chains(calls, others, max_depth)))


def tree(calls: DataFrame, roots: DataFrame, max_depth: int = 1000) -> DataFrame:
    """``tree_edges`` of all ``chains``: ``(root, caller, callee)``.

    Where a root reaches no cycle these are the calls of all that it reaches; the chains of the others are listed.
    """
    edges = _edges(calls)
    plain, others = _apart(edges, _starts(roots), max_depth)
    kind = plain.schema["root"].dataType
    from_ = _reached(edges, plain, max_depth - 1).where(F.col("depth") < max_depth - 1)
    found = from_.join(edges, F.col("node") == F.col("caller")).select("root", F.col("caller").cast(kind).alias("caller"), F.col("callee").cast(kind).alias("callee"))
    return found if others.isEmpty() else found.unionByName(tree_edges(chains(calls, others, max_depth)))


def render(found: DataFrame, arrow: str = "->") -> DataFrame:
    """Add ``chain``, the path as text."""
    return found.withColumn("chain", F.array_join(F.transform("path", lambda x: x.cast("string")), arrow))


def chain_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("root").agg(F.count("*").alias("n_chains"), F.max("depth").alias("deepest"))


def differences(left: DataFrame, right: DataFrame, column: str = "chain") -> DataFrame:
    """``(side, chain)`` of the lines in one of two listings alone; blank lines and repetitions don't count."""
    a, b = (x.select(F.trim(column).alias("chain")).where("chain <> ''").distinct() for x in (left, right))
    return a.exceptAll(b).select(F.lit("left").alias("side"), "chain").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "chain"))


def enclosing(tokens: DataFrame, tag: str = "FUNCDEF") -> DataFrame:
    """Add ``enclosing``: the nearest earlier name with that tag in the same document."""
    from pyspark.sql import Window

    by = Window.partitionBy("doc_id").orderBy("line", "col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tokens.withColumn("enclosing", F.last(F.when(F.col("tag") == tag, F.col("name")), ignorenulls=True).over(by))


def function_headers(tokens: DataFrame) -> DataFrame:
    return tokens.where("tag = 'FUNCDEF'").select("name", "doc_id", "line")


def callers(tokens: DataFrame) -> DataFrame:
    """``(caller, callee, line)`` of every call inside a function."""
    inside = enclosing(tokens).where("tag = 'CALL' AND enclosing IS NOT NULL")
    return inside.select(F.col("enclosing").alias("caller"), F.col("name").alias("callee"), "doc_id", "line")


def look_up(tokens: DataFrame, wanted: DataFrame, tag: str) -> DataFrame:
    """Declarations of the names in ``wanted(name, doc_id, line)`` with the tag (``FUNCDEF``, ``CLASS``, ``VARDECL``), the nearest of each.

    ``(name, doc_id, line, def_doc, def_line)``: one in the same document goes before others, then the nearest line,
    then the lesser document; names that are declared nowhere are left out. An equi-join on the name, with a least
    value of each on top that is aggregated before the shuffle.
    """
    defs = tokens.where(F.col("tag") == tag).select("name", F.col("doc_id").alias("def_doc"), F.col("line").alias("def_line"))
    order = F.struct((F.col("doc_id") != F.col("def_doc")).alias("elsewhere"), F.abs(F.col("line") - F.col("def_line")).alias("gap"), "def_doc", "def_line")
    best = wanted.join(defs, "name").groupBy("name", "doc_id", "line").agg(F.min(order).alias("b"))
    return best.select("name", "doc_id", "line", "b.def_doc", "b.def_line")


def callers_of(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(callee, caller, doc_id, header_line)``: the functions that call the names in ``wanted(callee)``, with their headers, each once."""
    calls = callers(tokens).join(wanted.select("callee").distinct(), "callee", "left_semi")
    headers = function_headers(tokens).select(F.col("name").alias("caller"), "doc_id", F.col("line").alias("header_line"))
    near = calls.join(headers, ["caller", "doc_id"]).where("header_line <= line")
    return near.groupBy("callee", "caller", "doc_id", "line").agg(F.max("header_line").alias("header_line")).select("callee", "caller", "doc_id", "header_line").distinct()


def tree_edges(found: DataFrame) -> DataFrame:
    """``(root, caller, callee)`` of chains with their paths, each once: what is stored of a tree, or of a forest by union."""
    pairs = F.transform(F.slice("path", 2, F.size("path")), lambda x, i: F.struct(F.get(F.col("path"), i).alias("caller"), x.alias("callee")))
    return found.select("root", F.inline(pairs)).distinct()


def resolve(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Each call ``(doc_id, caller, callee, line)`` with the definition it means: ``def_doc`` and ``def_line``.

    ``functions`` has ``(name, doc_id, line)``. A definition in the same document goes before others, then the
    nearest line, then the lesser document. A callee that is defined nowhere isn't resolved.
    """
    defs = functions.select(F.col("name").alias("callee"), F.col("doc_id").alias("def_doc"), F.col("line").alias("def_line"))
    near = calls.join(defs, "callee")
    order = F.struct((F.col("doc_id") != F.col("def_doc")).alias("elsewhere"), F.abs(F.col("line") - F.col("def_line")).alias("gap"), "def_doc", "def_line")
    best = near.groupBy("doc_id", "caller", "callee", "line").agg(F.min(order).alias("b"))
    return best.select("doc_id", "caller", "callee", "line", F.col("b.def_doc").alias("def_doc"), F.col("b.def_line").alias("def_line"))


#: (container, member, result) of well-known members; None is a plain function.
BUILTINS = [
    ("string", "size", "size_t"), ("string", "length", "int"), ("string", "substr", "string"), ("string", "substring", "String"), ("string", "find", "size_t"), ("string", "c_str", "const char*"),
    ("vector", "size", "size_t"), ("vector", "empty", "bool"), ("vector", "begin", "iterator"), ("map", "size", "size_t"), ("map", "find", "iterator"), ("list", "size", "int"), ("list", "isEmpty", "boolean"),
    ("str", "split", "list"), ("str", "join", "str"), ("str", "upper", "str"), ("str", "lower", "str"), ("dict", "keys", "dict_keys"), ("dict", "items", "dict_items"), ("list", "append", "None"), ("list", "index", "int"),
    (None, "len", "int"), (None, "print", "None"), (None, "range", "range"), (None, "abs", "int"), (None, "sorted", "list"), (None, "open", "TextIOWrapper"), (None, "keccak256", "bytes32"), (None, "sha256", "bytes32"), (None, "blockhash", "bytes32"), (None, "gasleft", "uint256"),
]


def builtin_types(calls: DataFrame) -> DataFrame:
    """Add ``return_type`` to ``(container, function)``, null where it isn't known; the container's case doesn't count."""
    known = calls.sparkSession.createDataFrame(BUILTINS, "k string, f string, return_type string")
    return calls.join(F.broadcast(known), F.lower("container").eqNullSafe(F.col("k")) & (F.col("function") == F.col("f")), "left").drop("k", "f")
