"""Sources, chunks, retrieval, call graphs, providers and streams on small inputs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquill import providers
from sparquill.functions import text as X
from sparquill.operators import callgraph, chunks, retrieval
from sparquill.sources import files, sinks
from sparquill.streaming import index


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def f(): pass\n")
    (tmp_path / "src/test_b.java").write_bytes("Größe ist gut genug".encode("latin-1"))
    (tmp_path / "src/c.txt").write_text("  \n")
    (tmp_path / "src/d.py").write_bytes(b"\x89PNG....")
    (tmp_path / "src/e.py").write_bytes(b"a\x00b")
    (tmp_path / "src/f.xml").write_bytes(b"")
    (tmp_path / "src/skip.md").write_text("no")
    (tmp_path / "build").mkdir()
    (tmp_path / "build/g.py").write_text("x = 1")
    rows = {r.file_path: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"src/a.py", "src/test_b.java"} or set(rows) == {"src/a.py", "src/test_b.java", "build/g.py"}
    assert rows["src/a.py"].programming_language == "python" and rows["src/a.py"].is_code
    assert rows["src/test_b.java"].text == "Größe ist gut genug" and rows["src/test_b.java"].encoding_status == "latin-1"
    assert not rows["src/test_b.java"].is_implementation


def test_globs():
    rx = re.compile(files.glob_regex("*/bin*/*"))
    assert rx.fullmatch("a/binary/x/y") and not rx.fullmatch("bin/x")
    assert re.fullmatch(files.glob_regex("[!a]?.c"), "bx.c") and not re.fullmatch(files.glob_regex("[!a]?.c"), "ax.c")


@pytest.mark.parametrize("size,overlap", [(3, 0), (3, 1), (4, 3), (2, 5), (100, 10)])
@pytest.mark.parametrize("split_by", ["word", "sentence", "passage", "token"])
def test_chunks_by_brute_force(spark, size, overlap, split_by):
    texts = ["a b c d e f g", "a  b\nc. d", "x", "", None, "one. two. three.\n\nfour", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.ord): r.text for r in chunks.split_chunks(df, size, overlap, split_by).collect()}
    sep, step, want = chunks.SEPARATORS[split_by], (size - overlap if size > overlap else size), {}
    for i, t in enumerate(texts):
        u = (t.split(sep) if sep else list(t)) if t else []
        if u and u[-1] == "":
            u.pop()
        at = 0
        while u:
            want[i, at // step] = sep.join(u[at : at + size])
            if at + size >= len(u):
                break
            at += step
    assert got == want


def test_context(spark):
    df = chunks.link(chunks.split_chunks(spark.createDataFrame([(1, "a b c d e")], "doc_id int, text string"), 1))
    rows = {r.ord: r for r in chunks.context(df, 1).collect()}
    assert rows[0].context == "ab" and rows[2].context == "bcd" and not rows[2].cannot_extend
    assert [rows[k].prev_id for k in range(3)] == [None, "1-0", "1-1"]
    assert {r.ord: r.context for r in chunks.context(df, 2, "previous").collect()}[4] == "cde"
    assert all(r.cannot_extend for r in chunks.context(df, 9).collect())
    with pytest.raises(ValueError):
        chunks.context(df, 1, "sideways")


def test_bm25_pads_and_matches(spark):
    docs = spark.createDataFrame([(k, ["a"] if k == 7 else ["b"]) for k in range(10)], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(1, ["a", "a"]), (2, ["zz"]), (3, [])], "query_id long, tokens array<string>")
    rows = retrieval.bm25(docs, asked, 4).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id) for r in rows] == [(1, 7), (1, 0), (1, 1), (1, 2)]
    assert [r.doc_id for r in retrieval.bm25(docs, asked, 4, match_only=True).collect()] == [7]


def test_knn_blocks_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(k, v[k].tolist()) for k in range(60)] + [(98, None), (99, [1.0])], "doc_id long, vec array<double>").repartition(3)
    got = {(r.query_id, r.rank): r.doc_id for r in retrieval.knn(df, df.withColumnRenamed("doc_id", "query_id"), 3, block=7).collect() if r.query_id < 60 and r.doc_id < 60}
    s = np.round(v @ v.T, 6)
    assert got == {(q, k + 1): int(i) for q in range(60) for k, i in enumerate(np.argsort(-s[q], kind="stable")[:3])}


def test_knn_odd_vector_heads_a_block(spark):
    rows = [(99, [1.0])] + [(k, [float(k), 1.0]) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, vec array<double>").coalesce(1)
    got = retrieval.knn(df, df.withColumnRenamed("doc_id", "query_id"), 2).where("rank = 1").collect()
    assert {r.query_id: r.doc_id for r in got} == {99: 99, 0: 0} | {q: 19 for q in range(1, 20)}


def test_fusion_of_one_sided_lists(spark):
    a = spark.createDataFrame([(1, 10, 3.0, 1), (1, 11, 1.0, 2)], "query_id long, doc_id long, score double, rank int")
    b = spark.createDataFrame([(1, 12, 0.5, 1)], "query_id long, doc_id long, score double, rank int")
    assert [(r.doc_id, r.score) for r in retrieval.fuse_add(a, b).orderBy("rank").collect()] == [(10, 0.5), (12, 0.0), (11, -0.5)]
    assert [r.doc_id for r in retrieval.fuse_rrf(a, b).orderBy("rank").collect()] == [10, 12, 11]


def test_chains_cut_cycles(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("a", "b"), (None, "x"), ("e", "e")], "caller string, callee string")
    roots = spark.createDataFrame([("a",), ("e",), ("d",), (None,), ("a",)], "root string")
    assert sorted(r.chain for r in callgraph.render(callgraph.chains(calls, roots)).collect()) == ["a->b->c", "a->d"]
    assert sorted((r.root, r.node, r.depth) for r in callgraph.reachable(calls, roots).collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("d", "d", 0), ("e", "e", 0)]


def test_calls_from_code(spark):
    from sparquill.functions.code_tokens import tokenize

    code = "def a():\n    b()\n    c()\n\ndef b():\n    c()\n"
    t = tokenize(spark.createDataFrame([(1, code, "python")], "doc_id long, text string, programming_language string"))
    assert sorted((r.caller, r.callee) for r in callgraph.callers(t).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert [r.name for r in callgraph.function_headers(t).orderBy("line").collect()] == ["a", "b"]


def test_text_functions(spark):
    df = spark.createDataFrame([("1: a\n\n2: b",), ("1: a\nb",), ("",), (None,)], "t string")
    rows = df.select(X.strip_line_numbers(F.col("t")).alias("s"), X.locate_line(F.col("t"), F.lit("b")).alias("l")).collect()
    assert [r.s for r in rows] == ["a\n\nb", "1: a\nb", "", None]
    assert rows[0].l.number == 2 and rows[0].l.line == "b" and rows[2].l is None
    kinds = spark.createDataFrame([(x,) for x in ["'a'", "12", "0xFF", "1.5f", "1e3", "True", "None", "x", None]], "t string")
    assert [r.k for r in kinds.select(X.literal_type(F.col("t")).alias("k")).collect()] == ["string", "integer", "integer", "float", "float", "boolean", "null", "unknown", "unknown"]
    one = spark.createDataFrame([(["K", "V"], ["int"])], "p array<string>, a array<string>")
    assert one.select(X.type_arguments(F.col("p"), F.col("a")).alias("m")).first().m == {"K": "int"}
    chain = spark.createDataFrame([("a.b(1).c",)], "e string").select(X.dot_chain(F.col("e")).alias("c")).first().c
    assert [(x.name, x.type) for x in chain] == [("a", "scope"), ("b", "function_call"), ("c", "scope")]


def test_providers(spark):
    df = spark.createDataFrame([("x", "some words"), ("y", "some words"), ("z", " "), ("w", None)], "chunk_id string, text string")
    cached = spark.createDataFrame([("y", [1.0])], "chunk_id string, vec array<float>")
    rows = {r.chunk_id: np.array(r.vec) for r in providers.embed_missing(df, cached).collect()}
    assert set(rows) == {"x", "z", "w"} and abs(np.linalg.norm(rows["x"]) - 1) < 1e-6 and not rows["z"].any()
    ctx = df.limit(1).select(F.array(F.struct(F.lit("p").alias("path"), "text")).alias("c"))
    text = ctx.select(providers.complete(providers.prompt(F.lit("sys"), F.col("c"), F.lit("q?"))).alias("a")).first().a
    assert text.startswith("sys\n1. File: p")


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([(1, 0.5), (2, 0.9)], "doc_id long, score double")
    sinks.write_scores(s, str(tmp_path / "s"))
    assert {r.doc_id for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()} == {"1", "2"}
    sinks.write_chains(spark.createDataFrame([("a->b",), ("a->b",), (" ",)], "chain string"), str(tmp_path / "c"))
    assert [r.chain for r in sinks.read_lines(spark, str(tmp_path / "c")).collect()] == ["a->b"]


def test_stream_index_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    one = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "n")], "doc_id long, text string")
    one.coalesce(1).write.parquet(src)
    run = lambda: index.index_stream(spark.readStream.schema(one.schema).parquet(src), out, str(tmp_path / "cp"), 2).awaitTermination()
    run()
    spark.createDataFrame([(1, "a b c"), (2, "d")], one.schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted((r.doc_id, r.ord, r.text) for r in spark.read.parquet(out).collect()) == [(1, 0, "a b"), (1, 1, "c"), (2, 0, "d")]


def test_stream_windows(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    (tmp_path / "e").mkdir()
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = index.windowed_counts(stream).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == events.count()


def test_splitters(spark):
    from sparquill.operators import splitters

    text = "One two three. Four five six seven. Eight nine ten eleven twelve. Thirteen. " * 9
    spans = splitters.snapped(text, splitters.sentence_ends(text), 12, 0, 0.5)
    assert "".join(text[a:b] for a, b in spans) == text and all(text[a:b].strip().endswith(".") for a, b in spans)
    assert all(len(text[a:b].split()) <= 12 for a, b in spans)
    over = splitters.snapped(text, splitters.sentence_ends(text), 12, 4, 0.5)
    assert all(b1 >= a2 > a1 for (a1, b1), (a2, _) in zip(over, over[1:])) and over[-1][1] == len(text)
    code = "x = f(1,\n  2)\ny = 3\n"
    assert splitters.statement_ends(code) == [len("x = f(1,\n  2)\n"), len(code)]
    df = spark.createDataFrame([(1, code, ".py"), (2, text, ".txt"), (3, None, ".py"), (4, " ", ".md")], "doc_id long, text string, ext string")
    got = splitters.split_dynamic(df, 12, 0).collect()
    assert {r.doc_id for r in got} == {1, 2}


def test_engine(spark, tmp_path):
    from sparquill.plans.engine import Config, Engine

    src, out = tmp_path / "s", str(tmp_path / "i")
    src.mkdir()
    (src / "one.py").write_text("def load(path):\n    return open(path).read()\n")
    (src / "two.py").write_text("def save(path, data):\n    open(path, 'w').write(data)\n")
    (src / "three.txt").write_text("notes about the weather in spring")
    engine = Engine(spark, Config().with_value("bm25.k1", 1.5).with_value("fusion", "rrf"))
    engine.build(str(src), out)
    names = {r.chunk: r.file_path for r in engine.numbered(out).join(spark.read.parquet(f"{out}/documents"), "doc_id").select("chunk", "file_path").collect()}
    top = lambda *a: names[engine.retrieve(out, *a).where("rank = 1").first().doc_id]
    assert top("[FUNCDEF]save") == "two.py" and top("", "weather in spring") == "three.txt"
    assert top("[FUNCDEF]load[TOKEN_SPLIT][CALL]read", "load path read") == "one.py"
    answer = engine.answer(out, "[FUNCDEF]load", "load path").first()
    assert "one.py" in answer.prompt and answer.response
    (src / "four.py").write_text("def extra():\n    pass\n")
    engine.add(files.scan(spark, str(src)), out)
    assert spark.read.parquet(f"{out}/documents").count() == 4
    names = {r.chunk: r.file_path for r in engine.numbered(out).join(spark.read.parquet(f"{out}/documents"), "doc_id").select("chunk", "file_path").collect()}
    assert names[engine.retrieve(out, "[FUNCDEF]extra").where("rank = 1").first().doc_id] == "four.py"
    with pytest.raises(ValueError):
        engine.retrieve(out)
    with pytest.raises(KeyError):
        engine.transform(spark.range(1), "nothing")


def test_shared_folder_is_the_session_s(spark):
    import os

    from sparquill.runtime import checkpointed, shared_dir, stored

    where = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == where
    before = set(os.listdir(where.removeprefix("file://")))
    assert stored(spark.range(3), "x").count() == 3 and checkpointed(spark.range(4)).count() == 4
    assert any(n.startswith("x-") for n in set(os.listdir(where.removeprefix("file://"))) - before)


def test_code_chunks(spark):
    from sparquill.functions.code_tokens import typed_tokens
    from sparquill.operators.code_chunks import code_chunks, placed_units, split_code_chunks

    code = "def alpha(x): return x\n\ndef beta(y):\n    é = alpha(y)\n    return é\n"
    for unit, line, col in placed_units(code, " "):
        assert code.split("\n")[line].encode()[col:].decode().startswith(unit.split("\n")[0])
    toks = [(f"[{t}]{n}", a, b) for t, n, a, b in typed_tokens(code, "python")]
    for size in (1, 2, 3, 7, 100):
        got = code_chunks(code, toks, size)
        assert [t for c in got for t in c["tokens"]] == toks
        assert " ".join(c["original_text"][c["position_restoration_spaces"] :] for c in got).strip().split() == code.strip().split()
        assert all(c["text"].split("\n")[0].startswith(f"{c['start_line']}: ") or not c["original_text"].split("\n")[0] for c in got)
    long = code_chunks("a long.name.of.it b", [("[CALL]name.of.it b", 0, 7)], 2)
    assert long[0]["original_text"] == "a long.name.of.it b" and len(long) == 2
    assert code_chunks("a b\nc d", [], 1)[1]["position_restoration_spaces"] == 2
    df = spark.createDataFrame([(1, code, [("x", 0, 0)]), (2, None, None), (3, "", [])], "doc_id long, text string, tokens array<struct<token:string,line:int,col:int>>")
    assert {r.doc_id for r in split_code_chunks(df, 3).collect()} == {1}


def test_bytes():
    data = "aé漢".encode()
    assert [X.safe_cut(data, k) for k in range(-1, 8)] == [0, 0, 1, 1, 3, 3, 3, 6, 6]
    assert X.cache_name("/a/b/", dual=True, model="m") == "#a#b-dual-vector-m"


def test_bm25_by_blocks_and_by_joins_agree(spark, small, monkeypatch):
    from sparquill.plans import catalog

    asked, tokens = catalog._asked(spark, small), catalog._tokens(spark, small)
    for b in (0.0, 0.75):
        for match_only in (False, True):
            one = sorted(tuple(r) for r in retrieval.bm25(tokens, asked, 5, b=b, match_only=match_only).collect())
            with monkeypatch.context() as m:
                m.setattr(retrieval, "BROADCAST_BYTES", 0)
                two = sorted(tuple(r) for r in retrieval.bm25(tokens, asked, 5, b=b, match_only=match_only).collect())
            assert one == two and one


def test_bm25_reads_documents_once(spark, small, monkeypatch):
    from sparquill.plans import catalog

    scans, write = [], retrieval.stored

    def counted(df, name):
        scans.append(df._jdf.queryExecution().executedPlan().toString().count("documents.parquet"))
        return write(df, name)

    monkeypatch.setattr(retrieval, "stored", counted)
    out = catalog.QUERIES["rt_bm25"](spark, small)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum(scans) == 1 and "documents.parquet" not in plan and "Exchange hashpartitioning(token" not in plan


def test_content_types(spark):
    """Literal rows, worked out by hand from the marks."""
    rows = [("hello world", "unknown"), ("  \n ", "unknown"), ("{}", "code"), ('["a", null]', "json"), ("a: b", "yaml"), (".. note:: x", "rst"), ("const x = 1;\nlet y = 2;\n", "code"), ("1. see http://a.org", "text"), ("import os\nclass a", "code")]
    df = spark.createDataFrame(rows, "t string, want string").select("t", "want", X.content_type(F.col("t")).alias("got"))
    assert [(r.t, r.got) for r in df.collect()] == rows


def test_chains_end_at_the_depth(spark):
    calls = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "caller int, callee int")
    root = spark.createDataFrame([(1,)], "root int")
    assert [r.path for r in callgraph.chains(calls, root, 3).collect()] == [[1, 2, 3]]
    assert [r.path for r in callgraph.chains(calls, root, 1000).collect()] == [[1, 2, 3, 4]]


def test_shared_folder_has_to_be_named_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from sparquill import runtime

    off = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        runtime.shared_dir(off)


def test_scratch_goes_at_its_end(spark):
    import os

    from sparquill import runtime

    with runtime.scratch(spark) as base:
        runtime.stored(spark.range(3), "some")
        assert os.path.isdir(base.removeprefix("file://"))
    assert not os.path.exists(base.removeprefix("file://"))


def test_query_driven_embeds_candidates_alone(spark):
    from sparquill import providers

    seen = []
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "gamma")], "doc_id long, text string")
    ranking = spark.createDataFrame([(0, 1, 2.0, 1), (0, 2, 1.0, 2)], "query_id long, doc_id long, score double, rank int")
    got = retrieval.candidates(docs, ranking)
    assert sorted(r.doc_id for r in got.collect()) == [1, 2] and not seen
    asked = spark.range(1).select(F.col("id").alias("query_id"), providers.embed(F.lit("alpha")).alias("vec"))
    rows = retrieval.query_driven(ranking, got, asked).orderBy("rank").collect()
    assert {r.doc_id for r in rows} == {1, 2} and len(rows) == 2


def test_report_and_rankings(spark, tmp_path):
    from sparquill.sources import sinks

    one = spark.createDataFrame([(0, 1, 2.0)], "query_id int, doc_id int, score double")
    answer = spark.createDataFrame([("why?", "so")], "prompt string, response string")
    sinks.write_report(str(tmp_path / "r"), answer, answer, one, one, one, one)
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["bm25_retrieved", "context", "metadata", "prompt", "response", "retrieved_documents"]
    sinks.write_rankings(str(tmp_path / "s"), bm25=one, dense=one, sum=one, rrf=one)
    assert len(list((tmp_path / "s").iterdir())) == 4


def test_chains_counts_and_trees_by_brute_force(spark):
    import random
    from collections import Counter

    rng = random.Random(5)
    dag = {(a, b) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.35}
    cyclic = {(a, b) for a in range(20, 27) for b in range(20, 27) if rng.random() < 0.35} | {(20, 21), (21, 20), (40, 41)}
    calls, roots = sorted(dag | cyclic), (0, 3, 20, 40, 41)

    def walk(path, most):
        after = [b for a, b in calls if a == path[-1] and b not in path] if len(path) < most else []
        return [p for b in after for p in walk([*path, b], most)] if after else [path] if len(path) > 1 else []

    df, start = spark.createDataFrame(calls, "caller long, callee long"), spark.createDataFrame([(r,) for r in roots], "root long")
    places = spark.createDataFrame([(k, f"f{k}", k) for k in range(30)], "name long, file string, line long")
    for most in (1, 2, 4, 1000):
        want = [tuple(p) for r in roots for p in walk([r], most)]
        got = callgraph.chains(df, start, most, places).collect()
        assert sorted(tuple(r.path) for r in got) == sorted(want) and all(r.depth == len(r.path) - 1 and r.root == r.path[0] for r in got)
        assert all(r.located == "->".join(f"f{k},{k}" if k < 30 else "?,?" for k in r.path) for r in got)
        many = Counter(p[0] for p in want)
        assert sorted(callgraph.counted(df, start, most).collect()) == sorted((r, n, max(len(p) - 1 for p in want if p[0] == r)) for r, n in many.items())
        assert sorted(callgraph.tree(df, start, most).collect()) == sorted({(p[0], a, b) for p in want for a, b in zip(p, p[1:])})


def test_chains_beyond_the_recursion_limit(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", 100)
    try:
        calls = spark.range(1, 400).selectExpr("id div 2 AS caller", "id AS callee").where("caller > 0")
        root = spark.range(1, 2).toDF("root")
        assert callgraph.chains(calls, root).count() == 200
        assert callgraph.counted(calls, root).collect() == [(1, 200, 8)]
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_reachability_plan_stays_small(spark):
    """A round's plan has nothing of the rounds before: neither their operators nor the constraints of their rows."""
    calls = spark.range(1, 9).selectExpr("id AS caller", "id + 1 AS callee")
    found = callgraph.reachable(calls, spark.range(1, 2).toDF("root"))
    assert found.count() == 9
    found = found.where("depth > 1 AND node > 2")
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 1000


def test_files_are_decoded_once(spark, small):
    from sparquill.plans import catalog

    plan = catalog.QUERIES["src_files"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Generate ")
    assert below and "is_valid_utf8" not in above.lower().replace("isvalidutf8", "is_valid_utf8") and "ISO-8859-1" not in above and "(..)" not in plan


def test_a_task_gives_the_best_alone(spark):
    """What a task of a search holds and gives is ``top_k`` a query, however many Arrow batches it gets."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        docs = spark.range(200, numPartitions=1).selectExpr("id AS doc_id", "split(concat('a b w', id % 7, ' ', repeat('c ', CAST(id % 5 AS INT))), ' ') AS tokens")
        asked = spark.createDataFrame([(1, "a", 1), (2, "c", 1), (2, "w3", 2)], "query_id int, token string, times long")
        found = retrieval._by_blocks(docs, asked, 3, 1.2, 0.0, False)
        assert found.count() == 6
        vecs = spark.range(200, numPartitions=1).selectExpr("id AS doc_id", "array(CAST(id % 11 AS FLOAT), CAST(id % 3 AS FLOAT)) AS vec")
        near = retrieval.knn(vecs, vecs.where("doc_id < 4").withColumnRenamed("doc_id", "query_id"), 3)
        assert "Join" not in near._jdf.queryExecution().executedPlan().toString()
        want = []
        for q in range(4):
            best = sorted((-float((q % 11) * (k % 11) + (q % 3) * (k % 3)), k) for k in range(200))[:3]
            want += [(q, k, -s, n + 1) for n, (s, k) in enumerate(best)]
        assert sorted(tuple(r) for r in near.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_best_is_bounded_and_exact(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(retrieval, "PART_HITS", 50)
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(0, 30, (5, 4000)).astype(float), rng.permutation(4000)
    best = retrieval.Best(5, 4, pa.int64(), pa.string())
    for k in range(0, 4000, 7):
        best.add(0, pa.array([f"{i:05}" for i in ids[k : k + 7]]), scores[:2, k : k + 7])
        best.add(2, pa.array([f"{i:05}" for i in ids[k : k + 7]]), scores[2:, k : k + 7])
        assert best.found.num_rows <= 20 and best.many < 50 + 5 * 7
    got = sorted((r["query_id"], -r["score"], r["doc_id"]) for b in best.batches([10, 11, 12, 13, 14]) for r in b.to_pylist())
    assert got == sorted(x for q in range(5) for x in sorted((q + 10, -s, f"{i:05}") for s, i in zip(scores[q], ids))[:4])


def test_queries_beyond_a_broadcast_go_in_groups(spark, monkeypatch):
    vecs = spark.range(300, numPartitions=3).selectExpr("id AS doc_id", "array(CAST(id % 17 AS FLOAT), CAST(id % 5 AS FLOAT)) AS vec")
    asked = vecs.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    whole = sorted(tuple(r) for r in retrieval.knn(vecs, asked, 3, 4, True).collect())
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 100)
    parts = retrieval.knn(vecs, asked, 3, 4, True)
    assert sorted(tuple(r) for r in parts.collect()) == whole and len(whole) == 90


def test_providers_get_parts_of_a_batch(spark):
    """Texts go to a provider about a megabyte at once, whatever the Arrow batch."""

    class Checked(providers.HashEmbedding):
        def embed(self, texts):
            assert sum(map(len, texts)) <= 1 << 20
            return super().embed(texts)

        def complete(self, prompts):
            assert sum(map(len, prompts)) <= 1 << 20
            return [p[:1] for p in prompts]

    providers.register_embedding("checked", Checked)
    providers.register_model("checked", Checked)
    texts = spark.range(40, numPartitions=1).selectExpr("id", "IF(id = 7, NULL, repeat('ab', 50000)) AS t")
    got = texts.select("id", providers.embed(F.col("t"), "checked").alias("v"), providers.complete(F.col("t"), "checked").alias("c")).orderBy("id").collect()
    assert all(any(r.v) == (r.id != 7) and r.c == ("" if r.id == 7 else "a") for r in got) and len(got) == 40


def test_tokens_of_a_document_are_not_shuffled_to_be_chunked(spark, small):
    from sparquill.functions.code_tokens import listed, tokenize
    from sparquill.plans import catalog

    docs = spark.createDataFrame([(1, "ab c\nd", "unknown"), (2, None, "python"), (3, "", None), (4, "def f():\n  g()\n", "python"), (1, "x", None)], "doc_id int, text string, programming_language string")
    got = [(r.doc_id, [tuple(t) for t in r.tokens]) for r in listed(docs).collect()]
    assert sorted(got) == [(1, [("ab", 0, 0), ("c", 0, 3), ("d", 1, 0)]), (1, [("x", 0, 0)]), (2, []), (3, []), (4, [("[FUNCDEF]f", 0, 4), ("[CALL]g", 1, 2)])]
    assert sorted((r.doc_id, r.token, r.line, r.col) for r in tokenize(docs).collect()) == sorted((i, *t) for i, ts in got for t in ts)
    plan = catalog.QUERIES["ch_code_tokens"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
