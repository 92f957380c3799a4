"""Queries by name over the shared tables, each over the whole of them, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import callgraph, chunks, retrieval
from ..runtime import table
from ..sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "documents").select(*(cols or ("doc_id", "text")))


W = r"[\p{L}\p{N}_]+"

# scalar functions


@query(f"SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, regexp_extract_all(text, '{W}') AS t FROM documents)")
def sc_words(spark, d):
    """Unicode words of every document."""
    t = _docs(spark, d).select("doc_id", X.words(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query(f"SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '{W}'), lambda x: regexp_full_match(x, '[A-Za-z0-9_]+')) AS t FROM documents)")
def sc_ascii_words(spark, d):
    """The fallback tokenizer."""
    t = _docs(spark, d).select("doc_id", X.ascii_words(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query("SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN length(x) > 0 THEN (i - 1)::VARCHAR || ': ' || x ELSE '' END), chr(10))) AS numbered FROM documents")
def sc_line_numbers(spark, d):
    """Text with line numbers."""
    return _docs(spark, d).select("doc_id", F.md5(X.number_lines(F.col("text"), F.lit(0))).alias("numbered"))


@query("SELECT doc_id, md5(text) AS stripped FROM documents")
def sc_strip_line_numbers(spark, d):
    """Numbering and stripping again gives the text."""
    numbered = X.number_lines(F.col("text"), F.lit(1))
    back = F.when(X.has_line_numbers(numbered), X.strip_line_numbers(numbered))
    return _docs(spark, d).select("doc_id", F.md5(back).alias("stripped"))


@query("""SELECT doc_id, path, ext, lang, lang NOT IN ('documentation', 'ini', 'makefile', 'shell', 'unknown') AS code,
  NOT (starts_with(path, 'test_') OR starts_with(path, 'app_') OR starts_with(path, 'build')) AND NOT contains(lower(path), 'test') AS implementation FROM (
  SELECT doc_id, path, ext, CASE ext WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.md' THEN 'documentation' WHEN '.sol' THEN 'solidity' ELSE 'unknown' END AS lang FROM (
    SELECT doc_id, source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'tests/' WHEN doc_id % 7 = 1 THEN 'build/' ELSE '' END || doc_id || e AS path, e AS ext FROM (
      SELECT doc_id, source, CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.java' WHEN 'fr' THEN '.md' ELSE '.sol' END AS e FROM documents)))""")
def sc_file_kinds(spark, d):
    """Extension, language and kind of a path made of a document's source and number."""
    docs = _paths(spark, d)
    ext = X.file_extension(F.col("path"))
    return docs.select("doc_id", "path", ext.alias("ext")).select("doc_id", "path", "ext", X.programming_language(F.col("ext")).alias("lang")).select("*", X.is_code(F.col("lang")).alias("code"), X.is_implementation(F.col("path")).alias("implementation"))


def _paths(spark, d):
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".java").when(F.col("lang") == "fr", ".md").otherwise(".sol")
    folder = F.when(F.col("doc_id") % 7 == 0, "tests/").when(F.col("doc_id") % 7 == 1, "build/").otherwise("")
    return _docs(spark, d, "doc_id", "lang", "source").select("doc_id", F.concat("source", F.lit("/"), folder, F.col("doc_id").cast("string"), ext).alias("path"))


@query("""SELECT s_suppkey AS id, regexp_replace(trim(regexp_replace('const ' || s_name || ' const&', '^(const )+', '')), '[ &*]+$', '') AS bare, 'run' AS callee,
  md5(s_name) AS hash, 2::INT AS n_tokens, s_name AS name, 'a' || chr(10) || s_name AS plain FROM supplier""")
def sc_expressions(spark, d):
    """Type cleaning, callee names, hashes, query splitting, tags and escapes."""
    s = table(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"),
        X.clean_type(F.concat(F.lit("const "), "s_name", F.lit(" const&"))).alias("bare"),
        X.callee_name(F.concat(F.lit("obj->"), "s_name", F.lit("::run(1, f(2))"))).alias("callee"),
        X.definition_hash(F.col("s_name")).alias("hash"),
        F.size(X.query_tokens(F.concat("s_name", F.lit("[TOKEN_SPLIT]b")))).alias("n_tokens"),
        X.untagged(F.concat(F.lit("[CALL]"), "s_name")).alias("name"),
        X.unescape(F.concat(F.lit("a\\n"), "s_name")).alias("plain"),
    )


def _marks_sql() -> str:
    quote = lambda m: "'" + m.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    count = lambda c: f"(length(text) - length(replace(text, '{c}', '')))"
    cols = []
    for k, marks in X.MARKS.items():
        s = " + ".join(f"contains(low, {quote(m)})::INT" for m in marks)
        cols.append(f"{s}{' + 2 * (' + count('{') + ' + ' + count('}') + ' > length(text) * 0.01 OR ' + count(';') + ' > length(text) * 0.02)::INT' if k == 'code' else ''} AS s_{k}")
    best = "greatest(" + ", ".join(f"s_{k}" for k in X.MARKS) + ")"
    return f"SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\\s', '', 'g')) = '' OR {best} = 0 THEN 'unknown' {' '.join(f'WHEN s_{k} = {best} THEN {chr(39)}{k}{chr(39)}' for k in X.MARKS)} END AS kind FROM (SELECT doc_id, text, {', '.join(cols)} FROM (SELECT doc_id, text, lower(text) AS low FROM documents))"


@query(_marks_sql())
def sc_content_type(spark, d):
    """Kind of content by its marks."""
    return _docs(spark, d).select("doc_id", X.content_type(F.col("text")).alias("kind"))


@query("""SELECT source, doc_id, round(CASE WHEN n <= 1 THEN 1.0 ELSE (x - lo) / (hi - lo + 1e-12) END, 6) AS minmax, round((x - m) / (s + 1e-12), 6) AS zscore FROM (
  SELECT source, doc_id, n_chars::DOUBLE AS x, min(n_chars) OVER w AS lo, max(n_chars) OVER w AS hi, avg(n_chars) OVER w AS m, stddev_pop(n_chars) OVER w AS s, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY source))""")
def sc_normalised(spark, d):
    """Min-max and z-score within a source."""
    by = Window.partitionBy("source")
    x = F.col("n_chars").cast("double")
    return _docs(spark, d, "source", "doc_id", "n_chars").select("source", "doc_id", F.round(X.min_max(x, by), 6).alias("minmax"), F.round(X.z_score(x, by), 6).alias("zscore"))


# filters


def _exclusion_sql() -> str:
    rx = "|".join(files.glob_regex(p) for p in dict.fromkeys(files.EXCLUDED))
    return f"SELECT * FROM ({SQL['sc_file_kinds']}) WHERE NOT regexp_full_match(path, '{rx}', 's')"


@query(_exclusion_sql())
def fl_excluded(spark, d):
    """What the exclusion globs leave."""
    return sc_file_kinds(spark, d).where(~files.excluded(F.col("path")))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) <= 1000000 AND trim(text) <> ''")
def fl_size(spark, d):
    """Documents within the size limit that aren't blank."""
    return _docs(spark, d, "doc_id", "n_chars", "text").where((F.length("text") <= files.MAX_CHARS) & (F.trim("text") != "")).select("doc_id", "n_chars")


# chunks

_UNITS = "SELECT doc_id, CASE WHEN u[-1] = '' THEN u[:-2] ELSE u END AS u FROM (SELECT doc_id, string_split(text, ' ') AS u FROM documents WHERE length(text) > 0)"


def _chunk_sql(size: int, overlap: int, cols: str) -> str:
    step = size - overlap
    return f"""WITH c AS (SELECT doc_id, ord::INT AS ord, u[(ord * {step} + 1):(ord * {step} + {size})] AS w, u[1:(ord * {step})] AS b FROM (
      SELECT doc_id, u, unnest(range(0, greatest(ceil((len(u) - {size}) / {float(step)}), 0)::BIGINT + 1)) AS ord FROM ({_UNITS}) WHERE len(u) > 0)),
    k AS (SELECT doc_id, ord, len(w)::INT AS n_units, array_to_string(w, ' ') AS text, (length(array_to_string(b, ' ')) - length(replace(array_to_string(b, ' '), chr(10), '')))::INT AS start_line FROM c),
    chunks AS (SELECT *, (start_line + length(text) - length(replace(text, chr(10), '')))::INT AS end_line FROM k) {cols}"""


@query(_chunk_sql(256, 0, "SELECT doc_id, ord, n_units, md5(text) AS text, start_line, end_line FROM chunks"))
def ch_fixed(spark, d):
    """Chunks of 256 words."""
    return chunks.split_chunks(_docs(spark, d)).withColumn("text", F.md5("text"))


@query(_chunk_sql(256, 32, "SELECT doc_id, ord, n_units, md5(text) AS text, start_line, end_line FROM chunks"))
def ch_overlap(spark, d):
    """Chunks of 256 words, 32 of them those of the chunk before."""
    return chunks.split_chunks(_docs(spark, d), overlap=32).withColumn("text", F.md5("text"))


@query(_chunk_sql(256, 0, "SELECT doc_id, ord, doc_id || '-' || ord AS chunk_id, lag(doc_id || '-' || ord) OVER w AS prev_id, lead(doc_id || '-' || ord) OVER w AS next_id FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY ord)"))
def wn_links(spark, d):
    """Links between the chunks of a document."""
    return chunks.link(chunks.split_chunks(_docs(spark, d))).select("doc_id", "ord", "chunk_id", "prev_id", "next_id")


@query("""SELECT conv_id, turn, md5(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS context,
  turn - 1 <= min(turn) OVER (PARTITION BY conv_id) AND turn + 1 >= max(turn) OVER (PARTITION BY conv_id) AS cannot_extend FROM conversations""")
def wn_context(spark, d):
    """A turn with its neighbours."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "text")
    return chunks.context(t).select(F.col("doc_id").alias("conv_id"), F.col("ord").alias("turn"), F.md5("context").alias("context"), "cannot_extend")


@query(_chunk_sql(256, 0, "SELECT l.doc_id, l.line, c.ord FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10)))))::INT AS line FROM documents WHERE length(text) > 0) l JOIN chunks c ON l.doc_id = c.doc_id AND l.line BETWEEN c.start_line AND c.end_line"))
def jn_line_range(spark, d):
    """The chunks that contain a line, for all lines."""
    docs = _docs(spark, d)
    lines = docs.where(F.length("text") > 0).select("doc_id", F.explode(F.sequence(F.lit(0), F.size(F.split("text", "\n", -1)) - 1)).alias("line"))
    spans = chunks.split_chunks(docs).select("doc_id", "ord", "start_line", "end_line")
    return chunks.chunk_at_line(spans, lines).select("doc_id", "line", "ord")


@query(_chunk_sql(256, 0, "SELECT doc_id, min_by(doc_id || '-' || ord, ord) AS first_id, count(*) AS n FROM chunks GROUP BY doc_id"))
def ag_first_chunk(spark, d):
    """First chunk and number of chunks of a document."""
    c = chunks.split_chunks(_docs(spark, d)).select("doc_id", "ord", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("ord").cast("string")).alias("chunk_id"))
    return c.groupBy("doc_id").agg(F.min_by("chunk_id", "ord").alias("first_id"), F.count("*").alias("n"))


# retrieval


def _tokens(spark, d):
    return _docs(spark, d).select("doc_id", X.words(F.col("text")).alias("tokens"))


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), X.words(F.col("text")).alias("tokens"))


_BM25 = f"""WITH dt AS (SELECT doc_id, unnest(regexp_extract_all(text, '{W}')) AS token FROM documents),
  qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(text, '{W}')) AS token FROM benchmark),
  q AS (SELECT query_id, token, count(*) AS times FROM qt GROUP BY ALL),
  tf AS (SELECT doc_id, token, count(*) AS tf FROM dt WHERE token IN (SELECT token FROM q) GROUP BY ALL),
  df AS (SELECT token, ln((SELECT count(*) FROM documents) + 1) - ln(count(*) + 0.5) AS idf FROM tf GROUP BY token),
  t AS (SELECT query_id, q.token, times * idf * 2.2 AS w FROM q JOIN df USING (token)),
  base AS (SELECT query_id, sum(w * (0.5 / 1.7)) AS base FROM t GROUP BY query_id),
  gain AS (SELECT query_id, doc_id, sum(w * ((tf + 0.5) / (1.7 + tf) - 0.5 / 1.7)) AS gain FROM t JOIN tf USING (token) GROUP BY ALL),
  scored AS (SELECT b.query_id, d.doc_id, round(base + coalesce(gain, 0), 6) AS score FROM base b CROSS JOIN documents d LEFT JOIN gain g ON g.query_id = b.query_id AND g.doc_id = d.doc_id),
  bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20)"""


@query(_BM25 + " SELECT query_id, doc_id, score, rank::INT AS rank FROM bm25")
def rt_bm25(spark, d):
    """BM25's best twenty documents for every benchmark item."""
    return retrieval.bm25(_tokens(spark, d), _asked(spark, d))


@query(f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{W}')) AS token FROM documents) SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY token")
def ag_frequencies(spark, d):
    """Document and corpus frequency of every word."""
    return retrieval.postings(_tokens(spark, d)).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _vectors(spark, d, by="doc_id"):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias(by), F.col("embedding").alias("vec"))


_KNN = """knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q CROSS JOIN embeddings e WHERE {w})) WHERE rank <= 20)"""


@query("WITH " + _KNN.format(w="q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id") + " SELECT query_id, doc_id, score, rank::INT AS rank FROM knn")
def rt_knn(spark, d):
    """The exact twenty nearest vectors of every vector whose id is divisible by fifty."""
    return retrieval.knn(_vectors(spark, d), _vectors(spark, d, "query_id").where("query_id % 50 = 0"), skip_same=True)


def _dense(spark, d):
    asked = _vectors(spark, d, "query_id").join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")), "query_id", "left_semi")
    return retrieval.knn(_vectors(spark, d), asked)


_DENSE = _KNN.format(w="q.vec_id IN (SELECT item_id FROM benchmark)")
_NORM = """SELECT query_id, doc_id, (mm - avg(mm) OVER w) / (stddev_pop(mm) OVER w + 1e-12) AS z FROM (
  SELECT query_id, doc_id, CASE WHEN count(*) OVER v <= 1 THEN 1.0 ELSE (score - min(score) OVER v) / (max(score) OVER v - min(score) OVER v + 1e-12) END AS mm FROM {t} WINDOW v AS (PARTITION BY query_id)) WINDOW w AS (PARTITION BY query_id)"""
_TOP = " SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 20"


@query(_BM25 + ", " + _DENSE + f", a AS ({_NORM.format(t='bm25')}), b AS ({_NORM.format(t='knn')}), f AS (SELECT query_id, doc_id, round(coalesce(a.z, 0) * 0.5 + coalesce(b.z, 0) * 0.5, 6) AS score FROM a FULL JOIN b USING (query_id, doc_id))" + _TOP)
def rt_hybrid_add(spark, d):
    """Fusion by the sum of z-scores."""
    return retrieval.fuse_add(rt_bm25(spark, d), _dense(spark, d))


@query(_BM25 + ", " + _DENSE + ", f AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM (SELECT query_id, doc_id, 0.5 / (60 + rank) AS s FROM bm25 UNION ALL SELECT query_id, doc_id, 0.5 / (60 + rank) FROM knn) GROUP BY ALL)" + _TOP)
def rt_hybrid_rrf(spark, d):
    """Fusion by reciprocal ranks."""
    return retrieval.fuse_rrf(rt_bm25(spark, d), _dense(spark, d))


_UNDERSTOOD = _KNN.replace("knn AS", "u AS").replace("e.embedding::DOUBLE[]", "list_reverse(e.embedding)::DOUBLE[]").format(w="q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id")


@query("WITH " + _KNN.replace("knn AS", "c AS").format(w="q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id") + ", " + _UNDERSTOOD + ", f AS (SELECT query_id, doc_id, greatest(c.score, u.score) AS score FROM c FULL JOIN u USING (query_id, doc_id))" + _TOP)
def rt_dual(spark, d):
    """Two vectors of each document, that of its summary being the other one reversed; merged by the better score."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.reverse("embedding").alias("vec"))
    asked = _vectors(spark, d, "query_id").where("query_id % 50 = 0")
    return retrieval.max_merge(retrieval.knn(_vectors(spark, d), asked, skip_same=True), retrieval.knn(e, asked, skip_same=True))


@query("SELECT vec_id, label, len(embedding)::INT AS size FROM embeddings WHERE len(embedding) = (SELECT s FROM (SELECT len(embedding) AS s, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, s LIMIT 1))")
def ag_modal_size(spark, d):
    """Vectors of the commonest length."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return retrieval.modal_size(e, "embedding").select("vec_id", "label", F.size("embedding").alias("size"))


# joins, sets


@query("SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def jn_not_embedded(spark, d):
    """Documents that have no vector yet."""
    return _docs(spark, d, "doc_id", "n_chars").join(_vectors(spark, d).select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def jn_embedded(spark, d):
    """Documents that have a vector."""
    return _docs(spark, d, "doc_id", "n_chars").join(_vectors(spark, d).select("doc_id"), "doc_id", "left_semi")


@query("SELECT DISTINCT trim(source) AS name FROM documents WHERE trim(source) <> ''")
def st_distinct(spark, d):
    """Distinct trimmed names."""
    return _docs(spark, d, "source").select(F.trim("source").alias("name")).where("name <> ''").distinct()


_SIDES = "a AS (SELECT DISTINCT trim(c_mktsegment || '->' || c_nationkey) AS chain FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT trim(c_mktsegment || '->' || c_nationkey) AS chain FROM customer WHERE c_acctbal < 0)"


@query(f"WITH {_SIDES} SELECT 'left' AS side, chain FROM a WHERE chain NOT IN (SELECT chain FROM b) UNION ALL SELECT 'right', chain FROM b WHERE chain NOT IN (SELECT chain FROM a)")
def st_differences(spark, d):
    """Lines in one of two listings alone."""
    c = table(spark, d, "customer").withColumn("chain", F.concat_ws("->", "c_mktsegment", F.col("c_nationkey").cast("string")))
    return callgraph.differences(c.where("c_acctbal > 9000"), c.where("c_acctbal < 0"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS enclosing FROM events""")
def jn_enclosing(spark, d):
    """As-of: the latest opening event at or before each event of a user."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    first = e.agg(F.min("event_type").alias("tag"))
    t = e.crossJoin(F.broadcast(first)).select("event_id", F.col("user_id").alias("doc_id"), F.col("ts").alias("line"), F.col("event_id").alias("col"), F.when(F.col("event_type") == F.col("tag"), "FUNCDEF").alias("tag"), F.col("event_id").alias("name"))
    return callgraph.enclosing(t).select("event_id", F.col("doc_id").alias("user_id"), "enclosing")


# call graphs


def _calls(spark, d):
    """A supplier is called by the one with half its number, and by that with a third of it."""
    s = table(spark, d, "supplier").where("s_suppkey > 1").select("s_suppkey")
    return s.select(F.expr("s_suppkey div 2").alias("caller"), F.col("s_suppkey").alias("callee")).unionByName(s.where("s_suppkey > 2").select(F.expr("s_suppkey div 3").alias("caller"), F.col("s_suppkey").alias("callee")))


_CALLS = "calls AS (SELECT DISTINCT caller, callee FROM (SELECT s_suppkey // 2 AS caller, s_suppkey AS callee FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT s_suppkey // 3, s_suppkey FROM supplier WHERE s_suppkey > 2))"
_CHAINS = f"""WITH RECURSIVE {_CALLS}, t(root, node, path, depth) AS (
  SELECT 1::BIGINT, 1::BIGINT, [1::BIGINT], 0 UNION ALL
  SELECT t.root, c.callee, list_append(path, c.callee), depth + 1 FROM t JOIN calls c ON c.caller = t.node WHERE NOT list_contains(path, c.callee)),
  chains AS (SELECT root, path, depth FROM t WHERE depth > 0 AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.caller = t.node AND NOT list_contains(path, c.callee)))"""


def _root(spark):
    return spark.range(1, 2).select(F.col("id").alias("root"))


@query(_CHAINS + " SELECT root, array_to_string(path, '->') AS chain, depth FROM chains")
def cg_chains(spark, d):
    """All call chains from the root."""
    found = callgraph.render(callgraph.chains(_calls(spark, d), _root(spark)))
    return found.select(F.col("root").cast("long"), "chain", "depth")


@query(_CHAINS + " SELECT root, count(*) AS n_chains, max(depth)::INT AS deepest FROM chains GROUP BY root")
def cg_chain_counts(spark, d):
    """Number and depth of the chains of a root."""
    return callgraph.counted(_calls(spark, d), _root(spark))


@query(f"""WITH RECURSIVE {_CALLS}, t(root, node, depth) AS (SELECT 1::BIGINT, 1::BIGINT, 0 UNION SELECT t.root, c.callee, depth + 1 FROM t JOIN calls c ON c.caller = t.node)
  SELECT root, node, min(depth)::INT AS depth FROM t GROUP BY root, node""")
def cg_reachable(spark, d):
    """All that the root calls, with the least depth."""
    return callgraph.reachable(_calls(spark, d), _root(spark))


# code


def _code(spark, d):
    """A small Python file of each document: a function that calls another."""
    n = F.col("doc_id").cast("string")
    code = F.concat(F.lit("import os\n\ndef f"), n, F.lit("(a):\n    x = g"), n, F.lit("(a)\n    return x\n"))
    return _docs(spark, d, "doc_id").select("doc_id", code.alias("text"), F.lit("python").alias("programming_language"))


@query("""SELECT doc_id, t.tag AS tag, CASE WHEN t.own THEN t.name || doc_id ELSE t.name END AS name, t.line AS line, (t.col + CASE WHEN t.shift THEN length(doc_id::VARCHAR) ELSE 0 END)::INT AS col FROM documents,
  (VALUES ('PKG', 'os', false, 0, 7, false), ('FUNCDEF', 'f', true, 2, 4, false), ('VARDECL', 'a', false, 2, 6, true), ('VARDECL', 'x', false, 3, 4, false), ('CALL', 'g', true, 3, 8, false), ('IDENTIFIER', 'a', false, 3, 10, true), ('IDENTIFIER', 'x', false, 4, 11, false)) AS t(tag, name, own, line, col, shift)""")
def tk_python(spark, d):
    """Typed tokens of Python code."""
    from ..functions.code_tokens import tokenize

    return tokenize(_code(spark, d)).select("doc_id", "tag", "name", "line", "col")


@query("SELECT doc_id, 'f' || doc_id AS caller, 'g' || doc_id AS callee, 3::INT AS line FROM documents")
def cg_calls(spark, d):
    """Calls with the functions they are in, read from code."""
    from ..functions.code_tokens import tokenize

    return callgraph.callers(tokenize(_code(spark, d))).select("doc_id", "caller", "callee", "line")


@query("SELECT doc_id, 's' || doc_id AS name FROM documents")
def tk_xml(spark, d):
    """Statements that a mapping file defines."""
    from ..functions.code_tokens import tokenize

    code = F.concat(F.lit('<mapper>\n<select id="s'), F.col("doc_id").cast("string"), F.lit('">q</select>\n<p id="no"/></mapper>'))
    rows = _docs(spark, d, "doc_id").select("doc_id", code.alias("text"), F.lit("xml").alias("programming_language"))
    return tokenize(rows).where("tag = 'FUNCDEF'").select("doc_id", "name")


@query("SELECT doc_id, 'Box' AS base, 'ns' AS namespaces, lang || ',List<' || source || '>' AS args, source AS item FROM documents")
def lq_type_names(spark, d):
    """Parts of class names, and the item type of a list."""
    from ..functions.analysis import as_udf

    name = F.concat(F.lit("ns::Box<"), "lang", F.lit(", List<"), "source", F.lit(">>"))
    rows = _docs(spark, d, "doc_id", "lang", "source").select("doc_id", as_udf("base_class_name")(name).alias("n"), as_udf("element_type")(F.concat(F.lit("List<"), "source", F.lit(">"))).alias("item"))
    return rows.select("doc_id", F.col("n.base_class_name").alias("base"), F.array_join("n.namespaces", ",").alias("namespaces"), F.array_join("n.type_arguments", ",").alias("args"), "item")


@query("""SELECT doc_id, CASE WHEN pos IS NULL THEN NULL ELSE (pos - 1)::INT END AS number, CASE WHEN pos IS NULL THEN NULL ELSE (strpos(lines[pos], 'the ') - 1)::INT END AS col FROM (
  SELECT doc_id, lines, list_position(list_transform(lines, lambda x: contains(x, 'the ')), true) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""")
def sc_locate(spark, d):
    """First numbered line with an element, and the element's column."""
    numbered = X.number_lines(F.col("text"), F.lit(0))
    at = _docs(spark, d).select("doc_id", X.locate_line(numbered, F.lit("the ")).alias("at"))
    return at.select("doc_id", F.col("at.number").alias("number"), X.column_of(F.col("at.line"), F.lit("the ")).alias("col"))


# more windows, filters, prompts


@query("""SELECT conv_id, turn, list_filter(range(0, 31, 3), lambda k: list_sum(lens[greatest(pos - k, 1):(pos + k)]) >= 1000)[1]::INT AS width FROM (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, list(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lens FROM conversations)""")
def wn_widening(spark, d):
    """The least widening, of 0, 3, ..., 30 turns, whose context has a thousand characters."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(by).alias("at"), F.collect_list(F.length(F.coalesce("text", F.lit("")))).over(whole).alias("lens"))
    fits = F.filter(F.sequence(F.lit(0), F.lit(30), F.lit(3)), lambda k: F.aggregate(F.slice(F.col("lens"), F.greatest(F.col("at") - k, F.lit(1)), F.least(F.col("at") + k, F.size("lens")) - F.greatest(F.col("at") - k, F.lit(1)) + 1), F.lit(0), lambda s, x: s + x) >= 1000)
    return t.select("conv_id", "turn", F.get(fits, F.lit(0)).alias("width"))


@query(_BM25 + " SELECT query_id, doc_id, source FROM (SELECT query_id, doc_id, source, max((source = 'src0')::INT) OVER (PARTITION BY query_id) AS own FROM bm25 JOIN documents USING (doc_id)) WHERE source = 'src0' OR own = 0")
def fl_source_or_all(spark, d):
    """Hits in one source, or all of a query's hits where it has none there."""
    hits = rt_bm25(spark, d).select("query_id", "doc_id").join(_docs(spark, d, "doc_id", "source"), "doc_id")
    some = F.max((F.col("source") == "src0").cast("int")).over(Window.partitionBy("query_id"))
    return hits.withColumn("some", some).where("source = 'src0' OR some = 0").select("query_id", "doc_id", "source")


@query("SELECT conv_id, md5('system' || chr(10) || chr(10) || string_agg((n || '. File: ' || role || chr(10) || text), chr(10) || chr(10) ORDER BY n) || chr(10) || chr(10) || 'why?') AS prompt FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def cx_prompt(spark, d):
    """A prompt with the turns of a conversation as numbered contexts."""
    from ..providers import prompt

    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("path"), "text"))).alias("c"))
    return t.select("conv_id", F.md5(prompt(F.lit("system"), F.col("c"), F.lit("why?"))).alias("prompt"))


@query()
def em_vectors(spark, d):
    """Embeddings of the documents by feature hashing."""
    from ..providers import embed

    return _docs(spark, d).select("doc_id", embed(F.col("text")).alias("vec"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def sm_windows(spark, d):
    """Events by hour and type, as the streaming window query gives them once all has arrived."""
    from ..streaming.index import windowed_counts

    e = table(spark, d, "events").select("ts", "event_type", "value")
    return windowed_counts(e).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("value", 4).alias("value"))


@query("SELECT doc_id, 'f' || doc_id AS caller, 'f' || (doc_id + 1) AS callee, 1::INT AS line, doc_id + 1 AS def_doc, 0::INT AS def_line FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents)")
def cg_resolved(spark, d):
    """Calls resolved to their definitions: each document's function calls that of the next."""
    from ..functions.code_tokens import tokenize

    n, m = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    code = F.concat(F.lit("def f"), n, F.lit("():\n    f"), m, F.lit("()\n"))
    t = tokenize(_docs(spark, d, "doc_id").select("doc_id", code.alias("text"), F.lit("python").alias("programming_language")))
    return callgraph.resolve(callgraph.callers(t), callgraph.function_headers(t))


@query("SELECT doc_id, 'obj.go(' || source || ', h(1))' AS call_expr, 7::INT AS line_number, 2::INT AS column_number, 'member_method' AS call_type, 'go' AS method_name FROM documents UNION ALL SELECT doc_id, 'h(1)', 7, (2 + length('obj.go(' || source || ', '))::INT, 'function', 'h' FROM documents")
def lq_calls(spark, d):
    """Call expressions of a numbered body, with their kind."""
    from ..functions.analysis import as_udf

    body = F.concat(F.lit("7:   obj.go("), "source", F.lit(", h(1)) // x()"))
    rows = _docs(spark, d, "doc_id", "source").select("doc_id", F.explode(as_udf("call_expressions")(body)).alias("c")).select("doc_id", "c.*")
    return rows.withColumn("k", as_udf("call_kind")(F.col("call_expr"))).select("doc_id", "call_expr", "line_number", "column_number", "k.call_type", "k.method_name")


@query("""SELECT doc_id, (length(p) - length(replace(p, chr(10), '')))::INT AS line, strlen(string_split(p, chr(10))[-1])::INT AS col FROM (
  SELECT doc_id, substr(text, 1, length(text) // 2) AS p FROM documents)""")
def sc_byte_positions(spark, d):
    """Line and column of the byte in the middle of a document's characters."""
    half = F.octet_length(F.substring(F.col("text"), F.lit(1), F.expr("length(text) div 2").cast("int")))
    at = _docs(spark, d).select("doc_id", X.line_and_column(F.col("text"), half).alias("at"))
    return at.select("doc_id", "at.line", "at.col")


@query("SELECT s_suppkey AS id, s_suppkey % 3 = 0 AS chained, CASE WHEN s_suppkey % 3 = 0 THEN 'a|b(1)|c(2)' ELSE 'ns|go(x)' END AS parts, 'identifier|function_call|literal' AS kinds FROM supplier")
def lq_chains(spark, d):
    """Components of chained calls, and operands of an expression."""
    from ..functions.analysis import as_udf

    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    expr = F.when(F.col("id") % 3 == 0, "a->b(1).c(2)").otherwise("ns::go(x)")
    kinds = as_udf("segments")(F.concat(F.lit("n + f(1, "), F.col("id").cast("string"), F.lit(") * 2")))
    return s.select("id", as_udf("is_chained")(expr).alias("chained"), F.array_join(F.transform(as_udf("chain_components")(expr), lambda c: c["component"]), "|").alias("parts"), F.array_join(F.transform(kinds, lambda k: k["kind"]), "|").alias("kinds"))


from . import catalog_more  # noqa: E402, F401  (registers its queries)
