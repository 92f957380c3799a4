"""More queries of the catalogue: files, typed tokens of several languages, look-ups, sinks that are read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import providers
from ..functions import text as X
from ..functions.analysis import parsed_chain
from ..functions.code_tokens import listed, tokenize
from ..operators import callgraph, code_chunks, retrieval, splitters
from ..runtime import shared_dir, table
from ..sources import files, sinks
from .catalog import _BM25, _CALLS, _CHAINS, _chunk_sql, _calls, _docs, _root, _vectors, query, rt_bm25
from .engine import Config, Engine


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_EXT = "CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.java' WHEN 'fr' THEN '.md' ELSE '.sol' END"


def _files(spark, d):
    """Documents as files: a path, and the text's bytes."""
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".java").when(F.col("lang") == "fr", ".md").otherwise(".sol")
    return _docs(spark, d, "doc_id", "lang", "source", "text").select(F.concat(F.lit("/code/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"), F.encode("text", "utf-8").alias("content"))


@query(f"""SELECT sha256(path) AS doc_id, path AS file_path, ext, lang = 'en' OR lang = 'de' OR lang NOT IN ('en', 'de', 'fr') AS is_code, true AS is_implementation,
  CASE ext WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.md' THEN 'documentation' ELSE 'solidity' END AS programming_language, 'utf-8' AS encoding_status, md5(text) AS text
  FROM (SELECT lang, text, source || '/' || doc_id || {_EXT} AS path, {_EXT} AS ext FROM documents) WHERE trim(regexp_replace(text, '\\s', '', 'g')) <> '' AND length(text) <= 1000000""")
def src_files(spark, d):
    """Files described: decoded, with language and kind; blank ones left out."""
    return files.describe(_files(spark, d), "/code").drop("title").withColumn("text", F.md5("text"))


@query("SELECT doc_id, md5(text) AS text FROM documents WHERE trim(regexp_replace(text, '\\s', '', 'g')) <> ''")
def ch_dynamic(spark, d):
    """Chunks at statement and sentence ends, put together again: every character is in one."""
    ext = F.when(F.col("lang") == "en", ".py").otherwise(".txt")
    docs = _docs(spark, d, "doc_id", "lang", "text").select("doc_id", "text", ext.alias("ext")).where(F.trim(F.regexp_replace("text", r"\s", "")) != "")
    cut = splitters.split_dynamic(docs, 256, 0)
    whole = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("c"))
    return whole.select("doc_id", F.md5(F.array_join(F.transform("c", lambda x: x["text"]), "")).alias("text"))


@query("""SELECT doc_id, sum(n)::BIGINT AS n_tokens, md5(string_agg(t, ' ' ORDER BY i)) AS tokens FROM (
  SELECT doc_id, i, w[i] AS t, 1 AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT doc_id, list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Za-z0-9_]+')) AS w FROM documents))) GROUP BY doc_id""")
def ch_code_tokens(spark, d):
    """Chunks that don't cut tokens: every token of a document is in one of its chunks, and once."""
    docs = _docs(spark, d).withColumn("programming_language", F.lit("unknown"))
    cut = code_chunks.split_code_chunks(listed(docs), 64, 8).where(F.size("tokens") > 0)
    own = cut.groupBy("doc_id").agg(F.sum(F.size("tokens")).alias("n_tokens"), F.flatten(F.collect_list("tokens")).alias("t"))
    t = F.array_sort(F.transform("t", lambda x: F.struct(x["line"], x["col"], x["token"].alias("token"))))
    return own.select("doc_id", "n_tokens", F.md5(F.array_join(F.transform(t, lambda x: x["token"]), " ")).alias("tokens"))


@query(_chunk_sql(256, 0, "SELECT doc_id, ord, doc_id || '-' || ord AS chunk_id, lag(doc_id || '-' || ord) OVER w AS prev_id, lead(doc_id || '-' || ord) OVER w AS next_id, md5(text) AS text FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY ord)"))
def en_split(spark, d):
    """The engine's transformer by name: linked chunks."""
    cut = Engine(spark, Config().with_value("chunk_size", 256)).transform(_docs(spark, d), "split")
    return cut.select("doc_id", "ord", "chunk_id", "prev_id", "next_id", F.md5("text").alias("text"))


@query("""SELECT doc_id, CASE WHEN p >= n THEN p ELSE p - CASE WHEN substr(h, 2 * p + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 0 WHEN substr(h, 2 * p - 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 1
    WHEN substr(h, 2 * p - 3, 1) NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END END AS cut FROM (SELECT doc_id, hex(encode(text)) AS h, strlen(text)::INT AS n, (strlen(text) // 2)::INT AS p FROM documents)""")
def sc_char_start(spark, d):
    """The middle byte of a document, moved to the start of its character."""
    return _docs(spark, d).select("doc_id", X.char_start(F.col("text"), F.expr("octet_length(text) div 2")).alias("cut"))


@query("""SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'code' WHEN lang = 'fr' THEN 'unknown' ELSE 'text' END AS kind, lang || ',' || source AS args, 'T,U' AS params,
  CASE WHEN doc_id % 2 = 0 THEN 'a,c' ELSE 'b' END AS complete, CASE doc_id % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'string' WHEN 2 THEN 'float' ELSE 'boolean' END AS literal FROM documents""")
def sc_types(spark, d):
    """Kinds of files, type parameters and their arguments both ways, complete definitions, types of literals."""
    rows = _docs(spark, d, "doc_id", "lang", "source")
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".JAVA").when(F.col("lang") == "fr", ".md").otherwise(".txt")
    params, args = F.array(F.lit("T"), F.lit("U"), F.lit("V")), F.array("lang", "source")
    there, back = X.type_arguments(params, args), X.parameters_of(params, args)
    flags = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("yes"), F.lit("no"), F.lit("YES"))).otherwise(F.array(F.lit("no"), F.lit("yes"), F.lit("")))
    n = F.col("doc_id").cast("string")
    literal = F.when(F.col("doc_id") % 4 == 0, n).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("'"), n, F.lit("'"))).when(F.col("doc_id") % 4 == 2, F.concat(n, F.lit(".5"))).otherwise("true")
    return rows.select("doc_id", X.document_type(ext).alias("kind"), F.concat_ws(",", there["T"], there["U"]).alias("args"), F.concat_ws(",", F.element_at(back, F.col("lang")), F.element_at(back, F.col("source"))).alias("params"), F.array_join(X.complete_only(F.array(F.lit("a"), F.lit("b"), F.lit("c")), flags), ",").alias("complete"), X.literal_type(literal).alias("literal"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ns:namespace_or_class|' || lang || ':namespace_or_class|get:function_call|' || source || ':member_access|go:function_call'
  WHEN 1 THEN lang || ':scope|run:function_call|' || source || ':scope' END AS parts FROM documents""")
def sc_chains(spark, d):
    """Components of chained expressions by their language; a language without rules gives none."""
    rows = _docs(spark, d, "doc_id", "lang", "source")
    one = F.concat(F.lit("ns::"), "lang", F.lit("::get(a.b, c->d)."), "source", F.lit("->go()"))
    two = F.concat("lang", F.lit(".run(x.y(1.5)).") , "source")
    language = F.when(F.col("doc_id") % 3 == 0, "cpp").when(F.col("doc_id") % 3 == 1, "python").otherwise("cobol")
    parts = parsed_chain(F.when(F.col("doc_id") % 3 == 0, one).otherwise(two), language)
    return rows.select("doc_id", F.array_join(F.transform(parts, lambda p: F.concat(p["name"], F.lit(":"), p["type"])), "|").alias("parts"))


# typed tokens of code: five samples of each language, with the document's number in their names (§)

SAMPLES = {
    "cpp": [
        "class Box§ {\n  int size§;\npublic:\n  int area§(int side) { return grow§(side) * size§; }\n};\n",
        "int sum§(int a, int b) {\n  int total§ = a + b;\n  return total§;\n}\n",
    ],
    "java": [
        "package shop§;\npublic class Cart§ {\n  private int count§;\n  int add§(int more) {\n    return merge§(more);\n  }\n}\n",
    ],
    "solidity": [
        "contract Vault§ {\n  uint256 total§;\n  function put§(uint256 sum) public {\n    total§ = keep§(sum);\n  }\n}\n",
    ],
    "python": [
        "import os§\nclass Tree§:\n    def grow§(self, high):\n        leaf§ = cut§(high)\n        return leaf§\n",
    ],
}
#: (language, sample, tag, name, line, column, numbers before it in its line), as read by eye.
EXPECTED = """
cpp 0 CLASS Box§ 0 6 0|cpp 0 VARDECL size§ 1 6 0|cpp 0 FUNCDEF area§ 3 6 0|cpp 0 VARDECL side 3 15 1|cpp 0 CALL grow§ 3 30 1|cpp 0 IDENTIFIER side 3 35 2|cpp 0 IDENTIFIER size§ 3 43 2
cpp 1 FUNCDEF sum§ 0 4 0|cpp 1 VARDECL a 0 12 1|cpp 1 VARDECL b 0 19 1|cpp 1 VARDECL total§ 1 6 0|cpp 1 IDENTIFIER a 1 14 1|cpp 1 IDENTIFIER b 1 18 1|cpp 1 IDENTIFIER total§ 2 9 0
java 0 CLASS Cart§ 1 13 0|java 0 VARDECL count§ 2 14 0|java 0 FUNCDEF add§ 3 6 0|java 0 VARDECL more 3 14 1|java 0 CALL merge§ 4 11 0|java 0 IDENTIFIER more 4 17 1
solidity 0 CLASS Vault§ 0 9 0|solidity 0 VARDECL total§ 1 10 0|solidity 0 FUNCDEF put§ 2 11 0|solidity 0 VARDECL sum 2 23 1|solidity 0 IDENTIFIER total§ 3 4 0|solidity 0 CALL keep§ 3 12 1|solidity 0 IDENTIFIER sum 3 17 2
python 0 PKG os§ 0 7 0|python 0 CLASS Tree§ 1 6 0|python 0 FUNCDEF grow§ 2 8 0|python 0 VARDECL self 2 13 1|python 0 VARDECL high 2 19 1|python 0 VARDECL leaf§ 3 8 0|python 0 CALL cut§ 3 15 1|python 0 IDENTIFIER high 3 19 2|python 0 IDENTIFIER leaf§ 4 15 0
"""


def _samples(spark, d, language: str):
    n = F.col("doc_id").cast("string")
    texts = [F.replace(F.lit(t), F.lit("§"), n) for t in SAMPLES[language]]
    return _docs(spark, d, "doc_id").select("doc_id", F.get(F.array(*texts), (F.col("doc_id") % len(texts)).cast("int")).alias("text"), F.lit(language).alias("programming_language"))


def _expected(language: str) -> str:
    rows = [r.split() for line in EXPECTED.split("\n") for r in line.split("|") if r.startswith(language + " ")]
    values = ", ".join(f"({r[1]}, '{r[2]}', '{r[3]}', {r[4]}, {r[5]}, {r[6]})" for r in rows)
    return f"SELECT doc_id, tag, replace(name, '§', doc_id::VARCHAR) AS name, line, (col + shift * length(doc_id::VARCHAR))::INT AS col FROM documents JOIN (VALUES {values}) AS t(sample, tag, name, line, col, shift) ON doc_id % {len(SAMPLES[language])} = sample"


def _typed(language: str):
    def run(spark, d):
        return tokenize(_samples(spark, d, language)).select("doc_id", "tag", "name", "line", "col")

    run.__name__, run.__doc__ = f"tk_{language}_samples", f"Typed tokens of {language} code."
    query(_expected(language))(run)


for _language in SAMPLES:
    _typed(_language)


def _everything(spark, d):
    code = [_samples(spark, d, lang).select(F.concat(F.lit(lang + "/"), F.col("doc_id").cast("string")).alias("doc_id"), "text", "programming_language") for lang in ("python", "java", "solidity")]
    return tokenize(code[0].unionByName(code[1]).unionByName(code[2]))


@query("""SELECT 'Cart' || doc_id AS name, 'python/' || doc_id AS doc_id, 'java/' || doc_id AS def_doc, 1::INT AS def_line, 'CLASS' AS tag FROM documents
  UNION ALL SELECT 'put' || doc_id, 'python/' || doc_id, 'solidity/' || doc_id, 2, 'FUNCDEF' FROM documents UNION ALL SELECT 'count' || doc_id, 'python/' || doc_id, 'java/' || doc_id, 2, 'VARDECL' FROM documents""")
def jn_definitions(spark, d):
    """Definitions of functions, classes and variables by name, from another file."""
    tokens, n = _everything(spark, d), F.col("doc_id").cast("string")
    out = None
    for tag, name in (("CLASS", "Cart"), ("FUNCDEF", "put"), ("VARDECL", "count")):
        wanted = _docs(spark, d, "doc_id").select(F.concat(F.lit(name), n).alias("name"), F.concat(F.lit("python/"), n).alias("doc_id"), F.lit(0).alias("line"))
        found = callgraph.look_up(tokens, wanted, tag).select("name", "doc_id", "def_doc", "def_line", F.lit(tag).alias("tag"))
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT 'merge' || doc_id AS callee, 'add' || doc_id AS caller, 'java/' || doc_id AS doc_id, 3::INT AS header_line FROM documents UNION ALL SELECT 'keep' || doc_id, 'put' || doc_id, 'solidity/' || doc_id, 2 FROM documents")
def jn_callers(spark, d):
    """Headers of the functions that call a function."""
    n = F.col("doc_id").cast("string")
    wanted = _docs(spark, d, "doc_id").select(F.explode(F.array(F.concat(F.lit("merge"), n), F.concat(F.lit("keep"), n))).alias("callee"))
    return callgraph.callers_of(_everything(spark, d), wanted)


# chains stored and read again, answers, summaries


@query(_CHAINS + ", e AS (SELECT DISTINCT root, path[i] AS caller, path[i + 1] AS callee FROM (SELECT root, path, unnest(range(1, len(path))) AS i FROM chains)) SELECT root, caller, callee FROM e")
def snk_edges(spark, d):
    """The tree of all chains of the root, written as edges and read again."""
    path = _folder(spark, "edges")
    sinks.write_edges(callgraph.tree(_calls(spark, d), _root(spark)), path)
    return sinks.read_edges(spark, path)


@query(_CHAINS + " SELECT DISTINCT array_to_string(list_transform(path, lambda x: 's' || (x % 7) || ',' || x), '->') AS chain FROM chains")
def snk_located(spark, d):
    """Chains as file and line, written as text and read again."""
    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("name"))
    places = n.select("name", F.concat(F.lit("s"), (F.col("name") % 7).cast("string")).alias("file"), F.col("name").alias("line"))
    path = _folder(spark, "chains")
    found = callgraph.chains(_calls(spark, d), _root(spark), places=places)
    sinks.write_chains(found.select(F.col("located").alias("chain")), path)
    return sinks.read_lines(spark, path)


@query(_BM25 + ", s AS (SELECT source, count(*) AS n, count(l.doc_id) AS n_labelled FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source) SELECT source, n, n_labelled FROM s")
def ag_metadata(spark, d):
    """Documents of a source, and how many of them are labelled."""
    known = table(spark, d, "labels").select("doc_id", F.lit(True).alias("known")).distinct()
    return _docs(spark, d, "doc_id", "source").join(known, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("known")).alias("n_labelled"))


_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s', '', 'g')) <> '')[1:3]"


@query(f"SELECT doc_id, md5(array_to_string({_LINES}, chr(10))) AS summary, 256::INT AS size, 256::INT AS summary_size FROM documents")
def em_summaries(spark, d):
    """Summaries of documents by the offline model, and vectors of both."""
    u = providers.understood(_docs(spark, d))
    return u.select("doc_id", F.md5("summary").alias("summary"), F.size("vec").alias("size"), F.size("summary_vec").alias("summary_size"))


@query(f"SELECT 'extractive' AS model, count(*) AS calls, sum(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')))::BIGINT AS prompt_tokens, sum(len(regexp_extract_all(array_to_string({_LINES}, chr(10)), '[\\p{{L}}\\p{{N}}_]+')))::BIGINT AS completion_tokens FROM documents")
def ag_usage(spark, d):
    """Calls and tokens of the model that sums up all documents, from the audit table."""
    path = _folder(spark, "audit")
    told = _docs(spark, d).select(F.col("text").alias("prompt"), providers.complete(F.col("text")).alias("response"))
    sinks.audit(providers.audited(told), path)
    return providers.usage(spark.read.parquet(path))


@query(_BM25 + """, near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) AS r FROM (
    SELECT b.query_id, b.doc_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dense FROM bm25 b JOIN embeddings e ON e.vec_id = b.doc_id JOIN embeddings q ON q.vec_id = b.query_id)),
  f AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM (SELECT query_id, doc_id, 0.5 / (60 + rank) AS s FROM bm25 UNION ALL SELECT query_id, doc_id, 0.5 / (60 + r) FROM near) GROUP BY ALL)
  SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 20""")
def rt_query_driven(spark, d):
    """BM25's candidates alone are scored by vectors, and both rankings fused."""
    return retrieval.query_driven(rt_bm25(spark, d), _vectors(spark, d), _vectors(spark, d, "query_id"))


@query(_BM25 + " SELECT query_id, doc_id, score FROM bm25")
def snk_scores(spark, d):
    """A ranking written as CSV and read again."""
    path = _folder(spark, "scores")
    sinks.write_rankings(path, bm25=rt_bm25(spark, d))
    return spark.read.option("header", True).schema("query_id bigint, doc_id bigint, score double, rank int").csv(f"{path}/bm25_scores.csv").drop("rank")


@query("SELECT user_id, min(ts) AS began, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT, 0) AS new FROM events)) GROUP BY user_id, s")
def sm_sessions(spark, d):
    """Sessions of users: events less than half an hour apart."""
    from ..streaming.index import sessions

    e = table(spark, d, "events").select("ts", "user_id")
    return sessions(e).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("began"), "n")


@query(f"WITH RECURSIVE {_CALLS} SELECT caller, callee, row_number() OVER (PARTITION BY caller ORDER BY callee)::INT AS nth FROM calls")
def st_ordered(spark, d):
    """Distinct calls, numbered in their order."""
    return _calls(spark, d).distinct().withColumn("nth", F.row_number().over(Window.partitionBy("caller").orderBy("callee")))
