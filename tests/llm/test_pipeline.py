"""The pipeline's stages, each against what its operator decides on that stage's own input."""

import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from sparquill.llm import bpe, mixing, quality, simhash


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    raw, seen = docs, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
    names = [n for n, _ in P.STAGES]
    for n in names[:-1]:
        assert seen[n][1].columns == raw.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = seen["quality_rules"]
    assert ids(after) == ids(quality.quality_rules(before, quality.train_rules(raw, labels)).where("keep"))
    before, after = seen["quality_classifier"]
    assert ids(after) == ids(quality.quality_classifier(before, quality.train_ranker(raw, labels)).where("keep"))
    before, after = seen["simhash_dedup"]
    assert ids(after) == ids(simhash.near_duplicates(before).where("keep"))
    before, after = seen["mixing"]
    wanted = mixing.copies(before).where("copies > 0").select(F.explode(F.sequence(F.lit(1), "copies")), F.col("id").alias("doc_id"))
    assert ids(after) == ids(wanted)
    before, after = seen["bpe"]
    text = {r.doc_id: r.text for r in before.collect()}
    import public_tokenizers

    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(bpe.vocabulary_path()).ranks, special_tokens={})
    rows = after.collect()
    assert sorted(r.doc_id for r in rows) == ids(before)
    assert all(r.token_ids == e.encode_ordinary(text[r.doc_id]) for r in rows)
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(bad & {r.doc_id for r in rows}) <= 1


def test_run(spark, small):
    a, b = (sorted((r.doc_id, tuple(r.token_ids)) for r in P.run(spark, small).collect()) for _ in range(2))
    assert a == b and a


def test_odd_rows(spark, small, tmp_path):
    """Nulls in every column, string ids, repeated rows, clashing extra columns, a very long text, an empty table."""
    schema = "doc_id string, text string, lang string, source string, n_chars long, keep string, k int, content_share double"
    clean = spark.read.parquet(f"{small}/documents.parquet").orderBy("n_chars").limit(30).collect()
    rows = [(str(r.doc_id), r.text, r.lang, None if r.doc_id % 3 else r.source, None, "x", None, 0.5) for r in clean]
    rows += [rows[0], (None, None, None, None, None, None, None, None), (None, clean[1].text, "en", "s", 1, "y", 1, None), ("e", "", "en", "s", 0, None, 1, None), ("long", clean[2].text * 3000, "en", "s", 0, None, 1, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        columns, before = docs.columns, docs.count()
        for k, (name, stage) in enumerate(P.STAGES):
            out = str(tmp_path / f"{before}-{k}")
            stage(spark, docs, small).write.parquet(out)
            docs = spark.read.parquet(out)
            if name != "bpe":
                assert docs.columns == columns
                assert not docs.where("keep NOT IN ('x', 'y')").count()
        assert (docs.count() > 5) == (before > 0)
        assert {r.doc_id for r in docs.collect()} <= {r[0] for r in rows}


def test_many_rows_of_one_id(spark, small, tmp_path, monkeypatch):
    """The models' fits take no labelled row to the driver beyond ``LOCAL_BYTES``, however many rows repeat a labelled id."""
    d = tmp_path / "d"
    labels = spark.read.parquet(f"{small}/labels.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    hot = labels.where("quality = 1").agg(F.min("doc_id")).first()[0]
    more = spark.range(20_000).select(F.lit(hot).alias("doc_id"), F.concat(F.lit("plain words of row number "), F.col("id").cast("string"), F.lit(".")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(30).cast("long").alias("n_chars"))
    docs.unionByName(more).write.parquet(f"{d}/documents.parquet")

    def refused(*_):
        raise AssertionError("rows at the driver")

    monkeypatch.setattr(quality, "fit_rules", refused)
    monkeypatch.setattr(quality, "fit_ranker", refused)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    monkeypatch.setattr(quality, "LOCAL_BYTES", 1 << 20)
    # the lines are all different, and so plain that both stages keep the rows
    for stage in (P.quality_rules, P.quality_classifier):
        assert stage(spark, docs, str(d)).where(F.col("doc_id") == hot).count() > 19_000


def test_all_labels_count(spark):
    ids = spark.range(5000)
    labels = ids.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    docs = ids.select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    assert quality.labelled_sample(docs, labels).count() == 5000
