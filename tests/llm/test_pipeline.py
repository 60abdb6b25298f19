"""The pipeline's stages on awkward rows, and the registered queries."""

import gc
import random
import re
import time
from pathlib import Path

import cases
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(*r[:2], r[2] and "en", *r[3:5]) for r in cases.awkward()]  # of one language, so that only texts without a letter are rejected
    rows += [(200 + k, f"alpha beta gamma delta number {'abcdefghij'[k]} one two three four five six seven eight nine ten {k}", "en", "s", 9) for k in range(6)]
    rows += [(300, "x " + " ".join("abcdefgh"[k % 8] * 3 + str(k) for k in range(20)), "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[-1][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
    start, lettered, distinct, clean, private, tokens = seen
    assert {r.text for r in lettered} == {r.text for r in start if re.search(r"[^\W\d_]", r.text or "")}
    assert len(lettered) == sum(bool(re.search(r"[^\W\d_]", r.text or "")) for r in start)
    for a in lettered:
        like = [b for b in distinct if (x := shingles(a.text)) and 100 * len(x & (y := shingles(b.text))) >= 80 * len(x | y)]
        assert len(like) == 1, (a.doc_id, a.text[:50])
    assert {r.doc_id for r in clean} == {r.doc_id for r in distinct} - {300}
    assert len(private) == len(clean) == len(tokens)
    changed = next(r for r in private if r.doc_id == 11)
    assert "[EMAIL]" in changed.text and changed.n_chars == len(changed.text)
    assert all(r.lossless for r in tokens)


def test_stages_beyond_the_broadcast(spark, folder, monkeypatch):
    """The same rows, and no text in a shuffle but of rows that a bitmap marks."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("row_key", F.lit("own"))
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated):
        found = []
        for bound in (10**6, 0):
            monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", bound)
            out = stage(spark, docs, folder)
            found.append(sorted(map(repr, out.collect())))
            assert out.columns == docs.columns
        assert found[0] == found[1] and 0 < len(found[0]) < docs.count()
    logical = out._jdf.queryExecution().optimizedPlan().toString()
    asked = [x for x in logical.split("Join LeftAnti") if "rightHint=(strategy=merge)" in x[:120]]
    assert asked and "__bits" in asked[-1]


def test_run_is_the_stages(spark, folder):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("tallystream-*"))
    assert corpus_pipeline.run(spark, folder).count() > 0
    left = set(shared.glob("tallystream-*")) - before
    assert [p.name for x in left for p in x.iterdir()] == ["stage-4"]  # all else is removed as it goes
    assert corpus_pipeline.ORACLE_SQL is None


def test_queries_leave_only_their_results(spark, folder):
    from tallystream.llm import queries

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    spark.createDataFrame([(1, "http://a", "<p>a</p>"), (2, "http://b", "<p>a</p>")], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name in ("op2_decontaminate", "op3_neardup", "op5_archive", "op6_gif", "op9_quality", "op10_secrets"):
        before = set(shared.glob("tallystream-*"))
        out = queries.QUERIES[name](spark, folder)
        assert [p.name for x in set(shared.glob("tallystream-*")) - before for p in x.iterdir()] == ["result"], name
        assert out.count() == (2 if name == "op5_archive" else spark.read.parquet(f"{folder}/documents.parquet").count())


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {re.match(r"op\d+", n)[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_other_languages_go(spark, tmp_path):
    r = random.Random(4)
    parts = {"en": ["the", "tion", "and", "ing"], "de": ["der", "ung", "sch", "ich"], "fr": ["eau", "que", "oi", "é"]}
    make = lambda bits: " ".join("".join(r.choices(bits, k=r.randrange(1, 4))) for _ in range(30))
    rows = [(i, make(parts[x]), x, "s", 9) for i in range(3000) for x in [list(parts)[i % 3]]]
    rows += [(9000 + i, make(["zzkw", "olo", "wwa", "ybb", "привет", "мир"]), None, "s", 9) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {x.doc_id for x in corpus_pipeline.keep_languages(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert sum(i < 9000 for i in kept) >= 2970
    assert sum(i >= 9000 for i in kept) <= 2, sum(i >= 9000 for i in kept)


def test_least_score_is_that_of_all_held_out(spark, monkeypatch):
    """The exact quantile of every held-out document whose label is found, however many a label has."""
    from tallystream.llm import language, queries

    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).alias("n_chars"))
    scored = docs.withColumn("lang_pred", F.when(F.col("doc_id") % 10 == 0, "de").otherwise(F.col("lang"))).withColumn("score", F.lit(0.6) + F.col("doc_id") % 3989 / 10_000)
    monkeypatch.setattr(language, "fit", lambda *_, **__: language.ByteGru(["de", "en"]))
    monkeypatch.setattr(language, "identify", lambda rows, *_, **__: scored.join(rows.select("doc_id"), "doc_id", "left_semi"))
    right = sorted(r.score for r in scored.filter(queries.held_out() & (F.col("lang") == F.col("lang_pred"))).collect())
    least = right[-(-len(right) * 2 // 1000) - 1]  # the least score that 0.002 of them don't exceed
    kept = {r.doc_id for r in corpus_pipeline.keep_languages(spark, docs, "").collect()}
    assert len(right) > 5000 and kept == {r.doc_id for r in scored.filter(F.col("score") >= least).collect()}
    assert 0 < docs.count() - len(kept) < 100


def test_stages_begin_with_free_heaps(spark, monkeypatch):
    from tallystream.llm import _arrow

    jvm = spark.sparkContext._jvm
    thing = jvm.java.lang.Object()
    known = jvm.java.lang.ref.WeakReference(thing)
    jvm.System.gc()
    assert known.get() is not None
    del thing
    for _ in range(10):
        gc.collect()
        time.sleep(0.3)  # the gateway lets go of what Python has dropped a little later
        _arrow.give_back_heap(spark)
        if known.get() is None:
            break
    else:
        pytest.fail("no garbage was collected")

    def stop(_):
        raise InterruptedError

    monkeypatch.setattr(corpus_pipeline, "give_back_heap", stop)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(InterruptedError):
            stage(spark, None, "")
