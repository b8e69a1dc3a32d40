"""Stages of the corpus pipeline against brute force, on whole tables and on odd rows."""

import collections

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from freshet.llm import language, quality
from tests.llm.test_near import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_quality(rows):
    """Kept texts by counting distinct texts for each host and line, in plain Python."""
    norm = lambda line: " ".join(line.lower().split(" "))
    words = lambda text: [w for w in text.translate(str.maketrans("\t\n\x0b\f\r", "     ")).split(" ") if w]
    line_of = lambda line: norm(" ".join(words(line)))
    holders = collections.defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if words(line):
                holders[r.source or "", line_of(line)].add(r.text or "")
    out = []
    for r in rows:
        text = r.text or ""
        w = words(text)
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = len({i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)})
        lost = [line for line in text.split("\n") if words(line) and len(holders[r.source or "", line_of(line)]) > 20]
        if len(w) < 50 or 100 * repeated > 50 * len(w) or len(w) - sum(len(words(x)) for x in lost) < 0.2 * len(w):
            continue
        gone = {line_of(x) for x in lost}
        out.append((r.doc_id, "\n".join(x for x in text.split("\n") if not words(x) or line_of(x) not in gone)))
    return sorted(out, key=str)


def test_quality_rules(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = [f"template line number {k} of the host" for k in range(30)]
    own = lambda tag, n: " ".join(f"{tag}x{j}" for j in range(n))
    hot = [(10_000 + i, "\n".join([*lines, own(f"d{i}", 10)]), "en", "hot", 1) for i in range(1000)]  # almost all template: rejected
    hot += [(12_000 + i, "\n".join([*lines[:9], own(f"e{i}", 80)]), "en", "warm", 1) for i in range(100)]  # lose nine lines
    hot += [(13_000 + i, "\n".join(own(f"c{k}", 20) for k in range(4)), "en", "hot", 1) for i in range(40)]  # exact copies count once
    hot += [(None, own("n", 60), None, None, None), (None, None, None, None, None), (14_000, "", "en", None, 0), (14_001, "\t \n", "en", "", 0), (14_002, f"A  {own('b', 60)}\n a {own('b', 60)}", "en", "s", 1)]
    table = base.unionByName(spark.createDataFrame(hot, DOCS))
    rows = table.collect()
    got = corpus_pipeline.quality_rules(spark, table, "")
    assert got.columns == table.columns
    found = got.collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == plain_quality(rows)
    kept = {r.doc_id: r.text for r in found}
    assert not any(10_000 <= k < 11_000 for k in kept if k is not None)
    assert all("template" not in kept[12_000 + i] for i in range(100)) and all(13_000 + i in kept for i in range(40)) and None in kept


def test_lines_flagged_in_the_query_and_its_sql(spark):
    lines = [f"line {k} of twenty" for k in range(20)]
    rows = [(i, "\n".join([*lines, " ".join(f"o{i}y{j}" for j in range(60))]), "en", "h", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    got = docs.transform(quality.line_quality).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got.removed_words == 80).all()
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    want = c.execute(quality.ORACLE_SQL["op8_quality"]).df().sort_values("doc_id").reset_index(drop=True)[got.columns]
    assert (got == want).all().all()


def test_language_id(spark, docs):
    odd = docs.unionByName(spark.createDataFrame([(None, None, "en", "s", 1), (9_001, "", None, None, 0), (9_002, "Все люди рождаются свободными и равными. " * 9, None, "s", 1), (9_003, "12 34", "de", "s", 1)], DOCS))
    got = corpus_pipeline.language_id(spark, odd, "")
    assert got.columns == odd.columns
    model = language.train(odd)
    want = {}
    for r in odd.collect():
        (lang,), _, (rejected,) = model.predict([r.text])
        if not rejected:
            want[r.doc_id] = lang
    assert {r.doc_id: r.lang for r in got.collect()} == want
    assert not {None, 9_001, 9_002, 9_003} & set(want) and len(want) > 0.95 * docs.count()


def test_near_duplicates(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    want = {rows[i].doc_id for i in brute([r.text or "" for r in rows])}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


def test_stages_of_empty_and_odd_tables(spark, docs):
    wide = docs.limit(0).withColumns({c: F.lit(1) for c in ("key", "fp", "mark", "root", "text ", "__row", "a.b", "h")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide, "").count() == 0, name
    repeated = docs.limit(20).unionByName(docs.limit(20)).withColumns({c: F.lit(1) for c in ("key", "fp", "mark", "root", "a.b", "h", "words", "kept")})
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, repeated, "").columns == repeated.columns, name
    assert corpus_pipeline.near_duplicates(spark, repeated, "").count() <= 20


def test_run_gives_the_pieces_of_what_was_kept(spark, docs):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "length", "sequence_id", "offset"} <= set(out.columns)
    step = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        step = stage(spark, step, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in step.collect()}
    sizes = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 1024 for r in sizes)
