"""Language centroids, URL rules and URL trees against brute force and held-out rows."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import language, urls

M = 2**32


def grams(text):
    """Hashed one- to three-grams, one at a time."""
    found = [0] * language.DIMENSIONS
    c = [ord(x) * 0x9E3779B1 % M if x.isalpha() else None for x in (text or "").lower()]
    space = 32 * 0x9E3779B1 % M
    at = lambda i: space if c[i] is None else c[i]
    two = lambda i: (at(i) << 5) % M ^ at(i + 1) * 31 % M
    for i in range(len(c)):
        keys = [at(i)] if c[i] is not None else []
        if i + 1 < len(c) and (c[i] is not None or c[i + 1] is not None):
            keys.append(two(i))
        if i + 2 < len(c) and c[i + 1] is not None:
            keys.append(two(i) * 0x85EBCA6B % M ^ at(i + 2))
        for h in keys:
            found[(h * 0xC2B2AE35 % M) >> 20] += 1
    return found


def nearest(model, text):
    """Language, cosine and rejection by plain arithmetic."""
    if not any(x.isalpha() for x in text or ""):
        return "und", 0.0, True
    v = [math.log1p(n) * float(w) for n, w in zip(grams(text), model.idf)]
    norm = math.sqrt(sum(x * x for x in v))
    scores = [sum(x * float(y) for x, y in zip(v, row)) / norm for row in model.matrix]
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    return model.labels[best], scores[best], scores[best] < model.least[model.labels[best]]


ODD = [None, "", "12 ...", "ÀÉ", "İstanbul Σίσυφος", "a", "x y", "Привет, мир", "one\ntwo\tthree"]


@pytest.fixture(scope="module")
def model(spark):
    return language.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), per_language=80)


def test_prediction_by_brute_force(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").limit(40).select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    rows = language.identify(docs, model).select("doc.text", "lang_pred", "score", "rejected").collect()
    assert len(rows) >= 20 + len(ODD)
    for r in rows:
        lang, score, rejected = nearest(model, r.text)
        assert (r.lang_pred, r.rejected) == (lang, rejected) and abs(r.score - max(0.0, score)) < 1e-4


def test_blocks_of_a_long_text_count_nothing_twice():
    text = "Zwölf Boxkämpfer, jagen İ Viktor! 12 x" * 9
    whole = language.counts(text)
    assert whole.tolist() == grams(text)
    assert all((language.counts(text, block=n) == whole).all() for n in (1, 2, 3, 7, 50))
    assert language.counts("1234" * 9 + "a", block=4).tolist() == grams("1234" * 9 + "a")
    assert language.counts("ab " * 40_000).max() > 39_000


def test_ties_go_to_the_first_language():
    rows = [(x, language.counts("the same text in both")) for x in ("bb", "aa")]
    assert language.fit(rows).predict(["the same text in both"])[0] == ["aa"]


def test_other_scripts_and_noise_are_rejected(model):
    rng = np.random.default_rng(0)
    noise = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 600))
    foreign = ["Все люди рождаются свободными и равными в своем достоинстве и правах. " * 5, "人人生而自由,在尊严和权利上一律平等。" * 9, "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι. " * 5, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności. " * 5, noise]
    assert model.predict(foreign)[2] == [True] * len(foreign)


def test_clean_documents_are_not_rejected(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) >= 100")
    assert language.identify(docs, model).where("rejected").count() <= 0.002 * docs.count()


def test_training_with_repeated_and_null_keys(spark):
    rows = [(7, "a text of some length", "en")] * 50 + [(None, "ein text", "de")] * 5 + [(k, "un texte de plus", "fr") for k in range(20)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, `a.b` string, drawn string")
    fitted = language.train(docs)
    assert "de" not in fitted.labels and "fr" in fitted.labels
    kept = language.identify(docs, fitted)
    assert kept.count() == len(rows) and kept.select("doc.*").columns == docs.columns
    held = {r.key: r.h for r in docs.select(F.col("doc_id").alias("key"), language.held_out(F.col("doc_id")).alias("h")).distinct().collect()}
    assert all(held[k] == (k is not None and zlib.crc32(str(k).encode()) % 5 == 0) for k in held)


def rule_of(url):
    """Host, path, rule and verdict by hand."""
    url = url or ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups() if "://" in url else ("", "")
    host = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_rules_by_brute_force(spark):
    odd = [None, "", "://", "a://B.ORG/", "x://example.org/es/é", "http://Ä.com/fr/", "http://com/de/", "http://a.com/de", "http://a.b.com/fr/?q://c.org/", "http://u@h.com:80/de/x#y", "http://org", "HTTP://a.org/\n"]
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame([(-i - 1, u) for i, u in enumerate(odd)], "page_id long, url string"))
    want = {r.page_id: rule_of(r.url) for r in rows.collect()}
    got = urls.judge_urls(rows.withColumn("rule", F.lit("clash")).withColumn("blocked", F.lit(1))).collect()
    assert len(got) == len(want)
    for r in got:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_trees_on_held_out_urls(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").distinct().collect()
    judged = [(r.url, *rule_of(r.url)) for r in rows]
    judged = sorted((url, host, path, float(verdict == "block")) for url, host, path, rule, verdict in judged if rule)
    held = [zlib.crc32(x[0].encode()) % 5 == 0 for x in judged]
    frame = spark.createDataFrame([x for x, h in zip(judged, held) if not h], "url string, host string, path string, blocked double")
    lexical, trees = urls.train(frame)
    test = [x for x, h in zip(judged, held) if h]
    found = trees.probability(lexical.matrix([x[:3] for x in test])) >= 0.5
    y = np.array([x[3] for x in test]) > 0
    print("held-out accuracy", (found == y).mean(), len(y), y.mean())
    assert (found == y).mean() > 0.97
    for k in range(0, len(test), 97):  # a batch and single rows are judged alike
        assert (trees.probability(lexical.matrix([test[k][:3]]))[0] >= 0.5) == found[k]


def test_training_sample_is_bounded_and_repeats_count_once(spark):
    rows = [("http://hot.com/de/", "hot.com", "/de/", True)] * 3000 + [(f"http://h{i}.org/{i}", f"h{i}.org", f"/{i}", False) for i in range(500)]
    frame = spark.createDataFrame(rows, "url string, host string, path string, blocked boolean")
    lexical, _ = urls.train(frame, training_rows=10_000)
    assert abs(lexical.prior - 1 / 501) < 1e-9
    small, _ = urls.train(frame, training_rows=50)
    assert len(small.shares[1]) <= 50
