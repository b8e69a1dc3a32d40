"""Cases of the review: wrappers, lines of a host, small shards."""

import numpy as np

from freshet.llm import quality, topk, wrappers

PAGES = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in wrappers.extract_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}


def test_constant_nodes_within_an_article_are_template(spark):
    page = "<nav>{n}</nav><article><h1>T{n}</h1><div class=box>Read our paper</div><p>Words {n}</p></article>"
    got = texts(spark, [(i, f"http://a.example/{i}", page.format(n=i)) for i in range(5)])
    assert all(got[i] == f"T{i}\nWords {i}" for i in range(5))


def test_pages_without_an_article_beside_pages_with_one(spark):
    rows = [(i, None, f"<article><p>Article {i}</p></article><div class=foot>F{i}</div>") for i in range(4)]
    rows += [(10 + i, None, f"<div class=story><p>Story {i}</p></div>") for i in range(4)]
    got = texts(spark, rows)
    assert all(got[i] == f"Article {i}" and got[10 + i] == f"Story {i}" for i in range(4))


def test_copies_of_a_page_count_once(spark):
    rows = [(i, f"http://b.example/{i}", f"<nav>{i}</nav><div class=story><p>One and the same</p></div>") for i in range(6)]
    rows += [(10 + i, f"http://c.example/{i}", "<article><p>Copied</p></article>") for i in range(6)]
    got = texts(spark, rows)
    assert all(got[i] == "One and the same" and got[10 + i] == "Copied" for i in range(6))


def test_lines_shared_with_other_shared_lines(spark):
    shared = [f"shared line number {k} of this host" for k in range(10)]
    rows = [(i, "\n".join([*shared, " ".join(f"own{i}x{j}" for j in range(60))]), "hot") for i in range(100)]
    rows += [(1000 + i, "\n".join(" ".join(f"copy{k}y{j}" for j in range(20)) for k in range(4)), "hot") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in quality.clean_lines(docs).collect()}
    assert len(got) == 140 and not any("shared" in t for t in got.values())
    assert all(got[1000 + i].count("\n") == 3 for i in range(40))  # exact copies count once


def test_topk_of_exactly_k_rows_in_a_shard(spark):
    x = np.random.default_rng(3).normal(size=(20, 4)) + 0.5
    whole = np.floor(x * 64).astype(int)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, "key % 5 = 0").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (0, 5, 10, 15):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(20) if i != q)
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def brute_top(vectors, keys, queries, k):
    whole = [[int(np.floor(x * 64)) for x in v] for v in vectors]
    out = {}
    for q in queries:
        same = [(-sum(a * b for a, b in zip(whole[q], whole[i])), keys[i] is None, keys[i] or 0, i) for i in range(len(keys)) if i != q and len(whole[i]) == len(whole[q])]
        out[keys[q]] = [(n + 1, None if last else key, -s) for n, (s, last, key, _) in enumerate(sorted(same)[:k])]
    return out


def test_topk_prunes_cells_and_stays_exact(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6)) * 40
    vectors = [centres[i % 12] + rng.normal(size=6) * 0.3 for i in range(900)] + [centres[3]] * 500 + [rng.normal(size=9) for _ in range(150)]
    keys = [None if i % 97 == 5 else i for i in range(len(vectors))]
    df = spark.createDataFrame([(k, v.tolist(), 1, 2) for k, v in zip(keys, vectors)], "vec_id long, embedding array<double>, cell long, uid long")
    got = {}
    for r in topk.top_k(df, "key % 20 = 0", shard_rows=32, block_rows=8, sample_rows=300, most_cells=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_top(vectors, keys, [i for i, k in enumerate(keys) if k is not None and k % 20 == 0], 20)
    assert got.keys() == want.keys()
    assert all(sorted(got[q]) == want[q] for q in want)


def test_topk_repeated_keys(spark):
    rng = np.random.default_rng(9)
    vectors = [rng.normal(size=3).round(2) for _ in range(60)]
    keys = [i // 2 for i in range(60)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, vectors)], "vec_id long, embedding array<double>")
    rows = topk.top_k(df, "key % 10 = 0", k=5).collect()
    want = []
    for q in (i for i in range(60) if keys[i] % 10 == 0):
        own = brute_top(vectors, keys, [q], 5)
        want += [(keys[q], *x) for x in own[keys[q]]]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows) == sorted(want)


def test_cells_of_equal_and_few_rows():
    same = topk.Cells.grow(np.ones((100, 3)), 10)
    assert len(same.centres) == 1 and (same.of(np.ones((5, 3)))[1] == 0).all()
    half = topk.Cells.grow(np.concatenate([np.zeros((90, 2)), np.arange(20.0).reshape(10, 2)]), 8, least_rows=2)
    cell, away = half.of(np.zeros((3, 2)))
    assert len(set(cell.tolist())) == 1 and (away >= 0).all()
