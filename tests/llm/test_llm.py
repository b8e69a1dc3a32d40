"""The training-data operators against brute force, libraries and exact round trips."""

import gzip
import hashlib
import html
import io
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from freshet.llm import bitpacked, bpe_transducer, language, packing, quality, simhash, topk, urls, warc, wrappers
from freshet.llm.shared import new_folder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n", "a  b", " a", "a ", "x\n\ny c\td", "<|endoftext|> x", "é́ x", "It's  \n don't\n", "日本 語　x", "3.5,x_.y ... a,b.", "x\xa0y\x85z", "ab" * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    rows = [(i, t, None, None, None, 1, 2) for i, t in enumerate(ODD)] + [(4, "a  b", None, None, None, 1, 2), (None, "no key", "en", "s", 6, 1, 2)]
    return spark.createDataFrame(rows, DOCS + ", key int, ids int")


def none(spark):
    return spark.createDataFrame([], DOCS)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_bpe_matches_library_and_round_trips(spark, odd):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=bpe_transducer.PATTERN, mergeable_ranks=bpe_transducer.read_ranks(path), special_tokens={})
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    encoded = bpe_transducer.bpe_encode(docs, path)
    got = {r.doc_id: ids(r.ids) for r in encoded.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(got[k] == library.encode_ordinary(t) for k, t in texts.items())
    decoded = {r.doc_id: r.text for r in bpe_transducer.bpe_decode(encoded, path, block=7).collect()}
    assert decoded == texts
    assert bpe_transducer.bpe_encode(none(spark), path).count() == 0


def test_bpe_round_trip_is_encode_and_decode(spark, odd):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = odd.unionByName(odd)
    both = bpe_transducer.bpe_round_trip(docs, path)
    assert both.columns == ["doc_id", "ids", "data"]
    assert sorted(map(str, both.select("doc_id", "ids").collect())) == sorted(map(str, bpe_transducer.bpe_encode(docs, path).collect()))
    assert sorted(bytes(r.data) for r in both.collect()) == sorted((r.text or "").encode() for r in docs.collect())
    assert bpe_transducer.bpe_round_trip(none(spark), path).count() == 0


def test_transducer_on_random_pieces():
    import tiktoken

    ranks = bpe_transducer.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    machine, library = bpe_transducer.Transducer(ranks, max_states=500), tiktoken.Encoding("t", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
    rng, tokens = random.Random(3), list(ranks)
    for _ in range(1500):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6)))
        assert machine.encode_piece(piece) == library._core_bpe.encode_single_piece(piece)
    piece = b"".join(rng.choice(tokens) for _ in range(30_000))  # states are forgotten within it
    assert len(piece) > 2 * 65536
    assert machine.encode_piece(piece) == library._core_bpe.encode_single_piece(piece)


def test_utf8_stream_holds_unfinished_characters():
    data = "aé日𝄞".encode()
    stream = bpe_transducer.Utf8Stream()
    assert "".join(stream.feed(data[i : i + 1]) for i in range(len(data))) + stream.close() == "aé日𝄞"
    assert bpe_transducer.Utf8Stream().feed(b"\xff") == "�"


def test_utf8_machine_accepts_what_the_codec_does():
    rng = random.Random(6)
    steps = bpe_transducer.utf8_machine()
    for _ in range(20_000):
        data = bytes(rng.choice((0x41, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xDF, 0xE0, 0xED, 0xEF, 0xF0, 0xF4, 0xF5, 0xFF)) for _ in range(rng.randint(0, 5)))
        state = 0
        for byte in data:
            state = steps[state][byte] if state >= 0 else -1
        try:
            data.decode()
            valid = True
        except UnicodeDecodeError:
            valid = False
        assert (state == 0) == valid
        stream, cut = bpe_transducer.Utf8Stream("surrogateescape"), rng.randint(0, len(data))
        assert stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.close() == data.decode("utf-8", "surrogateescape")


def test_topk_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 8)).round(1)
    vectors[50:150] = vectors[7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(500, None), (520, [float("nan")] * 8), (540, [None] * 8), (560, [1.0, 2.0]), (580, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, "key % 20 = 0", shard_rows=64, block_rows=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = np.floor(vectors * 64).astype(int)
    for q in range(0, 300, 20):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(300) if i != q)[:20]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert not {500, 520, 540, 560, 580} & set(got)
    assert topk.top_k(df.limit(0), "key % 20 = 0").count() == 0


def test_packing_is_gapless_and_tight(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = odd.select("doc_id", "text", "key").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit(0).alias("key")))
    rows = packing.pack_documents(docs, path, group_items=64).collect()
    library = Tokenizer.from_file(path)
    want = {}
    for r in docs.collect():
        x = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.setdefault(r.doc_id, []).extend((s, n, zlib.crc32(x[s : s + n].tobytes())) for s, n in packing.cut(len(x), 1024))
    got = {}
    bins = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(bins) <= sum(r.length for r in rows) / 1024 * 1.05 + 6
    assert packing.pack_documents(none(spark), path).count() == 0


def test_cut_leaves_only_the_first_piece_short():
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(1, 1024) == [(0, 1)]


def test_language_on_held_out_documents(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs, per_language=80)
    rows = language.identify(docs, model).select("doc.lang", "lang_pred", language.held_out(F.col("doc.doc_id")).alias("h")).where("h").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    found = language.identify(odd, model).select("doc.text", "lang_pred", "score", "rejected").collect()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in found)
    assert language.identify(odd, language.train(none(spark))).select("lang_pred").distinct().collect()[0][0] == "und"


PAGE = '<html><body><nav><ul><li><a href=/x>{n}</a></li></ul></nav><div class="cookie-notice">ok {n}</div><form><p>search {n}</p></form>{open}<h1>T{n}</h1><p>One &amp; {n}<p><b>two<br>\n three{close}<div id=comments><p>me {n}</p></div><footer>(c) {n}</footer></body></html>'


def test_wrappers_keep_the_article(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(n=i, open="<article>", close="</article>")) for i in range(6)]
    rows += [(10 + i, f"http://b.example/{i}", PAGE.format(n=i, open="<div class=story>", close="</div><div class=box><p>Always the same</p></div>")) for i in range(6)]
    rows += [(20, None, None), (21, "x", "<p>plain"), (22, "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract_text(df).collect()}
    assert all(got[i] == f"T{i}\nOne & {i}\ntwo three" for i in range(6))
    assert all(got[10 + i] == f"T{i}\nOne & {i}\ntwo three" for i in range(6))
    assert got[20] == "" and got[21] == "plain" and got[22] == ""
    assert wrappers.extract_text(df.limit(0)).count() == 0


def test_wrappers_on_pages(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in wrappers.extract_text(df).collect()}
    for r in df.collect():
        inner = re.search(r"(?s)<article>(.*)</article>", r.html)[1].replace("<b>", "").replace("<br>", " ")
        blocks = (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert got[r.page_id] == "\n".join(x for x in blocks if x)


def brute_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(values, bits=4):
    up = list(range(len(values)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_simhash_components(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.where("doc_id IS NOT NULL").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = sorted(simhash.near_duplicates(docs).collect())
    texts = sorted(docs.collect(), key=lambda r: r.doc_id)
    values = [brute_fingerprint(r.text) for r in texts]
    assert [r.fingerprint for r in rows] == [f"{v:016x}" for v in values]
    assert [r.component_id for r in rows] == [texts[i].doc_id for i in brute_components(values)]
    assert simhash.near_duplicates(none(spark)).count() == 0


@pytest.mark.parametrize("leaf_rows,aim", [(8192, 512), (40, 64), (8192, 0)])
def test_vantage_trees_lose_no_link(spark, leaf_rows, aim):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, size=150, dtype=np.int64)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(63, size=rng.integers(0, 6), replace=False)) for c in centres.tolist() * 3]
    hot = [int(centres[0]) ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(i)]
    values = sorted({*near, *hot, 0})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, len(values), leaf_rows, aim)).collect()}
    assert [roots.get(v, v) for v in values] == [values[i] for i in brute_components(values)]


def test_url_rules_and_trees(spark):
    rows = [(1, "http://Example.ORG/es/1"), (2, "https://www.example.org/en/17?x"), (3, "ftp://a.org/"), (4, "http://a.com/fr/"), (5, "http://a.com/de/#f"), (6, "http://badexample.org/es/"), (7, "http://a.net"), (8, None), (9, "no scheme"), (10, "http://a.org"), (11, "http://a.org?q=/"), (1, "http://Example.ORG/es/1")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert got[1] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("www.example.org", "/en/17", "example.org/en/1", "block")
    assert got[3][2:] == ("org/", "allow") and got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6][2:] == ("org/", "allow")
    assert got[7][:3] == ("a.net", "", None) and got[8][:3] == ("", "", None) == got[9][:3] and got[10][2] is None and got[11][:2] == ("a.org", "")
    assert all(v[3] in ("allow", "block") for v in got.values())
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = urls.BoostedTrees().fit(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9


def test_quality_matches_sql(spark, odd):
    import duckdb

    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    line = "this line stands at the foot of every page of the host"
    extra = [(5000 + i, f"{line}\n" + " ".join(f"w{i}x{j}" for j in range(60 if i % 2 else 5)), "en", "hot", 1) for i in range(40)]
    extra += [(6000 + i, "\n".join(" ".join(f"c{k}y{j}" for j in range(20)) for k in range(4)), "en", "hot", 1) for i in range(40)]
    extra += [(i, t, None, None, None) for i, t in enumerate(ODD, 9000)]
    docs = base.unionByName(spark.createDataFrame(extra, DOCS)).coalesce(2)
    frame = quality.line_quality(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    documents = docs.toPandas()
    documents["text"] = documents["text"].astype(object).where(documents["text"].notna(), None)
    c = duckdb.connect()
    c.register("documents", documents)
    want = c.execute(quality.ORACLE_SQL["op8_quality"]).df().sort_values("doc_id").reset_index(drop=True)[frame.columns]
    assert (frame == want).all().all()
    own = frame.set_index("doc_id")
    assert own.loc[5001, "removed_words"] == 12 and own.loc[5001, "kept"] and not own.loc[5000, "kept"]
    assert own.loc[6000, "removed_words"] == 0 and own.loc[6000, "kept"]  # copies are not boilerplate
    cleaned = {r.doc_id: r.text for r in quality.clean_lines(docs).collect()}
    assert sorted(cleaned) == sorted(own.index[own.kept]) and line not in cleaned[5001]
    assert quality.line_quality(none(spark)).count() == 0 and quality.clean_lines(odd).columns == odd.columns


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    x = np.random.default_rng(bits).integers(0, 2**bits, size=1001).astype("<u4")
    assert (bitpacked.unpack_bits(bitpacked.pack_bits(x, bits), len(x), bits) == x).all()


def test_token_files(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    folder = new_folder(spark, "tokens")
    files = bitpacked.write_token_files(odd, folder, path, 1, 49408)
    rows = sorted(bitpacked.read_token_files(spark, files).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(path)
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in odd.collect()], key=lambda k: (k is not None, k))
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in odd.collect()}
    at = 0
    for r in rows:
        assert r.start == at and ids(r.ids) == want[r.doc_id]
        at += len(r.ids) // 4
    one = bitpacked.BitFile(files[-1][0])
    assert one.document(one.n_docs - 1).tolist() == ids(rows[-1].ids)
    hot = spark.createDataFrame([(7, "the same")] * 900 + [(7, f"text {i}") for i in range(300)] + [(3, "first"), (9, None)], "doc_id long, text string").repartition(5)
    files = bitpacked.write_token_files(hot, new_folder(spark, "tokens"), path, 1, 49408)
    assert len(files) > 1 and max(f[1] for f in files) < 700  # a hot key is split
    back = sorted(bitpacked.read_token_files(spark, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == [3] + [7] * 1200 + [9] and ids(back[-1].ids) == [1]
    assert sum(ids(r.ids) == ids(bitpacked.BitFile(files[0][0]).document(1)) for r in back) >= 1
    empty = bitpacked.write_token_files(none(spark), new_folder(spark, "tokens"), path, 1, 49408)
    assert empty == [] and bitpacked.read_token_files(spark, empty).count() == 0


def test_warc_revisits_and_round_trip(spark):
    long = "<p>" + "é" * 200
    rows = [(1, "http://a/ b", "x"), (2, "u", "x"), (7, "u", long), (3, None, long), (9, "u", long), (4, "u", None), (5, "u", "WARC/1.1\r\n\r\n" * 20), (3, None, long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = [r.path for r in warc.write_archives(df.coalesce(2), new_folder(spark, "warc")).collect()]
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, paths).collect())
    want = []
    for key, _, text in rows:
        data = (text or "").encode()
        again = text == long and key != 3
        want.append((key, "revisit" if again else "response", 3 if again else None, len(data), hashlib.sha256(data).hexdigest()))
    assert got == sorted(want)
    for p in paths:  # every record is a gzip member that other tools can read
        with gzip.open(p.removeprefix("file://")) as f:
            assert f.read().startswith(b"WARC/1.1")
    assert warc.write_archives(df.limit(0), new_folder(spark, "warc")).count() == 0


def test_normaliser_splits_a_monolithic_stream():
    records = [warc.record_bytes(i, "u", os.urandom(i * 1000), i * 1000, "d", None) for i in range(5)]
    out = io.BytesIO()
    index = warc.normalise(io.BytesIO(gzip.compress(b"".join(records))), out)
    data = out.getvalue()
    assert [zlib.decompress(data[o : o + n], 31) for o, n, _ in index] == records
    with pytest.raises(EOFError):
        warc.normalise(io.BytesIO(gzip.compress(b"".join(records))[:-20]), io.BytesIO())
