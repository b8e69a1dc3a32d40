"""HTML extraction: no article elements, odd markup, very deep and unclosed pages."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from freshet.llm import wrappers

PAGES = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in wrappers.extract_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}


def article_of(page):
    """Brute force for the driver's pages: what stands in the one article element, block by block."""
    inner = re.search(r"(?s)<article>(.*)</article>", page)[1].replace("<b>", "").replace("<br>", " ")
    blocks = (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(x for x in blocks if x)


@pytest.mark.parametrize("name", ["article", "div", 'div class="market-share"'])
def test_pages_by_brute_force_whatever_the_tag(spark, name):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    renamed = df.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<article>", f"<{name}>"), "</article>", f"</{name.split()[0]}>"))
    got = {r.page_id: r.text for r in wrappers.extract_text(renamed).collect()}
    assert all(got[r.page_id] == article_of(r.html) for r in df.collect())


def test_hosts_without_any_article(spark):
    first = "<div class=top>Site of {h}</div><div class=story><h2>T{n}</h2><p>Words {n} &lt;b&gt;</p><div class=plug>Buy our book</div><p>More {n}</p></div><div class=box>Always</div>"
    second = "<table><tr><td>Home</td><td><p>Row {n}</p><ul><li>one {n}<li>two {n}</ul></td></tr></table><div class=comment-list><p>me {n}</p></div>"
    rows = [(i, f"http://a.example/{i}", first.format(h="a", n=i)) for i in range(8)] + [(10 + i, f"http://b.example/{i}", second.format(n=i)) for i in range(8)]
    got = texts(spark, rows + rows[:1])
    assert all(got[i] == f"T{i}\nWords {i} <b>\nMore {i}" for i in range(8))
    assert all(got[10 + i].endswith(f"Row {i}\none {i}\ntwo {i}") and "me" not in got[10 + i] for i in range(8))


def test_words_of_class_names_are_read_whole(spark):
    names = {"market-share": True, "header-story": True, "cookie-notice": False, "site-header": False, "siteFooter": False, "ad slot": False, "advert": False, "story-12": True}
    rows = [(i, f"http://h{i}.example/", f"<body class=has-sidebar><div class='{name}'><p>kept</p></div>") for i, name in enumerate(names)]
    got = texts(spark, rows)
    assert [got[i] == "kept" for i in range(len(names))] == list(names.values())


def test_odd_markup(spark):
    rows = [
        (1, None, "<p title=it's>Hello <b>there</b></p><p>it's</p>"),
        (2, None, "<p data-x=\"a>b\">one</p><!-- <p>no</p> --><p>two<!--> three</p></><p>4 < 5 <"),
        (3, None, "<p>before</p><a href='unclosed"),
        (4, None, "<script>if (a </scripty) '</p>'</SCRIPT ><p>after</p><style>p{}"),
        (5, None, "<p>&nbsp;a&#32;&#x41;&eacute;\t\n b </p>"),
    ]
    got = texts(spark, rows)
    assert got == {1: "Hello there\nit's", 2: "one\ntwo three\n4 < 5 <", 3: "before", 4: "after", 5: "a Aé b"}


@pytest.mark.parametrize("source", ["<div>" * 20_000 + "deep", "<a " * 350_000, "<div>" * 20_000 + "</p></b></section>" * 20_000, "<!--" * 250_000, "<p>a</p><h2>b</h2>" * 10_000, "<p>" + "word " * 400_000])
def test_deep_unclosed_and_very_long_pages(source):
    began = time.process_time()
    task = wrappers.Induction()
    task.add("h", source)
    text = wrappers.Extractor().text(wrappers.merged([wrappers.json.dumps(task.wrappers["h"].packed())]), source)
    assert text.startswith(("deep", "a\nb", "word word")) or not text
    assert time.process_time() - began < 5


def test_matching_by_brute_force():
    import random

    rng = random.Random(4)

    def tree(depth):
        return wrappers.Node(rng.choice("abc"), [tree(depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)])

    def size(a, b):
        if a.label != b.label:
            return 0
        best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids):
            for j, y in enumerate(b.kids):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size(x, y))
        return 1 + best[-1][-1]

    for _ in range(400):
        a, b = tree(4), tree(4)
        b.label = a.label
        where = wrappers.aligned(a, b)
        assert len(where) == size(a, b)
        nodes = {id(n): n for n in b.walk()}
        assert all(nodes[k].label == n.label for k, n in where.items())
        assert wrappers.aligned(a, b, most_steps=0).keys() <= nodes.keys()
        before, after = len(list(a.walk())), len(list(b.walk()))
        merged = wrappers.merge(a, b)
        assert len(merged) == after and len(list(a.walk())) == before + after - len(where)
        again = wrappers.Node.unpacked(a.packed())
        assert again == a


def plain_lcs(xs, ys):
    """Length of the longest common subsequence, by the bits of whole numbers."""
    at = {}
    for i, x in enumerate(xs):
        at[x] = at.get(x, 0) | 1 << i
    every = (1 << len(xs)) - 1
    row = every
    for y in ys:
        met = row & at.get(y, 0)
        row = (row + met | row - met) & every
    return len(xs) - row.bit_count()


def test_long_lists_of_children_are_matched_whole():
    import random

    rng = random.Random(8)
    xs, ys = (rng.choices("abcde", k=n) for n in (2300, 2600))  # six million pairs
    a, b = (wrappers.Node("#", [wrappers.Node(x) for x in kids]) for kids in (xs, ys))
    assert len(wrappers.aligned(a, b)) == 1 + plain_lcs(xs, ys)


def test_matching_is_the_same_at_any_number_of_steps():
    import random

    rng = random.Random(9)

    def tree(depth):
        return wrappers.Node(rng.choice("abc"), [tree(depth - 1) for _ in range(rng.randint(0, 9) if depth else 0)])

    for _ in range(60):
        a, b = tree(3), tree(3)
        b.label = a.label
        want = {k: id(n) for k, n in wrappers.aligned(a, b).items()}
        for steps in (0, 7, 40):
            assert {k: id(n) for k, n in wrappers.aligned(a, b, most_steps=steps).items()} == want
