"""Revisits by either join, with clashing columns, null keys and hot digests."""

import hashlib

from freshet.llm import warc


def test_revisits_are_the_same_by_either_join(spark):
    long, other = "<p>" + "x" * 200, "y" * 100
    rows = [(i, "u", long if i % 3 == 0 else "" if i % 3 == 1 else other if i < 30 else f"{i}" * 60) for i in range(90)] + [(None, None, long), (None, "u", None), (5, "u", other)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, first long")
    found = []
    for most in (200_000, 0):
        got = warc.with_revisits(df, "page_id", "url", "html", broadcast_rows=most).collect()
        found.append(sorted((str(r.key), r.digest, r.payload_bytes, r.refers_to) for r in got))
    want = []
    for key, _, text in rows:
        first = {long: 0, other: 2}.get(text)
        data = (text or "").encode()
        want.append((str(key), hashlib.sha256(data).hexdigest(), len(data), first if first is not None and key != first else None))
    assert found[0] == found[1] == sorted(want, key=lambda r: (r[0], r[1], r[2]))
