"""Operator 4: language identification by nearest centroids.

A text becomes a vector of its letters' one- to three-grams, hashed to
``DIMENSIONS``, with logarithmic counts times inverse document frequency, of
length one.  Each language has several centroids, found by spherical k-means; the
language of the nearest by cosine is predicted, and a text farther from it
than almost all training texts is marked as rejected.

The model is fitted on a bounded sample: ``per_language`` labelled documents of each
language, chosen by hash among those whose key isn't held out.

Contract
--------
Null texts and those without a letter are ``und`` with score 0 and rejected.
Without any labelled document all are ``und``.  Ties go to the language that
sorts first.  Repeated rows are judged alike, null keys count as not held out and
aren't learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .shared import documents, lean, only, sliced

DIMENSIONS = 4096


@functools.cache
def letter_table() -> np.ndarray:
    """For each code point itself if it is a letter, else a space."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    letters = [c for c in range(0x110000) if chr(c).isalpha()]
    table[letters] = letters
    return table


def counts(text: str | None, block: int = 1 << 20) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None if it has no letter."""
    total = np.zeros(DIMENSIONS, dtype=np.int64)
    seen = False
    text = (text or "").lower()
    for at in range(0, len(text), block):
        before = min(at, 2)  # characters that grams of this block begin with; they are counted already
        c = letter_table()[np.frombuffer(text[at - before : at + block].encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        letter = c != 32
        if not letter[before:].any() and not seen:
            continue
        seen = True
        c = c * np.uint32(0x9E3779B1)
        one, two = c, (c[:-1] << np.uint32(5)) ^ (c[1:] * np.uint32(31))
        three = (two[:-1] * np.uint32(0x85EBCA6B)) ^ c[2:] if len(c) > 2 else c[:0]
        for h, own, first in ((one, letter, before), (two, letter[:-1] | letter[1:], max(0, before - 1)), (three, letter[1:-1], 0)):
            h = (h[first:] * np.uint32(0xC2B2AE35)) >> np.uint32(20)
            total += np.bincount(h[own[first:]], minlength=DIMENSIONS)
    return total if seen else None


@dataclass
class Centroids:
    """A fitted model: ``labels[i]`` is the language of centroid ``i``."""

    labels: list[str]
    matrix: np.ndarray
    idf: np.ndarray
    least: dict[str, float]

    def vectors(self, rows: list[np.ndarray]) -> np.ndarray:
        x = np.log1p(np.stack(rows).astype(np.float32)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        lang, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if not self.labels:
            return lang, score, rejected
        for at in range(0, len(texts), 512):
            found = [(i, v) for i, v in ((i, counts(t)) for i, t in enumerate(texts[at : at + 512], at)) if v is not None]
            if not found:
                continue
            near = self.vectors([v for _, v in found]) @ self.matrix.T
            for (i, _), k, s in zip(found, near.argmax(axis=1).tolist(), near.max(axis=1).tolist()):
                lang[i], score[i] = self.labels[k], min(1.0, max(0.0, float(s)))
                rejected[i] = s < self.least[lang[i]]
        return lang, score, rejected


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from mutually distant rows."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centres = x[chosen]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit(rows: list[tuple[str, np.ndarray]], centroids: int = 4) -> Centroids:
    """Fit to ``(language, counts)``."""
    if not rows:
        return Centroids([], np.zeros((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS, np.float32), {})
    present = np.stack([v > 0 for _, v in rows]).sum(axis=0)
    idf = (np.log((1 + len(rows)) / (1 + present)) + 1).astype(np.float32)
    model = Centroids([], np.zeros((0, DIMENSIONS), np.float32), idf, {})
    parts = []
    for language in sorted({x for x, _ in rows}):
        x = model.vectors([v for name, v in rows if name == language])
        centres = cluster(x, centroids)
        parts.append(centres)
        model.labels += [language] * len(centres)
        # well below what training texts have
        model.least[language] = 0.5 * float(np.quantile((x @ centres.T).max(axis=1), 0.01))
    model.matrix = np.concatenate(parts).astype(np.float32)
    return model


def held_out(key):
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_language: int = 300, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Centroids:
    rows = only(docs, key=id_column, text=text_column, lang=lang_column).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")))
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not found:
        return fit([])
    parts = 1 << 30
    share = None
    for language, n in sorted(found.items()):
        most = F.lit(min(parts, int(parts * 2 * per_language / n)))
        share = F.when(F.col("lang") == language, most) if share is None else share.when(F.col("lang") == language, most)
    drawn = F.pmod(F.xxhash64("key"), F.lit(parts))
    sample = rows.withColumn("drawn", drawn).where(F.col("drawn") < share)
    sample = sample.groupBy("key").agg(F.min(F.struct("lang", "text", "drawn")).alias("row")).select("row.*")  # a key counts once, however often it is repeated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, langs, drawn = (batch.column(c).to_pylist() for c in ("text", "lang", "drawn"))
            own = [(lang, d, v.astype("<u4").tobytes()) for t, lang, d in zip(texts, langs, drawn) if (v := counts(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in own], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["lang", "drawn", "counts"])

    # the bound: twice per_language of each language on average, of which per_language are taken
    got = sample.select("text", "lang", "drawn").mapInArrow(lean(run), "lang string, drawn long, counts binary").collect()
    used: dict[str, list[np.ndarray]] = {}
    for r in sorted(got):
        if len(used.setdefault(r["lang"], [])) < per_language:
            used[r["lang"]].append(np.frombuffer(r["counts"], "<u4").astype(np.int64))
    return fit([(lang, v) for lang, rows in sorted(used.items()) for v in rows])


def identify(docs: DataFrame, model: Centroids, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) in one struct ``doc``, and ``lang_pred, score, rejected``."""
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"), F.col(f"`{text_column}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: a few centroids for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lang, score, rejected = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc", "lang_pred", "score", "rejected"])

    schema = StructType([wrapped.schema["doc"], *(StructField(n, t) for n, t in (("lang_pred", StringType()), ("score", DoubleType()), ("rejected", BooleanType())))])
    return wrapped.mapInArrow(lean(run), schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs, train(docs), keep=["doc_id"])
    return out.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
