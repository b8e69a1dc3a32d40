"""Operator 8: quality rules by cross-document line frequency, in SQL functions only.

Lines are normalised (case and white space) and hashed.  For each host the
distinct documents that hold a line are counted, lines in more documents than the limit
are removed, and a document is rejected when too little of it is left.

Exact copies of one document are not distinct documents: a document is known by the hash
of its text.  Near copies are distinct; taking them out is left to the near-duplicate
operators.

Every text is read once.  Its counts and the hashes of its lines are written to the shared
folder, and both the count of the lines and their removal start from there.  The
count is combined by (host, line, document) before anything is dealt by (host, line) alone,
so a line that a third of all documents hold is no heavier than others.

Contract
--------
Null text counts as empty (and fails the base rules); null hosts form one host;
repeated rows are judged alike and all returned; an empty table gives an empty
result; extra columns are kept by ``clean_lines`` and left out by ``line_quality``.
Very long texts stay within one row: nothing is exploded but a row for each line.
Limits: ``max_documents`` distinct documents of a host that may share a line,
``least_left`` the share of words that must be left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, staged

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MAX_DOCUMENTS, LEAST_LEFT = 20, 0.2
LEAST_WORDS, MOST_REPEATED = 50, 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words; an empty array if there is none."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def line_hash(words: Column) -> Column:
    return F.md5(F.lower(F.array_join(words, " ")))


def line_structs(text: Column) -> Column:
    """Hash and number of words of each line that has a word."""
    lines = F.transform(F.split(text, "\n"), lambda x: let(words_of(x), lambda w: F.struct(line_hash(w).alias("h"), F.size(w).alias("words"))))
    return F.filter(lines, lambda x: x["words"] > 0)


def covered(codes: Column, places: Column) -> Column:
    """Words covered by the windows that have an equal neighbour; ``codes`` are sorted."""
    last = F.size(codes) - 1
    hit = F.transform(codes, lambda x, k: F.when(((k > 0) & (x == F.get(codes, k - 1))) | ((k < last) & (x == F.get(codes, k + 1))), F.get(places, k)))
    return let(F.filter(hit, lambda q: q.isNotNull()), lambda q: F.size(F.array_distinct(F.concat(q, F.transform(q, lambda x: x + 1), F.transform(q, lambda x: x + 2)))))


def by_text(words: Column) -> Column:
    """``covered`` of the windows themselves."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("window"), i.alias("at")))
    return let(F.sort_array(windows), lambda s: covered(s["window"], s["at"]))


def by_hash(words: Column, hashes: Column, shift: Column) -> Column:
    """``covered`` of hashes, sorted with their places packed into their low bits.

    Where neighbours with equal hashes are windows of different words, the windows themselves are sorted.
    """

    def of_sorted(packed: Column) -> Column:
        codes = F.transform(packed, lambda x: F.call_function("shiftrightunsigned", x, shift))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1
        places = let(mask, lambda m: F.transform(packed, lambda x: x.bitwiseAND(m).cast("int")))

        def differ(a: Column, b: Column) -> Column:
            return (F.get(words, a) != F.get(words, b)) | (F.get(words, a + 1) != F.get(words, b + 1)) | (F.get(words, a + 2) != F.get(words, b + 2))

        def of_codes(c: Column) -> Column:
            def of_places(q: Column) -> Column:
                clash = F.exists(F.sequence(F.lit(1), F.size(c) - 1), lambda k: (F.get(c, k) == F.get(c, k - 1)) & differ(F.get(q, k), F.get(q, k - 1)))
                return F.when(clash, by_text(words)).otherwise(covered(c, q))

            return let(places, of_places)

        return let(codes, of_codes)

    return let(F.sort_array(F.transform(hashes, lambda x, i: F.call_function("shiftleft", x, shift).bitwiseOR(i.cast("long")))), of_sorted)


def repeated_words(words: Column, hash_of: Callable[..., Column] = F.xxhash64) -> Column:
    """Words that stand in a three-word window found twice or more; exact, hashes only sort.

    If no hash repeats the answer is zero.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: hash_of(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    bits = F.length(F.bin(F.size(words).cast("long")))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(bits, lambda n: by_hash(words, h, n))))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(some)


def base_columns(text: Column) -> dict[str, Column]:
    """Counts of one text."""
    stats = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return {
        "stats": stats,
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def measured(docs: DataFrame, kept: list[Column], text_column: str, host_column: str) -> DataFrame:
    """``kept``, and of each row a number, its host, a hash of its text, its counts and its lines; written to the shared folder."""
    text, host = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (text_column, host_column))
    columns = [c.alias(n) for n, c in base_columns(text).items()]
    rows = docs.select(*kept, host.alias("__host"), F.xxhash64(text).alias("__mark"), line_structs(text).alias("__lines"), *columns)
    return staged(rows.select(F.monotonically_increasing_id().alias("__row"), "*", "stats.*").drop("stats"), "measured")


def frequent_lines(rows: DataFrame, max_documents: int) -> DataFrame:
    """``(__host, h, documents)`` of the lines that stand in more distinct documents of a host than the limit."""
    held = rows.select("__host", "__mark", F.explode("__lines.h").alias("h"))
    return held.groupBy("__host", "h").agg(F.count_distinct("__mark").alias("documents")).where(F.col("documents") > max_documents)


def removed_lines(rows: DataFrame, max_documents: int) -> DataFrame:
    """``(__row, removed_words, removed)`` of the rows that lose lines; ``removed`` holds the lines' hashes."""
    lines = rows.select("__row", "__host", F.explode("__lines").alias("line")).select("__row", "__host", "line.*")
    out = lines.join(frequent_lines(rows, max_documents), ["__host", "h"], "left_semi")
    return out.groupBy("__row").agg(F.sum("words").alias("removed_words"), F.collect_set("h").alias("removed"))


def judged(rows: DataFrame, max_documents: int, least_left: float) -> DataFrame:
    """The measured rows with ``removed_words, removed, base_failed, kept``."""
    joined = rows.join(removed_lines(rows, max_documents), "__row", "left")
    lost = F.coalesce("removed_words", F.lit(0).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = (F.col("n_words") - lost) < least_left * F.col("n_words")
    return joined.withColumns({"removed_words": lost, "base_failed": failed, "kept": ~failed & ~depleted})


def line_quality(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, least_left: float = LEAST_LEFT, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """Counts and verdict of every document, without its text."""
    rows = measured(docs, [F.col(f"`{id_column}`").alias("__key")], text_column, host_column)
    return judged(rows, max_documents, least_left).select(F.col("__key").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")


def clean_lines(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, least_left: float = LEAST_LEFT, text_column: str = "text", host_column: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns, their texts without the removed lines."""
    rows = measured(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")], text_column, host_column)
    kept = judged(rows, max_documents, least_left).where("kept")
    text = F.col("__doc")[text_column]
    left = F.filter(F.split(text, "\n"), lambda x: let(words_of(x), lambda w: (F.size(w) == 0) | ~F.array_contains(F.col("removed"), line_hash(w))))
    cleaned = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(left, "\n"))
    return kept.select(*[cleaned.alias(c) if c == text_column else F.col("__doc")[c].alias(c) for c in docs.columns])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(documents(spark, sf_dir))


#: The same rules with DuckDB's functions.
ORACLE_SQL = {
    "op8_quality": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) t(k) GROUP BY doc_id
), l AS (
  SELECT doc_id, host, mark, line FROM (SELECT doc_id, host, md5(text) AS mark, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id
), lh AS (
  SELECT doc_id, host, mark, md5(regexp_replace(lower(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), '[\x20\x09-\x0D]+', ' ', 'g')) AS h,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM l
), flagged AS (
  SELECT host, h FROM lh GROUP BY host, h HAVING count(DISTINCT mark) > 20
), lost AS (
  SELECT doc_id, sum(words)::BIGINT AS removed_words FROM lh SEMI JOIN flagged USING (host, h) GROUP BY doc_id
), r AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - removed_words) < 0.2::DOUBLE * n_words AS kept
FROM r
""",
}
