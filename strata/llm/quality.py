"""Quality rules with cross-document line frequency.

Every document gets word, symbol, repeated-line and repeated-window counts and the base
verdict from them.  Lines are normalised (ASCII lower case, words joined by one space) and
hashed (SHA-256, cut to 128 bits), and for each host (``source``) the distinct documents with a
line are counted; copies of one text are one document.  A line above the limits (see
``above``) is boilerplate there, however long it is, and is removed from every document of the
host.  A document that keeps less than ``LEFT`` percent of its words is depleted and rejected.

Null text counts as empty (no words: base_failed); null hosts are one host, that of empty
names; equal rows get equal results; ids may be null or repeat; texts and lines of any length
are taken whole; an empty table gives no rows.  Other columns are ignored, or kept by ``cleaned``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import text as tx

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
SYMBOLS = "#*$%&|<>"
MOST_DOCS = 5
LEFT = 20
#: Rows up to which the table of boilerplate lines is broadcast (under 100 bytes each, and a host's name).
BROADCAST_ROWS = 100_000
#: Parts that the rows of one text, or of one line of a host, are dealt over.
SALTS = 64

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = f"doc_id long, host string, text_key binary, {', '.join(c + ' long' for c in COUNTS)}, lines array<struct<line:binary,words:int>>"
_SYMBOL = np.isin(np.arange(256), [*map(ord, SYMBOLS)])


class Lines:
    """Lines of a block that have a word: their place, text, number of words and normalised digest."""

    def __init__(self, block: tx.Block, words: tuple[np.ndarray, np.ndarray, np.ndarray]):
        starts = words[0]
        feeds = np.flatnonzero(block.cps == 10)
        begin, end = np.append(0, feeds + 1), np.append(feeds, len(block.cps))
        a, b = np.searchsorted(starts, begin), np.searchsorted(starts, end)
        has = b > a
        self.begin, self.end, a, b = begin[has], end[has], a[has], b[has]
        self.words = b - a
        self.text = np.searchsorted(block.end, self.begin)
        data, first, last = block.spaced(lower=True)
        self.digest = tx.digests(data, first[a], last[b - 1])


def _binary(digests: np.ndarray) -> pa.Array:
    """Digests as a column of 16 bytes each."""
    data = np.ascontiguousarray(digests, "<u8").tobytes()
    at = np.arange(0, len(data) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(digests), [None, pa.py_buffer(at), pa.py_buffer(data)])


def _duplicates(block: tx.Block, lines: Lines) -> np.ndarray:
    """For each text, its lines that equal an earlier one, character by character."""
    h = tx.ROLL.ranges(tx.ROLL.prefix(tx.char_values(block.cps)), lines.begin, lines.end)
    maybe = np.flatnonzero(tx.repeated(h ^ tx.mix(lines.text + 1)))
    seen, out = set(), np.zeros(len(block.texts), np.int64)
    for t, a, b in zip(lines.text[maybe].tolist(), lines.begin[maybe].tolist(), lines.end[maybe].tolist()):
        n = len(seen)
        seen.add((t, block.joined[a:b]))
        out[t] += len(seen) == n
    return out


def _repeats(block: tx.Block, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Mask of the words in windows that stand twice or more in their text."""
    starts, ends, before = words
    word = tx.ROLL.ranges(tx.ROLL.prefix(tx.char_values(block.cps)), starts, ends)
    first, text = tx.windows(before, WINDOW)
    maybe = np.flatnonzero(tx.repeated(tx.ROLL2.ranges(tx.ROLL2.prefix(word), first, first + WINDOW) ^ tx.mix(text + 1)))
    if not len(maybe):
        return np.zeros(len(starts), bool)
    first, text = first[maybe], text[maybe]
    data, a, b = block.spaced()
    order, begin = tx.distinct_rows([text, *tx.digests(data, a[first], b[first + WINDOW - 1]).T])
    size = np.diff(np.append(begin, len(order)))
    return tx.covered(len(starts), first[order[np.repeat(size > 1, size)]], WINDOW)


def _stats(block: tx.Block) -> tuple[list[np.ndarray], pa.Array]:
    c, n = block.cps, len(block.texts)
    words = starts, ends, before = block.words()

    def per_text(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        s = np.append(0, np.cumsum(x, dtype=np.int64))
        return np.diff(s[at])

    n_words = np.diff(before)
    word_chars = per_text(ends - starts, before)
    symbols = np.append(0, np.cumsum(_SYMBOL[np.minimum(c, 255)], dtype=np.int64))
    n_symbols = symbols[block.end] - symbols[block.start]
    lines = Lines(block, words)
    counts = [n_words, word_chars, n_symbols, _duplicates(block, lines), per_text(_repeats(block, words), before)]
    order, at = tx.distinct_rows([lines.text, *lines.digest.T])
    total = np.add.reduceat(lines.words[order], at) if len(at) else lines.words
    one = order[at]
    upto = np.append(0, np.cumsum(np.bincount(lines.text[one], minlength=n)))
    pairs = pa.StructArray.from_arrays([_binary(lines.digest[one]), pa.array(total.astype(np.int32))], ["line", "words"])
    return counts, pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pairs)


def _host() -> F.Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _text_key() -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def statistics(docs: DataFrame) -> DataFrame:
    """``STATS`` of every row, computed once and kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in tx.blocks(batch.column(3)):
                counts, lines = _stats(block)
                own = [batch.column(k).slice(first, len(block.texts)) for k in range(3)]
                columns = [*own, *(pa.array(x.astype(np.int64)) for x in counts), lines]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "host", "text_key", *COUNTS, "lines"])

    rows = docs.select(F.col("doc_id").cast("long"), _host().alias("host"), _text_key().alias("text_key"), F.col("text").cast("string"))
    return scratch.written(rows.mapInArrow(run, STATS), "quality-stats")


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def above(n_docs: F.Column, host_docs: F.Column | None, most_docs: int = MOST_DOCS, share: float | None = None) -> F.Column:
    """Whether a line in ``n_docs`` documents of a host of ``host_docs`` is above the limits: the lesser of
    ``most_docs`` documents and, with ``share``, that percentage of the host's (one document at least).
    The limit never grows beyond ``most_docs``, however large the host."""
    over = n_docs > most_docs
    return over if share is None else over | ((n_docs > 1) & (100 * n_docs > share * host_docs))


def _salt(column: str) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _lines(stats: DataFrame) -> DataFrame:
    """host, text_key, line, words, salt: the lines of each text of a host, once."""
    line = stats.select("host", "text_key", F.explode("lines").alias("x")).select("host", "text_key", "x.line", "x.words")
    return line.distinct().withColumn("salt", _salt("text_key"))


def removals(stats: DataFrame, most_docs: int = MOST_DOCS, share: float | None = None) -> DataFrame:
    """host, text_key, removed_words, removed_lines of the texts that lose lines.  Copies of a text are
    merged before anything is grouped by line; a line's documents are counted, and joined, in
    ``SALTS`` parts, so a line that most documents of a host share is in no one task."""
    line = _lines(stats)
    parts = scratch.written(line.groupBy("host", "line", "salt").agg(F.count("*").alias("n")), "quality-lines")
    counts = parts.groupBy("host", "line").agg(F.sum("n").alias("n_docs"))
    if share is None:
        bad = counts.filter(above(F.col("n_docs"), None, most_docs))
    else:
        texts = stats.select("host", "text_key").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
        bad = counts.join(texts, "host").filter(above(F.col("n_docs"), F.col("host_docs"), most_docs, share))
    bad = scratch.written(bad.select("host", "line"), "boilerplate")
    if bad.count() <= BROADCAST_ROWS:
        hit = line.join(F.broadcast(bad), ["host", "line"])
    else:
        hit = line.join(parts.join(bad, ["host", "line"]).select("host", "line", "salt"), ["host", "line", "salt"])
    return hit.groupBy("host", "text_key").agg(F.sum("words").cast("long").alias("removed_words"), F.collect_list("line").alias("removed_lines"))


def _dealt(stats: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (a row for each host and text_key) once for each part that rows of the text are in."""
    have = stats.select("host", "text_key", _salt("doc_id").alias("salt")).distinct()
    return have.join(found, ["host", "text_key"])


def verdicts(stats: DataFrame, most_docs: int = MOST_DOCS, share: float | None = None, left: float = LEFT) -> DataFrame:
    """Every row of ``stats`` with removed_words, removed_lines, base_failed and kept."""
    gone = scratch.written(removals(stats, most_docs, share), "quality-removals")
    rows = stats.drop("lines").withColumn("salt", _salt("doc_id"))
    out = rows.join(_dealt(stats, gone), ["host", "text_key", "salt"], "left").drop("salt")
    removed = F.coalesce(F.col("removed_words"), F.lit(0).cast("long"))
    depleted = 100 * (F.col("n_words") - removed) < left * F.col("n_words")
    return out.withColumns({"removed_words": removed, "base_failed": base_failed(), "kept": ~base_failed() & ~depleted})


def cleaned(docs: DataFrame, most_docs: int = MOST_DOCS, share: float | None = None, left: float = LEFT) -> DataFrame:
    """The documents that are kept, without their boilerplate lines; columns as before (n_chars, where
    there is one, follows the text)."""
    cols, schema = docs.columns, docs.schema
    host, key, salt, kept, lines = scratch.fresh(docs, "_host", "_key", "_salt", "_kept", "_lines")
    stats = statistics(docs)
    found = verdicts(stats, most_docs, share, left).filter(~F.col("kept") | F.col("removed_lines").isNotNull())
    one = found.withColumn("salt", _salt("doc_id")).groupBy("host", "text_key", "salt")
    found = scratch.written(one.agg(F.first("kept").alias(kept), F.first("removed_lines").alias(lines)), "quality-verdicts")
    found = found.withColumnsRenamed({"host": host, "text_key": key, "salt": salt})
    own = docs.withColumns({host: _host(), key: _text_key(), salt: F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(SALTS)).cast("int")})
    rows = own.join(found, [host, key, salt], "left").filter(F.coalesce(F.col(kept), F.lit(True)))
    at = cols.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, bad in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                block, bad = tx.Block([text]), set(bad)
                has = Lines(block, block.words())
                gone = {a for a, d in zip(has.begin.tolist(), _binary(has.digest).to_pylist()) if d in bad}
                begins, left = 0, []
                for line in text.split("\n"):
                    if begins not in gone:
                        left.append(line)
                    begins += len(line) + 1
                texts.append("\n".join(left))
            out = [batch.column(k) for k in range(len(cols))]
            out[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(out, cols)

    whole = rows.filter(F.col(lines).isNull()).select(*cols)
    changed = rows.filter(F.col(lines).isNotNull()).select(*cols, lines).mapInArrow(cut, schema)
    if "n_chars" in cols:
        changed = changed.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return whole.unionByName(changed.select(*cols))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(statistics(scratch.documents(spark, sf_dir)))
    return out.select("doc_id", *COUNTS, "base_failed", "kept")


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS k FROM documents
), texts AS (
  SELECT k, any_value(t) AS t FROM d GROUP BY k
), w AS (
  SELECT k, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM texts
), win AS (
  SELECT k, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}
), keyed AS (
  SELECT k, i, list_slice(ws, i, i + {WINDOW - 1}) AS win FROM win
), again AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM keyed) WHERE n > 1
), rep AS (
  SELECT k, count(DISTINCT i + j) AS n_repeat FROM again, range(0, {WINDOW}) AS r(j) GROUP BY k
), raw AS (
  SELECT k, unnest(string_split(t, chr(10))) AS line FROM texts
), ln AS (
  SELECT k, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM raw
), dup AS (
  SELECT k, count(*) - count(DISTINCT line) AS n_dup FROM ln WHERE len(ws) > 0 GROUP BY k
), norm AS (
  SELECT k, array_to_string(ws, ' ') AS line, sum(len(ws)) AS words FROM ln WHERE len(ws) > 0 GROUP BY ALL
), host_texts AS (
  SELECT DISTINCT host, k FROM d
), bad AS (
  SELECT host, line FROM host_texts JOIN norm USING (k) GROUP BY host, line HAVING count(*) > {MOST_DOCS}
), removed AS (
  SELECT host, k, sum(words) AS removed FROM host_texts JOIN norm USING (k) JOIN bad USING (host, line) GROUP BY host, k
), stats AS (
  SELECT d.doc_id, d.host, d.k, CAST(len(w.ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (k) LEFT JOIN dup USING (k) LEFT JOIN rep USING (k)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)
    AND NOT (100 * (n_words - coalesce(removed, 0)) < {LEFT} * n_words) AS kept
FROM stats LEFT JOIN removed USING (host, k)
"""
