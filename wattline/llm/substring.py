"""Substring dedup with a count-min prefilter.

Words are runs of bytes other than ASCII white space.  A window is `window` consecutive words of one document; every word covered by a window
whose words also start anywhere else (the same document included) is removed, in all copies.  Merged partition sketches overestimate the
counts of windows, through the anchor that equal windows share; a second pass groups exactly the windows that are estimated repeated, so none
is lost (`repeats`).  The second pass groups windows of one anchor by a 64-bit hash of their words; the words themselves are not moved.

Null or empty text: no words, nothing removed, kept text empty.  Fewer words than a window: nothing removed.  Rows with equal doc_id and equal
text are one document (their windows are no copies of each other); rows with one doc_id, or none, and different texts are different documents.
A null doc_id stays null.  Columns other than doc_id and text are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm import words
from wattline.llm.anchors import gram_hashes, mix64
from wattline.llm.base import buffer_of, shown_id, text_input
from wattline.llm.repeats import Plan, covered

ANCHOR_SHARE = 3                     # the anchor of a window of w words has w / 3 words


def _units(b: pa.RecordBatch):
    data, starts, lengths = buffer_of(b.column("text"))
    first, end, text = words.spans(data, starts, lengths)
    n = np.bincount(text, minlength=len(starts)).astype(np.int64)
    return b.column("doc_id").to_numpy(), words.hashes(data, first, end), np.cumsum(n) - n, n


def _plan(window: int) -> Plan:
    def payload(symbols: np.ndarray, first: int, count: int) -> bytes:
        return gram_hashes(symbols[first:first + count + window - 1], window).tobytes()

    def classes(payloads, counts) -> np.ndarray:
        return np.frombuffer(b"".join(payloads), np.uint64)

    def hashes(payload: bytes, count: int):
        h = np.frombuffer(payload, np.uint64)
        return h, mix64(h)

    return Plan(window, max(1, window // ANCHOR_SHARE), _units, payload, classes, hashes, True)


def word_windows(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, row, start, n): word windows start .. start + n - 1 of a document occur elsewhere too.  doc_id null is base.NO_ID."""
    texts = text_input(docs)
    size = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return covered(texts, _plan(window), size // 6)


def remove_repeats(docs: DataFrame, window: int = 35, *more: Column) -> DataFrame:
    """(doc_id, n_words, n_removed, text, more...): one row for each row of docs; text is its kept words joined by one space."""
    spans = (word_windows(docs, window).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
             .select("doc_id", "row", "spans.start", "spans.n"))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            data, starts, lengths = buffer_of(b.column("text"))
            first, end, text = words.spans(data, starts, lengths)
            n = np.bincount(text, minlength=len(starts)).astype(np.int64)
            at = np.cumsum(n) - n
            raw = data.tobytes()
            removed, kept = [], []
            for i, (s, m) in enumerate(zip(b.column("start").to_pylist(), b.column("n").to_pylist(), strict=True)):
                edge = np.zeros(n[i] + 1, np.int64)
                if s:
                    np.add.at(edge, np.minimum(s, n[i]), 1)
                    np.add.at(edge, np.minimum(np.add(s, m) + window - 1, n[i]), -1)
                keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0) + at[i]
                removed.append(int(n[i] - len(keep)))
                kept.append(b" ".join([raw[a:z] for a, z in zip(first[keep].tolist(), end[keep].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), *b.columns[4:]],
                                             ["doc_id", "n_words", "n_removed", "kept", *b.schema.names[4:]])

    texts = text_input(docs, *more)
    extra = texts.columns[3:]
    joined = texts.join(spans, ["doc_id", "row"], "left").select("doc_id", "text", "start", "n", *extra)
    schema = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name in extra)
    out = joined.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept binary" + schema)
    return out.select(shown_id("doc_id").alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("text"), *extra)


def strip(docs: DataFrame, window: int = 35) -> DataFrame:
    """docs with the repeated windows taken out of text, and n_chars, if there, counted anew; documents that lose all words go."""
    others = [c for c in docs.columns if c != "text"]
    out = remove_repeats(docs, window, *[F.col(c).alias(f"_{i}") for i, c in enumerate(others)], F.col("text").alias("_text")).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("_text")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") == 0, F.col(f"_{others.index('n_chars')}")).otherwise(F.char_length("text")) if "n_chars" in others else None
    return out.select(*[text.alias(c) if c == "text" else size.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"_{others.index(c)}").alias(c) for c in docs.columns])


def digest(docs: DataFrame, window: int = 35) -> DataFrame:
    """The contract's columns of `remove_repeats`."""
    return remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: The same question for DuckDB: all windows of all documents, grouped by their words.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
    SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS g
    FROM d WHERE len(w) >= 35),
r AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM s WHERE g IN (SELECT g FROM r)),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = x.doc_id AND gone.p = x.p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
