"""Benchmark decontamination by winnowing, in DataFrame operations only.

A-Z are lower-cased; words are runs of digits, letters a-z and characters beyond ASCII.  A window is `WINDOW` consecutive words of a benchmark
item; an item of fewer words, but not none, is one window.  A document word inside any occurrence of a window is hit.

Winnowing: of each window, the least hash of its `GRAM`-word grams is its fingerprint, so equal windows have equal fingerprints and every shared
span of a window's length is found.
1. Documents' fingerprints are joined with the benchmark's, which are broadcast while there are at most `BROADCAST_ROWS` (they do not grow with
   the documents); beyond that both sides are shuffled.
2. Hits are extended: windows with a shared fingerprint are joined with the benchmark's windows word by word (equality of the text, not of a
   hash), and the words of all occurrences are united.

Null or empty texts have no words: never hit, and such items have no windows.  Rows with equal doc_id and equal text count as one document; rows
with one doc_id, or none, and different texts are different documents.  An item with a null item_id hits words but is not listed.  Items of one wording are
matched once.  Extra columns are not looked at.  An empty benchmark hits nothing; empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.base import id_of, row_key, shown_id, staged, without

WINDOW, GRAM = 10, 5
BROADCAST_ROWS = 500_000             # windows of the benchmark up to which its fingerprints (8 bytes each) are broadcast
_MARK = -(1 << 63)
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _small(word: Column) -> Column:
    """A-Z lower-cased, no other letter: lower() where the word is ASCII, which is fast."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _BREAK), "")


def _let(value: Column, fn) -> Column:
    """fn(value) with the value computed once a row, also where fn uses it inside a lambda."""
    return F.transform(F.array(value), fn)[0]


def _each(array: Column, length: int, fn) -> Column:
    """fn(slice) for each run of `length` neighbours of the array, in order."""
    def runs(a: Column) -> Column:
        n = F.size(a) - length + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: fn(F.slice(a, i, length)))).otherwise(F.array().cast("array<bigint>"))

    return _let(array, runs)


def _prints(hashes: Column, length: int) -> Column:
    """Fingerprint of each window of `length` words: the least gram hash in it.  Short windows are a single gram."""
    gram = GRAM if length == WINDOW else length
    grams = _each(hashes, gram, F.xxhash64)
    return grams if gram == length else _each(grams, length - gram + 1, F.array_min)


def _windows(df: DataFrame, lengths: list[int]) -> DataFrame:
    """(columns of df, length, start, fp, window text) of all windows; df has words (lower-cased)."""
    hashed = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    out = None
    for n in lengths:
        w = hashed.select(*[c for c in df.columns if c != "words"], "words", F.lit(n).alias("length"), F.posexplode(_prints(F.col("h"), n)).alias("start", "fp"))
        w = w.withColumn("window", F.concat_ws(" ", F.slice("words", F.col("start") + 1, n))).drop("words")
        out = w if out is None else out.unionByName(w)
    return out


def _one_pass(docs: DataFrame, prints: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, row, n_words, length, start, window): a row without a window for each row of docs, and a row for each window with a shared fingerprint.

    The fingerprints of the benchmark are broadcast; a document's windows meet them where they are made, and only matches are spelt out."""
    out = None
    for k, n in enumerate(lengths):
        raw = docs.select("doc_id", "row", _words("text").alias("raw"))
        mark = F.array(F.lit(_MARK)) if k == 0 else F.array().cast("array<bigint>")        # comes last and stands for the document itself
        hashed = F.transform("raw", lambda w: F.xxhash64(_small(w)))
        rows = raw.select("doc_id", "row", "raw", F.posexplode(F.concat(_prints(hashed, n), mark)).alias("start", "fp"))
        own = prints.where(F.col("length") == n).select("fp").unionByName(docs.sparkSession.createDataFrame([(_MARK,)], "fp bigint")).distinct()
        rows = rows.join(F.broadcast(own), "fp")
        last = F.col("start") > F.size("raw") - n
        window = F.when(~last, F.concat_ws(" ", F.transform(F.slice("raw", F.col("start") + 1, n), _small)))
        rows = rows.select("doc_id", "row", F.when(last, F.size("raw")).alias("n_words"), F.lit(n).alias("length"), "start", window.alias("window"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _two_passes(docs: DataFrame, prints: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for a benchmark too large to broadcast: a document's different fingerprints are shuffled, then the texts of documents that share one."""
    hashed = docs.select("doc_id", "row", F.transform(_words("text"), lambda w: F.xxhash64(_small(w))).alias("h"))
    found = None
    for n in lengths:
        f = hashed.select("doc_id", "row", F.size("h").alias("n_words"), F.explode_outer(F.array_distinct(_prints(F.col("h"), n))).alias("fp"))
        f = f.join(prints.where(F.col("length") == n).select("fp", F.lit(1).alias("shared")), "fp", "left").groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.max("shared").alias("shared"))
        found = f if found is None else found.unionByName(f)
    found = staged(found)
    maybe = found.where("shared = 1").select("doc_id", "row").distinct()
    texts = docs.join(maybe, ["doc_id", "row"], "left_semi").select("doc_id", "row", F.transform(_words("text"), _small).alias("words"))
    near = _windows(texts, lengths).join(prints, ["length", "fp"], "left_semi").select("doc_id", "row", F.lit(None).cast("int").alias("n_words"), "length", "start", "window")
    return found.select("doc_id", "row", "n_words", F.lit(None).cast("int").alias("length"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("window")).unionByName(near)


def hits(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, row, n_words, n_hit, items array of item ids as strings, sorted): one row for each document (doc_id, row as base.row_key)."""
    spark, document = docs.sparkSession, ["doc_id", "row"]
    docs = docs.select(id_of("doc_id").alias("doc_id"), row_key().alias("row"), "text")
    items = (benchmark.select("item_id", F.transform(_words("text"), _small).alias("words")).where(F.size("words") > 0)
             .groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids")))
    items = staged(items.select(F.xxhash64("words").alias("wording"), "words", "ids"))
    lengths = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect())        # at most WINDOW values
    if lengths:
        own = [_windows(items.where(F.size("words") >= WINDOW if n == WINDOW else F.size("words") == n), [n]) for n in lengths]
        windows = own[0]
        for w in own[1:]:
            windows = windows.unionByName(w)
        windows = staged(windows.select("wording", "ids", "length", "fp", "window").distinct())
    else:
        windows = spark.createDataFrame([], "wording bigint, ids array<string>, length int, fp bigint, window string")
    prints = windows.select("length", "fp").distinct()

    if not lengths:
        found = docs.groupBy(document).agg(F.max(F.size(_words("text"))).alias("n_words"))
        return found.select(shown_id("doc_id").alias("doc_id"), "row", F.col("n_words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    if windows.count() <= broadcast_rows:
        near = _one_pass(docs, prints, lengths)
    else:
        near = _two_passes(docs, prints, lengths)
    near = staged(near)
    found = near.where("window IS NULL").groupBy(document).agg(F.max("n_words").alias("n_words"))
    places = near.where("window IS NOT NULL").join(windows.select("length", "window").distinct(), ["length", "window"]).select(*document, "start", "length", "window").distinct()
    places = staged(places)

    # unite the occurrences: what each adds beyond the ends before it
    edges = places.groupBy(document).agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("at"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    n_hit = F.aggregate("at", zero, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(x["start"], a["end"]))).alias("n"), F.greatest(a["end"], x["start"] + x["length"]).alias("end")))["n"]
    listed = (places.join(windows.select("length", "window", "wording", "ids"), ["length", "window"]).select(*document, "wording", "ids").distinct()
              .groupBy(document).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items")))
    hit = edges.select(*document, n_hit.alias("n_hit")).join(listed, document)
    out = found.join(hit, document, "left")
    return out.select(shown_id("doc_id").alias("doc_id"), "row", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns of `hits`."""
    return hits(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                                        (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark window; null and empty texts stay, and so do rows that share only their doc_id with such a document."""
    return without(docs, hits(docs, benchmark).where("n_hit > 0").select(id_of("doc_id").alias("doc_id"), "row"))


#: The same question for DuckDB: all windows of both sides, joined on their words.
SQL = r"""
WITH dw AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (
    SELECT item_id, least(10, len(w)) AS n, list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' ')) AS g FROM bw WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, unnest(g) AS g FROM items),
spans AS (
    SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
    FROM dw, (SELECT DISTINCT n FROM items) WHERE len(w) >= n),
found AS (SELECT doc_id, n, i, item_id FROM spans JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM found)) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT dw.doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
