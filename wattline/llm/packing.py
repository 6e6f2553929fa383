"""Best-fit packing with exact-complement hashing.

A document's tokens are its vocabulary ids followed by an end id.  Only documents longer than `capacity` are cut, into full pieces and a rest.
Pieces are packed whole.  The plan is made on the histogram of lengths, whose size is bounded by the capacity and not by the documents:
from the longest length down, a sequence's gap is filled exactly by one, two or three available lengths (found in an index of single, pair and
triple sums), as often as the scarcest of them allows; lengths without an exact filling are packed best fit, longest first.  Each step uses up
a length or the last filling of one, so the plan has few rows.  Spark then numbers the pieces of each length (a length is dealt over many
buckets, so a hot one is no single group) and every task looks its pieces up in the plan.

Null or empty text: the end id alone.  Repeated rows are packed each for itself.  A null doc_id stays null.  Extra columns are not looked at.  An
empty table gives an empty result.  Texts of any length are handled one at a time.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.base import staged, strings_of

CAPACITY, END_ID = 4096, 1
_REMEMBER = 250_000                  # chunks of text whose ids a worker remembers, twice
_APART, _BEYOND_LATIN = re.compile("[\x1c-\x1f]"), re.compile("[^\x00-\u02ff]")
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
# printable bytes stand for themselves, the others for the characters from U+0100 on, in order
_OTHERS = [c for c in range(256) if not (33 <= c < 127 or 161 <= c < 173 or 174 <= c)]
_BYTE_NAMES = {c: 256 + i for i, c in enumerate(_OTHERS)}


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, exactly as the tokenizer gives them for the whole text.

    The vocabulary of the default file never joins across white space, so ids are put together from the ids of the chunks between white space, which
    are remembered.  A chunk of Latin letters and closing ASCII marks falls into those two parts, and the letters go straight to the vocabulary's
    merges.  Texts with the separators U+001C to U+001F, which Python and the tokenizer tell apart, are encoded whole, and so is everything when
    the file is not of that kind."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}                # chunks met lately, and those met before them
        self.old: dict[str, bytes] = {}
        self.by_chunk = self._splits_at_space(self.tokenizer)

    @staticmethod
    def _splits_at_space(tokenizer) -> bool:
        """Is it the kind of file whose steps this class knows: NFC, white space, lower case; letters apart from marks; bytes; merges by word?"""
        import json

        t = json.loads(tokenizer.to_str())
        steps = (t.get("normalizer") or {}).get("normalizers") or []
        parts = (t.get("pre_tokenizer") or {}).get("pretokenizers") or []
        return ([n.get("type") for n in steps] == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
                and parts[0].get("invert") is True and parts[0].get("behavior") == "Removed" and parts[0].get("pattern", {}).get("Regex", "").endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
                and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex"))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, chunk: str, latin: bool) -> bytes:
        word = chunk.rstrip(_MARKS)
        if not latin or not word.isalpha():
            return self._whole(chunk)
        if len(word) == len(chunk):
            return array("I", [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_NAMES))]).tobytes()
        return self._get(word, latin) + self._get(chunk[len(word):], False)

    def _get(self, chunk: str, latin: bool) -> bytes:
        got = self.known.get(chunk) or self.old.get(chunk)
        if got is None:
            got = self._new(chunk, latin)
        self.known[chunk] = got
        return got

    def __call__(self, text: str) -> bytes:
        if not self.by_chunk or _APART.search(text):
            return self._whole(text)
        latin = "<|" not in text and not _BEYOND_LATIN.search(text)
        chunks = (text.lower() if latin else text).split()
        if len(self.known) > _REMEMBER:
            self.old, self.known = self.known, {}
        for chunk in set(chunks).difference(self.known):
            self._get(chunk, latin)
        return b"".join(map(self.known.__getitem__, chunks))


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary: little-endian unsigned 32-bit]) of each row of docs."""
    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = _encoder(vocabulary), np.asarray([end_id], "<u4").tobytes()
        for b in rows:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
            for doc, text in zip(b.column("doc_id").to_pylist(), strings_of(b.column("text")), strict=True):
                ids = encode(text) + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for name, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if with_ids else []))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
            .mapInArrow(task, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")))


class Complements:
    """Index of the sums of one, two and three available lengths."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.size = counts, len(counts)
        self.refresh()

    def refresh(self) -> None:
        """Which sums two available lengths can make; lengths only run out, so an old answer errs towards yes."""
        have = self.counts > 0
        at = np.flatnonzero(have)
        self.pairs = np.zeros(self.size, bool)
        for a in at.tolist():
            self.pairs[a:] |= have[:self.size - a]

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two available lengths of this sum, the most unequal first."""
        a = np.arange(1, total // 2 + 1)
        ok = np.flatnonzero((self.counts[a] > 0) & (self.counts[total - a] > 0) & ((2 * a != total) | (self.counts[a] > 1)))
        return (int(a[ok[0]]), total - int(a[ok[0]])) if len(ok) else None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """Lengths that fill the gap exactly: one, else two, else three."""
        if self.counts[gap] > 0:
            return (gap,)
        if not self.pairs[gap]:
            return self._triple(gap)
        return self.pair(gap) or self._triple(gap)

    def _triple(self, gap: int) -> tuple[int, ...] | None:
        first = np.arange(gap - 1, 0, -1)
        for a in first[(self.counts[first] > 0) & self.pairs[gap - first]].tolist():
            self.counts[a] -= 1
            two = self.pair(gap - a)
            self.counts[a] += 1
            if two:
                return (a, *two)
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, [(length, how often in each), ...]) rows that use every piece of the histogram once."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = [(int(counts[capacity]), [(capacity, 1)])] if counts[capacity] else []
    counts[capacity] = 0
    index, steps = Complements(counts), 0
    for length in range(capacity - 1, 0, -1):
        while counts[length]:
            counts[length] -= 1
            found = index.fill(capacity - length)
            counts[length] += 1
            if not found:
                break
            once: dict[int, int] = {}
            for x in (length, *found):
                once[x] = once.get(x, 0) + 1
            n = min(int(counts[x]) // k for x, k in once.items())
            for x, k in once.items():
                counts[x] -= n * k
            out.append((n, sorted(once.items(), reverse=True)))
            steps += 1
            if steps % 64 == 0:
                index.refresh()
    return out + best_fit(counts, capacity)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Longest first into the fullest sequence that still takes it, for whole groups of like sequences at once."""
    groups: dict[int, list[tuple[int, list]]] = {}               # by gap
    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            gap = min((g for g in groups if g >= length), default=capacity)
            many, inside = groups[gap].pop() if gap in groups else (left, [])
            if gap in groups and not groups[gap]:
                del groups[gap]
            each = min(gap // length, left)
            n = min(many, left // each)
            if many > n and inside:
                groups.setdefault(gap, []).append((many - n, inside))
            groups.setdefault(gap - each * length, []).append((n, [*inside, (length, each)]))
            left -= n * each
    return [row for rows in groups.values() for row in rows]


def assign(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts with sequence_id and offset.  parts: staged rows with doc_id, piece, start, ids_crc32 and length of at most `capacity`."""
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}     # at most `capacity` rows
    slots: list[tuple] = []
    used: dict[int, int] = {}
    base = 0
    for n, inside in plan(histogram, capacity):
        offset = 0
        for length, each in inside:
            slots.append((length, used.get(length, 0), base, offset, each))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        base += n
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5)
    model = parts.sparkSession.sparkContext.broadcast(table)            # rows are bounded by the capacity, see the plan

    # number the pieces of each length: places within a bucket after the sizes of the buckets before it
    buckets = max(64, sum(histogram.values()) // 50_000)
    keyed = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = keyed.withColumn("_place", place - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_place") + F.col("_before")).select(*parts.columns, "_rank")

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = model.value
        key = t[:, 0] * (1 << 45) + t[:, 1]
        for b in rows:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            row = t[np.searchsorted(key, length * (1 << 45) + rank, side="right") - 1]
            within = rank - row[:, 1]
            keep = [c for name, c in zip(b.schema.names, b.columns, strict=True) if name != "_rank"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(row[:, 2] + within // row[:, 4]), pa.array(row[:, 3] + within % row[:, 4] * length)], [n for n in b.schema.names if n != "_rank"] + ["sequence_id", "offset"])

    columns = ", ".join(f"{n} {t}" for n, t in parts.dtypes)
    return ranked.mapInArrow(task, f"{columns}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The contract's columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return assign(staged(pieces(docs, vocabulary, capacity, end_id)), capacity)
