"""HTML extraction by a linear-chain conditional random field over DOM leaf blocks.

Every page is a chain of leaf blocks (`dom`).  A block's features are the tags of its ancestors, the names they carry (class, id, role), and its text:
length, share of links, punctuation, marks such as the copyright sign, place on the page.  The field is trained on labelled pages, and the best
labelling of a page (Viterbi) tells its main blocks.

Labelled pages are of two kinds: pages of the table that mark their article themselves (HTML's `article` or `main` element, less the elements in it that
HTML keeps for other things), at most about `LEARN` chosen by a hash of their html, and `MADE` pages in other layouts (`layouts`), filled with
text of the first kind.  Fitting is the only bounded step; every page is read whole and decoded.

Null html is empty, a page without main blocks has empty text; repeated rows give a row each; very long pages are one chain each, in memory linear in
their length.  Character references are decoded, white space inside a block becomes one space.  Only page_id, url and html are looked at, and an empty table
gives no rows.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.base import batches
from wattline.llm.crf import Chains, Model, train, viterbi
from wattline.llm.dom import Block, blocks
from wattline.llm.layouts import page

LEARN, MADE, SAMPLE_BYTES = 256, 768, 1 << 16        # labelled pages of the table and made ones; longer pages are not learned from
SIZE = 1 << 14                                       # hashed features
ROUNDS, RATE, PENALTY = 150, 0.1, 1e-4
ARTICLE, OTHER = {"article", "main"}, {"nav", "aside", "footer", "form", "button", "select"}
TOGETHER = 256                                       # pages decoded at once
PLAIN = ["Plain words stand here, in a sentence of some length.", "A second sentence follows.", "Short text"]


def own_label(b: Block) -> int:
    """What the page's own elements say of a block."""
    label = 0
    for tag, _ in b.path:
        label = 1 if tag in ARTICLE else 0 if tag in OTHER else label
    return label


def _bin(x: float) -> int:
    return int(np.log2(x + 1))


def features(page_blocks: list[Block], number: dict[str, int], with_tags: bool = True) -> list[list[int]]:
    """Feature numbers of each block; `number` keeps them by name between pages.  Without tags, elements that name their purpose read as `div`."""
    def at(name: str) -> int:
        n = number.get(name)
        if n is None:
            n = number[name] = zlib.crc32(name.encode()) % SIZE
        return n

    out, total = [], len(page_blocks)
    of_path: dict[tuple, list[int]] = {}
    for i, b in enumerate(page_blocks):
        base = of_path.get(b.path)
        if base is None:
            names = ["bias"]
            for tag, parts in b.path:
                tag = tag if with_tags or tag not in ARTICLE | OTHER | {"header"} else "div"
                names.append(f"in:{tag}")
                for w in parts:
                    names += [f"name:{w}", f"stem:{w[:4]}"]
            if b.path:
                names += [f"leaf:{b.path[-1][0]}", f"deep:{min(8, len(b.path))}"]
            base = of_path[b.path] = [at(x) for x in dict.fromkeys(names)]
        t = b.text
        words, share = t.count(" ") + 1, b.linked / len(t)
        linked = 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.9 else 3
        ends = t[-1] in ".!?…:;\"”»)"
        own = [f"words:{_bin(words)}", f"links:{linked}", f"ends:{ends}", f"stops:{min(4, _bin(sum(t.count(c) for c in '.!?')))}", f"commas:{min(4, _bin(t.count(',')))}",
               f"long:{_bin(words)}:{linked}:{ends}", f"start:{min(i, 3)}", f"left:{min(total - 1 - i, 2)}"]
        if "©" in t:
            own.append("copyright")
        if any(c.isdigit() for c in t[:200]):
            own.append("digits")
        out.append(base + [at(x) for x in own])
    return out


# ------------------------------------------------------------------------------------------ training

def sample(pages: DataFrame, most: int = LEARN) -> list[str]:
    """About `most` pages that mark their article, chosen by a hash of their html; the count is one aggregate."""
    marked = pages.select("html").where((F.octet_length("html") <= SAMPLE_BYTES) & F.col("html").rlike("(?i)<(article|main)[\\s>]")).withColumn("h", F.pmod(F.xxhash64("html"), F.lit(1 << 30)))
    n = marked.count()
    if not n:
        return []
    chosen = marked.where(F.col("h") <= int(min(1.0, 1.5 * most / n) * (1 << 30))).orderBy("h", "html").limit(most).collect()
    return [r["html"] for r in chosen]


def learned(html: list[str], made: int = MADE, seed: int = 12) -> Model:
    """The field trained on pages that mark their article and on made pages."""
    number: dict[str, int] = {}
    chains, lengths, labels, texts = [], [], [], []
    for h in html:
        found = list(blocks(h))
        y = [own_label(b) for b in found]
        texts += [b.text for b, v in zip(found, y, strict=True) if v][:20]
        chains += features(found, number)
        lengths.append(len(found))
        labels += y
    rng = random.Random(seed)
    for _ in range(made):
        found = list(blocks(page(rng, texts or PLAIN)))
        chains += features(found, number, with_tags=rng.random() < 0.7)
        lengths.append(len(found))
        labels += [b.label for b in found]
    return train(Chains(chains, lengths), np.array(labels, np.int64), SIZE, ROUNDS, RATE, PENALTY)


# ------------------------------------------------------------------------------------------ extraction

def main_texts(html: list[str | None], model: Model, number: dict[str, int], known: dict) -> list[str]:
    found = [list(blocks(h or "", known)) for h in html]
    if len(number) > 1 << 17:
        number.clear()
    chains = Chains([f for p in found for f in features(p, number)], [len(p) for p in found])
    label = viterbi(model, chains)
    return ["\n\n".join(b.text for b, v in zip(p, label[a:a + len(p)], strict=True) if v) for p, a in zip(found, chains.first, strict=True)]


def _extractor(model: Model):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        known: dict = {}
        for batch in it:
            for i in range(0, len(batch), TOGETHER):
                some = batch.slice(i, TOGETHER)
                text = main_texts(some.column("html").to_pylist(), model, number, known)
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; `model` is trained on the table's own pages unless given."""
    rows = pages.select("page_id", "url", "html")
    model = model or learned(sample(pages))
    kinds = dict(rows.dtypes)
    return batches(rows, _extractor(model), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


#: The same question for DuckDB, for pages that mark their article by one `article` element of text blocks and inline markup.
SQL = r"""
WITH a AS (
    SELECT page_id, url, row_number() OVER () AS row,
           regexp_replace(regexp_replace(coalesce(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), ''), '(?is)<br[^>]*>', ' ', 'g'), '(?i)</?(b|i|a|em|strong|span)(\s[^>]*)?>', '', 'g') AS x
    FROM pages),
b AS (SELECT page_id, url, row, unnest(regexp_split_to_array(x, '<[^>]*>')) AS t, generate_subscripts(regexp_split_to_array(x, '<[^>]*>'), 1) AS i FROM a),
d AS (
    SELECT page_id, url, row, i, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#39;', ''''), '&amp;?', '&', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS t FROM b)
SELECT page_id, url, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (WHERE t <> ''), '') AS text,
       length(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (WHERE t <> ''), '')) AS n_chars
FROM d GROUP BY page_id, url, row
"""
