"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Texts are lower-cased; their words are runs of ASCII letters and digits and of
non-ASCII characters, their shingles five consecutive words. A document is
contaminated by an item when it holds at least ``containment`` of the item's
distinct shingles. An item of fewer than five words is one shingle of all its words,
and contaminates every document that holds these words in a row: such items are
looked up exactly, by the hash of their words.

Items are partitioned by size into powers of two. For items of up to L shingles
a document is read in windows of 2L shingles that overlap by L, so a copied item
lies within one window, and containment there means a Jaccard similarity of at
least t q / (2L + (1 - t) q): about a fifth, however long the document. Each
partition takes as many MinHash values as a miss chance below ``miss`` needs,
one value a band. Windows of one partition are made from the window minima of
the smaller one, so the cost is one minimum a shingle and hash function. A
window that shares a band with an item is a candidate; candidates are verified
by exact shingle containment in the whole document, in the same pass, so texts
are never shuffled.

Items are taken in blocks of at most ``block_bytes`` of text, one pass over the
documents for each block, which bounds what travels with a task. An item of more
text than that makes a block of its own.

Defined results: null and wordless texts and items match nothing; repeated rows
and repeated items each match, items with a null id too; ties do not arise. Texts of
any length are searched whole. Empty tables give no rows. ``clean`` passes all columns
through; where a key of ``contaminated`` has the name of a result column, the latter
gets an underscore more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textbatch as tb
from .language_id import lowered

SHINGLE = 5
BLOCK = 1 << 21


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Word hashes of a batch's texts and their documents, in text order, and the number of texts."""
    raw, offsets = tb.utf8(lowered(column))
    starts, ends, docs = tb.words(raw, offsets, tb.symbol_table())
    return tb.range_hashes(raw, starts, ends), docs, len(offsets) - 1


def functions(n: int) -> np.ndarray:
    """Odd multipliers, one a MinHash function."""
    return tb.mix(np.arange(1, n + 1, dtype=tb.U64) * tb.GOLDEN) | tb.U64(1)


def values_needed(size: int, containment: float, miss: float) -> int:
    """MinHash values by which an item of more than size / 2 shingles is missed less often than ``miss``."""
    least = size // 2 + 1
    jaccard = containment * least / (2 * size + (1 - containment) * least)
    return max(1, math.ceil(math.log(miss) / math.log1p(-jaccard)))


class Items:
    """Items of one block: shingle sets, MinHash values by size partition, and short items by length."""

    def __init__(self, ids: list[int | None], texts: list[str | None], containment: float, miss: float):
        self.ids = pa.array(ids, pa.int64())
        hashes, docs, n = hashed_words(pa.array(texts, pa.string()))
        self.containment = containment
        at, value = tb.windows(hashes, docs, SHINGLE)
        bounds = np.searchsorted(docs[at], np.arange(n + 1))
        self.sets = [np.unique(value[bounds[i] : bounds[i + 1]]) for i in range(n)]
        length = np.bincount(docs, minlength=n)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for words in range(1, SHINGLE):
            at, key = tb.windows(hashes, docs, words)
            at, key = at[length[docs[at]] == words], key[length[docs[at]] == words]
            if len(at):
                order = np.argsort(key, kind="stable")
                self.short[words] = key[order], docs[at][order]
        self.partitions: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes = np.array([len(s) for s in self.sets])
        size = 1
        while len(sizes) and size // 2 < sizes.max():
            members = np.flatnonzero((sizes > size // 2) & (sizes <= size)) if size > 1 else np.flatnonzero(sizes == 1)
            if len(members):
                tables = []
                for a in functions(values_needed(size, containment, miss)):
                    least = np.array([(self.sets[i] * a).min() for i in members], tb.U64)
                    order = np.argsort(least)
                    tables.append((least[order], members[order]))
                self.partitions[size] = tables
            size *= 2


def block_starts(first: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks of ``size`` shingles inside each document, and their documents."""
    blocks = -(-counts // size)
    owner = np.repeat(np.arange(len(counts)), blocks)
    within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return np.repeat(first, blocks) + within * size, owner


def search(value: np.ndarray, owner: np.ndarray, n_docs: int, items: Items) -> set[tuple[int, int]]:
    """Candidate (document, item) pairs of a batch."""
    found: set[tuple[int, int]] = set()
    if not len(value) or not items.partitions:
        return found
    counts = np.bincount(owner, minlength=n_docs)
    first = np.cumsum(counts) - counts
    grids = {size: block_starts(first, counts, size) for size in items.partitions}
    multipliers = functions(max(len(t) for t in items.partitions.values()))
    for k, a in enumerate(multipliers):
        hashed = value * a
        for size, tables in items.partitions.items():
            if k >= len(tables):
                continue
            starts, docs = grids[size]
            least = np.minimum.reduceat(hashed, starts)
            window = least.copy()
            joined = np.flatnonzero(docs[:-1] == docs[1:])
            window[joined] = np.minimum(least[joined], least[joined + 1])
            keys, members = tables[k]
            lo = np.searchsorted(keys, window)
            hit = np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == window))
            for i in hit:
                j = lo[i]
                while j < len(keys) and keys[j] == window[i]:
                    found.add((int(docs[i]), int(members[j])))
                    j += 1
    return found


def exact(hashes: np.ndarray, docs: np.ndarray, items: Items) -> set[tuple[int, int]]:
    """(document, item) of the short items whose words stand in a row in a document."""
    found: set[tuple[int, int]] = set()
    for words, (keys, members) in items.short.items():
        at, value = tb.windows(hashes, docs, words)
        lo, hi = np.searchsorted(keys, value), np.searchsorted(keys, value, side="right")
        pairs = np.unique(np.stack([docs[at], lo, hi])[:, lo < hi], axis=1)
        found.update((int(d), int(members[j])) for d, a, b in pairs.T for j in range(a, b))
    return found


def links(texts: pa.Array, items: Items) -> list[tuple[int, int, int, int]]:
    """Verified (row, item, shared, size of item) of a batch's texts, in order."""
    hashes, docs, n = hashed_words(texts)
    at, value = tb.windows(hashes, docs, SHINGLE)
    owner = docs[at]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    rows = [(doc, item, 1, 1) for doc, item in exact(hashes, docs, items)]
    have = (-1, None)
    for doc, item in sorted(search(value, owner, n, items)):
        if have[0] != doc:
            have = (doc, np.unique(value[bounds[doc] : bounds[doc + 1]]))
        wanted = items.sets[item]
        shared = int(np.isin(wanted, have[1], assume_unique=True).sum())
        if shared >= items.containment * len(wanted) - 1e-9:
            rows.append((doc, item, shared, len(wanted)))
    return sorted(rows)


def matcher(items: Items, text: str, names: list[str]):
    """Executor side of the search: one row a link, of all columns but ``text`` and the link's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.blocks(batches, text, BLOCK):
            rows = links(batch.column(text), items)
            if rows:
                at = np.array(rows, np.int64)
                keys = [batch.column(i).take(pa.array(at[:, 0])) for i, n in enumerate(batch.schema.names) if n != text]
                own = [items.ids.take(pa.array(at[:, 1])), pa.array(at[:, 2]), pa.array(at[:, 3])]
                yield pa.RecordBatch.from_arrays([*keys, *own], names=names)

    return run


def dropper(items: Items):
    """Executor side of cleaning: batches without the rows that have a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.blocks(batches, "text", BLOCK):
            keep = np.ones(batch.num_rows, bool)
            keep[[r[0] for r in links(batch.column("text"), items)]] = False
            yield batch.filter(pa.array(keep))

    return run


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list]:
    """Rows (item_id, text) in blocks of bounded text, dealt by hash."""
    usable = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(1.25 * size / block_bytes))
    for b in range(blocks):
        rows = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if rows or blocks == 1:
            yield sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))


def contaminated(
    documents: DataFrame,
    items: DataFrame,
    keys: list[str],
    containment: float = 0.8,
    miss: float = 1e-6,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """Every (document, item) link: ``keys`` of the document, item_id, n_shared, n_item, containment."""
    own = ["item_id", "n_shared", "n_item", "containment"]
    own = [store.fresh([*keys, *own[:i], *own[i + 1 :]], name) if name in keys else name for i, name in enumerate(own)]
    text = store.fresh(keys, "text")
    texts = documents.where("text is not null").select(*[f"`{k}`" for k in keys], F.col("text").cast("string").alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.drop(text).schema.fields)
    schema += f", {own[0]} long, {own[1]} long, {own[2]} long"
    out = None
    for rows in item_blocks(items, block_bytes):
        block = Items([r["item_id"] for r in rows], [r["text"] for r in rows], containment, miss)
        part = texts.mapInArrow(matcher(block, text, [*keys, *own[:3]]), schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumn(own[3], F.col(own[1]) / F.col(own[2]))


def clean(documents: DataFrame, items: DataFrame, containment: float = 0.8, miss: float = 1e-6, block_bytes: int = 16 << 20) -> DataFrame:
    """Documents without a contaminating item, filtered in the pass that reads them; null texts stay."""
    for rows in item_blocks(items, block_bytes):
        block = Items([r["item_id"] for r in rows], [r["text"] for r in rows], containment, miss)
        documents = documents.mapInArrow(dropper(block), documents.schema)
    return documents


#: Exact containment in DuckDB SQL, without the search.
ORACLE = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\x00-\x7F])+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\x00-\x7F])+') FROM benchmark
), grams AS (
  SELECT DISTINCT side, id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM words, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) >= 5
), sizes AS (SELECT id, count(*) AS n FROM grams WHERE side = 'i' GROUP BY id
), short AS (SELECT id, array_to_string(w, ' ') AS g FROM words WHERE side = 'i' AND len(w) BETWEEN 1 AND 4)
SELECT d.id AS doc_id, s.id AS item_id, count(*) AS n_shared, s.n AS n_item, count(*)::DOUBLE / s.n AS containment
FROM grams d JOIN grams i ON d.side = 'd' AND i.side = 'i' AND d.g = i.g JOIN sizes s ON s.id = i.id
GROUP BY d.id, s.id, s.n HAVING count(*) >= 0.8 * s.n - 1e-9
UNION ALL
SELECT d.id, s.id, 1, 1, 1.0
FROM words d JOIN short s ON d.side = 'd' AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || s.g || ' ')
"""
