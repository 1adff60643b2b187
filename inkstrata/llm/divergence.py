"""How sources of a language differ in their words: pairs of sources, and the terms that mark a source.

Terms are runs of ASCII letters and of all characters beyond ASCII, A-Z lower-cased.
A language keeps the V terms that stand in at least three of its documents. A group
is a (lang, source) that occurs; with N its occurrences of kept terms, a term it
holds ``count`` times gets p = 1 + floor(10^9 (count + 1) / (N + V)), and the same
over the whole language. Against another p, q, the divergence of a term is
floor((p - q)^2 / q).

Pairs are found by two-dimensional tiling. Counts of a group are packed into one
row for each vocabulary chunk. Groups of a language form blocks; a packed row of
a block goes to every tile (its block by another), and a tile's task computes its
submatrix, one vocabulary chunk after the other. Chunks of a language are dealt into
slices, so that one large language is many tasks; tiles of all slices are summed. A
task holds one chunk of two blocks at a time, whatever the input.

Everything is exact: p stays below 2^31 but for one, so squares fit 64 bits, and all
divergences of a pair sum to less than 4 * 10^18.

Defined results: null text, lang and source count as ''. A group without terms is a
group all the same; with V = 0 its pairs have value 0. Repeated rows are documents
of their own. Ties go by the item's UTF-8 bytes. An empty table gives no rows. Texts
and terms of any length are read whole; extra columns are not read. Sums N + V up
to 9 * 10^13 and counts below it stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from . import textbatch as tb

#: Documents of its language that hold a kept term, at least.
MIN_DOCS = 3
TOP_TERMS = 200
#: Bytes of text counted at once, about.
BATCH = 1 << 23
#: Terms of a vocabulary chunk, about; groups of a block; chunks of a slice.
CHUNK, BLOCK, SLICE = 4096, 32, 16

COUNTED = "lang string, source string, term string, n long, docs long"
TILED = "lang string, a int, b int, value long"


def term_table() -> np.ndarray:
    """Separator flags by byte: all ASCII but letters."""
    table = np.zeros(256, bool)
    table[:128] = True
    table[65:91] = table[97:123] = False
    return table


def term_codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of texts laid end to end, the term of each occurrence, and its text."""
    starts, ends, docs = tb.words(raw, offsets, separators := term_table())
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = lower[raw[~separators[raw]]]
    where = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(where), pa.py_buffer(inside.tobytes())).dictionary_encode()
    return terms.dictionary, terms.indices.to_numpy().astype(np.int64), docs


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term) with occurrences and documents, pre-aggregated by block; each group once without a term."""
    for batch in tb.blocks(batches, "text", BATCH):
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        groups, owner = np.unique(group, return_inverse=True)
        terms, codes, docs = term_codes(*tb.utf8(batch.column("text")))
        wide = max(1, len(terms))
        each, per_doc = np.unique(docs * wide + codes, return_counts=True)
        keys, back = np.unique(owner[each // wide] * wide + each % wide, return_inverse=True)
        n = np.bincount(back, per_doc, len(keys)).astype(np.int64)
        has = np.bincount(back, minlength=len(keys))
        of = np.concatenate([groups[keys // wide], groups])
        words = pa.concat_arrays([terms.take(pa.array(keys % wide)), pa.nulls(len(groups), pa.string())])
        none = np.zeros(len(groups), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                lang.dictionary.take(pa.array(of // len(source.dictionary))),
                source.dictionary.take(pa.array(of % len(source.dictionary))),
                words,
                pa.array(np.concatenate([n, none])),
                pa.array(np.concatenate([has, none])),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


def term_counts(documents: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``; one row of each group has a null term."""
    texts = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = texts.mapInArrow(counted, COUNTED)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count, total):
    """1 + floor(10^9 (count + 1) / total) in 64 bits, by two steps of long division; count < total."""
    first = (count + 1) * F.lit(100_000)
    left = first % total
    return F.lit(1) + F.call_function("div", first, total) * 10_000 + F.call_function("div", left * 10_000, total)


def divergence(p, q):
    return F.call_function("div", (p - q) * (p - q), q)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    first = (counts + 1) * 100_000
    return 1 + first // total * 10_000 + first % total * 10_000 // total


def _submatrix(a: list[dict], b: list[dict], a_counts: dict, b_counts: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sums of both directions over the terms of one chunk that any group holds, less what absent terms give."""
    held = [*a_counts.values(), *b_counts.values()]
    active, back = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
    split = np.cumsum([len(x[0]) for x in held])[:-1]
    places = dict(zip([(0, g) for g in a_counts] + [(1, g) for g in b_counts], np.split(back, split), strict=True))

    def dense(side: int, groups: list[dict], counts: dict) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(groups), len(active)), np.int64)
        for row, g in enumerate(groups):
            if g["id"] in counts:
                out[row, places[side, g["id"]]] = counts[g["id"]][1]
        total = np.array([g["total"] for g in groups], np.int64)
        return shares(out, total[:, None]), shares(np.zeros(len(groups), np.int64), total)

    p, p0 = dense(0, a, a_counts)
    q, q0 = dense(1, b, b_counts)
    there, back_again = np.empty((len(a), len(b)), np.int64), np.empty((len(a), len(b)), np.int64)
    for i in range(len(a)):
        square, square0 = (p[i] - q) ** 2, (p0[i] - q0) ** 2
        there[i] = (square // q).sum(1) - len(active) * (square0 // q0)
        back_again[i] = (square // p[i]).sum(1) - len(active) * (square0 // p0[i])
    return there, back_again


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Submatrices from packed rows sorted by tile and chunk; a tile's groups come first, as chunk -1."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield {c: batch.column(c)[i].as_py() for c in ("lang", "slice", "i", "j", "chunk", "id", "total", "terms", "block")} | {
                    "places": batch.column("places")[i].values, "counts": batch.column("counts")[i].values,
                }

    for (lang, part, i, j), tile in groupby(rows(), lambda r: (r["lang"], r["slice"], r["i"], r["j"])):
        a, b, ab, ba = [], [], None, None
        for chunk, held in groupby(tile, lambda r: r["chunk"]):
            if chunk < 0:
                groups = sorted(held, key=lambda r: r["id"])
                a, b = [g for g in groups if g["block"] == i], [g for g in groups if g["block"] == j]
                p0, q0 = (np.array([int(shares(np.int64(0), np.int64(g["total"]))) if g["total"] else 0 for g in s], np.int64) for s in (a, b))
                square = (p0[:, None] - q0) ** 2
                terms = (groups[0]["terms"] or 0) if part == 0 else 0
                ab = terms * (square // np.maximum(q0, 1)[None, :])
                ba = terms * (square // np.maximum(p0, 1)[:, None])
                continue
            counts: list[dict] = [{}, {}]
            for r in held:
                vector = (r["places"].to_numpy().astype(np.int64), r["counts"].to_numpy().astype(np.int64))
                for side, block in enumerate((i, j)):
                    if r["block"] == block:
                        counts[side][r["id"]] = vector
            there, back = _submatrix(a, b, *counts)
            ab, ba = ab + there, ba + back
        x, y = np.meshgrid([g["id"] for g in a], [g["id"] for g in b], indexing="ij")
        own = x.ravel() != y.ravel()
        ends = [(x, y, ab)] if i == j else [(x, y, ab), (y, x, ba)]
        for left, right, value in ends:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * int(own.sum()), pa.string()),
                    pa.array(left.ravel()[own], pa.int32()),
                    pa.array(right.ravel()[own], pa.int32()),
                    pa.array(value.ravel()[own], pa.int64()),
                ],
                names=["lang", "a", "b", "value"],
            )


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: all pairs of sources, and each group's first terms."""
    counts = store.shelve(term_counts(documents), "terms")
    words = counts.where("term is not null")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = store.shelve(kept.drop("docs"), "kept")
    n_chunks = max(1, -(-kept.count() // CHUNK))
    n_slices = -(-n_chunks // SLICE)

    # Places of terms within a chunk of their language.
    placed = kept.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(n_chunks)).cast("int"))
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    packed = (
        words.join(placed, ["lang", "term"])
        .groupBy("lang", "source", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("place", "n", "lang_n", "term"))).alias("held"), F.sum("n").alias("n"))
    )
    packed = store.shelve(packed, "packed")

    # One row a group: its number within the language, N + V, and those of the language.
    languages = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("n"))
    groups = counts.where("term is null").select("lang", "source").join(packed.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    groups = groups.join(languages.select("lang", "terms", F.col("n").alias("lang_total")), "lang", "left").select(
        "lang", "source",
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("id"),
        F.count("*").over(Window.partitionBy("lang")).alias("groups"),
        F.coalesce("terms", F.lit(0)).alias("terms"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("terms", F.lit(0))).alias("total"),
        (F.coalesce("lang_total", F.lit(0)) + F.coalesce("terms", F.lit(0))).alias("lang_total"),
    )
    groups = store.shelve(groups.withColumn("block", F.floor(F.col("id") / BLOCK).cast("int")), "groups")
    store.discard(kept)

    full = packed.join(groups, ["lang", "source"])
    out = _pairs(full, groups, n_slices).unionByName(_terms(full, top_terms))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _pairs(full: DataFrame, groups: DataFrame, n_slices: int) -> DataFrame:
    """The part ``pair``, by tiles of group blocks."""
    none = F.array().cast("array<int>")
    heads = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1)))).select(
        "lang", "slice", "groups", "block", "id", "total", "terms", F.lit(-1).alias("chunk"), none.alias("places"),
        F.array().cast("array<long>").alias("counts"),
    )
    vectors = full.select(
        "lang", F.pmod("chunk", F.lit(n_slices)).alias("slice"), "groups", "block", "id", "total", "terms", "chunk",
        F.col("held.place").alias("places"), F.col("held.n").alias("counts"),
    )
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("groups") - 1) / BLOCK).cast("int"))).alias("other")
    sent = heads.unionByName(vectors).select("*", other)
    sent = sent.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("groups", "other")
    tiled = (
        sent.repartition("lang", "slice", "i", "j").sortWithinPartitions("lang", "slice", "i", "j", "chunk", "id").mapInArrow(tiles, TILED)
    )
    value = tiled.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "id", "source")
    named = value.join(names.withColumnRenamed("id", "a"), ["lang", "a"]).join(
        names.select("lang", F.col("id").alias("b"), F.col("source").alias("item")), ["lang", "b"]
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(full: DataFrame, top: int) -> DataFrame:
    """The part ``term``: what each group uses more than its language, by divergence."""
    each = full.select("lang", "source", "total", "lang_total", F.explode("held").alias("held"))
    p, q = share(F.col("held.n"), F.col("total")), share(F.col("held.lang_n"), F.col("lang_total"))
    scored = each.select("lang", "source", F.col("held.term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    scored = scored.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


ORACLE = r"""
with words as (
  select doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as word
  from (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text
        from documents)),
occurrences as (
  select doc, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from words),
kept as (
  select lang, term, count(*)::hugeint as n from occurrences group by all having count(distinct doc) >= 3),
languages as (select lang, count(*)::hugeint as v, sum(n)::hugeint as n from kept group by all),
groups as (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
counts as (
  select lang, source, term, count(*)::hugeint as n from occurrences semi join kept using (lang, term) group by all),
totals as (
  select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as n
  from groups g left join counts c on c.lang = g.lang and c.source = g.source group by all),
shares as (
  select t.lang, t.source, k.term, coalesce(c.n, 0) as n,
         1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (t.n + l.v) as p,
         1 + (1000000000::hugeint * (k.n + 1)) // (l.n + l.v) as q
  from totals t join languages l on l.lang = t.lang join kept k on k.lang = t.lang
  left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) as value
             from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
    on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (
  select lang, source, term as item, ((p - q) * (p - q)) // q as value from shares where n > 0 and p > q)
select lang, source, 'pair' as part, item, value::bigint as value,
       row_number() over (partition by lang, source order by value desc, encode(item))::int as rank from pairs
union all
select lang, source, 'term', item, value::bigint,
       row_number() over (partition by lang, source order by value desc, encode(item))::int as rank from terms
qualify rank <= 200
"""
