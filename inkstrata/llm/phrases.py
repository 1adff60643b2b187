"""Phrases of two and three words that stand together more often than their parts suggest, by language.

A-Z are lower-cased; texts are split at ``.,;:!?`` and line ends into pieces, and
pieces at blanks and tabs into words. A phrase counts wherever it stands within a
piece, overlaps included. From MIN_COUNT occurrences on it is a candidate, scored
by its weakest cut: floor(10^6 a^2 / (l r)) with a, l and r the counts of the phrase
and of the two parts. A candidate inside a longer one that has half its count or
more is dropped.

The work is on numbers. Every block of texts is kept as its own words and their
places (local codes). Words that reach MIN_COUNT in their language form a dictionary
with dense ids; the ids come back to each block by a join, so no task and no
broadcast holds the dictionary. Rarer words break pieces, as no candidate can hold
them. Runs of two and three ids are packed into binary keys of a fixed width and counted
within a group of blocks. Sorted keys are cut at the bounds of ranges, a slice becomes one
row, Spark shuffles the slices by range, and a range's keys are sorted together and
summed by run lengths.

Defined results: null text is empty, null lang is ``und``. Repeated rows count as often
as they stand there. Scores tie on integers; rank goes by score, count and the phrase's
UTF-8 bytes. Empty tables give no rows; texts and words of any length are read whole;
extra columns are not read. Scores are exact to counts of 10^15 (38-digit decimals).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from . import textbatch as tb

MIN_COUNT = 10
TOP = 2000
#: Bytes of text in a block, about.
BATCH = 1 << 22
#: Words of a bucket of the dictionary, about; candidates that one task ranks, about.
BUCKET, RANKED = 1 << 16, 100_000
#: Words of a group of blocks that is counted at once; keys of a range, and keys that set the bounds of ranges, about.
GROUP, PART, SAMPLED = 2_000_000, 2_000_000, 1_000_000
#: Bytes that end a piece, and those that part words within one.
ENDS, BLANKS = b".,;:!?\n\v\f\r", b" \t"

BLOCKS = "block long, lang string, words array<string>, counts array<long>, codes binary"
KEYS = "key binary, n long"


def flags(held: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(held)] = True
    return table


def local_codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of texts laid end to end, and the code of each occurrence; -1 stands before a new piece."""
    ends = flags(ENDS)
    separators = ends | flags(BLANKS)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    starts, stops, docs = tb.words(raw, offsets, separators)
    inside = lower[raw[~separators[raw]]]
    where = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(where), pa.py_buffer(inside.tobytes())).dictionary_encode()
    codes = found.indices.to_numpy().astype(np.int32)
    passed = np.concatenate([[0], np.cumsum(ends[raw])])
    fresh = (docs[1:] != docs[:-1]) | (passed[starts[1:]] != passed[stops[:-1]])
    return found.dictionary, np.insert(codes, np.flatnonzero(fresh) + 1, -1)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each language of a block: its words with counts, and all places as local codes."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    for batch in tb.blocks(batches, "text", BATCH):
        langs = batch.column("lang").dictionary_encode()
        owner = langs.indices.to_numpy()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            words, codes = local_codes(*tb.utf8(batch.column("text").filter(pa.array(owner == i))))
            counts = pa.array(np.bincount(codes[codes >= 0], minlength=len(words)), pa.int64())
            one_row = [
                pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.ListArray.from_arrays([0, len(words)], words),
                pa.ListArray.from_arrays([0, len(words)], counts), pa.array([codes.tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(one_row, names=["block", "lang", "words", "counts", "codes"])
            number += 1


def key_bytes(ids: np.ndarray, width: int) -> np.ndarray:
    """Big-endian bytes of columns of ids, ``width`` bytes each, so that keys sort as the ids do."""
    wide = np.ascontiguousarray(ids.astype(">u8")).view(np.uint8).reshape(len(ids), ids.shape[1], 8)
    return np.ascontiguousarray(wide[:, :, 8 - width :]).reshape(len(ids), ids.shape[1] * width)


def _distinct(first: np.ndarray, second: np.ndarray, third: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct triples of local codes below ``base``, as columns, and how often each stands there."""
    pairs, codes = np.unique(first * base + second, return_inverse=True) if base**3 >= 1 << 62 else (None, first * base + second)
    whole, n = np.unique(codes * base + third, return_counts=True)
    lead = whole // base
    lead = lead if pairs is None else pairs[lead]
    return np.column_stack([lead // base, lead % base, whole % base]), n


def grams(batches: Iterator[pa.RecordBatch], width: int, part: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct sorted keys of two ids and a zero, then of three ids, with their counts, for groups of blocks.

    ``part`` above 1 takes one in so many of a block's places, a run of them.
    """

    def group(held: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        named = np.unique(np.concatenate([ids for _, _, ids in held]))
        here = [np.zeros(1, np.int64)]
        for codes, places, ids in held:
            known = np.zeros(int(codes.max(initial=-1)) + 2, np.int64)  # the last one is for -1
            inside = places < len(known) - 1
            known[places[inside]] = np.searchsorted(named, ids[inside]) + 1
            here += [known[codes], np.zeros(1, np.int64)]
        here = np.concatenate(here)
        named = np.concatenate([[0], named])
        pair = np.flatnonzero((here[:-1] > 0) & (here[1:] > 0))
        found, n = _distinct(here[pair], here[pair + 1], np.zeros(len(pair), np.int64), len(named))
        yield key_bytes(named[found], width), n
        three = pair[:-1][np.diff(pair) == 1] if len(pair) else pair
        found, n = _distinct(here[three], here[three + 1], here[three + 2], len(named))
        yield key_bytes(named[found], width), n

    held, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.int32)
            if part > 1:
                run = -(-len(codes) // part)
                begin = int(batch.column("block")[i].as_py()) * 7919 % part * run
                codes = codes[begin : begin + run]
            held.append((codes, *(batch.column(c)[i].values.to_numpy() for c in ("places", "ids"))))
            size += len(codes)
            if size >= GROUP:
                yield from group(held)
                held, size = [], 0
    if held:
        yield from group(held)


def sampled(width: int, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every ``step``-th key of a sixteenth of each block, for the bounds of the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _ in grams(batches, width, 16):
            few = keys[step // 2 :: step]
            yield pa.RecordBatch.from_arrays([_binary(few)], names=["key"])

    return run


def dealt(width: int, bounds: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys and counts of a group of blocks, cut at the bounds: one row for each range that has any."""
    kind = f"S{3 * width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.frombuffer(bounds, kind)
        for keys, n in grams(batches, width):
            cuts = np.searchsorted(keys.view(kind).ravel(), ends) if len(keys) else np.zeros(len(ends), np.int64)
            cuts = np.concatenate([[0], cuts, [len(keys)]])
            parts = np.flatnonzero(np.diff(cuts))
            rows = [(keys[cuts[p] : cuts[p + 1]].tobytes(), n[cuts[p] : cuts[p + 1]].astype("<u4").tobytes()) for p in parts]
            made = [pa.array(parts, pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(made, names=["part", "keys", "counts"])

    return run


def _binary(keys: np.ndarray) -> pa.Array:
    ends = (np.arange(len(keys) + 1) * keys.shape[1]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(keys.tobytes())])


def _keyed(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_binary(keys), pa.array(n, pa.int64())], names=["key", "n"])


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each, by sorting and run lengths."""
    words = -(-keys.shape[1] // 8)
    wide = np.zeros((len(keys), 8 * words), np.uint8)
    wide[:, : keys.shape[1]] = keys
    order = np.lexsort(wide.view(">u8").astype(np.uint64).T[::-1])
    keys, n = keys[order], n[order]
    begin = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]).nonzero()[0]
    return keys[begin], np.add.reduceat(n, begin)


def run_lengths(width: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys with their sums, from ``least`` on, one range after the other in rows sorted by range."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            parts = batch.column("part").to_pylist()
            for i, part in enumerate(parts):
                yield part, batch.column("keys")[i].as_py(), batch.column("counts")[i].as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in groupby(rows(batches), lambda r: r[0]):
            keys, counts = zip(*((k, c) for _, k, c in held), strict=True)
            matrix = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 3 * width)
            found, total = summed(matrix, np.frombuffer(b"".join(counts), "<u4").astype(np.int64))
            often = np.flatnonzero(total >= least)
            yield _keyed(found[often], total[often])

    return run


def count_grams(coded: DataFrame, words: int, width: int, least: int) -> DataFrame:
    """Keys that stand at least ``least`` times in coded blocks of about ``words`` words, with their counts.

    Ranges are cut so that one holds about PART keys before equal ones are summed; a
    key has one entry a group of blocks at most, so no key outweighs a range. Bounds come
    from up to SAMPLED keys, as those of Spark's own range partitioning do.
    """
    spark = coded.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-2 * words // PART))
    step = max(1, 2 * words // 16 // min(SAMPLED, 100 * parts))
    few = sorted(bytes(r[0]) for r in coded.mapInArrow(sampled(width, step), "key binary").collect())
    ends = [few[i * len(few) // parts] for i in range(1, parts)] if few else []
    rows = coded.mapInArrow(dealt(width, b"".join(ends)), "part int, keys binary, counts binary")
    return rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run_lengths(width, least), KEYS)


def dictionary(kept: DataFrame) -> DataFrame:
    """``(lang, word, f)`` with dense ids from 1, by offsets of buckets; no task sees more than a bucket."""
    buckets = max(1, -(-kept.count() // BUCKET))
    words = kept.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)))
    sizes = words.groupBy("bucket").count()
    before = sizes.select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    return words.withColumn("rank", rank).join(before, "bucket").select("lang", "word", "f", (F.col("before") + F.col("rank")).alias("id"))


def mine(documents: DataFrame, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language."""
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    held = store.shelve(texts.mapInArrow(blocks, BLOCKS), "blocks")
    each = held.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    each = each.select("block", "lang", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    kept = each.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    kept = store.shelve(kept, "words")
    ids = store.shelve(dictionary(kept), "dictionary")
    store.discard(kept)
    total = held.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total"))
    total = store.shelve(total, "totals")

    # The ids of a block's words, back to the block.
    back = each.join(ids, ["lang", "word"]).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("w"))
    coded = held.select("block", "codes").join(back, "block").select("block", "codes", F.col("w.place").alias("places"), F.col("w.id").alias("ids"))
    coded = store.shelve(coded, "coded")
    size = ids.count()
    width = max(1, (size.bit_length() + 7) // 8)
    words = ids.agg(F.sum("f")).first()[0] or 0
    sums = count_grams(coded, words, width, least)
    found = store.shelve(sums, "phrases")
    store.discard(held, coded)
    return _ranked(found, ids, total, width, top)


def _ranked(found: DataFrame, ids: DataFrame, total: DataFrame, width: int, top: int) -> DataFrame:
    part = lambda i: F.conv(F.hex(F.substring("key", i * width + 1, width)), 16, 10).cast("long")
    none = F.lit(bytes(width))
    pieces = found.select("key", F.col("n").alias("a"), *(part(i).alias(c) for i, c in enumerate("xyz")))
    one = lambda c, *more: ids.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"), F.col("f").alias(f"{c}_f"), *more)
    twos = pieces.where("z = 0").select("key", "a", "x", "y")
    threes = pieces.where("z > 0").select(
        "a", "x", "y", "z",
        F.concat(F.substring("key", 1, 2 * width), none).alias("head"), F.concat(F.substring("key", width + 1, 2 * width), none).alias("tail"),
    )

    # Pairs: dropped inside a triple that has half their count or more.
    inside = threes.select(F.explode(F.array("head", "tail")).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    stay = twos.join(inside, "key", "left").where("longer is null or 100 * longer < 50 * a").drop("longer")
    two = stay.join(one("x", "lang"), "x").join(one("y"), "y").select(
        "lang", F.concat_ws(" ", "x_word", "y_word").alias("phrase"), "a", F.col("x_f").alias("l"), F.col("y_f").alias("r"),
        _score("a", "x_f", "y_f").alias("score"),
    )

    # Triples: the weaker of their two cuts; both parts of two words are frequent, so they are among the pairs.
    pair = lambda c: twos.select(F.col("key").alias(c), F.col("a").alias(f"{c}_f"))
    three = threes.join(pair("head"), "head").join(pair("tail"), "tail").drop("head", "tail")
    three = three.join(one("x", "lang"), "x").join(one("y"), "y").join(one("z"), "z")
    three = three.withColumn("s1", _score("a", "x_f", "tail_f")).withColumn("s2", _score("a", "head_f", "z_f"))
    first = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", F.concat_ws(" ", "x_word", "y_word", "z_word").alias("phrase"), "a",
        F.when(first, F.col("x_f")).otherwise(F.col("head_f")).alias("l"),
        F.when(first, F.col("tail_f")).otherwise(F.col("z_f")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    scored = store.shelve(two.unionByName(three), "scored")
    store.discard(found)

    # Rounds of smaller and smaller groups, each keeping its first ones, until one task can rank a language.
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    left = scored.count()
    while left > RANKED:
        salts = -(-left // RANKED)
        salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        scored = salted.withColumn("place", place).where(F.col("place") <= top).drop("salt", "place")
        if salts * top >= left:
            break
        left = salts * top
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )


def _score(a: str, left: str, right: str):
    """floor(10^6 a^2 / (l r)) in decimals; it is at most 10^6, as a phrase is no more frequent than its parts."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    above = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", above.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


ORACLE = r"""
with pieces as (
  select row_number() over () as piece, lang, text from (
    select coalesce(lang, 'und') as lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\x0A-\x0D]')) as text
    from documents)),
places as (
  select piece, lang, unnest(w) as word, generate_subscripts(w, 1) as i
  from (select piece, lang, regexp_extract_all(text, '[^\x20\x09]+') as w from pieces)),
near as (
  select lang, word as x, lead(word) over (partition by piece order by i) as y, lead(word, 2) over (partition by piece order by i) as z
  from places),
ones as (select lang, x, count(*)::hugeint as f from near group by all),
twos as (select lang, x, y, count(*)::hugeint as a from near where y is not null group by all having count(*) >= 10),
threes as (
  select lang, x, y, z, count(*)::hugeint as a from near where z is not null group by all having count(*) >= 10),
inside as (
  select lang, x, y, max(a) as longer from (
    select lang, x, y, a from threes union all select lang, y, z, a from threes) group by all),
cuts as (
  select t.lang, t.x || ' ' || t.y as phrase, t.a, p.f as l, q.f as r, 1 as k, (1000000::hugeint * t.a * t.a) // (p.f * q.f) as score
  from twos t join ones p on p.lang = t.lang and p.x = t.x join ones q on q.lang = t.lang and q.x = t.y
  left join inside i on i.lang = t.lang and i.x = t.x and i.y = t.y
  where i.longer is null or 100 * i.longer < 50 * t.a
  union all
  select t.lang, t.x || ' ' || t.y || ' ' || t.z, t.a, p.f, q.a, 1, (1000000::hugeint * t.a * t.a) // (p.f * q.a)
  from threes t join ones p on p.lang = t.lang and p.x = t.x join twos q on q.lang = t.lang and q.x = t.y and q.y = t.z
  union all
  select t.lang, t.x || ' ' || t.y || ' ' || t.z, t.a, p.a, q.f, 2, (1000000::hugeint * t.a * t.a) // (p.a * q.f)
  from threes t join twos p on p.lang = t.lang and p.x = t.x and p.y = t.y join ones q on q.lang = t.lang and q.x = t.z),
scored as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
sums as (select lang, sum(f) as n from ones group by all)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase,
       a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from scored join sums using (lang)
qualify rank <= 2000
"""
