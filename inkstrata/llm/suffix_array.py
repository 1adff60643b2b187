"""Suffix-array dedup on a sparse suffix array.

Positions are words (runs without ASCII white space). A suffix is kept only where
its five-word hash is the least of a window of WINDOW positions (a minimiser):
the choice depends on the text alone, so every copy of a passage of ``min_words``
words keeps the same suffixes, one of them within its first WINDOW positions, and
the ``min_words - WINDOW + 1`` words that follow it, its head, lie in the passage.

Kept suffixes are sorted by the hash of their head, then by document and place;
range partitions make the sort distributed, and documents in the sort key split
any hot passage. Neighbours are compared in one pass over each sorted partition:
suffixes with equal heads make a run, named by its first row, and runs that go on
across partitions are joined from two rows of each partition.

Matches of one document with one earlier place at one offset are chained where
their heads overlap: in a chain both texts are equal word by word. Chains are then
extended to the left and right: every passage of ``min_words`` words that reaches
over the ends of a chain, here or in the text it is copied from, and could be
common as the first suffix it must keep has a match, is hashed, sorted and compared
with its neighbours in the same way. Passages that follow each other and have their
first place at one offset become one span, so a span ends exactly where the common
text ends or where another document holds the text first. However long the common
text is, nothing is cut.

Result: one row for each span and document that holds it, the first one included
(``is_first``); ``first_doc_id`` and ``first_word`` name the class by its first
place, the least document id, then word. The words of a span equal the words from
there. Each passage of ``min_words`` words that occurs in two documents lies in a
span of each of its occurrences, and no other passage does. With ``within``, this
holds for passages that occur twice in one document as well. Whoever drops all
spans that are not first keeps every passage's words at an earlier place.

Defined results: null texts and texts of fewer than ``min_words`` words have no
spans, rows with a null id take no part. Rows that repeat id and text are one
document; rows that repeat an id with other texts share the id (matches between
them count only ``within``). Texts of any length are read whole. Extra columns
are ignored, whatever their names. Empty tables give no rows. Passages are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from . import textbatch as tb

GRAM, WINDOW, MIN_WORDS = 5, 14, 50
BLOCK = 1 << 21


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, docs = tb.words(raw, offsets, tb.space_table())
    return tb.range_hashes(raw, starts, ends), starts, ends, docs


def least_grams(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word at which WINDOW grams begin in a row, and where the least of these lies (the leftmost of equals)."""
    at, value = tb.windows(hashes, docs, GRAM)
    n = len(at) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.flatnonzero(docs[at[:n]] == docs[at[WINDOW - 1 :]])
    least, where = value[whole], whole.copy()
    for j in range(1, WINDOW):
        smaller = value[whole + j] < least
        least = np.where(smaller, value[whole + j], least)
        where = np.where(smaller, whole + j, where)
    return at[whole], at[where]


def passages(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position in ``at``."""
    total = np.zeros(len(hashes) + 1, tb.U64)
    np.cumsum(tb.mix(hashes) * tb.powers(len(hashes), tb.BASE), out=total[1:])
    inverse = tb.powers(len(hashes), np.uint64(pow(int(tb.BASE), -1, 1 << 64)))
    return tb.mix((total[at + size] - total[at]) * inverse[at]).view(np.int64)


def names_of(batch: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id of each row, and 32 bits of its text's hash to tell rows of one id apart."""
    whole = tb.range_hashes(raw, offsets[:-1], offsets[1:], 3) if len(raw) else np.zeros(len(offsets) - 1, tb.U64)
    return batch.column("doc_id").to_numpy(zero_copy_only=False), (whole >> tb.U64(32)).astype(np.uint32).view(np.int32)


SUFFIX = "k long, doc_id long, dup int, at int"


def suffixes(min_words: int):
    head = min_words - WINDOW + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.blocks(batches, "text", BLOCK):
            raw, offsets = tb.utf8(batch.column("text"))
            hashes, _, _, docs = word_hashes(raw, offsets)
            stop = np.cumsum(np.bincount(docs, minlength=batch.num_rows))
            at = np.unique(least_grams(hashes, docs)[1])
            at = at[at + head <= stop[docs[at]]]
            owner = docs[at]
            ids, dup = names_of(batch, raw, offsets)
            place = (at - np.append(0, stop)[owner]).astype(np.int32)
            columns = [pa.array(x) for x in (passages(hashes, at, head), ids[owner], dup[owner], place)]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "doc_id", "dup", "at"])

    return run


MATCH = "part int, edge int, k long, doc_id long, dup int, at int, start int, end int, fdoc long, fdup int, fat int"
FIELDS = [x.split()[0] for x in MATCH.split(", ")]
KINDS = [pa.int64() if x.endswith("long") else pa.int32() for x in MATCH.split(", ")]


def runs(within: bool):
    """One pass over a sorted partition: rows whose key another document has too, with the first row of their run.

    Edge 0 rows are decided. Rows of the partition's first run (1) and of its last
    run where that has one document so far (2) are decided by ``resolve`` from a
    summary of the first (3) and last run (4): its first row, and in ``fat``
    whether it has a match already. Rows that wait here are of one document and
    key, so no more than the document has words.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def out(edge: np.ndarray, own: list, first: list) -> pa.RecordBatch:
            columns = [np.full(len(edge), part), edge, *own, *first[1:4]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], names=FIELDS)

        last = waiting = opened = lead = None  # opened: first row, matched, whether it is the partition's first run
        for batch in batches:
            now = [
                batch.column(c).to_numpy(zero_copy_only=False) if c in batch.schema.names else np.zeros(batch.num_rows, np.int32)
                for c in ("k", "doc_id", "dup", "at", "start", "end")
            ]
            fresh = np.zeros(batch.num_rows, bool)  # repeated rows count once
            for c, x in enumerate(now[:4]):
                fresh[1:] |= x[1:] != x[:-1]
                fresh[:1] |= last is None or x[:1] != last[c]
            now = [x[fresh] for x in now]
            if not len(now[0]):
                continue
            last = [x[-1] for x in now[:4]]
            if waiting is not None:
                now = [np.concatenate(x) for x in zip(waiting, now, strict=True)]
            k, doc = now[0], now[1]
            new = np.append(True, k[1:] != k[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(k)) - 1
            first = [x[starts] for x in now]
            matched = (doc[starts] != doc[ends]) | (within & (ends > starts))
            goes_on = opened is not None and waiting is None and opened[0][0] == k[0]
            if goes_on:
                for x, y in zip(first, opened[0], strict=True):
                    x[0] = y
                matched[0] |= opened[1] or within or doc[ends[0]] != first[1][0]
            leads = opened is None or (goes_on and opened[2])
            run = np.cumsum(new) - 1
            edge = np.where(matched[run], 0, -1)
            if leads:
                edge[run == 0] = 1
                lead = [x[:1].copy() for x in first], bool(matched[0])
            final = len(starts) - 1
            waits = not matched[final] and not (leads and not final)
            waiting = [x[starts[final] :] for x in now] if waits else None
            opened = [x[final] for x in first], bool(matched[final]), leads and not final
            keep = edge >= 0
            yield out(edge[keep], [x[keep] for x in now], [x[run[keep]] for x in first])
        if opened is not None:
            yield out(np.array([3]), lead[0], [*lead[0][:3], np.array([lead[1]], np.int32)])
            if waiting is not None:
                yield out(np.full(len(waiting[0]), 2), waiting, [np.repeat(x[:1], len(waiting[0])) for x in waiting])
            if not opened[2]:
                row = [np.array([x]) for x in opened[0]]
                yield out(np.array([4]), row, [*row[:3], np.array([opened[1]], np.int32)])

    return scan


def resolve(edges: list, within: bool) -> list[tuple]:
    """(part, edge, fdoc, fdup, fat) of the open rows that have a match, from the partitions' summaries in order."""
    found: list[tuple] = []
    group, members, matched = None, [], False

    def close() -> None:
        if matched:
            found.extend((*m, group["doc_id"], group["dup"], group["at"]) for m in members)

    for r in sorted(edges, key=lambda r: (r["part"], r["edge"])):
        if group is not None and group["k"] == r["k"]:
            matched = matched or bool(r["fat"]) or within or r["doc_id"] != group["doc_id"]
        else:
            close()
            group, members, matched = r, [], bool(r["fat"])
        members.append((r["part"], r["edge"] - 2))
    close()
    return found


def decide(found: list[tuple]):
    """Rows with a match: decided ones, and open ones of a run in ``found``, which has two rows a partition at most, with its first row."""
    table = np.array([(-1, 0, 0, 0), *sorted((part * 4 + edge, *first) for part, edge, *first in found)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, edge, *first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "edge", *FIELDS[-3:]))
            run_of = np.where(edge > 0, part.astype(np.int64) * 4 + edge, -1)
            at = np.minimum(np.searchsorted(table[:, 0], run_of), len(table) - 1)
            keep = np.flatnonzero(table[at, 0] == run_of)
            named = [np.where(edge > 0, table[at, 1 + i], x)[keep] for i, x in enumerate(first)]
            kept = batch.take(pa.array(keep))
            columns = [*(kept.column(c) for c in FIELDS[:-3]), *(pa.array(x, t) for x, t in zip(named, KINDS[-3:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=FIELDS)

    return run


def repeated(rows: DataFrame, within: bool, label: str) -> DataFrame:
    """Rows (k, doc_id, dup, at, ...) whose key another document has too, with the first row that has it."""
    order = ["k", "doc_id", "dup", "at"]
    seen = store.shelve(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(runs(within), MATCH), label)
    found = resolve(seen.where("edge >= 3").collect(), within)  # two rows a partition at most
    decided = seen.where("edge < 3").mapInArrow(decide(found), MATCH).drop("part", "edge", "k")
    decided._shelf = seen._shelf  # noqa: SLF001
    return decided


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tb.blocks(batches, "text", BLOCK):
        raw, offsets = tb.utf8(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names_of(batch, raw, offsets)[1]), batch.column("text")], names=["doc_id", "dup", "text"]
        )


def chains(batch: pa.RecordBatch, min_words: int, within: bool) -> tuple[list[np.ndarray], tuple[np.ndarray, ...]]:
    """Matched heads of a batch (row, at, fdoc, fdup, fat) in order, and the chains that prove texts to be equal.

    The second part is, for each chain of one other place, the index of its first
    head, and the first and last word at which an equal passage begins; the last
    comes before the first where the chain is shorter than a passage.
    """
    head = min_words - WINDOW + 1
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    dup = batch.column("dup").to_numpy(zero_copy_only=False)
    listed = batch.column("heads")
    flat = listed.flatten()
    row = np.repeat(np.arange(batch.num_rows), np.diff(listed.offsets.to_numpy()))
    columns = [row, *(flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))]
    order = np.lexsort((columns[1], row))
    columns = row, at, fdoc, fdup, fat = [x[order] for x in columns]
    shift = at - fat
    opens = np.ones(len(row), bool)
    opens[1:] = (row[1:] != row[:-1]) | (fdoc[1:] != fdoc[:-1]) | (fdup[1:] != fdup[:-1])
    opens[1:] |= (shift[1:] != shift[:-1]) | (at[1:] > at[:-1] + head)
    a = np.flatnonzero(opens)
    last = at[np.append(a[1:], len(row)) - 1] + head - min_words
    other = fdoc[a] != ids[row[a]]
    if within:
        other |= (fdup[a] != dup[row[a]]) | (shift[a] != 0)
    return columns, (a[other], at[a[other]], last[other])


def copied(min_words: int, within: bool):
    """For each chain, where it begins (end 0) and ends (1) in the document that holds the text first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (_, _, fdoc, fdup, fat), (a, lo, hi) = chains(batch, min_words, within)
            first, last = fat[a], (fat[a] + hi - lo).astype(np.int32)
            end = np.repeat(np.arange(2, dtype=np.int32), len(a))
            columns = [np.tile(fdoc[a], 2), np.tile(fdup[a], 2), end, np.append(first, last), np.append(last, last)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "dup", "end", "at", "upto"])

    return run


def marked(n: int, lo: list[np.ndarray], hi: list[np.ndarray]) -> np.ndarray:
    """Which of ``n`` positions lie between a ``lo`` and its ``hi``, both included."""
    steps = np.zeros(n + 1, np.int64)
    for x, y in zip(lo, hi, strict=True):
        np.add.at(steps, np.clip(x, 0, n), 1)
        np.add.at(steps, np.clip(y + 1, 0, n), -1)
    return np.cumsum(steps[:n]) > 0


PIECE = "k long, doc_id long, dup int, at int, upto int, start int, end int, fdoc long, fdup int, fat int"


def extend(min_words: int, within: bool):
    """Chains, and what they are copied from, as spans (k is null), and the passages at their ends that may be common."""
    names = [x.split()[0] for x in PIECE.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.int32() for x in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.blocks(batches, "text", BLOCK):
            raw, offsets = tb.utf8(batch.column("text"))
            hashes, starts, ends, docs = word_hashes(raw, offsets)
            points = tb.code_points(raw)
            count = np.bincount(docs, minlength=batch.num_rows)
            stop = np.cumsum(count)
            begin = stop - count
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            dup = batch.column("dup").to_numpy(zero_copy_only=False)
            (row, at, fdoc, fdup, fat), (a, lo, hi) = chains(batch, min_words, within)
            a, lo, hi = (x[hi >= lo] for x in (a, lo, hi))
            lo, hi = begin[row[a]] + lo, begin[row[a]] + hi
            matched = np.zeros(len(hashes), bool)
            matched[begin[row] + at] = True
            # What others copy from here, overlaps merged, and the passages about the ends of each copy.
            listed = batch.column("known").fill_null([])
            flat = listed.flatten()
            end, first, last = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            of = np.repeat(begin, np.diff(listed.offsets.to_numpy()))
            first, last = of + first, of + last
            near = marked(len(hashes), [(first - WINDOW + 1)[end == 0], first[end == 1] + 1], [first[end == 0] - 1, (first + WINDOW - 1)[end == 1]])
            whole = (end == 0) & (last >= first)
            order = np.argsort(first[whole], kind="stable")
            first, last = first[whole][order], np.maximum.accumulate(last[whole][order])
            opens = np.append(True, first[1:] > last[:-1] + 1)[: len(first)]
            own = first[opens]
            own_last = last[np.append(np.flatnonzero(opens)[1:], len(first)) - 1] if len(first) else last
            # Passages whose least gram begins a matched head, outside of these.
            maybe, gram = least_grams(hashes, docs)
            maybe = maybe[matched[gram] & (maybe + min_words <= stop[docs[maybe]])]
            maybe = maybe[~marked(len(hashes), [lo], [hi])[maybe] & (near | ~marked(len(hashes), [own], [own_last]))[maybe]]
            n = len(lo) + len(own)
            word, upto = np.concatenate([lo, own, maybe]), np.concatenate([hi, own_last, maybe])
            if not len(word):
                continue
            owner = docs[word]
            base = points[offsets[owner]]
            selves = owner[len(lo) :]
            columns = [
                pa.array(np.append(np.zeros(n, np.int64), passages(hashes, maybe, min_words)), mask=np.arange(len(word)) < n),
                ids[owner],
                dup[owner],
                word - begin[owner],
                upto - begin[owner],
                points[starts[word]] - base,
                points[ends[upto + min_words - 1]] - base,
                np.append(fdoc[a], ids[selves]),
                np.append(fdup[a], dup[selves]),
                np.append(fat[a], word[len(lo) :] - begin[selves]),
            ]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def matches(documents: DataFrame, min_words: int = MIN_WORDS, within: bool = False) -> DataFrame:
    """Maximal common passages: doc_id, start, end (code points), n_words, word, first_doc_id, first_word, is_first."""
    if min_words < WINDOW + GRAM - 1:
        raise ValueError(f"min_words must be {WINDOW + GRAM - 1} or more")
    source = documents.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    kept = store.shelve(source.mapInArrow(suffixes(min_words), SUFFIX), "suffixes")
    heads = repeated(kept, within, "heads")
    store.discard(kept)
    name = ["doc_id", "dup"]
    requests = heads.groupBy(*name).agg(F.collect_list(F.struct("at", "fdoc", "fdup", "fat")).alias("heads"))
    requests = store.shelve(requests, "requests")
    # No more ends than a document has suffixes, however many copies there are.
    known = requests.mapInArrow(copied(min_words, within), "doc_id long, dup int, end int, at int, upto int")
    known = known.groupBy(*name, "end", "at").agg(F.max("upto").alias("upto"))
    known = known.groupBy(*name).agg(F.collect_list(F.struct("end", "at", "upto")).alias("known"))
    texts = source.mapInArrow(keyed, "doc_id long, dup int, text string")
    met = texts.join(requests.hint("merge"), name).join(known.hint("merge"), name, "left")
    met = met.select(*name, "text", "heads", "known")
    pieces = store.shelve(met.mapInArrow(extend(min_words, within), PIECE), "pieces")
    store.discard(heads)
    store.discard(requests)
    ends = repeated(pieces.where("k is not null").select("k", "doc_id", "dup", "at", "start", "end"), within, "ends")
    known = pieces.where("k is null").drop("k").unionByName(ends.withColumn("upto", F.col("at")))
    line = Window.partitionBy("doc_id", "dup").orderBy("at", "upto")
    before = lambda c: F.lag(c).over(line)
    same = (F.col("fdoc") == before("fdoc")) & (F.col("fdup") == before("fdup")) & (F.col("shift") == before("shift"))
    reach = F.max("upto").over(line.rowsBetween(Window.unboundedPreceding, -1))
    follows = same & (F.col("at") <= reach + 1)
    spans = (
        known.withColumn("shift", F.col("at") - F.col("fat"))
        .withColumn("opens", F.when(follows, 0).otherwise(1))
        .withColumn("span", F.sum("opens").over(line))
        .groupBy("doc_id", "dup", "span", "fdoc", "fdup", "shift")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("at").alias("word"), F.max("upto").alias("upto"))
    )
    return spans.select(
        "doc_id",
        "start",
        "end",
        (F.col("upto") - F.col("word") + min_words).cast("int").alias("n_words"),
        "word",
        F.col("fdoc").alias("first_doc_id"),
        (F.col("word") - F.col("shift")).alias("first_word"),
        ((F.col("fdoc") == F.col("doc_id")) & (F.col("fdup") == F.col("dup")) & (F.col("shift") == 0)).alias("is_first"),
    )
