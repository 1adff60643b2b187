"""Places of flagged characters in batches of texts, by array arithmetic.

All texts of a slice are one array of code points; a table of classes by code point
tells what each is. Slices are bounded, so memory does not go with the batch.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import unicode_data as U

#: Bytes of text that are looked at together; a longer text is a slice of its own.
SLICE = 1 << 20
LOOK_THROUGH = 8
RTL_RADIUS = 64
SKIPS, JOINS, REGIONAL, PART, TAG = (1 << i for i in range(5))
NAMES = ("position", "byte_offset", "grapheme_index", "line", "column", "kind", "verdict")
HIT = pa.struct([(n, pa.int32()) for n in NAMES])
HITS = "array<struct<" + ",".join(f"{n}:int" for n in NAMES) + ">>"
CATEGORIES = ("bidi_control", "exotic_space", "homoglyph", "other_invisible", "soft_hyphen", "tags_block", "variation_selector", "zero_width")
BIDI_CONTROL, EXOTIC_SPACE, HOMOGLYPH, OTHER, SOFT_HYPHEN, TAGS, VARIATION, ZERO_WIDTH = range(len(CATEGORIES))
#: What can be said of a flagged character: its disposition and its context.
VERDICTS = (
    ("actionable", "token mixes Latin with a look-alike letter"),
    ("contextual", "token mixes writing systems"),
    ("informational", "look-alike letter in a token of one script"),
    ("informational", "leading byte-order mark"),
    ("informational", "joins emoji or letters of one script"),
    ("contextual", "word joiner may be intended"),
    ("actionable", "no shaping or boundary context"),
    ("informational", "selector follows a fitting base"),
    ("actionable", "selector without glyph context"),
    ("informational", "part of a valid emoji tag sequence"),
    ("actionable", "tag outside a valid emoji tag sequence"),
    ("contextual", "control near right-to-left text"),
    ("actionable", "control without right-to-left text nearby"),
    ("contextual", "spacing may be typographic"),
    ("contextual", "hyphenation may be intended"),
    ("informational", "format character in its own script"),
    ("contextual", "format character of unclear use"),
)
(
    MIXED_LATIN, MIXED, ONE_SCRIPT, LEADING, JOINED, WORD_JOINER, UNJOINED, FITTING, UNFITTING, TAGGED, UNTAGGED, NEAR_RTL, NOT_NEAR_RTL,
    SPACING, HYPHENATION, NATIVE, UNCLEAR,
) = range(len(VERDICTS))
#: A bit for each script, and two more, in the table of traits.
SCRIPTS = tuple(sorted(set(U.SCRIPT_NAMES.values())))
LATIN_SCRIPT, HAN, HANGUL, KHMER = (1 << SCRIPTS.index(s) for s in ("Latin", "Han", "Hangul", "Khmer"))
ANY_SCRIPT, EMOJI, RTL = (1 << len(SCRIPTS)) - 1, 1 << 30, 1 << 31


def ranges() -> list[tuple[int, int, int]]:
    """What code points are: (bit, first, last). Made on the driver, as workers do not have this package."""
    marks = U.ranges_of(lambda cp, category: category[0] == "M")
    selectors = [(0x200C, 0x200D), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF)]
    known = {
        SKIPS: marks + selectors,
        JOINS: [(max(a, 0x300), b) for a, b in marks if b >= 0x300] + selectors + [(0x1F3FB, 0x1F3FF), (0xE0000, 0xE007F), (0x20E3, 0x20E3)],
        REGIONAL: [(0x1F1E6, 0x1F1FF)],
        PART: U.ranges_of(lambda cp, category: category[0] == "M" or cp == 95 or chr(cp).isalnum()),
        TAG: [(0xE0020, 0xE007E)],
    }
    return [(bit, a, b) for bit, held in known.items() for a, b in held]


def traits() -> list[tuple[int, int, int]]:
    """Scripts of code points, emoji and right-to-left ones: (bit, first, last)."""
    known = {1 << SCRIPTS.index(script): runs for script, runs in U.script_ranges().items()}
    known |= {EMOJI: U.EMOJI, RTL: U.ranges_of(lambda cp, category: unicodedata.bidirectional(chr(cp)) in ("R", "AL", "AN"))}
    return [(bit, a, b) for bit, held in known.items() for a, b in held]


def classes(known: list[tuple[int, int, int]], bits: type = np.uint8) -> np.ndarray:
    """The bits of each code point."""
    of = np.zeros(0x110000, bits)
    for bit, a, b in known:
        of[a : b + 1] |= bit
    return of


def split_up(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another: as code points, the byte where each code point begins, and where each text ends."""
    starts = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)
    return np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32), starts, np.searchsorted(starts, ends)


def kinds(flagged: list[int]) -> np.ndarray:
    """The place of each code point among the flagged ones, -1 for the others."""
    of = np.full(0x110000, -1, np.int16)
    of[flagged] = np.arange(len(flagged))
    return of


def nearest(cps: np.ndarray, of: np.ndarray, at: np.ndarray, edge: np.ndarray, step: int) -> np.ndarray:
    """The first character that is no mark, joiner or selector on one side of each hit, 0 without one."""
    out = np.zeros(len(at), np.uint32)
    open_ = np.ones(len(at), bool)
    for k in range(1, LOOK_THROUGH + 1):
        i = at + k * step
        open_ &= (i >= edge) if step < 0 else (i < edge)
        if not open_.any():
            break
        c = cps[np.where(open_, i, 0)]
        found = open_ & (of[c] & SKIPS == 0)
        out[found] = c[found]
        open_ &= ~found
    return out


def borders(cps: np.ndarray, held: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Running number of graphemes that begin; regional indicators pair up from the start of their run."""
    regional = held & REGIONAL != 0
    begin = held & JOINS == 0
    begin[1:] &= (cps[:-1] != 0x200D) | regional[1:]
    if regional.any():
        at = np.flatnonzero(regional)
        fresh = np.r_[True, np.diff(at) > 1] | np.isin(at, begins)
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        begin[at] = (np.arange(len(at)) - start) % 2 == 0
    begin[begins[begins < len(cps)]] = True
    return np.r_[0, np.cumsum(begin)]


def tagged(cps: np.ndarray, held: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each hit is part of an emoji's run of tags, up to and with the closing one."""
    plain = held & TAG != 0
    here = np.arange(len(cps))
    last = np.maximum.accumulate(np.where(plain, -1, here))
    next_ = np.minimum.accumulate(np.where(plain, len(cps), here)[::-1])[::-1]
    closing = cps[at] == 0xE007F
    inner = np.where(closing, np.maximum(at - 1, begin), at)
    base = last[inner]
    opened = plain[inner] & (base >= begin) & (cps[np.maximum(base, 0)] == 0x1F3F4)
    close = np.where(closing, at, next_[at])
    return opened & (close < end) & (cps[np.minimum(close, len(cps) - 1)] == 0xE007F)


def script_mixes(cps: np.ndarray, held: np.ndarray, trait: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Verdicts on look-alike letters by the scripts of the words that they stand in; each word is looked at once."""
    outside = np.flatnonzero(held & PART == 0)
    j = np.searchsorted(outside, at)
    bars = np.r_[-1, outside, len(cps)]
    left, right = np.maximum(begin, bars[j] + 1), np.minimum(end, bars[j + 1])
    left, first, word = np.unique(left, return_index=True, return_inverse=True)
    scripts = np.r_[trait[cps] & ANY_SCRIPT, np.zeros(1, np.uint32)]
    held_by = np.bitwise_or.reduceat(scripts, np.stack([left, right[first]], axis=1).ravel())[::2]
    mixed = held_by & (held_by - 1) != 0
    return np.where(mixed, np.where(held_by & LATIN_SCRIPT != 0, MIXED_LATIN, MIXED), ONE_SCRIPT)[word]


def verdicts(
    cps: np.ndarray, held: np.ndarray, of: np.ndarray, trait: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, category: np.ndarray
) -> np.ndarray:
    """The place in VERDICTS of each hit, by its category and what stands by."""
    if not len(at):
        return np.zeros(0, np.int64)
    cp = cps[at]
    left, right = nearest(cps, of, at, begin, -1), nearest(cps, of, at, end, 1)
    after = np.where(at + 1 < end, cps[np.minimum(at + 1, len(cps) - 1)], 0)
    before_, after_ = trait[left], trait[right]
    both = before_ & after_
    joins = ((cp == 0x200D) & (both & EMOJI != 0)) | (both & ANY_SCRIPT & ~np.uint32(LATIN_SCRIPT) != 0)
    keycap = (cp == 0xFE0F) & (after == 0x20E3) & np.isin(left, [ord(c) for c in "#*0123456789"])
    varies = (before_ & EMOJI != 0) | np.where(cp >= 0xE0100, before_ & HAN != 0, keycap | (left >= 0x80))
    native = np.isin(cp, (0x115F, 0x1160, 0x17B4, 0x17B5)) & ((before_ | after_) & (HANGUL | KHMER) != 0)
    joiner = np.isin(cp, (0x200C, 0x200D)) & joins
    out = np.select(
        [category == ZERO_WIDTH, category == VARIATION, category == EXOTIC_SPACE, category == SOFT_HYPHEN],
        [
            np.select([(cp == 0xFEFF) & (at == begin), joiner, cp == 0x2060], [LEADING, JOINED, WORD_JOINER], UNJOINED),
            np.where((left != 0) & varies, FITTING, UNFITTING),
            SPACING,
            HYPHENATION,
        ],
        np.where(native, NATIVE, UNCLEAR),
    )
    letter, tag, control = (np.flatnonzero(category == c) for c in (HOMOGLYPH, TAGS, BIDI_CONTROL))
    if len(letter):
        out[letter] = script_mixes(cps, held, trait, at[letter], begin[letter], end[letter])
    if len(tag):
        out[tag] = np.where(tagged(cps, held, at[tag], begin[tag], end[tag]), TAGGED, UNTAGGED)
    if len(control):
        passed = np.r_[0, np.cumsum(trait[cps] & RTL != 0)]
        first, last = np.maximum(begin[control], at[control] - RTL_RADIUS), np.minimum(end[control], at[control] + RTL_RADIUS + 1)
        out[control] = np.where(passed[last] > passed[first], NEAR_RTL, NOT_NEAR_RTL)
    return out


def found(points: tuple, of: np.ndarray, trait: np.ndarray, kind_of: np.ndarray, category: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hits of texts one after another, as of ``split_up``: what they hold, where, in which text from where to where, kind and verdict."""
    cps, _, stop = points
    wide = np.flatnonzero(cps > 127)
    kind = kind_of[cps[wide]]
    at = wide[kind >= 0]
    kind = kind[kind >= 0]
    row = np.searchsorted(stop, at, "right")
    begin, end = np.r_[0, stop][row], stop[row]
    held = of[cps]
    return held, at, row, begin, kind, verdicts(cps, held, of, trait, at, begin, end, category[kind])


def placed(points: tuple, ends: np.ndarray, hit: tuple[np.ndarray, ...], graphemes: bool) -> pa.StructArray:
    """Hits as rows; places are those within their text."""
    cps, starts, stop = points
    held, at, row, begin, kind, verdict = hit
    newlines = np.flatnonzero(cps == 10)
    above, first = np.searchsorted(newlines, at), np.searchsorted(newlines, begin)
    last = np.where(above > first, newlines[above - 1] if len(newlines) else -1, begin - 1)
    if graphemes:
        passed = borders(cps, held, np.r_[0, stop][:-1])
        grapheme = passed[at + 1] - passed[begin] - 1
    else:
        grapheme = np.zeros(len(at), np.int64)
    numbers = (at - begin, starts[at] - np.r_[0, ends][row], grapheme, above - first + 1, at - last, kind, verdict)
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in numbers], fields=list(HIT))


def slices(texts: pa.Array):
    """Texts (nulls as empty ones) as (bytes, ends within them), about SLICE bytes each."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        yield data[int(offsets[i]) : int(offsets[j])].to_pybytes() if data is not None else b"", offsets[i + 1 : j + 1] - offsets[i]
        i = j


def looker(letters: bool):
    """What finds hits in texts as of ``split_up``, once it is called in a task. The table of characters is the driver's."""
    table = [row for row in U.flagged_table() if letters or row[1] != "homoglyph"]
    known, more = ranges(), traits()
    flagged, categories = [ord(ch) for ch, *_ in table], [CATEGORIES.index(category) for _, category, *_ in table]

    def made():
        tables = classes(known), classes(more, np.uint32), kinds(flagged), np.array(categories)
        return lambda points: found(points, *tables)

    return made


def finder(graphemes: bool, letters: bool):
    """An Arrow UDF from texts to their hits; null for null."""
    made = looker(letters)

    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        look = made()
        counts, parts = [np.zeros(0, np.int64)], [pa.array([], HIT)]
        for data, ends in slices(texts):
            points = split_up(data, ends)
            hit = look(points)
            counts.append(np.bincount(hit[2], minlength=len(ends)))
            parts.append(placed(points, ends, hit, graphemes))
        offsets = np.r_[0, np.cumsum(np.concatenate(counts))]
        mask = texts.is_null() if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.concat_arrays(parts), mask=mask)

    return hits


COUNTS = ("n", "actionable", "contextual", "informational")
COUNTED = "array<struct<kind:int," + ",".join(f"{n}:bigint" for n in COUNTS) + ",positions:string>>"
FINDING = pa.struct([("kind", pa.int32()), *[(n, pa.int64()) for n in COUNTS], ("positions", pa.string())])


def grouped(hit: tuple[np.ndarray, ...], level: np.ndarray, kinds_: int) -> tuple[np.ndarray, pa.StructArray]:
    """Hits of texts by text and kind: the text of each group, and the groups as rows, with positions as one string."""
    _, at, row, begin, kind, verdict = hit
    group = row.astype(np.int64) * kinds_ + kind
    order = np.argsort(group, kind="stable")
    group = group[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    bars = np.r_[first, len(group)]
    listed = pa.ListArray.from_arrays(pa.array(bars.astype(np.int32)), pa.array((at - begin)[order]).cast(pa.string()))
    of_level = lambda i: np.diff(np.r_[0, np.cumsum(level[verdict[order]] == i)][bars])
    columns = [pa.array((group[first] % kinds_).astype(np.int32)), *map(pa.array, (np.diff(bars), *map(of_level, range(3)))), pc.binary_join(listed, ",")]
    return group[first] // kinds_, pa.StructArray.from_arrays(columns, fields=list(FINDING))


def counter():
    """An Arrow UDF from texts to their flagged characters, counted by kind and disposition; null for null."""
    made, kinds_ = looker(True), len(U.flagged_table())
    levels = [COUNTS.index(level) - 1 for level, _ in VERDICTS]

    @F.arrow_udf(COUNTED)
    def counted(texts: pa.Array) -> pa.Array:
        look, level = made(), np.array(levels)
        counts, parts = [np.zeros(0, np.int64)], [pa.array([], FINDING)]
        for data, ends in slices(texts):
            row, groups = grouped(look(split_up(data, ends)), level, kinds_)
            counts.append(np.bincount(row, minlength=len(ends)))
            parts.append(groups)
        offsets = np.r_[0, np.cumsum(np.concatenate(counts))]
        mask = texts.is_null() if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.concat_arrays(parts), mask=mask)

    return counted


EDIT = pa.struct([(n, pa.int32()) for n in ("position", "output_position", "kind")])
CLEANED = "struct<cleaned:string,n:int,edits:array<struct<position:int,output_position:int,kind:int>>,marks:boolean>"
#: The first code point that NFC can change, alone or with what stands before it.
FIRST_MARK = 0x300


def cleaner(safe: bool, edits: bool):
    """An Arrow UDF from texts to what their policy edits make of them, how many there are, and with ``edits`` all of them in order.

    ``marks`` tells whether what is left holds a character from FIRST_MARK on.

    The safe profile keeps some characters by their rule and verdict. Look-alike letters are no policy edits. An edit is
    numbers alone: batches hold many, and what they stand for is told by the row of ``flagged_table``, its kind.
    """
    table = [row for row in U.flagged_table() if row[1] != "homoglyph"]
    made = looker(False)
    levels = [level for level, _ in VERDICTS]
    keeping = {"preserve": levels, "bidi_context": ["contextual"]}
    keeping |= dict.fromkeys(("join_context", "variation_context", "emoji_tag_context", "script_context"), ["informational"])
    keeps = [[safe and level in keeping.get(rule, ()) for level in levels] for _, _, _, rule, *_ in table]
    leading = [safe and rule == "leading_bom" for _, _, _, rule, *_ in table]
    deleted = [action == "delete" for _, _, action, *_ in table]

    @F.arrow_udf(CLEANED)
    def cleaned(texts: pa.Array) -> pa.Array:
        look, keep, first, delete = made(), np.array(keeps), np.array(leading), np.array(deleted)
        counts, parts, rows, marks = [np.zeros(0, np.int64)], [pa.array([], pa.string())], [pa.array([], EDIT)], [np.zeros(0, bool)]
        for data, ends in slices(texts):
            cps, starts, stop = split_up(data, ends)
            _, at, row, begin, kind, verdict = look((cps, starts, stop))
            done = ~(keep[kind, verdict] | (first[kind] & (at == begin)))
            at, row, begin, kind = at[done], row[done], begin[done], kind[done]
            gone = delete[kind]
            out, stays = cps.copy(), np.ones(len(cps), bool)
            out[at] = 32
            stays[at[gone]] = False
            passed = np.r_[0, np.cumsum(stays)]
            left, until = out[stays], passed[stop]
            parts.append(joined(left, until))
            marks.append(np.isin(np.arange(len(ends)), np.searchsorted(until, np.flatnonzero(left >= FIRST_MARK), "right")))
            counts.append(np.bincount(row, minlength=len(ends)))
            if edits:
                numbers = (at - begin, passed[at] - passed[begin], kind)
                rows.append(pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in numbers], fields=list(EDIT)))
        counted = np.concatenate(counts)
        offsets = np.r_[0, np.cumsum(counted if edits else np.zeros_like(counted))]
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.concat_arrays(rows))
        columns = [pa.concat_arrays(parts), pa.array(counted.astype(np.int32)), lists, pa.array(np.concatenate(marks))]
        return pa.StructArray.from_arrays(columns, names=["cleaned", "n", "edits", "marks"], mask=texts.is_null())

    return cleaned


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def running(values: pa.Array) -> pa.Array:
    """Running sums of each array, its own value included."""
    flat = values.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.where(values.is_null().to_numpy(zero_copy_only=False), 0, values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    offsets = np.r_[0, np.cumsum(sizes)]
    sums = np.r_[0, np.cumsum(flat)]
    out = sums[1:] - np.repeat(sums[offsets[:-1]], sizes)
    mask = values.is_null() if values.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out.astype(np.int32)), mask=mask)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())])))
def lines(texts: pa.Array, positions: pa.Array) -> pa.Array:
    """Line and column (from 1) of each of the ascending positions in a text; only a newline ends a line."""
    flat, sizes = [np.zeros((2, 0), np.int64)], [0]
    for text, at in zip(texts, positions, strict=True):
        at = np.array(at.as_py() or [], np.int64)
        ends = np.flatnonzero(np.frombuffer((text.as_py() or "").encode("utf-32-le"), np.uint32) == 10)
        above = np.searchsorted(ends, at)
        flat.append(np.stack([above + 1, at - np.r_[-1, ends][above]]))
        sizes.append(len(at))
    line, column = np.concatenate(flat, axis=1).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(line), pa.array(column)], names=["line", "column"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), rows)


LATIN, FOREIGN, CLEAR, BLANK, LOOK = (1 << i for i in range(5))
BLANKS = ((9, 13), (28, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def joined(points: np.ndarray, stop: np.ndarray) -> pa.StringArray:
    """Code points as texts that end at ``stop``."""
    data = points.tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    offsets = np.r_[0, np.r_[0, np.cumsum(width)][stop]].astype(np.int32)
    return pa.StringArray.from_buffers(len(stop), pa.py_buffer(offsets), pa.py_buffer(data))


def plain(cps: np.ndarray, stop: np.ndarray, of: np.ndarray, keys: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> pa.StringArray:
    """Look-alikes of texts replaced: all of a text that Latin leads, else those of words with a Latin letter."""
    begin = np.r_[0, stop[:-1]]
    held = of[cps]
    count = lambda bit: np.diff(np.r_[0, np.cumsum(held & bit != 0)][np.r_[0, stop]])
    own = count(LATIN)
    leads = (own >= count(FOREIGN)) | ((own > 0) & (own >= count(CLEAR)))
    blank = held & BLANK != 0
    fresh = np.r_[True, blank[1:] != blank[:-1]]
    fresh[begin[begin < len(cps)]] = True
    latin = np.logical_or.reduceat(held & LATIN != 0, np.flatnonzero(fresh))
    at = np.flatnonzero(held & LOOK)
    word = np.cumsum(fresh)[at] - 1
    at = at[leads[np.searchsorted(stop, at, "right")] | latin[word]]
    kind = np.searchsorted(keys, cps[at])
    many = np.ones(len(cps), np.int64)
    many[at] = sizes[kind]
    ends = np.r_[0, np.cumsum(many)]
    out = np.repeat(cps, many)
    for k in range(values.shape[1]):
        longer = sizes[kind] > k
        out[ends[at[longer]] + k] = values[kind[longer], k]
    return joined(out, ends[stop])


def skeleton():
    """An Arrow UDF from texts to their ASCII skeletons; null for null."""
    table = U.confusables()
    keys = sorted(table)
    wide = max(map(len, table.values()))
    values = [[*map(ord, table[k]), *[0] * (wide - len(table[k]))] for k in keys]
    look_alikes = {ord(k) for k in U.confusables()}
    foreign = [r for script, runs in U.script_ranges().items() if script != "Latin" for r in runs]
    clear = [(cp, cp) for a, b in foreign for cp in range(a, b + 1) if cp not in look_alikes]
    bits = {LATIN: U.script_ranges()["Latin"], FOREIGN: foreign, BLANK: BLANKS, LOOK: [(ord(k), ord(k)) for k in keys]}
    known = [(bit, a, b) for bit, held in bits.items() for a, b in held] + [(CLEAR, a, b) for a, b in merged(clear)]
    points, sizes = [ord(k) for k in keys], [len(table[k]) for k in keys]

    @F.arrow_udf(T.StringType())
    def replaced(texts: pa.Array) -> pa.Array:
        of, parts = classes(known), [pa.array([], pa.string())]
        for data, ends in slices(texts):
            cps, _, stop = split_up(data, ends)
            if len(cps):
                parts.append(plain(cps, stop, of, np.array(points), np.array(values, np.uint32), np.array(sizes)))
            else:
                parts.append(pa.array([""] * len(stop), pa.string()))
        out = pa.concat_arrays(parts)
        return pc.if_else(texts.is_null(), pa.scalar(None, pa.string()), out) if texts.null_count else out

    return replaced


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges with neighbours as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a - 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
