"""Byte-level BPE encoding and decoding with forced boundaries.

A text is split at added tokens, then into pieces by the published rules of
byte-level tokenizers. Two neighbouring bytes that stand together inside no token
of the vocabulary can never be joined by a merge, so a piece is cut for certain
between them. The fragments are encoded independently, each by its merges in order
of rank and then of place, and their ids are concatenated. Cuts, distinct fragments
of a batch and concatenation are numpy and Arrow work; a fragment is merged once a
worker while a bounded cache holds it.

Ids are those of the tokenizers library for the same file, without special tokens
added, truncation or padding; the strings of added tokens inside a text become
their ids, as there. Decoding puts the bytes of all tokens together and reads them
as UTF-8; bytes that are no UTF-8 become U+FFFD, and an id outside the vocabulary
is left out, as there.

Defined results: a null or empty text has no ids, null or empty ids decode to the
empty text. Rows are independent, so repeated rows each get a result and empty
tables give none. Texts of any length are encoded whole, in stretches that end
before white space; a fragment costs about 100 bytes of memory for each of its own
while it is merged. Extra columns pass through; those named as a result give way to it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import textbatch as tb

# The endings that the published pattern of byte-level tokenizers keeps with their apostrophe.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Bytes of text that are cut at once, and ids that are decoded at once, about.
STRETCH = 1 << 21
#: Entries of the cache, and the longest fragment that enters it.
CACHE_ENTRIES = 1_000_000
CACHED = 48
#: Longest fragment whose merges are found by looking at all its pairs each time.
SHORT = 24
NO_MERGE = 1 << 62
ID_BITS = (1 << 32) - 1


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def classes() -> np.ndarray:
    """White space, letter, number or other, by code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    spaces = [c for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
    table[spaces] = SPACE
    return table


def read_points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code point that begins at each of the bytes ``at``."""
    lead = raw[at].astype(np.int64)
    out = lead.copy()
    for size, low, bits in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        mine = np.flatnonzero((lead >= low) & (lead < (low | bits) + 1))
        value = lead[mine] & bits
        for j in range(1, size):
            value = value << 6 | (raw[at[mine] + j] & 0x3F)
        out[mine] = value
    return out


def ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``rows`` of a ragged table, one row after the other, and the number of each."""
    counts = (offsets[1:] - offsets[:-1])[rows]
    begin = np.cumsum(counts) - counts
    return values[np.repeat(offsets[rows] - begin, counts) + np.arange(counts.sum())], counts


class Table:
    """Byte strings by id, laid end to end."""

    def __init__(self, rows: dict[int, bytes]):
        held = [rows.get(i, b"") for i in range(max(rows, default=-1) + 1)]
        self.values = np.frombuffer(b"".join(held), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)

    def join(self, ids: np.ndarray) -> bytes:
        inside = ids[(ids >= 0) & (ids < len(self.offsets) - 1)]
        return ragged(self.values, self.offsets, inside)[0].tobytes()


class Vocabulary:
    """What a tokenizer file says; it travels with tasks, so executors need no such file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        added = spec.get("added_tokens") or []
        if (
            spec.get("normalizer") is not None
            or pre.get("type") != "ByteLevel"
            or pre.get("add_prefix_space")
            or not pre.get("use_regex", True)
            or model.get("type", "BPE") != "BPE"
            or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
            or any(a[k] for a in added for k in ("lstrip", "rstrip", "single_word"))
            or any(c.isspace() for a in added for c in a["content"])
        ):
            raise ValueError("only plain byte-level BPE files are read")
        self.added = {a["content"].encode(): a["id"] for a in added}
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ids: dict[str, int] = model["vocab"]
        self.tokens = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.first = [ids.get(c, -1) for c in byte_letters()]
        #: Rank and id of each merge in one number.
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = rank << 32 | ids[a + b]
        #: Whether two bytes stand together inside any token; if not, a cut between them is certain.
        self.joined = np.zeros((256, 256), bool)
        for token in self.tokens.values():
            raw = np.frombuffer(token, np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        self.tokens |= {i: content for content, i in self.added.items()}


class Encoder:
    """Encodes and decodes texts under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.classes = classes()
        self.bytes = Table(vocabulary.tokens)
        self.digits = Table({i: b"%d," % i for i in range(max(vocabulary.tokens) + 1)})
        self.cache: dict[bytes, bytes] = {}
        self.fixed = {content: np.int32(i).tobytes() for content, i in vocabulary.added.items()}
        self.added = re.compile(b"|".join(map(re.escape, sorted(self.fixed, key=len, reverse=True)))) if self.fixed else None

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where fragments begin in texts laid end to end: pieces, added tokens and forced boundaries."""
        n = len(raw)
        found = np.array([m.span() for m in self.added.finditer(raw)] if self.added else [], np.int64).reshape(-1, 2)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        fresh = np.zeros(n + 1, bool)  # where a text, an added token or what follows one begins
        fresh[offsets] = True
        fresh[found.ravel()] = True
        fresh = fresh[at]
        point = read_points(raw, at)
        kind = self.classes[point]
        begins = np.ones(len(at), bool)
        begins[1:] = fresh[1:] | (kind[1:] != kind[:-1])
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~fresh[1:]) + 1
        begins[after - 1] = True  # the last white space before a word stands apart from those before it
        begins[after[point[after - 1] == 0x20]] = False  # and a blank goes with the word
        quote = np.flatnonzero(point == 0x27)
        follows = quote[~fresh[quote]]
        inner = follows[(kind[follows - 1] == OTHER) | (point[follows - 1] == 0x20)]
        quote = np.setdiff1d(quote, inner, assume_unique=True)
        for ending in CONTRACTIONS:
            size = len(ending)
            here = quote[quote + size <= len(at)]
            for j in range(1, size):
                here = here[(point[here + j] == ord(ending[j])) & ~fresh[here + j]]
            begins[here + 1] = False
            ends = here + size
            begins[ends[ends < len(at)]] = True
        cut = np.zeros(n, bool)
        cut[1:] = ~self.v.joined[raw[:-1], raw[1:]]
        cut[at[begins]] = True
        for a, b in found.tolist():
            cut[a + 1 : b] = False
        return np.flatnonzero(cut)

    def merged(self, fragment: bytes) -> bytes:
        """The int32 ids of one fragment: the pair of lowest rank merges first, of equal ones the leftmost."""
        found = self.cache.get(fragment) or self.fixed.get(fragment)
        if found is None:
            ids = [self.v.first[b] for b in fragment]
            found = np.array(self._short(ids) if len(ids) <= SHORT else self._long(ids), np.int32).tobytes()
            if len(fragment) <= CACHED:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[fragment] = found
        return found

    def _short(self, ids: list[int]) -> list[int]:
        """Merges by looking at all pairs that are left; of equal ones ``index`` finds the leftmost."""
        get = self.v.merges.get
        found = [get(pair, NO_MERGE) for pair in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) < NO_MERGE:
            at = found.index(best)
            joined = best & ID_BITS
            ids[at : at + 2] = [joined]
            del found[at]
            if at < len(found):
                found[at] = get((joined, ids[at + 1]), NO_MERGE)
            if at:
                found[at - 1] = get((ids[at - 1], joined), NO_MERGE)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """Merges by a queue of pairs; an entry whose pair has changed since is passed over."""
        get, n = self.v.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = ((get(pair, NO_MERGE), i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)))
        waiting = [found >> 32 << 40 | i for found, i in ranks if found < NO_MERGE]
        heapq.heapify(waiting)
        while waiting:
            entry = heapq.heappop(waiting)
            at = entry & ((1 << 40) - 1)
            right = after[at]
            if ids[at] < 0 or right >= n:
                continue
            found = get((ids[at], ids[right]), NO_MERGE)
            if found >> 32 != entry >> 40:
                continue
            ids[at], ids[right] = found & ID_BITS, -1
            right = after[at] = after[right]
            if right < n:
                before[right] = at
                if (found := get((ids[at], ids[right]), NO_MERGE)) < NO_MERGE:
                    heapq.heappush(waiting, found >> 32 << 40 | at)
            left = before[at]
            if left >= 0 and (found := get((ids[left], ids[at]), NO_MERGE)) < NO_MERGE:
                heapq.heappush(waiting, found >> 32 << 40 | left)
        return [i for i in ids if i >= 0]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts laid end to end, and the number of each text."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        begin = self.cuts(raw, offsets)
        ends = np.append(begin, len(raw)).astype(np.int32)
        parts = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes())])
        distinct = parts.dictionary_encode()
        rows = [self.merged(x) for x in distinct.dictionary.to_pylist()]
        where = np.concatenate([[0], np.cumsum([len(x) >> 2 for x in rows])])
        ids, counts = ragged(np.frombuffer(b"".join(rows), np.int32), where, distinct.indices.to_numpy())
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[np.searchsorted(begin, offsets)])

    def stretches(self, raw: np.ndarray) -> Iterator[np.ndarray]:
        """One text in stretches that end behind an ASCII letter or digit, before white space."""
        begin = 0
        while len(raw) - begin > 2 * STRETCH:
            end = begin + STRETCH
            while end < len(raw):
                near = raw[end - 1 : end + 4096]
                letter = ~tb.symbol_table()[near[:-1]] & (near[:-1] < 0x80)
                found = np.flatnonzero(letter & tb.space_table()[near[1:]])
                if len(found):
                    end += int(found[0])
                    break
                end += 4096
            yield raw[begin:end]
            begin = min(end, len(raw))
        yield raw[begin:]

    def encode_all(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode``, a very long text by stretches."""
        if len(offsets) != 2 or len(raw) <= 2 * STRETCH:
            return self.encode(raw, offsets)
        ids = np.concatenate([self.encode(x, np.array([0, len(x)]))[0] for x in self.stretches(raw)])
        return ids, np.array([len(ids)])

    def text(self, text: str) -> np.ndarray:
        """The ids of one text."""
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_all(raw, np.array([0, len(raw)]))[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        return b"".join(self.bytes.join(ids[a : a + STRETCH]) for a in range(0, len(ids), STRETCH)).decode("utf-8", "replace")

    def id_digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids, joined by commas."""
        mark, last = hashlib.sha256(), len(ids)
        for a in range(0, last, STRETCH):
            part = self.digits.join(ids[a : a + STRETCH])
            mark.update(part if a + STRETCH < last else part[:-1])
        return mark.hexdigest()


#: The encoder of this worker, by the vocabulary it was made from, so that its caches outlive a task.
_worker: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    mark = hashlib.sha256(spec.encode()).hexdigest()
    if mark not in _worker:
        _worker.clear()
        _worker[mark] = Encoder(Vocabulary(spec))
    return _worker[mark]


def load(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast text: read once on the driver, a few megabytes whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    Vocabulary(spec)
    return spark.sparkContext.broadcast(spec)


Batches = Iterator[pa.RecordBatch]


def _ids(column: pa.Array) -> Iterator[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for i, valid in enumerate(column.is_valid().to_pylist()):
        yield flat[ends[i] : ends[i + 1]] if valid else flat[:0]


def encoded(spec, column: str, name: str) -> Callable[[Batches], Batches]:
    """Batches with the ids of ``column`` as a list column."""

    def run(batches: Batches) -> Batches:
        worker = encoder(spec.value)
        for batch in tb.blocks(batches, column, STRETCH):
            made = tb.lists(*worker.encode_all(*tb.utf8(batch.column(column))), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return run


def decoded(spec, column: str, name: str) -> Callable[[Batches], Batches]:
    """Batches with the text of the ids in ``column``."""

    def run(batches: Batches) -> Batches:
        worker = encoder(spec.value)
        for batch in batches:
            made = pa.array([worker.decode(x) for x in _ids(batch.column(column))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return run


def hashed(spec, keep: list[str], ids: str, text: str) -> Callable[[Batches], Batches]:
    """Batches of the ``keep`` columns with size and digests of ids, and the digest of the decoded text."""

    def run(batches: Batches) -> Batches:
        worker = encoder(spec.value)
        for batch in batches:
            found = [(len(x), worker.id_digest(x)) for x in _ids(batch.column(ids))]
            texts = [hashlib.sha256(x.as_py().encode()).hexdigest() for x in batch.column(text)]
            made = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *made], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return run


def encode(df: DataFrame, vocabulary_path: str, column: str = "text", name: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``column`` as ``name``, an array of int."""
    base = df.drop(name)
    fields = [*base.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType(), False), False)]
    return base.mapInArrow(encoded(load(df.sparkSession, vocabulary_path), column, name), T.StructType(fields))


def decode(df: DataFrame, vocabulary_path: str, column: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in ``column`` as ``name``."""
    base = df.drop(name)
    fields = [*base.schema.fields, T.StructField(name, T.StringType(), False)]
    return base.mapInArrow(decoded(load(df.sparkSession, vocabulary_path), column, name), T.StructType(fields))


def digest(df: DataFrame, vocabulary_path: str, column: str = "text") -> DataFrame:
    """``df`` without ``column``, with n_tokens and the digests of the ids and of the text decoded from them.

    Encoding, decoding and digests are one pass of a Python worker over the same batches.
    """
    spec = load(df.sparkSession, vocabulary_path)
    keep = [f for f in df.schema.fields if f.name.lower() not in (column.lower(), "n_tokens", "ids_sha256", "decoded_sha256")]
    names = [f.name for f in keep]
    base = df.select(*names, df[column].alias("text_"))
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    first, then, last = encoded(spec, "text_", "ids_"), decoded(spec, "ids_", "decoded_"), hashed(spec, names, "ids_", "decoded_")
    return base.mapInArrow(lambda batches: last(then(first(batches))), T.StructType([*keep, *made]))
