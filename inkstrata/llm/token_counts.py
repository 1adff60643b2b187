"""Token counts under a unigram tokenizer, without building any token list.

The tokenizer is a unigram model over the pieces and scores of a vocabulary
file, after the usual meta-space step: blanks become U+2581, one is put in front
of a text that has none there, and words start at each of them. A word's best
segmentation is found by Viterbi: an Aho-Corasick automaton enumerates the
pieces that end at each position, and dynamic programming carries the best score
and its number of pieces only. Tie rules are those of the tokenizers library: of
equal scores the piece that starts first wins; a character without a piece of
its own costs ten less than the worst score; runs of such characters fuse and
then fall back to one piece for each byte.

Distinct words of up to ``CACHED`` characters are segmented once a task and then
looked up, so the work follows the number of distinct words.

Defined results: null and empty texts have 0 tokens and score 0. Rows are
independent, so repeated rows each get a count, and empty tables give no rows. Ties
between segmentations go by the rules above. Texts of any length are counted whole;
a word costs its length times the longest piece. Extra columns pass through; those
named ``n_tokens`` or ``best_score`` give way to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

META = "▁"
CACHED = 64
CACHE_ENTRIES = 400_000
UNKNOWN_COST = 10.0


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores, and the index of the unknown piece, of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class Counter:
    """Best score and piece count of words under one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_COST
        known = {piece for piece, _ in pieces}
        self.byte_pieces = all(f"<0x{b:02X}>" in known for b in range(256))
        self.cache: dict[str, tuple[float, int]] = {}

    def word(self, word: str) -> tuple[float, int]:
        found = self.cache.get(word)
        if found is None:
            found = self.viterbi(word)
            if len(word) <= CACHED:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def viterbi(self, word: str) -> tuple[float, int]:
        n = len(word)
        score: list[float] = [0.0] * (n + 1)
        count = [0] * (n + 1)
        fused = [False] * (n + 1)
        done = 0
        matches = self.automaton.iter(word)
        pending = next(matches, None)
        for end in range(1, n + 1):
            best, pieces, unknown, single = None, 0, False, False
            while pending is not None and pending[0] + 1 == end:  # the longest piece, so the first start, comes first
                length, value = pending[1]
                candidate = value + score[end - length]
                if best is None or candidate > best:
                    best, pieces = candidate, count[end - length] + 1
                single |= length == 1
                pending = next(matches, None)
            if not single:
                candidate = self.unknown + score[end - 1]
                if best is None or candidate > best:
                    best, unknown = candidate, True
                    if self.byte_pieces:
                        pieces = count[end - 1] + len(word[end - 1].encode("utf-8"))
                    else:
                        pieces = count[end - 1] + (not fused[end - 1])
            score[end], count[end], fused[end] = best, pieces, unknown
            done = end
        return score[done], count[done]

    def text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(" ", META)
        if text[0] != META:
            text = META + text
        total, tokens, word = 0.0, 0, self.word
        for rest in text.split(META)[1:]:
            value, pieces = word(META + rest)
            total += value
            tokens += pieces
        return tokens, total


def counts(pieces: list[tuple[str, float]], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces)
        for batch in batches:
            found = [counter.text(x) for x in batch.column(column).to_pylist()]
            out = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64())],
                names=[*batch.schema.names, "n_tokens", "best_score"],
            )

    return run


def count_tokens(df: DataFrame, vocabulary_path: str, column: str = "text") -> DataFrame:
    """``df`` with ``n_tokens`` and the Viterbi score ``best_score``.

    The driver reads the vocabulary; its pieces travel with the task, so
    executors need no such file.
    """
    pieces, _ = vocabulary(vocabulary_path)
    base = df.drop("n_tokens", "best_score")
    schema = T.StructType(
        [*base.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("best_score", T.DoubleType())]
    )
    return base.mapInArrow(counts(pieces, column), schema)
