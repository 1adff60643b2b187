"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of one to three characters, hashed into ``buckets``
columns, on at most ``train_per_language`` labelled documents of each language
(those with the least hash of id and text; whole texts). The smoothed
log-probability matrix (languages x buckets) is a closure broadcast to the
executors; scoring gathers its columns for each n-gram of a batch and sums them
by document, a sparse product done by numpy in blocks of bounded size.

The posterior of a long text is 0 or 1, whatever the text is, so filtering goes by
the mean log-probability of its n-grams under the language found: a document is
known when that lies nearer to the language's own mean than to the mean of n-grams
drawn evenly from all buckets, allowing for the spread of short texts.

Defined results: a null text, or one without a letter, gets ``und`` and score 0;
so does every text when there is nothing to learn from. Ties go to the language
that comes first by code point. Rows are independent: repeated rows and repeated
ids each get a prediction, but rows that repeat id and text are learned once, and
those with a null id not at all. Texts of any length are read whole. Extra columns
pass through; those named ``lang_pred`` or ``score`` give way to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbatch as tb

SIZES = (1, 2, 3)
BLOCK = 1 << 18


def grams(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every character n-gram; runs of white space count as one blank."""
    chars = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    ends = tb.code_points(raw)[offsets]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(ends))
    blank = np.zeros(len(chars), bool)
    for c in tb.SPACE_BYTES:
        blank |= chars == c
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    chars, owner = np.where(blank, np.uint32(32), chars)[keep].astype(tb.U64), owner[keep]
    found, owners = [], []
    for size in SIZES:
        at, value = tb.windows(chars + tb.U64(size << 32), owner, size)
        found.append((value >> tb.U64(20)) % tb.U64(buckets))
        owners.append(owner[at])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners)


def lowered(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(column)


def counter(languages: list[str], buckets: int):
    """Executor side of training: n-gram counts by language, one table a task."""
    index = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(index), buckets), np.int64)
        for batch in tb.blocks(batches, "text", BLOCK):
            labels = np.array([index[x] for x in batch.column("lang").to_pylist()])
            bucket, owner = grams(*tb.utf8(lowered(batch.column("text"))), buckets)
            total += np.bincount(labels[owner] * buckets + bucket, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at // buckets, pa.int32()), pa.array(at % buckets, pa.int32()), pa.array(total.ravel()[at])],
            names=["label", "bucket", "n"],
        )

    return count


def judge(column: pa.Array, languages: list[str], flat: np.ndarray) -> tuple[np.ndarray, ...]:
    """Whether each text has a letter, its arg-max language (an index), the posterior and log-likelihood of that, and n-grams."""
    texts = lowered(column)
    n = len(texts)
    lettered = np.array([x is not None and any(map(str.isalpha, x)) for x in texts.to_pylist()], bool)
    if not languages:
        return np.zeros(n, bool), np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n)
    bucket, owner = grams(*tb.utf8(texts), len(flat))
    total = np.stack([np.bincount(owner, flat[bucket, k], n) for k in range(len(languages))], axis=1)
    best = total.argmax(axis=1)
    own = total[np.arange(n), best]
    return lettered, best, 1 / np.exp(total - own[:, None]).sum(axis=1), own, np.bincount(owner, minlength=n)


def scorer(languages: list[str], logs: np.ndarray, column: str):
    """Executor side of prediction: language and score of each row."""
    flat = np.ascontiguousarray(logs.T)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.blocks(batches, column, BLOCK):
            lettered, best, posterior, *_ = judge(batch.column(column), languages, flat)
            names = [languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
            out = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(names, pa.string()), pa.array(np.where(lettered, posterior, 0.0))],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return score


def keeper(model: LanguageModel, column: str):
    """Executor side of filtering: batches without the rows whose language is not known."""
    languages, flat = model.languages, np.ascontiguousarray(model.logs.T)
    middle, spread = (model.own + model.strange) / 2, model.spread

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.blocks(batches, column, BLOCK):
            lettered, best, _, total, n = judge(batch.column(column), languages, flat)
            mean = total / np.maximum(n, 1)
            # Up to three n-grams share a character, so a third of them are counted as draws.
            known = mean >= middle[best] - 2 * spread[best] / np.sqrt(np.maximum(n, 1) / 3)
            yield batch.filter(pa.array(lettered & known))

    return keep


class LanguageModel:
    """Log-probabilities by language and bucket, and the mean and deviation of n-grams by language."""

    def __init__(self, languages: list[str], logs: np.ndarray, counts: np.ndarray | None = None):
        self.languages, self.logs = languages, logs
        share = np.exp(logs) if counts is None else counts / counts.sum(axis=1, keepdims=True)
        self.own = (share * logs).sum(axis=1)
        self.spread = np.sqrt((share * (logs - self.own[:, None]) ** 2).sum(axis=1))
        self.strange = logs.mean(axis=1) if len(logs) else np.zeros(0)

    @classmethod
    def fit(
        cls, labelled: DataFrame, train_per_language: int = 4000, buckets: int = 1 << 15, alpha: float = 0.5
    ) -> LanguageModel:
        """Learn from ``labelled(doc_id, text, lang)``; rows with a null are skipped.

        The matrix has (languages x buckets) doubles, however many rows there are.
        The sample is ranked among the rows below a hash that leaves about half as
        many again as are wanted, so no task sorts a whole language.
        """
        spark = labelled.sparkSession
        usable = labelled.where("doc_id is not null and text is not null and lang is not null").select(
            "doc_id", "text", "lang", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("draw")
        )
        distinct = usable.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n"))
        sizes = {r["lang"]: max(1, r["n"]) for r in distinct.collect()}  # one row a language
        languages = sorted(sizes)
        if not languages:
            return cls([], np.zeros((0, buckets)))
        most = (1 << 63) - 1
        below = {k: min(most, int((1.5 * train_per_language + 100) / n * most)) for k, n in sizes.items()}
        limit = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])
        order = Window.partitionBy("lang").orderBy("draw", "doc_id")
        chosen = (
            usable.where(F.col("draw") <= limit[F.col("lang")])
            .select("draw", "doc_id", "lang")
            .distinct()
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= train_per_language)
            .drop("rank")
        )
        picked = chosen.collect()  # train_per_language keys a language at most
        ids = spark.createDataFrame(picked, chosen.schema)
        sample = usable.join(F.broadcast(ids), chosen.columns, "left_semi").dropDuplicates(chosen.columns)
        counts = sample.mapInArrow(counter(languages, buckets), "label int, bucket int, n long")
        total = np.zeros((len(languages), buckets))
        for r in counts.groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect():
            total[r["label"], r["bucket"]] = r["n"]
        smooth = total + alpha
        return cls(languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)), smooth)

    def predict(self, df: DataFrame, column: str = "text") -> DataFrame:
        """``df`` with ``lang_pred`` and ``score``, added after dropping columns of those names."""
        base = df.drop("lang_pred", "score")
        schema = T.StructType(
            [*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
        )
        return base.mapInArrow(scorer(self.languages, self.logs, column), schema)


def held_out(doc_id: str = "doc_id", fold: int = 2, folds: int = 4):
    """Whether crc32 of the id as text leaves remainder ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def identify(documents: DataFrame, **options) -> DataFrame:
    """Predictions for all documents by a model of those that are not held out: the query's contract."""
    model = LanguageModel.fit(documents.where(~held_out()), **options)
    flagged = documents.select("doc_id", "text", held_out().alias("held_out"))
    return model.predict(flagged).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(documents: DataFrame) -> DataFrame:
    """Documents whose language is known: those without letters, or unlike all languages learned, go."""
    model = LanguageModel.fit(documents.where(~held_out()))
    if not model.languages:
        return documents
    return documents.mapInArrow(keeper(model, "text"), documents.schema)
