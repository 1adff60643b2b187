"""Clashing column names, repeated ids and rows, short items, relative links, foreign texts, very long texts."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstrata.llm import (
    cdc_dedup,
    decontaminate,
    language_id,
    mixing,
    prob_minhash,
    quality_rules,
    secret_scan,
    store,
    suffix_array,
    token_counts,
    url_filters,
)
from inkstrata.llm import textbatch as tb

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PAIR = "doc_id long, text string"
#: Names that the operators use themselves.
CLASHES = (
    "repeated", "stay_id", "stay_text", "stay_more", "runs", "random_runs", "spans", "base_spans", "copies", "mix_words", "mix_key",
    "mix_rows", "row_key", "size", "rows", "once", "turn", "n_tokens", "best_score", "lang_pred", "score", "same", "class", "k", "rid",
    "place", "words_", "features_", "llr", "draw", "c0_", "c1_", "held_out", "item_id", "n_shared", "containment",
)


@pytest.fixture(scope="module")
def odd(spark, tiny):
    """Documents with a column of every name that the operators use, and null and repeated rows."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("doc_id < 60")
    docs = docs.unionByName(docs.where("doc_id in (3, 4)")).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    docs = docs.unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    return store.shelve(docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES]), "odd")


def test_callers_columns_pass_through(spark, tiny, odd):
    labels, items = (spark.read.parquet(f"{tiny}/{x}.parquet") for x in ("labels", "benchmark"))
    n, plain = odd.count(), odd.select("doc_id", "text", "lang", "source", "n_chars")
    for stage in (
        language_id.keep_known, prob_minhash.deduplicate, secret_scan.redact, lambda d: decontaminate.clean(d, items),
    ):
        out, want = stage(odd), stage(plain)
        assert out.columns == odd.columns
        assert Counter(map(tuple, out.select(plain.columns).collect())) == Counter(map(tuple, want.collect()))
        assert out.where("doc_id is not null and repeated <> concat('repeated', doc_id)").count() == 0
    drawn = mixing.sample(odd)
    assert drawn.columns == [*(c for c in odd.columns if c != "copies"), "copies"]
    assert drawn.where("copies not between 1 and 3").count() == 0
    total = drawn.select(F.sum(F.col("copies") * mixing.word_count())).first()[0]
    assert total == mixing.mix(odd).agg(F.sum("taken")).first()[0]
    assert mixing.mix(odd).count() == n
    for found, want in (
        (secret_scan.digest(odd), secret_scan.digest(plain)),
        (quality_rules.judge(odd, labels), quality_rules.judge(plain, labels)),
        (prob_minhash.classes(odd), prob_minhash.classes(plain)),
        (cdc_dedup.repeated_spans(odd), cdc_dedup.repeated_spans(plain)),
        (suffix_array.matches(odd), suffix_array.matches(plain)),
        (language_id.identify(odd), language_id.identify(plain)),
    ):
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    counted = token_counts.count_tokens(odd, VOCABULARY)
    assert counted.count() == n and counted.schema["n_tokens"].dataType.simpleString() == "bigint"
    met = decontaminate.contaminated(odd, items, ["doc_id", "item_id", "containment", "n_shared"])
    assert met.columns == ["doc_id", "item_id", "containment", "n_shared", "item_id_", "n_shared_", "n_item", "containment_"]
    assert met.count() == decontaminate.contaminated(plain, items, ["doc_id"]).count()


def test_one_document_of_each_class_stays(spark):
    rows = [(3, "t " * 9), (5, "u v w x y z"), (5, "t " * 9), (5, "t " * 9), (6, "u v w x y z!"), (7, ""), (7, ""), (7, None), (8, "12 a")]
    kept = prob_minhash.deduplicate(spark.createDataFrame(rows, PAIR)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(3, "t " * 9), (5, "u v w x y z"), (7, ""), (7, None), (8, "12 a")])


def test_bands_follow_the_similarity():
    for similarity in (0.4, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0):
        bands, rows = prob_minhash.banding(similarity)
        assert (1 - similarity**rows) ** bands <= prob_minhash.MISS and bands * rows <= prob_minhash.MOST_REGISTERS
    assert prob_minhash.banding(0.8) == (25, 5)


@pytest.mark.parametrize("similarity", [0.5, 0.9])
def test_near_duplicates_at_other_similarities(spark, similarity):
    from test_operators import classes_by_force

    rng = random.Random(14)
    words = [f"v{i}" for i in range(3000)]
    rows = []
    for _ in range(12):
        text = rng.choices(words, k=120)
        for _ in range(6):
            copy = list(text)
            for _ in range(rng.randint(0, 14)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    got = {r.doc_id: r.class_id for r in prob_minhash.classes(spark.createDataFrame(rows, PAIR), similarity).collect()}
    assert got == classes_by_force(rows, similarity)


def test_foreign_texts_are_rejected(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    foreign = ["Привет, как дела? Это русский текст.", "这是一个中文句子。" * 3, "Καλημέρα κόσμε, τι κάνεις σήμερα;", "?! 12", "", None]
    more = spark.createDataFrame([(10**6 + i, t, None, None, None) for i, t in enumerate(foreign)], docs.schema)
    kept = {r.doc_id for r in language_id.keep_known(docs.unionByName(more)).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.where(docs.text.rlike(r"\p{L}")).select("doc_id").collect()}
    assert language_id.keep_known(docs.limit(0)).count() == 0


def test_language_sample_is_bounded_and_exact(spark, monkeypatch):
    """The sample is the least hashes of each language, repeated rows once."""
    rows = [(i, f"text number {i} of one", "en" if i % 3 else "fr") for i in range(3000)] + [(1, "text number 1 of one", "en")] * 2000
    df = spark.createDataFrame([*rows, (None, "no id", "en")], "doc_id long, text string, lang string")
    seen = []
    own = language_id.LanguageModel.__init__
    monkeypatch.setattr(language_id.LanguageModel, "__init__", lambda self, *a: (seen.append(a), own(self, *a))[1])
    language_id.LanguageModel.fit(df, train_per_language=50, buckets=256, alpha=0.5)
    drawn = df.where("doc_id is not null").distinct().withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    want = defaultdict(list)
    for r in sorted(drawn.collect(), key=lambda r: (r.h, r.doc_id)):
        want[r.lang].append(r.text)
    languages, _, counts = seen[0]
    for k, lang in enumerate(languages):
        assert (counts[k] - 0.5).sum() == sum(len(t) + len(t) - 1 + len(t) - 2 for t in want[lang][:50])


def test_short_items_inside_long_documents(spark):
    rng = random.Random(15)
    filler = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    items = [(1, "alpha bravo charlie delta"), (2, "Echo"), (3, "alpha bravo"), (4, ""), (None, "golf hotel"), (3, "alpha bravo")]
    docs = [
        (1, f"{filler(100)} Alpha, bravo charlie-delta {filler(9)}"), (2, "alpha bravo charlie"), (3, f"x echo{filler(3)}"),
        (4, "echo"), (5, "alpha x bravo charlie delta"), (6, "golf hotel india"), (None, "ECHO!"), (7, None),
    ]
    d, b = spark.createDataFrame(docs, PAIR), spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.contaminated(d, b, ["doc_id"]).collect())
    want = {(1, 1, 1, 1): 1, (1, 3, 1, 1): 2, (2, 3, 1, 1): 2, (4, 2, 1, 1): 1, (6, None, 1, 1): 1, (None, 2, 1, 1): 1}
    assert got == want
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {3, 5, 7}


def test_links_are_resolved(spark):
    import duckdb

    page = "http://www.a.com/x/y/z.html?q=1"
    wanted = {
        "http://b.com/1": "http://b.com/1", "//c.com/k?a=1&amp;b=2": "http://c.com/k?a=1&b=2", "/r/s": "http://www.a.com/r/s",
        "p.html": "http://www.a.com/x/y/p.html", "../p": "http://www.a.com/x/p", "../../../p?z": "http://www.a.com/p?z",
        "./q/./w": "http://www.a.com/x/y/q/w", "?n=2": "http://www.a.com/x/y/z.html?n=2", "#top": None, "mailto:a@b.c": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in wanted], "l string")
    out = url_filters.resolved(F.replace("l", F.lit("&amp;"), F.lit("&")), F.lit(page))
    assert {r.l: r.to for r in df.select("l", out.alias("to")).collect()} == wanted
    link = '<link rel="canonical" href="{}">'
    rows = [(i, f"http://h{i}.example.com/en/a/{i}", link.format(l)) for i, l in enumerate(wanted)]
    rows += [(50, "http://x.example.com/en/p", link.format("../de/1")), (51, "http://x.example.com", link.format("de/2"))]
    rows += [(52, "http://c.com/k?b=2&a=1", None), (53, "http://c.com/k?a=1&b=2", link.format("//d.example.com/de/3"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filters.judge(df).collect()}
    assert got[50] == got[51] == got[53] == got[1] == "block" and got[52] == got[0] == "allow"
    base = duckdb.connect()
    base.register("pages", pa.Table.from_pylist([dict(zip(("page_id", "url", "html"), r)) for r in rows]))
    assert {r[0]: r[4] for r in base.execute(url_filters.ORACLE).fetchall()} == got


def test_token_counts_of_the_real_vocabulary():
    """Counts under the whole vocabulary equal those of the tokenizers library's unigram model with the same pieces."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, unknown = token_counts.vocabulary(VOCABULARY)
    library = Tokenizer(models.Unigram(pieces, unknown, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter, rng = token_counts.Counter(pieces), random.Random(16)
    words = ["the", "internationalisation", "Über", "naïve", "数据", "x=1;", "\n\n", "I'm", "1234567", "\U0001f600", "ßß", "  "]
    for _ in range(300):
        text = " ".join(rng.choice(words) + rng.choice(["", "s", ",", "."]) for _ in range(rng.randint(0, 40)))
        assert counter.text(text)[0] == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_very_long_texts(spark, tiny):
    """One text above the block size of every operator, found and judged whole."""
    rng = random.Random(17)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(5000)]
    text = " ".join(rng.choices(words, k=480_000))
    assert len(text) > 3_000_000  # blocks are of 2 MB
    item = text[-400:].split(" ", 1)[1]
    key = "password=abcdef0123456789 "
    rows = [(1, text, "en"), (2, text + " end", "en"), (3, key + text, "fr"), (4, item, "fr"), (5, "short", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).repartition(2)
    assert {r.doc_id: r.class_id for r in prob_minhash.classes(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(df, items, ["doc_id"]).collect()} == {1, 2, 3, 4}
    n = len(text.split())
    spans = {(r.doc_id, r.n_words, r.first_doc_id, r.first_word, r.is_first) for r in suffix_array.matches(df).collect()}
    m = len(item.split())
    assert spans == {(1, n, 1, 0, True), (2, n, 1, 0, False), (3, n, 1, 0, False), (4, m, 1, n - m, False)}
    chunks = cdc_dedup.repeated_spans(df).collect()
    assert max(r.end - r.start for r in chunks if r.doc_id == 2) > len(text) - 300
    assert {r.doc_id: r.n_assign for r in secret_scan.digest(df).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
    assert {r.doc_id: r.lang_pred for r in language_id.identify(df).collect()}.keys() == {1, 2, 3, 4, 5}
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_words for r in quality_rules.judge(df.where("doc_id in (1, 4)"), labels).collect()} == {1: n, 4: m}
    assert mixing.mix(df).agg(F.sum("size")).first()[0] == 3 * n + m + 3
    assert token_counts.count_tokens(df.where("doc_id = 1"), VOCABULARY).first().n_tokens > n


def test_hashes_by_pieces_are_those_of_the_whole(monkeypatch):
    rng = random.Random(18)
    raw = np.frombuffer(bytes(rng.choices(b"abc  ", k=5000)) + b"x" * 3000 + b" end", np.uint8)
    starts, ends, _ = tb.words(raw, np.array([0, len(raw)]), tb.space_table())
    whole = tb.range_hashes(raw, starts, ends)
    monkeypatch.setattr(tb, "PIECE", 64)
    assert (tb.range_hashes(raw, starts, ends) == whole).all()
    own = [tb.range_hashes(raw[a:b], np.array([0]), np.array([b - a]))[0] for a, b in zip(starts, ends)]
    assert (np.array(own) == whole).all()
