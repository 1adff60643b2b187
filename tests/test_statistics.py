"""Statistics, localization, quality and spans against plain Python."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from inkstrata.operators import closed_vocabulary, detect, localize, metrics, protocol, quality, records, scan, spans


def test_threshold_and_rate(spark):
    rows = [("g", False, float(i)) for i in range(100)] + [("g", True, 100.0), ("g", True, 0.0)]
    df = spark.createDataFrame(rows, "g string, positive boolean, score double")
    assert metrics.tpr_at_fpr(df, 0.01, ["g"]).first().tpr == 0.5
    assert metrics.thresholds(df.where("not positive").limit(50), 0.01, ["g"]).first().threshold is None


def test_auroc_with_ties(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.random() < 0.4, float(rng.randint(0, 9))) for _ in range(300)]
    got = {r.g: r.auroc for r in metrics.auroc(spark.createDataFrame(rows, "g int, positive boolean, score double"), ["g"]).collect()}
    for g in (0, 1):
        p = [s for h, y, s in rows if h == g and y]
        n = [s for h, y, s in rows if h == g and not y]
        want = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
        assert math.isclose(got[g], want)


def test_sign_test_is_the_binomial_tail(spark):
    rows = [(a, b) for a in range(0, 9) for b in range(0, 9)]
    df = spark.createDataFrame(rows, "a long, b long").withColumn("p", metrics.sign_test("a", "b"))
    for r in df.collect():
        n, k = r.a + r.b, min(r.a, r.b)
        assert math.isclose(r.p, min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n), rel_tol=1e-9)


def test_holm(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.5))], "f string, i int, p_value double")
    got = [round(r.adjusted, 9) for r in metrics.holm(df, ["f"], "i").orderBy("i").collect()]
    assert got == [0.04, 0.09, 0.09, 0.5]


def test_alpha_of_agreement(spark):
    rows = [("d", u, r) for u, r in ((1, 3), (1, 3), (2, 5), (2, 5))]
    assert metrics.interval_alpha(spark.createDataFrame(rows, "dimension string, unit int, rating int")).first().alpha == 1.0


def test_kgw_against_python(spark):
    text = "It's the end of the world, it's the end. " * 3
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = detect.score(df, "kgw-word-v1").first()
    words = df.select(detect.tokens(F.col("text"))).first()[0]
    big = list(dict.fromkeys(zip(words, words[1:])))
    hash_ = lambda *p: (int.from_bytes(hashlib.sha256("\x1f".join(p).encode()).digest()[:8], "big") + 0.5) / 2**64
    hits = sum(hash_(detect.KEY, "kgw-word-v1", a, b) < 0.25 for a, b in big)
    assert got.effective_tokens == len(big)
    assert math.isclose(got.score, (hits - 0.25 * len(big)) / math.sqrt(len(big) * 0.1875))


def test_unsupported_names_never_score(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    rows = detect.evidence(df).where("scheme = 'vendor-production'").collect()
    assert [(r.status, r.score) for r in rows] == [("unsupported", None)]


def test_localize_marks(spark):
    rows = [(1, "x" * 3000 + "MARK" + "y" * 3000), (2, "MARK"), (3, "nothing"), (4, None)]
    spans_, report = localize.localize(
        spark.createDataFrame(rows, "doc_id long, text string"), localize.contains_detector("MARK"), calibrated=True
    )
    got = {r.doc_id: (r.start, r.end) for r in spans_.collect()}
    assert got[2] == (0, 4) and got[1][0] <= 3000 and got[1][1] >= 3004
    assert {r.doc_id: r.status for r in report.where("doc_id < 4").collect()} == {1: "localized", 2: "localized", 3: "not_detected"}


def test_quality_reasons(spark):
    rows = [
        (1, "We must pay 12 kg by May 3, 2020.", "We must pay 12 kg by May 3, 2020."),
        (2, "See https://a.example/x and call 5 now", "See it and call now"),
        (3, "It is not true", "It is true"),
        (4, "# Title\ntext here", "Title\ntext here"),
        (5, '{"a": "x", "b": 1}', '{"a": "y", "b": 2}'),
        (6, "one two", "one [BLANK]"),
    ]
    got = {r.id: r.reasons for r in quality.evaluate(spark.createDataFrame(rows, "id int, source string, candidate string")).collect()}
    assert got[1] == []
    assert "URLs were dropped" in got[2] and "numbers were dropped" in got[2]
    assert "negation changed" in got[3]
    assert got[4] == ["document structure changed"]
    assert "document structure changed" in got[5]
    assert got[6][-1] == "unresolved mask placeholder"


def test_chunks_are_lossless(spark):
    text = ("A sentence here. Another one! " * 40 + "\n\n") * 3 + "z" * 900
    chunks = spark.range(1).select(spans.chunk(F.lit(text), 256)).first()[0]
    assert "".join(chunks) == text and max(map(len, chunks)) <= 256


def test_template(spark):
    text = "alpha beta  gamma delta"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    marked = spark.createDataFrame([(1, 7, 8), (1, 13, 15)], "doc_id long, start int, end int")
    merged = spans.merge(marked, spans.word_spans(docs))
    assert spans.template(docs, merged).first().template == "alpha [BLANK] delta"


def test_changed_lines_and_suppression(spark):
    diff = "--- a/f.txt\n+++ b/f.txt\n@@ -1,2 +1,3 @@\n one\n+two\n three\n+four"
    rows = scan.changed_lines(spark.createDataFrame([(1, diff)], "diff_id int, text string")).collect()
    assert sorted((r.path, r.line) for r in rows) == [("f.txt", 2), ("f.txt", 4)]
    files = spark.createDataFrame([("a.txt", "ok\nhe​llo"), ("b.txt", "x​")], "path string, text string")
    found = scan.scan(files)
    assert [(r.line, r.column, r.codepoint) for r in found.where("path = 'a.txt'").collect()] == [(2, 3, "U+200B")]
    assert [r.path for r in scan.suppress(found, ["a.*"]).collect()] == ["b.txt"]


def test_length_bins(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 63, 64, 511, 512)], "n int").select(protocol.length_bin(F.col("n")))
    assert [r[0] for r in rows.collect()] == ["under_64", "under_64", "64_127", "256_511", "512_up"]


def test_ngram_mean_against_big_integers():
    def wrap(x):
        x &= (1 << 64) - 1
        return x - (1 << 64) if x >> 63 else x

    def fold(now, values):
        for v in values:
            now = wrap(wrap(wrap(now + v) * closed_vocabulary.MULTIPLIER) + 1)
        return now

    rng = random.Random(2)
    ids, keys = [rng.randint(1, 9) for _ in range(120)] + [0, 3, 4, 5, 6, 7], [5, 17]
    import struct

    start = int.from_bytes(hashlib.sha256(struct.pack("<2q", *keys)).digest(), "big") % ((1 << 63) - 1)
    seen, bits = [0] * 16, []
    for i in range(len(ids) - 3):
        context = fold(start, ids[i : i + 3])
        if context not in seen and i + 3 < 120:
            for k in keys:
                v = fold(fold(start, ids[i : i + 4]), [k])
                for _ in range(12):
                    v = fold(v, [1]) >> 5
                bits.append((v >> 30) % 2)
        seen = [context, *seen[:-1]]
    n, mean = closed_vocabulary.ngram_mean(ids, keys, 4, 16, 0)
    assert n == len(bits) // 2 and math.isclose(mean, sum(bits) / len(bits))
    assert closed_vocabulary.ngram_mean([1, 2], keys, 4, 16, 0) == (0, None)


def test_closed_vocabulary_rejects_unknown_words(spark):
    df = spark.createDataFrame([(1, ["a", "b"] * 40), (2, ["a", "?"])], "doc_id int, w array<string>")
    got = closed_vocabulary.transition_score(df, F.col("w"), "ab", [[True, True], [True, True]], 0.25, minimum=2).collect()
    assert {r.doc_id: (r.status, r.effective_tokens) for r in got} == {1: ("not_detected", 2), 2: ("unsupported", 0)}


def test_strict_json(spark):
    rows = [(1, '{"b": 1, "a": [null]}'), (2, '{"a": 1, "a": 2}'), (3, "[NaN]"), (4, None), (5, "nope")]
    got = spark.createDataFrame(rows, "i int, t string").select("i", records.canonical_json("t").alias("c")).collect()
    assert {r.i: r.c for r in got} == {1: '{"a":[null],"b":1}', 2: None, 3: None, 4: None, 5: None}
