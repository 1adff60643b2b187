"""What the third round's review found: results on odd texts, and steps that must not grow faster than the input."""

import numpy as np
from pyspark.sql import functions as F

from inkstrata.operators import closed_vocabulary, covert, detect, inspect, jobs, sanitize, scan, spans


def test_planted_letters_go_from_texts_of_few_letters(spark):
    """Planted letters outnumber the Latin ones here, and whole words are planted; a foreign word stays as it is."""
    texts = ["1 a ace 22 ## 33", "x 77 eco ;;; 8", "oh cape 12", "привет сор", "Москва a", "сор"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    report = sanitize.family_report(covert.plant(df.where("doc_id < 3"), ("homoglyph",))).first()
    assert (report.n, report.restored) == (3, 3)
    marked = covert.plant(df.where("doc_id < 3"), ("homoglyph",)).select("doc_id", F.col("marked").alias("text"))
    rows = marked.unionByName(df.where("doc_id > 2"))
    got = {r.doc_id: r.cleaned for r in sanitize.sanitize(rows, "aggressive").collect()}
    assert got == dict(enumerate(texts))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_flagged_characters_stay_in_their_rows(spark):
    """Inspection, safe edits and located findings shuffle no flagged characters; SARIF logs group them once."""
    df = spark.createDataFrame([(1, "a\u200bb\u00a0c\n\u200c d"), (2, None), (3, "plain")], "doc_id long, text string")
    files = df.select(F.col("doc_id").cast("string").alias("path"), "text")
    found = scan.scan(files)
    assert shuffles(inspect.occurrences(df, graphemes=True, lines=True)) == 0
    assert shuffles(sanitize.sanitize(df)) == shuffles(sanitize.sanitize_with_edits(df, "aggressive")) == shuffles(found) == 0
    assert shuffles(jobs.sarif_logs(found)) == 1
    assert [(r.line, r.column) for r in found.orderBy("line").collect()] == [(1, 2), (2, 1)]
    edits = sanitize.edited(df).where("doc_id = 1").first().edits
    assert [(e.position, e.output_position, e.replacement) for e in edits] == [(1, 1, ""), (3, 2, " "), (6, 5, "")]
    assert {r.doc_id: r.cleaned for r in sanitize.sanitize(df).collect()} == {1: "ab c\n d", 2: None, 3: "plain"}


def test_skeletons_look_at_texts_as_arrays(spark):
    """Letters of several texts in one slice, with longer replacements; foreign words stay in foreign texts."""
    texts = ["раypal æon", "", None, "привет мир раyраl абв", "\u00a0сор x", "“so” ×2", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    made = df.select("i", sanitize.skeleton(F.col("t")).alias("s"))
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
    want = ["paypal aeon", "", None, "привет мир paypal абв", "\u00a0cop x", "''so'' x2", "plain"]
    assert {r.i: r.s for r in made.collect()} == dict(enumerate(want))


def test_evidence_tokenizes_once_and_hashes_in_batches(spark):
    """All schemes come from one pass; a long text of distinct words does not compare every pair of bigrams."""
    text = " ".join(f"w{i}" for i in range(3000)) + " w1 w2"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").coalesce(1)
    made = detect.evidence(df)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "array_distinct" not in plan and "Union" not in plan
    got = {(r.doc_id, r.scheme): (r.status, r.effective_tokens) for r in made.collect()}
    counts = {"kgw-word-v1": 3000, "unigram-word-v1": 3002, "tournament-word-v1": 2998}
    assert {s: got[1, s][1] for s in detect.SCHEMES} == counts and {got[2, s] for s in detect.SCHEMES} == {("insufficient_evidence", 0)}
    assert got[1, "vendor-production"] == ("unsupported", None)


def test_words_stay_in_their_rows(spark):
    """Places of words need no shuffle, and merging shuffles arrays of words, not words."""
    docs = spark.createDataFrame([(1, " aa b\ncc  dd"), (2, ""), (3, None)], "doc_id long, text string")
    words = spans.word_spans(docs)
    assert shuffles(words) == 0
    assert [tuple(r) for r in words.collect()] == [(1, 0, "aa", 1, 3), (1, 1, "b", 4, 5), (1, 2, "cc", 6, 8), (1, 3, "dd", 10, 12)]
    given = spark.createDataFrame([(1, 2, 3), (1, 4, 4), (1, 5, 7), (1, 11, 12), (1, 9, 10), (2, 0, 1)], "doc_id long, start long, end long")
    lists = spans.merge(given, spans.word_places(docs))
    assert "Window" not in lists._jdf.queryExecution().executedPlan().toString()
    for merged in (lists, spans.merge(given, words)):
        assert sorted(map(tuple, merged.collect())) == [(1, 1, 3), (1, 6, 12)]


def test_repeated_contexts_are_masked_as_by_a_ring():
    """The sorted form against a ring of contexts; a long text takes no walk in Python."""
    rng = np.random.default_rng(3)
    keys, ngram = (11, 29), 3
    assert not {"deque", "Counter"} & set(vars(closed_vocabulary))
    for history in (0, 1, 4, 50):
        for ids in (rng.integers(1, 4, 200), rng.integers(0, 3, 40), np.ones(90, np.int64), np.arange(1, 3)):
            n = len(ids) - ngram + 1
            if n <= 0:
                assert closed_vocabulary.ngram_mean(ids, keys, ngram, history, 0) == (0, None)
                continue
            context = closed_vocabulary.fold(np.full(n, closed_vocabulary.start_value(keys), np.int64), [ids[j : j + n] for j in range(ngram - 1)]).tolist()
            ring, total = [0] * history, 0
            end = np.r_[np.flatnonzero(ids == 0), len(ids)][0]
            for i, c in enumerate(context):
                total += c not in ring and i + ngram - 1 < end
                ring = [*ring, c][1:]
            assert closed_vocabulary.ngram_mean(ids, keys, ngram, history, 0)[0] == total
