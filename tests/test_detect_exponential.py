"""The exponential statistic and its tail, and skeletons over a large given table."""

import math
import random

from pyspark.sql import functions as F

from inkstrata.functions import unicode_data as U
from inkstrata.operators import detect, sanitize


def test_gamma_tail_against_the_poisson_sum():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randint(1, 400)
        t = n * rng.choice([0.3, 0.8, 0.97, 1.0, 1.02, 1.3, 2.5]) + rng.random()
        want = math.fsum(math.exp(k * math.log(t) - t - math.lgamma(k + 1)) for k in range(n))
        assert math.isclose(detect.gamma_tail(n, t), min(1.0, want), rel_tol=1e-9, abs_tol=1e-12)
    assert detect.gamma_tail(0, 3) == detect.gamma_tail(5, 0) == 1.0
    assert 0.49 < detect.gamma_tail(1_000_000, 1_000_000) < 0.51
    assert detect.gamma_tail(1000, 3000) < 1e-100


def test_marked_texts_are_told_from_plain_ones(spark):
    """Words chosen by the largest draw are detected; random words, short and empty texts are not."""
    rng, words = random.Random(1), [f"w{i}" for i in range(40)]

    def draw(a, b):
        import hashlib

        mark = "\x1f".join((detect.KEY, detect.EXPONENTIAL, a, b))
        return (int(hashlib.sha256(mark.encode()).hexdigest()[:16], 16) + 0.5) / 2**64

    marked, last = ["w0"], "w0"
    for _ in range(120):
        last = max(rng.sample(words, 12), key=lambda w: draw(last, w))
        marked.append(last)
    plain = [rng.choice(words) for _ in range(120)]
    rows = [(1, " ".join(marked)), (2, " ".join(plain)), (3, "w1 w2 w3"), (4, ""), (5, None), (6, "one")]
    out = {r.doc_id: r for r in detect.exponential(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert (out[1].status, out[2].status, out[3].status, out[4].status, out[5].status) == ("detected", "not_detected", *["insufficient_evidence"] * 3)
    costs = [-math.log(max(1e-12, 1 - draw(a, b))) for a, b in zip(plain, plain[1:], strict=False)]
    assert math.isclose(out[2].score, (sum(costs) / len(costs) - 1) * math.sqrt(len(costs)), rel_tol=1e-9)
    assert (out[4].score, out[4].p_value, out[6].effective_tokens) == (0.0, 1.0, 0)


def test_tokens_of_texts_that_fold_unlike_their_lower_case(spark):
    texts = ["Straße ΣΑΣ", "İx Iı", "ŉa ſo", "Plain TEXT's", "ǅ Ǆ", "ΑΣ", "É’É"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", detect.tokens(F.col("t")).alias("w")).collect()
    import regex

    pattern = regex.compile(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*|[^\p{L}\p{N}_\s]")
    for t, w in rows:
        assert w == [m.casefold() for m in pattern.findall(t)]


def test_skeleton_over_a_large_table(spark, tmp_path):
    """A table of the published format with hundreds of longer values, against a plain loop."""
    rng = random.Random(6)
    letters = rng.sample([chr(c) for c in range(0x13A0, 0x13F5)] + [chr(c) for c in range(0x1400, 0x1676)] + [chr(c) for c in range(0xA4D0, 0xA4F8)], 700)
    table = {c: "".join(rng.choice("abcXYZ'") for _ in range(rng.choice([1, 2, 3]))) for c in letters}
    lines = [f"{ord(k):04X} ;\t{' '.join(f'{ord(x):04X}' for x in v)} ;\tMA\t# x" for k, v in table.items()]
    (tmp_path / "given.txt").write_text("\n".join(lines), encoding="utf-8")
    try:
        assert U.use_confusables(str(tmp_path / "given.txt")) == len(table)
        texts = ["".join(rng.choice([*letters[:90], "a", "b", " ", "é"]) for _ in range(rng.randint(0, 200))) for _ in range(50)]
        texts += ["".join(letters) * 20, "", "plain"]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        for t, got in df.select("t", sanitize.replace_letters(F.col("t"))).collect():
            assert got == "".join(table.get(c, c) for c in t)
        changes = df.select("t", sanitize.replace_letters(F.col("t")).alias("r")).withColumn("e", sanitize.letter_changes()("t", "r"))
        for t, r, edits in changes.collect():
            back = r
            for e in reversed(edits or []):
                at = e.output_position
                assert back[at : at + len(e.replacement)] == e.replacement
                back = back[:at] + e.original + back[at + len(e.replacement) :]
            assert back == t
    finally:
        U.use_confusables(None)


def test_changes_that_do_not_fit_the_table_are_one_edit(spark):
    df = spark.createDataFrame([("aΩb", "axyb"), ("æ", "e"), ("æ", "aez")], "a string, b string")
    for a, b, edits in df.withColumn("e", sanitize.letter_changes()("a", "b")).collect():
        assert [(e.position, e.original, e.replacement) for e in edits] == [(0, a, b)]
