"""Steps whose cost must go with the text: flagged characters are judged as arrays, texts are edited once, covers are cut once."""

import re
import unicodedata

from pyspark.sql import functions as F

from inkstrata.operators import covert, inspect, sanitize, scan
from inkstrata.plans import queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_suppressed_files_are_not_looked_into(spark):
    """keys are plain filters, that of the path below the search, and no pattern is tried on each finding's context."""
    texts = [("docs/1.txt", "a​b"), ("docs/2_x.txt", "a​b‮"), ("docs/2%x.txt", "​"), ("docs/2yx.txt", "​"), ("e", "\U000e0041")]
    found = scan.scan(spark.createDataFrame(texts, "path string, text string"))
    made = plan(scan.suppress(found, ["docs/1*"]))
    assert "exists(" not in made and "regexp_replace" not in made and made.count("RLIKE") <= 2
    assert made.index("Generate explode") < made.index("StartsWith(path")
    left = lambda *patterns: sorted((r.path, r.category) for r in scan.suppress(found, list(patterns)).collect())
    all_ = left()
    assert len(all_) == 6
    assert left("docs/1*") == [r for r in all_ if r[0] != "docs/1.txt"]
    assert left("docs/2_x.txt", "docs/2%*") == [r for r in all_ if r[0] not in ("docs/2_x.txt", "docs/2%x.txt")]
    assert left("docs/2?x.txt:U+202E") == left("docs/2[_]x.txt:bidi*") == [r for r in all_ if r[1] != "bidi_control"]
    assert left("tags_block", "docs/*:1") == []
    assert left(found.where("category = 'tags_block'").first().fingerprint) == [r for r in all_ if r[1] != "tags_block"]
    assert left(*[f"docs/{i}*" for i in range(30)]) == [("e", "tags_block")]


def test_covers_are_cut_once(spark):
    """Hidden characters go between stretches of one cut of the cover, whatever lies beyond the first plane."""
    df = spark.createDataFrame([(1, "ab\U0001f600" * 5000), (2, ""), (3, None), (4, "abc"), (5, "a\n\r b" * 200)], "i int, t string")
    hidden = F.lit("​‌\U000e0041")
    made = df.select("i", "t", covert.distribute(F.col("t"), hidden).alias("m"))
    assert len(re.findall(r"substring\(", plan(made))) <= 1
    for r in made.collect():
        if r.t is None:
            assert r.m is None
            continue
        h, step = "​‌\U000e0041", max(1, len(r.t) // 4)
        n = min(3, len(r.t) // step)
        assert r.m == "".join(r.t[j * step : j * step + step] + h[j] for j in range(n)) + r.t[n * step :] + h[n:]


def test_verdicts_by_what_stands_by(spark):
    """Contexts of hits in one slice do not reach over to the next text, and words are those around each letter."""
    texts = [
        ("א", []), ("‮" + "x" * 64 + "א", ["actionable"]), ("‮" + "x" * 63 + "א", ["contextual"]), ("‮", ["actionable"]),
        ("م‌م a‌b", ["informational", "actionable"]), ("م‌", ["actionable"]), ("م", []), ("1️⃣ 1️", ["informational", "actionable"]),
        ("\U0001f3f4\U000e0067\U000e007f \U000e0067", ["informational", "informational", "actionable"]), ("﻿a﻿", ["informational", "actionable"]),
        ("pаy ар аα", ["actionable", "informational", "informational", "contextual", "contextual"]), ("ᅠ한 ᅠ", ["informational", "contextual"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").coalesce(1)
    found = inspect.occurrences(df)
    assert "RLIKE" not in plan(found).replace("RLIKE(text", "")
    got = {}
    for r in found.orderBy("doc_id", "position").collect():
        got.setdefault(r.doc_id, []).append(r.disposition)
    assert [got.get(i, []) for i in range(len(texts))] == [want for _, want in texts]


def test_texts_are_edited_once(spark):
    """one pass finds, judges and edits; nothing of it is planned again for each column that reads it."""
    texts = [(1, "é a​ م‌م­"), (2, "plain"), (3, None), (4, "­"), (5, "\U0001f600​　b​é")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    for made, python in ((sanitize.sanitize(df), 2), (sanitize.sanitize_with_edits(df), 2)):
        text = plan(made)
        assert text.count("ArrowEvalPython") == python and text.count("cleaned(CASE") == 1 and "zip_with" not in text and text.count("RLIKE") <= 4
    got = {r.doc_id: (r.cleaned, r.n_edits) for r in sanitize.sanitize(df).collect()}
    assert got == {1: ("é a م‌م­", 2), 2: ("plain", 0), 3: (None, 0), 4: ("­", 0), 5: ("\U0001f600 bé", 3)}
    rows = {r.doc_id: r for r in sanitize.sanitize_with_edits(df).collect()}
    assert [(e.stage, e.position, e.output_position, e.original, e.replacement) for e in rows[5].edits] == [
        ("policy", 1, 1, "​", ""), ("policy", 2, 1, "　", " "), ("policy", 4, 3, "​", ""), ("NFC", 3, 3, "é", "é"),
    ]
    assert rows[1].counts == {"zero_width": 1, "exotic_space": 1} and rows[4].edits == [] and rows[3].cleaned is None
    back = {r.doc_id: r.restored for r in sanitize.reverse_edits(sanitize.sanitize_with_edits(df)).collect()}
    assert {i: back[i] for i in (1, 2, 4, 5)} == {i: t for i, t in texts if i != 3}


def test_one_row_group_is_dealt_out(spark, tmp_path):
    """a large file of one row group has many splits, all but one of them empty; its texts still go to all cores."""
    texts = [(i, f"{i} " + "é" * (i % 50)) for i in range(2000)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        raw = spark.read.parquet(str(tmp_path / "documents.parquet"))
        held = lambda df: df.select(F.spark_partition_id()).distinct().count()
        assert raw.rdd.getNumPartitions() >= 4 and held(raw) == 1
        out = queries.QUERIES["sanitize_safe"](spark, str(tmp_path))
        assert held(out) >= 4
        assert sorted(map(tuple, out.collect())) == texts
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_only_texts_with_marks_are_normalised(spark):
    """hidden characters are made once a row, and edited texts are not searched again for what NFC could change."""
    texts = ["é​à", "e​́", "é", "é", None, "", "​", "ᄒ​ᅡ", "Ω", "a" * 3000 + "​", "q​̣̇"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    made = plan(sanitize.sanitize(df))
    assert r"[^\x00-\x7F]" not in made and "nfc(CASE WHEN coalesce(marks_" in made
    got = {r.doc_id: r.cleaned for r in sanitize.sanitize(df).collect()}
    assert got == {i: t if t is None else unicodedata.normalize("NFC", t.replace("​", "")) for i, t in enumerate(texts)}
    marked = df.select("doc_id", covert.embed_zero_width(F.col("text"), F.lit("zd")).alias("text"))
    assert plan(marked.select("text")).count("translate(") <= 1
    assert {r.doc_id: r.cleaned for r in sanitize.sanitize(marked).collect()} == got
