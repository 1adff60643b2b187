"""Canonical JSON in the JVM against the strict reader."""

import json
import random

from pyspark.sql import functions as F

from inkstrata.operators import records

CASES = [
    '{"b":1,"a":[1,2,{"z":null,"y":true}]}', "1 2", '{"a":1} x', '{"a":1,"a":2}', "NaN", "[NaN]", "[Infinity]", "[1,]", "01", '"x\\n\\t\\"\\\\/"',
    '{"é":"中","E":"\\/"}', " [ ] ", "{}", '[{"a":{"a":1,"a":2}}]', "", " ", "-0", "12345678901234567890123", "tru", "[[[[1]]]]", "{'a':1}", "{a:1}",
    "/*c*/1", '"open', "[1]]", "1}", "1],[2", '1},{"k":2', '1,"k":2', '1,"j":2', "1,2", "1.50", "1e5", "1E400", '"\\ud83d\\ude00"', '"\\u0007"', '{"\U0001f600":1,"￿":2}',
    "null", None, '"a.e1.5"',
]


def test_canonical_form_equals_the_strict_reader(spark):
    rng = random.Random(12)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind == 0:
            return rng.choice([None, True, False])
        if kind == 1:
            return rng.randrange(-(10**17), 10**17)
        if kind in (2, 3):
            return "".join(rng.choice('ab"\\/é中\n\t .') for _ in range(rng.randint(0, 6)))
        if kind == 4:
            return rng.random() * 10 ** rng.randint(-9, 20)
        return [value(depth - 1) for _ in range(3)] if kind == 5 else {value(0).__repr__(): value(depth - 1) for _ in range(3)}

    texts = CASES + [json.dumps(value(4), ensure_ascii=rng.random() < 0.3, indent=rng.choice([None, 1])) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, a, b in df.select("t", records.canonical(F.col("t")), records.canonical_json(F.col("t"))).collect():
        assert a == b, t
