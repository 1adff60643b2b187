"""Secret scan: key patterns plus a randomness test battery with false-discovery control.

Base spans come from three patterns: ``assign`` (a key name, a separator, a value
of 6 or more characters), ``access`` (AKIA ids of 20 or more) and ``hex`` (runs of
24 or more). The battery then looks at every other run of 20 or more characters
of the base64 alphabets. For each run it infers the encoding (the smallest
alphabet that holds it) and computes

* a chi-squared test that the alphabet is used uniformly,
* a runs test about the middle of the alphabet,
* a lag-one serial-correlation test,

joined by Bonferroni into ``p_random``: small for text that no generator of
uniform symbols would produce. Runs that pass (``p_random >= 0.01``) get
``p_text``, a bound on the chance that ordinary text looks as random: the
likelihood of the run as text over that as uniform symbols of its encoding, times
the number of encodings it could have had (Markov's inequality on the likelihood
ratio). Text is a chain of character classes (words, Capitals and camelCase, or
all upper case; digits in groups) with letters by the mix below, vowels and
consonants in turn; of the two chains the likelier counts. Benjamini-Hochberg at ``rate`` within each
stratum of encoding and length over the whole corpus selects the ``random``
spans. Strata are few and p-values are binned, so only a small histogram reaches
the driver.

Defined results: null counts as empty, empty texts have no spans; positions are
code points with the end exclusive. Rows are independent except through the
corpus-wide threshold; repeated rows each count. Texts of any length are read whole,
in time in proportion to their length. Empty tables give no rows. Callers' columns
pass through, whatever their names; ``find_secrets`` names its own ``base_spans`` and
``spans``, so keys of those names are an error.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
#: Alphabets by name, smallest first.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64_url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "any": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
#: Relative frequency of letters in ordinary text, in per cent.
LETTERS = {
    "e": 12.7, "t": 9.1, "a": 8.2, "o": 7.5, "i": 7.0, "n": 6.7, "s": 6.3, "h": 6.1, "r": 6.0, "d": 4.3, "l": 4.0,
    "c": 2.8, "u": 2.8, "m": 2.4, "w": 2.4, "f": 2.2, "g": 2.0, "y": 2.0, "p": 1.9, "b": 1.5, "v": 1.0, "k": 0.8,
    "j": 0.15, "x": 0.15, "q": 0.1, "z": 0.07,
}
#: Classes of neighbouring characters in text, by mode: shares of lower, upper, digit and other after each of them
#: and, last, at the start of a run.
CHAINS = {
    "words": {
        "lower": (0.93, 0.02, 0.02, 0.03), "upper": (0.60, 0.30, 0.05, 0.05), "digit": (0.07, 0.05, 0.75, 0.13),
        "other": (0.50, 0.20, 0.25, 0.05), "": (0.60, 0.20, 0.15, 0.05),
    },
    "capitals": {
        "lower": (0.50, 0.42, 0.04, 0.04), "upper": (0.01, 0.92, 0.03, 0.04), "digit": (0.02, 0.10, 0.75, 0.13),
        "other": (0.05, 0.65, 0.25, 0.05), "": (0.05, 0.75, 0.15, 0.05),
    },
}
VOWELS = "aeiouy"
#: Chance of a vowel after a vowel and after a consonant, and share of letters that follow no rule (names, other languages).
AFTER_VOWEL, AFTER_CONSONANT, LOOSE = 0.22, 0.52, 0.2
LENGTHS = (24, 32, 48, 80)
BINS = 400


def letter_share(c: str, before: str) -> float:
    """Share of the letter ``c`` (lower case) in text after the letter ``before``, or at the start of a word."""
    kind = [x for x in LETTERS if (x in VOWELS) == (c in VOWELS)]
    share = LETTERS[c] / sum(LETTERS[x] for x in kind)
    vowel = AFTER_VOWEL if before in VOWELS else AFTER_CONSONANT
    ruled = share * (vowel if c in VOWELS else 1 - vowel) if before else LETTERS[c] / sum(LETTERS.values())
    return (1 - LOOSE) * ruled + LOOSE / 26


def text_logs() -> list[dict[tuple[str, str], float]]:
    """For each chain, the log likelihood in text of a character after another ('' at the start)."""
    classes = {c: "digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "other" for c in ALPHABETS["any"]}
    names, out = ("lower", "upper", "digit", "other"), []
    for chain in CHAINS.values():
        logs = {}
        for before, kind in [("", ""), *classes.items()]:
            for c, now in classes.items():
                share = chain[kind][names.index(now)]
                if now in ("lower", "upper"):
                    joined_on = before.isalpha() and not (kind == "lower" and now == "upper")
                    share *= letter_share(c.lower(), before.lower() if joined_on else "")
                else:
                    share *= 1 / 10 if now == "digit" else 1 / 4
                logs[before, c] = math.log(share)
        out.append(logs)
    return out


def tail(z: float) -> float:
    """Upper tail of the standard normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def collision_moments(n: int, second: float, third: float) -> tuple[float, float]:
    """Mean and deviation of the sum of squared counts of n multinomial draws."""
    mean = n + n * (n - 1) * second
    variance = 2 * n * (n - 1) * (second + 2 * (n - 2) * third - (2 * n - 3) * second**2)
    return mean, math.sqrt(max(variance, 1e-9))


class Battery:
    """The three tests for runs of one session's alphabets."""

    def __init__(self):
        self.rank = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
        self.logs = text_logs()
        self.sets = {name: frozenset(letters) for name, letters in ALPHABETS.items()}

    def encoding(self, run: str) -> str:
        used = set(run)
        return next((name for name, letters in self.sets.items() if used <= letters), "any")

    def test(self, run: str) -> tuple[str, float, float]:
        """Encoding, p_random and p_text."""
        run = run.rstrip("=")
        name = self.encoding(run)
        rank = self.rank[name]
        n, k = len(run), len(rank)
        symbols = [rank[c] for c in run]
        counts: dict[int, int] = {}
        for s in symbols:
            counts[s] = counts.get(s, 0) + 1
        squares = sum(c * c for c in counts.values())
        mean, deviation = collision_moments(n, 1 / k, 1 / k**2)
        p_uniform = min(1.0, 2 * tail(abs(squares - mean) / deviation))
        high = [s >= k // 2 for s in symbols]
        share = (k - k // 2) / k
        turns = sum(a != b for a, b in zip(high, high[1:]))
        chance = 2 * share * (1 - share)
        p_runs = min(1.0, 2 * tail(abs(turns - chance * (n - 1)) / math.sqrt((n - 1) * chance * (1 - chance))))
        centre = sum(symbols) / n
        spread = sum((s - centre) ** 2 for s in symbols)
        lag = sum((a - centre) * (b - centre) for a, b in zip(symbols, symbols[1:])) / spread if spread else 1.0
        p_serial = min(1.0, 2 * tail(abs(lag) * math.sqrt(n)))
        pairs = list(zip(["", *run], run))
        as_text = max(sum(logs[pair] for pair in pairs) for logs in self.logs)
        p_text = min(1.0, len(ALPHABETS) * math.exp(min(0.0, as_text + n * math.log(k))))
        return name, min(1.0, 3 * min(p_uniform, p_runs, p_serial)), p_text


def stratum(name: str, length: int) -> str:
    return f"{name}:{sum(length >= x for x in LENGTHS)}"


def log_bin(p: float) -> int:
    """p-values by tenths of a decimal order; larger bins hold smaller values."""
    return min(BINS - 1, int(-10 * math.log10(max(p, 1e-39))))


class Scanner:
    def __init__(self):
        self.assign = re.compile(ASSIGN, re.I | re.A)
        self.access, self.hex, self.run = re.compile(ACCESS), re.compile(HEX[:-1] + "{24,}"), re.compile(RUN)
        self.battery = Battery()

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the base spans in order."""
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(found)

    def candidates(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int]]:
        """Runs outside base spans that pass as random: start, end, stratum, bin; others have bin -1."""
        out = []
        i, reach = 0, -1  # base spans that start before the run's end, and the last end among them
        for m in self.run.finditer(text):
            start, end = m.span()
            while i < len(base) and base[i][0] < end:
                reach = max(reach, base[i][2])
                i += 1
            if reach > start:
                continue
            name, p_random, p_text = self.battery.test(m.group())
            out.append((start, end, stratum(name, end - start), log_bin(p_text) if p_random >= 0.01 else -1))
        return out


SPANS = "array<struct<kind:string,start:int,end:int>>"
RUNS = "array<struct<start:int,end:int,stratum:string,bin:int>>"


def scan(column: str, keep: bool):
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    runs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.string()), ("bin", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            base, random = [], []
            for text in batch.column(column).to_pylist():
                found = scanner.base(text or "")
                base.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
                random.append(
                    [{"start": a, "end": b, "stratum": s, "bin": i} for a, b, s, i in scanner.candidates(text or "", found)]
                )
            rest = [i for i, name in enumerate(batch.schema.names) if keep or name != column]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in rest), pa.array(base, span), pa.array(random, runs)],
                names=[*(batch.schema.names[i] for i in rest), "base_spans", "random_runs"],
            )

    return run


def thresholds(scanned: DataFrame, rate: float) -> dict[str, int]:
    """The least bin selected in each stratum by Benjamini-Hochberg at ``rate``.

    A stratum's tests are all its runs; the histogram has at most strata x BINS rows.
    """
    counts = scanned.select(F.explode("random_runs").alias("r")).groupBy("r.stratum", "r.bin").count().collect()
    by: dict[str, dict[int, int]] = {}
    for r in counts:
        by.setdefault(r["stratum"], {})[r["bin"]] = r["count"]
    out = {}
    for name, bins in by.items():
        tests, taken = sum(bins.values()), 0
        for i in sorted((i for i in bins if i >= 0), reverse=True):
            taken += bins[i]
            if 10 ** (-i / 10) * tests <= rate * taken:
                out[name] = i
    return out


def find_secrets(df: DataFrame, keys: list[str], column: str = "text", rate: float = 0.01) -> DataFrame:
    """``keys`` of each row with ``spans``: base and random spans by start, then kind as listed.

    One pass over the texts; what it finds is kept in the shared folder, so the
    corpus-wide thresholds need no second pass.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    texts = df.select(*dict.fromkeys([*keys, column]))
    scanned = store.shelve(
        texts.mapInArrow(scan(column, column in keys), f"{schema}, base_spans {SPANS}, random_runs {RUNS}"), "secrets"
    )
    least = thresholds(scanned, rate)
    picked = F.filter("random_runs", lambda r: F.lit(False))
    if least:
        limit = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
        picked = F.filter("random_runs", lambda r: r["bin"] >= F.coalesce(F.try_element_at(limit, r["stratum"]), F.lit(BINS)))
    random = F.transform(picked, lambda r: F.struct(F.lit("random").alias("kind"), r["start"].alias("start"), r["end"].alias("end")))
    order = F.array_sort(
        F.transform(
            F.concat("base_spans", random),
            lambda s: F.struct(
                s["start"].alias("start"),
                F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"),
                s["end"].alias("end"),
                s["kind"].alias("kind"),
            ),
        )
    )
    return scanned.select(*keys, "base_spans", order.alias("spans"))


def joined(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def digest(documents: DataFrame) -> DataFrame:
    """The query's contract: counts, the hash of the base spans and all spans as text."""
    found = find_secrets(documents, ["doc_id"])
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def redactor(column: str, length_column: str | None, spans_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(column).to_pylist()
            listed = batch.column(spans_column).to_pylist()
            for i, spans in enumerate(listed):
                if spans and texts[i] is not None:
                    parts, at = [], 0
                    for s in spans:
                        if s["end"] > at:
                            parts += [texts[i][at : max(at, s["start"])], "[secret]" if s["start"] >= at else ""]
                            at = s["end"]
                    texts[i] = "".join(parts) + texts[i][at:]
            out = {name: batch.column(i) for i, name in enumerate(names) if name != spans_column}
            out[column] = pa.array(texts, out[column].type)
            if length_column in out:
                old = out[length_column].to_pylist()
                out[length_column] = pa.array(
                    [len(t) if s and t is not None else o for t, s, o in zip(texts, listed, old, strict=True)],
                    out[length_column].type,
                )
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def redact(documents: DataFrame, column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """Documents with every found secret replaced by ``[secret]``; the length column follows the text.

    All rows stay, with their columns; overlapping spans become one mark.
    """
    columns = documents.columns
    # The search names columns of its own, so the caller's go through under others.
    inner = [f"c{i}_" for i in range(len(columns))]
    found = find_secrets(documents.toDF(*inner), inner, inner[columns.index(column)])
    spans = store.fresh(columns, "spans")
    named = found.select(*inner, "spans").toDF(*columns, spans)
    return named.mapInArrow(redactor(column, length_column, spans), documents.schema)


#: How many base spans of each kind there are, in DuckDB SQL.
ORACLE_BASE = r"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
