"""Covert-channel embedders and decoders as column expressions, for planting test signals.

Every function takes and returns columns; nothing leaves the JVM. Payloads are
UTF-8 strings; null texts and payloads give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.unicode_data import TWINS

FAMILIES = ("zero_width", "variation_selector", "tags_block", "homoglyph", "exotic_space")
ZERO, ONE = "​", "‌"
NARROW = " "


def bits(payload: Column) -> Column:
    """Bits of the payload's bytes, most significant first, as a string of 0 and 1."""
    digits = F.filter(F.split(F.hex(payload.cast("binary")), ""), lambda h: h != "")
    return F.array_join(F.transform(digits, lambda h: F.lpad(F.conv(h, 16, 2), 4, "0")), "")


def byte_values(payload: Column) -> Column:
    digits = F.hex(payload.cast("binary"))
    pairs = F.regexp_extract_all(digits, F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))


def from_code_points(points: Column) -> Column:
    """A string of the code points in an integer array."""
    return F.decode(F.unhex(F.array_join(F.transform(points, lambda p: F.lpad(F.hex(p), 8, "0")), "")), "UTF-32")


def distribute(cover: Column, hidden: Column) -> Column:
    """Hidden characters after every step-th cover character; what is left over follows the text."""

    def spread(parts: Column, signs: Column, hidden: Column, m: Column, placed: Column) -> Column:
        marked = F.zip_with(F.slice(parts, 1, placed), F.slice(signs, 1, placed), lambda part, sign: F.concat(part, sign))
        return F.concat(F.array_join(marked, ""), F.array_join(F.slice(parts, placed + 1, F.size(parts)), ""), F.substring(hidden, placed + 1, m))

    def sized(cover: Column, hidden: Column, n: Column, m: Column) -> Column:
        step = F.greatest(F.lit(1), F.floor(n / (m + 1)).cast("int"))
        # The cover is cut once: places in it would each be counted from its start. Possessive, so that no step goes deep.
        parts = F.regexp_extract_all(cover, F.concat(F.lit("(?s).{1,"), step.cast("string"), F.lit("}+")), F.lit(0))
        return let(spread, parts, F.split(hidden, ""), hidden, m, F.least(m, F.floor(n / step).cast("int")))

    measured = lambda cover, hidden: let(sized, cover, hidden, F.length(cover), F.length(hidden))
    return let(measured, cover, hidden)


def embed_zero_width(cover: Column, payload: Column) -> Column:
    return distribute(cover, F.translate(bits(payload), "01", ZERO + ONE))


def embed_variation_selector(cover: Column, payload: Column) -> Column:
    points = F.transform(byte_values(payload), lambda b: F.when(b < 16, b + 0xFE00).otherwise(b - 16 + 0xE0100))
    return distribute(cover, from_code_points(points))


def embed_tags_block(cover: Column, payload: Column) -> Column:
    """Null for a payload that is not ASCII: the family cannot carry it."""
    points = F.transform(byte_values(payload), lambda b: b + 0xE0000)
    return F.when(payload.rlike(r"^[\x00-\x7F]*$"), distribute(cover, from_code_points(points)))


def _toggle(cover: Column, payload: Column, pattern: str, change) -> Column:
    """Apply ``change`` to the matches of a one-character pattern whose bit, taken cyclically, is 1."""

    def toggled(found: Column, between: Column, taken: Column) -> Column:
        bit = lambda i: F.substring(taken, F.pmod(i, F.length(taken)) + 1, F.lit(1))
        rest = F.transform(
            found, lambda c, i: F.concat(F.when(bit(i) == "1", change(c)).otherwise(c), F.get(between, i + 1))
        )
        return F.concat(F.get(between, F.lit(0)), F.array_join(rest, ""))

    return let(toggled, F.regexp_extract_all(cover, F.lit(pattern), F.lit(0)), F.split(cover, pattern, -1), bits(payload))


def embed_homoglyph(cover: Column, payload: Column) -> Column:
    letters = "".join(TWINS)
    return _toggle(cover, payload, f"[{letters}]", lambda c: F.translate(c, letters, "".join(TWINS.values())))


def embed_exotic_space(cover: Column, payload: Column) -> Column:
    return _toggle(cover, payload, " ", lambda c: F.lit(NARROW))


EMBEDDERS = {
    "zero_width": embed_zero_width,
    "variation_selector": embed_variation_selector,
    "tags_block": embed_tags_block,
    "homoglyph": embed_homoglyph,
    "exotic_space": embed_exotic_space,
}


def decode_zero_width(text: Column) -> Column:
    """Payload bytes, as text, of the zero-width characters; a last incomplete byte is dropped."""
    found = F.translate(F.array_join(F.regexp_extract_all(text, F.lit(f"[{ZERO}{ONE}]"), F.lit(0)), ""), ZERO + ONE, "01")
    groups = F.regexp_extract_all(found, F.lit("[01]{8}"), F.lit(0))
    return F.decode(F.unhex(F.array_join(F.transform(groups, lambda b: F.lpad(F.conv(b, 2, 16), 2, "0")), "")), "UTF-8")


def decode_variation_selector(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"), F.lit(0))
    value = F.transform(found, lambda c: F.when(F.ascii(c) < 0xFE10, F.ascii(c) - 0xFE00).otherwise(F.ascii(c) - 0xE0100 + 16))
    return F.decode(F.unhex(F.array_join(F.transform(value, lambda b: F.lpad(F.hex(b), 2, "0")), "")), "UTF-8")


def decode_tags_block(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"[\x{E0000}-\x{E007F}]"), F.lit(0))
    return from_code_points(F.transform(found, lambda c: F.ascii(c) - 0xE0000))


DECODERS = {
    "zero_width": decode_zero_width,
    "variation_selector": decode_variation_selector,
    "tags_block": decode_tags_block,
}


def strip_covert(text: Column) -> Column:
    """Plain removal of all five channels, the yardstick of the suite."""
    bare = F.regexp_replace(text, r"[\x{200B}-\x{200D}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{E0000}-\x{E007F}]", "")
    return F.translate(bare, NARROW + "".join(TWINS.values()), " " + "".join(TWINS))


def plant(documents: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """One row for each document and family: doc_id, family, payload, cover and marked text."""
    payload = lambda family: F.concat(F.lit(f"zd-{family}-"), F.col("doc_id").cast("string"))
    rows = [
        F.struct(
            F.lit(f).alias("family"), payload(f).alias("payload"), EMBEDDERS[f](F.col("text"), payload(f)).alias("marked")
        )
        for f in families
    ]
    return documents.select("doc_id", F.col("text").alias("cover"), F.explode(F.array(*rows)).alias("p")).select(
        "doc_id", "cover", "p.*"
    )
