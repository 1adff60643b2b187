"""Character classes and policy tables, made from Python's Unicode data.

All classes are explicit code-point ranges, so results do not depend on the
Unicode version of the JVM.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

# Policy ranges as (first, last, category, action, token, safe rule).
POLICY = (
    (0x00A0, 0x00A0, "exotic_space", "space", "NBSP", "space"),
    (0x00AD, 0x00AD, "soft_hyphen", "delete", "SHY", "preserve"),
    (0x034F, 0x034F, "other_invisible", "delete", "CGJ", "preserve"),
    (0x061C, 0x061C, "bidi_control", "delete", "ALM", "bidi_context"),
    (0x115F, 0x1160, "other_invisible", "delete", "HANGUL_FILLER", "script_context"),
    (0x1680, 0x1680, "exotic_space", "space", "OGHAM", "space"),
    (0x17B4, 0x17B5, "other_invisible", "delete", "KHMER_INHERENT", "script_context"),
    (0x180E, 0x180E, "other_invisible", "delete", "MVS", "preserve"),
    (0x2000, 0x200A, "exotic_space", "space", "SPACE", "space"),
    (0x200B, 0x200B, "zero_width", "delete", "ZWSP", "delete"),
    (0x200C, 0x200C, "zero_width", "delete", "ZWNJ", "join_context"),
    (0x200D, 0x200D, "zero_width", "delete", "ZWJ", "join_context"),
    (0x200E, 0x200F, "bidi_control", "delete", "BIDI_MARK", "bidi_context"),
    (0x2028, 0x2029, "exotic_space", "space", "LINE_SEPARATOR", "preserve"),
    (0x202A, 0x202E, "bidi_control", "delete", "BIDI_EMBED", "bidi_context"),
    (0x202F, 0x202F, "exotic_space", "space", "NNBSP", "space"),
    (0x205F, 0x205F, "exotic_space", "space", "MMSP", "space"),
    (0x2060, 0x2060, "zero_width", "delete", "WJ", "preserve"),
    (0x2061, 0x2064, "other_invisible", "delete", "INVISIBLE_OPERATOR", "preserve"),
    (0x2066, 0x2069, "bidi_control", "delete", "BIDI_ISOLATE", "bidi_context"),
    (0x206A, 0x206F, "bidi_control", "delete", "BIDI_DEPRECATED", "bidi_context"),
    (0x3000, 0x3000, "exotic_space", "space", "IDSP", "space"),
    (0xFE00, 0xFE0F, "variation_selector", "delete", "VS", "variation_context"),
    (0xFEFF, 0xFEFF, "zero_width", "delete", "BOM", "leading_bom"),
    (0xFFF9, 0xFFFB, "other_invisible", "delete", "INTERLINEAR", "preserve"),
    (0xE0000, 0xE007F, "tags_block", "delete", "TAG", "emoji_tag_context"),
    (0xE0100, 0xE01EF, "variation_selector", "delete", "VS", "variation_context"),
)
# Risk of each category.
RISK = {
    "bidi_control": "high",
    "exotic_space": "low",
    "homoglyph": "medium",
    "other_invisible": "medium",
    "soft_hyphen": "low",
    "tags_block": "high",
    "variation_selector": "medium",
    "zero_width": "high",
}
# Scripts by the beginning of a letter's Unicode name.
SCRIPT_NAMES = {
    "ARABIC": "Arabic", "ARMENIAN": "Armenian", "BENGALI": "Bengali", "CJK": "Han", "CYRILLIC": "Cyrillic",
    "DEVANAGARI": "Devanagari", "GEORGIAN": "Georgian", "GREEK": "Greek", "GUJARATI": "Gujarati",
    "GURMUKHI": "Gurmukhi", "HANGUL": "Hangul", "HEBREW": "Hebrew", "HIRAGANA": "Hiragana", "IDEOGRAPH": "Han",
    "KANNADA": "Kannada", "KATAKANA": "Katakana", "KHMER": "Khmer", "LAO": "Lao", "LATIN": "Latin",
    "MALAYALAM": "Malayalam", "MYANMAR": "Myanmar", "ORIYA": "Oriya", "SINHALA": "Sinhala", "SYRIAC": "Syriac",
    "TAMIL": "Tamil", "TELUGU": "Telugu", "THAANA": "Thaana", "THAI": "Thai", "TIBETAN": "Tibetan",
}
# The Latin letters that the homoglyph channel toggles, and their Cyrillic twins.
TWINS = {
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "K": "К", "M": "М", "O": "О", "P": "Р", "T": "Т",
    "a": "а", "c": "с", "e": "е", "i": "і", "o": "о", "p": "р", "x": "х", "y": "у",
}
# Further letters that look like ASCII ones.
LOOKALIKES = {
    "Ѕ": "S", "І": "I", "Ј": "J", "Х": "X", "У": "Y", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "α": "a", "γ": "y", "ι": "i", "σ": "o", "υ": "u",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L",
    "ı": "i", "ɑ": "a", "ɡ": "g", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "p", "ƒ": "f",
}
# Signs and digits that look like ASCII ones.
SIGNS = {
    "×": "x", "‘": "'", "’": "'", "‛": "'", "′": "'", "´": "'", "ˈ": "'", "՚": "'", "“": "''", "”": "''", "″": "''", "‟": "''",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "˗": "-", "۔": "-", "⁄": "/", "∕": "/", "⧸": "/", "∗": "*", "٭": "*", "∶": ":",
    "ː": ":", "։": ":", "׃": ":", "‚": ",", "٫": ",", "․": ".", "܁": ".", "܂": ".", "∼": "~", "‹": "<", "˂": "<", "›": ">", "˃": ">",
    "ǃ": "!", "∣": "l", "∖": "\\", "❨": "(", "❩": ")", "❴": "{", "❵": "}", "٠": ".", "١": "l", "٥": "o", "٧": "V", "۰": ".",
    "۱": "l", "۵": "o", "۷": "V", "߀": "O", "०": "o", "০": "o", "੦": "o", "૦": "o", "๐": "o", "໐": "o", "၀": "o", "៰": "o",
}
EMOJI = ((0x1F000, 0x1FAFF), (0x2600, 0x27FF), (0x2300, 0x23FF)) + tuple(
    (c, c) for c in (0x00A9, 0x00AE, 0x203C, 0x2049, 0x2122, 0x2139, 0x3030, 0x303D)
)
#: White space as Python's str.split and \s see it.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def char_class(ranges) -> str:
    """Ranges as the inside of a regex class (Java and RE2)."""
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


@cache
def _facts() -> list[tuple[int, str]]:
    """Code point and general category of all assigned characters, surrogates left out."""
    out = []
    for cp in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(cp))
        if category not in ("Cn", "Cs"):
            out.append((cp, category))
    return out


def ranges_of(test: Callable[[int, str], bool]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for cp, category in _facts():
        if test(cp, category):
            if out and out[-1][1] == cp - 1:
                out[-1][1] = cp
            else:
                out.append([cp, cp])
    return [(a, b) for a, b in out]


@cache
def marks() -> str:
    return char_class(ranges_of(lambda cp, category: category[0] == "M"))


@cache
def rtl() -> str:
    return char_class(ranges_of(lambda cp, category: unicodedata.bidirectional(chr(cp)) in ("R", "AL", "AN")))


@cache
def word_parts() -> str:
    """Characters of a token: underscore, letters, digits, marks."""
    return char_class(ranges_of(lambda cp, category: category[0] == "M" or cp == 95 or chr(cp).isalnum()))


@cache
def script_ranges() -> dict[str, list[tuple[int, int]]]:
    """Ranges of each script, by the names of its letters and marks."""
    found: dict[str, list[tuple[int, int]]] = {}
    for cp, category in _facts():
        if category[0] in "LM":
            name = unicodedata.name(chr(cp), "")
            script = next((s for prefix, s in SCRIPT_NAMES.items() if name.startswith(prefix)), None)
            if script:
                runs = found.setdefault(script, [])
                if runs and runs[-1][1] == cp - 1:
                    runs[-1] = (runs[-1][0], cp)
                else:
                    runs.append((cp, cp))
    return found


@cache
def scripts() -> dict[str, str]:
    """Regex class inside of each script."""
    return {script: char_class(runs) for script, runs in sorted(script_ranges().items())}


_given: dict[str, str] = {}


def use_confusables(path: str | None) -> int:
    """Take the look-alikes from a file in the public ``confusables.txt`` format; None goes back to the lists here.

    Kept are characters that look like ASCII text and do not decompose to ASCII,
    as normalising deals with those that do. Returns how many there are.
    """
    _given.clear()
    if path is not None:
        with open(path, encoding="utf-8-sig") as lines:
            for line in lines:
                parts = [p.strip() for p in line.split("#")[0].split(";")]
                if len(parts) < 2 or " " in parts[0]:
                    continue
                source, target = chr(int(parts[0], 16)), "".join(chr(int(x, 16)) for x in parts[1].split())
                if target.isascii() and not unicodedata.normalize("NFKC", source).isascii():
                    _given[source] = target
    for made in (confusables, confusable_class, flagged_class, flagged_table):
        made.cache_clear()
    return len(confusables())


@cache
def confusables() -> dict[str, str]:
    """Characters and the ASCII text that they look like: twins, listed letters and signs, or those of a file."""
    return dict(_given) or {twin: letter for letter, twin in TWINS.items()} | LOOKALIKES | SIGNS


def name_of(ch: str) -> str:
    return unicodedata.name(ch, f"<unassigned U+{ord(ch):04X}>")


@cache
def flagged_class(letters: bool = True) -> str:
    """All characters that inspection looks at, or those of the policy alone; ASCII is ruled out first, as most text is."""
    held = char_class((a, b) for a, b, *_ in POLICY) + (confusable_class() if letters else "")
    return r"\x{80}-\x{10FFFF}&&[" + held + "]"


@cache
def confusable_class() -> str:
    """Letters among the look-alikes, which inspection reports."""
    known = confusables()
    return char_class(ranges_of(lambda cp, category: category[0] == "L" and chr(cp) in known))


@cache
def known_letters() -> str:
    """Letters and marks of all named scripts."""
    return "".join(scripts().values())


@cache
def one_script() -> str:
    """Pattern of a run of letters of one script."""
    return "^(?:" + "|".join(f"[{inside}]+" for inside in scripts().values()) + ")$"


@cache
def pair_of_script() -> str:
    """Pattern of two letters of the same script other than Latin."""
    return "^(?:" + "|".join(f"[{inside}]{{2}}" for script, inside in scripts().items() if script != "Latin") + ")$"


@cache
def flagged_table() -> list[tuple[str, str, str, str, str, str]]:
    """Flagged characters: character, category, action, safe rule, marker, name."""
    rows = []
    for first, last, category, action, token, rule in POLICY:
        for cp in range(first, last + 1):
            if category == "variation_selector":
                token = f"VS{cp - 0xFE00 + 1 if cp <= 0xFE0F else cp - 0xE0100 + 17}"
            elif category == "tags_block":
                token = f"TAG_{cp - 0xE0000:X}"
            rows.append((chr(cp), category, action, rule, token, name_of(chr(cp))))
    tags = {"CYRILLIC": "CYR", "GREEK": "GRK", "ARMENIAN": "ARM"}
    for ch, plain in confusables().items():
        if unicodedata.category(ch)[0] != "L":
            continue
        tag = next((t for name, t in tags.items() if unicodedata.name(ch, "").startswith(name)), "CONF")
        rows.append((ch, "homoglyph", "homoglyph", "mixed_script", f"{tag}_{plain.upper()}", name_of(ch)))
    return rows


@cache
def folds() -> dict[str, str]:
    """Characters whose case folding is not their lower case alone, or whose lower case depends on what stands by."""
    known = {chr(cp): chr(cp).casefold() for cp, category in _facts() if category[0] in "LMNS" and cp > 127}
    return {c: f for c, f in known.items() if f != c.lower() or c in "Σς"}


@cache
def fold_class() -> str:
    return char_class((ord(c), ord(c)) for c in sorted(folds()))
