"""BPE against the tokenizers library, source divergence and phrases against brute force and their SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkstrata.llm import bpe, divergence, phrases

PATH = "/opt/tokenizers/byte_bpe_50k.json"
DOCS = "doc_id long, text string, lang string, source string, ids string, term string, n long, place int"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(open(PATH, encoding="utf-8").read()))


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns named as the operators' own."""
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "12 34 !!", None, "a"), (None, "the same words, the same words", "en", None),
        (5, "the same words here. The same", "en", "b"), (5, "the same words here. The same", "en", "b"),
        (6, "The Same words; here the words é É", "en", "c"), (7, "long word " * 30000, "en", "b"), (8, "é中\U0001f600 ​ <|endoftext|>x", "de", ""),
        (9, "été été\ta b\r\na  b", "de", "x"), (10, "été a b", "de", "y"), (11, "a b été", "de", "x"), (12, "", "fr", "z"), (13, "!", "fr", "w"),
    ]
    return spark.createDataFrame([(*r, "i", "t", 1, 2) for r in rows], DOCS)


# 11 ------------------------------------------------------------------------------------------

ALPHABET = ["a", "B", "the", "'s", "'ll", "'LL", " ", "  ", "\n", "\t", "é", "中", "1", "²", ".", "!!", "<|endoftext|>", "<|end", "\U0001f600", "​"]
ALPHABET += ["\x85", "\x1c", "　", "I'm", "'", "﻿", "\x00", "ǅ", "٣"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(ALPHABET)).map("".join), st.text()))
def test_ids_equal_the_library(encoder, library, text):
    ids = encoder.text(text)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert encoder.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False) == text


def test_every_character_in_context(encoder, library):
    for c in [*range(0x3100), *range(0x3100, 0x110000, 211)]:
        if not 0xD800 <= c < 0xE000:
            s = f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} y\n{chr(c)}\t"
            assert encoder.text(s).tolist() == library.encode(s, add_special_tokens=False).ids, hex(c)


def test_no_token_spans_a_forced_cut(encoder):
    for token in encoder.v.tokens.values():
        if token not in encoder.v.added:
            assert all(encoder.v.joined[a, b] for a, b in zip(token, token[1:], strict=False))
    assert 100 < (~encoder.v.joined).sum() < 65536


def test_any_ids_decode_as_the_library_does(encoder, library):
    rng = random.Random(5)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert encoder.decode(np.array(ids, np.int32)) == library.decode(ids, skip_special_tokens=False)
    assert encoder.decode(np.array([50257, -1, 64], np.int32)) == encoder.decode(np.array([64], np.int32))


def test_long_texts_and_small_caches(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 64)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    for s in ("ab" * 3000, "x9_ q" * 900, "word and don't  word\n\n" * 200, " " * 999, "<|endoftext|> " * 99):
        ids = encoder.text(s)
        assert ids.tolist() == library.encode(s, add_special_tokens=False).ids
        assert encoder.decode(ids) == s
        assert encoder.id_digest(ids) == hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def test_bpe_digest_of_every_document(spark, tiny, library, edges):
    for df in (spark.read.parquet(f"{tiny}/documents.parquet"), edges):
        rows = df.collect()
        want = Counter()
        for r in rows:
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want[r.doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text))] += 1
        out = bpe.digest(df, PATH)
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want
        assert out.columns == [*(c for c in df.columns if c != "text"), "n_tokens", "ids_sha256", "decoded_sha256"]


def test_bpe_round_trip_of_frames(spark, edges):
    there = bpe.encode(edges, PATH)
    assert there.columns == [*(c for c in edges.columns if c != "ids"), "ids"]
    back = bpe.decode(there, PATH)
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).first().decoded == ""
    assert bpe.digest(edges.limit(0), PATH).count() == 0


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Vocabulary(open("/opt/tokenizers/word_bpe_49k.json", encoding="utf-8").read())


# 12 ------------------------------------------------------------------------------------------


def oracle(df, sql):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall())


def rows_of(df):
    return sorted(df.columns), Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def divergence_by_hand(rows, min_docs=3, top=200):
    """Every definition read off literally, with Python's integers."""
    docs = [(r.lang or "", r.source or "", r.text or "") for r in rows]
    words = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t) for _, _, t in docs]
    words = [["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in ws] for ws in words]
    seen, out = defaultdict(Counter), set()
    for (lang, _, _), ws in zip(docs, words, strict=True):
        seen[lang].update(set(ws))
    for lang in {d[0] for d in docs}:
        kept = {t for t, n in seen[lang].items() if n >= min_docs}
        held = defaultdict(Counter)
        for (g, source, _), ws in zip(docs, words, strict=True):
            if g == lang:
                held[source].update(w for w in ws if w in kept)
        whole = sum(held.values(), Counter())

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        def f(x, y):
            return (x - y) * (x - y) // y

        for source, c in held.items():
            pairs = [(-sum(f(p(c, t), p(d, t)) for t in kept), o) for o, d in held.items() if o != source]
            terms = [(-f(p(c, t), p(whole, t)), t) for t in c if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                ranked = sorted(found, key=lambda x: (x[0], x[1].encode()))
                out |= {(item, lang, part, rank, source, -v) for rank, (v, item) in enumerate(ranked, 1)}
    return out


def test_divergence_by_hand_and_by_sql(spark, tiny, edges, monkeypatch):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for chunk, block, part in ((4096, 32, 16), (7, 3, 2)):
        monkeypatch.setattr(divergence, "CHUNK", chunk)
        monkeypatch.setattr(divergence, "BLOCK", block)
        monkeypatch.setattr(divergence, "SLICE", part)
        for df in (docs, edges):
            if chunk == 7 and df is docs:
                df = docs.where("lang in ('en', 'de')")
            names, got = rows_of(divergence.audit(df))
            assert (names, got) == oracle(df, divergence.ORACLE)
            if df is edges:
                assert set(got) == divergence_by_hand(df.collect())
    assert divergence.audit(edges.limit(0)).count() == 0


def test_shares_of_large_counts_are_exact():
    rng = random.Random(3)
    for _ in range(500):
        total = rng.randrange(2, 9 * 10**13)
        count = rng.randrange(0, total - 1)
        assert int(divergence.shares(np.int64(count), np.int64(total))) == 1 + 10**9 * (count + 1) // total
    assert pa.array(divergence.term_codes(np.zeros(0, np.uint8), np.zeros(2, np.int64))[1]).to_pylist() == []


# 13 ------------------------------------------------------------------------------------------


def phrases_by_hand(rows, least=10, top=2000):
    f, total = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, count in f.items():
        found = []
        for phrase, a in count.items():
            if len(phrase) == 1 or a < least:
                continue
            longer = [b for q, b in count.items() if len(q) == 3 and len(phrase) == 2 and b >= least and phrase in (q[:2], q[1:])]
            if any(100 * b >= 50 * a for b in longer):
                continue
            cuts = [(10**6 * a * a // (count[phrase[:k]] * count[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(phrase).encode(), a, count[phrase[:k]], count[phrase[k:]], score))
        for rank, (_, _, text, a, left, right, score) in enumerate(sorted(found)[:top], 1):
            out.add((a, left, lang, total[lang], text.decode(), right, rank, score))
    return out


@pytest.fixture(scope="module")
def chatter(spark, edges):
    """Few words in many orders, so that counts tie, phrases nest and overlap."""
    rng = random.Random(9)
    words = ["new", "york", "city", "New", "of", "of", "é", "a", "x.", "b,", "c\tnew", "york\ncity"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None]), None) for i in range(150)]
    rows += [(1000 + i, "new york city " * 5 + "of of of of", "en", "s") for i in range(6)]
    return spark.createDataFrame([(*r, "i", "t", 1, 2) for r in rows], DOCS).unionByName(edges)


def test_phrases_by_hand_and_by_sql(spark, tiny, chatter, edges, monkeypatch):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for df, batch in ((docs, 1 << 22), (docs, 1 << 17), (chatter, 1 << 22), (chatter, 2000), (edges, 1 << 22)):
        monkeypatch.setattr(phrases, "BATCH", batch)
        names, got = rows_of(phrases.mine(df))
        assert (names, got) == oracle(df, phrases.ORACLE)
        assert set(got) == phrases_by_hand(df.collect())
    assert phrases.mine(edges.limit(0)).count() == 0


def test_phrases_are_ranked_in_rounds(spark, chatter, monkeypatch):
    want = phrases_by_hand(chatter.collect(), top=5)
    monkeypatch.setattr(phrases, "RANKED", 40)
    monkeypatch.setattr(phrases, "BUCKET", 3)
    assert set(rows_of(phrases.mine(chatter, top=5))[1]) == want


def test_keys_and_large_dictionaries():
    rng = np.random.default_rng(4)
    ids = np.sort(rng.integers(1, 1 << 39, (500, 3)), axis=0)
    keys = phrases.key_bytes(ids, 5)
    assert [tuple(int.from_bytes(bytes(k[i : i + 5]), "big") for i in (0, 5, 10)) for k in keys] == [tuple(x) for x in ids.tolist()]
    triple = rng.integers(1, 50, (3, 4000))
    for base in (50, 1 << 21):  # packed in one number, and by way of pairs
        grams, n = phrases._distinct(*triple, base)
        assert Counter(map(tuple, triple.T.tolist())) == dict(zip(map(tuple, grams.tolist()), n.tolist(), strict=True))
        assert [tuple(x) for x in grams.tolist()] == sorted(map(tuple, grams.tolist()))


def test_scores_beyond_64_bits(spark):
    a, left, right = 900_000_000_000_000, 900_000_000_000_001, 999_999_999_999_999
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases._score("a", "l", "r").alias("s")).first()
    assert row.s == 10**6 * a * a // (left * right)


def test_ranges_and_groups_of_any_size(spark, chatter, monkeypatch):
    want = phrases_by_hand(chatter.collect())
    monkeypatch.setattr(phrases, "BATCH", 3000)
    for group, part in ((1, 4000), (700, 1500), (10**9, 10**9)):
        monkeypatch.setattr(phrases, "GROUP", group)
        monkeypatch.setattr(phrases, "PART", part)
        assert set(rows_of(phrases.mine(chatter))[1]) == want


def test_sums_of_equal_keys():
    rng = np.random.default_rng(2)
    for width in (1, 9, 15, 16):
        keys, n = rng.integers(0, 3, (3000, width)).astype(np.uint8), rng.integers(1, 9, 3000)
        want = Counter()
        for k, c in zip(keys, n, strict=True):
            want[bytes(k)] += int(c)
        found, total = phrases.summed(keys, n)
        assert [(bytes(k), int(c)) for k, c in zip(found, total, strict=True)] == sorted(want.items())
