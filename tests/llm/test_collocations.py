"""Collocations against a plain count of all phrases, with one trie and with many."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sheafwork.llm import collocations as co

from .helpers import SF, awkward, empty


def brute(rows, least=100, longest=5, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * found[p[i:j]]}
        scored = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()
    want = brute(docs)
    assert want and rows_of(co.op11_collocations(spark, SF)) == want


@pytest.mark.parametrize("part, vocabulary", [(1 << 20, 1 << 22), (150, 100)])
def test_low_support(spark, monkeypatch, part, vocabulary):
    monkeypatch.setattr(co, "PART", part)
    monkeypatch.setattr(co, "VOCABULARY", vocabulary)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    assert rows_of(co.collocations(docs, 6, 4, 300)) == brute(docs.select("lang", "text").collect(), 6, 4, 300)


def test_awkward(spark):
    assert rows_of(co.collocations(empty(spark))) == []
    docs = awkward(spark)
    want = brute(docs.select("lang", "text").collect(), 3)
    assert want and rows_of(co.collocations(docs, 3)) == want


def test_pieces_blanks_and_null_languages(spark):
    texts = ["A b.C d a B", "a\tb  c, a b\x0bc d", "a b\nc d a b", None, "", "x:y z;x y z!x y z", "ÀB ab àb AB"] * 4
    docs = spark.createDataFrame([(None if i % 3 else "fr", t) for i, t in enumerate(texts)], "lang string, text string")
    assert rows_of(co.collocations(docs, 2)) == brute(docs.collect(), 2)


def test_long_texts_are_cut_between_pieces(spark):
    long = ("one two three four five six. " * 60_000) + "word " * 300_000 + ", end of it"
    docs = spark.createDataFrame([("en", long), ("en", "seven one")], "lang string, text string")
    assert rows_of(co.collocations(docs, 100, 3)) == brute(docs.collect(), 100, 3)


def test_double_array_holds_its_phrases():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.zipf(1.3, (3000, 2)) % 400 + 5, axis=0)
    triples = np.unique(np.column_stack([pairs[rng.integers(0, len(pairs), 2000)], rng.integers(5, 405, 2000)]), axis=0)
    trie, (two, three) = co.Trie.build([pairs, triples])
    assert len({*two.tolist(), *three.tolist()}) == len(two) + len(three)
    text = rng.integers(0, 420, 20_000)
    text[::3] = pairs[rng.integers(0, len(pairs), len(text[::3])), 0]
    by_state = {s: tuple(p) for s, p in zip([*two.tolist(), *three.tolist()], [*pairs.tolist(), *triples.tolist()])}
    known = set(by_state.values())
    for size, (at, state) in zip((2, 3), trie.walk(text, 3)):
        assert [by_state[s] for s in state.tolist()] == [tuple(text[i : i + size].tolist()) for i in at.tolist()]
        assert len(at) == sum(tuple(text[i : i + size].tolist()) in known for i in range(len(text)))
