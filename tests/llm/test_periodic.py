"""Periodic runs against a search over every period, on sequences made to be hard and on whole documents."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sheafwork.llm import periodic

from .helpers import SF, WORD, awkward, empty


def brute(words) -> list[tuple[int, int, int]]:
    """All runs (start, end, smallest period) by trying every period."""
    _, s = np.unique(np.asarray(words, dtype=object).astype(str), return_inverse=True)
    n, best = len(s), {}
    for q in range(1, n // 3 + 1):
        same = np.concatenate([[0], (s[q:] == s[:-q]).astype(np.int8), [0]])
        edge = np.diff(same)
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if b + q - a >= max(24, 3 * q):
                best.setdefault((a, b + q), q)  # a multiple of the smallest period has the same ends
    return sorted(((a, e, q) for (a, e), q in best.items()), key=lambda r: (r[0], r[2]))


def sequence(rng: random.Random, kind: int) -> list[int]:
    n = rng.randrange(0, 500)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:  # repeated stretches of all lengths, one after another
        s = []
        while len(s) < n:
            unit = [rng.randrange(3) for _ in range(rng.randrange(1, 50))]
            s += (unit * rng.randrange(1, 8))[: rng.randrange(1, 300)]
        return s
    if kind == 2:  # Fibonacci words: the most runs of runs
        a, b = [0, 1], [0]
        while len(a) < n:
            a, b = a + b, a
        return (a * 2)[:n]
    unit = ([0, 1] * rng.randrange(1, 20) + [2]) * rng.randrange(1, 3) + [rng.randrange(3)]  # blocks that are periodic themselves
    s = (unit * 60)[:n]
    for _ in range(rng.randrange(3)):
        if s:
            s[rng.randrange(len(s))] = rng.randrange(3)
    return s


@pytest.mark.parametrize("kind", range(4))
def test_runs_equal_brute_force(kind):
    rng = random.Random(kind)
    for _ in range(150):
        s = sequence(rng, kind)
        assert [tuple(r) for r in periodic.runs_in(np.array([*s, 10**6], np.uint64)).tolist()] == brute(s)


def test_successor():
    rng = np.random.default_rng(3)
    values = rng.permutation(1000)[:700]
    tree = periodic.WaveletTree(values, 1000)
    lo = rng.integers(0, 700, 500)
    hi = np.minimum(lo + rng.integers(0, 80, 500), 700)
    bound = rng.integers(0, 1100, 500)
    want = [min((v for v in values[a:b] if v >= c), default=-1) for a, b, c in zip(lo, hi, bound)]
    assert tree.successor(lo, hi, bound, -1).tolist() == want


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    drop = {i for a, e, q in runs for i in range(a + q, e)}
    lines = "".join(f"{a},{e - a},{q}\n" for a, e, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def found(df):
    return sorted(map(tuple, periodic._digests(periodic.periodic_runs(df, periodic.planted)).collect()), key=repr)


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert sorted(map(tuple, periodic.op12_periodic(spark, SF).collect()), key=repr) == want
    assert sum(r[1] for r in want) > 10


def test_awkward_rows(spark):
    assert found(empty(spark)) == []
    assert found(awkward(spark)) == sorted((expected(r.doc_id, r.text) for r in awkward(spark).collect()), key=repr)
    assert re.fullmatch("[0-9a-f]{64}", found(awkward(spark))[0][-1])


def test_long_and_constant_texts(spark):
    texts = ["a " * 40_000, " ".join(f"w{i % 7000}" for i in range(50_000)), " ".join(f"w{i}" for i in range(50_000)), "x " * 24, "x " * 23]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.periodic_runs(docs).collect()}
    assert runs == {0: [(0, 40_000, 1)], 1: [(0, 50_000, 7000)], 2: [], 3: [(0, 24, 1)], 4: []}
