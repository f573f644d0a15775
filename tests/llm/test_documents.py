"""Operators over documents: awkward tables, brute force, held-out accuracy."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafwork.llm import common, hilbert, langid, mixing, ngram_join, packing, quality, queries, tokens, toxicity

from .helpers import EXTRA, SF, WORD, awkward, awkward_rows, empty, key, prose


def test_hilbert_index_visits_neighbours(spark):
    cells = spark.range(512).select((F.col("id") % 8).alias("a"), (F.floor(F.col("id") / 8) % 8).alias("b"), F.floor(F.col("id") / 64).alias("c"))
    rows = sorted((r.hilbert, r.a, r.b, r.c) for r in hilbert.with_hilbert_index(cells, ["a", "b", "c"], 3).collect())
    assert [r[0] for r in rows] == list(range(512))
    assert all(sum(abs(p[i] - q[i]) for i in (1, 2, 3)) == 1 for p, q in zip(rows, rows[1:]))


def test_hilbert_shards(spark):
    docs = awkward(spark)
    rows = hilbert.document_shards(docs).collect()
    texts = [r[1] for r in awkward_rows()]
    assert len(rows) == len(texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in awkward_rows())
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    assert max(map(len, shards.values())) - min(len(shards.get(s, [])) for s in range(16)) <= 1 and set(shards) <= set(range(16))
    for own in shards.values():
        own.sort(key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
    order = [r.hilbert for s in sorted(shards) for r in shards[s]]
    assert order == sorted(order)
    assert hilbert.document_shards(empty(spark)).count() == 0
    assert hilbert.shard_manifest(hilbert.document_shards(docs), ["d_size"]).agg(F.sum("rows")).first()[0] == len(texts)


def test_hilbert_plan_is_native(spark):
    plan = hilbert.op3_hilbert(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def brute_quality(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), copies, len(covered))


def test_quality_counts(spark):
    repeated = "\n".join(["the same line of eight words is here"] * 3 + ["# other | line", "", "# other | line"])
    texts = [r[1] for r in awkward_rows()] + [repeated, "a b c d e f g h " * 5, "x" * 5000]
    for t in texts:
        assert quality.text_counts(t)[:5] == brute_quality(t), (t or "")[:40]


def test_quality_variety_at_any_length():
    """The share of different words depends on the words, not on how long the text is."""
    at = quality.COUNTS + quality.MORE
    for n in (1000, 4999, 5000, 60_000):
        few = dict(zip(at, quality.text_counts(" ".join(f"w{i * i % 83}" for i in range(n)))))
        many = dict(zip(at, quality.text_counts(" ".join(f"w{i * 7919 % 1_000_003}" for i in range(n)))))
        assert few["n_distinct"] / n < 0.1
        assert many["n_distinct"] == n


def test_quality_judgement(spark):
    rows = quality.judge(awkward(spark)).collect()
    assert len(rows) == len(awkward_rows())
    for r in rows:
        n, _, _, _, repeats = (r[c] for c in quality.COUNTS)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (r.base_failed and r.kept) and 0 <= r.quality <= 1
    assert quality.judge(empty(spark)).count() == 0


def test_quality_agrees_with_labels(spark):
    found = quality.op9_quality(spark, "/root/testdata/sf0.01").where("not base_failed").join(common.table(spark, "/root/testdata/sf0.01", "labels").select("doc_id"), "doc_id")
    share = found.toPandas()
    labels = common.table(spark, "/root/testdata/sf0.01", "labels").toPandas().set_index("doc_id")["quality"]
    good = labels.loc[share["doc_id"]].to_numpy() == 1
    assert (share["kept"].to_numpy()[good]).mean() > 0.98 and (~share["kept"].to_numpy()[~good]).mean() > 0.9


def test_langid(spark):
    found = langid.op4_langid(spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert (found["held_out"] == [zlib.crc32(key(d)) % 3 == 1 for d in found["doc_id"]]).all()
    held = found[found["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert found["score"].between(0, 1).all() and found["rejected"].mean() < 0.01


def test_langid_awkward(spark):
    docs = awkward(spark)
    out = langid.keep_identified(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert not {3, 4, 5, 8} & kept and {1, 2, 7} <= kept
    by = {r.row.doc_id: r for r in langid.identify(docs, F.lit(True)).collect()}
    assert by[3].lang_pred == by[8].lang_pred == "und" and by[3].score == 0
    assert langid.keep_identified(empty(spark)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}


def test_toxicity_learns(spark):
    found = toxicity.op2_toxicity(spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").toPandas()
    assert (found["held_out"] == [zlib.crc32(key(d)) % 5 == 0 for d in found["doc_id"]]).all()
    assert ((found["predicted"] == 1) == (found["score"] >= 0.5)).all()
    held = found[found["held_out"]]
    assert ((held["predicted"] == 1) & (held["toxic"] == 0)).sum() == 0
    assert (held["predicted"] == held["toxic"]).mean() > 0.9


def test_toxicity_is_noisy_or(spark):
    texts = [prose(i, 40).replace(" river", " river.") + (" you vile grub." if i % 3 == 0 else "") for i in range(90)]
    model = toxicity.train(texts, np.array([int(i % 3 == 0) for i in range(90)]))
    text = prose(500, 30) + " Such a vile grub. " + prose(501, 20)
    bag = toxicity.Bag(toxicity.encode(text))
    p = model.sentences(bag)
    score, n, worst, start, end = model.score(text)
    assert n == len(p) == 3 and math.isclose(score, 1 - np.prod(1 - p), rel_tol=1e-9) and score > 0.5 and worst == p.max()
    assert b"vile grub" in toxicity.encode(text)[start:end]
    docs = spark.createDataFrame([(1, text), (2, prose(700, 30)), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.sentence) for r in toxicity.toxic_sentences(docs, model).collect()] == [(1, 1)]


def test_toxicity_awkward(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 1), (7, 1, 0), (3, 0, None), (None, 1, 1), (9, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(rows) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in rows)
        assert all(r.score == 0 for r in rows if not WORD.search(r.row.text or ""))
    out = toxicity.keep_clean(docs, none)
    assert out.columns == docs.columns and out.count() == len(awkward_rows())
    assert toxicity.keep_clean(empty(spark), none).count() == 0


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers(spark):
    import random

    r, t, own = random.Random(3), tokenizer(), tokens.Encoder()
    texts = [x[1] or "" for x in awkward_rows()] + ["".join(r.choice([" ", " ", "a", "b", "'s", "1", "!", "\n", "\t", "\u00a0", "é", "日", ".", "\x1c", "<|endoftext|>"]) for _ in range(r.randint(0, 14))) for _ in range(800)]
    for text in texts:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text[:50])
    assert np.frombuffer(own.ids("a <|endoftext|> b"), "<u4").tolist().count(50256) == 1
    plain, t.encode_special_tokens = tokens.Encoder(special={}), True
    assert np.frombuffer(plain.ids("a <|endoftext|> b"), "<u4").tolist() == t.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_length_histogram(spark):
    lengths = [0, 0, 3, 3, 3, 10, 50]
    df = spark.createDataFrame([(n,) for n in lengths] + [(None,)], "n_tokens long")
    rows = {r.length: r for r in tokens.length_histogram(df).collect()}
    assert sorted(rows) == [0, 3, 10, 50] and rows[0].n_docs == 3
    for limit, r in rows.items():
        assert r.total_upto_limit == sum(min(n, limit) for n in lengths) and r.docs_longer == sum(n > limit for n in lengths)
    h = tokens.length_histogram(df)
    answers = {r.context: r for r in tokens.answer_limits(h, [5, 100]).collect()}
    assert answers[5].tokens_cut == 0 + 9 + 5 + 5 and answers[5].docs_over == 2 and answers[100].tokens_cut == answers[100].tokens == 69
    assert tokens.quantile(h, 0.5).first()[0] == 3
    assert tokens.length_histogram(tokens.token_counts(empty(spark))).count() == 0
    assert tokens.length_histogram(tokens.token_counts(awkward(spark))).agg(F.sum("n_docs")).first()[0] == len(awkward_rows())


def test_vector_packing_keeps_limits():
    rng = np.random.default_rng(1)
    items = np.stack([rng.integers(1, 300, 500), rng.integers(1, 3, 500), rng.integers(0, 200, 500)], 1)
    bins, places = packing.pack_vectors(items, (1000, 8, 600))
    for b in np.unique(bins):
        own = items[bins == b]
        assert (own.sum(0) <= (1000, 8, 600)).all() and sorted(places[bins == b]) == list(range(len(own)))
    lower = np.ceil(items.sum(0) / (1000, 8, 600)).max()
    assert bins.max() + 1 <= 1.15 * lower
    with pytest.raises(ValueError):
        packing.pack_vectors(np.array([[2000, 1, 1]]), (1000, 8, 600))


def test_packing(spark):
    rows = packing.pack(awkward(spark), segments=4).collect()
    t, ids = tokenizer(), defaultdict(list)
    for d, text, *_ in awkward_rows():
        ids[d].append(t.encode(text or "", add_special_tokens=False).ids + [0])
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    for d, own in ids.items():
        assert sum(r.length for r in pieces[d]) == sum(map(len, own))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.r_[0, np.cumsum([r.length for r in own])[:-1]].tolist()
        assert sum(r.length for r in own) <= 1024 and len(own) <= 4
    assert packing.pack(empty(spark)).count() == 0


def test_packing_by_each_limit(spark):
    rows = [(i, prose(i, 30), prose(900 + i, 60)) for i in range(80)] + [(500, None, prose(1, 400)), (501, prose(2, 400), ""), (502, None, None)]
    docs, t = spark.createDataFrame(rows, "doc_id long, before string, text string"), tokenizer()
    bound = {}
    for name, limits in {"tokens": (300, 64, 300), "segments": (300, 2, 300), "loss": (300, 64, 90)}.items():
        length, segments, loss = limits
        found = packing.pack(docs, length, segments, loss, "before").collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in found:
            pieces[r.doc_id].append(r)
            sequences[r.sequence_id].append(r)
        for d, before, text in rows:
            quiet, ids = (t.encode(x or "", add_special_tokens=False).ids for x in (before, text))
            bears, at = [0] * len(quiet) + [1] * len(ids) + [0], 0
            for r in sorted(pieces[d], key=lambda r: r.start):
                assert r.start == at and r.loss_tokens == sum(bears[at : at + r.length]) and r.doc_tokens == len(bears)
                assert r.ids_crc32 == zlib.crc32(np.array([*quiet, *ids, 0][at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(bears)
        used = [(sum(r.length for r in s), len(s), sum(r.loss_tokens for r in s)) for s in sequences.values()]
        assert all(u <= most for row in used for u, most in zip(row, limits))
        bound[name] = used
    # without its limit more would have gone in: fewer sequences, and some hold more than the limit lets through
    assert len(bound["segments"]) > len(bound["tokens"]) < len(bound["loss"])
    assert max(u[1] for u in bound["tokens"]) > 2 and max(u[2] for u in bound["tokens"]) > 90
    with pytest.raises(ValueError):
        packing.pack(docs, loss=0)


def test_exchanges(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (2, 0, "assistant", "alone"), (3, 0, "user", None), (3, 1, "assistant", "b"), (None, 1, "assistant", "c")]
    got = packing.exchanges(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {tuple(r) for r in got.collect()} == {(1, 2, "q", "a"), (2, 0, None, "alone"), (3, 1, None, "b"), (None, 1, None, "c")} and got.count() == 4
    real = spark.read.parquet(f"{SF}/conversations.parquet")
    packed = packing.pack(packing.exchanges(real), loss=512, prompt="prompt").agg(F.sum("loss_tokens"), F.sum("length")).first()
    assert 0 < packed[0] < packed[1]


def test_samples_are_bounded(spark):
    repeated = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same long text again").alias("text"), F.lit("en").alias("lang"))
    varied = spark.range(50_000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("other text "), "id").alias("text"), F.lit("fr").alias("lang"))
    none = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("null id "), "id").alias("text"), F.lit("de").alias("lang"))
    docs = repeated.union(varied).union(none)
    sizes = {r.lang: r["count"] for r in langid.sample_by_class(docs, "lang", 200).groupBy("lang").count().collect()}
    assert sizes.get("en", 0) <= 1 and 100 < sizes["fr"] <= 400 and 100 < sizes["de"] <= 400
    known = docs.withColumn("toxic", (F.col("lang") == "fr").cast("int"))
    sample = {r.toxic: (r.n, r.o) for r in common.bounded_sample(known, "toxic", 500, 5000).groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("o")).collect()}
    assert all(n <= 500 and o <= 5000 for n, o in sample.values()) and len(sample) == 2
    assert common.bounded_sample(empty(spark).withColumn("toxic", F.lit(1)), "toxic", 5).count() == 0


def test_packing_pads_little(spark):
    rows = packing.op5_packing(spark, "/root/testdata/sf0.01").groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n"), F.count("*")).first()
    assert rows[0] / (1024 * rows[1]) > 0.99


def test_mixing(spark):
    docs = awkward(spark)
    sized = mixing.sized_documents(docs)
    budgets = {r.source: r for r in mixing.source_budgets(sized, evenness=0.9).collect()}
    p = np.array([b.share for b in budgets.values() if b.share > 0])
    w = np.array([b.weight for b in budgets.values() if b.share > 0])
    a = next(iter(budgets.values())).exponent
    assert np.allclose(w, p**a / (p**a).sum()) and math.isclose(w.sum(), 1, abs_tol=1e-9)
    entropy = -(w * np.log(w)).sum()
    assert entropy >= 0.9 * math.log(len(w)) - 1e-6 or (w / p).max() <= mixing.REPEATS + 1e-3
    taken = mixing.schedule(sized, mixing.source_budgets(sized, evenness=0.9)).collect()
    by = defaultdict(list)
    for r in taken:
        by[r.source].append(r)
    for source, own in by.items():
        own.sort(key=lambda r: (r.source_start, r.n_tokens))
        b = budgets[source]
        assert own[-1].source_start < b.budget and sum(r.n_tokens for r in own) >= b.budget
        whole = Counter(r.doc_id for r in own if r["pass"] == 0)
        if b.passes >= 1:
            assert sum(whole.values()) == b.docs
    again = Counter(r.doc_id for r in mixing.mixed_documents(docs, evenness=0.9).collect())
    assert again == Counter(r.doc_id for r in taken)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


def test_mixing_target_acts_on_whole_tables(spark):
    """The registered target binds: exponent below 1, some documents repeat, some are left out, and blocks hold the sources in proportion."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sized = mixing.sized_documents(docs)
    budgets = {r.source: r for r in mixing.source_budgets(sized).collect()}
    assert all(0 < r.exponent < 1 for r in budgets.values())
    w = [r.weight for r in budgets.values()]
    assert -sum(x * math.log(x) for x in w) >= mixing.EVENNESS * math.log(len(w)) - 1e-6
    taken = mixing.op7_mixing(spark, sf).collect()
    copies = Counter(r.doc_id for r in taken)
    assert max(copies.values()) > 1 and len(copies) < docs.select("doc_id").distinct().count()
    assert Counter(r.doc_id for r in mixing.mixed_documents(docs).select("doc_id").collect()) == copies
    longest = max(r.n_tokens for r in taken)
    tokens: Counter = Counter()
    for r in taken:
        tokens[r.source, r.block] += r.n_tokens
    for source, b in budgets.items():
        assert sum(n for (s, _), n in tokens.items() if s == source) == pytest.approx(b.budget, abs=longest)
        own = [r for r in taken if r.source == source]
        upto = 0  # a block begins where its share of the budget begins, whatever the other sources do
        for r in sorted(own, key=lambda r: r.source_start):
            assert r.source_start == upto and r.block == min(int(r.source_start / b.budget * 64), 63)
            upto += r.n_tokens
    assert {r.block for r in taken} == set(range(64))


def test_mixing_more_blocks_for_more_tokens(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 1000)
    sized = spark.createDataFrame([(i, f"s{i % 3}", 100, i) for i in range(3000)], "doc_id long, source string, n_tokens long, key long")
    taken = mixing.schedule(sized, mixing.source_budgets(sized)).collect()
    sums: Counter = Counter()
    for r in taken:
        sums[r.block] += r.n_tokens
    assert len(sums) == 300 and max(sums.values()) <= 1200


def test_mixing_exponent(spark):
    shares = spark.createDataFrame([(0.9,), (0.05,), (0.05,)], "share double")
    a = mixing.find_exponent(shares, evenness=0.8, repeats=100)
    p = np.array([0.9, 0.05, 0.05]) ** a
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - 0.8 * math.log(3)) < 1e-4
    capped = mixing.find_exponent(shares, evenness=1.0, repeats=2)
    q = np.array([0.9, 0.05, 0.05]) ** capped
    assert abs((q / q.sum() / [0.9, 0.05, 0.05]).max() - 2) < 1e-3


def brute_join(rows, least=0.8):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall(text or "")
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    root, links = list(range(len(rows))), [0] * len(rows)
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    return links, [min(groups[find(i)]) for i in range(len(rows))]


def near_rows():
    rows, base = [], prose(9, 120).split()
    for i in range(60):
        words = list(base)
        for k in range(i % 12):
            words[(7 * k + i) % len(words)] = f"edit{i}"
        rows.append((i, " ".join(words)))
    return rows + [(100 + i, prose(200 + i, 40)) for i in range(20)] + [(300, "two words"), (301, "two words"), (302, ""), (303, "two words more")]


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    rows = near_rows()
    links, component = brute_join(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1024, 16):  # one cell, and many blocks
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        found = {r.doc_id: r for r in ngram_join.jaccard_join(docs).collect()}
        assert [found[r[0]].n_links for r in rows] == links
        assert [found[r[0]].component_id for r in rows] == component
        assert [found[r[0]].kept for r in rows] == [c == r[0] for c, r in zip(component, rows)]


def test_ngram_join_awkward(spark):
    docs = awkward(spark)
    found = ngram_join.jaccard_join(docs).collect()
    assert len(found) == len(awkward_rows())
    by = {r.doc_id: r for r in found}
    assert by[2].class_id == by[2].component_id == 1 and by[2].n_links == 2 and not by[2].kept
    assert by[3].n_links == by[4].n_links == 0 and by[3].kept
    out = ngram_join.keep_one(docs)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and ids.count(1) == 1 and 2 not in ids and {3, 4, 5, 7} <= set(ids)
    assert ngram_join.jaccard_join(empty(spark)).count() == 0 and ngram_join.keep_one(empty(spark)).count() == 0


def test_ngram_join_keeps_texts_that_share_an_id(spark):
    a = prose(700, 120)
    near = [" ".join([*a.split()[:-2], *more]) for more in (("x", "y"), ("z", "y"))]
    rows = [(1, a), (1, prose(701, 120)), (2, near[0]), (3, near[1]), (None, a), (None, prose(702, 50)), (4, prose(701, 120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.n_links) for r in ngram_join.jaccard_join(docs).collect())
    assert found == [(0, 0), (0, 3), (1, 1), (1, 3), (2, 3), (3, 3), (4, 1)]
    kept = sorted((r.doc_id or 0, r.text) for r in ngram_join.keep_one(docs).collect())
    assert kept == sorted([(1, a), (1, prose(701, 120)), (0, prose(702, 50))])


def test_prefix_depth(spark):
    none, _ = ngram_join.prefix_depth({})
    assert ngram_join.meeting_chance(0.8, none) >= ngram_join.RECALL > ngram_join.meeting_chance(0.8, none + 1)
    # pairs that share long prefixes only allow longer ones; some that share short ones only call for these
    assert ngram_join.prefix_depth({8: 1e6})[0] == ngram_join.DEPTH and ngram_join.prefix_depth({8: 990.0, 2: 10.0})[0] <= 2
    docs = spark.createDataFrame(near_rows(), "doc_id long, text string")
    signed = ngram_join.signatures(docs).where("print is not null").groupBy("print").agg(F.first("signature").alias("signature")).withColumn("cls", F.monotonically_increasing_id())
    depth, measured = ngram_join.prefix_depth(ngram_join.audit(signed))
    assert measured >= 0.99 and 1 <= depth <= ngram_join.DEPTH


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert EXTRA


def test_langid_holds_many_languages(spark):
    """Two hundred languages: each is fitted in a task of its own, and the driver holds the model alone."""
    import random
    import resource

    rng = random.Random(8)
    rows = []
    for lang in range(200):
        stems = ["".join(chr(97 + rng.randrange(26)) for _ in range(4)) for _ in range(12)]
        rows += [(lang * 100 + i, " ".join(rng.choice(stems) for _ in range(60)), f"l{lang:03d}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = langid.identify(docs, common.fold_of(F.col("doc_id"), 3) != 1).select("row.lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.98
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB


def test_langid_refuses_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "some words", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.identify(docs, F.lit(True))


def test_short_texts_fill_sequences(spark):
    """Documents of a few ids: no limit on segments leaves a sequence half empty."""
    docs = spark.createDataFrame([(i, f"w{i % 7}") for i in range(3000)], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    total = sum(r.length for r in rows)
    assert total >= 0.9 * 1024 * len({r.sequence_id for r in rows}) and total > 5000


def test_prefix_depth_of_the_join_needs_no_sample(spark, monkeypatch):
    """the depth was taken from an audit of 512 classes."""
    monkeypatch.setattr(ngram_join, "audit", lambda *_: pytest.fail("a sample decides"))
    asked = []
    monkeypatch.setattr(ngram_join, "candidate_cells", lambda classes, depth, real=ngram_join.candidate_cells: asked.append(depth) or real(classes, depth))
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight {i // 2}") for i in range(20)], "doc_id long, text string")
    assert {r.n_links for r in ngram_join.jaccard_join(docs).collect()} == {1}
    assert asked and ngram_join.meeting_chance(ngram_join.JACCARD, asked[0]) >= ngram_join.RECALL
