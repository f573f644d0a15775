"""Phrase collocations: broadcast double-array tries of Apriori-safe candidates count all phrases of 2 to 5 words.

1. Words are counted by language, map-side first; those with `least` occurrences get numbers in the order of their hashes. A phrase that
   occurs `least` times has only such words. Texts become arrays of these numbers (-1: any other word or the end of a piece), in a table.
2. Candidates of k words: a trie of the candidates of k - 1 words moves over all positions at once; where a position and the next one both
   accept, every part of the k words is frequent, and the pair (state, next word) is a key. Keys are summed in tasks, dealt to piles by hash and summed there; those with `least` stay.
3. The trie of all candidates moves over all positions once more, level by level; counts of the states are taken with bincount in each task
   and summed over tasks. Those are the counts that results use.
4. Scores, containment and ranks are joins of the counted phrases. Products are decimals of 38 digits, so nothing is rounded.

A trie is built in a task and holds about PART phrases; more are dealt to several tries by their first two words, which are broadcast one after another,
each in a pass of its own (then only the front part of a candidate is tested, since the rest may be in another trie: counts stay exact).
The word numbers are broadcast in parts of VOCABULARY hashes alike. So nothing that is broadcast, collected or held grows with the corpus, and no phrase is left out.

Null texts are empty, a null language is `und`; empty texts have no words; very long texts are read in chunks cut between pieces; repeated rows count each time;
ties are broken as stated; an empty table gives an empty result; extra columns are ignored. Words are told by 64-bit hashes inside a task and by themselves in counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ranked, stage_table, table
from .words import Text, mix

LEAST, LONGEST, TOP = 100, 5, 2000
PART, VOCABULARY, CHUNK, HELD, WORDS, PILE = 1 << 20, 1 << 22, 1 << 18, 1 << 19, 1 << 17, 1 << 21

#: Pieces end at these bytes: . , ; : ! ? and \n \v \f \r.
ENDS = b".,;:!?\n\x0b\x0c\r"
_END = np.zeros(256, bool)
_END[list(ENDS)] = True
_APART = _END.copy()
_APART[[32, 9]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(language, lower-cased bytes): texts of a batch, side by side with an end between, a long text cut between pieces."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        data = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(_LOWER)
        at = 0
        while len(data) - at > CHUNK:
            cut = max(data.rfind(end, at, at + CHUNK) for end in (ENDS[i : i + 1] for i in range(len(ENDS))))
            if cut < 0:  # no end within a chunk: the piece goes on to its own end
                cut = min((p for p in (data.find(ENDS[i : i + 1], at + CHUNK) for i in range(len(ENDS))) if p >= 0), default=len(data) - 1)
            yield lang, data[at : cut + 1]
            at = cut + 1
        held.setdefault(lang, []).append(data[at:])
        size[lang] = size.get(lang, 0) + len(data) - at
        if size[lang] >= CHUNK:
            yield lang, b"\n".join(held.pop(lang))
            size[lang] = 0
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def _words(lang: str, data: bytes) -> tuple[Text, np.ndarray, np.ndarray]:
    """Words, their hashes by language, and whether each is the last of its piece."""
    text = Text(data, _APART)
    ends = np.concatenate([[0], np.cumsum(_END[text.bytes])])
    last = np.ones(len(text.starts), bool)
    last[:-1] = ends[text.starts[1:]] > ends[text.ends[:-1]]
    salt = Text(b"\x00" + lang.encode(), np.zeros(256, bool)).hashes
    return text, mix(text.hashes ^ salt).view(np.int64), last


class _Sums:
    """Counts by 64-bit key within a task; what it holds is bounded, a key may come out more than once."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > HELD:
            keys, counts = self.merged()
            self.keys, self.counts, self.size = [keys], [counts], len(keys)
            if self.size > HELD // 2:
                yield keys, counts
                self.keys, self.counts, self.size = [], [], 0

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        return keys, np.bincount(where, weights=np.concatenate(self.counts), minlength=len(keys)).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, hash, f: occurrences of each word in each language; word and hash are null in the row of a language's total."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, list]] = {}
        totals: dict[str, int] = {}

        def out():
            rows = [(lang, w, h, n) for lang, found in held.items() for h, (n, w) in found.items()] + [(lang, None, None, n) for lang, n in totals.items()]
            held.clear()
            totals.clear()
            columns = zip(*rows) if rows else ([],) * 4
            kinds = pa.string(), pa.string(), pa.int64(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "word", "hash", "f"])

        for batch in batches:
            for lang, data in _chunks(batch):
                text, hashes, _ = _words(lang, data)
                totals[lang] = totals.get(lang, 0) + len(hashes)
                keys, first, counts = np.unique(hashes, return_index=True, return_counts=True)
                of = held.setdefault(lang, {})
                starts, ends = text.starts[first].tolist(), text.ends[first].tolist()
                for h, n, a, e in zip(keys.tolist(), counts.tolist(), starts, ends):
                    if (old := of.get(h)) is None:
                        of[h] = [n, data[a:e].decode()]
                    else:
                        old[0] += n
                if sum(map(len, held.values())) > WORDS or len(totals) > WORDS:
                    yield out()
        yield out()

    words = docs.mapInArrow(count, "lang string, word string, hash long, f long")
    return words.groupBy("lang", "word").agg(F.min("hash").alias("hash"), F.sum("f").alias("f"))


def encode(docs: DataFrame, numbered: DataFrame, size: int) -> DataFrame:
    """Texts as arrays of word numbers (int32 bytes in `ids`); -1 stands between what can't be one phrase.

    numbered: hash and rank (gapless, in order of hash) of `size` words. More than VOCABULARY words take several passes.
    """
    out = docs
    parts = max(1, math.ceil(size / VOCABULARY))
    for part in range(parts):
        low = part * VOCABULARY
        mine = numbered.where((F.col("rank") >= low) & (F.col("rank") < low + VOCABULARY)).select("hash", "rank").toArrow()
        known, number = np.asarray(mine.column(0), np.int64), np.asarray(mine.column(1), np.int64)
        order = np.argsort(number)
        out = _look_up(out, known[order], low, part == 0, part == parts - 1)
    return out


def _look_up(rows: DataFrame, known: np.ndarray, low: int, first: bool, last: bool) -> DataFrame:
    def batches_of(batch):
        if first:
            for lang, data in _chunks(batch):
                _, hashes, ends = _words(lang, data)
                yield hashes, ends, np.full(len(hashes), -1, np.int32)
        else:
            for row in batch.to_pylist():
                yield np.frombuffer(row["hashes"], np.int64), np.frombuffer(row["ends"], bool), np.frombuffer(row["ids"], np.int32)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, ends, ids in batches_of(batch):
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                ids = np.where(known[at] == hashes, low + at, ids).astype(np.int32) if len(known) else ids
                if not last:
                    columns = [pa.array([a.tobytes()], pa.binary()) for a in (hashes, ends, ids)]
                    yield pa.RecordBatch.from_arrays(columns, ["hashes", "ends", "ids"])
                    continue
                # a break after each piece; single words and breaks in a row carry nothing
                spread = np.full(len(ids) + int(ends.sum()), -1, np.int32)
                spread[np.arange(len(ids)) + np.cumsum(ends) - ends] = ids
                joined = (spread[1:] >= 0) & (spread[:-1] >= 0)
                phrase = np.concatenate([joined, [False]]) | np.concatenate([[False], joined]) if len(spread) else np.zeros(0, bool)
                keep = phrase | np.concatenate([[False], phrase[:-1]])
                spread = np.where(phrase, spread, -1)[keep]
                yield pa.RecordBatch.from_arrays([pa.array([spread.astype(np.int32).tobytes()], pa.binary())], ["ids"])

    schema = "ids binary" if last else "hashes binary, ends binary, ids binary"
    return stage_table(rows.mapInArrow(find, schema), "collocation-ids")


class Trie:
    """A double array: state s goes on with symbol c to t = base[s] + c if check[t] = s. Symbols are the part's own, commonest first."""

    def __init__(self, symbols: np.ndarray, base: np.ndarray, check: np.ndarray):
        self.symbols, self.base, self.check = symbols, base, check
        self._order = np.argsort(symbols)
        self._sorted = symbols[self._order]

    @classmethod
    def build(cls, phrases: list[np.ndarray]) -> tuple[Trie, list[np.ndarray]]:
        """phrases[k]: rows of k + 2 word numbers, with all their prefixes of two or more words. Also returns each row's state."""
        symbols, uses = np.unique(np.concatenate([p.ravel() for p in phrases]), return_counts=True)
        order = np.argsort(-uses, kind="stable")
        code = np.empty(len(symbols), np.int64)
        code[order] = np.arange(len(symbols))
        coded = [code[np.searchsorted(symbols, p)] for p in phrases]
        array = _Slots(len(symbols))
        firsts = np.unique(coded[0][:, 0])
        array.used[firsts] = True
        array.check[firsts] = -2
        states, at = [], coded[0][:, 0]
        for level, rows in enumerate(coded):
            if level:  # a prefix's state, found by its row among the shorter ones
                shorter, inverse = np.unique(np.concatenate([coded[level - 1], rows[:, :-1]]), axis=0, return_inverse=True)
                of = np.full(len(shorter), -1)
                of[inverse.ravel()[: len(coded[level - 1])]] = states[-1]
                at = of[inverse.ravel()[len(coded[level - 1]) :]]
            states.append(array.place(at, rows[:, -1]))
        return cls(symbols[order], array.base[: array.top].astype(np.int32), array.check[: array.top].astype(np.int32)), states

    def codes(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self._sorted, ids), len(self._sorted) - 1)
        return np.where(self._sorted[at] == ids, self._order[at], -1)

    def walk(self, ids: np.ndarray, levels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For phrases of 2, 3, ... words: the positions at which one begins, and the states that they end in."""
        codes = self.codes(ids)
        at = np.flatnonzero(codes >= 0)
        at = at[self.check[codes[at]] == -2]
        state = codes[at]
        for step in range(1, levels):
            fits = at + step < len(codes)
            at, state = at[fits], state[fits]
            symbol = codes[at + step]
            to = self.base[state] + symbol
            fits = (symbol >= 0) & (to >= 0) & (to < len(self.check))
            fits[fits] = self.check[to[fits]] == state[fits]
            at, state = at[fits], to[fits]
            yield at, state


class _Slots:
    """The growing arrays of a double array, and where the next children fit."""

    def __init__(self, symbols: int):
        self.symbols, self.top = symbols, max(symbols, 1)
        self.random, self.used = np.random.default_rng(symbols), np.zeros(self.top, bool)
        self.base, self.check = np.zeros(self.top, np.int64), np.full(self.top, -1, np.int64)

    def _grow(self, size: int) -> None:
        self.top = max(self.top, size)
        if size > len(self.used):
            more = max(size, 3 * len(self.used) // 2) - len(self.used)
            self.used = np.concatenate([self.used, np.zeros(more, bool)])
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def place(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """States for the children (parent, symbol); parents with most children look for room first."""
        states = np.empty(len(parents), np.int64)
        order = np.lexsort((symbols, parents))
        starts = np.flatnonzero(np.concatenate([[True], parents[order][1:] != parents[order][:-1]])) if len(order) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(order)))
        for node in np.argsort(-sizes, kind="stable"):
            if sizes[node] == 1:
                break
            mine = order[starts[node] : starts[node] + sizes[node]]
            states[mine] = self._fit(parents[mine[0]], symbols[mine])
        single = order[starts[sizes == 1]]
        self._grow(self.top + len(single))
        free = np.flatnonzero(~self.used[: self.top])[: len(single)]
        self.used[free], self.check[free], self.base[parents[single]] = True, parents[single], free - symbols[single]
        states[single] = free
        return states

    def _fit(self, parent: int, symbols: np.ndarray) -> np.ndarray:
        """A base at which all symbols' slots are free, from random tries; the arrays grow by a quarter when none is found."""
        apart = symbols - symbols[0]
        tries = max(16, min(1024, (1 << 18) // len(symbols)))
        while True:
            for _ in range(16 if self.top > apart[-1] else 0):
                slots = self.random.integers(0, self.top - apart[-1], tries)[:, None] + apart
                ok = np.flatnonzero(~self.used[slots].any(1))
                if len(ok):
                    slots = slots[ok[0]]
                    self.used[slots], self.check[slots], self.base[parent] = True, parent, slots[0] - symbols[0]
                    return slots
            self._grow(max(self.top + self.top // 4, self.top + int(apart[-1]) + 1))


class Tries:
    """Tries of a table of phrases (array of word numbers), PART phrases each, built in tasks and read one at a time."""

    def __init__(self, phrases: DataFrame, label: str):
        self.parts = max(1, math.ceil(phrases.count() / PART))
        dealt = phrases.withColumn("part", F.pmod(F.xxhash64(F.col("phrase")[0], F.col("phrase")[1]), F.lit(self.parts)).cast("int"))

        def build(rows: pa.Table) -> pa.Table:
            lists = rows.column("phrase").combine_chunks()
            sizes, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
            at = np.cumsum(sizes) - sizes
            of = [np.flatnonzero(sizes == k) for k in range(2, int(sizes.max()) + 1)]
            trie, states = Trie.build([flat[at[rows_][:, None] + np.arange(k + 2)].reshape(-1, k + 2) for k, rows_ in enumerate(of)])
            part = rows.column("part")[0].as_py()
            arrays = [a.astype(np.int32).tobytes() for a in (trie.symbols, trie.base, trie.check)]
            where = np.empty(len(sizes), np.int64)
            for rows_, state in zip(of, states):
                where[rows_] = state
            schema = pa.schema([("part", pa.int32()), ("state", pa.int64()), ("phrase", pa.list_(pa.int32())), ("arrays", pa.list_(pa.binary()))])
            body = pa.table({"part": pa.array(np.full(len(sizes), part), pa.int32()), "state": where, "phrase": lists, "arrays": pa.nulls(len(sizes), pa.list_(pa.binary()))}, schema)
            return pa.concat_tables([body, pa.Table.from_pylist([{"part": part, "arrays": arrays}], schema)])

        built = dealt.select("part", "phrase").groupBy("part").applyInArrow(build, "part int, state long, phrase array<int>, arrays array<binary>")
        built = stage_table(built, f"collocation-{label}")
        self.states, self._arrays = built.where(F.col("state").isNotNull()).drop("arrays"), built.where(F.col("arrays").isNotNull())

    def __iter__(self) -> Iterator[tuple[int, Trie]]:
        for part in range(self.parts):
            row = self._arrays.where(F.col("part") == part).select("arrays").first()
            if row:
                yield part, Trie(*[np.frombuffer(a, np.int32) for a in row.arrays])


def _dealt(keys: np.ndarray, counts: np.ndarray, piles: int) -> pa.RecordBatch:
    """Counts dealt to piles by a hash of the key: one row of two arrays for each pile."""
    of = (mix(keys.view(np.uint64)) % np.uint64(piles)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []
    columns = [pa.array([int(of[p[0]]) for p in parts], pa.int64())]
    columns += [pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([counts[p].astype(np.int64).tobytes() for p in parts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["pile", "keys", "counts"])


def _added_up(dealt: DataFrame, least: int) -> DataFrame:
    """key, f of the keys whose counts sum to `least` or more; a task adds up the arrays of one pile."""

    def add_up(rows: pa.Table) -> pa.Table:
        keys, counts = (np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in rows.column(c)]) for c in ("keys", "counts"))
        order = np.argsort(keys, kind="stable")
        keys, sums = keys[order], np.cumsum(counts[order])
        last = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]]))
        total = np.diff(np.concatenate([[0], sums[last]]))
        enough = total >= least
        return pa.table({"key": keys[last][enough], "f": total[enough]})

    return dealt.groupBy("pile").applyInArrow(add_up, "key long, f long")


_DEALT = "pile long, keys binary, counts binary"


def _sum_keys(ids: DataFrame, keys, part: int, least: int, piles: int) -> DataFrame:
    """part, key, f of the keys that `keys` finds in the arrays, where they sum to `least` or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for data in batch.column(0):
                for found in sums.add(keys(np.frombuffer(data.as_buffer(), np.int32))):
                    yield _dealt(*found, piles)
        yield _dealt(*sums.merged(), piles)

    return _added_up(ids.mapInArrow(count, _DEALT), least).withColumn("part", F.lit(part))


def _pairs(ids: np.ndarray) -> np.ndarray:
    both = (ids[:-1] >= 0) & (ids[1:] >= 0)
    return ids[:-1][both].astype(np.int64) << 32 | ids[1:][both]


def _longer(trie: Trie, k: int, whole: bool):
    """Keys (state of k - 1 words, next word) at positions where a phrase of k words may be a candidate."""

    def keys(ids: np.ndarray) -> np.ndarray:
        at = state = np.zeros(0, np.int64)
        for at, state in trie.walk(ids, k - 1):
            pass
        next_ = at + k - 1
        fits = next_ < len(ids)
        fits[fits] = ids[next_[fits]] >= 0
        if whole:  # the last k - 1 words are a candidate too
            begins = np.zeros(len(ids) + 1, bool)
            begins[at] = True
            fits &= begins[at + 1]
        return state[fits].astype(np.int64) << 32 | ids[next_[fits]]

    return keys


def _piles(n_words: int) -> int:
    """Piles of counts: their number grows with the words, so that none does."""
    return max(64, math.ceil(n_words / PILE))


def candidates(ids: DataFrame, least: int, longest: int, n_words: int) -> DataFrame:
    """phrase (array of word numbers): all of 2 to `longest` words that occur `least` times."""
    key, piles = F.col("key"), _piles(n_words)
    word, front = key.bitwiseAND(0xFFFFFFFF).cast("int"), F.shiftright("key", 32)
    found = stage_table(_sum_keys(ids, _pairs, 0, least, piles).select(F.array(front.cast("int"), word).alias("phrase")), "collocation-2")
    every = found
    for k in range(3, longest + 1):
        tries = Tries(every if k == 3 else every.where(F.size("phrase") < k), f"trie-{k}")
        new = None
        for part, trie in tries:
            some = _sum_keys(ids, _longer(trie, k, tries.parts == 1), part, least, piles)
            some = some.select("part", front.alias("state"), word.alias("word"))
            some = stage_table(some, f"collocation-{k}") if tries.parts > 1 else some
            new = some if new is None else new.unionByName(some)
        if new is None:
            break
        new = stage_table(new.join(tries.states, ["part", "state"]).select(F.concat("phrase", F.array("word")).alias("phrase")), f"collocation-{k}")
        every = every.unionByName(new)
    return every


def count_phrases(ids: DataFrame, phrases: DataFrame, longest: int, n_words: int) -> DataFrame:
    """phrase, f: occurrences of the candidates, by bincounts of the states of their tries."""
    tries, piles = Tries(phrases, "trie"), _piles(n_words)
    out = phrases.withColumn("f", F.lit(0).cast("long")).limit(0)
    for part, trie in tries:

        def count(batches: Iterator[pa.RecordBatch], trie=trie) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(trie.check), np.int64)
            for batch in batches:
                for data in batch.column(0):
                    for _, state in trie.walk(np.frombuffer(data.as_buffer(), np.int32), longest):
                        counts += np.bincount(state, minlength=len(counts))
            seen = np.flatnonzero(counts)
            yield _dealt(seen, counts[seen], piles)

        summed = _added_up(ids.mapInArrow(count, _DEALT), 1).withColumnRenamed("key", "state")
        out = out.unionByName(summed.join(tries.states.where(F.col("part") == part), "state").select("phrase", "f"))
    return stage_table(out, "collocation-counts")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` phrases, as op11's contract defines them.

    docs: lang and text. `least` is at least 1, `longest` at least 2.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    words = stage_table(count_words(rows).where((F.col("f") >= least) | F.col("word").isNull()), "collocation-words")
    totals = words.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    numbered = ranked(words.where(F.col("word").isNotNull()), ["hash", "lang", "word"], "collocation-numbers")
    vocabulary = numbered.select("lang", "word", "hash", "rank", "f")
    ids = encode(rows, vocabulary, vocabulary.count())
    n_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    phrases = candidates(ids, least, longest, n_words)
    # phrases as words: only their own language's words have their numbers
    counted = count_phrases(ids, phrases, longest, n_words).where(F.col("f") >= least).select(F.monotonically_increasing_id().alias("no"), "phrase", "f")
    spelt = counted.select("no", "f", F.posexplode("phrase").alias("pos", "rank")).join(vocabulary.select("rank", "lang", "word"), "rank")
    spelt = spelt.groupBy("no").agg(F.first("lang").alias("lang"), F.first("f").alias("a"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    spelt = stage_table(spelt.select("lang", "a", F.col("w.word").alias("words")), "collocation-phrases")
    return _ranked(_scored(spelt, vocabulary, totals), top)


def _scored(spelt: DataFrame, vocabulary: DataFrame, totals: DataFrame) -> DataFrame:
    """Each phrase's lowest-scoring cut, for the phrases that no longer one with the same count contains."""
    of = F.array_join("words", " ")
    counts = spelt.select("lang", of.alias("part"), F.col("a").alias("f")).unionByName(vocabulary.select("lang", F.col("word").alias("part"), "f"))
    n_words = F.size("words")
    # a phrase of one word more is enough: counts between a phrase and a longer one with its count are equal
    inner = F.array(F.slice("words", 1, n_words - 1), F.slice("words", 2, n_words - 1))
    inside = spelt.where(n_words > 2).select("lang", F.col("a").alias("longer"), F.explode(inner).alias("words")).select("lang", "longer", of.alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = spelt.withColumn("phrase", of).join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), n_words - 1)))
    cuts = cuts.withColumn("left", F.array_join(F.slice("words", F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("right", F.array_join(F.slice("words", F.col("k") + 1, n_words), " "))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    exact = F.expr("cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    least = F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(least).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    pile = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = scored.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", pile).orderBy(*order))).where(F.col("_rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return some.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of `documents`; null texts are empty, null languages `und`, an empty table gives no rows."""
    return collocations(table(spark, sf_dir, "documents"))
