"""Names that are nearly alike: a similarity join by segments, and grouping in the order of the names.

Two names match if they are equal but for case, if their edit distance is at most `distance`, or if 1 - distance / longer length is at least `least`.

The join is exact and has no nested loop. If two names are within t edits and one is cut into t + 1 segments, some segment is
in the other name unchanged and hardly displaced: at most i - 1 places for segment i from the left, t + 1 - i from the right.
So the shorter name of a pair gives its segments, the longer one the substrings that may be one of them, and the two meet
by equality. Short segments meet by chance, so each name carries bits of its letters and of its pairs of neighbouring letters: an edit changes
at most two and four of these, and pairs that differ in more are dropped in the join itself. The rest is verified by edit distance there and then; only
matches are shuffled again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rows, staging

DISTANCE, LEAST, FIRST = 3, 0.8, 4096


def _edits(length: Column, distance: int, least: float) -> Column:
    """Edits within which a name of this length matches shorter ones; rounded up a little, as pairs are verified."""
    return F.greatest(F.lit(distance), F.floor(length * (1 - least) + 1e-6)).cast("int")


def _pieces(names: DataFrame) -> DataFrame:
    """names with i, start, size for each segment of a name of `length` letters cut for `edits`; all are counted from 1, the last ones are longer by
    one where it doesn't come out even. If there are fewer letters than segments, only the empty one is sure to be in the other name.

    What is used twice has a column of its own: one expression for all would grow too large for the JVM to compile.
    """
    tiny, segments, i = F.col("length") <= F.col("edits"), F.col("edits") + 1, F.col("i")
    out = names.withColumn("even", F.when(tiny, 0).otherwise(F.floor(F.col("length") / segments)).cast("int")).withColumn("short", F.when(tiny, 1).otherwise(segments - F.col("length") % segments))
    out = out.withColumn("i", F.explode(F.sequence(F.lit(1), F.when(tiny, 1).otherwise(segments))))
    start = (i - 1) * F.col("even") + F.greatest(F.lit(0), i - 1 - F.col("short")) + 1
    return out.withColumn("start", start).withColumn("size", F.col("even") + (i > F.col("short")).cast("int")).drop("even", "short")


def _mark(name: str) -> bytes:
    """256 bits: for each hash value of a pair of neighbouring letters whether the name has it an odd number of times."""
    bits = 0
    for a, b in zip(name, name[1:]):
        bits ^= 1 << (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA6B >> 11 & 255)
    return bits.to_bytes(32, "little")


def _letters(name: str) -> int:
    """The same in 61 bits for single letters."""
    bits = 0
    for a in name:
        bits ^= 1 << ord(a) % 61
    return bits


def _marked(names: DataFrame) -> DataFrame:
    """name and mark, four longs for pairs of letters and one for letters. Dealt out over all tasks: a few megabytes of names would else be cut up and compared by one."""
    # by another hash than the one that made them distinct, else Spark leaves the step out
    dealt = names.select("name").repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("name"))

    def marked(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            marks = np.frombuffer(b"".join(map(_mark, texts)), "<i8").reshape(-1, 4)
            words = [pa.array(np.ascontiguousarray(marks[:, k])) for k in range(4)] + [pa.array(list(map(_letters, texts)), "int64")]
            mark = pa.StructArray.from_arrays(words, [f"w{k}" for k in range(5)])
            yield pa.RecordBatch.from_arrays([batch.column(0), mark], names=["name", "mark"])

    return dealt.mapInArrow(marked, "name string, mark struct<w0:long,w1:long,w2:long,w3:long,w4:long>")


def _meet() -> Column:
    """Where segments and substrings meet, in eight bytes; what meets by chance alone is dropped with all else that doesn't match."""
    return F.xxhash64("edits", "length", "i", F.substring("name", F.col("at"), F.col("size"))).alias("meet")


def _carried(side: str) -> list[Column]:
    """What is compared when names meet; plain columns, as a struct would be taken apart for each pair."""
    return [F.col("name").alias(f"{side}er"), F.col("letters").alias(f"{side}_letters"), *[F.col(f"mark.w{k}").alias(f"{side}_w{k}") for k in range(5)]]


def _segments(names: DataFrame, distance: int, least: float) -> DataFrame:
    """meet, shorter and what it carries: segments of each name for all numbers of edits that a longer partner may allow."""
    length = F.length("name")
    longest = F.ceil(length / least + 1e-6).cast("int") if least > 0 else F.lit(1 << 20)
    partners = F.sequence(length, F.greatest(longest, length + distance))
    allowed = F.transform(partners, lambda n: F.when(n - _edits(n, distance, least) <= length, _edits(n, distance, least)))
    out = names.select("name", "mark", length.alias("letters"), length.alias("length"), F.explode(F.array_compact(F.array_distinct(allowed))).alias("edits"))
    return _pieces(out).withColumnRenamed("start", "at").select(_meet(), *_carried("short"))


def _substrings(names: DataFrame, distance: int, least: float) -> DataFrame:
    """meet, longer and what it carries, allowed: what segment i of a partner of each length (not longer than the name) may be."""
    own, edits, i, start = F.length("name"), F.col("edits"), F.col("i"), F.col("start")
    out = names.select("name", "mark", own.alias("letters"), _edits(own, distance, least).alias("edits"))
    out = _pieces(out.withColumn("length", F.explode(F.sequence(F.greatest(F.col("letters") - edits, F.lit(0)), F.col("letters")))))
    out = out.withColumn("more", F.col("letters") - F.col("length"))
    low = F.greatest(F.lit(1), start - (i - 1), start + F.col("more") - (edits + 1 - i))
    high = F.least(F.col("letters") - F.col("size") + 1, start + (i - 1), start + F.col("more") + (edits + 1 - i))
    empty = F.col("length") <= edits
    out = out.withColumn("low", F.when(empty, 1).otherwise(low)).withColumn("high", F.when(empty, 1).otherwise(high)).where("low <= high")
    out = out.withColumn("at", F.explode(F.sequence("low", "high")))
    # the most edits that verified names may have, without the rounding up
    exact = F.when((edits <= distance) | (1 - edits / F.col("letters") >= least), edits).otherwise(edits - 1)
    return out.select(_meet(), *_carried("long"), exact.alias("allowed"))


def _byte_edits(a: str, b: str) -> Column:
    """Edits of the UTF-8 bytes of two columns; never fewer than those of their characters."""
    return F.levenshtein(*(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1") for c in (a, b)))


def _met(short: DataFrame, long: DataFrame, distance: int, least: float, in_bytes: bool) -> DataFrame:
    """shorter, longer, distance for all matches of a marked name of the first frame with one of the second that is not shorter."""
    # both sides are shuffled: their size before they are cut up, which Spark goes by, would have it broadcast a side hundreds of times as large
    met = _segments(short, distance, least).hint("merge").join(_substrings(long, distance, least), "meet")
    apart = [F.bit_count(F.col(f"short_w{k}").bitwiseXOR(F.col(f"long_w{k}"))) for k in range(5)]
    pairs, letters = apart[0] + apart[1] + apart[2] + apart[3], apart[4]
    more, allowed, edits = F.col("long_letters") - F.col("short_letters"), F.col("allowed"), F.levenshtein("shorter", "longer")
    # an insertion or deletion changes three pairs of letters and one letter, a substitution four and two
    like = (pairs <= 4 * allowed - more) & (letters <= 2 * allowed - more) & (more >= 0)
    # one condition, in the order of cost: few pass the marks, and fewer the count that stops at the edits allowed
    like = like & (F.call_function("levenshtein", F.col("shorter"), F.col("longer"), allowed) >= 0)
    if in_bytes:
        plain = (F.octet_length("shorter") == F.col("short_letters")) & (F.octet_length("longer") == F.col("long_letters"))
        like, edits = like & (plain | (_byte_edits("shorter", "longer") <= allowed)), F.when(plain, edits).otherwise(_byte_edits("shorter", "longer"))
    return met.where(like).select("shorter", "longer", edits.alias("distance")).distinct()


def near_names(left: DataFrame, right: DataFrame, distance: int = DISTANCE, least: float = LEAST, in_bytes: bool = False) -> DataFrame:
    """left_name, right_name, distance for all matching pairs of lower-case names (column `name` of both frames).

    With in_bytes edits are those of the UTF-8 bytes, as some engines' levenshtein counts them; lengths stay those in characters. Such a
    distance is never under that in characters, so the segments find all pairs in either case.
    """
    left, right = (_marked(d.select(F.lower("name").alias("name")).where("name is not null").distinct()) for d in (left, right))
    forth, back = _met(left, right, distance, least, in_bytes), _met(right, left, distance, least, in_bytes)
    forth = forth.select(F.col("shorter").alias("left_name"), F.col("longer").alias("right_name"), "distance")
    back = back.where(F.length("shorter") < F.length("longer"))  # equally long ones came forth
    return forth.unionByName(back.select(F.col("longer").alias("left_name"), F.col("shorter").alias("right_name"), "distance"))


def _first_leaders(block: DataFrame, pairs: DataFrame) -> DataFrame:
    """name, rank of those that no earlier leader of the block matches: the groups that going through the names in order would open.

    A name that matches no earlier open name leads; those that match it are settled; the rest goes on. Each round settles at least the first
    open name, and in practice a few rounds settle all.
    """
    open_, edges, leaders = block, pairs, None
    while True:
        lead = open_.join(edges.select(F.col("later").alias("name")), "name", "left_anti")
        lead = staging.stage_table(lead, "leaders")
        leaders = lead if leaders is None else leaders.unionByName(lead)
        settled = edges.join(lead.select(F.col("name").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("name")).distinct()
        open_ = staging.stage_table(open_.join(lead.select("name"), "name", "left_anti").join(settled, "name", "left_anti"), "open")
        if open_.isEmpty():
            return leaders
        left = open_.select("name")
        edges = edges.join(left.withColumnRenamed("name", "earlier"), "earlier", "left_semi").join(left.withColumnRenamed("name", "later"), "later", "left_semi")
        edges = staging.stage_table(edges, "edges")


def group_names(df: DataFrame, name: str, order: list[str], distance: int = DISTANCE, least: float = LEAST, first: int = FIRST, in_bytes: bool = False) -> DataFrame:
    """df with `group_name`: each name joins the first group, in the order of opening, whose name it matches, else opens one of its own.

    The result is that of a loop over all names and groups; the work is joins. Names are taken in stretches of their order, each four times
    as long as all before; a stretch is compared with itself, and its new groups then take all later names that match them, so what is
    alike is settled early and later stretches have few pairs. Null names have no group.
    """
    key = F.lower(F.col(f"`{name}`"))
    firsts = df.where(key.isNotNull()).groupBy(key.alias("name")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in order], F.col(f"`{name}`").alias("_spelt"))).alias("_at"))
    ranked = rows.row_numbers(firsts, ["_at"]).select("name", F.col("row_idx").alias("rank"), F.col("_at._spelt").alias("spelt"))
    ranked = open_ = staging.stage_table(ranked, "names")
    taken, upto = None, first
    total = ranked.count()
    while total:
        block = open_.where(F.col("rank") < upto).select("name", "rank")
        with_rank = lambda n, r: block.select(F.col("name").alias(n), F.col("rank").alias(r))  # noqa: B023, E731
        marked = _marked(block.select("name"))
        pairs = _met(marked, marked, distance, least, in_bytes).join(with_rank("shorter", "a"), "shorter").join(with_rank("longer", "b"), "longer").where("a <> b")
        earlier, later = (F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)) for x, y in (("shorter", "longer"), ("longer", "shorter")))
        pairs = staging.stage_table(pairs.select(earlier.alias("earlier"), later.alias("later")).distinct(), "edges")
        leaders = staging.stage_table(_first_leaders(block, pairs), "leaders")
        others = open_.select("name", "rank").join(leaders.select("name"), "name", "left_anti")
        hit = near_names(leaders, others, distance, least, in_bytes).join(leaders.select(F.col("name").alias("left_name"), F.col("rank").alias("leader")), "left_name")
        hit = hit.join(others.select(F.col("name").alias("right_name"), "rank"), "right_name").where("leader < rank")
        joined = hit.groupBy(F.col("right_name").alias("name")).agg(F.min("leader").alias("leader"))
        joined = joined.unionByName(leaders.select("name", F.col("rank").alias("leader")))
        joined = staging.stage_table(joined, "joined")
        taken = joined if taken is None else taken.unionByName(joined)
        open_ = staging.stage_table(open_.join(joined.select("name"), "name", "left_anti"), "open")
        if upto >= total or open_.isEmpty():
            break
        upto = min(5 * upto, total)
    spelt = ranked.select(F.col("rank").alias("leader"), F.col("spelt").alias("group_name"))
    groups = (taken if taken is not None else ranked.select("name", F.col("rank").alias("leader"))).join(spelt, "leader").select(F.col("name").alias("_key"), "group_name")
    return df.join(groups, key == F.col("_key"), "left").drop("_key")

