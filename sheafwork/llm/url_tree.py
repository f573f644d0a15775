"""URL filtering by a path-template tree for each host.

Paths are cut into segments; runs of digits and long hexadecimal runs are wildcards at once, which leaves far
fewer shapes than pages. Level by level, to whatever depth labels disagree, a segment with few pages among
many values becomes `*` unless its labels set it apart, then sibling branches whose labelled bad rates don't differ significantly are
merged into `+`; `**` is whatever follows. A template is blocked
if its bad rate, smoothed towards its host's and the host's towards the whole, is over a limit. Given rules for
(host, path) come first.

Only counts by shape are ever grouped; pages meet their template again in one join. Shapes that hold many pages are salted
there, so that no host or path fills a task; the many shapes of few pages are not copied. Null URLs and those without `://` have an empty host and path and are one template of
their own. Pages may repeat; each row is judged. Without any label every template is allowed. An empty table gives an empty
result; extra columns are ignored; very long URLs are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage_table, table

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Copies of the verdict of a hot shape, and how many shapes can be hot.
SALTS, HOT = 32, 256
#: The segment of a path that ends in its node.
END = "\x00"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; nulls where none fits."""
    text = verdict = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text.otherwise(none), verdict.otherwise(none))


def shape(path: Column) -> Column:
    """The path with long hexadecimal runs and runs of digits as wildcards, without a slash at either end."""
    plain = F.regexp_replace(F.regexp_replace(path, r"[0-9a-fA-F]{16,}", "{h}"), r"[0-9]+", "{n}")
    return F.regexp_replace(plain, r"^/+|/+$", "")


def differs(l: Column, b: Column, all_l: Column, all_b: Column, z: float) -> Column:  # noqa: E741
    """Whether a two-proportion test tells b of l from the rest of all_b of all_l."""
    n0, b0, pooled = all_l - l, all_b - b, all_b / all_l
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(l, F.lit(1)) + 1 / F.greatest(n0, F.lit(1))))
    return F.coalesce((l > 0) & (n0 > 0) & (spread > 0) & (F.abs(b / F.greatest(l, F.lit(1)) - b0 / F.greatest(n0, F.lit(1))) > z * spread), F.lit(False))


def grow_templates(shapes: DataFrame, share: float = 0.02, least: int = 10, z: float = 1.96) -> DataFrame:
    """From (host, shape, n, labelled, bad): host, shape and its template.

    The tree grows by a level a round, past whatever all paths of a node share, until no node can be split: one
    whose labels agree or are at most z * z has no branch, at any depth, that the test below could tell apart.
    A segment is variable where its node has many values with few pages each: it has under `least` pages, or under
    `share` of its node's and fewer than there are values. One whose labels differ from its siblings' stays literal
    whatever its share. From the deepest level up, branches that are one template each merge unless `differs` tells their bad rate from their siblings'.
    """
    rows = shapes.select("host", "shape", "n", "labelled", "bad", F.split("shape", "/").alias("rest"), F.array().cast("array<string>").alias("branch"))
    grown, levels = [], 0
    while True:
        nodes = rows.groupBy("host", "branch").agg(F.sum("labelled").alias("_l"), F.sum("bad").alias("_b"), F.min("rest").alias("_lo"), F.max("rest").alias("_hi"))
        nodes = nodes.where((F.col("_lo") != F.col("_hi")) & (F.col("_l") > z * z) & (F.col("_b") > 0) & (F.col("_b") < F.col("_l")))
        shared = F.array_position(F.zip_with("_lo", "_hi", lambda x, y: x.eqNullSafe(y)), False).cast("int") - 1
        rows = stage_table(rows.join(nodes.select("host", "branch", shared.alias("_p")), ["host", "branch"], "left"), "url-tree")
        grown.append(rows.where("_p is null").drop("_p"))
        rows = rows.where("_p is not null")
        if rows.isEmpty():
            break
        levels += 1
        rows = rows.withColumn("_s", F.coalesce(F.try_element_at("rest", F.col("_p") + 1), F.lit(END)))
        children = rows.groupBy("host", "branch", "_s").agg(F.sum("n").alias("_n"), F.sum("labelled").alias("_l"), F.sum("bad").alias("_b"))
        whole = children.groupBy("host", "branch").agg(F.sum("_n").alias("_all"), F.sum("_l").alias("_al"), F.sum("_b").alias("_ab"), F.count("*").alias("_values"))
        literal = children.join(whole, ["host", "branch"]).where(literal_segment(share, least, z)).select("host", "branch", "_s", F.lit(True).alias("_keep"))
        label = F.array_join(F.concat(F.slice("rest", 1, F.col("_p")), F.array(F.when(F.col("_keep") | (F.col("_s") == END), F.col("_s")).otherwise("*"))), "/")
        rows = rows.join(literal, ["host", "branch", "_s"], "left").select("host", "shape", "n", "labelled", "bad", F.slice("rest", F.col("_p") + 2, F.greatest(F.size("rest"), F.lit(1))).alias("rest"), F.array_append("branch", label).alias("branch"))
    tree = reduce(lambda x, y: x.unionByName(y), grown)
    for k in range(levels, 0, -1):
        node, s = F.slice("branch", 1, k - 1), F.try_element_at("branch", F.lit(k))
        deep = tree.where(F.size("branch") >= k)
        branches = deep.groupBy("host", node.alias("_node"), s.alias("_s")).agg(F.sum("labelled").alias("_l"), F.sum("bad").alias("_b"), (F.min("branch") == F.max("branch")).alias("_one"))
        whole = branches.groupBy("host", "_node").agg(F.sum("_l").alias("_al"), F.sum("_b").alias("_ab"), F.count("*").alias("_branches"))
        alike = (F.col("_branches") > 1) & F.col("_one") & ~differs(F.col("_l"), F.col("_b"), F.col("_al"), F.col("_ab"), z) & ~F.col("_s").endswith(END)
        merge = branches.join(whole, ["host", "_node"]).where(alike).select("host", "_node", "_s", F.lit(True).alias("_merge"))
        merged = F.array_append("_node", F.regexp_replace("_s", "(^|/)[^/]*$", "$1+"))
        met = tree.withColumns({"_node": node, "_s": s}).join(merge, ["host", "_node", "_s"], "left")
        # what merges is one template: all below it is left to the branch
        tree = stage_table(met.withColumn("rest", F.when(F.col("_merge"), F.array(F.lit("**"))).otherwise(F.col("rest"))).withColumn("branch", F.when(F.col("_merge"), merged).otherwise(F.col("branch"))).drop("_node", "_s", "_merge"), "url-tree")
    ends = tree.groupBy("host", "branch").agg(F.min("rest").alias("_lo"), F.max("rest").alias("_hi"))
    tail = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.array(F.lit("**")))
    template = F.concat(F.lit("/"), F.array_join(F.concat(F.filter("branch", lambda x: x != END), tail), "/"))
    ends = ends.select("host", "branch", F.regexp_replace(template, f"/?{END}", "").alias("template"))
    return tree.join(ends, ["host", "branch"]).select("host", "shape", "n", "labelled", "bad", F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template"))


def literal_segment(share: float, least: int, z: float) -> Column:
    """Whether a segment (_n pages, _l labels, _b bad) stays literal among its node's _values."""
    l, b, n0 = F.col("_l"), F.col("_b"), F.col("_al") - F.col("_l")  # noqa: E741
    rest, rate = (F.col("_ab") - b + 0.5) / (n0 + 1.0), b / F.greatest(l, F.lit(1))
    # Chernoff's bound: it holds for few labels too, and counts how many segments were looked at
    gap = l * (F.coalesce(rate * F.ln(rate / rest), F.lit(0.0)) + F.coalesce((1 - rate) * F.ln((1 - rate) / (1 - rest)), F.lit(0.0)))
    apart = differs(l, b, F.col("_al"), F.col("_ab"), z) & (gap > z * z / 2 + F.ln(F.col("_values")))
    return apart | ((F.col("_n") >= least) & ((F.col("_n") >= share * F.col("_all")) | (F.col("_n") >= F.col("_values"))))


def template_verdicts(templates: DataFrame, limit: float = 0.5, strength: float = 8.0) -> DataFrame:
    """host, shape, template, bad_rate (smoothed) and blocked. `strength` is the weight, in labels, of the rate above."""
    nodes = templates.groupBy("host", "template").agg(F.sum("n").alias("pages"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    hosts = nodes.groupBy("host").agg(F.sum("labelled").alias("_l"), F.sum("bad").alias("_b"))
    whole = hosts.agg(F.coalesce(F.sum("_b") / F.nullif(F.sum("_l"), F.lit(0)), F.lit(0.0)).alias("rate")).first()["rate"]
    hosts = hosts.select("host", ((F.col("_b") + strength * whole) / (F.col("_l") + strength)).alias("_rate"))
    rated = nodes.join(hosts, "host").withColumn("bad_rate", (F.col("bad") + strength * F.col("_rate")) / (F.col("labelled") + strength))
    rated = rated.select("host", "template", "bad_rate", "labelled", (F.col("bad_rate") > limit).alias("blocked"))
    return templates.select("host", "shape", "template").join(rated, ["host", "template"])


def hot_shapes(shapes: DataFrame) -> DataFrame:
    """host, shape, _hot of the shapes with at least 1 / HOT of all pages: no more than HOT rows, whatever the table, so they are broadcast."""
    total = shapes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return F.broadcast(shapes.where(F.col("n") * HOT >= max(total, 1)).select("host", "shape", F.lit(True).alias("_hot")))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = 0.5) -> DataFrame:
    """From pages (page_id, url) and labels (page_key, bad 0 or 1; pages' key is the number that ends their
    path): page_id, host, path, rule, verdict, template and bad_rate."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("shape", shape(F.col("path"))).withColumn("_key", F.expr("try_cast(regexp_extract(path, '([0-9]+)(?:[.][a-z]+)?/*$', 1) as bigint)"))
    marked = labels.where(F.col("bad").isNotNull()).groupBy(F.col("page_key").alias("_key")).agg(F.max("bad").alias("_bad"))
    # a null or much repeated key is spread: counts by key first, then one row for each key meets its label
    keyed = parsed.groupBy("host", "shape", "_key").agg(F.count("*").alias("n")).join(marked, "_key", "left")
    shapes = keyed.groupBy("host", "shape").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("_bad").isNotNull(), F.col("n"))), F.lit(0)).alias("labelled"), F.coalesce(F.sum(F.col("_bad") * F.col("n")), F.lit(0)).alias("bad"))
    shapes = stage_table(shapes, "url-shapes")
    hot = hot_shapes(shapes)
    verdicts = template_verdicts(grow_templates(shapes), limit).join(hot, ["host", "shape"], "left")
    salted = verdicts.withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    rule, ruled = matched_rule(F.col("host"), F.col("path"), rules)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).otherwise(0)
    rows = parsed.join(hot, ["host", "shape"], "left").withColumn("_salt", salt).drop("_hot")
    out = rows.join(salted, ["host", "shape", "_salt"], "left")
    verdict = F.coalesce(ruled, F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", "bad_rate")


def op6_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_key"), (1 - F.col("quality")).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), labels)
