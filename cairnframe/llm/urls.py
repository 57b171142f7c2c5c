"""URL filters: a path-template tree per host, with DataFrame and SQL functions only.

A url's path becomes a template, segment by segment: a segment that looks generated (digits, hexadecimal, dates, a long mixture)
turns into a wildcard that keeps its shape (`<n>`, `<hex>`, `<id>`), and the literal children of a node that have fewer than `rare` pages
turn into `<*>` where the node has more than `fan_out` of them. Sibling branches of a host (same depth, same following shapes, differing in
one literal segment) merge where a two-proportion test can't tell their labelled shares from those of their kin apart and each holds enough labelled
pages. A template is rejected where its smoothed labelled purity, (blocked + strength * the host's share) / (labelled + strength), reaches
`reject_at`; the host's share, blocked / (labelled + strength), is drawn towards 0 itself. Pages without a label say nothing, and a branch without labelled
pages has no purity and is allowed: that other branches of its host are bad is no evidence against it.
Segments beyond `depth` collapse into `<**>`.

Rules come first: a rule (host suffix, path prefix) fits its host and all subdomains; the longest (host and path together, then
host, then text) wins. Pages that a rule decides are also the labels of the tree, unless a label column is given.

Defined results: a null url, or one without `://`, has an empty host and path, no rule and the tree's verdict for the empty host
(allow, since nothing there is labelled); repeated rows and ties are separate rows with the same verdict; other columns are ignored.

All aggregates are counts by (host, template), which combine before they shuffle, and the tree's tables join by (host, template):
where a host holds a third of the rows, its rows are first reduced to distinct templates on each task, and adaptive execution
splits what a join still finds skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored

#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s)(?:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s)(?:.*?)://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule and its verdict, or nulls."""
    which, verdict = None, None
    for rule, v in sorted(rules, key=lambda r: (-len(r[0]), -len(r[0].partition("/")[0]), r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        which = F.when(fits, rule) if which is None else which.when(fits, rule)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (which, verdict) if which is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def shape_of(segment: Column) -> Column:
    """A wildcard for a segment that looks generated, else the segment. An extension stays: 474.html is <n>.html."""
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    ending = F.substring(segment, F.length(stem) + 1, F.length(segment))
    return (
        F.when(stem.rlike(r"^[0-9]+$"), F.concat(F.lit("<n>"), ending))
        .when(stem.rlike(r"^[0-9]{1,4}([-_.][0-9]{1,4})+$"), F.concat(F.lit("<date>"), ending))
        .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), F.concat(F.lit("<hex>"), ending))
        .when((F.length(stem) >= 16) & stem.rlike("[0-9]"), F.concat(F.lit("<id>"), ending))
        .otherwise(segment)
    )


def templates(pages: DataFrame, depth: int) -> DataFrame:
    """pages (host, path, ...) with `t`, the array of at most depth + 1 template segments."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    parts = F.transform(parts, shape_of)
    cut = F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.lit("<**>")))).otherwise(parts)
    return pages.withColumn("t", cut)


def judge(pages: DataFrame, rules=RULES, label: str | None = None, depth: int = 4, fan_out: int = 50, rare: int = 10, strength: float = 4.0, reject_at: float = 0.7, z: float = 1.64) -> DataFrame:
    """page_id, host, path, rule, template, purity, verdict for every row of pages (page_id, url and `label`, true for bad, if named)."""
    known = [F.col(label).cast("boolean").alias("given")] if label else []
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), *known)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "by_rule": verdict})
    base = base.withColumn("bad", F.col("given") if label else F.col("by_rule") == "block")
    base = templates(base, depth)

    # Distinct templates of a host with their counts: everything after this works on them, not on pages.
    store = Stored(pages.sparkSession, "urls")
    tree = base.groupBy("host", "t").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bad").isNotNull()).alias("labelled"), F.count_if("bad").alias("blocked"))
    tree = store.write(tree.withColumn("from", F.col("t")))
    for level in range(depth):
        # Generalise: rare literal children of one parent, if there are many, become <*>.
        at, key = F.get("t", F.lit(level)), F.slice("t", 1, level)
        node = tree.where((F.size("t") > level) & ~F.startswith(at, F.lit("<"))).groupBy("host", key.alias("key"), at.alias("child")).agg(F.sum("n").alias("child_n"))
        scarce = node.where(F.col("child_n") < rare).select("host", "key", "child")
        wide = scarce.groupBy("host", "key").agg(F.count(F.lit(1)).alias("children")).where(F.col("children") > fan_out).select("host", "key")
        scarce = scarce.join(wide, ["host", "key"]).withColumn("wide", F.lit(True))
        tree = store.write(
            tree.withColumns({"key": key, "child": at})
            .join(scarce, ["host", "key", "child"], "left")
            .withColumn("t", F.when(F.col("wide"), F.concat("key", F.array(F.lit("<*>")), F.slice("t", level + 2, depth + 1))).otherwise(F.col("t")))
            .drop("key", "child", "wide")
        )
    merged = tree.groupBy("host", "t").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))

    # Merge: siblings that differ in their first literal segment only, labelled alike. Each is compared with its family as a whole.
    literal = F.array_position(F.transform("t", lambda s: F.when(F.startswith(s, F.lit("<")), 0).otherwise(1)), 1).cast("int")
    family = F.when(literal > 0, F.concat(F.slice("t", F.lit(1), literal - 1), F.array(F.lit("<+>")), F.slice("t", literal + 1, F.lit(depth + 1)))).otherwise(F.col("t"))
    merged = merged.withColumn("family", family)
    kin = merged.groupBy("host", "family").agg(F.sum("labelled").alias("all_n"), F.sum("blocked").alias("all_bad"))
    rest_n, rest_bad = F.col("all_n") - F.col("labelled"), F.col("all_bad") - F.col("blocked")
    share, rest_share, pooled = F.try_divide("blocked", "labelled"), F.try_divide(rest_bad, rest_n), F.try_divide("all_bad", "all_n")
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), rest_n)))
    alike = (F.col("labelled") >= 5) & (rest_n >= 5) & (F.abs(share - rest_share) <= z * spread)
    merged = merged.join(kin, ["host", "family"]).withColumn("branch", F.when(alike, F.col("family")).otherwise(F.col("t")))
    branch = merged.groupBy("host", "branch").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    hosts = branch.groupBy("host").agg((F.sum("blocked") / (F.sum("labelled") + F.lit(strength))).alias("host_share"))
    purity = F.when(F.col("labelled") > 0, (F.col("blocked") + strength * F.col("host_share")) / (F.col("labelled") + strength))
    verdicts = branch.join(hosts, "host").select("host", "branch", purity.alias("purity"))
    verdicts = merged.select("host", "t", "branch").join(verdicts, ["host", "branch"])
    verdicts = store.write(tree.select("host", F.col("from").alias("was"), "t").join(verdicts, ["host", "t"]).select("host", "was", "branch", "purity"))
    return base.join(verdicts.withColumnRenamed("was", "t"), ["host", "t"], "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.concat(F.lit("/"), F.array_join("branch", "/")).alias("template"),
        "purity",
        F.coalesce("by_rule", F.when(F.col("purity") >= reject_at, "block").otherwise("allow")).alias("verdict"),
    )
