"""Operator 6, URL filters: rules first, then a tree of path templates learnt from all urls.

Paths are cut into segments. In each host, level by level down to the last segment, a segment that `support` pages of its
parent have stays as it is, however many others the parent has and whatever it looks like. Of the rarer ones those that look
like identifiers (with a digit) become wildcards, all of them if they are more than `spread` different ones or if the parent
has less than `support` pages: what is left is a template.
Branches of one host whose templates have the same shape are put into BANDS bands of their shares of bad pages, and bands,
in order, into groups: a band starts a new group if it differs significantly from any band of the group before (a two-sample
z test on the smoothed shares of all their pages), so no two bands of a group do. A merged template is
rejected when its share of bad labelled pages, smoothed by `prior` pages of the overall share, is at least `reject`; pages
of templates without labels have the overall share.

Rules name a host (and its subdomains) and the start of a path; the longest that fits decides. DataFrame functions only;
hosts may hold any share of the pages: all statistics are sums that are aggregated before a shuffle, and what is joined
back is one row per segment or template. Null urls and urls without `://` have an empty host and path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WILD = "*"
BANDS = 256  # of equal width in the arc sine of the root of the share, 0.6 percentage points at most


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """pages with `rule` and `ruled` (allow or block, null where none fits). rules: (verdict, host and path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest comes last and so is asked first
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return pages.withColumns({"rule": rule, "ruled": verdict})


def generalised(pages: DataFrame, levels: int | None, spread: int, support: int) -> DataFrame:
    """pages with `template`: segments of the path, rare ones as wildcards. levels: None for all; beyond them all are wildcards.

    Each level is written, as the next one reads it twice. Pages without further segments are set aside.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = pages.withColumn("segments", segments).withColumn("template", F.array().cast("array<string>"))
    level, names = 0, ["host", "template", "segment"]
    done = rows.where(F.size("segments") == 0)
    rows = rows.where(F.size("segments") > 0)
    while levels is None or level < levels:
        rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
        counts = written(rows.groupBy(*names).agg(F.count("*").alias("n")), "url-segments")
        rare = (F.col("n") < support) & ~F.col("segment").rlike("[0-9]")
        parents = counts.groupBy("host", "template").agg(F.count(F.when(rare, 1)).alias("kinds"), F.sum("n").alias("pages")).where(F.col("pages") >= support)
        if not parents.take(1):
            rows = rows.drop("segment")
            break
        kept = counts.join(parents, ["host", "template"]).where((F.col("n") >= support) | (rare & (F.col("kinds") <= spread)))
        rows = rows.join(kept.select(*names, F.col("segment").alias("kept")), names, "left")
        named = F.concat("template", F.array(F.coalesce("kept", F.lit(WILD))))
        rows = written(rows.withColumn("template", named).drop("kept", "segment"), "url-templates")
        level += 1
        done = done.unionByName(rows.where(F.size("segments") <= level))
        rows = rows.where(F.size("segments") > level)
    rest = F.array_repeat(F.lit(WILD), F.size("segments") - level)
    return done.unionByName(rows.withColumn("template", F.concat("template", rest))).drop("segments")


def grouped(bands: Column, overall: Column, prior: float, z: float) -> Column:
    """(band, run) of each of at most BANDS bands (band, n, bad) in order; run numbers its group."""
    kind = "struct<run:int,held:array<struct<share:double,weight:double>>,placed:array<struct<band:bigint,run:int>>>"

    def differs(a: Column, b: Column) -> Column:
        common = (a["share"] * a["weight"] + b["share"] * b["weight"]) / (a["weight"] + b["weight"])
        return F.abs(a["share"] - b["share"]) > z * F.sqrt(common * (1 - common) * (1 / a["weight"] + 1 / b["weight"]))

    def add(so_far: Column, band: Column) -> Column:
        me = F.struct(((band["bad"] + prior * overall) / (band["n"] + prior)).alias("share"), (band["n"] + prior).cast("double").alias("weight"))
        new = F.exists(so_far["held"], lambda other: differs(other, me))
        run = F.when(new, so_far["run"] + 1).otherwise(so_far["run"])
        held = F.when(new, F.array(me)).otherwise(F.concat(so_far["held"], F.array(me)))
        return F.struct(run.alias("run"), held.alias("held"), F.concat(so_far["placed"], F.array(F.struct(band["band"], run.alias("run")))).alias("placed")).cast(kind)

    start = F.struct(F.lit(0).alias("run"), F.array().alias("held"), F.array().alias("placed")).cast(kind)
    return F.aggregate(bands, start, add)["placed"]


def merged(stats: DataFrame, overall: Column, prior: float, z: float) -> DataFrame:
    """host, template, group, n, bad: templates of one shape in a host are one group where their bands do not differ.

    A group of several templates is named by their shape and its place in the order of shares; its n and bad are summed.
    """
    shape = F.transform("template", lambda s: F.lit(WILD))
    share = (F.col("bad") + prior * overall) / (F.col("n") + prior)
    band = F.floor(F.asin(F.sqrt(F.least(share, F.lit(1.0)))) * (2 * BANDS / math.pi)).cast("long")
    rows = written(stats.withColumns({"shape": shape, "band": band}), "url-bands")
    bands = rows.groupBy("host", "shape", "band").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("kinds"))
    lists = bands.groupBy("host", "shape").agg(F.sort_array(F.collect_list(F.struct("band", "n", "bad", "kinds"))).alias("bands"))
    lists = lists.withColumn("placed", F.explode(F.arrays_zip("bands", grouped(F.col("bands"), overall, prior, z).alias("runs"))))
    placed = written(lists.select("host", "shape", "placed.bands.*", "placed.runs.run"), "url-runs")
    runs = placed.groupBy("host", "shape", "run").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("kinds").alias("kinds"))
    known = placed.select("host", "shape", "band", "run").join(runs, ["host", "shape", "run"])
    group = F.when(F.col("kinds") == 1, F.col("template")).otherwise(F.concat("shape", F.array(F.concat(F.lit("~"), F.col("run")))))
    return rows.drop("n", "bad").join(known, ["host", "shape", "band"]).select("host", "template", group.alias("group"), "n", "bad")


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], levels: int | None = None, spread: int = 32, prior: float = 10.0,
               reject: float = 0.5, z: float = 2.0, support: int = 10) -> DataFrame:
    """page_id, host, path, rule, template, group, bad_share, verdict of each page; labels: page_id, bad (0 or 1).

    A page labelled several times counts as bad if one label says so. Repeated pages count one by one. Without labels the
    overall share is 0 and all pages that no rule blocks are allowed.
    """
    marks = labels.where(F.col("page_id").isNotNull() & F.col("bad").isin(0, 1)).groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = generalised(ruled(rows, rules), levels, spread, support)
    known = rows.join(marks, "page_id", "left")
    stats = known.groupBy("host", "template").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    bad, n = known.agg(F.sum("bad"), F.count("bad")).first()
    overall = F.lit(bad / n if n else 0.0)
    groups = merged(stats, overall, prior, z).select(
        "host", "template", "group", ((F.col("bad") + prior * overall) / (F.col("n") + prior)).alias("bad_share"))
    rows = rows.join(groups, ["host", "template"])
    verdict = F.coalesce("ruled", F.when(F.col("bad_share") >= reject, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", F.concat(F.lit("/"), F.concat_ws("/", "template")).alias("template"),
                       F.concat(F.lit("/"), F.concat_ws("/", "group")).alias("group"), "bad_share", verdict.alias("verdict"))
