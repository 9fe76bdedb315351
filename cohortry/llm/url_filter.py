"""URL filters: rules first, then a path-template tree per host.

The tree holds, for every host, the paths of its URLs segment by segment.  Segments that vary become wildcards:
by their look (digits, long hexadecimal or mixed ids, with any ending), and below one node all words together
where they are too many for the URLs they cover.  Sibling branches with the same shapes below and a similar
share of blocked URLs merge.  A template is rejected if the smoothed share of blocked among its labelled URLs
is high; labels are what the rules say, or a table of page ids with verdicts.  What a template is held to be before
its own labels count comes from its sibling branches, those that differ from it in one segment at any level, each
labelled branch counting once: so a branch without labels is rejected where enough branches like it are.  Only
DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Levels between two tables that are written, so that plans stay small. A node's words become one wildcard if there are more than MANY and fewer than FEW URLs to each.
STEP, MANY, FEW = 8, 20, 3.0
#: A template is rejected if (blocked + prior * SMOOTH) / (labelled + SMOOTH) reaches REJECT, prior being the same of its siblings and PRIOR; branches merge if their blocked shares differ by CLOSE at most.
PRIOR, SMOOTH, REJECT, CLOSE = 0.2, 4.0, 0.7, 0.1


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr("substring(url, instr(url, '://') + 3)"), "/", 1)).otherwise("")
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    whole = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(F.when(F.instr(whole, "/") > 0, F.regexp_extract(whole, r"(?s)^[^/]*(/.*)$", 1)).otherwise(""), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """Segments of a path with those that vary by their look as wildcards."""
    one = lambda s: (
        F.when(s == "", F.lit("/"))
        .when(s.rlike(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$"), F.lit("{n}"))
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit("{d}"))
        .when(s.rlike(r"^[0-9A-Fa-f-]{8,}(\.[A-Za-z0-9]{1,5})?$"), F.lit("{h}"))
        .when(s.rlike(r"[0-9]"), F.lit("{i}"))
        .otherwise(s)
    )
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, one)


def priors(known: DataFrame) -> DataFrame:
    """(host, template, prior) of the templates (host, template, b, l): the smoothed mean of the blocked shares of the labelled
    siblings, at the level with most of them (the deepest of several)."""
    share = F.when(F.col("l") > 0, F.col("b") / F.col("l"))
    each = known.select("host", "template", share.alias("share"), F.explode(F.sequence(F.lit(1), F.greatest(F.size("template"), F.lit(1)))).alias("level"))
    each = each.withColumn("like", F.transform("template", lambda x, k: F.when(k == F.col("level") - 1, F.lit("")).otherwise(x)))
    pool = each.groupBy("host", "level", "like").agg(F.sum("share").alias("votes"), F.count("share").alias("voters")).where("voters > 0")
    own = F.when(F.col("share").isNull(), 0).otherwise(1)
    found = each.join(pool, ["host", "level", "like"], "left").withColumns({"voters": F.coalesce("voters", F.lit(0)) - own, "votes": F.coalesce("votes", F.lit(0.0)) - F.coalesce("share", F.lit(0.0))})
    prior = (F.col("votes") + PRIOR * SMOOTH) / (F.col("voters") + SMOOTH)
    return found.groupBy("host", "template").agg(F.max_by(prior, F.struct("voters", "level")).alias("prior"))


def templates(shapes: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, shape, template, blocked, labelled, prior): the leaves of every host's tree, with the template each belongs to.

    shapes: host, shape, n (URLs), blocked, labelled (of those with a verdict), one row for each host and shape.
    """
    rows = scratch.keep(shapes.withColumn("template", F.array().cast("array<string>")), "shapes")
    depth = rows.agg(F.max(F.size("shape"))).head()[0] or 0
    for level in range(1, depth + 1):
        seg = F.get("shape", F.lit(level - 1))
        nodes = rows.where(seg.isNotNull() & ~seg.startswith("{")).groupBy("host", "template", seg.alias("seg")).agg(F.sum("n").alias("n"))
        wide = nodes.groupBy("host", "template").agg(F.count("*").alias("words"), F.sum("n").alias("urls"))
        wide = wide.where((F.col("words") > MANY) & (F.col("urls") < FEW * F.col("words"))).select("host", "template", F.lit(True).alias("wide"))
        wide = scratch.keep(wide, f"wide-{level}")
        some = not wide.isEmpty()
        one = F.slice("shape", level, 1)  # empty beyond the end
        rows = rows.join(wide, ["host", "template"], "left") if some else rows
        if some:
            one = F.transform(one, lambda x: F.when(F.col("wide") & ~x.startswith("{"), F.lit("{w}")).otherwise(x))
        rows = rows.withColumn("template", F.concat("template", one))
        rows = scratch.keep(rows.drop("wide"), f"level-{level}") if some or level % STEP == 0 else rows
    # similar branches: siblings at the first level with the same templates below and close blocked shares
    below = F.expr("slice(template, 2, greatest(size(template), 1))")
    known = rows.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    rows = rows.join(priors(known), ["host", "template"])
    share = F.round((F.col("b") + PRIOR * SMOOTH) / (F.col("l") + SMOOTH) / CLOSE).cast("int")
    near = known.where((F.size("template") > 1) & (F.col("l") > 0)).select("host", "template", below.alias("below"), share.alias("band"))
    groups = near.groupBy("host", "below", "band").agg(F.count("*").alias("k")).where("k > 1")
    merged = near.join(groups, ["host", "below", "band"]).select("host", "template", F.concat(F.array(F.concat(F.lit("{m"), F.col("band").cast("string"), F.lit("}"))), "below").alias("into"))
    rows = rows.join(merged, ["host", "template"], "left").withColumn("template", F.coalesce("into", "template")).drop("into")
    sums = rows.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), F.min("prior").alias("prior"))
    return rows.select("host", "shape", "template").join(sums, ["host", "template"])


def url_verdicts(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template.

    pages needs page_id and url; labels, if given, has page_id and blocked (boolean) and counts instead of the
    rules' verdicts for the tree.  A null url, or one without ``://``, has an empty host and path.  Repeated
    rows come out as often as they go in; equal labels count once, of contradicting ones blocked wins.
    """
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": rule, "said": verdict, "shape": shape_of(F.col("path"))})
    if labels is None:
        seen = seen.withColumn("blocked", F.col("said") == "block")
    else:
        once = labels.groupBy("page_id").agg(F.max("blocked").alias("blocked"))
        seen = seen.join(once, "page_id", "left")
    shapes = seen.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked"), F.count("blocked").alias("labelled"))
    purity = (F.col("blocked") + F.col("prior") * SMOOTH) / (F.col("labelled") + SMOOTH)
    found = templates(shapes, scratch or Scratch(pages.sparkSession, "url-filter")).select("host", "shape", F.array_join("template", "/").alias("template"), F.when(purity >= REJECT, "block").otherwise("allow").alias("method"))
    out = seen.drop("blocked").join(found, ["host", "shape"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "method").alias("verdict"), "template")
