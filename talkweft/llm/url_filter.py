"""URL filter: fixed rules, and a path-template tree that learns from labelled urls.

A host's tree is built level by level from counts of path prefixes. A segment is generalised to ``*`` by its shape
(digits, hex, long mixed codes). Below a prefix with more than CHILDREN different branches all are ``*``. Else its branches
of MIN_OWN labelled urls are sorted by their bad share, and each joins the group before it while both differ by no more than
chance (two-proportion z under MERGE_Z). Where all of them make one group of several, the segment says nothing: they become
``*``, and so do their siblings without labels, known today or not. Where there are several groups, the members of each are
one branch, ``{a|b|c}``, and branches of few labels stay by themselves. The next level is built below what was merged. What
lies deeper than DEPTH segments is one wildcard.

A url is judged by the deepest node on its way that has MIN_OWN labelled urls of its own. The node is rejected when
the lower bound (LOWER_Z standard errors) of its purity, the labelled bad share smoothed by its host's and that by
all hosts', reaches PURITY. A host's share alone rejects nothing: without such a node a url is allowed, and its
purity is its host's. A url is labelled by the document it shows, whose doc_id is the number that ends its path: bad
is quality 0 or toxic 1. The fixed rules' verdicts are no labels, since they say nothing of the urls that no rule
decides. Urls are pre-aggregated to templates before any shuffle of theirs, so a hot host is a few rows.

Edge cases: a null url or one without ``://`` has an empty host and path, no rule, and is judged by the
template of the empty host; an empty path has depth 0; very long segments of letters are kept whole; ties of rules
go to the longer rule text, then the smaller; repeated rows get equal verdicts; without labels nothing is rejected;
of repeated labels of a document the bad one holds; labels of null ids or without any mark are ignored; an empty
table gives no rows; other columns of the tables are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, written

# (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEPTH = 4  # segments of a template; what lies deeper is one wildcard
CHILDREN = 64  # different children of a prefix, beyond which they are one wildcard
MERGE_Z = 2.0
MIN_OWN = 5  # labelled urls that a node needs, to be merged or to judge
LOWER_Z = 1.645
PRIOR = 8.0  # labelled urls that a prior counts for
PURITY = 0.9


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a url."""
    after = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):  # the last that fits wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _shape(segment: Column) -> Column:
    """A segment, or ``*`` where its shape says that it varies: digits, hex, or 16 and more with a digit."""
    varies = segment.rlike(r"^[0-9]+([._-][0-9]+)*(\.[A-Za-z]{2,5})?$|^(?=.*[0-9])[0-9a-f-]{8,}$|^(?=.*[0-9]).{16,}$")
    return F.when(varies, F.lit("*")).otherwise(segment)


NONE = "\u0001"  # stands for a segment that a path doesn't have
LEVELS = DEPTH + 1
SEGMENTS = [f"s{i}" for i in range(LEVELS)]
NODES = [f"t{i}" for i in range(LEVELS)]


def _levels(path: Column) -> list[Column]:
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", LEVELS)
    own = [F.when((F.size(parts) > i) & (path != ""), _shape(F.get(parts, F.lit(i)))).otherwise(F.lit(NONE)) for i in range(DEPTH)]
    return [*own, F.when(F.size(parts) > DEPTH, F.lit("*")).otherwise(F.lit(NONE))]


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast where its rows of a few short columns are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS // 10 else table


def templates(urls: DataFrame) -> DataFrame:
    """Path templates with counts: host, s0..s4 (as shaped), t0..t4 (generalised), bad, good.

    ``urls`` has host, path and bad (1 bad, 0 good, null unlabelled).
    """
    shaped = urls.select("host", "bad", *[c.alias(s) for c, s in zip(_levels(F.col("path")), SEGMENTS, strict=True)])
    tree = shaped.groupBy("host", *SEGMENTS).agg(F.count_if(F.col("bad") == 1).alias("bad"), F.count_if(F.col("bad") == 0).alias("good"))
    tree = written(tree, "templates")  # and after each level: the next reads it twice
    for i, (s, t) in enumerate(zip(SEGMENTS, NODES, strict=True)):
        prefix = ["host", *NODES[:i]]
        wild, named = _merged(tree, prefix, s)
        tree = tree.join(wild, prefix, "left").join(named, [*prefix, s], "left")
        tree = written(tree.withColumn(t, F.when(F.col("wild") & (F.col(s) != NONE), F.lit("*")).otherwise(F.coalesce("merged", s))).drop("wild", "merged"), "templates")
    return tree


def _chance(b1: Column, n1: Column, b2: Column, n2: Column) -> Column:
    """Whether two shares differ by no more than chance."""
    pooled = (b1 + b2) / (n1 + n2)
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1.0 / n1 + 1.0 / n2))
    return F.abs(b1 / n1 - b2 / n2) / error < MERGE_Z


def _merged(tree: DataFrame, prefix: list[str], s: str) -> tuple[DataFrame, DataFrame]:
    """Prefixes below which all is one wildcard (``wild``), and branches that are one with others (``merged``: their name together)."""
    branches = tree.where(F.col(s) != NONE).groupBy(*prefix, s).agg(F.sum("bad").alias("b"), F.sum(F.col("bad") + F.col("good")).alias("n"))
    kids = branches.groupBy(*prefix).agg(F.count(F.lit(1)).alias("kids"))
    many = kids.where(F.col("kids") > CHILDREN).select(*prefix)
    some = branches.where(F.col("n") >= MIN_OWN).join(kids.where(F.col("kids") <= CHILDREN), prefix)
    listed = some.groupBy(*prefix).agg(F.array_sort(F.collect_list(F.struct((F.col("b") / F.col("n")).alias("share"), F.col(s).alias("name"), "b", "n"))).alias("x"))  # CHILDREN at most
    kind = "array<struct<b:bigint,n:bigint,names:array<string>>>"

    def step(groups: Column, x: Column) -> Column:
        last = F.element_at(groups, -1)
        joined = F.struct((last["b"] + x["b"]).alias("b"), (last["n"] + x["n"]).alias("n"), F.concat(last["names"], F.array(x["name"])).alias("names"))
        alone = F.struct(x["b"].alias("b"), x["n"].alias("n"), F.array(x["name"]).alias("names"))
        alike = (F.size(groups) > 0) & _chance(last["b"], last["n"], x["b"], x["n"])
        return F.when(alike, F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(joined))).otherwise(F.concat(groups, F.array(alone))).cast(kind)

    groups = listed.select(*prefix, F.aggregate("x", F.array().cast(kind), step).alias("groups"))
    one = (F.size("groups") == 1) & (F.size(F.col("groups")[0]["names"]) > 1)
    wild = many.union(groups.where(one).select(*prefix)).withColumn("wild", F.lit(True))
    several = groups.where(F.size("groups") > 1).select(*prefix, F.explode("groups.names").alias("names")).where(F.size("names") > 1)
    name = F.concat(F.lit("{"), F.array_join(F.array_sort("names"), "|"), F.lit("}"))
    return wild, several.select(*prefix, F.explode("names").alias(s), name.alias("merged"))


def judged_templates(urls: DataFrame) -> DataFrame:
    """host, s0..s4, the template they fall under, its purity and whether it is rejected."""
    tree = templates(urls)
    leaves = tree.groupBy("host", *NODES).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    leaves = written(leaves.withColumn("way", F.array(*[F.array_join(F.array(*NODES[: i + 1]), "/") for i in range(LEVELS)])), "leaves")
    ways = leaves.select("host", "bad", "good", F.posexplode("way").alias("depth", "node"))
    nodes = ways.groupBy("host", "depth", "node").agg(F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("good")).alias("n")).where(F.col("n") >= MIN_OWN)
    hosts = leaves.groupBy("host").agg(F.sum("bad").alias("h_bad"), F.sum(F.col("bad") + F.col("good")).alias("h_n"))
    bad_all, n_all = hosts.agg(F.coalesce(F.sum("h_bad"), F.lit(0)), F.coalesce(F.sum("h_n"), F.lit(0))).first()
    everywhere = (bad_all + 0.5) / (n_all + 1)
    best = leaves.select("host", F.col("way")[LEVELS - 1].alias("leaf"), F.posexplode("way").alias("depth", "node")).join(nodes, ["host", "depth", "node"]).groupBy("host", "leaf").agg(F.max_by(F.struct("bad", "n"), "depth").alias("own"))
    full = leaves.select("host", *NODES, F.col("way")[LEVELS - 1].alias("leaf")).join(best, ["host", "leaf"], "left").join(hosts, "host")
    at_host = (F.col("h_bad") + PRIOR * everywhere) / (F.col("h_n") + PRIOR)
    seen = F.coalesce(F.col("own.n"), F.lit(0))
    purity = F.when(seen > 0, (F.col("own.bad") + PRIOR * at_host) / (seen + PRIOR)).otherwise(at_host)
    rejected = (seen > 0) & (purity - LOWER_Z * F.sqrt(purity * (1 - purity) / (seen + PRIOR)) >= PURITY)
    template = F.concat(F.lit("/"), F.array_join(F.filter(F.array(*NODES), lambda t: t != NONE), "/"))
    return tree.join(full.select("host", *NODES, template.alias("template"), purity.alias("purity"), rejected.alias("rejected")), ["host", *NODES]).select("host", *SEGMENTS, "template", "purity", "rejected")


def document_of(path: Column) -> Column:
    """The doc_id that ends a path, before an extension or a slash; null where there is none."""
    return F.regexp_extract(path, r"/([0-9]{1,18})(\.[A-Za-z]{2,5})?/?$", 1).try_cast("long")


def labelled(urls: DataFrame, labels: DataFrame | None) -> DataFrame:
    """host, path and bad (null where nothing is known) of every row of ``urls``."""
    if labels is None:
        return urls.select("host", "path", F.lit(None).cast("int").alias("bad"))
    bad = F.greatest(F.lit(1) - F.col("quality"), F.col("toxic")).cast("int")  # a null mark is passed over
    marks = labels.where("doc_id >= 0").groupBy(F.col("doc_id").alias("document")).agg(F.max(bad).alias("bad")).where("bad IS NOT NULL")
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    key = F.coalesce(document_of(F.col("path")), -1 - F.abs(F.hash("host", "path").cast("long")))  # no key of many rows for those without
    return urls.select("host", "path", key.alias("document")).join(marks, "document", "left").select("host", "path", "bad")


def filter_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row of ``pages``."""
    host, path = split_url()
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.select("*", rule.alias("rule"), said.alias("said"))
    urls = urls.select("*", *[c.alias(s) for c, s in zip(_levels(F.col("path")), SEGMENTS, strict=True)])
    judged = _small(written(judged_templates(labelled(urls, labels)), "judged"))
    method = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return urls.join(judged, ["host", *SEGMENTS], "left").select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
