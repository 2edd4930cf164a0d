"""URL filter: host and path rules, and for what no rule fits a tree of path templates per host.

The tree generalises in two ways. A segment that is a number, a date or a hexadecimal name becomes
its class; and where a node has too many different children they become one wildcard. Of the
children left, siblings with the same kinds of successors and with labels that do not differ
significantly become one branch. A template's label share is smoothed by its parent's, level
by level, and a template that is labelled and bad enough is rejected. Labels are what the rules say.

Everything is DataFrame functions. The tree works on the table of different generalised paths, one
written table a level; windows run over the children of one node, which are ``max_children`` at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import free_name, join_counted
from strandlake.session import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Variable segments: a pattern (an extension after it stays) and the class that takes its place.
CLASSES = (
    (r"^[0-9]+(?=(\.[A-Za-z]{1,5})?$)", "{n}"),
    (r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?(?=(\.[A-Za-z]{1,5})?$)", "{d}"),
    (r"^(?=[a-f-]*[0-9])[0-9a-f-]{8,}(?=(\.[A-Za-z]{1,5})?$)", "{x}"),
)
WILDCARD, TAIL = "*", "**"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and the paths that begin with ``path``."""

    host: str
    path: str
    block: bool

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    @classmethod
    def parse(cls, line: str) -> Rule:
        """``allow com/`` or ``block example.com/en/``."""
        verdict, place = line.split(" ", 1)
        if verdict not in ("allow", "block"):
            raise ValueError(f"neither allow nor block: {line}")
        host, slash, path = place.partition("/")
        return cls(host, slash + path, verdict == "block")


@dataclass(frozen=True)
class TreeSettings:
    """``depth`` levels, deeper segments being one tail; more than ``max_children`` children, or ``few`` of
    which at least the share ``distinct`` of all rows differ, are variable. Siblings merge unless their
    label shares differ by ``z_labels`` standard errors, or a branch's kinds of successors from the
    node's by a chi-square test at ``z_kinds``. A parent weighs ``strength`` labels."""

    depth: int = 4
    max_children: int = 64
    few: int = 8
    distinct: float = 0.5
    z_labels: float = 3.0
    z_kinds: float = 3.3
    strength: float = 4.0
    reject: float = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there to ``?``, ``#`` or the end.

    Both are empty for a null url and one without ``://``.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    bare = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^?#]*", 0)
    host = F.translate(F.regexp_extract(bare, r"^[^/]*", 0), UPPER, LOWER)
    return host, F.regexp_replace(bare, r"^[^/]*", "")


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct<rule, block> of the longest rule that fits, null where none does; of equally long ones that with the longer host."""
    found = F.lit(None).cast("struct<rule: string, block: boolean>")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = (host.eqNullSafe(r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.block).alias("block"))).otherwise(found)
    return found


def segments(path: Column, depth: int) -> Column:
    """The generalised segments of a path, those after the ``depth``-th as one tail."""
    parts = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    kinds = F.transform(F.slice(parts, 1, depth), lambda s: reduce(lambda c, k: F.regexp_replace(c, *k), CLASSES, s))
    return F.when(F.size(parts) > depth, F.concat(kinds, F.array(F.lit(TAIL)))).otherwise(kinds)


def kind_of(segment: Column) -> Column:
    """What stands after a branch: one of a few kinds."""
    bare = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    return F.when(segment.isNull() | (segment == ""), "end").when(bare.isin(*[c for _, c in CLASSES], TAIL), bare).when(bare.rlike("[0-9]"), "mixed").otherwise("word")


def chi_bound(df: Column, z: float) -> Column:
    """The chi-square quantile of ``df`` degrees of freedom at ``z`` (Wilson and Hilferty)."""
    part = F.lit(2) / F.nullif(9 * df, F.lit(0))
    return df * F.pow(1 - part + z * F.sqrt(part), F.lit(3))


def merged(children: DataFrame, s: TreeSettings) -> DataFrame:
    """(node, seg, token, labelled, bad, p) of the children of nodes that have few.

    ``children`` has one row for each node, seg and kind of successor. A branch whose kinds of successors
    differ from those of all its siblings stays by itself. The others are sorted by label share and cut
    where neighbours differ significantly; those without labels join their siblings if these agree.
    """
    node, own, kind = Window.partitionBy("node"), Window.partitionBy("node", "seg"), Window.partitionBy("node", "kind")
    expected = F.col("n_own") * F.col("n_kind") / F.col("n_node")
    profile = (
        children.withColumn("n_own", F.sum("n").over(own))
        .withColumn("n_kind", F.sum("n").over(kind))
        .withColumn("n_node", F.sum("n").over(node))
        .withColumn("df", F.size(F.collect_set("kind").over(node)) - 1)
        .groupBy("node", "seg", "df", "n_own")
        .agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.max("p").alias("p"), (F.sum(F.pow(F.col("n") - expected, F.lit(2)) / expected - expected) + F.col("n_own")).alias("chi"))
    )
    alike = (F.col("df") == 0) | (F.col("chi") <= chi_bound(F.col("df"), s.z_kinds))
    group = F.when(~alike, F.concat(F.lit("alone "), "seg")).when(F.col("labelled") > 0, "labelled").otherwise("unlabelled")
    order = Window.partitionBy("node", "group").orderBy(F.try_divide("bad", "labelled"), "seg")
    share, size = (F.col("bad") + 0.5) / (F.col("labelled") + 1), F.col("labelled") + 1
    error = share * (1 - share) / size
    gap = F.abs(share - F.lag(share).over(order)) > s.z_labels * F.sqrt(error + F.lag(error).over(order))
    ranked = profile.withColumn("group", group).withColumn("gap", F.when((F.col("group") == "labelled") & gap, 1).otherwise(0))
    ranked = ranked.withColumn("cluster", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.when(F.col("group") == "labelled", F.col("cluster"))).over(node)
    joins = (F.col("group") == "unlabelled") & (last == 0)
    ranked = ranked.withColumn("group", F.when(joins, "labelled").otherwise(F.col("group")))
    branch = Window.partitionBy("node", "group", "cluster")
    many = F.count("*").over(branch)
    token = F.when(many > 1, F.concat(F.lit("("), F.min("seg").over(branch), F.lit("|+"), (many - 1).cast("string"), F.lit(")"))).otherwise(F.col("seg"))
    return ranked.select("node", "seg", token.alias("token"), F.sum("labelled").over(branch).alias("labelled"), F.sum("bad").over(branch).alias("bad"), "p")


def grow(shapes: DataFrame, scratch: Scratch, s: TreeSettings) -> DataFrame:
    """(host, segs, template, p, labelled) of every different generalised path.

    ``shapes`` has host, segs, n, labelled and bad (rows that are labelled, and labelled bad).
    """
    sums = [F.sum(c).alias(c) for c in ("labelled", "bad")]
    total = shapes.agg(*sums, F.max(F.size("segs")).alias("deepest")).first()
    prior = (total["bad"] + 0.5) / (total["labelled"] + 1) if total["labelled"] else 0.5

    def smoothed(p: Column) -> Column:
        return (F.col("bad") + s.strength * p) / (F.col("labelled") + s.strength)

    hosts = scratch.cut(shapes.groupBy("host").agg(F.count("*").alias("rows"), *sums))
    known = hosts.select("host", smoothed(F.lit(prior)).alias("p"), F.col("labelled").alias("own"))
    at = scratch.cut(join_counted(shapes, known, "host", F.col("segs"), hosts.select("host", "rows"), "inner").withColumn("template", F.col("host")))
    for level in range(total["deepest"] or 0):
        seg, after = F.get("segs", F.lit(level)), F.get("segs", F.lit(level + 1))
        reached = at.where(F.size("segs") > level).withColumn("node", F.col("template")).withColumn("seg", seg)
        children = scratch.cut(reached.groupBy("node", "seg", kind_of(after).alias("kind")).agg(F.sum("n").alias("n"), *sums, F.max("p").alias("p")))
        # a node's children may have several kinds of successors each: count them once
        once = children.groupBy("node", "seg").agg(F.sum("n").alias("n"), *sums, F.max("p").alias("p"), F.count("*").alias("rows"))
        nodes = once.groupBy("node").agg(F.count("*").alias("children"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), *sums, F.max("p").alias("p"))
        many = (F.col("children") > s.max_children) | ((F.col("children") >= s.few) & (F.col("children") >= s.distinct * F.col("n")))
        nodes = scratch.cut(nodes.withColumn("variable", many))
        flags = nodes.select("node", "variable", smoothed(F.col("p")).alias("p_all"), F.col("labelled").alias("labelled_all"))
        told = join_counted(children, flags, "node", F.col("seg"), nodes.select("node", "rows"), "inner")
        wild = told.where("variable").select("node", "seg", F.lit(WILDCARD).alias("token"), F.col("p_all").alias("p_new"), F.col("labelled_all").alias("own_new")).distinct()
        fixed = merged(told.where("not variable"), s).select("node", "seg", "token", smoothed(F.col("p")).alias("p_new"), F.col("labelled").alias("own_new"))
        tokens = wild.unionByName(fixed).withColumn("child", F.concat_ws("/", "node", "seg")).drop("node", "seg")
        keyed = at.withColumn("child", F.when(F.size("segs") > level, F.concat_ws("/", "template", seg)))
        counts = once.select(F.concat_ws("/", "node", "seg").alias("child"), "rows")
        stepped = join_counted(keyed, tokens, "child", F.col("segs"), counts, "left")
        found = F.col("token").isNotNull()
        at = scratch.cut(
            stepped.select(
                "host", "segs", "n", "labelled", "bad",
                F.when(found, F.col("p_new")).otherwise(F.col("p")).alias("p"),
                F.when(found, F.col("own_new")).otherwise(F.col("own")).alias("own"),
                F.when(found, F.concat_ws("/", "template", "token")).otherwise(F.col("template")).alias("template"),
            )
        )
    return at.select("host", "segs", "n", "template", "p", F.col("own").alias("template_labelled"))


def judge(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", settings: TreeSettings = TreeSettings()) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template, blocked_share and template_labelled; columns of these names give way.

    A rule decides where one fits. Elsewhere the verdict is ``block`` if the url's template holds
    labelled urls, by itself or through the siblings it merged with, and its smoothed share of blocked ones is
    at least ``settings.reject``; else ``allow``. Null urls and those without ``://`` have empty
    host and path, and are judged like any others of that shape. Equal urls get equal results, and every
    row stays a row; with no labelled url, or no row, nothing is rejected. Hot hosts are dealt by path, hot
    paths by their row's hash.
    """
    scratch = Scratch()
    new = ("host", "path", "rule", "verdict", "template", "blocked_share", "template_labelled")
    kept = [c for c in pages.columns if c.lower() not in new]
    held, shape = free_name(pages, "_judged"), free_name(pages, "_shape")
    host, path = host_and_path(F.col(f"`{url_col}`"))
    parts = F.struct(host.alias("host"), path.alias("path"))
    rows = pages.select(*[F.col(f"`{c}`") for c in pages.columns], parts.alias(held))
    ruled = F.struct(F.col(held)["host"].alias("host"), F.col(held)["path"].alias("path"), matching_rule(F.col(held)["host"], F.col(held)["path"], rules).alias("by"), segments(F.col(held)["path"], settings.depth).alias("segs"))
    rows = rows.withColumn(held, ruled).withColumn(shape, F.concat_ws("/", F.col(held)["host"], F.col(held)["segs"]))
    own = F.col(held)
    labelled = own["by"]["block"].isNotNull()
    shapes = scratch.cut(rows.groupBy(own["host"].alias("host"), own["segs"].alias("segs")).agg(F.count("*").alias("n"), F.count_if(labelled).alias("labelled"), F.count_if(labelled & own["by"]["block"]).alias("bad")))
    grown = grow(shapes, scratch, settings).withColumn(shape, F.concat_ws("/", "host", "segs"))
    # two paths of one shape text differ at most in where a host ends, which no host does: hosts hold no slash
    verdicts = grown.select(shape, F.struct("template", F.col("p").alias("blocked_share"), "template_labelled").alias("_tree"))
    spread = F.xxhash64(*[F.col(f"`{c}`") for c, kind in pages.dtypes if "map<" not in kind and "variant" not in kind])
    joined = join_counted(rows, verdicts, shape, spread, grown.select(shape, F.col("n").alias("rows")), "left")
    tree = F.col("_tree")
    rejected = (tree["template_labelled"] > 0) & (tree["blocked_share"] >= settings.reject)
    blocks = F.coalesce(own["by"]["block"], rejected, F.lit(False))
    return joined.select(
        *[F.col(f"`{c}`") for c in kept],
        own["host"].alias("host"), own["path"].alias("path"), own["by"]["rule"].alias("rule"),
        F.when(blocks, "block").otherwise("allow").alias("verdict"),
        tree["template"].alias("template"), tree["blocked_share"].alias("blocked_share"), tree["template_labelled"].alias("template_labelled"),
    )
