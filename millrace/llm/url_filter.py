"""URL filters: rules first, then a path-template tree per host.

Rules (host and path prefix; the longest that fits wins) label the URLs that they cover. Paths are
counted per host by their segments' shapes, so that numbers and hashes are one segment at once.
Level by level, from the root down to the deepest path, a node's rare children become a wildcard
(those under RARE of its pages or, among few siblings, under twice their mean), and sibling branches
merge when neither the kinds of segments below them nor their labelled block rates differ. A branch
without labels joins the labelled group that it is like by a stricter bound, unless groups that it
is like differ in their block rates. A template is rejected when its smoothed share of blocked labels
reaches ``purity``; the more of it joined without labels, the stronger the smoothing. A URL without
a rule takes its template's verdict.

Defined cases: a null url, or one without ``://``, has an empty host and path; without any labels
nothing is rejected; repeated rows and null page_ids are judged each by itself; paths of any depth
and length are read whole (a node with one path below it needs no further levels); equal shares of
siblings are settled by name; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, on_workers

FEW_CHILDREN = 20
RARE = 0.02
SMOOTH = 10.0
PURITY = 0.9
FAR = 0.2
NEAR = 0.1
Z = 1.96


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


DEFAULT_RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.when(has, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(rules: tuple[Rule, ...]) -> Column:
    """struct(name, verdict) of the longest rule that fits host and path, else null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        found = F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<name:string,verdict:string>")


def segments(path: Column) -> Column:
    """A shape for each segment: identifiers by kind, digits as <n>."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return F.transform(
        parts,
        lambda s: F.when(s.rlike("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "<uuid>")
        .when(s.rlike("^[0-9a-fA-F]{16,}$"), "<hex>")
        .otherwise(F.regexp_replace(s, "[0-9]+", "<n>")),
    )


def _kind(seg: Column) -> Column:
    """A segment's kind, one of few: what branches are compared by."""
    return (
        F.when(seg.isNull(), "end").when(seg.rlike(r"^<n>$"), "number").when(seg.rlike(r"^<n>\.[A-Za-z]+$"), "number file")
        .when(seg.rlike("^<"), "code").when(seg.contains("<n>"), "word and number").when(seg.rlike(r"\.[A-Za-z]+$"), "file").otherwise("word")
    )


def _far(a: dict, b: dict) -> float:
    """Total variation of the kinds below."""
    na, nb = sum(a["kinds"].values()), sum(b["kinds"].values())
    return sum(abs(a["kinds"].get(k, 0) / na - b["kinds"].get(k, 0) / nb) for k in {*a["kinds"], *b["kinds"]}) / 2


def _alike(a: dict, b: dict) -> bool:
    """Labelled block rates that a two-proportion test doesn't tell apart."""
    pa, pb = a["blocked"] / a["labelled"], b["blocked"] / b["labelled"]
    p = (a["blocked"] + b["blocked"]) / (a["labelled"] + b["labelled"])
    spread = math.sqrt(p * (1 - p) * (1 / a["labelled"] + 1 / b["labelled"]))
    return abs(pa - pb) <= Z * spread or pa == pb


def _merge_siblings(g: pd.DataFrame) -> pd.DataFrame:
    """One node's children: at most 1 / RARE of them are left after the wildcard."""
    branches: dict[str, dict] = {}
    for child, kind, n, labelled, blocked in zip(g["child"], g["kind"], g["n"], g["labelled"], g["blocked"], strict=True):
        b = branches.setdefault(child, {"kinds": {}, "labelled": 0, "blocked": 0})
        b["kinds"][kind] = b["kinds"].get(kind, 0) + n
        b["labelled"] += labelled
        b["blocked"] += blocked
    groups: list[tuple[list[str], dict]] = []
    bare = [c for c in sorted(branches) if not branches[c]["labelled"]]
    for child in sorted({*branches} - {*bare}):
        for names, whole in groups:
            if _far(whole, branches[child]) <= FAR and _alike(whole, branches[child]):
                names.append(child)
                for k, n in branches[child]["kinds"].items():
                    whole["kinds"][k] = whole["kinds"].get(k, 0) + n
                whole["labelled"] += branches[child]["labelled"]
                whole["blocked"] += branches[child]["blocked"]
                break
        else:
            groups.append(([child], {"kinds": dict(branches[child]["kinds"]), "labelled": branches[child]["labelled"], "blocked": branches[child]["blocked"]}))
    joined = [(names, [], whole) for names, whole in groups]
    for child in bare:
        near = sorted((far, i) for i, (_, _, whole) in enumerate(joined) if whole["labelled"] and (far := _far(whole, branches[child])) <= NEAR)
        if near and all(_alike(joined[i][2], joined[k][2]) for _, i in near for _, k in near):
            joined[near[0][1]][1].append(child)
        else:
            joined.append(([child], [], branches[child]))
    rows = []
    for names, guests, _ in joined:
        every = sorted(names + guests)
        rows += [(c, every[0] if len(every) == 1 else "{" + "|".join(every) + "}", c in guests) for c in every]
    return pd.DataFrame({"host": g["host"].iloc[0], "template": g["template"].iloc[0], "child": [r[0] for r in rows], "branch": [r[1] for r in rows], "joins": [r[2] for r in rows]})


def templates(labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, segs, template, guest, n, labelled, blocked) of counted paths (host, segs, n, labelled,
    blocked); guests have joined a labelled group without labels of their own."""
    columns = ["host", "segs", "n", "labelled", "blocked", "template", "guest"]
    nodes = scratch.save(labelled.withColumn("template", F.lit("")).withColumn("guest", F.lit(False)), "paths")
    settled, d = [], 0
    while True:
        # a node with a single path is a chain: its template is what is left of the path
        paths = nodes.groupBy("host", "template").agg(F.count(F.lit(1)).alias("paths"))
        rest = F.array_join(F.slice("segs", d + 1, F.greatest(F.size("segs") - d, F.lit(0))), "/")
        here = scratch.save(nodes.join(paths, ["host", "template"]).withColumn("done", (F.col("paths") == 1) | (F.size("segs") <= d)).drop("paths"), f"nodes{d}")
        whole = F.when(F.size("segs") > d, F.concat("template", F.lit("/"), rest)).otherwise(F.col("template"))
        settled.append(here.where("done").withColumn("template", whole).select(columns))
        scratch.drop(nodes)
        inner = here.where("NOT done")
        if inner.isEmpty():
            break
        inner = inner.withColumn("seg", F.get("segs", F.lit(d)))
        children = inner.groupBy("host", "template", "seg").agg(F.sum("n").alias("c"))
        # a node's children are counted first; a wildcard takes the rare ones
        parents = children.groupBy("host", "template").agg(F.sum("c").alias("all"), F.count(F.lit(1)).alias("kids"))
        rare = (F.col("kids") > FEW_CHILDREN) & (F.col("c") < F.col("all") * F.greatest(F.lit(RARE), 2 / F.col("kids")))
        names = children.join(parents, ["host", "template"]).select("host", "template", "seg", F.when(rare, "*").otherwise(F.col("seg")).alias("child"))
        inner = inner.join(names, ["host", "template", "seg"])
        below = inner.groupBy("host", "template", "child", _kind(F.get("segs", F.lit(d + 1))).alias("kind")).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
        merged = below.groupBy("host", "template").applyInPandas(_merge_siblings, "host string, template string, child string, branch string, joins boolean")
        inner = inner.join(merged, ["host", "template", "child"]).withColumn("template", F.concat("template", F.lit("/"), "branch")).withColumn("guest", F.col("guest") | F.col("joins"))
        nodes = scratch.save(inner.select(columns), f"level{d}")
        d += 1
    return reduce(DataFrame.unionByName, settled)


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, purity: float = PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict, template, blocked_share for every page."""
    spark = pages.sparkSession
    on_workers(spark)
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path")).withColumn("r", rule_of(rules)).withColumn("segs", segments(F.col("path")))
    counted = seen.groupBy("host", "segs").agg(
        F.count(F.lit(1)).alias("n"), F.count("r").alias("labelled"), F.count(F.when(F.col("r.verdict") == "block", 1)).alias("blocked")
    )
    leaves = templates(counted, scratch)
    base = leaves.agg((F.coalesce(F.sum("blocked"), F.lit(0)) / F.greatest(F.coalesce(F.sum("labelled"), F.lit(0)), F.lit(1))).alias("p")).first()["p"]
    stats = leaves.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.sum(F.when(F.col("guest"), F.col("n")).otherwise(0)).alias("guests"))
    smooth = SMOOTH * (1 + F.col("guests") / F.greatest("l", F.lit(1)))
    share = (F.col("b") + smooth * F.lit(min(base, 0.5))) / (F.col("l") + smooth)
    judged = leaves.select("host", "segs", "template").join(stats.select("host", "template", share.alias("blocked_share")), ["host", "template"])
    by_template = F.when(F.col("blocked_share") >= purity, "block").otherwise("allow")
    return seen.join(judged, ["host", "segs"], "left").select(
        "page_id", "host", "path", F.col("r.name").alias("rule"), F.coalesce("r.verdict", by_template).alias("verdict"), "template", "blocked_share"
    )
