"""URL filters: rules first, then a path-template tree per host.

Pages that a rule decides are the labelled ones. Paths become templates: runs of digits in a
segment turn into `#`, and below each node of the host's tree a segment with few of the node's
pages turns into `*`. From the host down, a branch is merged with its parent unless its share of
blocked labelled pages differs from the merged parent's by more than chance (two-proportion test),
so a branch without labels takes its parent's purity. A branch that stays apart has its own share,
smoothed towards the purity of the merged parent; the host's is smoothed towards a half. A page
without a rule gets the verdict of its template: blocked if that purity exceeds `REJECT`.

DataFrame functions only. Pages are counted per template before anything else, so the tree is
built from templates; pages meet their template in one join on host and template, which adaptive
execution splits if a host is hot. The tree has `DEPTH` levels; all deeper segments of a path are
its last level as one text, so no page is left out.

A null url, or one without `://`, has an empty host and path; it fits no rule and is judged by
that template. Paths of any length are read whole. Rows are judged one by one: ids may be null or
repeated. Only page_id and url are read, so other columns may have any name. An empty table stays
empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, long_id

#: (host, path, verdict). Fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEPTH = 3
#: A segment needs so many pages, and such a share of its node's pages, to stay a branch of its own.
MIN_PAGES = 5
MIN_SHARE = 0.01
#: Squared normal quantile beyond which two shares differ.
Z2 = 3.84
#: Smoothing: so many labelled pages of the parent's purity are added to a branch (half of them blocked, to a host).
PRIOR = 4
REJECT = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as host + path; among equally long ones that of the longer host, then a block."""
    out = None
    for h, p, _ in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, h + p) if out is None else out.when(fits, h + p)
    return out if out is not None else F.lit(None).cast("string")


def _node(level: int) -> list[str]:
    return ["host", *[f"t{k}" for k in range(1, level + 1)]]


def _branches(paths: DataFrame) -> DataFrame:
    """Adds t1..tDEPTH: segments, rare ones as `*`; level by level, as a node's pages depend on the levels above."""
    out = paths
    for level in range(1, DEPTH + 1):
        above, seg = _node(level - 1), f"s{level}"
        counts = out.groupBy(*above, seg).agg(F.sum("n").alias("seg_n"))
        totals = counts.groupBy(*above).agg(F.sum("seg_n").alias("node_n"))
        counts = counts.join(totals, above)
        rare = (F.col("seg_n") < MIN_PAGES) | (F.col("seg_n") < MIN_SHARE * F.col("node_n"))
        names = counts.select(*above, seg, F.when(F.col(seg).isin("", "#"), F.col(seg)).when(rare, "*").otherwise(F.col(seg)).alias(f"t{level}"))
        out = out.join(names, [*above, seg])
    return out


def _differs(n: Column, b: Column, pn: Column, pb: Column) -> Column:
    """Whether two shares of blocked pages differ by more than chance; without labels nothing does."""
    p = (b + pb) / (n + pn)
    diff = b / n - pb / pn
    return F.when((n > 0) & (pn > 0), diff * diff > Z2 * p * (1 - p) * (1 / n + 1 / pn)).otherwise(False)


def templates(pages: DataFrame) -> DataFrame:
    """host, s1.. (segments), t1.. (branches), rejected: one row per host and segments. `pages`: host, s1.., n, labelled, blocked."""
    tree = keep(_branches(pages), "url-tree")  # read once for each level
    stats = tree
    for level in range(DEPTH + 1):
        node = _node(level)
        own = tree.groupBy(*node).agg(F.sum("labelled").cast("double").alias(f"own_n{level}"), F.sum("blocked").cast("double").alias(f"own_b{level}"))
        stats = stats.join(own, node)
    n, b = F.col("own_n0"), F.col("own_b0")
    stats = stats.withColumns({"eff_n0": n, "eff_b0": b, "purity0": (b + PRIOR / 2) / (n + PRIOR)})
    for level in range(1, DEPTH + 1):
        pn, pb, above = F.col(f"eff_n{level - 1}"), F.col(f"eff_b{level - 1}"), F.col(f"purity{level - 1}")
        n, b = F.col(f"own_n{level}"), F.col(f"own_b{level}")
        apart = _differs(n, b, pn, pb)
        pick = lambda own, parent, apart=apart: F.when(apart, own).otherwise(parent)
        stats = stats.withColumns({f"eff_n{level}": pick(n, pn), f"eff_b{level}": pick(b, pb), f"purity{level}": pick((b + PRIOR * above) / (n + PRIOR), above)})
    purity = F.col(f"purity{DEPTH}")
    return stats.select("host", *[f"s{k}" for k in range(1, DEPTH + 1)], *[f"t{k}" for k in range(1, DEPTH + 1)], purity.alias("purity"), (purity > REJECT).alias("rejected"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity; one row per page."""
    host, path = host_path(F.col("url"))
    read = pages.select(long_id("page_id"), host.alias("host"), path.alias("path"))
    read = read.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    blocked = reduce(lambda a, r: a | (F.col("rule") == r[0] + r[1]), [r for r in rules if r[2] == "block"], F.lit(False))
    read = read.withColumn("blocked", F.when(F.col("rule").isNotNull(), blocked))
    parts = F.split(F.regexp_replace(F.substring("path", 2, 1 << 30), "[0-9]+", "#"), "/")
    segments = [F.coalesce(F.get(parts, F.lit(k)), F.lit("")) for k in range(DEPTH - 1)]
    segments.append(F.array_join(F.slice(parts, DEPTH, F.greatest(F.size(parts) - DEPTH + 1, F.lit(0))), "/"))
    read = read.withColumns({f"s{k + 1}": s for k, s in enumerate(segments)})
    keys = ["host", *[f"s{k}" for k in range(1, DEPTH + 1)]]
    counted = read.groupBy(*keys).agg(F.count("*").alias("n"), F.count("rule").alias("labelled"), F.count_if("blocked").alias("blocked"))
    counted = keep(counted, "url-paths")
    verdict = F.when(F.col("blocked").isNotNull(), F.when(F.col("blocked"), "block").otherwise("allow")).when(F.col("rejected"), "block").otherwise("allow")
    template = F.concat_ws("/", F.col("host"), *[f"t{k}" for k in range(1, DEPTH + 1)])
    return read.join(templates(counted), keys).select("page_id", "host", "path", "rule", verdict.alias("verdict"), template.alias("template"), F.round("purity", 6).alias("purity"))


def _oracle() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda r: f"(host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[0]}{r[1]}'" for r in rules) + " END"
    blocks = ", ".join(f"'{r[0]}{r[1]}'" for r in RULES if r[2] == "block")
    levels, source = "", "c"
    for k in range(1, DEPTH + 1):
        above = ", ".join(_node(k - 1))
        levels += f""",
b{k} AS (SELECT *, CASE WHEN s{k} IN ('', '#') THEN s{k} WHEN seg_n < {MIN_PAGES} OR seg_n < {MIN_SHARE} * node_n THEN '*' ELSE s{k} END AS t{k}
       FROM (SELECT * EXCLUDE (seg_n, node_n), sum(n) OVER (PARTITION BY {above}, s{k}) AS seg_n, sum(n) OVER (PARTITION BY {above}) AS node_n FROM (SELECT *, 0 AS seg_n, 0 AS node_n FROM {source})))"""
        source = f"(SELECT * EXCLUDE (seg_n, node_n) FROM b{k})"
    own = ", ".join(f"CAST(sum(labelled) OVER (PARTITION BY {', '.join(_node(k))}) AS DOUBLE) AS own_n{k}, CAST(sum(blocked) OVER (PARTITION BY {', '.join(_node(k))}) AS DOUBLE) AS own_b{k}" for k in range(DEPTH + 1))
    merged = ""
    for k in range(1, DEPTH + 1):
        n, b, pn, pb, above = f"own_n{k}", f"own_b{k}", f"eff_n{k - 1}", f"eff_b{k - 1}", f"purity{k - 1}"
        src = f"(SELECT *, own_n0 AS eff_n0, own_b0 AS eff_b0, (own_b0 + {PRIOR / 2}) / (own_n0 + {PRIOR}) AS purity0 FROM own)" if k == 1 else f"m{k - 1}"
        p, diff = f"(({b} + {pb}) / ({n} + {pn}))", f"({b} / {n} - {pb} / {pn})"
        apart = f"{n} > 0 AND {pn} > 0 AND {diff} * {diff} > {Z2} * {p} * (1 - {p}) * (1 / {n} + 1 / {pn})"
        pick = lambda own, parent, apart=apart: f"CASE WHEN {apart} THEN {own} ELSE {parent} END"
        merged += f""",
m{k} AS (SELECT *, {pick(n, pn)} AS eff_n{k}, {pick(b, pb)} AS eff_b{k}, {pick(f"({b} + {PRIOR} * {above}) / ({n} + {PRIOR})", above)} AS purity{k} FROM {src})"""
    keys = ["host", *[f"s{k}" for k in range(1, DEPTH + 1)]]
    segs = ", ".join(f"coalesce(parts[{k}], '') AS s{k}" for k in range(1, DEPTH)) + f", array_to_string(parts[{DEPTH}:], '/') AS s{DEPTH}"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {rule} AS rule FROM h),
s AS (SELECT *, {segs} FROM (SELECT *, string_split(regexp_replace(substring(path, 2), '[0-9]+', '#', 'g'), '/') AS parts FROM r)),
c AS (SELECT {', '.join(keys)}, count(*) AS n, count(rule) AS labelled, count(*) FILTER (WHERE rule IN ({blocks})) AS blocked FROM s GROUP BY ALL){levels},
own AS (SELECT *, {own} FROM (SELECT * EXCLUDE (seg_n, node_n) FROM b{DEPTH})){merged},
v AS (SELECT {', '.join(keys)}, {', '.join(f't{k}' for k in range(1, DEPTH + 1))}, purity{DEPTH} AS purity FROM m{DEPTH})
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ({blocks}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN purity > {REJECT} THEN 'block' ELSE 'allow' END AS verdict,
       host || '/' || {" || '/' || ".join(f't{k}' for k in range(1, DEPTH + 1))} AS template, round(purity, 6) AS purity
FROM s JOIN v USING ({', '.join(keys)})
"""


ORACLE_SQL = _oracle()
