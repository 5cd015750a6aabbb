"""URL filter: stated host and path rules, and a path-template tree for what they leave.

The tree of each host has the segments of its paths as levels, all of them, to the deepest path found. Digits become `#`; a level whose values under one
parent are many and seldom repeat becomes the wildcard `*`; sibling branches with min_labels labelled pages each, whose allowed shares do not differ from their pooled share
by more than chance, are merged, and branches without that evidence stay apart. A template of a host has one purity: its labelled share of allowed pages, smoothed towards
that of its paths over all hosts, and this towards that of all pages; templates under min_purity are rejected. Labels are the verdicts of the
rules on the pages they fit, and any further labels given.

All of it is DataFrame operations. Pages are aggregated to (host, segments) before the first shuffle, so a hot host or path leaves each input partition as
one row. Level by level, only prefixes that may still become wildcards are followed; they are written, and so are pooled shares, and joined by broadcast
up to a checked number, by a shuffle that adaptive execution can split beyond it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_tables, lower_ascii, quoted, read_table, stored

#: Levels of the tree in OP6_SQL, which is stated for paths of no more segments; the operator has no bound.
LEVELS = 3
#: Templates and prefixes, of some 100 bytes each, are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_TEMPLATES = 200_000
#: host, path, verdict of the registered query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path; both empty without `://`."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def match_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path together, and its verdict; null without one. rules is a stated list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The non-empty segments with digits as #."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, "[0-9]+", "#"))


def _sized(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_TEMPLATES else table


def _generalised(leaves: DataFrame, min_values: int, min_repeats: float) -> tuple[DataFrame, list[str]]:
    """leaves (host, s, and sums) with t, their segments or wildcards; and the paths of the tables they are in.

    A level can only become a wildcard where more than min_values leaves share a prefix, so leaves under any other prefix are done with it.
    """
    done, paths, k = [], [], 0
    rows = leaves.withColumn("t", F.slice("s", 1, 0))
    done.append(rows.filter(F.size("s") == 0))
    rows = rows.filter(F.size("s") > 0)
    while True:
        value = F.get("s", F.lit(k))
        values = rows.groupBy("host", "t", value.alias("v")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("leaves"))
        spread = values.groupBy("host", "t").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("total"), F.sum("leaves").alias("leaves")).filter(F.col("leaves") > min_values)
        varies = (F.col("values") > min_values) & (F.col("total") < min_repeats * F.col("values"))
        spread, spread_path = stored(spread.select("host", "t", varies.alias("varies")), "url-prefixes")
        level = rows.join(_sized(spread), ["host", "t"], "left")
        rest = F.slice("s", F.lit(k + 1), F.size("s"))
        level = level.select(*leaves.columns, F.when(F.col("varies").isNull(), F.concat("t", rest)).otherwise(F.concat("t", F.array(F.when(F.col("varies"), "*").otherwise(value)))).alias("t"))
        level, path = stored(level, "url-level")
        drop_tables(leaves.sparkSession, [spread_path])
        paths.append(path)
        ended = F.size("t") == F.size("s")
        done.append(level.filter(ended))
        rows, k = level.filter(~ended), k + 1
        if rows.isEmpty():
            return reduce(DataFrame.union, done), paths


def _merged(tree: DataFrame, min_labels: int, z: float) -> DataFrame:
    """host, t, m of templates that are merged with others; tree: host, t, lab, good."""
    spark = tree.sparkSession
    known, path = stored(tree.filter(F.col("lab") >= min_labels).select("host", "t", "lab", "good", F.col("t").alias("m")), "url-labelled")
    depth = known.groupBy("host", F.size("t").alias("size")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.max("size")).first()[0] or 0
    for k in range(depth - 1, -1, -1):  # branches that differ in one level and have like shares; "" is no segment
        put = lambda x, k=k: F.concat(F.slice("m", 1, k), F.array(F.lit(x)), F.slice("m", F.lit(k + 2), F.size("m")))
        branch = known.filter(F.size("m") > k).groupBy("host", "m").agg(F.sum("lab").alias("lab"), F.sum("good").alias("good")).withColumn("others", put(""))
        pool = branch.groupBy("host", "others").agg(((F.sum("good") + 1) / (F.sum("lab") + 2)).alias("share"), F.count(F.lit(1)).alias("siblings")).filter("siblings > 1")
        pool, pool_path = stored(pool.select("host", "others", "share"), "url-pools")
        apart = F.abs(F.col("good") / F.col("lab") - F.col("share"))
        alike = branch.join(_sized(pool), ["host", "others"]).filter(apart <= z * F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("lab"))).select("host", "others", "m")
        alike, alike_path = stored(alike, "url-alike")
        several = alike.groupBy("host", "others").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("host", "others")
        joined, joined_path = stored(alike.join(several, ["host", "others"], "left_semi").select("host", "m", F.lit(True).alias("alike")), "url-joined")
        if not joined.isEmpty():
            known, new = stored(known.join(_sized(joined), ["host", "m"], "left").select("host", "t", "lab", "good", F.when(F.col("alike"), put("*")).otherwise(F.col("m")).alias("m")), "url-labelled")
            drop_tables(spark, [path])
            path = new
        drop_tables(spark, [pool_path, alike_path, joined_path])
    return known.select("host", "t", "m").filter("m <> t")


def judge_urls(
    pages: DataFrame, rules=(), labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
    min_values: int = 12, min_repeats: float = 4.0, min_labels: int = 5, z: float = 1.96, weight: float = 8.0, min_purity: float = 0.5,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    verdict is allow or block: the rule's, else the template's; all pages of one host and template have the same purity. labels, if given, has page_id and allowed (0 or 1) and
    joins by id; of several labels of an id the greatest counts. Null urls and urls without :// have an empty host and path and are judged by the template of the empty path.
    Without any label purity is 0.5 and allows. Paths may have any number of segments and any length. Repeated rows each count and get a row; null ids are carried and have no
    label; other columns are ignored, whatever their names. An empty table gives no rows.
    """
    host, path = split_url(quoted(url_col))
    base = pages.select(quoted(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), segments(F.col("path")).alias("s"))
    label = F.when(F.col("ruled") == "allow", 1).when(F.col("ruled") == "block", 0)
    known = base
    if labels is not None:
        known = base.join(labels.groupBy(quoted(id_col).alias("page_id")).agg(F.max("allowed").alias("allowed")), "page_id", "left")
        label = F.coalesce(label, F.col("allowed"))
    spark, sums = pages.sparkSession, (F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum("good").alias("good"))
    leaves, leaves_path = stored(known.groupBy("host", "s").agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("lab"), F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("good")), "url-leaves")
    named, paths = _generalised(leaves, min_values, min_repeats)
    tree, tree_path = stored(named.groupBy("host", "t").agg(*sums), "url-tree")
    merged, merged_path = stored(_merged(tree, min_labels, z), "url-merged")
    tree = tree.join(_sized(merged), ["host", "t"], "left").select("host", "t", F.coalesce("m", "t").alias("m"), "n", "lab", "good")

    total = tree.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("lab"), F.lit(0)).alias("lab")).first()
    overall = (total["good"] + 1) / (total["lab"] + 2)
    across, across_path = stored(tree.groupBy("t").agg(((F.sum("good") + weight / 2 * overall) / (F.sum("lab") + weight / 2)).alias("share")), "url-across")
    # a hot template of very many hosts comes straight from an exchange, if across is too large to broadcast
    judged = tree.join(_sized(across), "t").groupBy("host", "m").agg(F.sum(F.col("n") * F.col("share")).alias("prior"), *sums)
    judged = judged.select("host", "m", ((F.col("good") + weight * F.col("prior") / F.col("n")) / (F.col("lab") + weight)).alias("purity"))
    judged, judged_path = stored(tree.select("host", "t", "m").join(judged, ["host", "m"]).select("host", "t", F.concat(F.lit("/"), F.array_join("m", "/")).alias("template"), "purity"), "url-judged")
    by_leaf, _ = stored(named.select("host", "s", "t").join(_sized(judged), ["host", "t"]).select("host", "s", "template", "purity"), "url-templates")
    drop_tables(spark, [leaves_path, *paths, tree_path, merged_path, across_path, judged_path])
    out = base.join(_sized(by_leaf), ["host", "s"])
    judged_by = F.when(F.col("purity") >= min_purity, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", judged_by).alias("verdict"), "template", F.round("purity", 9).alias("purity"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), RULES)


def _sql() -> str:
    fits = [(h + p, v, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))]
    pick = lambda k: "CASE " + " ".join(f"WHEN {f[2]} THEN '{f[k]}'" for f in fits) + " END"
    ctes = [
        "u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u)",
        "p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)",
        f"base AS (SELECT page_id, host, path, {pick(0)} AS rule, {pick(1)} AS ruled, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '#', 'g')) AS s FROM p)",
        "w AS (SELECT host, s, CAST([] AS VARCHAR[]) AS t, count(*) AS n, count(ruled) AS lab, count(*) FILTER (ruled = 'allow') AS good FROM base GROUP BY host, s)",
    ]
    now = "w"
    for k in range(LEVELS):  # wildcards, from the first segment on
        ctes.append(f"v{k} AS (SELECT host, t, count(*) AS vals, sum(n) AS total FROM (SELECT host, t, s[{k + 1}] AS v, sum(n) AS n FROM {now} WHERE len(s) > {k} GROUP BY ALL) GROUP BY host, t)")
        step = f"list_append(t, CASE WHEN vals > 12 AND total < 4.0 * vals THEN '*' ELSE s[{k + 1}] END)"
        ctes.append(f"w{k} AS (SELECT host, s, CASE WHEN len(s) > {k} THEN {step} ELSE t END AS t, n, lab, good FROM {now} LEFT JOIN v{k} USING (host, t))")
        now = f"w{k}"
    ctes.append(f"tree AS (SELECT host, t, t AS m, sum(n) AS n, sum(lab) AS lab, sum(good) AS good FROM {now} GROUP BY host, t)")
    named, now = now, "tree"
    for k in range(LEVELS - 1, -1, -1):  # merges, from the last segment on, of branches with five labels and more
        put = lambda x, k=k: f"m[1:{k}] || ['{x}'] || m[{k + 2}:]"
        ctes.append(f"b{k} AS (SELECT host, m, {put('')} AS others, sum(lab) AS bl, sum(good) AS bg FROM {now} WHERE len(m) > {k} AND lab >= 5 GROUP BY host, m)")
        ctes.append(f"p{k} AS (SELECT host, others, (sum(bg) + 1.0) / (sum(bl) + 2) AS share FROM b{k} GROUP BY host, others HAVING count(*) > 1)")
        ctes.append(f"a{k} AS (SELECT host, m, count(*) OVER (PARTITION BY host, others) AS c FROM b{k} JOIN p{k} USING (host, others) WHERE abs(bg / CAST(bl AS DOUBLE) - share) <= 1.96 * sqrt(share * (1 - share) / bl))")
        ctes.append(f"t{k} AS (SELECT host, t, CASE WHEN lab >= 5 AND c > 1 THEN {put('*')} ELSE m END AS m, n, lab, good FROM {now} LEFT JOIN a{k} USING (host, m))")
        now = f"t{k}"
    ctes += [
        f"ev AS (SELECT (coalesce(sum(good), 0) + 1.0) / (coalesce(sum(lab), 0) + 2) AS g FROM {now})",
        f"ac AS (SELECT t, (sum(good) + 4.0 * any_value(g)) / (sum(lab) + 4.0) AS c FROM {now}, ev GROUP BY t)",
        f"ow AS (SELECT host, m, (sum(good) + 8.0 * sum(n * c) / sum(n)) / (sum(lab) + 8.0) AS purity FROM {now} JOIN ac USING (t) GROUP BY host, m)",
        f"ju AS (SELECT host, t, '/' || array_to_string(m, '/') AS template, purity FROM {now} JOIN ow USING (host, m))",
        f"le AS (SELECT host, s, template, purity FROM {named} JOIN ju USING (host, t))",
    ]
    return f"WITH {', '.join(ctes)} SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict, template, round(purity, 9) AS purity FROM base JOIN le USING (host, s)"


OP6_SQL = _sql()
