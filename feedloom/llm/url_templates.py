"""URL filter: a tree of path templates per host, judged by smoothed labelled purity.

A url that a rule fits takes the longest fitting rule's verdict, and is the
labelled evidence for the others.  Paths are read segment by segment.  At each
node of a host's tree the next segments are generalised:

* a segment with a digit is variable: ``*``;
* a word without labelled urls has nothing that tells it from other such words:
  all of them are ``-``, a branch of their own that labelled urls never join;
* a word whose labelled urls are blocked at a rate that differs from the other
  labelled words' of the node, or that is the only labelled one, is named;
* the other labelled words are statistically alike and merge into ``+``.

Rates differ when the two-proportion z, each side with one url more of either
label (so that small counts decide nothing), reaches Z.  The tests look at
numbers of labelled urls alone, so no section of a host moves the verdict of
another.  A node is gone into as long as its urls' remaining paths differ; where
they are all the same, no deeper test is left and the template ends with them.
A template is rejected when (blocked + WEIGHT x PRIOR) / (labelled + WEIGHT)
reaches REJECT.

Only DataFrame functions; rows stay thin (no html is read) and every count is
pre-aggregated, so a hot host costs no more than its rows.  There are as many
rounds as segments until the last two paths of a node part.

Defined cases: a null url or one without ``://`` has empty host and path, and
the root template of the empty host; empty segments are skipped; repeated urls
count as often as they occur; without any rule fitting, every verdict is allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import broadcast_if_small, table

#: Fixed values: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
Z = 1.96
WEIGHT, PRIOR, REJECT = 5.0, 0.5, 0.8

_NODE = ["host", "tmpl"]


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path) of each url."""
    rest = f"IF(instr({url_col}, '://') > 0, substr({url_col}, instr({url_col}, '://') + 3), '')"
    return pages.select(F.col(id_col).alias("id"), F.expr(f"coalesce({rest}, '')").alias("rest")).select(
        "id", F.expr("translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                     "'abcdefghijklmnopqrstuvwxyz')").alias("host"),
        F.expr("regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)").alias("path"))


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """urls with the longest rule that fits (null: none) and its verdict; the rules are a short parameter."""
    fit = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked last and so wins
        ok = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        fit, verdict = F.when(ok, F.lit(host + path)).otherwise(fit), F.when(ok, F.lit(v)).otherwise(verdict)
    return urls.withColumn("rule", fit).withColumn("ruled", verdict)


def _kind(seg: str, labelled: str, named: str) -> str:
    return f"CASE WHEN {seg} RLIKE '[0-9]' THEN '*' WHEN NOT {labelled} THEN '-' WHEN {named} THEN {seg} ELSE '+' END"


def with_templates(urls: DataFrame) -> DataFrame:
    """urls (host, path, ruled) with ``tmpl``, the path's template in its host's tree."""
    keep = urls.columns
    rows = table(urls.withColumn("segs", F.expr("filter(split(path, '/'), x -> x <> '')")).withColumn("tmpl", F.lit(""))
                 .withColumn("d", F.lit(0)))
    done = rows.where("size(segs) = 0").select(*keep, "tmpl")
    open_ = rows.where("size(segs) > 0")
    while True:
        # what is left of the paths of a node: one and the same, or not
        open_ = open_.withColumn("rest", F.expr("xxhash64(slice(segs, d + 1, size(segs)))"))
        nodes = table(open_.groupBy(*_NODE).agg(F.expr("min(rest) = max(rest)").alias("alike"),
                                                F.expr("count(ruled) > 0").alias("labelled")))
        at = open_.join(broadcast_if_small(nodes), _NODE)
        tail = f"transform(slice(segs, d + 1, size(segs)), x -> {_kind('x', 'labelled', 'true')})"
        done = done.unionByName(at.where("alike").select(*keep, F.expr(f"concat(tmpl, '/', array_join({tail}, '/'))").alias("tmpl")))
        if nodes.where("NOT alike").isEmpty():
            return done
        step = at.where("NOT alike").drop("alike", "labelled", "rest").withColumn("seg", F.expr("segs[d]"))
        word = table(step.where("NOT seg RLIKE '[0-9]'").groupBy(*_NODE, "seg").agg(
            F.count_if(F.col("ruled") == "block").alias("b"), F.count("ruled").alias("m")).where("m > 0"))
        node = word.groupBy(*_NODE).agg(F.sum("b").alias("bb"), F.sum("m").alias("mm"))
        p, q = "(b + 1) / (m + 2)", "(bb - b + 1) / (mm - m + 2)"
        z = f"abs({p} - {q}) / sqrt({p} * (1 - {p}) / (m + 2) + {q} * (1 - {q}) / (mm - m + 2))"
        word = table(word.join(broadcast_if_small(table(node)), _NODE).select(
            *_NODE, "seg", F.expr(f"m = mm OR {z} >= {Z}D").alias("named")))
        rows = table(step.join(broadcast_if_small(word), [*_NODE, "seg"], "left").withColumn("tmpl", F.expr(
            f"concat(tmpl, '/', {_kind('seg', '(named IS NOT NULL)', 'named')})")).withColumn("d", F.col("d") + 1)
            .drop("seg", "named"))
        done = done.unionByName(rows.where("size(segs) = d").select(*keep, "tmpl"))
        open_ = rows.where("size(segs) > d")


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, template, n_block, n_labelled, purity) per row."""
    rows = table(with_templates(ruled(parsed(pages, id_col, url_col), rules)))
    stats = rows.groupBy(*_NODE).agg(F.count_if(F.col("ruled") == "block").alias("n_block"),
                                     F.count("ruled").alias("n_labelled"))
    stats = table(stats.withColumn("purity", F.expr(f"(n_block + {WEIGHT}D * {PRIOR}D) / (n_labelled + {WEIGHT}D)")))
    return rows.join(broadcast_if_small(stats), _NODE).select(
        "id", "host", "path", "rule",
        F.expr(f"coalesce(ruled, IF(purity >= {REJECT}D, 'block', 'allow'))").alias("verdict"),
        F.col("tmpl").alias("template"), "n_block", "n_labelled", "purity")


def query(pages: DataFrame) -> DataFrame:
    return judged(pages).withColumnRenamed("id", "page_id")


def _sql() -> str:
    """DuckDB form: every row goes down to the end of its path, its node counted by windows."""
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    when = [f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%' THEN " + "{" + str(k) + "}"
            for k, (v, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1] + r[1][2]))]
    rule = " ".join(when).format(*[f"'{h}{p}'" for _, h, p in RULES])
    verdict = " ".join(when).format(*[f"'{v}'" for v, _, _ in RULES])
    return f"""
WITH RECURSIVE r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), {az}) AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
l AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS ruled,
    list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM q),
t AS (
  SELECT n, host, ruled, segs, 0 AS d, '' AS tmpl FROM l
  UNION ALL
  SELECT n, host, ruled, segs, d + 1, tmpl || '/' || CASE WHEN digit THEN '*' WHEN m = 0 THEN '-' WHEN m = mm THEN seg
      WHEN abs((b + 1) / (m + 2) - (bb - b + 1) / (mm - m + 2)) >= {Z} * sqrt(
        (b + 1) / (m + 2) * (1 - (b + 1) / (m + 2)) / (m + 2)
        + (bb - b + 1) / (mm - m + 2) * (1 - (bb - b + 1) / (mm - m + 2)) / (mm - m + 2)) THEN seg
      ELSE '+' END
  FROM (SELECT *, sum(CASE WHEN digit OR ruled IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY host, tmpl, seg) AS m,
      sum(CASE WHEN NOT digit AND ruled = 'block' THEN 1 ELSE 0 END) OVER (PARTITION BY host, tmpl, seg) AS b,
      sum(CASE WHEN digit OR ruled IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY host, tmpl) AS mm,
      sum(CASE WHEN NOT digit AND ruled = 'block' THEN 1 ELSE 0 END) OVER (PARTITION BY host, tmpl) AS bb
    FROM (SELECT *, segs[d + 1] AS seg, regexp_matches(segs[d + 1], '[0-9]') AS digit FROM t WHERE len(segs) > d) s) c),
f AS (SELECT n, tmpl AS template FROM t WHERE len(segs) = d),
u AS (SELECT host, template, count(*) FILTER (WHERE ruled = 'block') AS n_block, count(ruled) AS n_labelled
  FROM l JOIN f USING (n) GROUP BY host, template),
p AS (SELECT *, (n_block + {WEIGHT}::DOUBLE * {PRIOR}::DOUBLE) / (n_labelled + {WEIGHT}::DOUBLE) AS purity FROM u)
SELECT l.page_id, l.host, l.path, l.rule, coalesce(l.ruled, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
  f.template, n_block, n_labelled, purity
FROM l JOIN f USING (n) JOIN p ON p.host = l.host AND p.template = f.template
"""


SQL = _sql()
