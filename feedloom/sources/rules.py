"""Site rules.

Rules are a dimension table: one row per site, typed columns, list values
as ARRAY<STRING>.  They can be built from rows, or read from ``*.conf``
INI-style text files with Spark (sections, DEFAULT section, continuation
lines), and are attached to entries with a left join whose broadcast side
is size-checked.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.common import empty_str_array

LIST_KEYS = (
    "page_start", "page_end", "single_page_pats", "url_substitute", "skip_pats",
    "skip_nodes", "skip_link_pats", "skip_title_pats", "skip_content_pats",
    "index_skip_content_pats", "alt_domains", "story_url_rewrite", "order",
)
BOOL_KEYS = (
    "simplify_rss", "nocache", "allow_repeats", "skip_images", "nonlocal_images",
    "block_nonlocal_images", "png_to_jpg", "skip_links", "continue_on_timeout",
    "ascii", "allow_dup_titles",
)
INT_KEYS = ("rss_entry_size", "save_days", "max_image_size", "max_srcset_size", "min_width")
DOUBLE_KEYS = ("levels",)
STRING_KEYS = ("url", "encoding", "multipage_pat", "html_index_links", "when",
               "page_helper", "feed_helper", "helper_arg")

# Built-in rule defaults (used when neither the site nor the
# DEFAULT section sets a key).
BUILTIN_DEFAULTS = {
    "url": "", "levels": "2", "encoding": "", "page_start": "", "page_end": "",
    "single_page_pats": "", "url_substitute": "", "simplify_rss": "false",
    "rss_entry_size": "0", "skip_pats": "", "skip_nodes": "", "skip_link_pats": "",
    "skip_title_pats": "", "skip_content_pats": "", "index_skip_content_pats": "",
    "alt_domains": "", "story_url_rewrite": "", "html_index_links": "",
    "page_helper": "", "helper_arg": "", "nocache": "false", "allow_repeats": "false",
    "save_days": "7", "skip_images": "true", "nonlocal_images": "false",
    "block_nonlocal_images": "true", "max_image_size": "1200", "png_to_jpg": "true",
    "skip_links": "false", "when": "", "min_width": "25", "continue_on_timeout": "false",
    "ascii": "false", "allow_dup_titles": "false",
}
SRCSET_FALLBACK = 800


def rule_schema(key: str = "feed") -> T.StructType:
    fields = [T.StructField(key, T.StringType())]
    for k in STRING_KEYS:
        fields.append(T.StructField(k, T.StringType()))
    for k in DOUBLE_KEYS:
        fields.append(T.StructField(k, T.DoubleType()))
    for k in INT_KEYS:
        fields.append(T.StructField(k, T.IntegerType()))
    for k in BOOL_KEYS:
        fields.append(T.StructField(k, T.BooleanType()))
    for k in LIST_KEYS:
        fields.append(T.StructField(k, T.ArrayType(T.StringType())))
    return T.StructType(fields)


def _typed(key: str, text):
    """Typed column for one rule key from its text value."""
    if key in LIST_KEYS:
        items = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(s))
        return F.filter(items, lambda s: s != "")
    if key in BOOL_KEYS:
        return F.lower(F.trim(text)).isin("1", "yes", "true", "on")
    if key in INT_KEYS:
        return F.trim(text).try_cast("int")
    if key in DOUBLE_KEYS:
        return F.trim(text).try_cast("double")
    return text


def builtin_value(key: str):
    """Typed literal of the built-in default of a key."""
    if key == "max_srcset_size":
        return F.lit(SRCSET_FALLBACK)
    if key in LIST_KEYS:
        return empty_str_array()
    raw = BUILTIN_DEFAULTS.get(key)
    if raw is None:
        return F.lit(None).cast(rule_schema()[key].dataType)
    return _typed(key, F.lit(raw))


def python_default(key: str):
    """Built-in default of a key as a Python value (for rules given as rows)."""
    if key == "max_srcset_size":
        return SRCSET_FALLBACK
    if key in LIST_KEYS:
        return []
    raw = BUILTIN_DEFAULTS.get(key)
    if raw is None:
        return None
    if key in BOOL_KEYS:
        return raw.lower() in ("1", "yes", "true", "on")
    if key in INT_KEYS:
        return int(raw)
    if key in DOUBLE_KEYS:
        return float(raw)
    return raw


def rules_from_rows(spark: SparkSession, rows: list[dict], key: str = "feed") -> DataFrame:
    """Rules table from Python dicts; missing keys take the built-in default.

    The row count is recorded on the DataFrame (``known_rows``), so a later
    broadcast needs no counting job: its size bound is known by construction.
    """
    schema = rule_schema(key)
    data = [tuple(r.get(f.name) if r.get(f.name) is not None else python_default(f.name)
                  for f in schema.fields) for r in rows]
    df = spark.createDataFrame(data, schema)
    df.known_rows = len(rows)
    return df


def select_rules(rules: DataFrame, *cols: str) -> DataFrame:
    """Column subset of a rules table that keeps its known row count."""
    out = rules.select(*cols)
    if getattr(rules, "known_rows", None) is not None:
        out.known_rows = rules.known_rows
    return out


def with_rule_defaults(df: DataFrame, key: str = "feed") -> DataFrame:
    """Fill unset rule columns with built-in defaults (the fallback chain's last step)."""
    cols = [F.col(key)]
    for f in rule_schema(key).fields[1:]:
        if f.name in df.columns:
            cols.append(F.coalesce(F.col(f.name), builtin_value(f.name)).alias(f.name))
        else:
            cols.append(builtin_value(f.name).alias(f.name))
    return df.select(*cols)


def read_conf_rules(spark: SparkSession, path: str, key: str = "feed", main: str | None = None) -> DataFrame:
    """Read INI-style ``*.conf`` files into the rules table.

    Section names become ``feed``; DEFAULT applies under every section; keys
    are lower-cased; indented lines continue the previous value (multi-line
    value = list).  Comment lines start with '#' or ';'.

    The main file is read first and the others after it, by name; a later
    definition of a key wins, so a site's file overrides the main file.  The
    main file is the one named ``main``, or those that hold a DEFAULT section.
    """
    raw = (spark.read.text(path, wholetext=True)
           .select(F.input_file_name().alias("file"), F.col("value")))
    lines = raw.select("file", F.posexplode(F.split("value", "\n")).alias("ln", "line"))
    w = Window.partitionBy("file").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    header = F.regexp_extract("line", r"^\[([^\]]+)\]\s*$", 1)
    kv_key = F.regexp_extract("line", r"^([A-Za-z0-9_.\-]+)\s*[=:]", 1)
    kv_val = F.regexp_extract("line", r"^[A-Za-z0-9_.\-]+\s*[=:]\s?(.*)$", 1)
    is_cont = F.col("line").rlike(r"^[ \t]+\S")
    is_comment = F.col("line").rlike(r"^\s*[#;]")
    tagged = (lines
              .withColumn("section", F.last(F.when(header != "", header), ignorenulls=True).over(w))
              .withColumn("k", F.when(~is_cont & ~is_comment & (kv_key != ""), F.lower(kv_key)))
              .withColumn("cur_key", F.last("k", ignorenulls=True).over(w))
              .withColumn("k_start", F.last(F.when(F.col("k").isNotNull(), F.col("ln")),
                                            ignorenulls=True).over(w))
              .withColumn("part", F.when(F.col("k").isNotNull(), F.trim(kv_val))
                          .when(is_cont & ~is_comment, F.trim("line")))
              .filter(F.col("part").isNotNull() & F.col("section").isNotNull()
                      & F.col("cur_key").isNotNull()))
    is_main = (F.substring_index("file", "/", -1) == main if main
               else F.max(F.col("section") == "DEFAULT").over(Window.partitionBy("file")))
    tagged = tagged.withColumn("rank", F.when(is_main, 0).otherwise(1))
    values = (tagged.groupBy("rank", "file", "section", "cur_key", "k_start")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "part"))),
                                            lambda s: s["part"]), "\n").alias("v"))
              .groupBy("section", "cur_key")
              # a later definition of the same key wins
              .agg(F.max_by("v", F.struct("rank", "file", "k_start")).alias("v")))
    keys = [f.name for f in rule_schema(key).fields[1:]]
    wide = values.groupBy("section").agg(
        *[F.max(F.when(F.col("cur_key") == k, F.col("v"))).alias(k) for k in keys])
    # every site section falls back to the DEFAULT section, key by key
    sites = wide.filter(F.col("section") != "DEFAULT").withColumn("fallback", F.lit("DEFAULT"))
    dflt = wide.filter(F.col("section") == "DEFAULT").select(
        F.col("section").alias("fallback"), *[F.col(k).alias(f"d_{k}") for k in keys])
    merged = sites.join(dflt, "fallback", "left")
    typed = merged.select(F.col("section").alias(key),
                          *[_typed(k, F.coalesce(F.col(k), F.col(f"d_{k}"))).alias(k) for k in keys])
    return with_rule_defaults(typed, key)


def checked_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint only after proving the side has at most ``max_rows`` rows.

    Beyond the bound the plain DataFrame is returned and the join shuffles
    (AQE may still switch to a broadcast at run time from real sizes).
    """
    n = getattr(df, "known_rows", None)
    if n is None:
        n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def attach_rules(entries: DataFrame, rules: DataFrame, on="feed", max_rules: int = 100_000) -> DataFrame:
    """Every entry gets its site's rules; sites without a row get defaults.

    Only the rule columns present in ``rules`` are attached (select the ones
    a step needs, so the join carries narrow rows).
    """
    on_cols = [on] if isinstance(on, str) else list(on)
    rule_cols = [c for c in rules.columns if c not in on_cols]
    clash = [c for c in rule_cols if c in entries.columns]
    if clash:
        raise ValueError(f"entries already have rule columns {clash}")
    joined = entries.join(checked_broadcast(rules, max_rules), on_cols, "left")
    known = {f.name for f in rule_schema().fields[1:]}
    return joined.selectExpr(
        *[f"`{c}`" for c in joined.columns if c not in rule_cols],
        *[f"coalesce(`{c}`, {default_sql(c)}) AS `{c}`" if c in known else f"`{c}`" for c in rule_cols])


def default_sql(key: str) -> str:
    """The built-in default of a rule key as a SQL literal."""
    v = python_default(key)
    if key in LIST_KEYS:
        return "CAST(array() AS ARRAY<STRING>)"
    if v is None:
        return f"CAST(NULL AS {rule_schema()[key].dataType.simpleString()})"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"CAST({v} AS INT)"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


# Rule keys holding regular expressions (Python dialect in the rule files).
PATTERN_LIST_KEYS = ("page_start", "page_end", "single_page_pats", "skip_pats", "skip_link_pats",
                     "skip_title_pats", "skip_content_pats", "index_skip_content_pats")


PATTERN_KEYS = ("multipage_pat",)
PATTERN_PAIR_KEYS = ("story_url_rewrite", "url_substitute")
SPEC_LIST_KEYS = ("skip_nodes",)
REJECT_DDL = "feed string, item_id string, stage string, severity string, reason string"


def _spec_errors(spec: str) -> list[str]:
    """What is wrong with the value patterns of a node spec (nothing, when it has none)."""
    from feedloom.functions.regex import pattern_error
    from feedloom.functions.tree import parse_spec
    parsed = parse_spec(spec)
    return [e for _, v in (parsed[1] if parsed else []) if (e := pattern_error(v))]


def _check_patterns(pats):
    """(valid patterns in Java spelling, problems) for one list of rule patterns."""
    from feedloom.functions.regex import pattern_error, python_pattern_to_java
    ok, bad = [], []
    for p in list(pats) if pats is not None else []:
        err = pattern_error(p)
        if err is None:
            ok.append(python_pattern_to_java(p))
        else:
            bad.append(f"{p}: {err}")
    return ok, bad


def prepare_rules(rules: DataFrame, key: str = "feed") -> tuple[DataFrame, DataFrame]:
    """Validate and translate rule patterns once, when the rules are loaded.

    Patterns that do not compile are dropped from their list and reported
    as rejects (the job never fails on a bad rule); valid ones are put in
    Java spelling (named groups, end anchors); the ``story_url_rewrite``
    replacement is translated ('\\1' -> '$1', literal '$' escaped).  Runs as
    one Arrow-batched pass over the (small) rules table.
    """
    from feedloom.functions.regex import python_replacement_to_java

    lists = [k for k in PATTERN_LIST_KEYS if k in rules.columns]
    one = [k for k in PATTERN_KEYS if k in rules.columns]
    specs = [k for k in SPEC_LIST_KEYS if k in rules.columns]
    pairs = [k for k in PATTERN_PAIR_KEYS if k in rules.columns]
    keys = [*lists, *one, *specs, *pairs]
    out_t = T.StructType([T.StructField(k, T.StringType() if k in one else T.ArrayType(T.StringType())) for k in keys]
                         + [T.StructField("_problems", T.ArrayType(T.StringType()))])

    @F.pandas_udf(out_t)
    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for vals in zip(*[pdf[k] for k in keys]):
            rec, problems = {}, []
            for k, v in zip(keys, vals):
                given = ([v] if v else []) if k in one else list(v) if v is not None else []
                if k in pairs and len(given) != 2:
                    rec[k], bad = [], [f"needs 2 lines, has {len(given)}"] if given else []
                elif k in pairs:
                    ok, bad = _check_patterns(given[:1])
                    rec[k] = ok + [python_replacement_to_java(given[1])] if ok else []
                elif k in specs:
                    # a node spec keeps its spelling; only specs whose pattern is sound stay
                    bad = [f"{s}: {e}" for s in given for e in _spec_errors(s)]
                    rec[k] = [s for s in given if not _spec_errors(s)]
                else:
                    ok, bad = _check_patterns(given)
                    rec[k] = (ok[0] if ok else None) if k in one else ok
                problems += [f"{k}: {b}" for b in bad]
            rec["_problems"] = problems
            rows.append(rec)
        return pd.DataFrame(rows, columns=[f.name for f in out_t.fields])

    if not keys:
        return rules, rules.sparkSession.createDataFrame([], REJECT_DDL)
    checked = rules.withColumn("_chk", check(F.struct(*[F.col(k) for k in keys])))
    fixed = checked.select(*[F.col(f"_chk.{c}").alias(c) if c in keys else F.col(c) for c in rules.columns])
    rejects = checked.select(F.col(key).alias("feed"), F.explode("_chk._problems").alias("reason")).select(
        "feed", F.lit(None).cast("string").alias("item_id"), F.lit("rules").alias("stage"),
        F.lit("warn").alias("severity"), "reason")
    return fixed, rejects
