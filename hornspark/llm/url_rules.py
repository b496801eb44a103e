"""Allow and block rules for URLs by a sorted sweep, in DataFrame operations only.

A host's labels are reversed, so that a domain is a prefix of its subdomains. A rule fits its
host and all subdomains, so a URL has one key for each of its domains: the reversed domain, a
slash and the path. All keys that a rule fits lie in one interval, from the rule's own key to
the last that starts with it, and intervals are nested or apart. Rules' starts and ends and the
URLs' keys are sorted together; along that order a stack, one column for each depth of
nesting, holds the rules that have started and not ended. Its top is the longest rule of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornspark.llm.ordering import in_order, part
from hornspark.plans.materialize import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE = "struct<size:int,host_size:int,rule:string,verdict:string>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path up to ``?`` or ``#``; both empty for a null or a text without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def _key(labels: Column, path: Column) -> Column:
    """Sort key of the domain of these labels, top level first, and a path: bytes, since byte 255 ends an interval."""
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("/"), path), "UTF-8")


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _events(rules: DataFrame) -> DataFrame:
    """Start and end of each rule (host, path, verdict). Of rules alike in host and path, ``block`` holds."""
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    one = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    key = _key(_labels(F.col("host")), F.col("path"))
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict").cast(RULE)
    start = one.select(key.alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("id"), F.lit(1).alias("push"), rule.alias("own"))
    end = one.select(F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("id"), F.lit(-1).alias("push"), F.lit(None).cast(RULE).alias("own"))
    return start.unionByName(end)


def _running(rows: DataFrame, total: Column, name: str) -> DataFrame:
    """The sum of ``total`` up to and with each row along ``seq``: within its partition, and those before it."""
    rows = rows.withColumn("_part", part())
    sums = rows.groupBy("_part").agg(F.sum(total).alias("_sum"))  # one row for each partition
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    own = F.sum(total).over(Window.partitionBy("_part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")


def longest_rules(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """``keys`` (key, id) with ``found``, the longest rule that fits each; those that none fits are dropped.

    The order is cut into ranges of keys and ids, so a domain that many URLs share is dealt
    over many tasks. The stack at the beginning of a range is what the ranges before have left:
    the last start at each depth, from one row for each range.
    """
    events = materialize(_events(rules), "rule-events")
    deep = _running(in_order(events, "key", "kind", "id", name="rules-ordered"), F.col("push"), "depth")
    deep = materialize(deep, "rules-nested")
    most = deep.agg(F.max("depth")).first()[0] or 0
    if not most:
        return keys.withColumn("found", F.lit(None).cast(RULE)).limit(0)
    marks = deep.select("key", "kind", "id", "push", "depth", "own")
    probes = keys.select("key", F.lit(1).alias("kind"), "id", F.lit(0).alias("push"), F.lit(None).cast("bigint").alias("depth"), F.lit(None).cast(RULE).alias("own"))
    rows = in_order(marks.unionByName(probes), "key", "kind", "id", name="sweep").withColumn("_part", part())
    # the depth after the last event, and the last start at each depth
    state = {"_depth": F.col("depth"), **{f"_at{d}": F.when((F.col("push") == 1) & (F.col("depth") == d), F.col("own")) for d in range(1, most + 1)}}
    along = Window.partitionBy("_part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.where("kind <> 1").groupBy("_part").agg(*[F.max_by(c, F.when(c.isNotNull(), F.col("seq"))).alias(n) for n, c in state.items()])
    parts = rows.select("_part").distinct().join(ends, "_part", "left")  # one row for each range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_part", *[F.last(n, True).over(earlier).alias(f"{n}_in") for n in state])
    swept = rows.select("_part", "kind", "key", "id", *[F.last(c, True).over(along).alias(n) for n, c in state.items()]).where("kind = 1")
    swept = swept.join(F.broadcast(carried), "_part").select("key", "id", *[F.coalesce(n, f"{n}_in").alias(n) for n in state])
    top = F.coalesce(*[F.when(F.col("_depth") == d, F.col(f"_at{d}")) for d in range(1, most + 1)])
    return swept.select("key", "id", top.alias("found")).where("found is not null")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """For each row its id, ``host``, ``path``, the ``rule`` (host and path) that decides and its ``verdict``.

    ``rules``: host, path, verdict (``allow`` or ``block``). A rule fits its host and all its
    subdomains, if the path starts with the rule's; the longest (host and path together) decides,
    of equally long ones that with the longer host. Where none fits, ``rule`` is null and the
    verdict is ``default``. A null URL or one without ``://`` has an empty host and path. Repeated
    rows stay, an empty table gives an empty one, other columns are dropped, whatever their names;
    rules without a host fit nothing.
    """
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    urls = materialize(pages.select(F.col(f"`{id_col}`").alias("own"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("id")), "urls")
    # no rule looks further than the longest path and the most labels of all rules
    reach = rules.agg(F.max(F.length("path")), F.max(F.size(_labels(F.col("host"))))).first()
    n_path, n_labels = reach[0] or 0, reach[1] or 0
    labels = urls.where("host <> ''").select("id", _labels(F.col("host")).alias("labels"), F.substring("path", 1, n_path).alias("path"))
    each = labels.select("id", "path", "labels", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(1, n_labels))))).alias("k"))
    keys = each.select(_key(F.slice("labels", F.lit(1), F.col("k")), F.col("path")).alias("key"), "id")
    best = longest_rules(keys, rules).groupBy("id").agg(F.max("found").alias("found"))
    out = urls.join(best, "id", "left")
    return out.select(F.col("own").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
