"""URL filtering by a sort-merge range join of pages with prefix rules.

A rule names a host and the beginning of a path; it fits its host and all subdomains. The labels of
a host in reverse are its canonical key: the keys that begin with a rule's key form an interval, and
so do the paths that begin with a rule's path. Two sorted sweeps follow. The first goes over the
distinct hosts of pages and rules in ranges of keys: each host of a rule brings the stack of rule
hosts that are open there, a host of pages finds the last stack before it, and what is open at the
end of a range is carried into the next. The second goes over the paths below each rule host that
was found: a rule brings the stack of rules that are open at its start, and a page finds those
still open at its own path in the stack of the last start before it.

Defined results
    A null url, or one without ``://``, has an empty host and path and no rule. Of several rules
    that fit, the longest wins (code points of host and path); of equal ones, ``block``. Without
    a rule the verdict is ``allow``. Repeated rows are returned as often as they occur. Empty
    tables give empty results; further columns of the pages are not read.

Scale
    The first sweep sorts distinct hosts, not pages; one stack for each range, of no more hosts than a
    host has labels, comes to the driver. A page is repeated only for rule hosts that it lies under.
    Below a rule host, pages are dealt by a salt into as many parts as their counted number asks, and
    only the rules of such a host are repeated for each part: an ordinary host has one. A row holds
    the rules open at one place, never those of a host. Only id, url and keys are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamstat.functions.numbering import sorted_ranges
from seamstat.sources.scratch import stored

PAGES_AT_ONCE = 100_000
ALLOW = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"^(?s).*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def host_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def host_stacks(rules: DataFrame) -> DataFrame:
    """(labels, stack) of each host that has rules: it and its parents that have rules, outermost first."""
    hosts = rules.where("host IS NOT NULL").select(host_labels(F.col("host")).alias("labels")).distinct()
    opened = hosts.select(F.array_join("labels", ".").alias("open"))
    lengths = F.explode(F.sequence(F.lit(1), F.size("labels")))
    parents = hosts.withColumn("n", lengths).withColumn("parent", F.array_join(F.slice("labels", F.lit(1), F.col("n")), "."))
    met = parents.join(opened, F.col("parent") == F.col("open"))
    return met.groupBy("labels").agg(F.array_sort(F.collect_list("open")).alias("stack"))


def hosts_met(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, n, rule_host) of each host of pages and each rule host that it lies under.

    ``hosts`` has distinct labels and n. The sweep goes over ranges of sorted labels.
    """
    events = hosts.withColumn("page", F.lit(1)).unionByName(host_stacks(rules).withColumn("page", F.lit(0)), allowMissingColumns=True)
    ranged = sorted_ranges(events, ["labels", "page"])
    ends = ranged.where("stack IS NOT NULL").groupBy("range").agg(F.max_by("stack", "labels").alias("stack"))
    last = {r["range"]: r["stack"] for r in ends.collect()}
    carried, still_open = [], []
    for place in range(max(last, default=0) + 1):
        carried.append(F.array(*map(F.lit, still_open)).cast("array<string>"))
        still_open = last.get(place, still_open)
    after = F.array(*map(F.lit, still_open)).cast("array<string>")
    before = F.coalesce(F.get(F.array(*carried), F.col("range")), after)
    swept = Window.partitionBy("range").orderBy("labels", "page")
    key = F.array_join("labels", ".")
    inside = F.filter("stack", lambda host: F.startswith(F.concat(key, F.lit(".")), F.concat(host, F.lit("."))))
    return (
        ranged.withColumn("stack", F.coalesce(F.last("stack", ignorenulls=True).over(swept), before))
        .where("page = 1")
        .select(key.alias("key"), "n", F.explode(inside).alias("rule_host"))
    )


def open_rules(rules: DataFrame) -> DataFrame:
    """(host_key, start, stack) of each start of a rule: the rules open from there on, outermost first.

    A rule lies inside the rules of its host whose path its own path begins with. Only beginnings as
    long as some rule of the host are looked up. ``rules`` has host, path and verdict.
    """
    rank = F.when(F.col("verdict") == ALLOW, 0).otherwise(1)
    own = (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .groupBy(reversed_host(F.col("host")).alias("host_key"), "path")
        .agg(F.max(F.struct(rank.alias("rank"), F.concat("host", "path").alias("rule"), "verdict")).alias("is"))
    )
    lengths = own.groupBy(F.col("host_key").alias("of_host")).agg(F.collect_set(F.length("path")).alias("lengths"))
    fitting = F.explode(F.filter("lengths", lambda n: n <= F.length("path")))
    beginnings = (
        own.join(lengths, F.col("host_key") == F.col("of_host"))
        .select("host_key", F.col("path").alias("start"), fitting.alias("n"))
        .withColumn("open", F.expr("substring(start, 1, n)"))
    )
    opened = own.select(F.col("host_key").alias("of_host"), F.struct("path", "is.*").alias("entry"))
    met = beginnings.join(opened, (F.col("host_key") == F.col("of_host")) & (F.col("open") == F.col("entry.path")))
    return met.groupBy("host_key", "start").agg(F.array_sort(F.collect_list("entry")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, pages_at_once: int = PAGES_AT_ONCE) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    own = pages.select("page_id", "url")
    labels = host_labels(url_host(F.col("url")))
    hosts = own.groupBy(labels.alias("labels")).agg(F.count(F.lit(1)).alias("n"))
    found_hosts = stored(hosts_met(hosts, rules), "hosts-met")
    parts = stored(
        found_hosts.groupBy(F.col("rule_host").alias("host_key")).agg(
            F.ceil(F.sum("n") / pages_at_once).cast("int").alias("parts")
        ),
        "host-parts",
    )
    ways = found_hosts.join(parts, F.col("rule_host") == F.col("host_key")).select(F.col("key").alias("of_key"), "host_key", "parts")
    met = own.withColumn("key", F.array_join(labels, ".")).join(ways, F.col("key") == F.col("of_key"))
    starts = open_rules(rules).join(parts, "host_key")
    swept = Window.partitionBy("host_key", "salt").orderBy("start", "page")
    stack = F.last("stack", ignorenulls=True).over(swept)
    both = (
        met.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).cast("int"))
        .select("host_key", "salt", url_path(F.col("url")).alias("start"), F.lit(1).alias("page"), "page_id", "url")
        .unionByName(
            starts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("page", F.lit(0))
            .drop("parts"),
            allowMissingColumns=True,
        )
        .withColumn("stack", stack)
        .where("page = 1")
    )
    fitting = F.filter("stack", lambda rule: F.startswith(F.col("start"), rule["path"]))
    best = F.element_at(fitting, -1)
    found = both.withColumn("fitting", fitting).where(F.size("fitting") > 0).select(
        "page_id", "url", F.struct(F.length(best["rule"]).alias("length"), best["rank"].alias("rank"), best["rule"].alias("rule"), best["verdict"].alias("verdict")).alias("best"), F.lit(0).alias("one")
    )
    # One pass over equal pages; the sum of ``one`` counts how often the row occurs.
    judged = (
        own.select("page_id", "url", F.lit(1).alias("one"))
        .unionByName(found, allowMissingColumns=True)
        .groupBy("page_id", "url")
        .agg(F.max("best").alias("best"), F.sum("one").cast("int").alias("times"))
    )
    return judged.select(
        "page_id",
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(ALLOW)).alias("verdict"),
        F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("time"),
    ).drop("time")
