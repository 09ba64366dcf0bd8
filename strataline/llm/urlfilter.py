"""URL block lists that follow redirects: what is blocked stays blocked under its other addresses.

A url's own rule (longest fitting host and path) decides first, and an explicit
allow is final.  A url without a rule is blocked if any url that redirect or
canonical-link edges connect it with, over any number of hops, is blocked by a
rule of its own; else it is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path
and no aliases; pages repeating a url are judged alike; links without a target
are ignored; a fragment does not make another address.
"""

from __future__ import annotations

import string

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.components import connected_components
from strataline.llm.runtime import durable

#: The markup that declares another address of the same page.
LINK_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise(F.lit(""))


def with_host_path(df: DataFrame, url: str) -> DataFrame:
    """Adds host (A-Z lower-cased) and path of a url column."""
    rest = df.withColumn("__u", F.coalesce(F.col(url), F.lit(""))).withColumn("__r", _rest(F.col("__u")))
    raw = rest.withColumn("__h", F.regexp_extract("__r", r"^[^/?#]*", 0))
    host = F.translate("__h", string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(F.expr("substring(__r, length(__h) + 1)"), r"^[^?#]*", 0)
    return raw.withColumns({"host": host, "path": path}).drop("__u", "__r", "__h")


def with_rule(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and action of the longest fitting rule to rows with host and path; rules: action, host, path.

    Rules meet the distinct hosts only, by the suffixes of each host's labels.
    Of a rule given both ways, allow counts.
    """
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = df.select("host").distinct().withColumn("suffix", F.explode(suffix))
    kept = rules.select(F.col("host").alias("suffix"), F.col("path").alias("p"), "action").withColumn("rule", F.concat("suffix", "p"))
    one = F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("allow"), "rule", "p", "action")
    by_host = hosts.join(kept, "suffix").groupBy("host").agg(F.collect_set(one).alias("fits"))
    best = F.array_max(F.filter("fits", lambda r: F.startswith(F.col("path"), r["p"])))
    return df.join(by_host, "host", "left").withColumn("__b", best).withColumns({"rule": F.col("__b.rule"), "action": F.col("__b.action")}).drop("fits", "__b")


def _address(url: Column) -> Column:
    """What two spellings of an address share: no fragment, A-Z lower-cased in scheme and host."""
    whole = F.regexp_replace(url, r"(?s)#.*$", "")
    front = F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*", 0)
    return F.concat(F.translate(front, string.ascii_uppercase, string.ascii_lowercase), whole.substr(F.length(front) + 1, F.length(whole)))


def declared_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) between addresses that pages declare: canonical links and immediate redirects."""
    tags = F.concat(F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0)), F.regexp_extract_all(html, F.lit(REFRESH_TAG), F.lit(0)))
    found = pages.filter(F.col(html).rlike(r"(?i)canonical|refresh") & F.col(url).contains("://")).select(F.col(url).alias("url"), F.explode(tags).alias("tag"))
    goal = F.when(F.col("tag").rlike(LINK_TAG), F.regexp_extract("tag", HREF, 1)).otherwise(F.regexp_extract("tag", TARGET, 1))
    found = with_host_path(found.withColumn("goal", goal).filter(F.col("goal") != ""), "url")
    scheme = F.substring_index("url", "://", 1)
    base = F.concat(scheme, F.lit("://"), "host")
    full = (
        F.when(F.col("goal").contains("://"), F.col("goal"))
        .when(F.startswith("goal", F.lit("//")), F.concat(scheme, F.lit(":"), "goal"))
        .when(F.startswith("goal", F.lit("/")), F.concat(base, "goal"))
        .otherwise(F.concat(base, F.coalesce(F.nullif(F.regexp_extract("path", r"^.*/", 0), F.lit("")), F.lit("/")), "goal"))
    )
    return found.select(_address(F.col("url")).alias("a"), _address(full).alias("b")).filter(F.col("a") != F.col("b")).distinct()


def filter_urls(pages: DataFrame, rules: DataFrame, links: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every page; links: edges (a, b) between addresses."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
    judged = with_rule(with_host_path(own, "__url"), rules).withColumn("__at", _address(F.col("__url")))
    edges = durable(links, "url-links")
    verdict = F.coalesce("action", F.lit("allow"))
    if not edges.isEmpty():
        members = connected_components(edges)
        nodes = with_rule(with_host_path(members, "node"), rules)
        tainted = nodes.filter(F.col("action") == "block").select("component").distinct()
        blocked = members.join(tainted, "component", "left_semi").select(F.col("node").alias("__at"), F.lit("block").alias("spread"))
        judged = judged.join(blocked, "__at", "left")
        verdict = F.coalesce("action", "spread", F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
