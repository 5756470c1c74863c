"""URL filters: allow and block rules, carried over to the aliases of a page.

Pages that redirect to each other or name each other as canonical are one page under
several addresses: connected components over these links pass a block on to all of them,
unless one is allowed explicitly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsgauge.llm.components import components
from opsgauge.llm.shared import col, written

# Verdict, host and path of each rule.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows ``://`` up to a slash, question mark or hash, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to a question mark or hash."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def url_address(url: Column) -> Column:
    """Host, path and query: what names a page, whatever its scheme and fragment."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^?#]*(\?[^#]*)", 1)
    return F.concat(url_host(url), url_path(url), query)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``rule, verdict`` of the longest rule that fits, an allowing one first; NULL if none does.

    A rule fits its host and its subdomains if the path starts with the rule's path.
    """
    fits = [
        F.when(
            ((host == of) | host.endswith("." + of)) & path.startswith(start),
            F.struct(
                F.lit(len(of + start)).alias("length"),
                F.lit(verdict == "allow").alias("allow"),
                F.lit(of + start).alias("rule"),
            ),
        )
        for verdict, of, start in rules
    ]
    best = F.array_max(F.array(*fits))
    return F.when(
        best.isNotNull(),
        F.struct(best["rule"].alias("rule"), F.when(best["allow"], "allow").otherwise("block").alias("verdict")),
    )


def _resolved(target: Column, url: Column) -> Column:
    """An absolute URL from a link on the page ``url``."""
    target = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(url, r"^(?s:(.*?))://", 1)
    root = F.concat(scheme, F.lit("://"), url_host(url))
    folder = F.regexp_extract(url_path(url), r"^(?s:.*/)", 0)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target != "", F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )


def alias_links(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``a, b``: the addresses that redirects and canonical links of the pages connect.

    A link from or to a URL without a host connects nothing.
    """
    html, url = F.coalesce(col(html_column), F.lit("")), col(url_column)
    canonical = F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    refresh = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    targets = F.array(
        F.regexp_extract(canonical, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1),
        F.regexp_extract(refresh, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1),
    )
    found = pages.filter(url.contains("://")).select(url.alias("url"), F.explode(targets).alias("target"))
    found = found.filter("target != ''").withColumn("target", _resolved(F.col("target"), F.col("url")))
    return _with_hosts(found.select(url_address(F.col("url")).alias("a"), url_address(F.col("target")).alias("b")))


def _with_hosts(edges: DataFrame) -> DataFrame:
    """Edges whose ends are addresses: those without a host are empty or begin with their path or query."""
    return edges.filter(~F.col("a").rlike("^(?:$|[/?])") & ~F.col("b").rlike("^(?:$|[/?])"))


def url_verdicts(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    links: DataFrame | None = None,
) -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict, address, alias_of, n_aliases_blocked, n_aliases_allowed``.

    The longest rule that fits a page's own URL decides.  A page without a rule takes the decision
    of its aliases: allow if a rule allows one of them, else block if a rule blocks one, else allow.  ``links``
    adds redirects known from elsewhere (``a, b``, URLs).  Links may lead to addresses that are not in
    ``pages``; these count as aliases too.

    A NULL URL or one without ``://`` has an empty host and path, fits no rule and has no aliases; NULL
    html has no links; repeated pages are judged alike.  Other columns are not read.  No rows: no rows.
    """
    edges = alias_links(pages, url_column, html_column)
    if links is not None:
        given = links.select(url_address(F.col("a")).alias("a"), url_address(F.col("b")).alias("b"))
        edges = edges.union(_with_hosts(given))
    edges = written(edges.filter("a != b").distinct(), "aliases")
    roots = components(edges)
    members = edges.select(F.col("a").alias("address")).union(edges.select("b")).distinct()
    members = members.join(roots.withColumnRenamed("node", "address"), "address", "left")
    members = members.withColumn("root", F.coalesce("root", "address"))
    slash = F.concat(F.lit("x://"), F.col("address"))
    members = written(members.withColumn("own", rule_of(url_host(slash), url_path(slash), rules)), "members")
    groups = written(
        members.groupBy("root").agg(
            F.count_if(F.col("own.verdict") == "block").alias("blocked"),
            F.count_if(F.col("own.verdict") == "allow").alias("allowed"),
        ),
        "groups",
    )
    decided = members.select("address", "root").join(groups, "root")
    rows = pages.select(col(id_column).alias("id"), col(url_column).alias("url"))
    rows = rows.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url")), "address": url_address(F.col("url"))})
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).join(decided, "address", "left")
    alias = F.when((F.col("allowed") == 0) & (F.col("blocked") > 0), "block").otherwise("allow")
    return rows.select(
        "id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", alias).alias("verdict"),
        "address",
        F.coalesce("root", "address").alias("alias_of"),
        F.coalesce("blocked", F.lit(0)).alias("n_aliases_blocked"),
        F.coalesce("allowed", F.lit(0)).alias("n_aliases_allowed"),
    )
