"""URL filter with redirect equivalence, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import ascii_lower, let, spare, stored
from lathe.llm.components import connected_components


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def after_scheme(url: Column) -> Column:
    return let(url, lambda u: F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + F.lit(3), F.length(u))))


def node_of(url: Column) -> Column:
    """A page's name among links: host, path and query, without scheme and fragment; null without a host."""
    return let(url, lambda u: F.when(host_of(u) != "", F.concat(host_of(u), F.regexp_extract(after_scheme(u), r"^[^/?#]*([^#]*)", 1))))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. rules: (verdict, host, path), a bounded list held in the plan."""

    def best(u):
        fits = [F.when(((u["h"] == h) | u["h"].endswith("." + h)) & u["p"].startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
        return F.array_max(F.array_compact(F.array(*fits)))

    return let(F.struct(host.alias("h"), path.alias("p")), best)


def without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments are followed; it starts with ``/``."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    start = F.array().cast("array<string>")
    up = lambda acc: F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
    kept = F.aggregate(parts, start, lambda acc, x: F.when(x == ".", acc).when(x == "..", up(acc)).otherwise(F.array_append(acc, x)))
    return F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")


def resolved(url: Column, target: Column) -> Column:
    """The url that ``target`` names on the page ``url``; null where it names something other than a page, like ``mailto:``.

    ``//host/..`` takes the page's scheme, ``/..`` its host, ``?..`` its path, and any
    other its path up to the last ``/``; ``.`` and ``..`` are followed.
    """

    def made(x):
        to, host, path = x["to"], host_of(x["url"]), path_of(x["url"])
        rest = F.regexp_extract(to, r"^[^?#]*(.*)$", 1)
        own = F.regexp_extract(to, r"^([^?#]*)", 1)
        folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/?(.*/)?", 1))
        there = lambda p: F.concat(F.lit("x://"), host, without_dots(p), rest)
        full = F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(F.lit("x:"), to)).when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).when(own == "", F.concat(F.lit("x://"), host, path, rest))
        return full.when(own.startswith("/"), there(own)).otherwise(there(F.concat(folder, own)))

    return let(F.struct(url.alias("url"), target.alias("to")), made)


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges ``(a, b)`` between page names from ``<link rel=canonical href>`` and ``<meta http-equiv=refresh content="..url=..">``.

    Relative targets are resolved against the page's own url.
    """
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?i)(<link\b[^>]*\bcanonical\b[^>]*>|<meta\b[^>]*\brefresh\b[^>]*>)"), 1)
    tagged = pages.where(F.col(html).rlike(r"(?i)canonical|refresh")).select(F.col(url).alias("url"), F.explode(tags).alias("tag"))
    is_link = F.col("tag").rlike(r"""(?i)^<link\b[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b""")
    is_refresh = F.col("tag").rlike(r"""(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b""")
    target = F.when(is_link, F.regexp_extract("tag", r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)).when(is_refresh, F.regexp_extract("tag", r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)""", 1))
    full = resolved(F.col("url"), F.replace(F.when(target != "", target), F.lit("&amp;"), F.lit("&")))
    return tagged.select(node_of(F.col("url")).alias("a"), node_of(full).alias("b"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, url: str = "url", html: str | None = "html", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    A rule that fits the page's own url decides (the longest; rules of one length
    in the order of their text). Other pages follow their aliases: pages that
    redirects (a table ``(a, b)`` of urls) and canonical or refresh links connect.
    An alias, crawled or not, that a rule allows makes them ``allow``; else one that
    a rule blocks makes them ``block``: an explicit allow goes first. Pages without
    either get ``default``.

    Null urls and urls without ``://`` have an empty host and path, fit no rule
    and have no alias. Null or empty html holds no link. Urls that differ in
    scheme or fragment only are one page. Repeated rows stay; columns named like
    the new ones are replaced.
    """
    spark = pages.sparkSession
    base = pages.drop("host", "path", "rule", "verdict")
    node, own_rule, passed_on = spare(base.columns, "_node", "_own", "_alias")
    own = base.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), node: node_of(F.col(url))}).withColumn(own_rule, best_rule(F.col("host"), F.col("path"), rules))
    own = own.withColumns({"rule": F.col(own_rule)["rule"], "verdict": F.col(own_rule)["verdict"]}).drop(own_rule)
    edges = spark.createDataFrame([], "a string, b string") if html is None else link_edges(base, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).where("a is not null and b is not null"))
    comps = connected_components(edges)
    if comps.isEmpty():
        return own.withColumn("verdict", F.coalesce("verdict", F.lit(default))).drop(node)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    found = best_rule(host_of(as_url), path_of(as_url), rules)["verdict"]
    passed = stored(comps.withColumn("v", found).groupBy("component").agg(F.min("v").alias("alias_verdict")).where("alias_verdict is not null"))  # "allow" sorts before "block"
    aliases = stored(comps.join(passed, "component").select(F.col("node").alias(node), F.col("alias_verdict").alias(passed_on)))
    return own.join(aliases, node, "left").withColumn("verdict", F.coalesce("verdict", passed_on, F.lit(default))).drop(node, passed_on)
