"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import let, spare, stored, with_counted

# Fixed patterns: (kind, pattern, group that holds the value, least characters of that group).
BASE = [
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    ("access", r"(AKIA[A-Z0-9]{14,})", 1, 18),
    ("hex", r"([0-9a-f]{16,})", 1, 16),
]
# Opaque runs that may be credentials without a keyword: 20 characters or more with both cases and a digit.
OPAQUE = ("opaque", r"([A-Za-z0-9+/_-]{20,})", 1, 20)


def sums_before(sizes: Column) -> Column:
    """For each element of an array of numbers the sum of those before it, in two levels of about the root of the length.

    A fold that appends copies what it has made so far, so one fold over everything
    would take time by the square of the length.
    """

    def running(xs, first):
        start = F.struct(first.cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out")), lambda acc: acc["out"])

    def two_levels(xs):
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        firsts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), width)).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(firsts, lambda i: F.slice(xs, i, width))
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), running(totals, F.lit(0)).alias("s")), lambda z: running(z["b"], z["s"])))

    return let(sizes, two_levels)


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<s, kind, e, v>> of the pattern's leftmost non-overlapping matches, offsets in code points.

    Between the matches lie the parts that ``split`` returns, so a match starts
    where the parts and matches before it end.
    """
    parts = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    value = whole if group == 1 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.slice(parts, F.lit(1), F.size(whole)).alias("p"), F.transform(whole, lambda m: F.length(m)).alias("m"), value.alias("v"))

    def placed(xs):
        before = sums_before(F.transform(xs, lambda r: (r["p"] + r["m"]).cast("long")))
        one = lambda r, b: F.struct((b + r["p"]).cast("int").alias("s"), F.lit(kind).alias("kind"), (b + r["p"] + r["m"]).cast("int").alias("e"), r["v"].alias("v"))
        return F.filter(F.zip_with(xs, before, one), lambda x: F.length(x["v"]) >= least)

    return F.when(text.rlike(pattern), let(rows, placed)).otherwise(F.array().cast("array<struct<s:int,kind:string,e:int,v:string>>"))


def candidates(text: Column) -> Column:
    """Spans of the base kinds and opaque runs of a text; opaque runs that a base span overlaps are left out."""
    t = F.coalesce(text, F.lit(""))
    mixed = lambda v: v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")
    clear = lambda base: lambda x: mixed(x["v"]) & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    return let(F.struct(F.concat(*(spans_of(t, *b) for b in BASE)).alias("base"), spans_of(t, *OPAQUE).alias("opaque")), lambda x: F.concat(x["base"], F.filter(x["opaque"], clear(x["base"]))))


def scan(docs: DataFrame, text: str = "text", repository: str | Column = "source", owner: str | Column = "source", max_owners: int = 1, max_repositories: int = 3) -> DataFrame:
    """The rows of ``docs`` without ``text``, and ``spans``: array of struct(start, kind, end, live, owners, repositories), by start, then kind in listed order.

    Candidates are the base kinds and opaque runs. A candidate's value counts, over
    the whole corpus, the distinct repositories and owners that hold it: one with at
    most ``max_owners`` and ``max_repositories`` is owner-specific and live-looking,
    one beyond is a widely copied example: several owners share it, or one owner has
    copied it through many repositories. Base spans stay either way; an opaque run
    becomes a span (kind ``owned``) only if it is owner-specific.

    A null text is empty; null repositories and owners count as one of their own.
    Repeated rows stay and, being of one owner, don't make a value common. Values are
    compared by SHA-256. Counting first takes distinct (value, owner, repository), so
    a value that a third of all rows hold is a few rows before it is shuffled; when
    the counts go back to the rows, such a value is broadcast.
    """
    kept = [c for c in docs.columns if c not in ("spans", text)]
    number, place, holder, held = spare([*kept, "spans"], "_row", "_repository", "_owner", "_found")
    as_column = lambda x: F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit("\x00"))
    named = F.transform(candidates(F.col(text)), lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"), F.sha2(x["v"].cast("binary"), 256).alias("h")))
    found = stored(docs.select(*kept, as_column(repository).alias(place), as_column(owner).alias(holder), named.alias(held)).withColumn(number, F.monotonically_increasing_id()))
    each = found.select(F.col(number).alias("row"), F.col(place).alias("repository"), F.col(holder).alias("owner"), F.explode(held).alias("x")).select("row", "repository", "owner", "x.*")
    one = each.groupBy("h", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    use = stored(one.groupBy("h").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"), F.sum("n").alias("n")))
    judged = with_counted(each.select("row", "s", "kind", "e", "h"), use, ["h"], "n").withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).where("live or kind <> 'opaque'")
    order = F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2).otherwise(3)
    span = F.struct(F.col("s").alias("start"), order.alias("order"), F.when(F.col("kind") == "opaque", "owned").otherwise(F.col("kind")).alias("kind"), F.col("e").alias("end"), "live", "owners", "repositories")
    rows = judged.groupBy(F.col("row").alias(number)).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    empty = F.array().cast(rows.schema["spans"].dataType)
    return found.join(rows, number, "left").select(*kept, F.coalesce("spans", empty).alias("spans"))


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest rows of ``op5``: one for every document row."""
    found = scan(docs.select("doc_id", "text", "source", "lang"), repository=F.concat_ws("/", "source", "lang"))
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "owned")
    return found.select("doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_example"))
