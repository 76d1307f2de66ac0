"""Mixing to target weights by iterative proportional fitting, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import let, sized_broadcast, spare, stored

# Topics by the first pattern that a text holds; the rest is prose.
TOPICS = [
    ("licence", "(?i)licen[cs]e"),
    ("credential", "(?i)password|passwd|secret|token|api_?key"),
    ("contact", "@[A-Za-z0-9-]+[.]"),
]


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")), F.lit(0)).cast("long")


def topic_of(text: Column, topics=TOPICS) -> Column:
    pick = reduce(lambda c, t: c.when(text.rlike(t[1]), t[0]), topics[1:], F.when(text.rlike(topics[0][1]), topics[0][0]))
    return pick.otherwise("prose")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed and id: the same wherever and however often it is computed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def rake(cells: DataFrame, margins: dict[str, DataFrame], cycles: int) -> DataFrame:
    """``cells`` with ``w``: its column ``t`` fitted to the margins, one pass over every margin a cycle; and ``residual``, see ``fit``.

    Sums are taken by partial aggregation and joined back, so that a margin value
    shared by most cells is one row; each cycle is stored. For any number of cells.
    """
    now = cells.withColumn("w", F.col("t").cast("double"))
    sums = lambda at, name: at.groupBy(name).agg(F.sum("w").alias("_sum")).join(margins[name], name)
    for _ in range(cycles):
        for name in margins:
            now = now.join(sums(now, name), name, "left").withColumn("w", F.coalesce(F.when(F.col("_sum") > 0, F.col("w") * F.col("target") / F.col("_sum")), F.lit(0.0))).drop("_sum", "target")
        now = stored(now)
    off = [sums(now, name).agg(F.max(F.abs(F.col("_sum") / F.col("target") - 1))).first()[0] or 0.0 for name in margins]
    return now.withColumn("residual", F.lit(max(off)))


def rake_in_one_row(cells: DataFrame, margins: dict[str, DataFrame], cycles: int) -> DataFrame:
    """The same as one job: cells and margins as arrays of one row, cycles as a fold over them. For a bounded number of cells."""
    tagged = cells.select(F.lit(-1).alias("m"), F.struct(*margins, "t").alias("cell"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("target"))
    for i, (name, m) in enumerate(margins.items()):
        tagged = tagged.unionByName(m.where("target > 0").select(F.lit(i).alias("m"), F.col(name).alias("key"), "target"), allowMissingColumns=True)
    row = tagged.agg(
        F.sort_array(F.collect_list(F.when(F.col("m") == -1, F.col("cell")))).alias("cells"),
        *(F.sort_array(F.collect_list(F.when(F.col("m") == i, F.struct("key", "target")))).alias(f"m{i}") for i in range(len(margins))),
    )
    # each cell's place among a margin's values, 0 where it has no target there
    numbers = range(len(margins))
    at = lambda i, name: F.transform("cells", lambda c: F.array_position(F.transform(F.col(f"m{i}"), lambda x: x["key"]), c[name])).alias(f"p{i}")
    row = row.select("cells", *(F.col(f"m{i}") for i in numbers), *(at(i, name) for i, name in enumerate(margins)))

    def sums(w, i):
        """Weight on each value of margin ``i``."""
        both = F.zip_with(w, F.col(f"p{i}"), lambda x, p: F.struct(x.alias("x"), p.alias("p")))
        return let(both, lambda b: F.transform(F.col(f"m{i}"), lambda m, k: F.aggregate(b, F.lit(0.0), lambda s, y: s + F.when(y["p"] == k + 1, y["x"]).otherwise(0.0))))

    def fitted(w, i):
        factor = F.zip_with(sums(w, i), F.col(f"m{i}"), lambda s, m: F.when(s > 0, m["target"] / s).otherwise(0.0))
        return let(factor, lambda f: F.zip_with(w, F.col(f"p{i}"), lambda x, p: F.when(p > 0, x * F.get(f, (p - 1).cast("int"))).otherwise(0.0)))

    start = F.transform("cells", lambda c: c["t"].cast("double"))
    row = row.withColumn("w", F.aggregate(F.sequence(F.lit(1), F.lit(cycles)), start, lambda w, _: reduce(lambda x, i: let(x, lambda y: fitted(y, i)), numbers, w)) if cycles else start)
    off = [F.array_max(F.zip_with(sums(F.col("w"), i), F.col(f"m{i}"), lambda s, m: F.when(s > 0, F.abs(s / m["target"] - 1)))) for i in numbers]
    pairs = F.explode(F.arrays_zip(F.col("cells").alias("c"), F.col("w").alias("w"))).alias("x")
    return row.withColumn("residual", F.coalesce(F.array_max(F.array(*off)), F.lit(0.0))).select(pairs, "residual").select("x.c.*", "x.w", "residual")


def fit(cells: DataFrame, margins: dict[str, DataFrame], cycles: int, most_steps: int = 1 << 18) -> DataFrame:
    """Iterative proportional fitting: ``cells`` with ``w`` and ``residual``.

    cells: a stored table of one row a combination, with the margins' names as
    columns and the base weight ``t`` > 0. margins: for each name a stored table
    ``(name, target)``. Cells without a target in some margin get weight 0.
    ``residual`` says how far the fit is from done: the largest relative distance of
    any margin value's weight from its target, where any cell can hold it.

    A cycle looks at every cell once for every margin value. If these steps are at
    most ``most_steps``, both tables are arrays of one row; beyond, joins do the same.
    """
    n = cells.count() * sum(m.count() for m in margins.values())
    return (rake_in_one_row if n <= most_steps else rake)(cells, margins, cycles)


def tempered(cells: DataFrame, name: str, power: float) -> DataFrame:
    """Target shares ``(name, target)`` in proportion to the values' token shares raised to ``power``."""
    sums = stored(cells.groupBy(name).agg(F.sum("t").alias("t")).withColumn("p", F.pow(F.col("t").cast("double"), F.lit(power))))
    return sums.select(name, (F.col("p") / F.lit(sums.agg(F.sum("p")).first()[0] or 1.0)).alias("target"))


def mix(docs: DataFrame, dims: dict[str, Column], text: str = "text", doc_id: str = "doc_id", fraction: float = 0.5, power: float = 0.7, cycles: int = 10, seed: int = 17, targets: dict[str, DataFrame] | None = None, broadcast_bytes: int = 32 << 20, most_steps: int = 1 << 18) -> DataFrame:
    """Adds ``n_tokens``, ``weight`` (fitted share over own share), ``expected``, ``copies``, ``sampled`` and ``residual`` to every row of ``docs``.

    dims: name -> column of each margin; targets: name -> ``(name, target)`` shares,
    by default the margin's own shares raised to ``power``. Weights are raked over
    the cells that occur, for ``cycles`` passes, to sum to 1; ``residual`` is how far
    the worst margin value is from its target then.

    ``expected`` is ``fraction * weight``, the expected number of a document's copies
    in the sample: below 1 the probability that it is drawn. A cell that needs more
    than it has is repeated, so nothing is capped and expected tokens follow the
    fitted shares. ``copies`` is the whole part, and one more by the draw for the
    rest; ``sampled`` says whether there is one.

    A null dimension is a value of its own. Null and empty texts have no tokens: a
    cell without tokens has weight 1. Rows that share a doc_id share their draw;
    null ids draw as one. An empty table gives none. Columns named like the new
    ones are replaced; a margin that isn't a column of ``docs`` becomes one.
    """
    base = docs.drop("n_tokens", "weight", "expected", "copies", "sampled", "residual")
    made = {name: c for name, c in dims.items() if name not in base.columns}
    base = base.withColumns({**made, "n_tokens": word_count(F.col(text))})
    keys = spare([*base.columns, "weight", "residual"], *(f"_d{i}" for i in range(len(dims))))
    out = base.withColumns({k: F.coalesce(F.concat(F.lit("="), (F.col(name) if name in made else c).cast("string")), F.lit("-")) for k, (name, c) in zip(keys, dims.items(), strict=True)})
    cells = stored(out.groupBy(*keys).agg(F.sum("n_tokens").alias("t")).where("t > 0"))
    margins = {}
    for key, name in zip(keys, dims, strict=True):
        given = (targets or {}).get(name)
        margins[key] = stored(given.select(F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("-")).alias(key), F.col("target").cast("double").alias("target"))) if given is not None else tempered(cells, key, power)
    total = float(cells.agg(F.sum("t")).first()[0] or 0)
    weights = stored(fit(cells, margins, cycles, most_steps).select(*keys, (F.col("w") * F.lit(total) / F.col("t")).alias("weight"), "residual"))
    size = reduce(lambda a, b: a + b, (F.octet_length(k) for k in keys), F.lit(32))
    joined = out.join(sized_broadcast(weights, size, broadcast_bytes), keys, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).drop(*keys)
    expected = F.lit(fraction) * F.col("weight")
    joined = joined.withColumn("expected", expected)
    copies = (F.floor("expected") + (draw(F.col(doc_id), seed) < F.col("expected") - F.floor("expected")).cast("int")).cast("int")
    return joined.withColumn("copies", copies).withColumn("sampled", F.col("copies") > 0)


def document_dims(text: str = "text") -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.coalesce(F.col(text), F.lit("")))}


def mixing_report(docs: DataFrame) -> DataFrame:
    """The rows of ``op7``: one for every document row."""
    found = mix(docs.select("doc_id", "source", "lang", "text"), document_dims())
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("expected", 6).alias("expected"), "copies", "sampled", F.round("residual", 6).alias("residual"))
