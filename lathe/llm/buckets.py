"""Pairs of rows that share a bucket: links to one row of each bucket, then the links that those left out.

Rows have sketches that say which pairs may be similar, and an exact check
decides. The number of rows that any step makes grows with the rows in buckets,
never with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import sized_broadcast, stored, with_counted


def groups_of(batches, keys: int, least: int = 1) -> Iterator[pa.Table]:
    """Runs of equal values in the first ``keys`` columns of sorted record batches; whole runs are put together until they hold ``least`` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = bool(held) and any(held[-1].column(i)[-1].as_py() != c[0] for i, c in enumerate(columns))
        at = 0
        for s in np.flatnonzero(change).tolist():
            if n + s - at >= least:
                yield pa.Table.from_batches([*held, batch.slice(at, s - at)] if s > at else held)
                held, n, at = [], 0, s
        held.append(batch.slice(at))
        n += batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


CELLS = 8  # of blocks, for each partition


def packed(rows: DataFrame, cells: int, width: int, most: int = 1 << 19) -> DataFrame:
    """``cell, rows``: ``id, blocks`` (and ``sim``) with one entry for each block, as long integers side by side; about ``most`` entries of a task are dealt to cells by block at a time."""

    def dealt(held):
        entries = np.concatenate(held)
        cell = (entries[:, 0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(cells)
        cell = cell.astype(np.uint16 if cells <= 1 << 16 else np.int64)  # short ones take a radix sort
        order = np.argsort(cell, kind="stable")
        cell, data = cell[order], entries[order]
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        offsets = np.append(starts, len(data)).astype(np.int32) * np.int32(8 * width)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(cell[starts].astype(np.int64)), found], names=["cell", "rows"])

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            entries = np.empty((int(sizes.sum()), width), np.int64)
            entries[:, 0] = batch.column(1).flatten().to_numpy()
            for i, c in ((1, 0), (2, 2))[: width - 1]:
                entries[:, i] = np.repeat(batch.column(c).to_numpy(), sizes)
            held.append(entries)
            n += len(entries)
            if n >= most:
                yield dealt(held)
                held, n = [], 0
        if n:
            yield dealt(held)

    return rows.select("id", "blocks", *(["sim"] if width == 3 else [])).mapInArrow(pack, "cell long, rows binary")


def members_of(rows: DataFrame, radius: int | None = None, most: int = 1 << 20) -> DataFrame:
    """``block, id, head, near`` for every row of a bucket of two or more, stored; ``head`` is one of the bucket's ids, the least of the first that are read.

    rows: ``id`` and either its ``blocks``, an array, or one ``block`` (``sim``: a 64-bit
    print). ``near`` says whether a row is within ``radius`` bits of its head; without
    prints every row is, but the head itself. Entries are shuffled in packs, a few rows for each task and cell of
    blocks. A task reads about ``most`` entries at a time and keeps one for each block that it met, of which
    partitions hold about four million, so a crowded bucket costs time, not memory. Which id
    is the head decides what is compared first, not what is linked in the end.
    """
    width = 2 if radius is None else 3
    rows = rows if "blocks" in rows.columns else rows.withColumn("blocks", F.array("block"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    enough = -(-(rows.agg(F.sum(F.size("blocks").cast("long"))).first()[0] or 0) >> 22)

    def stream(batches):
        seen = np.empty((0, 4), np.int64)  # block, head, the head's print, whether the head has not been written yet

        def found(held):
            nonlocal seen
            entries = np.concatenate(held)
            entries = entries[np.argsort(entries[:, 0])]
            blocks, ids, prints = entries[:, 0], entries[:, 1], entries[:, width - 1]
            starts = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
            sizes = np.diff(np.append(starts, len(blocks)))
            at = np.minimum(np.searchsorted(seen[:, 0], blocks[starts]), max(len(seen) - 1, 0))
            old = seen[at, 0] == blocks[starts] if len(seen) else np.zeros(len(starts), bool)
            heads, group = np.minimum.reduceat(ids, starts), np.repeat(np.arange(len(starts)), sizes)
            spot = np.flatnonzero(ids == heads[group])
            spot = spot[np.concatenate(([True], group[spot[1:]] != group[spot[:-1]]))]  # where each least id stands first
            rest = np.ones(len(ids), bool)
            rest[spot[~old]] = False
            own = prints[spot]
            heads[old], own[old] = seen[at[old], 1], seen[at[old], 2]
            second = np.where(old, seen[at, 3] if len(seen) else 0, sizes > 1) > 0  # their heads are written now
            rest, group = np.flatnonzero(rest), group[rest]
            near = np.ones(len(rest), bool) if radius is None else np.bitwise_count((prints[rest] ^ own[group]).view(np.uint64)) <= radius
            seen[at[old], 3] = 0
            new = np.stack((blocks[starts], heads, own, sizes == 1), axis=1)[~old]
            seen = np.concatenate((seen, new))
            seen = seen[np.argsort(seen[:, 0])]
            columns = (np.concatenate(x) for x in ((blocks[rest], blocks[starts][second]), (ids[rest], heads[second]), (heads[group], heads[second]), (near, np.zeros(int(second.sum()), bool))))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "id", "head", "near"])

        held, n = [], 0
        for batch in batches:
            for x in batch.column(1):
                held.append(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, width))
                n += len(held[-1])
                if n >= most:
                    yield found(held)
                    held, n = [], 0
        if n:
            yield found(held)

    packs = packed(rows, CELLS * max(parts, enough), width)
    packs = packs.repartition(enough, "cell") if enough > parts else packs.repartition("cell")
    return stored(packs.mapInArrow(stream, "block long, id long, head long, near boolean"))


def stars(members: DataFrame) -> DataFrame:
    """Distinct pairs ``a, b`` of a head and a row near it."""
    return stored(members.where("near").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())


def settled(members: DataFrame, groups: DataFrame, points: DataFrame, payload: Callable[[DataFrame], DataFrame], near: Callable, quick: Callable, exact: Callable, similarity: float, crowd: int = 4096, outline: Callable | None = None, allowed: Callable | None = None, few: int = 64, shaped: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """Links ``a, b`` between rows of one bucket that ``groups`` leaves apart; None if there are none.

    groups: ``node, component`` so far. points: ``id, size, sketch, blocks``, the blocks
    in one order for all; ``shaped``, if given, makes these of other columns, only for the rows that are needed. payload: ids -> ``id, payload``. A pair is looked at if its
    sizes allow the similarity, ``near(sketch, sketches)`` holds, and no earlier block
    holds both (there it was looked at already). ``quick(payload, payload)`` says
    whether the rows are linked, or None; ``exact(pairs of payloads)`` decides those, some thousands at a time.
    ``allowed(outline, outlines)``, if given, says how similar pairs can be at most, by arrays that ``outline(payloads)`` makes,
    a row for each payload: less than ``similarity`` rules a pair out before that, and ``quick`` is tried only where at least
    half of what may be missing is left, else ``exact`` decides at once. Rows that became linked aren't compared any more.
    Buckets of up to ``few`` rows are looked through together, larger ones row by row.

    A bucket of more than ``crowd`` rows is cut into parts by hash, and every two
    parts meet in a group of their own, so its work is spread and no pair is lost.
    """
    label = groups.select(F.col("node").alias("id"), F.col("component").alias("label"))
    labelled = stored(members.select("block", "id").join(label, "id", "left").select("block", "id", F.coalesce("label", "id").alias("label")))
    torn = stored(labelled.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("block", "n"))
    if torn.isEmpty():
        return None
    rows = stored(with_counted(labelled, torn, ["block"], "n"))
    ids = stored(rows.select("id").distinct())
    known = points.join(sized_broadcast(ids, F.lit(16)), "id")
    known = shaped(known) if shaped else known
    parts = F.ceil(F.col("n") / crowd).cast("int")
    rows = rows.join(known, "id").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    met = F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.struct(F.least("part", q).alias("i"), F.greatest("part", q).alias("j")))).alias("x")
    columns = ["block", "i", "j", "part", "id", "label", "size", "sketch", "blocks"]
    rows = rows.select(*(c for c in columns if c not in ("i", "j")), met).select(*(F.col(f"x.{c}") if c in ("i", "j") else F.col(c) for c in columns))

    def dealt(df):
        return df.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "id")

    def candidates(t: pa.Table):
        """The labels of a table of whole buckets, which the caller may change, and its pairs ``x, y`` by position that are to be compared by the labels of the time."""
        keys = [t[c].to_numpy() for c in ("block", "i", "j")]
        part, label, size = (t[c].to_numpy() for c in ("part", "label", "size"))
        block, across, label = keys[0], keys[1] != keys[2], label.copy()
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        blocks = t["blocks"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        edges = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0), [True])))
        sizes = np.diff(edges)

        def still(x, y):
            """Which pairs are still to be compared; x: one position, or one for each of y."""
            fits = (label[y] != label[x]) & (np.minimum(size[y], size[x]) >= similarity * np.maximum(size[y], size[x]) - 1e-9)
            fits &= ~across[x] | (part[y] != part[x])
            at = np.flatnonzero(fits)
            x, y = x if np.ndim(x) == 0 else x[at], y[at]
            if len(at):
                same = blocks[y] == blocks[x]
                at = at[near(sketch[x], sketch[y]) & (blocks[x, same.argmax(axis=1)] == block[x])]
            return at

        def pairs():
            small = sizes <= few
            left = np.repeat(np.where(small, edges[1:], 0), sizes) - np.arange(t.num_rows) - 1  # rows of the same bucket that follow
            for k in range(1, int(sizes[small].max(initial=1))):
                x = np.flatnonzero(left >= k)
                at = still(x, x + k)
                if len(at):
                    yield x[at], x[at] + k
            for s, e in zip(edges[:-1][~small].tolist(), edges[1:][~small].tolist(), strict=True):
                for x in range(s, e - 1):
                    at = still(x, np.arange(x + 1, e))
                    if len(at):
                        yield x, x + 1 + at

        return label, pairs()

    def involved(batches):
        for t in groups_of(batches, 3, 4096):
            hit = np.zeros(t.num_rows, bool)
            for x, y in candidates(t)[1]:
                hit[x] = hit[y] = True
            if hit.any():
                yield from t.filter(pa.array(hit)).to_batches()

    def link(batches):
        held: list[tuple] = []  # undecided pairs, of one table or several

        def joined(ids, label, x, y):
            label[label == label[y]] = label[x]
            return ids[x], ids[y]

        def settle():
            links = [joined(ids, label, x, y) for (ids, label, x, y, _), good in zip(held, exact([h[4] for h in held]), strict=True) if good and label[x] != label[y]]
            held.clear()
            return packed(links)

        def packed(links):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for t in groups_of(batches, 3, 4096):
            label, pairs = candidates(t)
            ids, texts, links = t["id"].to_pylist(), t["payload"].to_pylist(), []
            shapes = outline(texts) if outline else None
            for x, y in pairs:
                hope = np.ones(len(y), bool)
                if outline:
                    most = allowed(shapes[x], shapes[y])
                    may = most >= similarity
                    x, y, hope = x if np.ndim(x) == 0 else x[may], y[may], most[may] >= (1 + similarity) / 2
                for a, b, close in zip(np.broadcast_to(x, len(y)).tolist(), y.tolist(), hope.tolist(), strict=True):
                    if label[a] != label[b]:
                        good = quick(texts[a], texts[b]) if close else None
                        if good:
                            links.append(joined(ids, label, a, b))
                        elif good is None:
                            held.append((ids, label, a, b, (texts[a], texts[b])))
                if len(held) >= 4096:
                    yield settle()
            yield packed(links)
        yield settle()

    found = stored(dealt(rows).mapInArrow(involved, rows.schema))
    if found.isEmpty():
        return None
    texts = payload(stored(found.select("id").distinct()))
    return stored(dealt(found.join(texts, "id").select(*columns, "payload")).mapInArrow(link, "a long, b long"))
