"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of words: digits, letters and everything beyond ASCII. A-Z is lower-cased, the rest becomes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class WuManber:
    """Word patterns of one length ``m``: a shift table over blocks of ``B`` words, and buckets of patterns by their last block.

    ``shift[block]`` is the least number of words by which the search may move
    on when the window ends with that block; a block of no pattern moves it by
    ``m - B + 1``. Where the shift is zero, the bucket's patterns are compared
    with the text word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]], m: int):
        self.m, self.block = m, min(2, m)
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for p, items in patterns.items():
            for end in range(self.block, m + 1):
                key = self.key(p, end)
                self.shift[key] = min(self.shift.get(key, m), m - end)
            self.bucket[self.key(p, m)].append((list(p), items))

    def key(self, text, end):
        return (text[end - 2], text[end - 1]) if self.block == 2 else text[end - 1]

    def occurrences(self, text: list[bytes]):
        """(start, items) of every occurrence, by start."""
        m, far, shift, bucket = self.m, self.m - self.block + 1, self.shift.get, self.bucket
        end, n = m, len(text)
        if self.block == 2:
            while end <= n:
                s = shift((text[end - 2], text[end - 1]))
                if s is None:
                    end += far
                elif s:
                    end += s
                else:
                    window = text[end - m : end]
                    for p, items in bucket[(text[end - 2], text[end - 1])]:
                        if p == window:
                            yield end - m, items
                    end += 1
        else:
            for at, word in enumerate(text):
                if shift(word) is not None:
                    for _, items in bucket[word]:
                        yield at, items


def build(rows, width: int) -> list[WuManber]:
    """One searcher for each pattern length. rows: (item number, text)."""
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for number, text in rows:
        w = words(text)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            p = tuple(w[i : i + width])
            if number not in by_length[len(p)][p]:
                by_length[len(p)][p].append(number)
    return [WuManber(dict(ps), m) for m, ps in sorted(by_length.items())]


def search(text: list[bytes], searchers: list[WuManber]) -> tuple[list[int], set[int]]:
    """Hit spans, flat as start, end, start, end, ..., merged; and the numbers of the items that occur."""
    found, items = [], set()
    for s in searchers:
        for start, which in s.occurrences(text):
            found.append((start, start + s.m))
            items.update(which)
    found.sort()
    spans: list[int] = []
    for start, end in found:
        if spans and start <= spans[-1]:
            spans[-1] = max(spans[-1], end)
        else:
            spans += [start, end]
    return spans, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """Adds ``n_words``, ``hit_spans`` (flat word offsets) and ``items`` (sorted strings) to every row of ``docs``.

    Null and empty texts have no words; a null item text or one without words has
    no window; rows that repeat each count for themselves; items that share an id
    are one item with the windows of all; an empty
    benchmark hits nothing. Items with a null id are searched for as ``null``.
    Columns of ``docs`` stay, and a column with one of the new names is replaced.

    The benchmark is a stated set of test strings: its bytes are summed first and
    it is searched for in blocks of at most ``block_bytes``, each sent to the
    executors as one set of tables. Within a row the blocks' spans are merged, so
    the search stays a map over documents without a shuffle.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    total = items.select(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = -(-total // block_bytes) or 1
    new = ["n_words", "hit_spans", "items"]
    out = docs.drop(*new)
    kept = out.columns
    schema = T.StructType([*out.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
    for b in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b)
        rows = [(r.i if r.i is not None else "null", r.t) for r in part.toLocalIterator()]
        names = sorted({i for i, _ in rows})
        number = {x: k for k, x in enumerate(names)}
        searchers = build([(number[i], t) for i, t in rows], width)
        shared = docs.sparkSession.sparkContext.broadcast((names, searchers))
        first = b == 0

        def run(batches, shared=shared, first=first):
            names, searchers = shared.value
            for batch in batches:
                n_words, spans, hits = [], [], []
                before = None if first else list(zip(batch.column("hit_spans").to_pylist(), batch.column("items").to_pylist(), strict=True))
                for k, t in enumerate(batch.column(text)):
                    w = words(t.as_py())
                    s, found = search(w, searchers)
                    who = {names[i] for i in found}
                    if before:
                        s, who = merged(before[k][0], s), who | set(before[k][1])
                    n_words.append(len(w))
                    spans.append(s)
                    hits.append(sorted(who))
                columns = [batch.column(c) for c in kept] + [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(hits, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

        out = out.mapInArrow(run, schema)
    return out


def merged(a: list[int], b: list[int]) -> list[int]:
    spans: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if spans and start <= spans[-1]:
            spans[-1] = max(spans[-1], end)
        else:
            spans += [start, end]
    return spans


def n_hit(spans="hit_spans"):
    """Words inside the flat spans."""
    return F.expr(f"aggregate(transform({spans}, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (s, x) -> s + x)")



def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest rows of ``op1``: one for every document row."""
    found = decontaminate(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))
