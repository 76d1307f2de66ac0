"""Main text by consensus host paths: pages score their containers, hosts vote on tag-class paths, winners extract."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.llm.common import sized_broadcast, spare, stored
from lathe.llm.urls import host_of

TAG_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
UNQUOTED = re.compile(r"""[^>"']*""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas")}
# Elements that start and end a block of text.
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary center nav header footer aside form fieldset dialog menu hr head search".split())
CONTAINERS = frozenset("body main article div td".split())
NEVER_CHROME = frozenset("html body main article".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
# Elements that never hold the article's text.
CHROME = frozenset("nav header footer aside form menu dialog head button select option label input fieldset search".split())
# Words of class, id or role that name menus, footers, sidebars, notices, adverts and reader comments.
NAMED = frozenset("nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar notice notices cookie cookies consent gdpr newsletter subscribe promo sponsor sponsors sponsored ad ads advert adverts advertisement advertising adslot adbox comment comments commentlist disqus pagination pager toolbar popup modal".split())
# Words that mark such parts on many pages and an article's own text on others.
LIKELY = frozenset("header banner foot side aside related recommended widget alert signup promotion promoted discussion replies respond share sharing social login form search contentinfo complementary toc".split())
# Words that say nothing of what a part is.
NEUTRAL = frozenset("box list section bar area block wrap wrapper container inner outer content item items unit slot top bottom left right page site global link links text col row group main".split())
STATES = frozenset("has with no is".split())  # "has-sidebar" says something of a page, not of a sidebar
SPLIT_NAME = re.compile(r"[^A-Za-z]+")
SPACE = re.compile(r"\s+")
# An open element of the first name ends where one of the second starts.
IMPLIED = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
LISTS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}  # elements that those stay within; a table for cells
CLOSES_P = BLOCKS - {"html", "body", "head"}


PLAIN, DOUBTFUL, CHROME_MARK = 0, 1, 2


def marked_by(token: str) -> int:
    """What one word of class, id or role says: chrome if it is made of naming and neutral words only, doubtful if it holds a naming or likely word among others."""
    parts = [x for x in SPLIT_NAME.split(token) if x]
    if not parts or parts[0] in STATES or (NAMED.isdisjoint(parts) and LIKELY.isdisjoint(parts)):
        return PLAIN
    return CHROME_MARK if not NAMED.isdisjoint(parts) and all(x in NAMED or x in LIKELY or x in NEUTRAL for x in parts) else DOUBTFUL


def attributes(raw: str) -> tuple[str, int, str]:
    """The generalised class part of a path, what class, id and role mark, and all their words, generalised, as one name."""
    classes, mark, words = "", PLAIN, set()
    if raw and not raw.isspace():
        for m in ATTRIBUTE.finditer(raw):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name not in ("class", "id", "role"):
                continue
            tokens = value.split()
            mark = max([mark, *map(marked_by, tokens)])
            general = {re.sub(r"\d+|>", "#", c) for c in tokens}
            words |= general
            if name == "class":
                classes = ".".join(sorted(general))
    return classes, mark, ".".join(sorted(words))


def tokens(text: str) -> Iterator[tuple[str, str, str]]:
    """``("text", raw, "")``, ``("start", tag, attributes)`` and ``("end", tag, "")`` in page order, in linear time.

    Comments and declarations are left out. A quote that never closes ends with its
    tag at the next ``>``. A mark that isn't found once isn't looked for again.
    The reader may send back a position to go on from.
    """
    at, n = 0, len(text)
    gone: set[str] = set()

    def find(mark: str, start: int) -> int:
        found = -1 if mark in gone else text.find(mark, start)
        if found < 0:
            gone.add(mark)
        return found

    def after(mark: str, start: int) -> int:
        found = find(mark, start)
        return n if found < 0 else found + len(mark)

    while at < n:
        low = find("<", at)
        if low < 0:
            yield "text", text[at:], ""
            return
        closing = text.startswith("/", low + 1)
        name = TAG_NAME.match(text, low + 1 + closing)
        declared = text.startswith(("!", "?"), low + 1)
        if name is None and not declared:
            yield "text", text[at : low + 1], ""
            at = low + 1
            continue
        if low > at:
            yield "text", text[at:low], ""
        if declared:
            if text.startswith("<!--", low):
                at = after("-->", low + 4)
            elif text.startswith("<![CDATA[", low):
                at = after("]]>", low + 9)
                yield "text", entities.escape(text[low + 9 : at].removesuffix("]]>"), quote=False), ""
            else:
                at = after(">", low + 2)
            continue
        end = UNQUOTED.match(text, name.end()).end()
        while end < n and text[end] != ">":
            close = find(text[end], end + 1)
            if close < 0:
                end = after(">", end + 1) - 1 if find(">", end + 1) >= 0 else n
                break
            end = UNQUOTED.match(text, close + 1).end()
        inside = text[name.end() : end]
        at = min(n, end + 1)
        on = yield "end" if closing else "start", name[0].lower(), inside, at
        if on is not None:
            at = on
            yield "", "", ""  # the answer to send


def parse(text: str) -> Iterator[tuple]:
    """Events of a page: ``("open", tag, classes, mark, name)``, ``("close",)``, ``("text", raw)`` and ``("break",)`` at block edges.

    End tags that are missing are implied: by a block inside a paragraph, by the
    next item or cell, by the end of an outer element and by the end of the page.
    Where the elements of a tag are open is kept as lists of depths, so an event
    takes the same time at any depth.
    """
    stack: list[str] = []
    where: defaultdict[str, list[int]] = defaultdict(list)
    barriers: list[int] = []  # open elements that a paragraph outside of them survives

    def pop():
        top = stack.pop()
        where[top].pop()
        if barriers and barriers[-1] == len(stack):
            barriers.pop()
        if top in BLOCKS:
            yield ("break",)
        yield ("close",)

    def deepest(tags) -> int:
        return max((where[t][-1] for t in tags if where[t]), default=-1)

    reader = tokens(text)
    for kind, value, inside, *position in reader:
        if kind == "text":
            yield "text", value
            continue
        tag = value
        if kind == "end":
            if where[tag]:
                low = where[tag][-1]
                while len(stack) > low:
                    yield from pop()
            elif tag == "p":
                yield ("break",)
            continue
        if tag in RAW:
            if not inside.endswith("/"):
                end = RAW[tag].search(text, position[0])
                reader.send(end.end() if end else len(text))
            continue
        if tag in CLOSES_P and where["p"] and deepest(("p",)) > (barriers[-1] if barriers else -1):
            low = where["p"][-1]
            while len(stack) > low:
                yield from pop()
        if tag in IMPLIED:
            low = deepest(IMPLIED[tag])
            if low > deepest(LISTS.get(tag, ("table",))):
                while len(stack) > low:
                    yield from pop()
        if tag == "br":
            yield "text", " "
            continue
        if tag in BLOCKS:
            yield ("break",)
        if tag in VOID or inside.endswith("/"):
            continue
        if tag in CONTAINERS or tag in ("li", "blockquote", "button"):
            barriers.append(len(stack))
        where[tag].append(len(stack))
        stack.append(tag)
        classes, mark, name = attributes(inside)
        if tag in CHROME:
            mark = CHROME_MARK
        elif tag in NEVER_CHROME or (mark == DOUBTFUL and tag not in BLOCKS):
            mark = PLAIN
        yield "open", tag, classes, mark, f"{tag}.{name}"
    while stack:
        yield from pop()


def step(tag: str, classes: str) -> str:
    return f"{tag}.{classes}" if classes else tag


class Place:
    """Where a reader of events stands: inside page chrome, links and articles.

    Chrome is what tags and naming words say. A doubtful block is chrome outside of
    ``article`` and ``main``; inside of them it is text until something else speaks
    against it.
    """

    def __init__(self):
        self.stack: list[tuple[bool, bool, bool]] = []
        self.chrome = self.link = self.article = 0

    def open(self, tag: str, mark: int) -> tuple[bool, bool]:
        """Whether the element starts chrome, and whether it is a doubtful block of an article."""
        starts = mark == CHROME_MARK or (mark == DOUBTFUL and not self.article)
        doubtful = mark == DOUBTFUL and not starts and not self.chrome
        self.stack.append((starts, tag == "a", tag in ("article", "main")))
        self.chrome += starts
        self.link += tag == "a"
        self.article += tag in ("article", "main")
        return starts, doubtful

    def close(self) -> None:
        starts, link, article = self.stack.pop()
        self.chrome -= starts
        self.link -= link
        self.article -= article


def survey(text: str) -> tuple[str | None, list[tuple[str, int]]]:
    """The path of the page's best container, and (name, text hash) of its doubtful blocks.

    A path is the chain of containers from the body, each as tag and classes with
    digits generalised. The best is where most unlinked text stands close to its own
    blocks, article and main elements first; ties go to the shorter path, then the
    first on the page. Where text outside of all containers makes the page itself the
    best, there is no path. Paths are numbered, so that depth costs nothing.
    """
    numbers: dict[tuple[int, str], int] = {}
    outer, name, depth, size, links = [-1], [""], [0], [0], [0]  # number 0 is the page
    place, at, chain, blocks, pieces = Place(), 0, [], [], None
    for event in parse(text):
        kind = event[0]
        if kind == "open":
            _, tag, classes, mark, own_name = event
            starts, doubtful = place.open(tag, mark)
            before = at
            if tag in CONTAINERS and not place.chrome:
                key = at, step(tag, classes)
                if key not in numbers:
                    numbers[key] = len(outer)
                    outer.append(at)
                    name.append(key[1])
                    depth.append(depth[at] + 1)
                    size.append(0)
                    links.append(0)
                at = numbers[key]
            first = doubtful and pieces is None
            if first:
                pieces = []
            chain.append((before, own_name if first else None))
        elif kind == "close":
            place.close()
            at, block = chain.pop()
            if block is not None:
                line = SPACE.sub(" ", "".join(pieces)).strip()
                if line:
                    blocks.append((block, xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)))
                pieces = None
        elif kind == "text" and not place.chrome:
            if pieces is not None:
                pieces.append(event[1])
            n = len(event[1].strip())
            size[at] += n
            links[at] += n * bool(place.link)
    own = list(size)
    for i in range(len(outer) - 1, 0, -1):
        size[outer[i]] += size[i]
        links[outer[i]] += links[i]
    best = None
    for i in range(0 if own[0] else 1, len(outer)):
        if size[i] > links[i]:
            score = (size[i] - links[i]) * (0.5 + 0.5 * own[i] / size[i]) * (4 if name[i].split(".")[0] in ("article", "main") else 1)
            if best is None or (score, -depth[i]) > best[0]:
                best = (score, -depth[i]), i
    steps, i = [], best[1] if best else 0
    while i:
        steps.append(name[i])
        i = outer[i]
    return ">".join(reversed(steps)) or None, blocks


def best_container(text: str) -> str | None:
    return survey(text)[0]


def extract(text: str, winner: str | None, boilerplate: frozenset[str] = frozenset()) -> str:
    """Text inside every container whose path is ``winner``, page chrome left out, one block a line; of the whole page where none has it.

    A doubtful block inside an article goes if half of its characters are links, or
    if its name is in ``boilerplate``: the blocks that the host repeats from page to page.
    """
    lines: list[str] = []
    parts: list[str] = []
    steps = winner.split(">") if winner is not None else []
    place, chain = Place(), []
    depth = matched = inside = seen = chars = linked = 0

    def flush():
        if parts:
            line = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if line:
                lines.append(line)

    for event in parse(text):
        kind = event[0]
        if kind == "open":
            _, tag, classes, mark, name = event
            was = place.chrome
            starts, doubtful = place.open(tag, mark)
            if (starts and not was) or doubtful:
                flush()
            chain.append((depth, matched, inside, (len(lines), chars, linked, name) if doubtful else None))
            if tag in CONTAINERS and not place.chrome:
                if matched == depth < len(steps) and step(tag, classes) == steps[depth]:
                    matched += 1
                depth += 1
                if matched == depth == len(steps):
                    inside, seen = inside + 1, 1
        elif kind == "close":
            place.close()
            ends = inside
            depth, matched, inside, block = chain.pop()
            if ends != inside or block:
                flush()
            if block:
                first, c, k, name = block
                if name in boilerplate or (chars > c and 2 * (linked - k) >= chars - c):
                    del lines[first:]
        elif kind == "text":
            if not place.chrome and (inside or winner is None):
                parts.append(event[1])
                n = len(event[1].strip())
                chars += n
                linked += n * bool(place.link)
        else:
            flush()
    flush()
    if winner is not None and not seen:
        return extract(text, best_container(text), boilerplate)
    return "\n".join(lines)


def surveyed(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, kind, key, hash, n``, stored: pages that vote for a path (kind 0), and doubtful blocks by name and text (kind 1)."""

    def run(batches):
        for batch in batches:
            hosts, kinds, keys, hashes = [], [], [], []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path, blocks = survey(t.as_py() or "")
                for kind, key, value in [*([(0, path, 0)] if path is not None else []), *((1, k, v) for k, v in blocks)]:
                    hosts.append(h)
                    kinds.append(kind)
                    keys.append(key)
                    hashes.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(kinds, pa.int32()), pa.array(keys, pa.string()), pa.array(hashes, pa.int64())], names=["host", "kind", "key", "hash"])

    votes = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, kind int, key string, hash long")
    return stored(votes.groupBy("host", "kind", "key", "hash").agg(F.count(F.lit(1)).alias("n")))


def winners_of(found: DataFrame) -> DataFrame:
    """``host, winner, votes``: the path that most pages of a host vote for; ties go to the longer path, then the last in order."""
    best = F.max(F.struct(F.col("n").alias("votes"), F.length("key").alias("size"), F.col("key").alias("winner")))
    return found.where("kind = 0").groupBy("host").agg(best.alias("b")).select("host", "b.winner", "b.votes")


def boilerplate_of(found: DataFrame) -> DataFrame:
    """``host, names``: doubtful blocks whose texts a host repeats: met twice or more, with half as many texts at most."""
    per = found.where("kind = 1").groupBy("host", "key").agg(F.sum("n").alias("met"), F.count(F.lit(1)).alias("texts"))
    return per.where("met >= 2 and 2 * texts <= met").groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("names"))


def vote(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    return winners_of(surveyed(pages, url, html))


def main_text(pages: DataFrame, url: str = "url", html: str = "html", name: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Adds ``text``: the page's main text, empty where there is none.

    A host's pages agree on one path, found in a first pass; the second extracts
    with it. A page that lacks the winning path, or whose host has none, uses its own
    best container. Page chrome goes by its tags and by words of class, id or role
    that name it. A block inside an article that such words only hint at goes if it is
    mostly links or if the host repeats it from page to page. Null html is empty; a null url belongs to the host with an
    empty name; repeated rows stay; a column named ``text`` is replaced.

    Votes are summed before they are shuffled, so a host with a third of all pages
    is a few rows. The winners, one row a host, are broadcast if they measure at
    most ``broadcast_bytes``, else joined by a shuffle that adaptive execution can split.
    """
    out = pages.drop(name)
    kept = out.columns
    host, winner, names = spare(kept, "_host", "_winner", "_names")
    found = surveyed(pages, url, html)
    agreed = stored(winners_of(found).join(boilerplate_of(found), "host", "full").select(F.col("host").alias(host), F.col("winner").alias(winner), F.col("names").alias(names)))
    size = 64 + F.octet_length(host) + F.coalesce(F.octet_length(winner), F.lit(0)) + F.coalesce(F.octet_length(F.array_join(names, ",")), F.lit(0))
    joined = out.withColumn(host, host_of(F.col(url))).join(sized_broadcast(agreed, size, broadcast_bytes), host, "left").select(*kept, winner, names)

    def run(batches):
        for batch in batches:
            texts = [extract(h.as_py() or "", w.as_py(), frozenset(x.as_py() or ())) for h, w, x in zip(batch.column(html), batch.column(winner), batch.column(names), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, name])

    return joined.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(name, T.StringType())]))


def page_text_report(pages: DataFrame) -> DataFrame:
    """The rows of ``op6``: one for every page row."""
    return main_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
