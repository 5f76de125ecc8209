"""Main text of web pages: differencing against the page with the nearest url, and page structure as its evidence.

Pages are sorted by host, path and id and dealt to key ranges, so a page's neighbours on its host stand beside it and a
host with a third of all pages is still many tasks. Each page's text lines (one for each block) are aligned with those of
its nearest neighbour by longest common subsequence; lines that both have are the site's, not the page's, and are deleted.
A neighbour that is a copy says nothing about the site and is passed over for the next. Copies have equal unmarked texts, or
nine tenths of the page's text in lines that are rare on the host (that no more than half of its different texts have).
Pages with equal texts side by side count as one place. Pages up to ``reach`` places away are looked at first; hosts with a
page that has only copies there are read again with a longer reach, until a page that isn't a copy or the host's end. Of
copies side by side those are passed over together that lack no more than a tenth of the page's rare text between them.
Ranges also get the pages of their first and last host that lie beyond their bounds, so results don't depend on the bounds.

Differencing alone is wrong where articles of a host share passages, and it can't see adverts or comments that differ from
page to page. So shared lines are deleted unless structure proves them text: lines in a heading, paragraph, list, quote,
table or the like within an article element (or, without one, a main element) stay. Lines in elements that aren't article
text (by tag, role, class or id) always go, and if a page has an article or main element, lines outside it go. If only class
names and ids speak against all text of an article, they are not believed. Within an article, ids of headings, paragraphs
and the like don't count, as they are made from the text, and others only if all of their words are such names.

What is aligned and moved between machines are 64-bit numbers of lines, with their lengths; texts stay where they are read,
and are joined with the deleted places at the end (broadcast if these are few, else by page).

White space in a block is one space, br is white space, blocks are joined by two line feeds; an inline element that is left
out doesn't part its block. Null and empty html gives an empty text; a page alone on its host keeps its unshared lines. Urls
that are null or have no host form one host. Repeated rows each get a row. Pages are aligned in time that follows the number
of equal pairs of lines; above two million such pairs, by halves and bits in memory that follows the pages' lengths, to the
same length. An empty table gives no rows. Columns other than id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict, deque
from collections.abc import Hashable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import id_text, range_bounds, range_number, saved, ship, url_host, url_path

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
DROPPED = {"aside", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "iframe", "input", "menu", "nav", "noscript", "object", "option", "select", "svg", "template"}
ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
MARKS = {
    "ad", "ads", "adsense", "alert", "announcement", "aside", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "discussion", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promotion", "related", "recommended", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget",
}
STARTS = ("advert", "breadcrumb", "comment", "cookie", "navig", "newsletter", "sidebar", "sponsor", "subscri")
TITLES = {"article", "content", "entry", "post", "story"}
# Words that make a class name tell of a state (with-sidebar, comments-open), not of what an element is.
STATE_STARTS, STATE_ENDS = {"has", "hide", "is", "no", "show", "with", "without"}, {"closed", "disabled", "enabled", "hidden", "off", "on", "open"}
# Words of ids that articles have for their own sections as well, and words that only say what kind of element it is.
UNCERTAIN = {"alert", "announcement", "copyright", "discussion", "notice", "notices", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "skip", "social", "subscription"}
STRUCTURE = {"area", "bar", "block", "body", "box", "container", "content", "form", "inner", "list", "main", "outer", "panel", "section", "thread", "top", "bottom", "wrap", "wrapper"}
PROVEN = {"blockquote", "caption", "dd", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "pre", "td", "th", "tr"}
ARTICLE, PLAIN, BOILER = 2, 1, 0
AT_ONCE = 256
AT_HAND = 4  # places on either side whose pages are compared one by one before lines are looked up
WIDER = 8  # how many times as far pages are looked for if all nearer ones are copies
SITE, NEAR, OWN = 0, 1, 2
LINE = np.dtype([("number", "<i8"), ("size", "<i4"), ("kind", "u1")])


def marked(name: str, attributes: str, within: bool, by_name: bool = True) -> bool:
    """Whether an element is boilerplate. within: it is in an article or main element; by_name: class and id count."""
    if name in DROPPED or name == "header" and not within:
        return True
    if not attributes.strip() or name in ("html", "body"):
        return False
    titled, against, header = False, False, False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I) or key == "role" and value.lower() in ROLES:
            return True
        if key not in ("class", "id") or not by_name:
            continue
        for token in value.split():
            words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())
            if not words or len(words) > 1 and (words[0] in STATE_STARTS or words[-1] in STATE_ENDS):
                continue
            marks = [w in MARKS or w.startswith(STARTS) for w in words]
            if key == "id" and within and (name in PROVEN or name == "section" and set(words) <= UNCERTAIN | STRUCTURE or not all(m or w in STRUCTURE for w, m in zip(words, marks, strict=True))):
                continue  # a heading's or section's own name
            if any(marks):
                against = True
            titled |= not set(words) - TITLES or name in ("article", "main") and bool(TITLES & set(words))
            header |= "header" in words
    return (against or header and not within) and not titled


def lines_of(page: str) -> list[tuple[str, int]]:
    """The text lines of a page, each with ARTICLE, PLAIN or BOILER."""
    found, within = parsed_lines(page, True)
    if within and all(kind == BOILER for _, kind in found):
        found, _ = parsed_lines(page, False)
    return found


def parsed_lines(page: str, by_name: bool) -> tuple[list[tuple[str, int]], bool]:
    """The lines, and whether class names or ids marked text in an article or main element."""
    text: list[str] = []
    held: list[str] | None = None  # of the block around an inline element that is left out
    skipped: list[str] = []  # open elements from the outermost that is boilerplate on
    articles = mains = 0
    proven = named = False
    at, end = 0, len(page)
    found: list[tuple[str, int, bool, bool]] = []  # line, kind, in an article, proven to be text

    def close_line() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                found.append((line, BOILER if skipped else PLAIN if not articles and not mains else ARTICLE, articles > 0, proven))
            text.clear()

    def end_skip() -> None:
        nonlocal held
        close_line()
        skipped.clear()
        if held is not None:
            text.extend(held)
            held = None

    while at < end:
        m = TAG.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not closing and name in RAW:
            gone = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = gone.end()
            continue
        if name in BLOCKS:
            if held is not None and closing and name not in skipped:  # the block around ends, the inline element was never closed
                end_skip()
            close_line()
            proven = name in PROVEN and not closing
        elif name in ("br", "td", "th"):
            text.append(" ")
        if name in VOID:
            continue
        if closing:
            if skipped:
                if name in skipped:
                    while skipped[-1] != name:
                        skipped.pop()
                    if len(skipped) == 1:
                        end_skip()
                    else:
                        skipped.pop()
                elif name in ("body", "html"):
                    end_skip()
            elif name == "article":
                articles = max(0, articles - 1)
            elif name == "main":
                mains = max(0, mains - 1)
            continue
        if skipped:
            if name in ("article", "main") and not articles and not mains and not marked(name, attributes, False, by_name) and "article" not in skipped:
                end_skip()  # an element that was never closed
            else:
                skipped.append(name)
                continue
        within = articles + mains > 0
        if marked(name, attributes, within, by_name):
            named |= within and not marked(name, attributes, within, False)
            if name not in BLOCKS:
                held = text.copy()
                text.clear()
            skipped.append(name)
        elif name == "article":
            articles += 1
        elif name == "main":
            mains += 1
    close_line()
    if skipped:
        end_skip()
        close_line()
    in_article = any(a for _, k, a, _ in found if k == ARTICLE)
    in_main = any(k == ARTICLE for _, k, _, _ in found)
    out = []
    for line, kind, a, proven in found:
        if in_article and not a or in_main and kind == PLAIN:
            kind = BOILER
        out.append((line, PLAIN if kind == ARTICLE and not proven else kind))
    return out, named


def common_lines(one: list, other: list, most_pairs: int = 2_000_000) -> list[int]:
    """Places in one of a longest common subsequence with other (Hunt and Szymanski)."""
    places: dict[Hashable, list[int]] = defaultdict(list)
    for j, line in enumerate(other):
        places[line].append(j)
    in_one: dict[Hashable, int] = defaultdict(int)
    for line in one:
        in_one[line] += 1
    if sum(n * len(places.get(line, ())) for line, n in in_one.items()) > most_pairs:
        return halved(one, other, most_pairs)
    ends: list[int] = []
    nodes: list[tuple] = []
    for i, line in enumerate(one):
        at = places.get(line)
        if not at:
            continue
        for j in reversed(at):
            k = bisect_left(ends, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                nodes.append(node)
            else:
                ends[k], nodes[k] = j, node
    out, node = [], nodes[-1] if nodes else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def halved(one: list, other: list, most_pairs: int) -> list[int]:
    """common_lines by Hirschberg's halves: memory in proportion to the pages, however many pairs are equal."""
    size = min(len(one), len(other))
    a = 0
    while a < size and one[a] == other[a]:
        a += 1
    z = 0
    while z < size - a and one[-1 - z] == other[-1 - z]:
        z += 1
    mid_one, mid_other = one[a : len(one) - z], other[a : len(other) - z]
    ends = list(range(a)), list(range(len(one) - z, len(one)))
    if not mid_one or not mid_other:
        return ends[0] + ends[1]
    if len(mid_one) == 1:
        return ends[0] + [a] * (mid_one[0] in mid_other) + ends[1]
    half = len(mid_one) // 2
    both = lengths(mid_one[:half], mid_other) + lengths(mid_one[half:][::-1], mid_other[::-1])[::-1]
    cut = int(both.argmax())
    left = common_lines(mid_one[:half], mid_other[:cut], most_pairs)
    right = common_lines(mid_one[half:], mid_other[cut:], most_pairs)
    return ends[0] + [a + i for i in left] + [a + half + i for i in right] + ends[1]


def lengths(one: list, other: list) -> np.ndarray:
    """The length of a longest common subsequence of one with the first 0, 1, ... lines of other (bit-parallel)."""
    n = len(other)
    raw: dict[Hashable, bytearray] = {line: bytearray() for line in one}
    for j, line in enumerate(other):
        if line in raw:
            bits = raw[line]
            if len(bits) <= j >> 3:
                bits.extend(bytes((j >> 3) + 1 - len(bits)))
            bits[j >> 3] |= 1 << (j & 7)
    places = {line: int.from_bytes(bits, "little") for line, bits in raw.items() if bits}
    full = (1 << n) - 1
    row = full
    for line in one:
        if line in places:
            met = row & places[line]
            row = ((row + met) | (row - met)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little")[:n]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def line_number(line: str) -> int:
    return line_number_of(line.encode("utf-8", "replace"))


def line_number_of(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def text_number(page: list[tuple[str, int]]) -> int:
    """Equal for pages with equal unmarked texts."""
    return line_number("\n".join(line for line, kind in page if kind != BOILER))


class Numbers:
    """A page as differencing sees it: its lines' numbers, kinds and lengths, and the number of its unmarked text."""

    def __init__(self, numbers: list[int], kinds: list[int], sizes: list[int], text: int):
        self.numbers, self.kinds, self.sizes, self.text = numbers, kinds, sizes, text

    @classmethod
    def of(cls, page: list[tuple[str, int]]) -> Numbers:
        return cls([line_number(line) for line, _ in page], [kind for _, kind in page], [len(line) for line, _ in page], text_number(page))

    def packed(self) -> bytes:
        return np.array(list(zip(self.numbers, self.sizes, self.kinds, strict=True)), LINE).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes, text: int) -> Numbers:
        held = np.frombuffer(raw, LINE)
        return cls(held["number"].tolist(), held["kind"].tolist(), held["size"].tolist(), text)

    def unmarked(self) -> set[int]:
        return {n for n, kind in zip(self.numbers, self.kinds, strict=True) if kind != BOILER}


def site_lines(pages: list[Numbers]) -> set[int]:
    """The unmarked lines that more than half of the different texts have."""
    texts = {p.text: p.unmarked() for p in pages}
    seen = Counter(line for lines in texts.values() for line in lines)
    return {line for line, n in seen.items() if 2 * n > len(texts)}


class Run:
    """Pages with equal unmarked texts that stand side by side; rows are (role, key, at) and the page."""

    def __init__(self, number: int):
        self.number, self.rows = number, []


class Places:
    """Where lines that several pages have stand in a row of pages, as stretches of places side by side that have them."""

    def __init__(self, pages: list[Numbers]):
        self.stretches: dict[int, tuple[list[int], list[int]]] = {}
        sets = [set(p.numbers) for p in pages]
        times = Counter(line for lines in sets for line in lines)
        for at, lines in enumerate(sets):
            for line in lines:
                if times[line] < 2:
                    continue
                starts, ends = self.stretches.setdefault(line, ([], []))
                if ends and ends[-1] == at:
                    ends[-1] = at + 1
                else:
                    starts.append(at)
                    ends.append(at + 1)

    def lacking(self, line: int, at: int) -> int:
        """The first place from at on that hasn't the line."""
        starts, ends = self.stretches.get(line, ((), ()))
        k = bisect_right(starts, at) - 1
        return max(at, ends[k]) if k >= 0 else at

    def first_other(self, rare: dict[int, int], at: int, end: int) -> int:
        """The first place from at to end that lacks more than a tenth of the rare text; end if there is none. Places are
        passed over together as long as all lines that any of them lacks are no more than a tenth."""
        total, never = sum(rare.values()), sum(n for line, n in rare.items() if line not in self.stretches)
        if not rare or 10 * never > total:
            return at
        gaps = [(self.lacking(line, at), line) for line in rare if line in self.stretches]
        heapify(gaps)
        while gaps:
            met, lacked = [], never
            while gaps and 10 * lacked <= total:
                at, line = heappop(gaps)
                lacked += rare[line]
                met.append((at, line))
            if 10 * lacked <= total or at >= end:
                return end
            while gaps and gaps[0][0] == at:
                met.append(heappop(gaps))
            if 10 * (never + sum(rare[line] for _, line in met if self.lacking(line, at) == at)) > total:
                return at
            for _, line in met:
                heappush(gaps, (self.lacking(line, at + 1), line))
        return end


class Nearest:
    """Finds the nearest place whose page is not a copy, up to reach places away on either side; the left one of two."""

    def __init__(self, runs: list[Run], reach: int):
        self.reach, self.n = reach, len(runs)
        self.before, self.after = [r.rows[-1][1] for r in reversed(runs)], [r.rows[0][1] for r in runs]  # as met on the way
        self.sides: tuple[Places, Places] | None = None

    def other(self, i: int, rare: dict[int, int]) -> Numbers | None:
        total = sum(rare.values())
        for d in range(1, min(self.reach, AT_HAND) + 1):
            for pages, at in ((self.before, self.n - 1 - i + d), (self.after, i + d)):
                if at < self.n and (not rare or 10 * lacking(rare, pages[at]) > total):
                    return pages[at]
        if self.reach <= AT_HAND:
            return None
        if self.sides is None:
            self.sides = Places(self.before), Places(self.after)
        here = self.n - 1 - i
        ends = [min(self.n, at + self.reach + 1) for at in (here, i)]
        left, right = (side.first_other(rare, at + AT_HAND + 1, end) for side, at, end in zip(self.sides, (here, i), ends, strict=True))
        if left < ends[0] and (left - here <= right - i or right >= ends[1]):
            return self.before[left]
        return self.after[right] if right < ends[1] else None


def lacking(rare: dict[int, int], page: Numbers) -> int:
    """How much of the rare text a page hasn't; no more than a tenth makes it a copy, as do equal unmarked texts."""
    there = set(page.numbers)
    return sum(n for line, n in rare.items() if line not in there)


def texts_near(runs: list[Run], reach: int, first: int, end: int) -> Iterator[int]:
    """How many different texts there are up to reach places around each of the runs first to end."""
    held = Counter(r.number for r in runs[max(0, first - reach) : first + reach])
    for i in range(first, end):
        if i + reach < len(runs):
            held[runs[i + reach].number] += 1
        yield len(held)
        if i >= reach:
            gone = runs[i - reach].number
            held[gone] -= 1
            if not held[gone]:
                del held[gone]


def differenced(runs: list[Run], common: set[int], texts: int, reach: int, first: int, end: int) -> Iterator[tuple[tuple, list[int], bool]]:
    """(row, places of deleted lines, settled) of the pages of runs first to end. Not settled: all texts up to reach places
    away are copies, and the host has more. Neighbouring runs differ in their texts."""
    nearest = Nearest(runs, reach)
    for i, seen in zip(range(first, end), texts_near(runs, reach, first, end), strict=True):
        page = runs[i].rows[0][1]
        rare: Counter[int] = Counter()
        for line, kind, size in zip(page.numbers, page.kinds, page.sizes, strict=True):
            if kind != BOILER and line not in common:
                rare[line] += size
        found = nearest.other(i, rare)
        for row, page in runs[i].rows:
            shared = common_lines(page.numbers, found.numbers) if found else []
            yield row, [k for k in shared if page.kinds[k] == PLAIN], found is not None or seen >= texts


def runs_of(pages: list[Numbers]) -> list[Run]:
    runs: list[Run] = []
    for p in pages:
        if not runs or runs[-1].number != p.text:
            runs.append(Run(p.text))
        runs[-1].rows.append(((), p))
    return runs


def kept_text(page: list[tuple[str, int]], deleted: list[int]) -> str:
    gone = set(deleted)
    return "\n\n".join(line for k, (line, kind) in enumerate(page) if kind != BOILER and k not in gone)


def main_texts(pages: list[list[tuple[str, int]]], reach: int) -> list[tuple[str, int]]:
    """(text, lines deleted by differencing) of all pages of one host, in url order."""
    numbers = [Numbers.of(p) for p in pages]
    runs, common = runs_of(numbers), site_lines(numbers)
    while True:
        out = list(differenced(runs, common, len({r.number for r in runs}), reach, 0, len(runs)))
        if all(settled for *_, settled in out):
            return [(kept_text(page, gone), len(gone)) for page, (_, gone, _) in zip(pages, out, strict=True)]
        reach *= WIDER


def edge_runs(pages: DataFrame, parts: int, reach: int) -> dict[int, list[list[tuple]]]:
    """The first and the last reach + 1 runs of each range: (host, number, key of the page at the range's bound)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads: dict[int, list[tuple]] = {}
        tails: dict[int, deque[tuple]] = {}
        for batch in batches:
            for part, host, number, key in zip(batch["part"], batch["host"], batch["number"], batch["key"], strict=True):
                head, tail = heads.setdefault(part, []), tails.setdefault(part, deque(maxlen=reach + 1))
                if tail and tail[-1][:2] == (host, number):
                    tail[-1] = (host, number, key)
                    continue
                if len(head) <= reach:
                    head.append((host, number, key))
                tail.append((host, number, key))
        rows = [(part, side, i, *x) for side, found in enumerate((heads, tails)) for part, held in found.items() for i, x in enumerate(held)]
        yield pd.DataFrame(rows, columns=["part", "side", "place", "host", "number", "key"])

    own = pages.select("part", "host", "number", "key", "at").repartition(parts, "part").sortWithinPartitions("part", "host", "key", "number", "at")
    out: dict[int, list[list[tuple]]] = {}
    for r in sorted(own.mapInPandas(run, "part int, side int, place int, host string, number long, key string").collect()):
        out.setdefault(r.part, [[], []])[r.side].append((r.host, r.number, r.key))
    return out


def beyond_bounds(edges: dict[int, list[list[tuple]]], reach: int) -> list[tuple[str, int, int]]:
    """(key, number, range) of the pages that a range needs from others: reach + 1 runs of its first and last host."""
    order, out = sorted(edges), []
    for at, part in enumerate(order):
        for side, others in ((1, reversed(order[:at])), (0, order[at + 1 :])):
            host, found = edges[part][1 - side][-1 if side == 0 else 0][0], []
            more = iter(x for p in others for x in (reversed(edges[p][1]) if side else edges[p][0]))
            for h, number, key in more:
                if h != host or len(found) > reach:
                    break
                if not found or found[-1][1] != number:
                    found.append((key, number, part))
            out += found
    return out


def extract_pages(pages: DataFrame, rows_each: int = 2048, reach: int = 4, broadcast_bytes: int = 1 << 25, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Returns page_id, url, text, n_chars and n_shared (lines that were deleted as the neighbour has them too)."""
    spark = pages.sparkSession
    ship(spark)
    url = F.col(url_column).cast("string")
    own = pages.select(id_text(id_column).alias("page_id"), url.alias("url"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"), url_host(url).alias("host"), url_path(url).alias("path"))
    own = own.withColumn("key", F.concat("host", F.lit("\x01"), "path", F.lit("\x01"), F.coalesce("page_id", F.lit("")))).drop("path")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [Numbers.of(lines_of(page)) for page in batch["html"]]
            raw = [p.packed() for p in read]
            yield batch[["host", "key"]].assign(number=[p.text for p in read], at=[line_number_of(x) for x in raw], body=raw, lines=[list(p.unmarked()) for p in read])

    # Pages are read twice, as their texts would take more disk than the numbers of their lines.
    numbered = saved(own.select("host", "key", "html").mapInPandas(number, "host string, key string, number long, at long, body binary, lines array<long>"), "pages")
    deleted = deleted_lines(numbered, rows_each, reach)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [lines_of(page) for page in batch["html"]]
            yield batch[["page_id", "url", "key"]].assign(at=[line_number_of(Numbers.of(p).packed()) for p in found], lines=[[None if kind == BOILER else line for line, kind in p] for p in found])

    texts = own.mapInPandas(read, "page_id string, url string, key string, at long, lines array<string>")
    size = deleted.agg(F.sum(F.length("key") + 4 * F.size("deleted") + 32)).first()[0] or 0
    texts = texts.join(F.broadcast(deleted) if size <= broadcast_bytes else deleted, ["key", "at"], "left")
    kept = F.when(F.col("deleted").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: ~F.array_contains("deleted", i)))
    texts = texts.select(F.col("page_id").cast("long").alias("page_id"), "url", F.array_join(F.filter(kept, lambda x: x.isNotNull()), "\n\n").alias("text"), F.coalesce(F.array_size("deleted"), F.lit(0)).cast("long").alias("n_shared"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")


def deleted_lines(numbered: DataFrame, rows_each: int, reach: int) -> DataFrame:
    """(key, at, deleted) of the pages that lose lines, deleted being their places. numbered: a table."""
    spark = numbered.sparkSession
    bounds = range_bounds(numbered, "key", rows_each)
    numbered = numbered.withColumn("part", range_number(bounds, F.col("key")))
    texts = numbered.select("host", "number", "lines").dropDuplicates(["host", "number"])
    sizes = saved(texts.groupBy("host").agg(F.count("*").alias("texts")), "hosts")
    seen = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1")
    common = seen.join(sizes, "host").where("2 * n > texts").groupBy("host").agg(F.collect_list("line").alias("lines"))
    sites = saved(sizes.join(common, "host", "left"), "sites")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Holds no more than AT_ONCE runs of pages, or as many as half the reach, and their neighbours."""
        step = max(AT_ONCE, wide // 2)  # lines are looked up in a table of all runs held: fewer of them with a longer reach
        runs: list[Run] = []
        common: set[int] = set()
        at, first, texts = None, 0, 0

        def done(end: int) -> pd.DataFrame:
            rows = [(*row[1:], gone, at[1], settled) for row, gone, settled in differenced(runs, common, texts, wide, first, end) if row[0] == OWN and (gone or not settled)]
            return pd.DataFrame(rows, columns=["key", "at", "deleted", "host", "settled"])

        for batch in batches:
            for part, host, role, key, mark, body, number, n, lines in zip(batch["part"], batch["host"], batch["role"], batch["key"], batch["at"], batch["body"], batch["number"], batch["texts"], batch["lines"], strict=True):
                if (part, host) != at:
                    if len(runs) > first:
                        yield done(len(runs))
                    runs, first, at = [], 0, (part, host)
                if role == SITE:
                    common, texts = set() if lines is None else set(lines), int(n)
                    continue
                if not runs or runs[-1].number != number:
                    if len(runs) >= first + step + wide:
                        end = len(runs) - wide
                        yield done(end)
                        keep = max(0, end - wide)
                        runs, first = runs[keep:], end - keep
                    runs.append(Run(number))
                runs[-1].rows.append(((role, key, mark), Numbers.unpacked(body, number)))
        if len(runs) > first:
            yield done(len(runs))

    columns = ["part", "host", "role", "key", "body", "number", "at"]
    none = [F.lit(None).cast("long").alias("texts"), F.lit(None).cast("array<long>").alias("lines")]
    out: DataFrame | None = None
    todo, wide = numbered.drop("lines"), reach
    while True:
        rows = todo.withColumn("role", F.lit(OWN)).select(*columns, *none)
        if bounds:
            needed = beyond_bounds(edge_runs(todo, len(bounds) + 1, wide), wide)
            sent = F.broadcast(spark.createDataFrame(needed, "key string, number long, part int"))
            rows = rows.union(todo.drop("part").join(sent, ["key", "number"]).dropDuplicates(["key", "number", "part"]).withColumn("role", F.lit(NEAR)).select(*columns, *none) if needed else rows.limit(0))
        site = todo.select("part", "host").distinct().join(sites, "host").select("part", "host", F.lit(SITE).alias("role"), F.lit("").alias("key"), F.lit(None).cast("binary").alias("body"), F.lit(0).cast("long").alias("number"), F.lit(0).cast("long").alias("at"), "texts", "lines")
        rows = rows.union(site)
        rows = rows.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "host", (F.col("role") != SITE), "key", "number", "at")
        got = saved(rows.mapInPandas(extract, "key string, at long, deleted array<int>, host string, settled boolean"), "deleted")
        open_hosts = saved(got.where("not settled").select("host").distinct(), "open")
        last = open_hosts.isEmpty()
        some = (got if last else got.join(open_hosts, "host", "left_anti")).where("size(deleted) > 0").select("key", "at", "deleted")
        out = some if out is None else out.union(some)
        if last:
            return out.dropDuplicates(["key", "at"])
        todo, wide = todo.join(open_hosts, "host", "left_semi"), wide * WIDER
