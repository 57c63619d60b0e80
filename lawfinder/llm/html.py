"""Main text of web pages, by wrappers inferred as union-free regular expressions.

A page is read into nested token streams, one for the contents of each element. A host's wrapper is such an expression, in
which any item may be optional (``?``) or repeated (``+``), but never an alternative. Wrappers come about by aligning
streams one after another: items that meet are joined and their contents aligned in turn; of what stands in one of the two
only, what repeats its neighbour becomes a repeated group and what does not an optional one; texts that meet become
one slot, known by its place in the wrapper, which keeps how much text and how much of it in links the pages
have there, and whether they ever differ.

What a page's main text is, is decided in this order. (1) Elements whose names say that they are menus, headers, footers,
sidebars, notices, adverts, forms, comments and the like are left out. (2) Of the rest, the texts in an article
element count, failing that those in an element that its class calls content, failing that those which the page, when
it is matched to its host's wrapper, puts into the wrapper's main slots: those of the element that holds most of the
host's varying text outside links. (3) A text that stands at the same path on most different pages of the host is a
constant of the wrapper and no slot's filling; it is left out, in articles too.
"""

from __future__ import annotations

import html as references
import itertools
import json
import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawfinder.llm.common import add_columns, parallelism, removed, table, utf8, without, written

#: A text is a constant of the wrapper if it is on more than half of the host's different pages, and on this many.
LEAST_PAGES = 3
#: Elements nested deeper than this count as part of the one at this depth (browsers do the same, at 512).
DEPTH = 200
#: Cells of an alignment table. Streams that differ in more become one repeated group of optional items instead.
CELLS = 40_000
#: Items of wrappers that a task holds before it hands them on, and wrappers that one task aligns in a round.
HELD, FAN_IN = 200_000, 64
#: Share of an element's text that one child must have for the main slots to be looked for below that child.
DOMINANT = 0.66
#: Bytes of all hosts' wrappers that are broadcast; more of them are joined to the pages by shuffling.
SMALL_WRAPPERS = 32 << 20

TEXT = "#"
OPTIONAL, REPEATED = 1, 2

# Elements of HTML, and words of class and id names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_ITEMS = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 option tbody pre blockquote".split())
_DROPPED = frozenset("nav footer aside form button dialog menu head noscript template svg math object canvas select".split()) | _RAW
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PLAIN = frozenset("html body main article".split())
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banners sponsor sponsored sponsors promo promos "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside footer foot colophon copyright "
    "cookie cookies consent gdpr popup popups modal newsletter subscribe login "
    "comment comments commentlist respond reply replies disqus discussion related recommended recommendations "
    "widget widgets skip masthead topbar toolbar logo crumbs".split()
)
#: Words that also name what articles are about: not heeded where most of an article's text stands under them.
_DOUBTFUL = frozenset(
    "banner promotion toc notice notices notification notifications alert alerts overlay subscription signup "
    "share sharing social forms form search hidden branding brand tagline legal".split()
)
_CONTENT = frozenset("article post entry story content maincontent articlebody postbody".split())
_NOISY_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_ENDS = _BLOCK - set("td th tr tbody thead tfoot caption body html head title legend summary".split())
_P_WALLS = {"table", "button", "body"}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_MARKED = re.compile(r"class|id|role|hidden|style", re.I)
_MARKS = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def label(name: str, attributes: str) -> str:
    """An opening tag as the wrapper sees it: the element, and its class, id and role; numbers in them count as one."""
    marks = []
    for key, value in _MARKS.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            marks.append(f"{key[0]}={re.sub('[0-9]+', '0', value)}")
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _UNSEEN.search(value)):
            marks.append("x=hidden")
    return " ".join([name, *marks])


def kind(tag: str) -> str:
    """Of a label: ``noise``, ``doubt``, ``header``, ``lead`` (a content element's header), ``article``, ``content`` or nothing."""
    name, _, marks = tag.partition(" ")
    words = {w.lower() for m in re.findall(r"[ci]=(.*?)(?= [cirx]=|$)", marks) for w in _WORDS.findall(m)}
    roles = set(re.findall(r"r=(\S+)", marks))
    if name in _DROPPED or "x=hidden" in marks or roles & _NOISY_ROLES:
        return "noise"
    if name in ("article", "main") or "main" in roles or "article" in roles:
        return "article"
    if name not in _PLAIN and words & _NOISE:
        return "noise"
    if name not in _PLAIN and words & _DOUBTFUL:
        return "doubt"
    if name == "header" or "header" in words:
        return "lead" if words & _CONTENT else "header"
    return "content" if name not in _PLAIN and words & _CONTENT else ""


#: What is known inside an element: noise, doubt, in an article or content, in a header, in a heading, rank (3 article, 2 content).
_OUTSIDE = (False, False, False, False, False, 0)


class Known(dict):
    """What follows from keys, kept for the next time and forgotten when there is too much of it."""

    def __init__(self, make: Callable, most: int = 200_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(*key)
        return value


def _state(was: tuple, tag: str) -> tuple:
    noise, doubt, inside, header, heading, rank = was
    k = kind(tag)
    rank = max(rank, 3 if k == "article" else 2 if k in ("content", "lead") else 0)
    return noise or k == "noise", doubt or k == "doubt", inside or rank > 0, header or k in ("header", "lead"), heading or tag.partition(" ")[0] in _HEADINGS, rank


_LABELS = Known(label)
_STATES = Known(_state)
_PATHS = Known(lambda parent, tag: xxhash.xxh64_intdigest(f"{parent:x}/{tag}"))
_KEYS = Known(lambda name, attributes: (_LABELS[name, attributes], kind(_LABELS[name, attributes])))


class Page:
    """A page's blocks of text in order, where each of them stands, and its token streams as an expression.

    The expression's leaves hold the numbers of their blocks. ``opens`` says whether an article begins outside what is left out.
    """

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.linked: list[int] = []  # characters of each text that are in links, roughly
        self.states: list[tuple] = []
        self.paths: list[int] = []
        self.opens = False
        self.items: list = []
        self._read(page)

    def _read(self, page: str) -> None:
        # open elements: name, label, items so far, state, path, whether it is a token of its own
        frames: list[tuple] = [("", "", self.items, _OUTSIDE, 0, True)]
        count: dict[str, int] = {}
        over: dict[str, int] = {}
        parts: list[str] = []
        link = linked = 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join(references.unescape("".join(parts)).split())
                parts.clear()
                _, _, items, state, path, _ = frames[-1]
                if text and not state[0]:
                    items.append([0, TEXT, [len(self.texts)]])
                    self.texts.append(text)
                    self.linked.append(min(linked, len(text)))
                    self.states.append(state)
                    self.paths.append(path)
            linked = 0

        def pop() -> None:
            name, tag, items, state, _, own = frames.pop()
            count[name] -= 1
            if own and not state[0]:
                items[:] = folded(items)

        def close_to(names: set[str] | frozenset[str], walls=()) -> None:
            for i in range(len(frames) - 1, 0, -1):
                if frames[i][0] in names:
                    while len(frames) > i:
                        pop()
                    return
                if frames[i][0] in walls:
                    return

        at, size, strict = 0, len(page), True
        absent: set[str] = set()
        while at < size:
            start = page.find("<", at)
            if start < 0:
                start = size
            if start > at:
                parts.append(page[at:start])
                linked += (start - at) if link else 0
            if start >= size:
                break
            found = _TAG.match(page, start) if strict else _LOOSE.match(page, start)
            if found is None:
                after = page[start + 1 : start + 2]
                second = page[start + 2 : start + 3] if after == "/" else after
                if after in ("!", "?") or (after == "/" and second and not second.isalpha()):
                    mark = "-->" if page.startswith("<!--", start) else "]]>" if page.startswith("<![CDATA[", start) and "]]>" not in absent else ">"
                    end = page.find(mark, start + (2 if mark == "-->" else 1))
                    if end < 0 and mark == "]]>":
                        absent.add(mark)
                        mark, end = ">", page.find(">", start)
                    at = size if end < 0 else end + len(mark)
                elif second.isascii() and second.isalpha():  # a tag that a quote keeps open to the end of the page: from here on quotes are not heeded
                    if not strict:
                        break
                    strict = False
                    at = start
                else:
                    parts.append("<")
                    at = start + 1
                continue
            at = found.end()
            closing, name, attributes = found.groups()
            name = name.lower()
            if closing:
                if name in _BLOCK:
                    flush()
                if name == "a":
                    link = 0
                if over.get(name):
                    over[name] -= 1
                elif count.get(name):
                    flush()
                    close_to({name})
                continue
            if name in _RAW:
                end = None if name in absent else re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                if end:
                    at = end.start()
                elif name in ("script", "style", "title", "textarea"):
                    break
                else:
                    absent.add(name)
                if name in _BLOCK:
                    flush()
                continue
            if name == "br":
                parts.append(" ")
                continue
            if name == "a":
                link = 1
            block = name in _BLOCK
            tag, what = _KEYS[name, attributes] if _MARKED.search(attributes) else _KEYS[name, ""]
            if block or what:
                flush()
            if name in _VOID:
                continue
            own = block or what != ""
            if not own and not count.get(name):
                continue  # an inline element without a part in the structure
            if name in _P_ENDS and count.get("p"):
                close_to({"p"}, _P_WALLS)
            if name in _CLOSES:
                close_to(*_CLOSES[name])
            if len(frames) > DEPTH:
                over[name] = over.get(name, 0) + 1
                continue
            if name in ("svg", "math") and attributes.endswith("/"):
                continue
            _, _, items, state, path, _ = frames[-1]
            if own:
                inner = _STATES[state, tag]
                if what == "article" and not inner[0]:
                    self.opens = True
                if not state[0]:
                    held: list = []
                    items.append([0, tag, held])
                    items = held
                frames.append((name, tag, items, inner, _PATHS[path, tag], True))
            else:
                frames.append((name, tag, items, state, path, False))
            count[name] = count.get(name, 0) + 1
        flush()
        while len(frames) > 1:
            pop()
        self.items = folded(self.items)

    def blocks(self) -> list[tuple[int, str]]:
        """(number, text) of the blocks that may be main text as far as names go."""
        return [(i, t) for i, t in enumerate(self.texts) if wanted(self.states[i])]


def wanted(state: tuple) -> bool:
    """Whether what stands in such elements may be main text at all: of headers, only an article's headings."""
    noise, _, inside, header, heading, _ = state
    return not noise and (not header or (inside and heading))


# ---- expressions: lists of items [flags, label, contents]; a text's contents are its payload, a group's label begins with "("


def joined(x: list, y: list, mix: Callable) -> list:
    """One item for two with the same label."""
    if x[1] == TEXT:
        return [x[0] | y[0], TEXT, mix(x[2], y[2])]
    return [x[0] | y[0], x[1], align(x[2], y[2], mix) if x[1] != "(any)" else gathered([*x[2], *y[2]], mix)]


def alike(x: list, y: list) -> bool:
    """Whether two items with the same label may be two of a list: containers must have the same kinds of contents."""
    if x[1] == TEXT or x[1].partition(" ")[0] in _ITEMS or x[1][0] == "(":
        return True
    return {i[1] for i in x[2]} == {i[1] for i in y[2]}


def extended(x: list, y: list) -> list:
    x.extend(y)
    return x


def folded(items: list, mix: Callable = extended, page: bool = True) -> list:
    """The items with repeats as repeated groups.

    On a page, three neighbours that are alike make one, and two equal stretches do. In a wrapper two neighbours do,
    if one of them is optional or repeated: some pages have more of them than others.
    """
    if len(items) < 2:
        return items
    out: list = []
    last: dict[str, list[int]] = {}
    group = -1  # the last group in out

    def put(x: list) -> None:
        last.setdefault(x[1], []).append(len(out))
        out.append(x)

    def cut(n: int) -> list:
        gone = out[len(out) - n :]
        del out[len(out) - n :]
        for g in gone:
            last[g[1]].pop()
        return gone

    for x in items:
        put(x)
        again = True
        while again:
            again = False
            n, x = len(out), out[-1]
            if n > 1 and out[-2][1] == x[1] and alike(out[-2], x):
                before = out[-2]
                if (before[0] & REPEATED) or (x[0] & REPEATED and not page) or (not page and (before[0] | x[0])):
                    cut(2)
                    one = joined(before, x, mix)
                    one[0] = REPEATED | (before[0] & x[0] & OPTIONAL)
                    put(one)
                    again = True
                elif page and n > 2 and out[-3][1] == x[1] and alike(out[-3], x):
                    a, b, c = cut(3)
                    one = joined(joined(a, b, mix), c, mix)
                    one[0] = REPEATED
                    put(one)
                    again = True
                if again:
                    continue
            if 0 <= group < n - 1 and out[group][1][0] == "(" and out[group][1] != "(any)" and n - 1 - group == len(out[group][2]) and all(a[1] == b[1] for a, b in zip(out[group][2], out[group + 1 :], strict=True)):
                more = cut(n - 1 - group)
                (g,) = cut(1)
                put([g[0] | REPEATED, g[1], [joined(a, b, mix) for a, b in zip(g[2], more, strict=True)]])
                group = len(out) - 1
                again = True
                continue
            places = last[x[1]]
            k = n - 1 - places[-2] if len(places) > 1 else 0
            if k > 1 and n >= 2 * k and out[n - 2 * k][1] == out[n - k][1] and all(out[n - 2 * k + i][1] == out[n - k + i][1] for i in range(k)):
                second = cut(k)
                first = cut(k)
                put([REPEATED, "(" + " ".join(i[1] for i in first) + ")", [joined(a, b, mix) for a, b in zip(first, second, strict=True)]])
                group = len(out) - 1
                again = True
    return out


def optional(x: list) -> list:
    return [x[0] | OPTIONAL, x[1], x[2]]


def gathered(items: list, mix: Callable) -> list:
    """The contents of a group that covers the items in any order: one optional item for each label."""
    found: dict[str, list] = {}
    waiting = items[::-1]
    while waiting:
        x = waiting.pop()
        if x[1][0] == "(":
            waiting += x[2][::-1]
        else:
            found[x[1]] = joined(found[x[1]], x, mix) if x[1] in found else x
    return [optional(x) for x in found.values()]


def grouped(items: list, other: list) -> list:
    """The items, with each stretch that is a repeated group in the other list as such a group."""
    kinds = {g[1]: [i[1] for i in g[2]] for g in other if g[1][0] == "(" and g[1] != "(any)"}
    for name, labels in kinds.items():
        out, i, k = [], 0, len(labels)
        while i < len(items):
            if items[i][1] == labels[0] and [x[1] for x in items[i : i + k]] == labels:
                out.append([REPEATED, name, items[i : i + k]])
                i += k
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(a: list, b: list, mix: Callable) -> list:
    """The expression that covers both: what meets is joined, what stands in one only becomes optional or repeated."""
    low, high, n, m = 0, 0, len(a), len(b)
    while low < n and low < m and a[low][1] == b[low][1] and alike(a[low], b[low]):
        low += 1
    while high < n - low and high < m - low and a[n - 1 - high][1] == b[m - 1 - high][1] and alike(a[n - 1 - high], b[m - 1 - high]):
        high += 1
    head = [joined(x, y, mix) for x, y in zip(a[:low], b[:low], strict=True)]
    tail = [joined(x, y, mix) for x, y in zip(a[n - high :], b[m - high :], strict=True)]
    x, y = a[low : n - high], b[low : m - high]
    x, y = grouped(x, y), grouped(y, x)
    if not x and not y:
        middle = []
        if not any(i[0] for i in head) and not any(i[0] for i in tail):
            return head + tail
    elif not x or not y:
        middle = [optional(i) for i in x or y]
    elif len(x) * len(y) > CELLS:
        middle = [[REPEATED, "(any)", gathered([*x, *y], mix)]]
    else:
        middle = table_aligned(x, y, mix)
    return folded(head + middle + tail, mix, False)


def table_aligned(a: list, b: list, mix: Callable) -> list:
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, x = best[i], best[i + 1], a[i]
        for j in range(m - 1, -1, -1):
            y = b[j]
            top = max(below[j], row[j + 1])
            if x[1] == y[1]:
                top = max(top, below[j + 1] + (3 if alike(x, y) else 1))
            row[j] = top
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][1] == b[j][1] and best[i][j] == best[i + 1][j + 1] + (3 if alike(a[i], b[j]) else 1):
            out.append(joined(a[i], b[j], mix))
            i, j = i + 1, j + 1
        elif i < n and (j >= m or best[i][j] == best[i + 1][j]):
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return out


def as_text(items: list) -> str:
    """The expression, readable."""
    out = []
    for flags, tag, contents in items:
        inner = TEXT if tag == TEXT else as_text(contents) if tag[0] == "(" else f"<{tag}>{as_text(contents)}</{tag.partition(' ')[0]}>"
        sign = ("", "?", "+", "*")[flags]
        out.append(f"({inner}){sign}" if sign or tag[0] == "(" else inner)
    return "".join(out)


def leaves(items: list) -> list[list]:
    """The text items, in order."""
    out = []
    for x in items:
        out.extend([x] if x[1] == TEXT else leaves(x[2]))
    return out


def shape(items: list) -> str:
    return "".join(TEXT if x[1] == TEXT else f"{x[0]}{x[1]}[{shape(x[2])}]" for x in items)


def size_of(items: list) -> int:
    return sum(1 if x[1] == TEXT else 1 + size_of(x[2]) for x in items)


# ---- payloads: in a wrapper (pages, characters, of these in links, digest of the text or 0 if it differs)


def summed(x: list, y: list) -> list:
    return [x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] if x[3] == y[3] else 0]


def paired(x: tuple, y: tuple) -> tuple:
    return x[0] + y[0], x[1] + y[1]


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def payload(page: Page, blocks: list[int]) -> list:
    texts = [page.texts[i] for i in blocks]
    return [1, sum(map(len, texts)), sum(page.linked[i] for i in blocks), digest("\n".join(texts)) or 1]


def filled(page: Page) -> list:
    """The page's expression with what fills its slots."""
    deep = lambda items: [[f, t, payload(page, c) if t == TEXT else deep(c)] for f, t, c in items]
    return deep(page.items)


def numbered(wrapper: list) -> list:
    """The wrapper with each text slot's number as its payload."""
    numbers = itertools.count()
    deep = lambda items: [[f, t, ((next(numbers),), ()) if t == TEXT else deep(c)] for f, t, c in items]
    return deep(wrapper)


def matched(page: Page, wrapper: list) -> dict[int, int]:
    """The slot of the wrapper (``numbered``) that each block of the page fills."""
    deep = lambda items: [[f, t, ((), tuple(c)) if t == TEXT else deep(c)] for f, t, c in items]
    return {b: slots[0] for _, _, (slots, blocks) in leaves(align(wrapper, deep(page.items), paired)) if slots for b in blocks}


def main_slots(wrapper: list) -> list[int]:
    """Numbers of the slots in the element that holds most of the text that differs between pages and is in no link."""
    numbers = itertools.count()

    def weigh(items, state):
        out = []
        for _, tag, contents in items:
            if tag == TEXT:
                n, chars, links, same = contents
                fixed = same and n >= LEAST_PAGES
                out.append((next(numbers), 0 if fixed or not wanted(state) or state[5] else chars - links, tag, None))
            else:
                below = weigh(contents, state if tag[0] == "(" else _STATES[state, tag])
                out.append((None, sum(x[1] for x in below), tag, below))
        return out

    now = weigh(wrapper, _OUTSIDE)
    mass = sum(x[1] for x in now)
    while mass > 0:
        top = max(now, key=lambda x: x[1])
        if top[3] is None or top[1] < DOMINANT * mass or top[2].partition(" ")[0] in _ITEMS:
            break
        now, mass = top[3], top[1]

    def slots(items):
        return [n for x in items for n in ([x[0]] if x[3] is None else slots(x[3]))]

    return slots(now) if mass > 0 else []


def host_of(url: str | None) -> str:
    found = re.match(r"\s*[a-zA-Z][\w+.-]*://([^/?#\s]*)", url or "")
    return found[1].rpartition("@")[2].partition(":")[0].lower() if found else ""


def constant(path: int, text: str) -> int:
    """What a text at a path of elements is known by."""
    return xxhash.xxh64_intdigest(f"{path:x} {text}") >> 1


_WRAPPERS = pa.schema([("host", pa.string()), ("part", pa.int64()), ("wrapper", pa.string()), ("page", pa.int64()), ("text", pa.int64())])


def _gather(batches):
    """(url, html) to a wrapper for each host of the task, and the digests of different pages and their texts (text null: the page)."""
    part = TaskContext.get().partitionId()
    wrappers: dict[str, list] = {}
    shapes: dict[tuple[str, str], list] = {}
    texts: set[tuple[str, int, int | None]] = set()
    held = 0

    def settle() -> None:
        for (host, _), items in sorted(shapes.items()):
            wrappers[host] = align(wrappers[host], items, summed) if host in wrappers else items
        shapes.clear()

    def out(rows):
        for some in iter(lambda: list(itertools.islice(rows, 5000)), []):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _WRAPPERS, strict=True)], schema=_WRAPPERS)

    for b in batches:
        for url, raw in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
            page, host = Page(raw.decode("utf-8", "replace")), host_of(url)
            key = host, shape(page.items)
            if key in shapes:
                for x, y in zip(leaves(shapes[key]), leaves(page.items), strict=True):
                    x[2] = summed(x[2], payload(page, y[2]))
            else:
                shapes[key] = filled(page)
                held += size_of(page.items)
            own = {constant(page.paths[i], t) for i, t in page.blocks()}
            name = digest(repr(sorted(own)))
            texts.add((host, name, None))
            texts.update((host, name, t) for t in own)
        if len(texts) > 200_000:
            yield from out((h, None, None, p, t) for h, p, t in texts)
            texts.clear()
        if len(shapes) > 2000 or held > HELD:
            settle()
            held = sum(size_of(w) for w in wrappers.values())
            if held > HELD:
                yield from out((h, part, pack(w), None, None) for h, w in wrappers.items())
                wrappers.clear()
                held = 0
    settle()
    yield from out((h, part, pack(w), None, None) for h, w in wrappers.items())
    yield from out((h, None, None, p, t) for h, p, t in texts)


def pack(wrapper: list) -> str:
    return json.dumps(wrapper, ensure_ascii=False, separators=(",", ":"))


def _aligned(batches):
    """Aligns the wrappers of each (host, part), rows sorted by these, as they stream by."""
    now, wrapper = None, []
    for b in batches:
        done = []
        for host, part, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (host, part) == now:
                wrapper = align(wrapper, json.loads(text), summed)
                continue
            if now is not None:
                done.append((*now, pack(wrapper)))
            now, wrapper = (host, part), json.loads(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), list(_WRAPPERS)[:3], strict=True)], names=["host", "part", "wrapper"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, pack(wrapper)), list(_WRAPPERS)[:3], strict=True)], names=["host", "part", "wrapper"])


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper, fixed, pages): each host's expression, the texts that are its constants, and how many different pages it has.

    All pages take part. Each task aligns its own pages of a host; these wrappers are aligned FAN_IN at a time, in as many rounds
    as it takes, so a host with most pages is many tasks' work. Copies of a page are one page when texts are counted. Pages without a host share an empty one.
    The answer is a table in the shared folder.
    """
    spark = pages.sparkSession
    n = parallelism(spark)
    rows = pages.select(F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    rows = written(rows.mapInArrow(_gather, "host string, part long, wrapper string, page long, text long"), "html-pages")
    each = rows.where("wrapper IS NOT NULL").select("host", "part", "wrapper")
    parts = (each.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN_IN)
        dealt = each.withColumn("part", F.expr(f"part % {parts}")).repartition(n, "host", "part")
        each = dealt.sortWithinPartitions("host", "part", F.desc(F.length("wrapper")), "wrapper").mapInArrow(_aligned, "host string, part long, wrapper string")
        if parts == 1:
            break
    digests = rows.where("page IS NOT NULL")
    all_ = digests.where("text IS NULL").groupBy("host", "page").count().groupBy("host").agg(F.count("*").alias("pages"))
    # only what stands on two different pages at least is counted by page
    shared = digests.where("text IS NOT NULL").groupBy("host", "text").agg(F.min("page").alias("low"), F.max("page").alias("high"), F.count("*").alias("n"))
    shared = shared.where(f"low < high AND n >= {LEAST_PAGES}").select("host", "text")
    fixed = digests.join(shared, ["host", "text"]).groupBy("host", "text", "page").count().groupBy("host", "text").agg(F.count("*").alias("n"))
    fixed = fixed.join(all_, "host").where(f"n >= {LEAST_PAGES} AND 2 * n > pages").groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("fixed"))
    found = written(each.join(all_, "host", "left").join(fixed, "host", "left").select("host", "wrapper", "fixed", F.coalesce("pages", F.lit(0)).alias("pages")), "html-wrappers")
    removed(rows)
    return found


class Wrapper:
    """A host's wrapper in a worker: the expression, its main slots and its constants."""

    def __init__(self, wrapper: str | None, fixed: list[int] | None, pages: int | None):
        self.text, self.fixed, self.pages, self.known = wrapper, frozenset(fixed or ()), pages or 0, None

    def main(self, page: Page) -> set[int]:
        """Blocks of the page that fill main slots; none if the host has too few pages to tell."""
        if not self.text or self.pages < LEAST_PAGES:
            return set()
        if self.known is None:
            wrapper = json.loads(self.text)
            self.known = numbered(wrapper), frozenset(main_slots(wrapper)), {}
        wrapper, main, seen = self.known
        key, own = shape(page.items), leaves(page.items)
        if key not in seen:
            if len(seen) > 500:
                seen.clear()
            slots = matched(page, wrapper)
            seen[key] = [slots.get(x[2][0]) for x in own]
        return {b for x, s in zip(own, seen[key], strict=True) if s in main for b in x[2]}


NO_WRAPPER = Wrapper(None, None, None)


def main_text(html: str, wrapper: Wrapper = NO_WRAPPER) -> str:
    """The page's main text, blocks joined by an empty line; see the module's order of decisions."""
    page = Page(html)
    found = page.blocks()
    ranks = {i: page.states[i][5] for i, _ in found}
    if max(ranks.values(), default=0) < 2:
        main = wrapper.main(page)
        ranks = {i: 1 if i in main else 0 for i, _ in found}
    for best in sorted(set(ranks.values()), reverse=True):
        at = [(i, t) for i, t in found if ranks[i] == best]
        sure = [(i, t) for i, t in at if not page.states[i][1]]
        chosen = at if best > 1 and 2 * sum(len(t) for _, t in sure) < sum(len(t) for _, t in at) else sure
        if not best and page.opens:
            break
        # texts that most pages of the host share are no part of this one's, unless that would leave less than half: near copies
        own = [t for i, t in chosen if constant(page.paths[i], t) not in wrapper.fixed] if wrapper.fixed else [t for _, t in chosen]
        if 2 * sum(map(len, own)) < sum(len(t) for _, t in chosen):
            own = [t for _, t in chosen]
        if own:
            return "\n\n".join(own)
    return ""


def extract(pages: DataFrame, url: str = "url", html: str = "html", small: int = SMALL_WRAPPERS) -> DataFrame:
    """``pages`` with text and n_chars (its code points) added; columns so named are replaced.

    A null or empty page has an empty text. Pages of one host are read by its wrapper, those with a null or
    unreadable URL by a common one. The hosts' wrappers are broadcast if they take ``small`` bytes at most.
    Tags that never end, unclosed elements and elements nested without bound are read in time in proportion to the page.
    """
    names = without(pages, ["text", "n_chars"]).columns
    wrappers = infer_wrappers(pages, url, html)
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 8 * F.greatest(F.size("fixed"), F.lit(0))), F.lit(0))).first()[0]
    added = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    base = pages.select(*[F.col(f"`{c}`") for c in names])

    def texts(column, known):
        out = [main_text(raw.decode("utf-8", "replace"), w) if raw else "" for raw, w in zip(utf8(column), known, strict=True)]
        return [out, [len(t) for t in out]]

    if size <= small:
        sent = pages.sparkSession.sparkContext.broadcast({r.host: (r.wrapper, r.fixed, r.pages) for r in wrappers.collect()})
        removed(wrappers)

        def fresh():
            known = Known(lambda host: Wrapper(*sent.value[host]) if host in sent.value else NO_WRAPPER, 5000)
            return lambda urls, column: texts(column, [known[(host_of(u),)] for u in urls.to_pylist()])

        return add_columns(base, [url, html], added, fresh)

    def fresh():
        known = Known(lambda text, fixed, pages: Wrapper(text, fixed, pages), 1000)

        def make(wrapper, fixed, count, column):
            return texts(column, [known[(w, tuple(f or ()), n)] for w, f, n in zip(wrapper.to_pylist(), fixed.to_pylist(), count.to_pylist(), strict=True)])

        return make

    @F.pandas_udf("string")
    def host(urls: pd.Series) -> pd.Series:
        return urls.map(host_of)

    mine = {c: f"__lf_{c}" for c in wrappers.columns}
    both = base.withColumn("__lf_host", host(F.col(url))).join(wrappers.withColumnsRenamed(mine), "__lf_host", "left")
    out = add_columns(both, ["__lf_wrapper", "__lf_fixed", "__lf_pages", html], added, fresh)
    return out.select(*[F.col(f"`{c}`") for c in names], "text", "n_chars")


def op1_html(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
