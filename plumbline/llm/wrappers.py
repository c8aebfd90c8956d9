"""Main text of web pages by union-free wrappers inferred for each host.

A page becomes a stream of opening and closing tokens with text slots, kept as a tree;
scripts, styles, comments and inline markup don't count as structure.  Neighbouring
tokens that repeat (one to three of a kind in turn) fold into a repeated group.  Two
streams are aligned level by level: what both have is merged, what one of them lacks
becomes optional, what comes next to its like becomes repeated, and text that differs
makes its slot variable.  Folding all pages of a host so gives its wrapper: a regular
expression without unions, with page counts and text volume for each slot.

Each page is then read against its host's wrapper, which says of each of its texts how
much the host's pages have in that slot and whether it ever varies.  A text's weight is
its own length without links and the slot's mean over the host's pages; text that never
varies over a host's pages (``CONSTANT_PAGES`` or more of different content, so copies
count once) is template and weighs nothing.  The main text stands in the outermost
article or main elements if those hold ``ARTICLE_SHARE`` of the page's weight, otherwise
in the smallest group that holds ``MAIN_SHARE`` of it, with the headings and lead before
it.  From there go menus, footers, sidebars, notices, adverts, forms and reader comments
(by element, role, or class names that say nothing else), and template text; inside an
article only template that isn't a paragraph, heading, list entry or cell.  Of a page
whose every text is template, the template is the text: no rule empties a page.

A class name marks an element if one of its parts is a mark and the others are layout
words ("comment-list", but not "social-science").  Inside an article weak marks (such as
"search" or "social") count only for elements whose text is mostly links.

Wrappers grow in each task first, then by host and salt in steps of ``SALTS``, then by
host, so a host with a third of all pages is spread over tasks, and each step merges
one wrapper after another.  Digits are cut from class names, so numbered ones don't make
wrappers grow with pages.  Pages meet their wrapper as rows of one sorted partition of
(host, salt), the wrapper first and once: nothing is broadcast, and a task holds one
wrapper and one batch of pages.

Defined results: null html is empty html and has empty text; a null url or one without a
host shares the host "".  Repeated pages have equal texts, and equal pages count once for
what is template.  Long pages are read whole; elements nested deeper than ``DEPTH`` are
read as blocks of the one at that depth, as browsers do.  No pages give no rows.  Other
columns pass through; one with a result's name gives way.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import free_name, tidy

SALTS = 32
#: A slot whose text is the same on all pages is the host's own, from this many pages.
CONSTANT_PAGES = 5
MAIN_SHARE = 0.6
ARTICLE_SHARE = 0.2
DEPTH = 200
#: Hosts that a task holds before it passes their wrappers on.
HELD = 500

# Elements of HTML by what they mean here.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PROSE = HEADINGS | frozenset("p blockquote pre figcaption".split())
ENTRIES = PROSE | frozenset("li dt dd td th caption summary".split())
LEADS = frozenset("abstract deck dek excerpt intro lead lede standfirst subtitle summary".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var".split())
CLOSES = {"p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
SKIPPED = frozenset("head title nav footer aside form button select textarea input dialog menu iframe object svg canvas audio video map label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion replies sidebar sponsor sponsored subscribe".split())
WEAK_MARKS = frozenset("banner discussion header related reply respond search share sharing social toolbar widget widgets".split())
#: Parts of class names that say where something is, not what.
LAYOUT = frozenset("area bar block bottom box button buttons container content form group icons inner item items left links list main middle outer page panel post posts right section signup site slot top unit wrap wrapper".split())
#: An article is left out only as one of these.
OTHER_ARTICLES = frozenset("ad ads advert comment comments promo related reply sponsored teaser".split())

#: What may stand in a head; anything else ends it, as text does.
HEAD_CONTENT = frozenset("head base link meta title".split())
#: Elements whose content is no markup and no text of the page.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template")}
#: A form with this share of a page's text is the page's frame.
FORM_SHARE = 0.5

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: Where an open tag ends, or a quoted value begins.
_EDGE = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[-_:]+")
_NUMBERED = re.compile(r"[-_]*[a-z]*[0-9].*", re.S)

NO, WEAK, YES = range(3)


class Node:
    """An element: its head (name and class), whether it is left out, and its children: elements and [text, characters of it in links]."""

    __slots__ = ("children", "head", "name", "open", "skipped")

    def __init__(self, head: str, name: str, skipped: int):
        self.head, self.name, self.skipped, self.children, self.open = head, name, skipped, [], False

    def say(self, piece: str, linked: bool) -> None:
        if self.open:
            self.children[-1][0] += piece
            self.children[-1][1] += len(piece) * linked
        else:
            self.children.append([piece, len(piece) * linked])
            self.open = True


def marked(name: str) -> int:
    """Whether a class name or id says that its element is no main text: ``NO``, ``WEAK`` or ``YES``."""
    parts = [p for p in _PARTS.split(name) if p and not p.isdigit()]
    if not all(p in MARKS or p in WEAK_MARKS or p in LAYOUT for p in parts):
        return NO
    return YES if not MARKS.isdisjoint(parts) else WEAK if not WEAK_MARKS.isdisjoint(parts) else NO


def _open(name: str, rest: str, within: bool) -> Node:
    """``within``: inside an article, where an id is a link's target and says nothing."""
    skipped, head = YES if name in SKIPPED else NO, name
    for m in _ATTRIBUTE.finditer(rest) if rest else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names = value.split()
            if key == "class" and names:
                head += "." + _NUMBERED.sub("", names[0])
            if name == "article":
                skipped = max(skipped, YES if not OTHER_ARTICLES.isdisjoint(names) else NO)
            elif name not in ("html", "body", "main") and (key == "class" or not within and name not in ENTRIES):
                skipped = max(skipped, *map(marked, names), NO)
        elif key == "role":
            skipped = YES if value in ROLES else skipped
        elif key == "style":
            skipped = YES if "display:none" in value.replace(" ", "") else skipped
        elif key in ("hidden", "aria-hidden") and value != "false":
            skipped = YES
    return Node(head, name, skipped)


def tokens(page: str) -> Iterator[tuple[str | None, str]]:
    """(None, text) and (name, attributes) in page order, end tags with a slash before their name; each character is looked at a few times at most.

    A quote that isn't closed ends with its tag, at the next ``>``; a tag without any ends where the next one begins.
    """
    at, size, last = 0, len(page), page.rfind(">")
    closed = {"'": True, '"': True}
    while at < size:
        start = page.find("<", at)
        if start != at:
            yield None, page[at:] if start < 0 else page[at:start]
        if start < 0:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        m = _NAME.match(page, start + 1)
        if m is None:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                at = size if start > last else page.find(">", start) + 1
            else:
                yield None, "<"
                at = start + 1
            continue
        end, here = -1, m.end()
        while here <= last and end < 0 and (edge := _EDGE.search(page, here)):
            quote = edge[0][-1]
            if quote == ">":
                end = edge.start()
                break
            close = page.find(quote, edge.end()) if closed[quote] else -1
            if close < 0:
                closed[quote] = False
                end = page.find(">", edge.end())
                break
            here = close + 1
        if end < 0:
            end = page.find("<", m.end())
            end = size if end < 0 else end
            at = end
        else:
            at = end + 1
        name = m[0].lower()
        if name in RAW:
            stop = RAW[name].search(page, at)
            at = stop.end() if stop else size
            continue
        yield name, page[m.end() : end]


class _Stack:
    """Open elements.  Below ``DEPTH`` they don't become nodes of their own; what is asked of them is kept in counts."""

    def __init__(self, top: Node):
        self.nodes, self.names, self.deep_skipped, self.articles = [top], {}, 0, 0

    @property
    def node(self) -> Node:
        return self.nodes[min(len(self.nodes), DEPTH) - 1]

    def push(self, node: Node) -> None:
        above = self.node
        above.open = False
        if len(self.nodes) < DEPTH:
            above.children.append(node)
        else:
            self.deep_skipped += node.skipped == YES
        self.nodes.append(node)
        self.names[node.name] = self.names.get(node.name, 0) + 1
        self.articles += node.name == "article"

    def pop(self) -> str:
        node = self.nodes.pop()
        if len(self.nodes) >= DEPTH:
            self.deep_skipped -= node.skipped == YES
        self.names[node.name] -= 1
        self.articles -= node.name == "article"
        return node.name

    def close(self, name: str) -> None:
        """Up to the last open element of a name, if there is one."""
        if self.names.get(name):
            self.node.open = False
            while self.pop() != name:
                pass
            self.node.open = False


def parse(page: str | None) -> Node:
    top = Node("", "", NO)
    stack, linked, forms = _Stack(top), False, []
    for name, rest in tokens(page or ""):
        if name is None:
            if stack.nodes[-1].name == "head" and not rest.isspace():
                stack.close("head")
            if not stack.deep_skipped:
                stack.node.say(rest, linked)
            continue
        if name[0] == "/":
            name = name[1:]
            if name == "a":
                linked = False
            if name not in INLINE and name not in VOID:
                stack.close(name)
            continue
        if name not in HEAD_CONTENT and stack.names.get("head"):
            stack.close("head")
        if name == "br":
            stack.node.say(" ", False)
            continue
        if name in INLINE:
            linked = True if name == "a" else linked
            continue
        if stack.nodes[-1].name in CLOSES and name in CLOSES[stack.nodes[-1].name]:
            stack.pop()
        if name in VOID:
            continue
        node = _open(name, rest, stack.articles > 0)
        if name == "form" and len(stack.nodes) < DEPTH:
            forms.append(node)
        stack.push(node)
    if forms:
        whole = _letters(top)
        for form in forms:
            if _letters(form) >= FORM_SHARE * whole:
                form.skipped = NO
    return top


def _letters(node: Node) -> int:
    """Characters of text in an element, those of the head apart."""
    total, todo = 0, [node]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, list):
                total += len(child[0]) - child[0].count(" ") - child[0].count("\n")
            elif child.name != "head":
                todo.append(child)
    return total


def clean(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


# A wrapper is a list: head, repeated, pages that have it, text's hash ("" if it varies or there is none), volume of text, of that in links, left out, children, and of a text that doesn't vary the smallest hashes (up to CONSTANT_PAGES) of different pages that have it.
HEAD, REPEATED, PAGES, TEXT, VOLUME, LINKED, SKIP, KIDS, SEEN = range(9)


def lift(node: Node) -> list:
    stream, seen = xxhash.xxh64(), []  # all slots of the page share what is known only at its end
    one = _lift(node, stream, seen)
    seen.append(stream.intdigest())
    return one


def _lift(node: Node, stream: xxhash.xxh64, seen: list[int]) -> list:
    kids: list[list] = []
    stream.update(f"<{node.head}>".encode("utf-8", "surrogatepass"))
    for child in node.children:
        if isinstance(child, list):
            text = clean(child[0])
            if not text:
                continue
            body = text.encode("utf-8", "surrogatepass")
            stream.update(body)
            kids.append(["#", 0, 1, xxhash.xxh64_hexdigest(body), len(text), min(len(text), child[1]), 0, [], seen])
        else:
            kids.append(_lift(child, stream, seen))
        _fold(kids)
    stream.update(b"</>")
    return [node.head, 0, 1, "", 0, 0, node.skipped, kids, []]


def _fold(kids: list[list]) -> None:
    """Merges what has just come with what it repeats: one, two or three of a kind in turn."""
    for k in (1, 2, 3):
        if len(kids) >= 2 * k and all(kids[-i][HEAD] == kids[-i - k][HEAD] for i in range(1, k + 1)):
            for i in range(k, 0, -1):
                one = merge(kids[-i - k], kids[-i], again=True)
                one[REPEATED] = 1
                kids[-i - k] = one
            del kids[-k:]
            return


def merge(a: list, b: list, again: bool = False) -> list:
    """The wrapper of what two wrappers with the same head match; ``again``: both on one page."""
    same = a[TEXT] if a[TEXT] == b[TEXT] else ""
    pages = max(a[PAGES], b[PAGES]) if again else a[PAGES] + b[PAGES]
    seen = [] if not same else a[SEEN] if a[SEEN] is b[SEEN] else sorted({*a[SEEN], *b[SEEN]})[:CONSTANT_PAGES]
    return [a[HEAD], a[REPEATED] | b[REPEATED], pages, same, a[VOLUME] + b[VOLUME], a[LINKED] + b[LINKED], min(a[SKIP], b[SKIP]), align(a[KIDS], b[KIDS], again), seen]


def align(a: list[list], b: list[list], again: bool = False) -> list[list]:
    """One list of siblings from two: what both have in the same order is merged, the rest is optional."""
    if [x[HEAD] for x in a] == [x[HEAD] for x in b]:
        return [merge(x, y, again) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for x, y in [*common([x[HEAD] for x in a], [x[HEAD] for x in b]), (len(a), len(b))]:
        for one in (*a[i:x], *b[j:y]):
            out.append(one)
            _fold(out)
        if x < len(a):
            out.append(merge(a[x], b[y], again))
            _fold(out)
        i, j = x + 1, y + 1
    return out


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence: the same start and end, and between them the longest in which like meets like by its count.

    Takes n log n steps, also where nothing is alike.
    """
    least = min(len(a), len(b))
    start = next((k for k in range(least) if a[k] != b[k]), least)
    end = next((k for k in range(least - start) if a[-1 - k] != b[-1 - k]), least - start)
    spots: dict[str, list[int]] = {}
    for j in range(len(b) - end - 1, start - 1, -1):
        spots.setdefault(b[j], []).append(j)
    tails: list[int] = []  # of the runs of each length so far, the least last place in b
    last: list[tuple[int, int, tuple | None]] = []
    for i in range(start, len(a) - end):
        if spots.get(a[i]):
            j = spots[a[i]].pop()
            k = bisect_left(tails, j)
            tails[k : k + 1] = [j]
            last[k : k + 1] = [(i, j, last[k - 1] if k else None)]
    middle, link = [], last[-1] if last else None
    while link:
        middle.append(link[:2])
        link = link[2]
    return [(k, k) for k in range(start)] + middle[::-1] + [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]


def expression(wrapper: list, above: int | None = None) -> str:
    """The wrapper as a union-free regular expression."""
    pages = wrapper[PAGES]
    if wrapper[HEAD] == "#":
        inner = "TEXT" if not wrapper[TEXT] else "'" + wrapper[TEXT] + "'"
    else:
        inner = f"<{wrapper[HEAD]}>" + "".join(expression(k, pages) for k in wrapper[KIDS]) + f"</{wrapper[HEAD]}>"
    mark = ("+" if wrapper[REPEATED] else "") + ("?" if above and pages < above else "")
    return f"({inner}){mark}" if mark else inner


def dump(wrapper: list) -> str:
    """As JSON: what is below the root as one list of rows, each with its depth before it."""
    rows: list[list] = []
    stack = [(1, k) for k in reversed(wrapper[KIDS])]
    while stack:
        depth, node = stack.pop()
        rows.append([depth, *node[:KIDS], node[SEEN]])
        stack += [(depth + 1, k) for k in reversed(node[KIDS])]
    return json.dumps([*wrapper[:KIDS], rows, wrapper[SEEN]], separators=(",", ":"))


def load(text: str) -> list:
    top = json.loads(text)
    rows, top[KIDS] = top[KIDS], []
    path = [top]
    for depth, *node, seen in rows:
        del path[depth:]
        path[-1][KIDS].append([*node, [], seen])
        path.append(path[-1][KIDS][-1])
    return top


class Leaf:
    """A text of a page: its slot's weight, whether that is template, and what holds it."""

    __slots__ = ("article", "constant", "holder", "linked", "main", "skipped", "text", "weight")

    def __init__(self, text: str, linked: int, holder: str, inside: tuple[bool, bool, bool]):
        self.text, self.linked, self.holder, (self.article, self.main, self.skipped) = text, linked >= len(text), holder, inside
        self.weight, self.constant = float(max(len(text) - linked, 0)), False

    @property
    def menu(self) -> bool:
        """Text that is all links is text in a paragraph or heading, elsewhere a menu."""
        return self.linked and self.holder not in PROSE


class Extractor:
    """Reads pages of one host."""

    def __init__(self, wrapper: list):
        self.wrapper = wrapper
        self.places: dict[int, dict[str, list[int]]] = {}

    def __call__(self, page: str | None) -> str:
        top, leaves = parse(page), []
        tree = self._read(top, self.wrapper, (False, False, False), leaves, set())
        able = [x for x in leaves if not x.skipped]
        if all(x.constant for x in able):
            for x in able:
                x.constant = False
        for x in able:
            x.weight = 0.0 if x.constant else x.weight
        total = sum(x.weight for x in able)
        anchored = [x for x in able if x.article or x.main]
        if anchored and sum(x.weight for x in anchored) >= ARTICLE_SHARE * total:
            chosen = [x for x in anchored if (x.article and (not x.constant or x.holder in ENTRIES)) or (not x.article and not x.constant and not x.menu)]
        else:
            chosen = [x for x in self._block(tree) if not x.constant and not x.menu]
        # what is left may be nothing but links or template: the page's text all the same
        chosen = chosen or anchored or able
        return "\n".join(x.text for x in chosen)

    def _read(self, node: Node, wrapper: list | None, inside: tuple[bool, bool, bool], leaves: list[Leaf], met: set[int]) -> list:
        """[node, weight, children, leaves]: the page's tree with its texts, each looked up in the wrapper."""
        article, main, skipped = inside[0] or node.name == "article", inside[1] or node.name == "main", inside[2] or node.skipped == YES
        within = article or main
        if node.skipped == WEAK:
            skipped |= not within or _mostly_links(node)
        inside = article, main, skipped or (node.name == "header" and not within)
        known, at = self._places(wrapper) if wrapper else {}, 0
        tree: list = [node, 0.0, []]
        for child in node.children:
            plain = isinstance(child, list)
            text = clean(child[0]) if plain else ""
            if plain and not text:
                continue
            spots = known.get("#" if plain else child.head)
            slot = None
            if spots:  # the next such token, or the last one before it of a repeated group
                k = bisect_left(spots, at)
                at = spots[k] if k < len(spots) else spots[-1]
                slot = wrapper[KIDS][at]
            if plain:
                leaf = Leaf(text, child[1], node.name, inside)
                if slot:
                    leaf.constant = len(slot[SEEN]) >= CONSTANT_PAGES
                    if id(slot) not in met:  # the host's mean counts once a page
                        met.add(id(slot))
                        leaf.weight += max(slot[VOLUME] - slot[LINKED], 0) / slot[PAGES]
                leaves.append(leaf)
                tree[2].append(leaf)
            else:
                tree[2].append(self._read(child, slot, inside, leaves, met))
        return tree

    def _places(self, wrapper: list) -> dict[str, list[int]]:
        found = self.places.get(id(wrapper))
        if found is None:
            found = self.places[id(wrapper)] = {}
            for i, k in enumerate(wrapper[KIDS]):
                found.setdefault(k[HEAD], []).append(i)
        return found

    def _block(self, tree: list) -> list[Leaf]:
        """Texts of the smallest group with most of the weight, and of the headings and lead before it."""
        weigh(tree)
        total, headings, lead = tree[1], [], []
        while total:
            kids = [k for k in tree[2] if isinstance(k, list)]
            deeper = next((k for k in kids if k[1] >= MAIN_SHARE * total), None)
            # a block that comes again next to its like is the text itself, and so is one without blocks
            if deeper is None or not any(isinstance(k, list) for k in deeper[2]) or sum(k[0].head == deeper[0].head for k in kids) > 1:
                break
            before = kids[: next(i for i, k in enumerate(kids) if k is deeper)]
            headings += [k for k in before if k[0].name in HEADINGS]
            lead = [k for k in before if k[1] and prose(k)] or lead
            tree = deeper
        seen: dict[int, Leaf] = {}
        for part in (*headings, *lead, tree):
            for x in texts(part):
                seen.setdefault(id(x), x)
        return [x for x in seen.values() if not x.skipped]


def _mostly_links(node: Node) -> bool:
    every = linked = 0
    for n in _nodes(node):
        for c in n.children:
            if isinstance(c, list):
                size = len(clean(c[0]))
                every, linked = every + size, linked + min(size, c[1])
    return 2 * linked >= every


def _nodes(node: Node) -> Iterator[Node]:
    yield node
    for c in node.children:
        if isinstance(c, Node):
            yield from _nodes(c)


def weigh(tree: list) -> float:
    tree[1] = sum((0.0 if k.skipped else k.weight) if isinstance(k, Leaf) else weigh(k) for k in tree[2])
    return tree[1]


def texts(tree: list) -> Iterator[Leaf]:
    for k in tree[2]:
        if isinstance(k, Leaf):
            yield k
        else:
            yield from texts(k)


def prose(tree: list) -> bool:
    node = tree[0]
    return node.name in PROSE or bool(LEADS.intersection(node.head.split(".")[1:])) or any(prose(k) for k in tree[2] if isinstance(k, list))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def infer(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, wrapper): the wrapper, as JSON, of all pages of each host."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = lift(parse(page.as_py()))
                found[host] = merge(found[host], one) if host in found else one
                if len(found) > HELD:
                    yield _packed(found)
                    found = {}
        yield _packed(found)

    def join(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        whole = None
        for text in sorted(parts.column("wrapper").to_pylist()):  # a fixed order: the same wrapper each time
            one = load(text)
            whole = merge(whole, one) if whole else one
        return pa.Table.from_batches([_packed({key[0].as_py(): whole})])

    found = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html")).mapInArrow(grow, "host string, wrapper string")
    for salts in (SALTS * SALTS, SALTS):
        salted = found.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
        found = salted.groupBy("host", "salt").applyInArrow(join, "host string, wrapper string")
    return found.groupBy("host").applyInArrow(join, "host string, wrapper string")


def _packed(found: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"host": pa.array(list(found), pa.string()), "wrapper": pa.array([dump(v) for v in found.values()], pa.string())})


def extract(pages: DataFrame, html: str = "html", url: str = "url", into: str = "text") -> DataFrame:
    """Adds the main text of each page."""
    wrappers = infer(pages, html, url)
    host, wrapper, salt = (free_name(pages, n) for n in ("host", "wrapper", "salt"))
    # every wrapper is there SALTS times, so a host's pages meet it in as many tasks
    held = wrappers.select(F.col("host").alias(host), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt), F.col("wrapper").alias(wrapper))
    dealt = pages.withColumn(host, host_of(pages[f"`{url}`"])).withColumn(salt, F.pmod(F.xxhash64(f"`{url}`", F.octet_length(f"`{html}`")), F.lit(SALTS)).cast("int"))
    together = dealt.unionByName(held, allowMissingColumns=True).repartition(F.col(host), F.col(salt)).sortWithinPartitions(host, salt, F.col(wrapper).isNull())
    keep = [c for c in pages.columns if c.lower() != into.lower()]
    kind = T.StructType([T.StructField(c, pages.schema[c].dataType) for c in keep] + [T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Extractor(lift(parse("")))
        for batch in batches:
            rows, out = [], []
            bodies, found = batch.column(html), batch.column(wrapper)
            for i in range(batch.num_rows):
                if found[i].is_valid:
                    read = Extractor(load(found[i].as_py()))
                else:
                    rows.append(i)
                    out.append(read(bodies[i].as_py()))
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in keep] + [pa.array(out, pa.string())], names=[*keep, into])
        tidy()

    return together.mapInArrow(run, kind)
