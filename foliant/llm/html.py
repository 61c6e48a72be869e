"""Main text of web pages by union-free regular expressions inferred per host.

A page is a stream of tags and texts. Every page's stream is first folded: neighbouring equal groups
become one repeated group. The streams of a host are then aligned one after another with its wrapper:
what both have stays, texts that differ become slots, and stretches that only one side has become
optional groups, after which repeats are folded again. A wrapper is thus a union-free regular
expression over tags, slots, repeated and optional groups. Partitions fold their own pages first;
the partial wrappers of a host are then aligned with each other in rounds, so no task ever reads all
pages of a large host. Every page takes part.

Texts enter the streams as hashes with a count of pages: an equal text at the same place of two pages
stays and its counts are added, differing ones become a slot. A slot, which in a repeated group stands
for many places, remembers its most frequent texts with their pages (``SLOT_TEXTS`` of them at least; a text on a
good share of the pages is among these, for one that is rare goes first). A text that stands at one
place on at least ``LEAST_PAGES`` pages and on ``TEMPLATE_SHARE`` of the host's is the host's template.

The wrapper tells where a host keeps its article: an ``article`` or ``main`` element if it has one,
and otherwise the container whose slots held the most text, counted over all pages without template
texts, outside of what is boilerplate by its element or by its class and id names. A page's stream is
then matched to the wrapper, and its text is what fills the slots, optional and repeated groups of
that container, without nested boilerplate. A page in which template texts outweigh what fills the
slots is a near copy of its host's other pages and keeps all its text. A host may have several
templates: every label under which its articles stand counts, and each page takes the one that holds
most of its own text. Pages whose own structure lacks all containers fall back to their body.

Labels are elements with their classes and roles, numbers in them generalised; ids are left out. A level
of more than ``WIDE`` items in no regular order becomes one repeated group of optional items, one of each
label, whose slots remember texts like any other; with more labels than that it falls back to the
elements' names. An element below ``DEEP`` others is listed with what it holds at the level above it, so
its texts take part, and it can be a container, at any depth.

Null html counts as empty, and an empty page has an empty text. Pages with a null url or without a
host share the host "". Repeated rows give equal rows, rows with a null id are extracted like any
other, unclosed and stray tags are closed where their parent ends, and an empty table gives an empty
result. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._shared import durable, require, slices, table

#: Elements that never hold a page's main text.
SKIP = frozenset("script style noscript template head title nav header footer aside form button select option textarea iframe svg canvas object dialog menu".split())
#: Words in class, id and role values that mark boilerplate.
SKIP_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios consent
cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo related
reply replies respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo""".split())
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Levels of elements that a wrapper describes, and items of one element that it keeps in order.
DEEP, WIDE = 160, 64
#: Texts that a slot remembers with the number of their pages.
SLOT_TEXTS = 512
#: Paths of a host's containers that are told apart by their classes.
MANY = 4096
#: Least pages, and least share of a host's pages, on which a text that never differs is its template.
LEAST_PAGES, TEMPLATE_SHARE = 3, 0.5
#: Least share of the largest container's text at which another one is a container of articles, too.
SUPPORT = 0.01
#: Blocks that hold text for the container around them.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr dt dd".split())
#: Opening one of these ends an open element of the same kind.
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.DOTALL)
_NAMES = re.compile(r"(?<![\w:.-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")
#: Elements that no name makes boilerplate.
HOLDERS = frozenset(("html", "body", "main", "article"))


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", element, names), ("close", element, "") or ("text", text, ""), in page order."""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        # An id is told from classes and roles by the sign before it.
        found = [(a.lower() == "id", x) for a, *g in _NAMES.findall(m[3]) for x in next(filter(None, g), "").split()] if m[3] else []
        names = " ".join(f"#{x}" if own else x.lstrip("#") for own, x in found)
        yield "open", name, names.lower()
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            yield "close", name, ""


def is_boilerplate(element: str, names: str) -> bool:
    return element in SKIP or named_boilerplate(element, names)


@lru_cache(65_536)
def named_boilerplate(element: str, names: str) -> bool:
    """Whether a whole class, id or role name marks the element."""
    return element not in HOLDERS and not SKIP_NAMES.isdisjoint(x.lstrip("#") for x in names.split())


@lru_cache(65_536)
def _label(element: str, names: str) -> str:
    classes = sorted({_DIGITS.sub("0", x) for x in names.replace("/", "|").split() if x[0] != "#"})
    return f"{element}.{'.'.join(classes)}" if classes else element


def _bare(label: str) -> str:
    """The label of an element whatever its classes."""
    return label.split(".")[0] + ".*"


#: What stands for the element around a page's first one.
NOWHERE = ("", "", False, False, "", "", False)


def walk(page: str) -> Iterator[tuple[str, list, str]]:
    """("open" | "close" | "text", open elements, text).

    An open element is (element, label, boilerplate by element, boilerplate by name, path, path of the container that
    its text counts for, whether it or one around it is boilerplate by its element).
    """
    stack: list[tuple[str, str, bool, bool, str, str, bool]] = []
    for kind, value, names in tokens(page):
        if kind == "text":
            yield kind, stack, value
        elif kind == "open":
            if value in VOID:
                yield "void", stack, value
                continue
            if value in CLOSES_ITSELF:
                # An unclosed item ends where the next one starts, unless a list or table lies between.
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == value:
                        while len(stack) > i:
                            yield "close", stack, ""
                            stack.pop()
                        break
                    if stack[i][0] not in INLINE:
                        break
            label, named = _label(value, names), named_boilerplate(value, names)
            _, _, _, _, path, holder, skipped = stack[-1] if stack else NOWHERE
            if named or value not in INLINE:
                own = f"{path}/{'!' if named else ''}{label}" if path else f"{'!' if named else ''}{label}"
                # The text counts for the container, not for the paragraph that holds it.
                path, holder = own, path if not named and value in LEAVES else own
            stack.append((value, label, value in SKIP, named, path, holder, skipped or value in SKIP))
            yield "open", stack, ""
        else:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == value:
                    while len(stack) > i:
                        yield "close", stack, ""
                        stack.pop()
                    break


# A wrapper is a list of items: "#" (a text slot), "=hash*pages*characters" (a text that stayed), ["<", label, items]
# (an element), ["+", items] (a group that repeats) and ["?", items] (a group that may be absent).

class Text(str):
    """A text or slot, with the texts that it stands for as hash: (pages, characters), and, in the stream of one
    page, the numbers of that page's text tokens by hash."""

    texts: dict[str, tuple[int, int]] = {}
    own: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of(cls, value: str, texts: dict[str, tuple[int, int]] | None = None, own: dict[str, tuple[int, ...]] | None = None) -> Text:
        out = cls(value)
        out.texts, out.own = texts or {}, own or {}
        return out


def _texts_of(item: str) -> dict[str, tuple[int, int]]:
    texts = getattr(item, "texts", None)
    if not texts and item[0] == "=":
        h, n, c = item.split("*")
        return {h: (int(n), int(c))}
    return texts or {}


def dumps(items: list) -> str:
    """A wrapper as JSON, without the numbers of any page's texts."""

    def plain(some):
        return [{"#": x.texts} if x == "#" and getattr(x, "texts", None) else x if isinstance(x, str) else [*x[:-1], plain(x[-1])] for x in some]

    return json.dumps(plain(items), separators=(",", ":"))


def loads(text: str) -> list:
    return json.loads(text, object_hook=lambda d: Text.of("#", {h: (n, c) for h, (n, c) in d["#"].items()}) if "#" in d else d)


def _key(item) -> str:
    return item if isinstance(item, str) else json.dumps(item, separators=(",", ":"))


class Node(list):
    """An item of a finished stretch, which keeps its shape once it is known."""

    __slots__ = ("shape",)


def _shape(item) -> str:
    """What an item is without its texts."""
    if isinstance(item, str):
        return "#"
    shape = getattr(item, "shape", None)
    if shape is None:
        shape = f"{' '.join(item[:-1])}({' '.join(map(_shape, item[-1]))})"
        if isinstance(item, Node):
            item.shape = shape
    return shape


def _text(left: str, right: str, pages: bool) -> str:
    """What stands for two texts; counts are added for texts of different pages."""
    a, b = _texts_of(left), _texts_of(right)
    if not a and not b:
        return "#"
    texts = a or dict(b)  # what is merged into grows in place
    if a:
        for h, (n, c) in b.items():
            known = texts.get(h)
            texts[h] = (n, c) if known is None else (known[0] + n if pages else max(known[0], n), c)
        if len(texts) > 2 * SLOT_TEXTS:
            kept = sorted(texts.items(), key=lambda x: (-x[1][0], x[0]))[:SLOT_TEXTS]
            texts.clear()
            texts.update(kept)
    own, more = getattr(left, "own", None), getattr(right, "own", None)
    if own and more:
        for h, ids in more.items():
            own[h] = own[h] + ids if h in own else ids
    own = own or more
    if left[0] == right[0] == "=" and len(texts) == 1:
        ((h, (n, c)),) = texts.items()
        return Text.of(f"{h}*{n}*{c}", texts, own)
    return left if left == "#" and a else Text.of("#", texts, own)


def _same(left: list, right: list, pages: bool) -> list:
    """One list for two of one shape."""
    out = type(left)()
    for x, y in zip(left, right):
        if isinstance(x, list):
            out.append(_same(x, y, pages))
        else:
            out.append(_text(x, y, pages) if x[:1] in ("#", "=") and y[:1] in ("#", "=") else x)
    return out


def fold(items: list, widest: int = 12) -> list:
    """Neighbouring equal groups become one repeated group, the narrowest groups first."""
    for width in range(1, widest + 1):
        if len(items) < 2 * width:
            break
        keys = [_shape(x) for x in items]
        out, shapes, i = [], [], 0
        while i < len(items):
            group, j = keys[i : i + width], i + width
            while keys[j : j + width] == group:
                j += width
            inner = items[i : i + width]
            if j > i + width:
                for k in range(i + width, j, width):
                    inner = _same(inner, items[k : k + width], False)
                out.append(inner[0] if width == 1 and inner[0][0] == "+" else Node(("+", inner)))
                shapes.append(group if out[-1][1] is inner else None)
                i = j
            elif out and out[-1][0] == "+" and (shapes[-1] or [_shape(x) for x in out[-1][1]]) == group:
                out[-1] = Node(("+", _same(out[-1][1], inner, False)))  # one more of a group that is known to repeat
                i = j
            else:
                out.append(items[i])
                shapes.append(None)
                i += 1
        items = out
    return items if len(items) <= WIDE else squeeze(items)


def is_bag(items: list) -> bool:
    """Whether the items are one group in no regular order."""
    return len(items) == 1 and _kind(items[0]) == "*"


def _bag(items: list) -> dict:
    """One item of each kind for the items of one page or wrapper, whatever their order."""
    kinds: dict[str, list] = {}

    def add(some: list) -> None:
        for x in some:
            if x[0] in "+?":
                add(x[1])
            else:
                kinds[_kind(x)] = _one(kinds[_kind(x)], x, False) if _kind(x) in kinds else x

    add(items)
    if len(kinds) > WIDE:
        some, kinds = list(kinds.values()), {}
        add([["<", _bare(x[1]), x[2]] if x[0] == "<" else x for x in some])
    return kinds


def squeeze(*sides: list) -> list:
    """Items in no regular order, as one group that repeats and may hold one of each kind; the sides are of different pages."""
    kinds: dict[str, list] = {}
    for bag in map(_bag, sides):
        for k, x in bag.items():
            kinds[k] = _one(kinds[k], x, True) if k in kinds else x
    if len(kinds) > WIDE:
        kinds = _bag(list(kinds.values()))
    return [["+", [["?", [kinds[k]]] for k in sorted(kinds)]]]


def skeleton(page: str, texts: bool = False) -> tuple[list, dict[str, int]]:
    """A page's folded stream, and its characters of text by the path of the container that holds them.

    A label in a path starts with "!" if its names mark it as boilerplate.

    With ``texts`` the stream tells its texts apart by hash; without, every text is a slot.
    """
    root: list = []
    levels = [root]
    mass: dict[str, int] = {}
    run: list[tuple[int, str]] = []
    number = -1

    def end_of_run() -> None:
        if run:
            whole = " ".join(entities.unescape("".join(t for _, t in run)).split())
            h = f"={xxhash.xxh3_64_hexdigest(whole.encode('utf-8', 'surrogatepass'))}"
            n = sum(len(t.strip()) for _, t in run)
            levels[-1].append(Text.of(f"{h}*1*{n}", {h: (1, n)}, {h: tuple(i for i, _ in run)}))
            run.clear()

    def close(levels: list) -> None:
        done = levels.pop()
        if done is not levels[-1]:
            done[:] = fold(done)

    for kind, stack, value in walk(page):
        if kind == "text":
            number += 1
            n = len(value.strip())
            if texts and (n or run):
                run.append((number, value))
            if not n:
                continue
            if not texts and levels[-1][-1:] != ["#"]:
                levels[-1].append("#")
            *_, holder, skipped = stack[-1] if stack else NOWHERE
            if not skipped:
                mass[holder] = mass.get(holder, 0) + n
        elif kind == "void" or stack[-1][0] in INLINE:
            if run:
                run.append((number, " " if kind == "void" else ""))
            continue
        elif kind == "open":
            end_of_run()
            # What lies deeper belongs to the element at the last level that a wrapper describes.
            inner: list = [] if len(levels) < DEEP else levels[-1]
            if inner is not levels[-1]:
                levels[-1].append(Node(("<", stack[-1][1], inner)))
            levels.append(inner)
        else:
            end_of_run()
            close(levels)
    end_of_run()
    while len(levels) > 1:
        close(levels)
    return fold(root), mass


def _add_mass(total: dict[str, int], mass: dict[str, int]) -> dict[str, int]:
    """Adds ``mass`` to ``total``; where paths get too many, to those of the elements' names."""
    for k, v in mass.items():
        total[k] = total.get(k, 0) + v
    if len(total) > MANY:
        few: dict[str, int] = {}
        for k, v in total.items():
            k = "/".join(_bare(x) for x in k.split("/")) if k else k
            few[k] = few.get(k, 0) + v
        total.clear()
        total.update(few)
    return total


def _kind(item) -> str:
    """What an item is matched by: an element by its label, whether it repeats or not."""
    if isinstance(item, str):
        return "#"
    if item[0] == "<":
        return f"<{item[1]}"
    if item[0] == "+" and all(x[0] == "?" for x in item[1]):
        return "*"
    return " ".join(_kind(x) for x in item[1])


def _one(left, right, pages: bool = True):
    """The item that stands for two of one kind."""
    if isinstance(left, str):
        return _text(left, right, pages)
    if left[0] == "+" or right[0] == "+":
        a, b = (x[1] if x[0] == "+" else [x] for x in (left, right))
        return ["+", align(a, b, pages)]
    return ["<", left[1], align(left[2], right[2], pages)]


def _strip(items: list) -> list[tuple[bool, list | str]]:
    """(optional, item): an optional group is matched by what it holds."""
    return [(o, z) for y in items for o, z in ([(True, z) for z in y[1]] if y[0] == "?" else [(False, y)])]


def _opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    return [("equal", 0, len(a), 0, len(b))] if a == b else SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def align(left: list, right: list, pages: bool = True) -> list:
    """One list for both: items of one kind stay and are aligned inside, all others become optional."""
    if left == right:
        return _same(left, right, pages)
    if pages and (is_bag(left) or is_bag(right)):
        return squeeze(left, right)
    out: list = []

    def add(optional: bool, items: list) -> None:
        if optional and items and out and out[-1][0] == "?":
            out[-1][1].extend(items)
        elif optional and items:
            out.append(["?", list(items)])
        else:
            out.extend(items)

    a, b = _strip(left), _strip(right)
    for tag, i, j, k, m in _opcodes([_kind(x) for _, x in a], [_kind(x) for _, x in b]):
        if tag == "equal":
            for (o1, x), (o2, y) in zip(a[i:j], b[k:m]):
                add(o1 or o2, [_one(x, y, pages)])
        else:
            add(True, [x for _, x in a[i:j]])
            add(True, [y for _, y in b[k:m]])
    if sum(len(x[1]) if x[0] == "?" else 1 for x in out) > WIDE:
        return squeeze(left, right) if pages else squeeze(out)
    return fold(out)


def literals_of(items: list, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(labels around it, pages, characters) of every text that stayed or that a slot remembers."""
    for x in items:
        if isinstance(x, str):
            yield from ((path, n, c) for n, c in _texts_of(x).values())
        else:
            yield from literals_of(x[2], (*path, x[1])) if x[0] == "<" else literals_of(x[1], path)


def only_template(items: list, pages: int) -> list:
    """The wrapper with the texts of the host's template alone; all others are slots."""
    least = max(LEAST_PAGES, TEMPLATE_SHARE * pages)

    def text(x: str) -> str:
        kept = {h: v for h, v in _texts_of(x).items() if v[0] >= least}
        return x if kept and x[0] == "=" else Text.of("#", kept) if kept else "#"

    return [text(x) if isinstance(x, str) else [*x[:-1], only_template(x[-1], pages)] for x in items]


def template_texts(wrapper: list, page: list, pages: int) -> set[int]:
    """Numbers of the page's texts that the wrapper holds as the host's template."""
    least = max(LEAST_PAGES, TEMPLATE_SHARE * pages)
    found: set[int] = set()

    def text(slot: str, x: str) -> None:
        known = _texts_of(slot)
        for h, ids in getattr(x, "own", {}).items():
            if known.get(h, (0,))[0] >= least:
                found.update(ids)

    def in_bag(kinds: dict, some: list) -> None:
        for x in some:
            if not isinstance(x, str) and x[0] in "+?":
                in_bag(kinds, x[1])
                continue
            of = kinds.get(_kind(x)) or (kinds.get(f"<{_bare(x[1])}") if x[0] == "<" else None)
            if of is not None and isinstance(x, str):
                text(of, x)
            elif of is not None:
                match(of[2], x[2])

    def match(left: list, right: list) -> None:
        if is_bag(left):
            in_bag({_kind(y[1][0]): y[1][0] for y in left[0][1]}, right)
            return
        a, b = [x for _, x in _strip(left)], [x for _, x in _strip(right)]
        for tag, i, j, k, m in _opcodes([_kind(x) for x in a], [_kind(x) for x in b]):
            for x, y in zip(a[i:j], b[k:m]) if tag == "equal" else ():
                if isinstance(x, str):
                    text(x, y)
                elif x[0] == "<" == y[0]:
                    match(x[2], y[2])
                else:
                    match(*(z[1] if z[0] == "+" else [z] for z in (x, y)))

    match(wrapper, page)
    return found


def merge(wrappers: Iterator[tuple[list, dict[str, int]]], once: bool = True) -> tuple[list, dict[str, int]]:
    """Fold many wrappers into one, in a fixed order; equal ones are aligned once, or else each."""
    mass: dict[str, int] = {}
    distinct: dict[str, list] = {}
    for w, m in wrappers:
        k = _key(w)
        distinct[k] = distinct[k] if once and k in distinct else _same(distinct[k], w, True) if k in distinct else w
        _add_mass(mass, m)
    result: list | None = None
    for k in sorted(distinct, key=lambda k: (-len(k), k)):
        result = distinct[k] if result is None else align(result, distinct[k])
    return result or [], mass


def has_template(wrapper: list, pages: int) -> bool:
    """Whether any text outside of what is boilerplate by its element is the host's template."""
    least = max(LEAST_PAGES, TEMPLATE_SHARE * pages)
    return any(n >= least and SKIP.isdisjoint(x.split(".")[0] for x in path) for path, n, _ in literals_of(wrapper))


def slot_mass(wrapper: list, mass: dict[str, int], pages: int) -> dict[str, int]:
    """``mass`` without the host's template texts."""
    left = dict(mass)
    plain = {_plain_path(k): k for k in mass}
    for path, n, chars in literals_of(wrapper):
        if n >= max(LEAST_PAGES, TEMPLATE_SHARE * pages):
            if path and path[-1].split(".")[0] in LEAVES:
                path = path[:-1]
            k = plain.get("/".join(path))
            if k is not None:
                left[k] = max(0, left[k] - n * chars)
    return left if any(left.values()) else mass


def _plain_path(path: str) -> str:
    return "/".join(x.removeprefix("!") for x in path.split("/"))


def overruled(mass: dict[str, int]) -> list[str]:
    """Labels that names mark as boilerplate but that hold most of what fills the slots.

    A host with text in an ``article`` or ``main`` needs none.
    """
    if any(v for k, v in mass.items() if "!" not in k and any(x.split(".")[0] in ("article", "main") for x in k.split("/"))):
        return []
    held: dict[str, int] = {}
    for k, v in mass.items():
        for x in {x for x in k.split("/") if x[:1] == "!"}:
            held[x] = held.get(x, 0) + v
    return sorted(x[1:] for x, v in held.items() if 2 * v > sum(mass.values()))


def unmarked(mass: dict[str, int], free: list[str]) -> dict[str, int]:
    """``mass`` outside of boilerplate, where the labels of ``free`` are none."""
    out: dict[str, int] = {}
    for k, v in mass.items():
        if all(x[:1] != "!" or x[1:] in free for x in k.split("/")):
            out[_plain_path(k)] = out.get(_plain_path(k), 0) + v
    return out


def containers(wrapper: list, mass: dict[str, int], pages: int = 0) -> list[list[str]]:
    """Labels of the elements that hold the host's articles, the preferred ones first.

    Labels of one list are alternatives of which a page takes what it has: all of ``article``, then
    all of ``main``, then the containers by what fills their slots, if that is at least ``SUPPORT`` of the
    largest. Nothing means the whole body.
    """
    mass = slot_mass(wrapper, mass, pages)
    mass = unmarked(mass, overruled(mass))
    out = []
    for wanted in ("article", "main"):
        own = {x for k, v in mass.items() if v for x in k.split("/") if x.split(".")[0] == wanted}
        if own:
            out.append(sorted(own))
    if out or not mass:
        return out
    held: dict[str, int] = {}
    for k, v in mass.items():
        x = k.split("/")[-1]
        held[x] = held.get(x, 0) + v
    ranked = sorted(held, key=lambda x: (-held[x], x))
    if ranked[0].split(".")[0] in ("html", "body", ""):
        return []
    return [[x] for x in ranked if held[x] >= SUPPORT * held[ranked[0]] and x.split(".")[0] not in ("html", "body", "")]


def _skipped(stack: list, free: list[str]) -> bool:
    """Whether an open element is boilerplate; labels of ``free`` are none by their names."""
    return bool(stack) and (stack[-1][6] or ("!" in stack[-1][4] and any(s[3] and s[1] not in free for s in stack)))


def chosen(page: str, held: list[list[str]], dropped: set[int], free: list[str]) -> set[str]:
    """The page's own container among those of its host."""
    known = {x for some in held for x in some}
    size: dict[str, int] = {}
    whole, number = 0, -1
    for kind, stack, value in walk(page):
        if kind == "open":
            for x in (stack[-1][1], _bare(stack[-1][1])):
                if x in known:
                    size.setdefault(x, 0)
        elif kind == "text":
            number += 1
            n = len(value.strip())
            if n and number not in dropped and not _skipped(stack, free):
                whole += n
                for x in {y for s in stack for y in (s[1], _bare(s[1])) if y in known}:
                    size[x] += n
    for rank, some in enumerate(held):
        own = [x for x in some if x in size]
        if not own:
            continue
        best = max(own, key=size.get)
        if best.split(".")[0] in ("article", "main"):
            classes = set(best.split(".")[1:])
            return {x for x in own if x == best or not classes.isdisjoint(x.split(".")[1:])}
        # Any but a host's first container holds the article only of a page that keeps most of its text there.
        if rank == 0 or 2 * size[best] >= whole:
            return {best}
    return set()


def main_text(page: str | None, holder: str | list[list[str]], wrapper: list | None = None, pages: int = 0, free: list[str] = ()) -> str:
    """The page's text inside ``holder`` (a label, or a host's containers), or inside its body where the page has no such element.

    With the wrapper of a host of ``pages`` pages, template texts are left out. Labels of ``free`` are no
    boilerplate, whatever their names.
    """
    page = page or ""
    dropped = template_texts(wrapper, skeleton(page, True)[0], pages) if wrapper and pages >= LEAST_PAGES else set()
    held = [[holder]] if isinstance(holder, str) and holder else holder or []
    # A host's only container is tried at once.
    own = set(held[0]) if len(held) == 1 and len(held[0]) == 1 else chosen(page, held, dropped, free)
    blocks, kept, constant = _blocks(page, own, dropped, free)
    if own and not kept + constant:
        own = chosen(page, held, dropped, free)
        blocks, kept, constant = _blocks(page, own, dropped, free)
    if constant > kept:
        blocks = _blocks(page, own, free=free)[0]
    joined = (" ".join(entities.unescape(b).split()) for b in blocks)
    return " ".join(b for b in joined if b)


def _blocks(page: str, own: set[str], dropped: set[int] = frozenset(), free: list[str] = ()) -> tuple[list[str], int, int]:
    """(blocks of text inside the labels of ``own``, characters that are kept and that are dropped)."""
    blocks, now = [], []
    number, kept, constant = -1, 0, 0
    for kind, stack, value in walk(page):
        if kind == "text":
            number += 1
            if _skipped(stack, free) or (own and not any(s[1] in own or _bare(s[1]) in own for s in stack)):
                continue
            if number in dropped:
                constant += len(value.strip())
                continue
            kept += len(value.strip())
            now.append(value)
        elif kind == "void":
            now.append(" ")
        else:
            if stack[-1][0] not in INLINE and now:
                blocks.append("".join(now))
                now = []
    blocks.append("".join(now))
    return blocks, kept, constant


WRAPPERS = "host string, wrapper string, mass map<string,long>, pages long"


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per host for what this task reads, sent off whenever many have been gathered."""
    held: dict[str, tuple[list, dict[str, int], int]] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, *x) for h, x in held.items()]
        held.clear()
        return _wrapper_batch(rows)

    for batch in slices(batches):
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            items, mass = skeleton(page or "", True)
            items = loads(dumps(items))  # without the numbers of the page's texts
            if host not in held:
                held[host] = (items, dict(mass), 1)
            else:
                wrapper, total, n = held[host]
                held[host] = (align(wrapper, items), _add_mass(total, mass), n + 1)
        if len(held) > 5000:
            yield out()
    if held:
        yield out()


def _wrapper_batch(rows: list[tuple[str, list, dict[str, int], int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([h for h, *_ in rows], pa.string()),
            pa.array([dumps(w) for _, w, _, _ in rows], pa.string()),
            pa.array([list(m.items()) for _, _, m, _ in rows], pa.map_(pa.string(), pa.int64())),
            pa.array([n for *_, n in rows], pa.int64()),
        ],
        ["host", "wrapper", "mass", "pages"],
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers arrive in order of host."""
    held: tuple[str, list] | None = None

    def one(rows: list) -> tuple[list, dict[str, int], int]:
        # Equal wrappers of different pages count for each of them.
        return (*merge(((w, m) for w, m, _ in rows), False), sum(n for *_, n in rows))

    def whole(rows: list) -> tuple[list, dict[str, int], int]:
        wrapper, mass, n = one(rows)
        return only_template(wrapper, n), mass, n

    for batch in batches:
        for host, w, m, n in zip(*(batch.column(c).to_pylist() for c in ("host", "wrapper", "mass", "pages"))):
            if held and held[0] != host:
                yield _wrapper_batch([(held[0], *whole(held[1]))])
                held = None
            if held is None:
                held = (host, [])
            held[1].append((loads(w), dict(m), n))
            if len(held[1]) >= 64:
                held = (host, [one(held[1])])
    if held:
        yield _wrapper_batch([(held[0], *whole(held[1]))])


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, mass, pages): one wrapper per host, from all its pages."""
    rows = require(pages, url_col, html_col).select(_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    return (
        rows.mapInArrow(_partial, WRAPPERS)
        .repartition("host")
        .sortWithinPartitions("host", "wrapper")
        .mapInArrow(_merged, WRAPPERS)
    )


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(loads(w), dict(m), n) for w, m, n in zip(*(batch.column(c).to_pylist() for c in ("wrapper", "mass", "pages")))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("host"),
                pa.array([json.dumps(containers(w, m, n)) for w, m, n in rows], pa.string()),
                pa.array([overruled(slot_mass(w, m, n)) for w, m, n in rows], pa.list_(pa.string())),
                batch.column("wrapper"),
                batch.column("pages"),
            ],
            ["host", "holder", "free", "wrapper", "pages"],
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    @lru_cache(256)
    def wrapper(w: str | None, pages: int | None) -> list | None:
        """The wrapper, if it leaves out any text."""
        items = loads(w) if w else None
        return items if items and has_template(items, pages) else None

    holders = lru_cache(256)(lambda h: json.loads(h) if h else [])
    for batch in slices(batches):
        pages = zip(*(batch.column(c).to_pylist() for c in ("html", "holder", "wrapper", "pages", "free")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([main_text(p, holders(h), wrapper(w, n), n or 0, f or ()) for p, h, w, n, f in pages], pa.string())],
            ["page_id", "url", "text"],
        )


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): one row per page. Spark broadcasts the hosts' wrappers while they are small."""
    pages = require(pages, id_col, url_col, html_col)
    holders = durable(infer_wrappers(pages, url_col, html_col).mapInArrow(_containers, "host string, holder string, free array<string>, wrapper string, pages long"))
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host")
    )
    kind = rows.schema["page_id"].dataType.simpleString()
    return (
        rows.join(holders, "host", "left").select("page_id", "url", "html", "holder", "free", "wrapper", "pages")
        .mapInArrow(_texts, f"page_id {kind}, url string, text string")
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract_text(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The given pages keep their text in one ``article`` with simple blocks and few entities.
ORACLE = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's') as x from pages),
b as (select page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') as x from a),
c as (select page_id, url, trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) as text from b)
select page_id, url, text, len(text)::bigint as n_chars from c"""
