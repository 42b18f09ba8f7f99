"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block. Blocks that never are main text (menus, scripts, forms, adverts,
comments, ...) leave empty lines, and so does the edge of a section. Text lengths are summed over a sliding window of lines; where
the sum surges to the length of a line of prose main text begins, where it dives to nothing it ends. The text between is kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import slices

#: Elements whose content isn't markup, and those whose content is never shown as text.
RAW = set("script style iframe textarea title xmp noembed noframes".split())
QUIET = set("noscript template svg math object canvas select datalist optgroup option button".split())
#: Elements that are shown but never main text.
SKIP = set("head nav footer aside form menu dialog fieldset label".split())
MAIN = {"article", "main"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("html body div section article main center hgroup header details td ul ol dl table".split())
#: Start tags that end an open element of the name, unless one of the second set is open in between.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option", "optgroup"} | BLOCK, set()), "td": ({"td", "th", "tr", "tbody"}, {"table"}), "th": ({"td", "th", "tr", "tbody"}, {"table"}), "tr": ({"tr", "tbody"}, {"table"}), "head": (BLOCK - {"head", "html"}, set())}
CLOSED_BY: dict[str, set[str]] = {}
for _name, (_ends, _) in IMPLIED.items():
    for _end in _ends:
        CLOSED_BY.setdefault(_end, set()).add(_name)
#: Skipped elements, besides those with a hint, that can be wrapped around the main text.
WRAPPERS = {"form", "fieldset", "label", "dialog"}
SECTION = {"article", "main", "section", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements open at a time; deeper ones count as their parents' text, as in browsers.
DEEPEST = 512
#: What a class, id or role says of what isn't main text: as a part of a name, or only as the whole name.
SURE = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|nav\w*|menu|breadcrumbs?|sidebar|footer|masthead|comments?|replies|related|newsletter|pagination|complementary|contentinfo)(?:$|[_-])")
WHOLE = {"notice", "notices", "banner", "consent", "reply", "popup", "modal"}
#: Words that do so only where the block has no line of prose.
MAYBE = re.compile(r"(?:^|[_-])(?:notices?|banner|consent|reply|share|social|recommended|subscribe|popup|modal|toolbar|widget|search|login|copyright)(?:$|[_-])")
SIMPLE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)\s*>")
TAG_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(?![\"'])([^\s>]*)))?)")
SPACE = re.compile(r"\s+")


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, dict[str, str], bool]]:
    """Tags of a page: start, end, name in lower case, whether it is an end tag, its class, id and role, whether it closes itself.

    Tags and attributes are read as HTML says: quotes only count where a value begins; a `<` without a letter, / or ! after it is text. Comments,
    declarations and what is in RAW elements come as tags without a name, from their first to their last character. What never ends goes on to the
    end of the page. Every character is looked at a bounded number of times, however broken the markup is.
    """
    at, n = page.find("<"), len(page)
    while at >= 0:
        simple = SIMPLE_TAG.match(page, at)
        if simple:
            end, name, closing, attributes, itself = simple.end(), simple.group(2).lower(), simple.group(1) == "/", {}, False
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, "", False, {}, False
            at = page.find("<", end)
            continue
        elif page[at + 1 : at + 2] in ("!", "?") or (page.startswith("</", at) and not page[at + 2 : at + 3].isalpha()):
            end = page.find(">", at + 1)
            end = n if end < 0 else end + 1
            yield at, end, "", False, {}, False
            at = page.find("<", end)
            continue
        else:
            start = TAG_NAME.match(page, at)
            if not start:
                at = page.find("<", at + 1)
                continue
            name, closing, attributes, itself = start.group(1).lower(), page[at + 1] == "/", {}, False
            end = start.end()
            while True:
                found = ATTRIBUTE.match(page, end)
                if not found or found.end() == end or found.end() >= n and not found.group(1):
                    yield at, n, "", False, {}, False  # a tag that the page ends in
                    return
                if found.group(1):
                    itself = page[found.end() - 2] == "/"
                    end = found.end()
                    break
                end = found.end()
                key = found.group(2).lower()
                if key in ("class", "id", "role"):
                    attributes.setdefault(key, html.unescape(found.group(3) or found.group(4) or found.group(5) or ""))
                elif page[end : end + 1] == "=":  # an attribute whose value has no end
                    yield at, n, "", False, {}, False
                    return
        yield at, end, name, closing, attributes, itself
        if name in RAW and not closing:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, end)
            stop = close.start() if close else n
            yield end, stop, "", False, {}, False
            end = stop
        at = page.find("<", end)


@dataclass(eq=False)
class Block:
    """A run of lines that isn't main text by its tag or name."""

    first: int
    around: Block | None  # the innermost such block around it
    wrapper: bool  # can stand around the main text
    maybe: bool  # only counts without prose
    end: int = -1
    main: bool = False  # holds a main element
    home: Block | None = None  # itself, or the next one around it that counts
    stays: bool = False


@dataclass
class Line:
    text: str
    links: int = 0  # characters of it that stand in links
    main: int = 0  # number of the outermost article or main element around it, 0 for none
    path: tuple[int, ...] = ()  # the open containers around it
    heading: bool = False
    block: Block | None = None  # the innermost block around it that may be left out


def lines_of(page: str, gap: int, prose: int = 80) -> list[Line]:
    """Lines of a page, one for each block of text; empty ones where something is left out and around sections.

    A block that would be left out stays if it only may be boilerplate and has a line of `prose` characters, or if it is a wrapper: if it holds a
    main element, articles with at least half as much text as there is outside of what is left out, or over twice that text. What is to be left
    out inside of it still goes. Wrappers are looked for once, from the largest block on.
    """
    out, blocks = _walk(page, gap)
    size, main = [0], [0]
    for x in out:
        size.append(size[-1] + len(x.text))
        main.append(main[-1] + len(x.text) * bool(x.main))
    for b in blocks:  # those around others come first
        text = b.maybe and any(len(x.text) >= prose and 2 * x.links <= len(x.text) for x in out[b.first : b.end])
        outer = b.around.home if b.around else None
        b.home, b.wrapper = (outer, False) if text else (b, b.wrapper)
    own: dict[int, int] = {}
    for x in out:
        key = id(x.block.home) if x.block and x.block.home else 0
        own[key] = own.get(key, 0) + len(x.text)
    rest = own.get(0, 0)
    chars = lambda b: size[b.end] - size[b.first]
    in_main = lambda b: main[b.end] - main[b.first]
    for b in sorted((b for b in blocks if b.wrapper and chars(b)), key=lambda b: (not b.main, -in_main(b), -chars(b), b.first)):
        outer = b.around.home if b.around else None
        if (outer is None or outer.stays) and (b.main or (in_main(b) and 2 * in_main(b) >= rest) or chars(b) > 2 * rest):
            b.stays = True
            rest += own.get(id(b), 0)
    return [x for x in out if not x.block or not x.block.home or x.block.home.stays]


def _walk(page: str, gap: int) -> tuple[list[Line], list[Block]]:
    out: list[Line] = []
    blocks: list[Block] = []
    text: list[str] = []
    opened: list[tuple[str, int, Block | None]] = []  # open elements that matter, with their numbers
    depth: Counter[str] = Counter()  # how many of a name are open
    linked = link_depth = main = mains = quiet = 0
    main_at = -1  # place of the outermost article or main element among the open ones
    path: tuple[int, ...] = ()
    inside: Block | None = None

    def close() -> None:
        nonlocal linked
        if text:
            joined = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                out.append(Line(joined, linked, main, path, bool(opened) and opened[-1][0] in HEADINGS, inside))
            text.clear()
        linked = 0

    def blank() -> None:
        out.extend(Line("", 0, main, path, False, inside) for _ in range(gap))

    def cut(n: int) -> None:
        nonlocal main, main_at, quiet, inside, path
        for name, number, block in reversed(opened[n:]):
            depth[name] -= 1
            quiet -= name in QUIET
            if path and path[-1] == number:
                path = path[:-1]
            elif number in path:
                path = path[: path.index(number)]
            if block:
                block.end, inside = len(out), block.around
        if any(block for _, _, block in opened[n:]):
            blank()
        del opened[n:]
        if main and n <= main_at:
            main, main_at = 0, -1

    def last(name: str) -> int:
        return next((i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == name), -1) if depth[name] else -1

    at = 0
    for number, (start, end, name, closing, attributes, itself) in enumerate(tokens(page)):
        if start > at and not quiet:
            text.append(page[at:start])
            linked += (start - at) * bool(link_depth)
        at = end
        if not name:
            if not quiet:
                text.append("" if end > start and page[start] == "<" else " ")
            continue
        if name == "a":
            link_depth = max(0, link_depth + (-1 if closing else 1))
        if closing:
            n = last(name)
            if name in BLOCK or name in SKIP or n >= 0:
                if name not in QUIET:
                    close()
                else:
                    text.append(" ")
                if n >= 0:
                    cut(n)
                if name in SECTION:
                    blank()
            continue
        names = " ".join(attributes.values()).lower().split() if attributes and name not in MAIN and name not in ("html", "body") else ()
        sure = any(x in WHOLE or SURE.search(x) for x in names)
        maybe = not sure and any(MAYBE.search(x) for x in names)
        if name in QUIET:
            if not itself and len(opened) < DEEPEST:
                if name in ("option", "optgroup") and opened and opened[-1][0] == "option":
                    cut(len(opened) - 1)
                if not quiet:
                    text.append(" ")
                opened.append((name, number, None))
                depth[name] += 1
                quiet += 1
            continue
        if name not in BLOCK and name not in SKIP and not sure and not maybe:
            continue
        close()
        if name in VOID:
            continue
        if name in BLOCK:
            i = len(opened) - 1
            while i >= 0 and opened[i][0] not in BLOCK and opened[i][0] not in QUIET:
                i -= 1
            if i >= 0 and opened[i][0] == "p":
                cut(i)
            closed = CLOSED_BY.get(name, ())
            if any(depth[x] for x in closed):
                for i in range(len(opened) - 1, -1, -1):
                    if opened[i][0] in closed:
                        cut(i)
                        break
                    if opened[i][0] in ("ul", "ol", "menu", "dl", "table", "div", "section", "article", "body"):
                        break
        if name in SECTION:
            blank()
        block = None
        if (name in SKIP or (name == "header" and not main) or sure or maybe) and len(opened) < DEEPEST:
            tagged = name in SKIP or name == "header"
            blank()
            block = inside = Block(len(out), inside, not main and (name in WRAPPERS or not tagged), maybe and not tagged)
            blocks.append(block)
        if len(opened) >= DEEPEST:
            continue
        if name == "main":
            for _, _, b in opened:
                if b:
                    b.main = True
        if name in MAIN and not main:
            mains += 1
            main, main_at = mains, len(opened)
        opened.append((name, number, block))
        depth[name] += 1
        if name in CONTAINERS:
            path = (*path, number)
    if at < len(page) and not quiet:
        text.append(page[at:])
    close()
    cut(0)
    return out, blocks


def window_sums(weights: list[int], window: int) -> list[int]:
    """For each line the text of it and the window - 1 lines after it."""
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    return [total[min(len(weights), i + window)] - total[i] for i in range(len(weights))]


def segments(weights: list[int], window: int, surge: int = 1) -> list[tuple[int, int]]:
    """Stretches [surge, dive): from a line with text after which the window's sum reaches surge, to where the window from it on has none.

    Between a dive and the next surge lie windows without text; stretches whose sums never reach surge are none.
    """
    sums, out, start, highest = window_sums(weights, window), [], -1, 0
    for i, w in enumerate(weights):
        if start < 0 and w:
            start, highest = i, 0
        if start >= 0 and sums[i] == 0:
            if highest >= surge:
                out.append((start, i))
            start = -1
        elif start >= 0:
            highest = max(highest, sums[i])
    if start >= 0 and highest >= surge:
        out.append((start, len(weights)))
    return out


def _shared(paths: list[tuple[int, ...]]) -> tuple[int, ...]:
    low, high = min(paths), max(paths)
    return low[: next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))]


def trimmed(lines: list[Line], weights: list[int], a: int, b: int, surge: int, root: tuple[int, ...]) -> tuple[int, int]:
    """The stretch without the short lines at its ends that stand elsewhere than its long ones (half of surge), headings excepted."""
    long = [i for i in range(a, b) if 2 * weights[i] >= surge] or [i for i in range(a, b) if weights[i]]

    def belongs(i: int, to: int) -> bool:
        home, mine = lines[to].path, lines[i].path
        return not lines[i].text or (lines[i].heading and i < to) or mine == home or (len(home) > len(root) and mine[: len(home)] == home)

    first, last = long[0], long[-1]
    while first > a and belongs(first - 1, long[0]):
        first -= 1
    while last + 1 < b and belongs(last + 1, long[-1]):
        last += 1
    return first, last + 1


def joined(lines: list[Line], found: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Groups of neighbouring candidates that were cut apart within one container, or whose containers have one parent.

    Right under what holds the whole page only candidates with a line of prose (80 characters) are joined, as the name of a site and its footer stand there too.
    """
    texts = [[x for x in lines[a:b] if x.text] for a, b in found]
    homes, prose = [_shared([x.path for x in t]) for t in texts], [max(len(x.text) for x in t) >= 80 for t in texts]
    root, out = _shared(homes) if homes else (), []
    for i, s in enumerate(found):
        if out:
            a, b = homes[i - 1], homes[i]
            near = a == b or a[:-1] == b[:-1] or a == b[: len(a)] or b == a[: len(b)]
            if near and (min(len(_shared([a, b])), len(a), len(b)) > len(root) or (prose[i - 1] and prose[i])):
                out[-1].append(s)
                continue
        out.append([s])
    return out


def extract(page: str, window: int = 3, surge: int = 80, near: float = 0.5) -> str:
    """The main text: blocks in page order, joined by one space; empty if there is none.

    Texts are weighed by line, lines of mostly links weigh nothing, and weights are summed over a sliding window. Where a sum reaches `surge` characters (or the
    page's largest sum, if that is less) main text begins, where it falls to nothing main text ends. An article or main element that the sums surge in
    is main text as a whole, and other text then isn't. Elsewhere the stretches between surge and dive are trimmed of short lines from other containers, and
    those of one container are taken together; the largest group stays, and others with at least `near` of its text.
    """
    lines = lines_of(page, window, surge)
    weights = [0 if 2 * x.links > len(x.text) else len(x.text) for x in lines]
    if any(x.main for x in lines if x.text):
        peaks: dict[int, int] = {}
        for x, s in zip(lines, window_sums([w * bool(x.main) for x, w in zip(lines, weights)], window)):
            if x.main and x.text:
                peaks[x.main] = max(peaks.get(x.main, 0), s)
        least = min(surge, max(peaks.values()))
        return " ".join(x.text for x in lines if x.text and x.main and peaks[x.main] >= least)
    least = min(surge, max(window_sums(weights, window), default=0))
    found = segments(weights, window, least) if least else []
    root = _shared([x.path for x in lines if x.text]) if found else ()
    groups = joined(lines, [trimmed(lines, weights, a, b, least, root) for a, b in found])
    sizes = [sum(sum(weights[a:b]) for a, b in g) for g in groups]
    return " ".join(x.text for g, n in zip(groups, sizes) if n >= near * max(sizes) for a, b in g for x in lines[a:b] if x.text)


def extract_pages(pages: DataFrame, html_col: str = "html", out_col: str = "text", window: int = 3) -> DataFrame:
    """pages with out_col in place of html_col, in one pass without a shuffle; other columns as they were.

    A null or empty page, and one without main text, gives an empty text. A column named out_col is replaced; rows repeat as they do.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    kept = [c for c in pages.columns if c not in (html_col, out_col)]
    rows = pages.select(*kept, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__html"))
    schema = StructType([*[f for f in rows.schema.fields if f.name != "__html"], StructField(out_col, StringType())])

    def run(batches):
        for b in slices(batches, "__html"):
            texts = [extract(p, window) for p in b.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(texts, pa.string())], [*kept, out_col])

    return rows.mapInArrow(run, schema)
