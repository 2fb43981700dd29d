"""Main text of web pages by tag-path ratios.

Every run of text in a page belongs to a block and to the path of tags from the root to it. For each path, text length
(links apart) and punctuation are summed over its blocks and divided by their number. Both ratios are smoothed over the
blocks in page order and multiplied; a path's mean is its score. Class names and roles of what surrounds articles (menus,
adverts, comments, ...) are evidence beside it: a block inside such an element has a fraction of its path's score. Blocks
from the threshold on are content.

Blocks that are not content by themselves, but stand among it, follow: all that is inside the article element which holds
the content (if the page has one), the other blocks of the element that directly holds content, blocks between content
in one element, and headings before what is kept. Inside a marked element they follow only where their own ratio reaches
the threshold. The page is read once, with a parent link for each element.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_kept

# Fixed values of HTML: elements without content, elements that end a paragraph, elements whose text is never shown or
# never part of an article, and elements and roles that surround articles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("head nav menu button select textarea iframe object svg canvas audio video dialog noscript template".split())
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "title", "xmp", "noembed", "noframes")
AROUND = frozenset("aside form".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of classes and ids that mark what surrounds an article. A name counts if all its parts are such words or those of NEUTRAL.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion promotions banner banners nav navbar navigation menu menus "
    "submenu breadcrumb breadcrumbs sidebar sidebars masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe "
    "subscription signup login register comment comments commentlist disqus respond replies share sharing social pagination pager paging footer header".split()
)
WEAK = frozenset("side rail aside foot search form reply discussion related recommended recommendations widget widgets skip legal copyright disclaimer teaser teasers tags meta".split())
NEUTRAL = frozenset(
    "site page main top bottom left right inner outer global primary secondary box list item items wrapper wrap container block area section bar links link buttons button text body "
    "posts post articles article content user reader thread row column col group panel module".split()
)
#: The words that count on elements which are themselves text.
FEW = frozenset("ad ads advert advertisement comment comments cookie copyright notice promo sponsored".split())
TEXTUAL = frozenset("article h1 h2 h3 h4 h5 h6 p b i em strong span a".split())
#: What a block's score is multiplied by inside an element that is not marked, weakly marked, strongly marked.
EVIDENCE = (1.0, 0.15, 0.002)
#: Elements that can hold an article, and those that say so.
HOLDERS = frozenset("article main section div td th center body".split())
FIRM = frozenset("article main".split())
#: Elements that a start tag of the key ends, if open since the last of the elements in the second set.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
SCOPES = frozenset("article aside body button div fieldset figure footer form header li main nav section table td th ul ol dl".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：()\"'«»“”]")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Weights of a block and its neighbours in page order when ratios are smoothed.
KERNEL = (0.06, 0.24, 0.4, 0.24, 0.06)
#: A path is content from this share of the ratios' standard deviation on.
THRESHOLD = 0.5
#: An article element is the article if it holds this share of the content.
MOST = 0.7


class Page:
    """What a page's markup says: its elements, as columns with parent links, and its blocks of text."""

    def __init__(self) -> None:
        self.parent, self.tag, self.path, self.mark = [0], ["body"], [0], [0]
        self.holder, self.firm, self.block = [0], [0], [0]  # the nearest that can hold an article, says so, is a block
        self.end = [0]  # the number after those of the elements inside
        self.blocks: list[Block] = []

    def holds(self, outer: int, inner: int) -> bool:
        return outer <= inner < self.end[outer]


class Block:
    __slots__ = ("element", "path", "parts", "linked", "text", "ratio", "score")

    def __init__(self, element: int, path: int) -> None:
        self.element, self.path, self.parts, self.linked, self.text, self.ratio, self.score = element, path, [], 0, "", 0.0, 0.0


def _name_mark(name: str, textual: bool, in_article: bool) -> int:
    """0, 1 (weak) or 2 (strong), of one class name or id."""
    words = [w for w in re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w and not w.isdigit()]
    if textual:
        return 2 if any(w in FEW for w in words) and all(w in FEW or w in NEUTRAL for w in words) else 0
    if not all(w in STRONG or w in WEAK or w in NEUTRAL for w in words):
        return 0
    if in_article:  # its own header belongs to it
        return max([0 if w == "header" else 1 if w == "footer" or w in WEAK else 2 if w in STRONG else 0 for w in words], default=0)
    return 2 if any(w in STRONG for w in words) else 1 if any(w in WEAK for w in words) else 0


def _mark(tag: str, attrs: dict[str, str], in_article: bool, in_quote: bool) -> int:
    """0, 1 or 2 as above, or 3 for what is never text of an article."""
    if tag in NEVER or "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style", "")):
        return 3
    if tag in AROUND or tag == "header" and not in_article or attrs.get("role", "").lower() in ROLES:
        return 2
    if tag == "footer":
        return 0 if in_quote else 1 if in_article else 2
    if tag in ("main", "body", "html"):
        return 0
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
    return max([_name_mark(n, tag in TEXTUAL, in_article) for n in names], default=0)


def read(page: str) -> Page:
    """The page's elements and its blocks in order, without what is never shown. Each token costs the same, however deep it stands."""
    found = Page()
    stack: list[int] = []  # open elements
    open_at: dict[str, list[int]] = {}  # per tag, where its open elements stand in the stack
    paths: dict[tuple[int, str], int] = {}
    scopes: list[int] = []  # where open elements stand in the stack that end the search for an open paragraph
    current = None
    gone = None  # where the outermost open element that is never shown stands in the stack

    def pop_to(k: int) -> None:
        nonlocal current, gone
        while len(stack) > k:
            tag = found.tag[stack.pop()]
            open_at[tag].pop()
            if tag in SCOPES:
                scopes.pop()
            if tag in BLOCKS:
                current = None
        if gone is not None and gone >= k:
            gone = None

    def last_of(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            if gone is not None:
                continue
            if current is None:
                if text.isspace():
                    continue
                element = stack[-1] if stack else 0
                current = Block(element, found.path[found.block[element]])
                found.blocks.append(current)
            current.parts.append(text)
            if open_at.get("a"):
                current.linked += len(text)
            continue
        if m["raw"] is not None or m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if open_at.get(tag):
                pop_to(open_at[tag][-1])
            if tag in BLOCKS:
                current = None
            continue
        if tag in ("br", "td", "th", "hr") and current is not None:
            if tag == "hr":
                current = None
            else:
                current.parts.append(" ")
        if tag in VOID:
            continue
        if tag in BLOCKS:  # ends an open paragraph
            if open_at.get("p") and open_at["p"][-1] > (scopes[-1] if scopes else -1):
                pop_to(open_at["p"][-1])
            current = None
        if tag in ENDS:
            ended, scope = ENDS[tag]
            at = last_of(ended)
            if at > last_of(scope):
                pop_to(at)
        raw = m["attrs"]
        if raw.endswith("/") and tag in ("svg", "path"):
            continue
        attrs = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}
        up = stack[-1] if stack else 0
        number = len(found.tag)
        mark = 3 if gone is not None else _mark(tag, attrs, found.firm[up] > 0, bool(open_at.get("blockquote")))
        if mark == 3 and gone is None:
            gone = len(stack)
        name = (attrs.get("class") or "").split() if tag in HOLDERS else None
        step = (found.path[up], f"{tag}.{name[0].lower()}" if name else tag)
        found.parent.append(up)
        found.tag.append(tag)
        found.path.append(paths.setdefault(step, len(paths) + 1))
        found.mark.append(max(mark, found.mark[up]))
        found.holder.append(number if tag in HOLDERS and tag != "body" else found.holder[up])
        found.firm.append(number if tag in FIRM else found.firm[up])
        found.block.append(number if tag in BLOCKS else found.block[up])
        open_at.setdefault(tag, []).append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        stack.append(number)
    found.end = [n + 1 for n in range(len(found.tag))]
    for n in range(len(found.tag) - 1, 0, -1):
        found.end[found.parent[n]] = max(found.end[found.parent[n]], found.end[n])
    for b in found.blocks:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    found.blocks = [b for b in found.blocks if b.text]
    return found


def smoothed(x: list[float]) -> list[float]:
    n, half = len(x), len(KERNEL) // 2
    return [sum(KERNEL[d + half] * x[min(n - 1, max(0, i + d))] for d in range(-half, half + 1)) for i in range(n)]


def ratios(blocks: list[Block]) -> None:
    """Set each block's ratio: the mean over its path of text ratio times punctuation ratio, both also smoothed."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0.0, 0.0, 0, 0.0])
        s[0] += max(0, len(b.text) - b.linked)
        s[1] += len(PUNCTUATION.findall(b.text))
        s[2] += 1
    text = [sums[b.path][0] / sums[b.path][2] for b in blocks]
    marks = [sums[b.path][1] / sums[b.path][2] for b in blocks]
    for b, s, p, own, q in zip(blocks, smoothed(text), smoothed(marks), text, marks, strict=True):
        sums[b.path][3] += math.sqrt(s * own) * (0.1 + math.sqrt(p * q))
    for b in blocks:
        b.ratio = sums[b.path][3] / sums[b.path][2]


def _is_link(b: Block) -> bool:
    return b.linked >= 0.5 * max(1, len(b.text))


def chosen_blocks(page: Page) -> tuple[list[bool], float, int]:
    """Which blocks are content by ratio and evidence; the threshold; and the mark that all content has."""
    blocks = page.blocks
    for b in blocks:
        b.score = b.ratio * EVIDENCE[page.mark[b.element]]
    if any(page.firm[b.element] and page.mark[b.element] < 2 and not _is_link(b) for b in blocks):  # what is strongly marked is not the article then
        blocks = [b for b in blocks if page.mark[b.element] < 2]
    scores = [b.score for b in blocks]
    centre = sum(scores) / len(scores)
    least = min(THRESHOLD * math.sqrt(sum((s - centre) ** 2 for s in scores) / len(scores)), max(scores))
    can = set(map(id, blocks))
    chosen = [id(b) in can and b.score >= least and not _is_link(b) for b in page.blocks]
    return chosen, least, min((page.mark[b.element] for b, c in zip(page.blocks, chosen, strict=True) if c), default=0)


def main_text(page: str | None) -> str:
    """The main text: blocks joined by two line ends; empty if there is none."""
    found = read(page or "")
    blocks = found.blocks
    if not blocks:
        return ""
    ratios(blocks)
    chosen, least, usual = chosen_blocks(found)
    if not any(chosen):
        return ""
    free = [found.mark[b.element] <= usual or found.mark[b.element] == 1 and b.ratio >= least for b in blocks]
    home = _article(found, chosen)
    if home:
        kept = [found.holds(home, b.element) and (c or f) for b, c, f in zip(blocks, chosen, free, strict=True)]
    else:
        kept = _with_neighbours(found, chosen, free)
    _add_headings(found, kept, free)
    return "\n\n".join([b.text for b, k in zip(blocks, kept, strict=True) if k])


def _article(page: Page, chosen: list[bool]) -> int:
    """The deepest article element that holds most of the content, 0 if there is none."""
    weight = [0.0] * len(page.tag)
    for b, c in zip(page.blocks, chosen, strict=True):
        if c:
            weight[page.firm[b.element]] += len(b.text) * b.score
    total = sum(weight)
    for n in range(len(weight) - 1, 0, -1):  # an element comes after its parents
        if page.tag[n] in FIRM:
            if weight[n] >= MOST * total:
                return n
            weight[page.firm[page.parent[n]]] += weight[n]
    return 0


def _holders(page: Page, chosen: list[bool]) -> list[int]:
    """Each block's element that can hold an article. A cell can where a cell of its table has content in elements of its own."""
    tag, parent = page.tag, page.parent
    layout, table = set(), [0] * len(tag)
    for n in range(1, len(tag)):
        table[n] = n if tag[n] == "table" else table[parent[n]]
    for b, c in zip(page.blocks, chosen, strict=True):
        if c and tag[page.block[b.element]] not in ("td", "th", "tr", "tbody", "table"):
            layout.add(table[b.element])
    real = [0] * len(tag)
    for n in range(1, len(tag)):
        cell = tag[n] in ("td", "th")
        own = page.holder[n] == n and (not cell or table[n] in layout)
        real[n] = n if own else real[table[n]] if cell else real[parent[n]]
    page.holder = real
    return [real[b.element] for b in page.blocks]


def _with_neighbours(page: Page, chosen: list[bool], free: list[bool]) -> list[bool]:
    """Content and the blocks that stand among it."""
    blocks, holders = page.blocks, _holders(page, chosen)
    direct: dict[int, int] = {}  # elements that directly hold content: its first block
    for k, (h, c) in enumerate(zip(holders, chosen, strict=True)):
        if c:
            direct.setdefault(h, k)
    around = [page.holder[page.parent[h]] if h else 0 for h in holders]  # the element around a block's
    before, after = _nearest(holders, chosen), _nearest(holders[::-1], chosen[::-1])[::-1]
    kept = list(chosen)
    first, last = chosen.index(True), len(chosen) - 1 - chosen[::-1].index(True)
    for k, b in enumerate(blocks):
        if chosen[k] or not free[k]:
            continue
        h, link = holders[k], _is_link(b)
        if h in direct:
            kept[k] = (first < k < last or h > 0 and k > direct[h]) if link else first < k < last or h > 0 or page.tag[page.block[b.element]] in HEADINGS
        else:
            kept[k] = not link and around[k] > 0 and page.holds(around[k], before[k]) and page.holds(around[k], after[k])
    return kept


def _nearest(holders: list[int], chosen: list[bool]) -> list[int]:
    """For each block the element that holds the last content before it (the body if there is none)."""
    out, now = [], 0
    for h, c in zip(holders, chosen, strict=True):
        out.append(now)
        now = h if c else now
    return out


def _add_headings(page: Page, kept: list[bool], free: list[bool]) -> None:
    """Headings right before a kept block, where an element other than the body holds both."""
    blocks = page.blocks
    for k in range(len(blocks) - 2, -1, -1):  # backwards, so that a heading before a heading is met
        b = blocks[k]
        holder = page.holder[b.element]
        if not kept[k] and kept[k + 1] and free[k] and holder and page.tag[page.block[b.element]] in HEADINGS:
            kept[k] = page.holds(holder, blocks[k + 1].element)


def _batches(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            texts = [main_text(x) for x in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*part.schema.names[:-1], "text", "n_chars"])


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of every row, text (empty if there is none) and n_chars (its code points).

    Null and empty pages give an empty text; broken markup is read as far as it goes; repeated rows are kept, and an empty
    table gives none. Kept columns called text or n_chars are replaced by those made here."""
    own = [c for c in keep if c.lower() not in ("text", "n_chars")]
    return map_kept(pages, own, html_col, "string", _batches, "text string, n_chars long")
