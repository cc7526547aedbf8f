"""Main text of HTML pages by tree scoring.

Paragraphs give points, for their length and their commas and less the more of them is links, to the elements around them.
If the container with the most points lies in an article, that article is kept whole, however long its parts are. Otherwise
the container, or the main element around it, is kept without the lists and containers in it that are mostly links, and with
what stands beside it and beside the elements around it, up to the body: paragraphs, headings, lists, tables and figures that
are not mostly links, and containers that hold prose. Of what stands beside an article, headings, paragraphs and articles that
hold prose are kept. Menus, headers, footers, sidebars, notices, adverts, forms, comments of readers and code never are.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.columns import column, others

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe input label map math menu nav noembed "
    "noframes noscript object option script select style svg template textarea title video".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("html body div article section main table td th caption ul ol dl blockquote figure details".split())
CONTAINERS = frozenset("div section article main body #root".split())
ROWS = frozenset("td th tr thead tbody tfoot table li ul ol dl dt dd".split())
CLOSES = {  # an opening element ends an open one of these
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert advertisement advertisements adverts advertising banner banners breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies copyright disclaimer disqus donate footer gdpr header hidden login masthead menu "
    "menus modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promoted promotion "
    "related recommended recommendations replies respond share sharing sidebar signup social sponsor sponsored sponsors "
    "subscribe subscription teaser toc toolbar topbar widget widgets alert aside skip".split()
)
# Names that say where or how large an element is, not what it holds, and names that are also ordinary words of a topic:
# share-buttons is dropped, share-price is not.
PLACE_NAMES = frozenset(
    "area bar block body bottom box button buttons center container content count counts float global group holder icon icons "
    "info inner item items large left link links list main middle mobile outer page panel post posts primary right row "
    "secondary section site slot small tool tools top unit wrap wrapper".split()
)
TOPIC_NAMES = frozenset("alert disclaimer header hidden menu menus notice notices related recommended share sharing skip social".split())
ARTICLE_NAMES = frozenset("article content entry main post story text body".split())
_NAME = re.compile(r"[A-Za-z]+")
_SENTENCE_END = re.compile(r"[.!?…。！？।؟]")
_PROSE_BYTES, _LONG_BYTES = 60, 200  # a sentence of the first size, or any line of the second, is taken for text of the page
_LINES = frozenset({"p", "blockquote", "pre", *HEADINGS})
_GROUPS = frozenset("table ul ol dl figure details".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "bonus", "score", "chars", "linked", "prose")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.dropped, self.bonus = False, 0.0
        self.score, self.chars, self.linked, self.prose = 0.0, 0, 0, False


def _names(attrs: dict[str, str | None]) -> list[set[str]]:
    """Words of each name in class and id; a name such as has-sidebar tells of something else and is left out."""
    names: list[set[str]] = []
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = [m.lower() for m in _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))]
        if parts and parts[0] not in ("has", "no", "with", "without"):
            names.append(set(parts))
    return names


def _tells_of_extras(words: set[str]) -> bool:
    """Whether a name marks an element that is no text of the page."""
    found = words & DROPPED_NAMES
    rest = [word for word in words - found if len(word) > 1 and word not in PLACE_NAMES]
    return bool(found) and not (rest and found <= TOPIC_NAMES)


class _Tree(HTMLParser):
    """Elements with their text in order; elements that are left open end where a following one says so."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#root", None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end({"p"} | CLOSES.get(tag, set()), {"table"} if tag in CLOSES else set())
        if tag == "br":
            self.now.parts.append(" ")
            return
        node = Node(tag, self.now)
        self.now.parts.append(node)
        held = dict(attrs)
        if held:
            names = _names(held)
            node.dropped = (
                (held.get("role") or "").lower() in DROPPED_ROLES or "hidden" in held or held.get("aria-hidden") == "true"
                or bool(_HIDDEN.search(held.get("style") or ""))
                or tag not in ("html", "body", "article", "main") and any(map(_tells_of_extras, names))
            )
            node.bonus = 25.0 * any(words & ARTICLE_NAMES for words in names)
        node.dropped |= tag in DROPPED
        if tag in ("article", "main"):
            node.bonus = 50.0
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.now
        while node.parent is not None and node.tag != tag:
            if node.tag in SCOPES and tag not in SCOPES:
                return  # an element can't end outside the container it is in
            node = node.parent
        if node.parent is not None:
            self.now = node.parent

    def _end(self, tags: set[str], stop: set[str]) -> None:
        node = self.now
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self.now = node.parent
                if node.tag == "p":
                    return
            elif node.tag in SCOPES and node.tag not in ("td", "th"):
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.now.parts.append(data)


def _blocks(top: Node) -> list[tuple[Node, str, int]]:
    """Blocks of text below ``top`` that are not dropped: the element each lies in, its text, its characters in links."""
    found: list[tuple[Node, str, int]] = []
    text: list[str] = []
    linked = 0
    owner = top

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join("".join(text).split())
            if line:
                found.append((owner, line, linked))
            text.clear()
        linked = 0

    stack: list[tuple[Node, int, bool, bool]] = [(top, 0, False, False)]  # element, next part, in a link, in a header
    while stack:
        node, at, link, header = stack.pop()
        if at == 0 and node.tag in BLOCKS:
            flush()
            owner = node
        while at < len(node.parts):
            part = node.parts[at]
            at += 1
            if isinstance(part, str):
                if not header or node.tag in HEADINGS:
                    text.append(part)
                    linked += len(part.strip()) if link else 0
            elif not part.dropped:
                if part.tag == "header" and not _within(node, ("article", "main")):
                    continue  # that of the page; of an article's own, the headings stay
                stack.append((node, at, link, header))
                stack.append((part, 0, link or part.tag == "a", header or part.tag == "header"))
                break
        else:
            if node.tag in BLOCKS:
                flush()
                owner = node.parent or top
    flush()
    return found


def _within(node: Node | None, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _outermost(node: Node | None, tag: str) -> Node | None:
    found = None
    while node is not None:
        if node.tag == tag:
            found = node
        node = node.parent
    return found


def _few_links(chars: int, linked: int) -> bool:
    return linked * 4 <= chars


def _points(line: str, linked: int) -> float:
    share = min(1.0, linked / len(line))
    return (1 + line.count(",") + len(line) / 100) * (1 - share)


def main_text(html: str | None) -> str:
    """The main text of a page, a line per block; empty if there is none."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    blocks = _blocks(tree.root)
    if not blocks:
        return ""
    containers: dict[int, Node] = {}
    for owner, line, linked in blocks:
        points, share, node = _points(line, linked), 1.0, owner
        if node.tag not in CONTAINERS:  # a paragraph's points go to what it stands in, those of a cell or item further up
            node = node.parent or node
        while node.parent is not None and node.tag in ROWS and (node is owner or node.tag not in ("td", "th")):
            node = node.parent
        size = len(line.encode("utf-8", "replace"))
        ended = size >= _LONG_BYTES or size >= _PROSE_BYTES and bool(_SENTENCE_END.search(line))
        prose = ended and _few_links(len(line), linked)
        around = owner
        while around is not None:
            around.chars += len(line)
            around.linked += min(linked, len(line))
            around.prose |= prose
            around = around.parent
        depth = 0
        while node is not None and depth < 3:
            node.score += points * share
            share /= 2
            containers[id(node)] = node
            depth += 1
            node = node.parent

    def value(node: Node) -> float:
        return (node.score + node.bonus * (node.score > 0)) * (1 - node.linked / max(node.chars, 1))

    best = max(containers.values(), key=value)  # the first of several
    article = _outermost(best, "article")
    best = article or _outermost(best, "main") or best
    kept, loose = {id(best)}, set()
    left_out = set()
    if article is None:  # lists of links in the container
        left_out = {
            id(part) for part in best.parts
            if isinstance(part, Node) and part.tag in _GROUPS | CONTAINERS and not _few_links(part.chars, part.linked)
        }
    least = max(2.0, 0.2 * best.score)
    level = best
    while level.parent is not None:
        loose.add(id(level.parent))
        for other in level.parent.parts:
            if not isinstance(other, Node) or other.dropped or other is level:
                continue
            if other.tag in _LINES or (other.tag in _GROUPS and article is None):
                more = _few_links(other.chars, other.linked)
            else:
                prose = other.prose and (article is None or other.tag == "article")
                more = (prose or level is best and other.tag == best.tag and other.score >= least) and _few_links(other.chars, other.linked)
            if more:
                kept.add(id(other))
        if article is not None or level.parent.tag in ("body", "html", "#root"):
            break
        level = level.parent

    def inside(owner: Node, line: str, linked: int) -> bool:
        """Whether a block lies in what is kept, or is a sentence right in an element around the best container."""
        if article is None and id(owner) in loose and owner.tag not in ("html", "#root"):
            if _few_links(len(line), linked) and _SENTENCE_END.search(line):
                return True
        node: Node | None = owner
        while node is not None:
            if id(node) in left_out:
                return False
            if id(node) in kept:
                return True
            node = node.parent
        return False

    return "\n".join(line for owner, line, linked in blocks if inside(owner, line, linked))


def main_text_column(html: Column) -> Column:
    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(page.as_py()) for page in pages], pa.string())

    return extract.asNondeterministic()(html)


def extract_text(df: DataFrame, html: str = "html") -> DataFrame:
    """Every row with ``text`` (the page's main text) and ``n_chars`` (its code points, long).

    A null or empty page, and one without any text, gives an empty text. Text outside any element is a block of its own.
    Broken markup is read as far as it goes: elements left open end with the container they are in. Pages are read whole,
    row by row without a shuffle, so ties, repeated rows and empty tables need no care. Columns named ``text`` or
    ``n_chars`` are replaced.
    """
    names = others(df, "text", "n_chars")
    found = df.select(*[column(c) for c in names], main_text_column(column(html)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
