"""HTML to blocks, in two steps: the markup becomes a tree of elements, and the tree a list of blocks.

A block is the longest run of text that no block-level element interrupts. Elements are told apart by
the content categories of the HTML standard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Element names by category of the HTML standard.
METADATA = frozenset("base head link meta noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK_LEVEL = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section"
    " summary table ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An element's open siblings that its start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements at which the search for such a sibling stops.
SCOPES = frozenset("ol ul menu dl table select body html".split())
#: Open elements beyond which further ones are not nested; their text stays.
DEEPEST = 200


@dataclass
class Element:
    tag: str
    children: list[Element | str] = field(default_factory=list)

    def text(self) -> str:
        """All text inside, without that of metadata."""
        return "".join(c if isinstance(c, str) else f" {c.text()} " if c.tag in BLOCK_LEVEL else c.text() for c in self.children if isinstance(c, str) or c.tag not in METADATA)

    def all(self, *tags: str) -> Iterator[Element]:
        """The nearest elements of these names below, not those inside one of them."""
        for c in self.children:
            if isinstance(c, Element):
                if c.tag in tags:
                    yield c
                else:
                    yield from c.all(*tags)


class _Builder(HTMLParser):
    """Builds the tree; tags that are not ended, or never begun, do no harm."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#document")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._end(ENDS[tag], SCOPES)
        elif tag in BLOCK_LEVEL and self.open[-1].tag == "p":
            self.open.pop()
        child = Element(tag)
        self.open[-1].children.append(child)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(child)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Element(tag))

    def handle_endtag(self, tag):
        self._end({tag}, frozenset())

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def _end(self, tags: set[str], scopes: frozenset[str]) -> None:
        """End the innermost open element of these names, if one is open before a scope."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                del self.open[at:]
                return
            if self.open[at].tag in scopes:
                return


def tree(markup: str) -> Element:
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.root


def plain(text: str) -> str:
    return " ".join(text.split())


def blocks(element: Element, kind: str = "paragraph") -> Iterator[tuple[str, str]]:
    """(type, text) of an element's blocks in order; empty ones are left out."""
    run: list[str] = []
    for child in element.children:
        if isinstance(child, str):
            run.append(child)
        elif child.tag in METADATA:
            continue
        elif child.tag not in BLOCK_LEVEL and not any(True for _ in child.all(*BLOCK_LEVEL)):
            run.append(child.text())
        else:
            if text := plain("".join(run)):
                yield kind, text
            run = []
            if child.tag == "table":
                yield from _table(child)
            else:
                yield from blocks(child, "heading" if child.tag in HEADINGS else "list_item" if child.tag == "li" else "paragraph" if child.tag in BLOCK_LEVEL else kind)
    if text := plain("".join(run)):
        yield kind, text


def _table(table: Element) -> Iterator[tuple[str, str]]:
    """A table's caption as a paragraph, and its rows as lines of cells."""
    for caption in table.all("caption"):
        if text := plain(caption.text()):
            yield "paragraph", text
    rows = [[plain(cell.text()) for cell in row.all("td", "th")] for row in table.all("tr")]
    if lines := [" | ".join(cells) for cells in rows if any(cells)]:
        yield "table", "\n".join(lines)


def html_blocks(markup: str) -> list[tuple[str, str]]:
    """All blocks of a document; its title comes first as a heading, unless the first block says the same."""
    root = tree(markup)
    found = list(blocks(root))
    title = next((plain(t.text()) for t in root.all("title")), "")
    return found if not title or found[:1] == [("heading", title)] else [("heading", title), *found]
