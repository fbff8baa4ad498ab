"""The clean form of post content, for one page.

Wrappers and presentation go; paragraphs, headings, lists, quotes, code, tables, frames, preview
cards and inline emphasis stay. The result is a list of segments, so that previews and uploaded
images can be put in later by a join:

- `text`: finished HTML;
- `image`: the value of an image's `src`, with the address as key;
- `bookmark`: a link preview to be replaced, with its address as key and its plain form as HTML.
"""

from __future__ import annotations

import re
from urllib.parse import quote

from inkferry.operators.dom import (
    CLOSES_P,
    VOID,
    WHITE,
    Node,
    absolute_url,
    escape_attr,
    escape_text,
    inside,
    open_tag,
    outer_html,
)

CONTEXT_RADIUS = 50
# The markers around a preview card.
CARD_OPEN = "<!-- wp:html -->"
CARD_CLOSE = "<!-- /wp:html -->"

# Elements kept under another or the same name.
RENAMED = {
    "b": "strong", "strong": "strong", "i": "em", "em": "em",
    "del": "del", "s": "del", "strike": "del",
}
VERBATIM = frozenset(("sup", "sub"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
DROPPED = frozenset("script style noscript template title head meta link".split())
BLOCKS = (CLOSES_P | frozenset("body html iframe video audio canvas noscript output tfoot thead tbody tr td th caption".split()))
_SPACES = re.compile(r"[ \t\r\n\f]+")
_URI_SAFE = ";/?:@&=+$,#-_.!~*'()%"


def _is_card(node: Node) -> bool:
    return node.tag == "figure" and "bookmark-card" in node.classes()


def _clean_address(address: str) -> str:
    return quote(address.strip(), safe=_URI_SAFE)


class NormalForm:
    """Builds the clean tree of a content root, then writes it out as segments."""

    def __init__(self, bookmarks: dict[int, tuple[int, str]], origin: str):
        # id() of each replaceable bookmark element -> (its place on the page, its address)
        self.bookmarks = bookmarks
        self.segments: list[dict] = []
        self.images: list[dict] = []
        self.links = LinkList(origin)
        self._buffer: list[str] = []
        self._recording = True
        self._block_cache: dict[int, bool] = {}

    # -- building the clean tree --

    def _has_block(self, node: Node) -> bool:
        known = self._block_cache.get(id(node))
        if known is None:
            known = any(
                isinstance(c, Node)
                and (c.tag in BLOCKS or id(c) in self.bookmarks or self._has_block(c))
                for c in node.children
            )
            self._block_cache[id(node)] = known
        return known

    def blocks(self, children: list[Node | str]) -> list[Node]:
        out: list[Node] = []
        run: list[Node | str] = []

        def flush() -> None:
            inline = self.inline(run)
            if inline:
                paragraph = Node("p")
                paragraph.children = inline
                out.append(paragraph)
            run.clear()

        for child in children:
            if isinstance(child, str):
                run.append(child)
            elif child.tag in DROPPED:
                continue
            elif child.tag in BLOCKS or id(child) in self.bookmarks:
                flush()
                out.extend(self._block(child))
            elif self._has_block(child):
                flush()
                out.extend(self._spread(child))
            else:
                run.append(child)
        flush()
        return out

    def _spread(self, node: Node) -> list[Node]:
        """An inline element around blocks: mark up the inside of each paragraph instead."""
        inner = self.blocks(node.children)
        tag = RENAMED.get(node.tag) or ("a" if node.tag == "a" and node.attrs.get("href") else None)
        if tag:
            attrs = {"href": _clean_address(node.attrs["href"])} if tag == "a" else {}
            for block in inner:
                if block.tag == "p" or block.tag in HEADINGS:
                    mark = Node(tag, dict(attrs))
                    mark.children, block.children = block.children, [mark]
        return inner

    def _block(self, node: Node) -> list[Node]:
        tag = node.tag
        if id(node) in self.bookmarks:
            marker = Node("#bookmark")
            marker.children = [node]
            return [marker]
        if _is_card(node):
            marker = Node("#verbatim")
            marker.children = [node]
            return [marker]
        if tag in HEADINGS:
            inline = self.inline(node.children, flatten=True)
            if not inline:
                return []
            heading = Node(tag)
            heading.children = inline
            return [heading]
        if tag == "blockquote":
            inner = self.blocks(node.children)
            quoted = Node("blockquote")
            quoted.children = list(inner)
            return [quoted] if inner else []
        if tag in ("ul", "ol", "menu", "dir"):
            return self._list(node)
        if tag == "pre" and (code := self._code(node)) is not None:
            return [code]
        if tag == "hr":
            return [Node("hr")]
        if tag == "table":
            return [self._table(node)]
        if tag == "iframe":
            if not node.attrs.get("src"):
                return []
            kept = ("src", "width", "height", "allowfullscreen")
            return [Node("iframe", {k: node.attrs[k] for k in kept if node.attrs.get(k)})]
        return self.blocks(node.children)

    def _list(self, node: Node) -> list[Node]:
        items = []
        for child in node.children:
            if not isinstance(child, Node) or child.tag in DROPPED:
                continue
            inner = self.blocks(child.children if child.tag == "li" else [child])
            if not inner:
                continue
            item = Node("li")
            paragraphs = [b for b in inner if b.tag == "p"]
            explicit = any(isinstance(c, Node) and c.tag == "p" for c in child.children)
            if len(paragraphs) <= 1 and not explicit:
                item.children = [
                    part for b in inner for part in (b.children if b.tag == "p" else ["\n", b])
                ]
            else:
                item.children = list(inner)
            items.append(item)
        if not items:
            return []
        start = node.attrs.get("start", "")
        numbered = node.tag == "ol"
        out = Node(
            "ol" if numbered else "ul",
            {"start": start} if numbered and start.isdigit() and start != "1" else {},
        )
        out.children = list(items)
        return [out]

    def _code(self, node: Node) -> Node | None:
        first = node.children[0] if node.children else None
        if not isinstance(first, Node) or first.tag != "code":
            return None
        language = re.search(r"language-(\S+)", first.attrs.get("class", ""))
        code = Node("code", {"class": f"language-{language[1]}"} if language else {})
        code.children = [first.text().rstrip("\n") + "\n"]
        block = Node("pre")
        block.children = [code]
        return block

    def _table(self, node: Node) -> Node:
        def clean_cell(cell: Node) -> Node:
            out = Node(cell.tag)
            out.children = [cell.text().strip(WHITE)]
            image = next((e for e in cell.elements() if e.tag == "img"), None)
            if image is not None and image.attrs.get("src"):
                attrs = {"src": image.attrs["src"].strip(WHITE)}
                attrs.update({k: image.attrs[k] for k in ("width", "height") if image.attrs.get(k)})
                out.children.append(Node("img", attrs))
            return out

        table = Node("table")
        head, body = Node("thead"), Node("tbody")
        for n, row in enumerate(e for e in node.elements() if e.tag == "tr"):
            cells = [e for e in row.elements() if e.tag in ("th", "td")]
            clean = Node("tr")
            clean.children = [clean_cell(c) for c in cells]
            target = head if n == 0 and cells and cells[0].tag == "th" else body
            target.children.append(clean)
        table.children = [part for part in (head, body) if part.children]
        return table

    def inline(self, children: list[Node | str], flatten: bool = False) -> list[Node | str]:
        out = self._inline(children, flatten, [True])
        while out and isinstance(out[0], str) and not out[0].strip(" "):
            out.pop(0)
        while out and (
            (isinstance(out[-1], str) and not out[-1].strip(" "))
            or (isinstance(out[-1], Node) and out[-1].tag == "br")
        ):
            out.pop()
        if out and isinstance(out[0], str):
            out[0] = out[0].lstrip(" ")
        if out and isinstance(out[-1], str):
            out[-1] = out[-1].rstrip(" ")
        return out

    def _inline(self, children, flatten: bool, after_space: list[bool]) -> list[Node | str]:
        """Clean inline content; `after_space[0]` tells whether the text so far ends in a space."""
        out: list[Node | str] = []
        for child in children:
            if isinstance(child, str):
                text = _SPACES.sub(" ", child)
                if after_space[0]:
                    text = text.lstrip(" ")
                if text:
                    after_space[0] = text.endswith(" ")
                    out.append(text)
                continue
            tag = child.tag
            if tag in DROPPED:
                continue
            if tag == "br":
                out.append(Node("br"))
                after_space[0] = True
            elif tag == "img":
                if child.attrs.get("src"):
                    attrs = {"src": _clean_address(child.attrs["src"]), "alt": child.attrs.get("alt", "")}
                    if child.attrs.get("title"):
                        attrs["title"] = child.attrs["title"]
                    out.append(Node("img", attrs))
                    after_space[0] = False
            elif tag in VERBATIM:
                out.append(child)
                after_space[0] = False
            elif tag == "input" and child.attrs.get("type") == "checkbox":
                checked = {"checked": ""} if "checked" in child.attrs else {}
                out.append(Node("input", {**checked, "disabled": "", "type": "checkbox"}))
                after_space[0] = False
            elif tag == "code":
                text = child.text()
                if text.strip(WHITE):
                    code = Node("code")
                    code.children = [text]
                    out.append(code)
                    after_space[0] = False
            elif tag == "a" and child.attrs.get("href"):
                attrs = {"href": _clean_address(child.attrs["href"])}
                if child.attrs.get("title"):
                    attrs["title"] = child.attrs["title"]
                link = Node("a", attrs)
                link.children = self._inline(child.children, flatten, after_space)
                out.append(link)
            elif tag in RENAMED:
                mark = Node(RENAMED[tag])
                mark.children = self._inline(child.children, flatten, after_space)
                if any(isinstance(c, Node) or c.strip(WHITE) for c in mark.children):
                    out.append(mark)
                else:
                    out.extend(mark.children)
            else:
                out.extend(self._inline(child.children, flatten, after_space))
        return out

    # -- writing it out --

    def run(self, root: Node) -> None:
        self._write_blocks(self.blocks(root.children), root)
        self._flush()

    def _flush(self) -> None:
        if self._buffer:
            self.segments.append({"kind": "text", "html": "".join(self._buffer), "key": None})
            self._buffer.clear()

    def _write_blocks(self, blocks: list[Node], parent: Node) -> None:
        for n, block in enumerate(blocks):
            if n:
                self._buffer.append("\n")
            self._write(block, parent)

    def _write(self, item: Node, parent: Node) -> None:
        put = self._buffer.append
        item.parent = parent
        tag = item.tag
        if tag == "#bookmark":
            self._write_bookmark(item.children[0])
        elif tag == "#verbatim":
            self._write_verbatim(item.children[0])
        elif tag == "img":
            self._write_image(item)
        else:
            if tag == "a":
                self._add_link("a", item.attrs.get("href", ""), item, parent)
            put(open_tag(item) if item.attrs else f"<{tag}>")
            if tag in VOID:
                return
            if tag in ("blockquote", "ul", "ol"):
                put("\n")
                self._write_blocks(item.children, item)
                put("\n")
            elif tag == "li" and item.children and all(
                isinstance(c, Node) and c.tag in BLOCKS for c in item.children
            ):
                self._write_blocks(item.children, item)
            else:
                raw = tag in ("td", "th")
                for child in item.children:
                    if isinstance(child, str):
                        put(child if raw else escape_text(child))
                    else:
                        self._write(child, item)
            put(f"</{tag}>")

    def _write_image(self, image: Node) -> None:
        address = image.attrs.get("src")
        self._buffer.append("<img")
        if address and self._recording:
            self._buffer.append(' src="')
            self._flush()
            self.segments.append({"kind": "image", "html": escape_attr(address), "key": address})
            self.images.append({"pos": len(self.images), "url": address, "alt_text": image.attrs.get("alt")})
            self._buffer.append('"')
        elif address is not None:
            self._buffer.append(f' src="{escape_attr(address)}"')
        for name, value in image.attrs.items():
            if name != "src":
                self._buffer.append(f' {name}="{escape_attr(value)}"')
        self._buffer.append(">")

    def _write_bookmark(self, node: Node) -> None:
        place, address = self.bookmarks[id(node)]
        plain = NormalForm({}, "")
        plain._recording = False
        plain.run_blocks(node)
        self._flush()
        fallback = "".join(s["html"] for s in plain.segments)
        self.segments.append({"kind": "bookmark", "html": fallback, "key": address})
        self._add_link("card", address, None, None)

    def run_blocks(self, node: Node) -> None:
        self._write_blocks(self.blocks(node.children), node)
        self._flush()

    def _write_verbatim(self, card: Node) -> None:
        for anchor in card.elements():
            if anchor.tag == "a" and anchor.attrs.get("href"):
                self._add_link("a", anchor.attrs["href"], anchor, anchor.parent)
        self._buffer.append(f"{CARD_OPEN}{outer_html(card)}{CARD_CLOSE}")

    def _add_link(self, kind: str, href: str, node: Node | None, parent: Node | None) -> None:
        if href and self._recording:
            self.links.add(kind, href, node, parent)


class LinkList:
    """Links in document order, each with the parent's text around the first place of its own."""

    def __init__(self, origin: str):
        self.origin = origin
        self.rows: list[dict] = []
        self._parent: Node | None = None
        self._around = ""

    def add(self, kind: str, href: str, node: Node | None, parent: Node | None) -> None:
        resolved = absolute_url(href, self.origin)
        if resolved is None:
            return
        text = node.text().strip(WHITE) if node is not None else ""
        context = None
        if parent is not None:
            if parent is not self._parent:
                self._parent, self._around = parent, parent.text()
            at = self._around.find(text)
            if at >= 0:
                end = at + len(text) + CONTEXT_RADIUS
                context = self._around[max(0, at - CONTEXT_RADIUS) : end].strip(WHITE)
        self.rows.append(
            {
                "pos": len(self.rows),
                "kind": kind,
                "key": href,
                "target_url": resolved[0],
                "target_host": resolved[1],
                "link_text": text,
                "context": context,
            }
        )


def page_images(root: Node) -> list[dict]:
    """Images of any HTML that are not part of a preview card."""
    found = []
    for node in root.elements():
        if node.tag == "img" and node.attrs.get("src") and not inside(node, "figure", "bookmark-card"):
            found.append({"pos": len(found), "url": node.attrs["src"], "alt_text": node.attrs.get("alt")})
    return found


def page_links(root: Node, origin: str) -> list[dict]:
    """Links of any HTML in document order."""
    links = LinkList(origin)
    for node in root.elements():
        if node.tag == "a" and node.attrs.get("href"):
            links.add("a", node.attrs["href"], node, node.parent)
    return links.rows
