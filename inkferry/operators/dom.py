"""A small forgiving HTML tree for one page, and the selectors the jobs need.

Only used inside the parse stages of `extract` and `previews`.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, unquote

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
DECODED_RAW_TEXT = frozenset(("textarea", "title"))
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table "
    "ul".split()
)
# an opening tag closes these open elements, searched up to the nearest boundary element
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
# Elements nested deeper than this become siblings, as in browsers; nothing is dropped.
MAX_DEPTH = 512
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())
# What the source platform's runtime strips as white space.
NBSP = chr(0xA0)
WHITE = "\t\n\v\f\r " + NBSP + "".join(
    map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+|[\"'])*+)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag = tag
        self.attrs = attrs if attrs is not None else {}
        self.children: list[Node | str] = []
        self.parent = parent

    def elements(self) -> Iterator[Node]:
        """Descendant elements in document order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(parts)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


@lru_cache(maxsize=8192)
def _attributes(source: str) -> dict[str, str]:
    """Attributes of a tag; equal tags share one dict, which nobody changes."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(source):
        value = double or single or bare
        if "&" in value:
            value = _REFERENCE.sub(lambda m: html.unescape(m[0]), value)
        found.setdefault(name.lower(), value)
    return found


def parse_html(source: str) -> tuple[Node, list[Node]]:
    """The page's root and all its elements in document order."""
    root = Node("#root")
    elements: list[Node] = []
    open_nodes = [root]
    too_deep: dict[str, int] = {}

    def close(targets, boundary) -> bool:
        for depth in range(len(open_nodes) - 1, 0, -1):
            tag = open_nodes[depth].tag
            if tag in targets:
                del open_nodes[depth:]
                return True
            if tag in boundary:
                return False
        return False

    def add_text(text: str, decode: bool = True) -> None:
        open_nodes[-1].children.append(html.unescape(text) if decode and "&" in text else text)

    at = 0
    search = _TOKEN.search
    while match := search(source, at):
        start, end = match.span()
        if start > at:
            add_text(source[at:start])
        at = end
        closing, tag, attrs = match.groups()
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if open_nodes[-1].tag == tag and not too_deep:
                open_nodes.pop()
            elif too_deep.get(tag):
                too_deep[tag] -= 1
            elif tag not in TABLE_PARTS:
                close((tag,), ("td", "th", "table"))
            else:
                close((tag,), () if tag == "table" else ("table",))
            continue
        if tag in CLOSES_P:
            close(("p",), ("td", "th", "table", "button", "object"))
        if tag in CLOSES:
            close(*CLOSES[tag])
        parent = open_nodes[-1]
        node = Node(tag, _attributes(attrs) if attrs else {}, parent)
        parent.children.append(node)
        elements.append(node)
        if tag in VOID:
            continue
        if tag in RAW_TEXT:
            end_tag = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            raw = source[at : end_tag.start()] if end_tag else source[at:]
            at = end_tag.end() if end_tag else len(source)
            if raw:
                decode = tag in DECODED_RAW_TEXT and "&" in raw
                node.children.append(html.unescape(raw) if decode else raw)
            continue
        if len(open_nodes) < MAX_DEPTH:
            open_nodes.append(node)
        else:
            too_deep[tag] = too_deep.get(tag, 0) + 1
    if at < len(source):
        add_text(source[at:])
    return root, elements


# --- selectors: type, *, #id, .class, [attr], [attr op value], descendant, child and comma lists ---

_COMPOUND = re.compile(
    r"(?P<tag>\*|[a-zA-Z][\w-]*)?"
    r"(?P<rest>(?:#[\w-]+|\.[\w-]+|\[[^\]]+\])*)"
)
_PART = re.compile(r"#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~]?=)\s*(\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]")


class _Compound:
    def __init__(self, tag, ids, classes, tests):
        self.tag, self.ids, self.classes, self.tests = tag, ids, classes, tests
        self.needs_attributes = bool(ids or classes or tests)

    def matches(self, node: Node) -> bool:
        if self.tag and node.tag != self.tag:
            return False
        if not self.needs_attributes:
            return True
        if not node.attrs:
            return False
        for wanted in self.ids:
            if node.attrs.get("id") != wanted:
                return False
        if self.classes and not self.classes <= set(node.classes()):
            return False
        for name, operator, value in self.tests:
            actual = node.attrs.get(name)
            if actual is None:
                return False
            if operator == "=" and actual != value:
                return False
            if operator == "~=" and value not in actual.split():
                return False
            if operator == "^=" and not (value and actual.startswith(value)):
                return False
            if operator == "$=" and not (value and actual.endswith(value)):
                return False
            if operator == "*=" and not (value and value in actual):
                return False
        return True


def _compile_one(source: str) -> list[tuple[str, _Compound]]:
    steps, at, combinator = [], 0, " "
    while at < len(source):
        match = _COMPOUND.match(source, at)
        if not match or match.end() == at:
            raise ValueError(f"unsupported selector: {source!r}")
        ids, classes, tests = [], set(), []
        for id_, class_, name, operator, value in _PART.findall(match["rest"]):
            if id_:
                ids.append(id_)
            elif class_:
                classes.add(class_)
            else:
                tests.append((name.lower(), operator, value.strip("\"'")))
        tag = match["tag"]
        steps.append((combinator, _Compound(None if tag in (None, "*") else tag.lower(), ids, classes, tests)))
        at = match.end()
        gap = re.compile(r"\s*(>?)\s*").match(source, at)
        if at < len(source) and gap.end() == at:
            raise ValueError(f"unsupported selector: {source!r}")
        combinator, at = gap[1] or " ", gap.end()
    if not steps or combinator == ">":
        raise ValueError(f"unsupported selector: {source!r}")
    return steps


@lru_cache(maxsize=256)
def compile_selector(source: str) -> tuple[tuple[tuple[str, _Compound], ...], ...]:
    return tuple(tuple(_compile_one(part.strip())) for part in source.split(","))


def _matches_chain(node: Node, steps, last: int) -> bool:
    combinator, compound = steps[last]
    if not compound.matches(node):
        return False
    if last == 0:
        return True
    parent = node.parent
    if combinator == ">":
        return parent is not None and _matches_chain(parent, steps, last - 1)
    while parent is not None:
        if _matches_chain(parent, steps, last - 1):
            return True
        parent = parent.parent
    return False


class Page:
    """All elements of a parsed page, by tag and in document order."""

    def __init__(self, source: str):
        self.root, self.elements = parse_html(source)
        self._by_tag: dict[str, list[Node]] = {}
        for node in self.elements:
            self._by_tag.setdefault(node.tag, []).append(node)

    def select(self, selector: str) -> list[Node]:
        chains = compile_selector(selector)
        if len(chains) > 1:
            return [n for n in self.elements if any(_matches_chain(n, c, len(c) - 1) for c in chains)]
        steps = chains[0]
        last, tag = len(steps) - 1, steps[-1][1].tag
        pool = self.elements if tag is None else self._by_tag.get(tag, ())
        return [n for n in pool if _matches_chain(n, steps, last)]

    def first(self, selector: str) -> Node | None:
        found = self.select(selector)
        return found[0] if found else None


def inside(node: Node, tag: str, class_name: str) -> bool:
    """Whether the node or one of its ancestors is such an element."""
    up: Node | None = node
    while up is not None:
        if up.tag == tag and class_name in up.classes():
            return True
        up = up.parent
    return False


# --- writing HTML ---


def escape_text(text: str) -> str:
    return text.replace("&", "&amp;").replace(NBSP, "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attr(value: str) -> str:
    return value.replace("&", "&amp;").replace(NBSP, "&nbsp;").replace('"', "&quot;")


def open_tag(node: Node) -> str:
    return f"<{node.tag}{''.join(f' {k}=\"{escape_attr(v)}\"' for k, v in node.attrs.items())}>"


def outer_html(node: Node) -> str:
    out: list[str] = []
    stack: list[Node | str | tuple[str]] = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, tuple):
            out.append(item[0])
        elif isinstance(item, str):
            out.append(escape_text(item))
        else:
            out.append(open_tag(item))
            if item.tag in VOID:
                continue
            stack.append((f"</{item.tag}>",))
            if item.tag in RAW_TEXT and item.tag not in DECODED_RAW_TEXT:
                out.extend(c for c in item.children if isinstance(c, str))
            else:
                stack.extend(reversed(item.children))
    return "".join(out)


def inner_html(node: Node) -> str:
    return "".join(escape_text(c) if isinstance(c, str) else outer_html(c) for c in node.children)


# --- addresses, as browsers resolve them ---

_SCHEME = re.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*):")
_DEFAULT_PORT = {"http": "80", "https": "443", "ftp": "21"}
_PATH_SAFE = "/%:@!$&'()*+,;=-._~[]|^\\"
_QUERY_SAFE = "/%:@!$&()*+,;=-._~?[]|^\\{}`"
_FRAGMENT_SAFE = "/%:@!$&'()*+,;=-._~?[]|^\\{}#"


def _clean_path(path: str) -> str:
    kept: list[str] = []
    parts = path.split("/")[1:]
    for i, part in enumerate(parts):
        dots = part.lower().replace("%2e", ".")
        last = i == len(parts) - 1
        if dots == "..":
            if kept:
                kept.pop()
            if last:
                kept.append("")
        elif dots == ".":
            if last:
                kept.append("")
        else:
            kept.append(part)
    return "/" + "/".join(kept)


_PLAIN_PATH = re.compile(r"/(?:[A-Za-z0-9_-][A-Za-z0-9_/-]*)?")


def absolute_url(href: str, origin: str) -> tuple[str, str] | None:
    """The address and host of a link on a site, or None when it is not valid.

    Addresses of other schemes than http(s) and ftp come back as they are, with an empty host.
    """
    if _PLAIN_PATH.fullmatch(href) and (site := _resolved("/", origin)):
        return site[0][:-1] + href, site[1]
    return _resolved(href, origin)


@lru_cache(maxsize=4096)
def _resolved(href: str, origin: str) -> tuple[str, str] | None:
    href = re.sub(r"[\t\n\r]", "", href.strip("".join(map(chr, range(33)))))
    scheme_match = _SCHEME.match(href)
    base_scheme, _, base_authority = origin.partition("://")
    authority = base_authority
    scheme = base_scheme.lower()
    rest = href
    if scheme_match:
        named = scheme_match[1].lower()
        if named not in _DEFAULT_PORT:
            return href, ""
        rest = href[scheme_match.end() :]
        slashed = rest.replace("\\", "/")
        if named != scheme or slashed.startswith("//"):
            scheme, authority, rest = named, None, slashed.lstrip("/")
    elif href.replace("\\", "/").startswith("//"):
        authority, rest = None, href.replace("\\", "/").lstrip("/")
    rest, hash_mark, fragment = rest.partition("#")
    rest, question, query = rest.partition("?")
    rest = rest.replace("\\", "/")
    if authority is None:
        authority, slash, path = rest.partition("/")
        rest = slash + path
    elif rest and not rest.startswith("/"):
        rest = "/" + rest
    credentials, at, host_port = authority.rpartition("@")
    host, colon, port = host_port.partition(":") if not host_port.startswith("[") else (host_port, "", "")
    try:
        host = host.lower() if host.isascii() else unquote(host).lower().encode("idna").decode()
    except UnicodeError:
        return None
    if not host or re.search(r"[\s<>^|%\"#]", host) or (
        port and not (port.isascii() and port.isdigit() and int(port) < 65536)
    ):
        return None
    port = "" if port == "" or port == _DEFAULT_PORT[scheme] else f":{int(port)}"
    address = f"{scheme}://{credentials}{at}{host}{port}"
    address += _clean_path(quote(rest, safe=_PATH_SAFE)) if rest else "/"
    if question:
        address += "?" + quote(query, safe=_QUERY_SAFE)
    if hash_mark:
        address += "#" + quote(fragment, safe=_FRAGMENT_SAFE)
    return address, host
