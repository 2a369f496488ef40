"""A small tolerant HTML reader: block trees without inline markup, scripts and styles."""

from __future__ import annotations

import html
import re

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content is no markup, and of which nothing is read.
RAW = {"script", "style", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "textarea", "title", "svg", "math", "canvas", "object", "audio", "video"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "label",
}
#: What an opening tag ends, if it is open and no closer scope lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = {"html", "table", "td", "th", "button", "object", "template"}
#: Levels of a tree at most, as in browsers: what is nested deeper lies side by side in the last one.
DEPTH = 512
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>",
    re.S,
)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """An element (tag, attrs, children) or, with the tag "", a run of text."""

    __slots__ = ("attrs", "children", "label", "linked", "tag", "text")

    def __init__(self, tag: str, attrs: dict | None = None, text: str = "", linked: int = 0):
        self.tag, self.attrs, self.text, self.linked, self.children = tag, attrs or {}, text, linked, []
        self.label = f"{tag}.{self.attrs.get('class', '')}" if tag else ""


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(raw)} if raw and not raw.isspace() else {}


def parse(page: str) -> Node:
    """The tree of block elements. A text node is the text between two block boundaries: character references decoded,
    white space made one blank, trimmed; `linked` counts its characters inside links."""
    root = Node("#root")
    stack, run, in_links, linked = [root], [], 0, 0
    opened: dict[str, int] = {}

    def flush() -> None:
        nonlocal run, linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                stack[-1].children.append(Node("", None, text, linked))
            run, linked = [], 0

    def close(upto: int) -> None:
        flush()
        for x in stack[upto:]:
            opened[x.tag] -= 1
        del stack[upto:]

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            run.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            text = html.unescape(page[at : m.start()])
            run.append(text)
            linked += len(text) if in_links else 0
        at = m.end()
        if m["cdata"]:
            run.append(m["cdata"])
        elif m["end"]:
            tag = m["end"].lower()
            if tag in INLINE:
                in_links = 0 if tag == "a" else in_links
            elif tag not in VOID:
                for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                    if stack[i].tag == tag:
                        close(i)
                        break
                else:
                    flush()
        elif m["tag"]:
            tag = m["tag"].lower()
            if tag in RAW:
                if not m["attrs"].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
                    at = end.end() if end else n
            elif tag == "br":
                run.append(" ")
            elif tag in INLINE:
                in_links = 1 if tag == "a" else in_links
            else:
                flush()
                if tag == "hr" or tag in VOID:
                    continue
                if tag in ENDS:
                    ends, scope = ENDS[tag]
                    for i in range(len(stack) - 1, 0, -1) if any(map(opened.get, ends)) else ():
                        if stack[i].tag in scope:
                            break
                        if stack[i].tag in ends:
                            close(i)
                            if tag not in ("tr", "tbody"):
                                break
                else:
                    for i in range(len(stack) - 1, 0, -1) if opened.get("p") else ():
                        if stack[i].tag in SCOPE:
                            break
                        if stack[i].tag == "p":
                            close(i)
                            break
                node = Node(tag, attributes(m["attrs"]))
                stack[min(len(stack), DEPTH) - 1].children.append(node)
                stack.append(node)
                opened[tag] = opened.get(tag, 0) + 1
    flush()
    return root


def text_size(node: Node) -> int:
    todo, n = [node], 0
    while todo:
        x = todo.pop()
        n += len(x.text)
        todo += x.children
    return n
