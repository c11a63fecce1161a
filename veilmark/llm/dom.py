"""A small, forgiving HTML reader: the tree of block elements and the runs of text that they hold."""

from __future__ import annotations

import re
from html import unescape

#: Fixed values of HTML: block elements, elements without content, and those whose content isn't text to read.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg title textarea select object video audio canvas xmp noframes noembed button".split())
#: A start tag closes an open element of its kind, unless one of these lies between.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>|\Z)|[^>]*+))(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I | re.S)
TOKEN = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """Block elements in page order, node 0 being the page itself.

    ``tag``, ``parent``, ``names`` (words of class, id and role), ``chars`` and ``linked`` (own text, and what of it
    lies in links) by node; ``runs``: (node, text) in page order, white space turned into one space.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.names = ["#page"], [-1], [()]
        self.chars, self.linked, self.runs = [0], [0], []
        self._text: list[str] = []
        self._links = self._in_link = 0
        self._stack: list[tuple[str, int]] = [("#page", 0)]  # an inline element has its block's node
        self._read(html)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                node = self._stack[-1][1]
                self.runs.append((node, text))
                self.chars[node] += len(text)
                self.linked[node] += min(self._links, len(text))
            self._text, self._links = [], 0

    def _say(self, raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            self._text.append(text)
            if self._in_link:
                self._links += len(text)

    def _pop(self, depth: int) -> None:
        """Close all elements from this place of the stack on."""
        if any(t in BLOCKS for t, _ in self._stack[depth:]):
            self._flush()
        for t, _ in self._stack[depth:]:
            self._in_link -= t == "a"
        del self._stack[depth:]

    def _start(self, name: str, attrs: str) -> None:
        stack = self._stack
        if name == "a" and self._in_link:
            self._end("a")
        if name not in BLOCKS:
            stack.append((name, stack[-1][1]))
            self._in_link += name == "a"
            return
        self._flush()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == "p":
                self._pop(i)
                break
            if stack[i][0] in BLOCKS:
                break
        if name in SIBLINGS:
            kinds, walls = SIBLINGS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in walls:
                    break
                if stack[i][0] in kinds:
                    self._pop(i)
                    break
        if name in ("html", "body") and any(t == name for t, _ in stack):
            return
        self.tag.append(name)
        self.parent.append(stack[-1][1])
        self.names.append(self._names(attrs) if attrs else ())
        self.chars.append(0)
        self.linked.append(0)
        stack.append((name, len(self.tag) - 1))

    @staticmethod
    def _names(attrs: str) -> tuple[str, ...]:
        out = []
        for m in ATTRIBUTE.finditer(attrs):
            out += TOKEN.findall(CAMEL.sub(" ", unescape(m[2] or m[3] or m[4] or "")).lower())
        return tuple(dict.fromkeys(out))

    def _end(self, name: str) -> None:
        stack = self._stack
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                self._pop(i)
                return
            if stack[i][0] in BLOCKS and name not in BLOCKS:
                return

    def _read(self, html: str) -> None:
        at = 0
        search = TAG.search
        while m := search(html, at):
            self._say(html[at : m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self._say(m[0][9:].removesuffix("]]>"))
                continue
            name = name.lower()
            if m["end"]:
                if name == "br":
                    self._text.append(" ")
                else:
                    self._end(name)
                continue
            if name == "br":
                self._text.append(" ")
            elif name == "hr":
                self._flush()
            elif name in VOID:
                pass
            elif name in RAW:
                if not m["attrs"].rstrip().endswith("/"):
                    close = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                    at = close.end() if close else len(html)
            elif name == "head":
                continue
            else:
                self._start(name, m["attrs"])
        self._say(html[at:])
        self._pop(1)
        self._flush()
