"""Clean text from HTML or JATS, Markdown, wiki and LaTeX markup, alone or mixed.

A text is parsed into one tree whatever the mixture; every node knows which
markup it came from, and a text holds markup if its tree has such a node: an
element, a character reference, or a mark that was taken out.  Paragraphs pass
points for length and commas to their ancestors, discounted by link density; the
best container and those siblings that read like text or hold a heading are
kept.  What is kept is written in one plain notation: ``# `` before headings,
``- `` or ``1. `` before list items, `` | `` between table cells, code indented
by four blanks, and formulas between dollar signs.

Marks that come in pairs are matched by scans with a stack, so nesting and
length are not limited and time grows with the text.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figmill.plans.lineage import spread

# Entity names that HTML reads without a semicolon too.
BARE_ENTITIES = "lt|gt|amp|nbsp|quot"
# LaTeX commands that stand without an argument in running text.
BARE_COMMANDS = "item|par|noindent|newline|linebreak|centering|hline|maketitle|ldots|dots|textbackslash|LaTeX|TeX|bigskip|medskip|smallskip"
# LaTeX commands whose argument is text, and those whose argument is a name to leave out.
TEXT_COMMANDS = "textit|textbf|emph|texttt|textrm|textsf|textsc|underline|textsuperscript|textsubscript|mbox|text|caption|footnote|title|uppercase|mathrm|mathbf|mathit"
NAME_COMMANDS = "label|ref|cite|citep|citet|eqref|autoref|pageref|includegraphics|bibliography|usepackage|documentclass|vspace|hspace"
# HTML and JATS elements by what they are.
BLOCKS = {"p", "div", "section", "article", "main", "body", "html", "header", "footer", "nav", "aside", "blockquote", "ul", "ol", "li", "table", "tr", "pre", "h1", "h2", "h3", "h4", "h5", "h6",
          "title", "caption", "sec", "list", "list-item", "disp-quote", "disp-formula", "figure", "figcaption", "form", "dl", "dt", "dd", "thead", "tbody", "tfoot", "code-block", "math-block", "hr"}
VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "col", "area", "source", "graphic", "inline-graphic", "break"}
HIDDEN = {"script", "style", "noscript", "template", "head"}
CONTAINERS = {"div", "section", "article", "main", "body", "nav", "aside", "header", "footer", "sec", "form", "root"}
#: Share of the best container's score a sibling needs, and length from which a sibling paragraph reads like text.
SIBLING_SHARE, SIBLING_CHARS = 0.2, 80
#: Nesting of elements; deeper ones lie side by side, but for lists, whose depth is written out.
MAX_DEPTH = 100
#: Deepest level of a list that is still indented further.
MAX_INDENT = 200
LIST_TAGS = {"ul", "ol", "list", "li", "list-item"}

#: Private characters: around the number of a piece set aside, and after the kind in the name of an element made from other markup.
_OPEN, _CLOSE, _FROM = "\ue000", "\ue001", "\ue002"
_TAG = r"</?[A-Za-z][A-Za-z0-9:_\ue002-]*(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=`]+))?)*\s*/?>"
_BROKEN_TAG = re.compile(r"</?(?:[a-z][a-z0-9]*:)?(?:p|div|span|b|i|u|em|strong|sub|sup|italic|bold|xref|ref|br|img|a|ul|ol|li|table|tr|td|th|pre|code|math|h[1-6]|font|small)(?=[\s/>]|$)(?=[^<>]*(?:<|$))(?:\s+[\w:-]+\s*=\s*(?:\"[^\"<>]*\"?|'[^'<>]*'?|[^\s<>\"']*))*", re.I)
_REFERENCE = re.compile(rf"&(?:#[0-9]{{1,7}};?|#[xX][0-9A-Fa-f]{{1,6}};?|(?:{BARE_ENTITIES})(?![A-Za-z0-9=;])|([A-Za-z][A-Za-z0-9]{{1,31}});)")
_LINK_TARGET = r"\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+\"[^\"]*\")?\)"
_FORMULA = re.compile(r"(?<![\w$\\])\$(?=[^\s$])[^$\n]*?[^\s$\\]\$(?![\d$])|(?<![\w$\\])\$[^\s$]\$(?![\d$])")
_BULLET, _NUMBER = re.compile(r"[ \t]*[-+*][ \t]+\S"), re.compile(r"[ \t]*\d{1,3}[.)][ \t]+\S")
_WIKI_ITEM, _WIKI_DEEP = re.compile(r"[*#]+[ \t]*\S"), re.compile(r"[*#:;]{2,}[ \t]+\S")
_SEPARATOR = r"[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*"
#: No markup is without one of these; the test spares plain texts the parse.
_SIGNS = re.compile(r"[<&*_~`#\[\]>|\\{}$=]|''|^[ \t]*(?:[-+]|\d{1,3}[.)][ \t])|^[:;]", re.M)
# LaTeX switches inside braces, and sectioning commands by depth.
SWITCHES = "it|bf|em|tt|sc|sl|rm|sf|small|large|itshape|bfseries"
SECTIONS = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 1}
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?[ \t]*(?:\[[^\]\n]*\][ \t]*)*\{|\{\\[A-Za-z]+[ \t]+|\{|\}")


@dataclass
class Node:
    tag: str
    children: list = field(default_factory=list)
    attrs: dict = field(default_factory=dict)
    origin: str = ""
    score: float = 0.0

    def walk(self) -> Iterator:
        """Nodes and strings in order, this node first."""
        todo: list = [self]
        while todo:
            x = todo.pop()
            yield x
            if isinstance(x, Node):
                todo.extend(reversed(x.children))

    def text(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))

    def linked(self) -> int:
        """Characters of text inside links."""
        total, todo = 0, [self]
        while todo:
            x = todo.pop()
            if x.tag == "a":
                total += len(x.text())
            else:
                todo += [c for c in x.children if isinstance(c, Node)]
        return total


class _Builder(HTMLParser):
    """Tolerant tree builder: open elements end with their container; a stray end is kept as a mark."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.stack = [self.root]
        self.blocks = 0  # open elements that are no lists

    def _cut(self, i: int) -> None:
        self.blocks -= sum(n.tag not in LIST_TAGS for n in self.stack[i:])
        del self.stack[i:]

    @staticmethod
    def _name(tag: str) -> tuple[str, str]:
        space, _, name = tag.rpartition(":")
        return name, space[:-1] if space.endswith(_FROM) else "html"

    def handle_starttag(self, tag, attrs):
        tag, origin = self._name(tag)
        if tag in ("li", "list-item", "tr", "td", "th", "p", "dt", "dd"):
            stop = {"ul", "ol", "list", "table", "div", "root", "section", "article", "body"} | ({"tr"} if tag in ("td", "th") else set())
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == tag or (tag in ("td", "th") and self.stack[i].tag in ("td", "th")):
                    self._cut(i)
                    break
                if self.stack[i].tag in stop:
                    break
        node = Node(tag, attrs={k: v or "" for k, v in attrs}, origin=origin)
        self.stack[-1].children.append(node)
        if tag in LIST_TAGS:
            self.stack.append(node)
        elif tag not in VOID and self.blocks < MAX_DEPTH:
            self.blocks += 1
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        tag, origin = self._name(tag)
        self.stack[-1].children.append(Node(tag, attrs={k: v or "" for k, v in attrs}, origin=origin))

    def handle_endtag(self, tag):
        tag, origin = self._name(tag)
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._cut(i)
                return
            if tag not in BLOCKS and self.stack[i].tag in LIST_TAGS:
                break  # an inline end does not close a list
        self.stack[-1].children.append(Node("mark", origin=origin))

    def handle_data(self, data):
        self.stack[-1].children.append(data)


class _Parser:
    """Turns Markdown, wiki and LaTeX into elements, then builds the tree."""

    def __init__(self, text: str):
        self.kept: list[Node] = []
        self.removed: list[str] = []
        self.text = re.sub(r"\r\n?", "\n", text).translate({0xE000: None, 0xE001: None, 0xE002: None})

    def keep(self, tag: str, content: str, origin: str) -> str:
        """Set a piece aside, so that nothing in it is read as markup."""
        self.kept.append(Node(tag, [content], origin=origin))
        return f"{_OPEN}{len(self.kept) - 1}{_CLOSE}"

    def gone(self, origin: str, instead: str = "") -> str:
        """A mark taken out: the tree remembers it."""
        self.removed.append(origin)
        return instead

    @staticmethod
    def element(origin: str, tag: str, content: str, attrs: str = "") -> str:
        return f"<{origin}{_FROM}:{tag}{attrs}>{content}</{origin}{_FROM}:{tag}>"

    def tree(self) -> Node:
        t = self._aside(self.text)
        # outside code a run of blanks or line ends means no more than a short one
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{12,}", " " * 12, t))
        t = self._inline(self._tables(self._blocks(t)))
        if "&" in t:
            t = _REFERENCE.sub(lambda m: m[0] if m[1] and m[1] + ";" not in html.entities.html5 else self.keep("charref", html.unescape(m[0]), "html"), t)
        if "<" in t:
            t = re.sub(rf"<(?!(?:{_TAG[1:]}))", "&lt;", t.replace("&", "&amp;"))
            b = _Builder()
            b.feed(t)
            b.close()
            root = b.root
        else:
            root = Node("root", [t])
        self._restore(root)
        root.children += [Node("mark", origin=k) for k in dict.fromkeys(self.removed)]
        return root

    def _pieces(self, text: str) -> list:
        """A string with the pieces set aside put back as nodes, and pieces inside them as text."""
        out, at = [], 0
        for m in re.finditer(f"{_OPEN}([0-9]+){_CLOSE}", text):
            out.append(text[at:m.start()])
            node = self.kept[int(m[1])]
            inner = node.children[0]
            while isinstance(inner, str) and _OPEN in inner:
                inner = re.sub(f"{_OPEN}([0-9]+){_CLOSE}", lambda x: self.kept[int(x[1])].children[0], inner)
            node.children = [inner]
            out.append(node)
            at = m.end()
        out.append(text[at:])
        return [c for c in out if c != ""]

    def _restore(self, root: Node) -> None:
        if not self.kept:
            return
        for node in [x for x in root.walk() if isinstance(x, Node)]:
            node.attrs = {k: re.sub(f"{_OPEN}([0-9]+){_CLOSE}", lambda x: self.kept[int(x[1])].children[0], v) for k, v in node.attrs.items()}
            if any(isinstance(c, str) and _OPEN in c for c in node.children):
                node.children = [p for c in node.children for p in (self._pieces(c) if isinstance(c, str) else [c])]

    def _aside(self, t: str) -> str:
        keep, gone = self.keep, self.gone
        if "&lt;" in t:  # simple tags that were escaped once more are tags
            t = re.sub(r"&lt;(/?[A-Za-z][A-Za-z0-9]*[ \t]*/?)&gt;", lambda m: gone("html", f"<{m[1]}>"), t)
        if "<!" in t or "<?" in t:
            t = re.sub(r"<!--.*?(?:-->|\Z)", lambda m: gone("html"), t, flags=re.S)
            t = re.sub(r"<!\[CDATA\[(.*?)(?:\]\]>|\Z)", lambda m: keep("raw", m[1], "html"), t, flags=re.S | re.I)
            t = re.sub(r"<!DOCTYPE[^>]*(?:>|\Z)|<\?xml[^>]*(?:>|\Z)", lambda m: gone("html"), t, flags=re.I)
        if "<" in t:
            t = re.sub(r"<nowiki>(.*?)(?:</nowiki>|\Z)", lambda m: keep("raw", m[1], "wiki"), t, flags=re.S | re.I)
        if "```" in t or "~~~" in t:
            t = re.sub(r"^ {0,3}(```+|~~~+)[^\n]*\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", lambda m: "\n" + keep("code-block", m[2].rstrip("\n"), "markdown") + "\n", t, flags=re.S | re.M)
            t = re.sub(r"^ {0,3}(?:```+|~~~+)", lambda m: gone("markdown"), t, flags=re.M)
        if "\\begin{" in t:
            t = re.sub(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(.*?)(?:\\end\{\1\*?\}|\Z)", lambda m: "\n" + keep("code-block", m[2].strip("\n"), "latex") + "\n", t, flags=re.S)
        if "<" in t:
            t = re.sub(r"<pre[^<>]*>(.*?)(?:</pre>|\Z)", lambda m: "\n" + keep("code-block", html.unescape(re.sub(r"</?code[^<>]*>", "", m[1])).strip("\n"), "html") + "\n", t, flags=re.S | re.I)
            t = re.sub(r"<code[^<>]*>(.*?)(?:</code>|\Z)", lambda m: keep("code", html.unescape(re.sub(_TAG, "", m[1])), "html"), t, flags=re.S | re.I)
        if "\\begin{" in t:
            t = re.sub(r"\\begin\{(equation|align|gather|displaymath|math|eqnarray|multline)\*?\}(.*?)(?:\\end\{\1\*?\}|\Z)", lambda m: keep("math-block", m[2].strip(), "latex"), t, flags=re.S)
        if "$" in t:
            t = re.sub(r"\$\$(.+?)\$\$", lambda m: keep("math-block", m[1].strip(), "latex"), t, flags=re.S)
        for end, tag in (("\\]", "math-block"), ("\\)", "math")):
            last = t.rfind(end) + 2  # beyond the last end nothing is closed
            if last > 1:
                start = "\\[" if tag == "math-block" else "\\("
                t = re.sub(rf"{re.escape(start)}(.+?){re.escape(end)}", lambda m: keep(tag, m[1].strip(), "latex"), t[:last], flags=re.S) + t[last:]
        if "$" in t:
            t = _FORMULA.sub(lambda m: keep("math", m[0][1:-1].strip(), "latex"), t)
        if "<" in t:
            t = re.sub(r"<((?:\w+:)?math)\b[^<>]*>(.*?)(?:</\1>|\Z)", lambda m: keep("math", html.unescape(re.sub(_TAG, "", m[2])).strip(), "html"), t, flags=re.S | re.I)
        if "\\SI" in t:
            t = re.sub(r"\\SI(?:range)?\{([^{}]*)\}\{((?:[^{}]|\{[^{}]*\})*)\}", lambda m: keep("math", f"{m[1]}\\,{m[2]}", "latex"), t)
        if "`" in t:
            t = re.sub(r"(?<!`)(`{1,2})(?!`)([^`\n]+)(?<!`)\1(?!`)", lambda m: keep("code", m[2].strip(), "markdown"), t)
        return t

    def _blocks(self, t: str) -> str:
        """Line structure of Markdown, wiki and LaTeX as elements."""
        gone, element = self.gone, self.element
        heading = lambda origin, level, text: f"\n{element(origin, f'h{level}', text)}\n"
        self.refs: dict[str, str] = {}
        if "]:" in t:
            t = re.sub(r"^ {0,3}\[([^\[\]\n]+)\]:[ \t]*(\S+)[^\n]*$", lambda m: gone("markdown", self.refs.setdefault(m[1].lower(), m[2]) and ""), t, flags=re.M)
        if "__" in t:
            t = re.sub(r"__[A-Z]{3,}__", lambda m: gone("wiki"), t)
        if "=" in t:
            t = re.sub(r"^(={1,6})[ \t]*([^=\n]+?)[ \t]*(={1,6})[ \t]*$", lambda m: heading("wiki", min(len(m[1]), len(m[3])), m[2]), t, flags=re.M)
        if "#" in t:
            t = re.sub(r"^ {0,3}(#{1,6})[ \t]+(\S[^\n]*)$", lambda m: heading("markdown", len(m[1]), re.sub(r"(?:^|(?<=\s))#+$", "", m[2].rstrip()).rstrip()), t, flags=re.M)
        if "---" in t or "===" in t:
            t = re.sub(r"^(?=[^\n]*\S)([^\n]+)\n {0,3}(=|-)\2{2,}[ \t]*$", lambda m: heading("markdown", 1 if m[2] == "=" else 2, m[1].strip()), t, flags=re.M)
        if "\\" in t:
            for env, tag in (("itemize", "ul"), ("enumerate", "ol"), ("description", "ul")):
                t = re.sub(rf"\\begin\{{{env}\}}(?:\[[^\]]*\])?", f"<latex{_FROM}:{tag}>", t)
                t = re.sub(rf"\\end\{{{env}\}}", f"</latex{_FROM}:{tag}>", t)
            t = re.sub(r"(?<![\w:\\/.-])\\item(?![A-Za-z])(?:\[([^\]]*)\])?\s*", lambda m: f"<latex{_FROM}:li>" + (m[1] + " " if m[1] else ""), t)
            cell = lambda c: element("latex", "td", c.strip())
            t = re.sub(r"\\begin\{tabular\}(?:\{[^{}]*\})?(.*?)(?:\\end\{tabular\}|\Z)", lambda m: element("latex", "table", "".join(element("latex", "tr", "".join(map(cell, re.split(r"(?<!\\)&", r)))) for r in re.split(r"\\\\", m[1].replace("\\hline", "")) if r.strip())), t, flags=re.S)
            t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", lambda m: gone("latex", "\n"), t)
        return self._lists(t) if re.search(r"^[ \t]*(?:[-+*#:;>]|\d{1,3}[.)])", t, flags=re.M) else t

    @staticmethod
    def _listed(lines: list[str]) -> tuple[bool, bool, bool]:
        """Whether the text has lists of bullets, of numbers and of wiki marks: two items without a blank line between them, or a deeper wiki mark."""
        bullets = numbers = wiki = False
        seen_b = seen_n = before = False
        for line in lines:
            if not line.strip():
                seen_b = seen_n = before = False
                continue
            b, n, w = _BULLET.match(line), _NUMBER.match(line), _WIKI_ITEM.match(line)
            bullets |= bool(b and seen_b)
            numbers |= bool(n and seen_n)
            wiki |= bool(_WIKI_DEEP.match(line)) or bool(w and before)
            seen_b, seen_n, before = seen_b or bool(b), seen_n or bool(n), bool(w) and line[1:2] not in ("*", "#") or bool(w and before)
        return bullets, numbers, wiki

    def _lists(self, t: str) -> str:
        lines = t.split("\n")
        bullets, numbers, wiki = self._listed(lines)
        quotes = any(re.match(r" {0,3}>[ \t]?\S", x) for x in lines)
        out, open_lists = [], []
        for line in lines:
            m = origin = None
            if bullets or numbers:
                m = re.match(r"([ \t]*)([-+*]|\d{1,3}[.)])[ \t]+(\S.*)$", line)
                if m and not (numbers if m[2][0].isdigit() else bullets):
                    m = None
                origin = "markdown"
            if m is None and (wiki or bullets):
                m = re.match(r"()([*#:;]{2,})[ \t]+(\S.*)$", line) or (re.match(r"()([*#]+)[ \t]*(?![*#])(\S.*)$", line) if wiki else None)
                origin = "wiki"
            if m:
                depth = len(m[2]) if origin == "wiki" else 1 + len(m[1].expandtabs(4)) // 2
                tag = "ol" if m[2][-1] in ".)#" else "ul"
                while len(open_lists) > depth or (open_lists and len(open_lists) == depth and open_lists[-1][1] != tag):
                    out.append("</{}{}:{}>".format(open_lists[-1][0], _FROM, open_lists.pop()[1]))
                while len(open_lists) < depth:
                    open_lists.append((origin, tag))
                    out.append(f"<{origin}{_FROM}:{tag}>")
                out.append(self.element(origin, "li", m[3]))
                continue
            while open_lists:
                out.append("</{}{}:{}>".format(open_lists[-1][0], _FROM, open_lists.pop()[1]))
            q = re.match(r" {0,3}>[ \t]?(.*)$", line) if quotes else None
            out.append(self.element("markdown", "blockquote", q[1]) if q else line)
        out += [f"</{o}{_FROM}:{x}>" for o, x in reversed(open_lists)]
        return "\n".join(out)

    def _tables(self, t: str) -> str:
        element, gone = self.element, self.gone

        def rows(origin: str, table: list[list[str]]) -> str:
            return "\n" + element(origin, "table", "".join(element(origin, "tr", "".join(element(origin, "td", c) for c in r)) for r in table if r)) + "\n"

        def wiki(m: re.Match) -> str:
            table: list[list[str]] = [[]]
            for line in m[1].split("\n")[1:]:
                line = line.strip()
                if line.startswith("|-"):
                    table.append([])
                elif line[:1] in ("|", "!") and not line.startswith("|}"):
                    table[-1] += [re.sub(r"^[^|\[\]]*=[^|\[\]]*\|(?!\|)", "", c).strip() for c in re.split(r"\|\||!!", line[1:])]
            return rows("wiki", table)

        def pipes(m: re.Match) -> str:
            lines = [x.strip().strip("|") for x in m[0].strip("\n").split("\n")]
            return rows("markdown", [[c.strip() for c in x.split("|")] for i, x in enumerate(lines) if i != 1])

        if "|" not in t:
            return t
        t = re.sub(r"^\{\|(.*?)(?:^\|\}[ \t]*$|\Z)", wiki, t, flags=re.S | re.M)
        t = re.sub(rf"^(?=[^\n]*\|)[^\n]+\n{_SEPARATOR}(?:\n[^\n]*\|[^\n]*)*", pipes, t, flags=re.M)
        t = re.sub(rf"^{_SEPARATOR}$", lambda m: gone("markdown"), t, flags=re.M)
        return re.sub(r"^\|\}|^\|-+", lambda m: gone("wiki"), t, flags=re.M)

    def _paired(self, t: str, sign: str, ends: str, least: int, most: int, origin: str, word: bool, escape: bool) -> str:
        """Emphasis: runs of a sign that open and close within a stretch of text that holds no ``ends``."""
        out = []
        for part in t.split(ends):
            stack: dict[int, list[tuple[int, int]]] = {}
            cuts: list[tuple[int, int, str]] = []
            for m in re.finditer(re.escape(sign) + "+", part):
                a, b = m.span()
                if b - a < least or (b - a > most and word):
                    continue
                n = b - a if word else 0
                left, right = part[a - 1:a], part[b:b + 1]
                side = lambda c: c != "" and (c.isalnum() or c == "_")
                closes = left != "" and not left.isspace() and not (escape and left == "\\") and not (word and side(right))
                opens = right != "" and not right.isspace() and not (word and (side(left) or left == "\\"))
                if closes and stack.get(n):
                    x, y = stack[n].pop()
                    cuts += [(x, y, f"<{origin}{_FROM}:em>"), (a, b, f"</{origin}{_FROM}:em>")]
                elif opens:
                    stack.setdefault(n, []).append((a, b))
            if cuts:
                text, at = [], 0
                for a, b, tag in sorted(cuts):
                    text += [part[at:a], tag]
                    at = b
                part = "".join([*text, part[at:]])
            out.append(part)
        return ends.join(out)

    def _templates(self, t: str) -> str:
        """Wiki templates from the inside out: their arguments remain."""
        pieces, starts = [], []
        for x in re.split(r"(\{\{|\}\})", t):
            if x == "{{":
                starts.append(len(pieces))
                pieces.append(x)
            elif x == "}}" and starts:
                at = starts.pop()
                content = "".join(pieces[at + 1:])
                if not content:
                    pieces.append(x)
                    continue
                args = [a.partition("=")[2].strip() if "=" in re.sub("<[^<>]*>", "", a) else a.strip() for a in content.split("|")[1:]]
                pieces[at:] = [self.gone("wiki", " ".join(args))]
            else:
                pieces.append(x)
        return "".join(pieces)

    def _commands(self, t: str) -> str:
        """LaTeX commands with braces, nested to any depth; what is left open loses its command."""
        out: list[str] = []
        stack: list[tuple[str, int, str]] = []  # what opened, where its piece lies, what to write at its end
        at, wait = 0, None
        for m in _COMMAND.finditer(t):
            if m.start() < at:
                continue
            if m.start() > at or m[0] != "{":
                wait = None if m[0] != "{" or t[at:m.start()].strip() else wait
            out.append(t[at:m.start()])
            at = m.end()
            if m[0] == "}":
                if not stack:
                    out.append("}")
                    continue
                what, where, end = stack.pop()
                if what == "href":
                    wait = "".join(out[where + 1:])
                    del out[where:]
                elif what == "name":
                    del out[where:]
                else:
                    out.append(end)
                continue
            if m[0] == "{" and wait is not None:
                out.append(f'<latex{_FROM}:a href="{html.escape(wait)}">')
                stack.append(("text", len(out) - 1, f"</latex{_FROM}:a>"))
                wait = None
                continue
            wait = None
            if m[1]:
                self.removed.append("latex")
                name, start, end = m[1], "", ""
                if name in SECTIONS:
                    start, end = f"\n<latex{_FROM}:h{SECTIONS[name]}>", f"</latex{_FROM}:h{SECTIONS[name]}>\n"
                elif name in ("cite", "ref", "eqref", "autoref"):
                    start, end = "[", "]"
                elif name == "textsuperscript":
                    start = "^"
                elif name == "textsubscript":
                    start = "_"
                what = "href" if name == "href" else "name" if re.fullmatch(NAME_COMMANDS, name) and not start else "text"
                out.append(start)
                stack.append((what, len(out) - 1, end))
            elif m[0] == "{":
                out.append("{")
                stack.append(("brace", len(out) - 1, "}"))
            else:  # a switch inside braces
                self.removed.append("latex")
                out.append("")
                stack.append(("text", len(out) - 1, ""))
        out.append(t[at:])
        for what, where, end in stack:
            if what == "text" and end:
                out.append(end)
        return "".join(out)

    def _inline(self, t: str) -> str:
        gone, element = self.gone, self.element
        link = lambda origin, text, url: element(origin, "a", text, f' href="{html.escape(url)}"')
        if "](" in t:
            t = re.sub(r"!\[([^\[\]\n]*)\]" + _LINK_TARGET, lambda m: gone("markdown", m[1]), t)
            t = re.sub(r"\[([^\[\]\n]*)\]" + _LINK_TARGET, lambda m: link("markdown", m[1], m[2]), t)
        if "][" in t:
            t = re.sub(r"\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]", lambda m: link("markdown", m[1], self.refs.get((m[2] or m[1]).lower(), "")), t)
        if "<http" in t:
            t = re.sub(r"<(https?://[^\s<>]+)>", lambda m: link("markdown", m[1], m[1]), t)
        if "[[" in t:
            t = re.sub(r"\[\[(?:File|Image|Datei|Fichier):([^\[\]\n]*)\]\]", lambda m: gone("wiki", m[1].split("|")[-1] if "|" in m[1] else ""), t, flags=re.I)
            t = re.sub(r"\[\[(?=[^\[\]\n])([^\[\]|\n]*)(?:\|([^\[\]\n]*))?\]\]", lambda m: link("wiki", m[2] or m[1], m[1]), t)
        if "[http" in t:
            t = re.sub(r"\[(https?://[^\s\]]+)(?:\s+([^\]\n]*))?\]", lambda m: link("wiki", m[2] or m[1], m[1]), t)
        if "{{" in t:
            t = self._templates(t)
        if "''" in t:
            quoted = "``" in t
            if quoted:
                t = re.sub(r"``([^`'\n]+?)\\?''", lambda m: gone("latex", f'"{m[1]}"'), t)
            t = self._paired(t, "'", "\n", 2, 0, "wiki", False, False)
        if "*" in t:
            t = self._paired(t, "*", "\n\n", 1, 3, "markdown", True, True)
        if "_" in t:
            t = self._paired(t, "_", "\n", 1, 3, "markdown", True, False)
        if "~~" in t:
            t = re.sub(r"~~(?=\S)([^~\n]+?)(?<=\S)~~", lambda m: element("markdown", "s", m[1]), t)
        if "\\" in t:
            t = self._commands(t)
            t = re.sub(rf"(?<![\w:\\/.-])\\(?:{BARE_COMMANDS})(?![A-Za-z])[ \t]*", lambda m: gone("latex", " "), t)
            t = re.sub(r"(?<![\\:/])\\([%&$#_{}])(?![A-Za-z]{2,}\\)", lambda m: gone("latex", self.keep("raw", m[1], "latex") if m[1] == "&" else m[1]), t)
        if "latex" in self.removed or any(n.origin == "latex" for n in self.kept):
            t = re.sub(r"(?<=[^\s~])~(?=[^\s~])", " ", t)
        if "<" in t:
            t = _BROKEN_TAG.sub(lambda m: gone("html"), t)
        return t


def parse(text: str | None) -> Node:
    """The tree of a text; a plain text is a root with one string."""
    if not text:
        return Node("root")
    if not _SIGNS.search(text):
        return Node("root", [text])
    if sys.getrecursionlimit() < 1_000_000:
        sys.setrecursionlimit(1_000_000)  # lists may be nested as deep as the text is long; Python calls take no C stack
    return _Parser(text).tree()


def kinds_of(root: Node) -> list[str]:
    """Kinds of markup the tree came from: html, markdown, wiki, latex; none for plain signs."""
    if len(root.children) == 1 and isinstance(root.children[0], str):
        return []
    found = {x.origin for x in root.walk() if isinstance(x, Node)}
    return [k for k in ("html", "markdown", "wiki", "latex") if k in found]


def markup_kinds(text: str | None) -> list[str]:
    return kinds_of(parse(text))


_HEADING = re.compile(r"h[1-6]|title")


def score_tree(root: Node) -> None:
    """Points of paragraphs, passed to the containers above: all to a parent, half to the next, less beyond; then discounted by link density."""
    above: list[tuple[Node, int]] = []  # open containers and their depths
    todo: list[tuple[Node, int, bool]] = [(root, 0, False)]
    while todo:
        node, depth, left = todo.pop()
        if left:
            own = "".join(c if isinstance(c, str) else c.text() if c.tag not in BLOCKS else "" for c in node.children).strip()
            if own and (node.tag in CONTAINERS or node.tag in ("p", "blockquote", "pre", "td", "li", "code-block", "math-block", "figcaption", "caption") or node.tag.startswith("h")):
                points = 1 + own.count(",") + own.count("，") + min(len(own) / 100, 3)
                first = depth if node.tag in CONTAINERS else depth - 1
                for a, d in above:
                    far = first - d
                    a.score += points / (1 if far == 0 else 2 if far == 1 else 3 * far)
            if node.tag in CONTAINERS:
                above.pop()
                size = len(node.text())
                node.score *= 1 - (node.linked() / size if size else 0)
            continue
        if node.tag in CONTAINERS:
            above.append((node, depth))
        todo.append((node, depth, True))
        todo += [(c, depth + 1, False) for c in reversed(node.children) if isinstance(c, Node)]


def main_content(root: Node) -> list:
    """The best container with the siblings, of it and of what holds it, that read like text or hold a heading; the whole tree where no container stands out."""
    score_tree(root)
    best, path = root, [root]
    todo: list[tuple[Node, list[Node]]] = [(root, [root])]
    while todo:
        node, way = todo.pop()
        if node.score > best.score:
            best, path = node, way
        for c in reversed(node.children):
            if isinstance(c, Node) and c.tag not in ("ul", "ol", "list"):
                todo.append((c, [*way, c] if c.tag in CONTAINERS else way))
    if best is root:
        return [root]
    held = {id(n) for n in path}

    def kept(parent: Node) -> list:
        out: list = []
        for c in parent.children:
            if c is best or isinstance(c, str):
                out.append(c)
            elif id(c) in held:
                out += kept(c)
            elif any(id(x) in held for x in c.walk()):
                out += kept(c)
            else:
                text = c.text().strip()
                density = c.linked() / len(text) if text else 1
                if c.tag not in CONTAINERS:
                    if density < 0.5 and (text or c.tag in VOID):
                        out.append(c)
                elif c.score >= SIBLING_SHARE * best.score or (len(text) > SIBLING_CHARS and density < 0.25) or (density < 0.5 and any(isinstance(x, Node) and _HEADING.fullmatch(x.tag) for x in c.walk())):
                    out.append(c)
        return out

    return [Node("root", kept(root))]


def render(nodes: list) -> str:
    """Kept nodes in the plain notation."""
    lines: list[str] = [""]

    def brk() -> None:
        if lines[-1].strip():
            lines.append("")

    def flow(node, depth: int) -> None:
        if isinstance(node, str):
            lines[-1] += re.sub(r"[ \t\n]+", " ", node)
            return
        tag = node.tag
        if tag in HIDDEN:
            return
        if tag in ("br", "break", "hr"):
            lines.append("")
        elif tag in ("img", "graphic", "inline-graphic"):
            lines[-1] += node.attrs.get("alt", "")
        elif tag in ("code-block", "pre"):
            brk()
            lines.extend("    " + x for x in node.text().split("\n"))
            lines.append("")
        elif tag in ("code", "raw"):
            lines[-1] += node.text()
        elif tag in ("math", "math-block"):
            lines[-1] += f"${node.text()}$"
        elif _HEADING.fullmatch(tag):
            brk()
            lines[-1] = "#" * (int(tag[1]) if tag[0] == "h" else 1) + " "
            for c in node.children:
                flow(c, depth)
            lines.append("")
        elif tag == "tr":
            brk()
            cells = [c for c in node.children if isinstance(c, Node)]
            lines[-1] = " | ".join(re.sub(r"\s+", " ", render([Node("span", c.children)])).strip() for c in cells)
            lines.append("")
        elif tag in ("ul", "ol", "list"):
            brk()
            items = 0
            for c in node.children:
                if isinstance(c, Node) and c.tag in ("li", "list-item"):
                    items += 1
                    brk()
                    lines[-1] = "  " * min(depth, MAX_INDENT) + ("- " if tag != "ol" else f"{items}. ")
                    for x in c.children:
                        flow(x, depth + 1)
                    brk()
                elif isinstance(c, Node):
                    flow(c, depth + 1)
                elif c.strip():
                    flow(c, depth)
            brk()
        elif tag in ("blockquote", "disp-quote"):
            brk()
            for x in render(node.children).split("\n"):
                lines[-1] = f"> {x}"
                lines.append("")
        elif tag not in BLOCKS:
            lines[-1] += {"ref": " ", "sup": "^", "sub": "_"}.get(tag, "")
            for c in node.children:
                flow(c, depth)
        else:
            brk()
            for c in node.children:
                flow(c, depth)
            brk()

    for n in nodes:
        flow(n, 0)
    out = [x.rstrip() if x.startswith("    ") else re.sub(r"(?<=\S)[ \t\u00a0]+", " ", x).rstrip() for x in lines]
    out = [x if x.startswith("  ") else x.lstrip() for x in out]
    return "\n".join(x for x in out if x.strip())


def read(text: str | None) -> tuple[str | None, list[str]]:
    """Clean text and kinds of markup of one text; a text whose tree holds no markup is itself."""
    root = parse(text)
    kinds = kinds_of(root)
    return (render(main_content(root)), kinds) if kinds else (text, [])


def clean(text: str | None) -> str | None:
    return read(text)[0]


def markup_to_text(rows: DataFrame, ident: str = "row_no", text: str = "caption") -> DataFrame:
    """``ident, clean, kinds``: the clean text of each row and the kinds of markup its tree holds.

    Null stays null and empty stays empty, both without kinds; a text without
    markup comes out unchanged; broken or unclosed markup is read as far as it
    goes; whole texts are parsed; repeated rows give repeated rows; an empty
    table gives no rows; other columns are not read.  One pass of Arrow batches.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in got], pa.string()), pa.array([k for _, k in got], pa.list_(pa.string()))], names=["ident", "clean", "kinds"])

    schema = T.StructType([T.StructField("ident", rows.schema[ident].dataType), T.StructField("clean", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])
    return spread(rows.select(F.col(ident).alias("ident"), F.col(text).alias("text")), "ident").mapInArrow(run, schema).withColumnRenamed("ident", ident)
