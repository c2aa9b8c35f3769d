"""One page as tokens, and the extents of its elements (helpers of H3, H7, H17, H18, S3).

A page is one row; these functions run inside Arrow batches and never see
more than that row.  They are linear in the page.

Contract for malformed HTML: void tags, self-closing tags, scripts and styles
have no subtree; the start of some elements ends others (CLOSED_BY); an end
tag ends everything opened within its element; an inline end tag does not
reach past an open element that is not inline, and an end tag that finds no
element is plain text of the page; what is still open ends with the page.
Nothing is re-serialised: tokens joined always spell the page.
"""

from __future__ import annotations

import re
import shlex
from collections import Counter

# Void elements, inline elements, and elements that a start tag ends.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "param", "source", "track", "wbr"]
INLINE_TAGS = ["a", "abbr", "b", "big", "cite", "code", "em", "font", "i", "label", "mark", "nobr", "q", "s",
               "small", "span", "strike", "strong", "sub", "sup", "tt", "u"]
CLOSED_BY = {
    "p": ["address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl",
          "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
          "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"],
    "li": ["li"], "dt": ["dd", "dt"], "dd": ["dd", "dt"],
    "option": ["optgroup", "option"],
    "td": ["tbody", "td", "tfoot", "th", "thead", "tr"], "th": ["tbody", "td", "tfoot", "th", "thead", "tr"],
    "tr": ["tbody", "tfoot", "thead", "tr"],
    "tbody": ["tbody", "tfoot", "thead"], "tfoot": ["tbody", "tfoot", "thead"], "thead": ["tbody", "tfoot", "thead"],
    "head": ["body"],
}
#: An implied end does not reach out of these; that of a ``p`` out of no element that is not inline.
HELD_BY = {"li": ["menu", "ol", "ul"], "dt": ["dl"], "dd": ["dl"], "option": ["select"], "td": ["table"],
           "th": ["table"], "tr": ["table"], "tbody": ["table"], "tfoot": ["table"], "thead": ["table"], "head": []}

_VOID, _INLINE = frozenset(VOID_TAGS), frozenset(INLINE_TAGS)
_ENDS: dict[str, frozenset[str]] = {
    t: frozenset(x for x, by in CLOSED_BY.items() if t in by) for t in {t for by in CLOSED_BY.values() for t in by}}
_HELD = {x: frozenset(by) for x, by in HELD_BY.items()}
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
_RAW = re.compile(r"<(script|style)\b", re.I | re.A)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I | re.A) for t in ("script", "style")}


def tokens(page: str) -> list[str]:
    """Scripts, styles and comments whole, tags, texts; a '<' that begins no tag by itself."""
    out, at, n = [], 0, len(page)
    gone = set()  # what the rest of the page does not hold is not searched again
    while at < n:
        end = -1
        if page[at] != "<":
            end = page.find("<", at)
            end = n if end < 0 else end
        elif (m := _RAW.match(page, at)) and (tag := m[1].lower()) not in gone:
            close = _RAW_END[tag].search(page, m.end())
            if close:
                end = close.end()
            else:
                gone.add(tag)
        elif page.startswith("<!--", at) and "-->" not in gone:
            end = page.find("-->", at + 4)
            if end < 0:
                gone.add("-->")
            else:
                end += 3
        if end < 0 and ">" not in gone:
            end = page.find(">", at) + 1 or -1
            if end < 0:
                gone.add(">")
        out.append(page[at:end] if end > 0 else "<")
        at += len(out[-1])
    return out


def kinds(toks: list[str]) -> tuple[list[str], list[str]]:
    """(tag name, kind) of each token; kind: text, comment, decl, raw, void, open or close."""
    names, out = [], []
    for t in toks:
        m = _TAG.match(t) if t[0] == "<" else None
        tag = m[1].lower() if m else ""
        if tag:
            kind = ("close" if t[1] == "/" else "raw" if tag in _RAW_END
                    else "void" if tag in _VOID or t.endswith("/>") else "open")
        else:
            kind = ("comment" if t.startswith("<!--") else "decl" if t.startswith(("<!", "<?")) else "text")
        names.append(tag)
        out.append(kind)
    return names, out


def _implied(stack: list[int], names: list[str], tag: str) -> int:
    """Stack index of the outermost element that a start of ``tag`` ends; the stack's length when none."""
    ends, low, above, inline = _ENDS[tag], len(stack), set(), True
    for j in range(len(stack) - 1, -1, -1):
        x = names[stack[j]]
        if x in ends and (inline if x == "p" else not _HELD[x] & above):
            low = j
        inline = inline and x in _INLINE
        above.add(x)
        if not inline and all(e == "p" or _HELD[e] & above for e in ends):
            break
    return low


def extents(names: list[str], kind: list[str]) -> tuple[list[int], list[int]]:
    """Last token of each element (-1 for other tokens), and the elements open at the end of the page."""
    end, stack, opened = [-1] * len(names), [], Counter()

    def cut(to: int, at: int) -> None:
        for p in stack[to:]:
            end[p] = at - 1
            opened[names[p]] -= 1
        del stack[to:]

    for i, (tag, k) in enumerate(zip(names, kind)):
        if k in ("open", "void"):
            if any(opened[x] for x in _ENDS.get(tag, ())):
                cut(_implied(stack, names, tag), i)
            if k == "void":
                end[i] = i
            else:
                stack.append(i)
                opened[tag] += 1
        elif k == "raw":
            end[i] = i
        elif k == "close" and opened[tag]:
            j = len(stack) - 1
            while j >= 0 and names[stack[j]] != tag:
                j = -1 if tag in _INLINE and names[stack[j]] not in _INLINE else j - 1
            if j >= 0:
                p = stack[j]
                cut(j, i)
                end[p] = i
    still = list(stack)
    cut(0, len(names))
    return end, still


# ------------------------------------------------------------------ node specs
_SPEC_TAG = re.compile(r"\s*(\*|[A-Za-z][A-Za-z0-9]*)(?=\s|$)")
_SPEC_ATTR = re.compile(r"""\s+([A-Za-z][-\w:]*)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def parse_spec(spec: str | None) -> tuple[str, list[tuple[str, str]]] | None:
    """'tag attr="value" ...' -> (tag, [(attr, value)]); the tag may be ``*``; None when it is no spec."""
    m = _SPEC_TAG.match(spec or "")
    if not m:
        return None
    attrs, at = [], m.end()
    while a := _SPEC_ATTR.match(spec, at):
        attrs.append((a[1].lower(), a[2] if a[2] is not None else a[3]))
        at = a.end()
    return (m[1].lower(), attrs) if not spec[at:].strip() else None


def _attr_rx(name: str) -> re.Pattern:
    return re.compile(rf"""\s{re.escape(name)}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*))""", re.I)


def parse_index(spec: str | None) -> tuple[str, list[tuple[str, str]]] | None:
    """A container: words, the tag (``*`` without one) and attr=value, values quoted or not; None when empty or unreadable."""
    try:
        words = shlex.split(spec or "")
    except ValueError:
        return None
    tag, attrs = "*", []
    for w in words:
        name, sign, value = w.partition("=")
        if sign:
            attrs.append((name.lower(), value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value))
        else:
            tag = w.lower()
    return (tag, attrs) if words else None


class Specs:
    """Node specs ready for matching: by a search in the attribute's value (skip_nodes),
    or, with ``equal``, by the whole value or one of its words (containers)."""

    def __init__(self, specs, equal: bool = False):
        self.equal = equal
        parsed = [(parse_index if equal else parse_spec)(s) for s in (specs if specs is not None else [])]
        # without an attribute a skip_nodes spec names nothing; a container spec names every such element
        self.specs = [(no, p[0], [(_attr_rx(a), v if equal else re.compile(v)) for a, v in p[1]])
                      for no, p in enumerate(parsed) if p and (p[1] or equal and p[0] != "*")]

    def first(self, tok: str, tag: str) -> int | None:
        """Number of the first spec that the tag token matches."""
        for no, name, attrs in self.specs:
            if name in (tag, "*") and all(self._value(tok, rx, want) for rx, want in attrs):
                return no
        return None

    def _value(self, tok: str, rx: re.Pattern, want) -> bool:
        m = rx.search(tok)
        if not m:
            return False
        v = next(g for g in m.groups() if g is not None)
        return v == want or want in v.split() if self.equal else want.search(v) is not None


# ------------------------------------------------------------------ operators on one page
class Page:
    """One page, parsed once: its tokens, the extents of its elements, and which tokens are still there.

    Edit steps act on the same elements whatever earlier steps took away:
    removing an element changes no other element's extent.
    """

    def __init__(self, page: str):
        self.toks = tokens(page)
        self.names, self.kind = kinds(self.toks)
        self.live = [True] * len(self.toks)
        self.tail = ""
        self._extents: tuple[list[int], list[int]] | None = None

    def extents(self) -> tuple[list[int], list[int]]:
        if self._extents is None:
            self._extents = extents(self.names, self.kind)
        return self._extents

    def named(self, specs: Specs, of=("open", "void")):
        """(token number, spec number) of the elements still there that a spec names, in page order."""
        for i, k in enumerate(self.kind):
            if self.live[i] and k in of and (no := specs.first(self.toks[i], self.names[i])) is not None:
                yield i, no

    def delete(self, specs: Specs) -> None:
        """H3: the elements that a spec names go, with their subtrees."""
        until = -1
        for i, _ in list(self.named(specs)):
            if i > until:
                until = self.extents()[0][i]
                self.live[i:until + 1] = [False] * (until + 1 - i)

    def keep(self, specs: Specs) -> None:
        """Only the first element of the first spec that names any stays; all stays when none does."""
        first = min(((no, i) for i, no in self.named(specs, ("open",))), default=None)
        if first is not None:
            start, stop = first[1], self.extents()[0][first[1]]
            self.live = [x and start <= i <= stop for i, x in enumerate(self.live)]

    def one_body(self) -> None:
        """H7: only the first start and the first end tag of html and of body stay."""
        met = set()
        for i, (tag, k) in enumerate(zip(self.names, self.kind)):
            if self.live[i] and tag in ("html", "body") and k in ("open", "close"):
                self.live[i] = (tag, k) not in met
                met.add((tag, k))

    def repair(self) -> None:
        """The first h1 goes, ' ...' follows the last text (' [...]' when there is none), open elements are closed."""
        end, still = self.extents()
        h1 = next((i for i, k in enumerate(self.kind) if self.live[i] and k == "open" and self.names[i] == "h1"), None)
        if h1 is not None:
            self.live[h1:end[h1] + 1] = [False] * (end[h1] + 1 - h1)
        last = next((i for i in range(len(self.toks) - 1, -1, -1) if self.live[i] and self.kind[i] == "text"), None)
        if last is not None:
            self.toks[last] += " ..."
        self.tail += "".join(f"</{self.names[i]}>" for i in reversed(still) if self.live[i])
        self.tail += "" if last is not None else " [...]"

    def text(self) -> str:
        return "".join(t for t, there in zip(self.toks, self.live) if there) + self.tail


#: Edit steps by name: the method, and whether its specs are containers (None: it takes none).
EDITS = {"delete": (Page.delete, False), "keep": (Page.keep, True), "one_body": (Page.one_body, None),
         "repair": (Page.repair, None)}


def edited(page: str | None, steps: list[tuple[str, Specs | None]]) -> str | None:
    """The page after the edit steps, in order; it is parsed once, and not at all when no step has anything to do."""
    steps = [(name, specs) for name, specs in steps if specs is None or specs.specs]
    if page is None or not steps:
        return page
    work = Page(page)
    for name, specs in steps:
        EDITS[name][0](work, *([] if specs is None else [specs]))
    return work.text()


def without(page: str | None, specs: Specs) -> str | None:
    """H3 alone: the page without the elements that a spec names, and their subtrees."""
    return edited(page, [("delete", specs)])


def container(page: str | None, specs: Specs) -> str | None:
    """H17 alone: the first element of the first spec that names any on the page; else the page."""
    return edited(page, [("keep", specs)])


def one_body(page: str | None) -> str | None:
    """H7 alone."""
    return edited(page, [("one_body", None)])


_HREF = _attr_rx("href")


def links_in(page: str | None, specs: Specs) -> list[dict]:
    """S3: (pos, href, text) of every a[href] inside an element that a spec names; a text belongs to its innermost link."""
    if page is None or not specs.specs:
        return []
    toks = tokens(page)
    names, kind = kinds(toks)
    end, _ = extents(names, kind)
    out, texts, owners, until = [], [], [], -1
    for i, (t, tag, k) in enumerate(zip(toks, names, kind)):
        if k == "open" and end[i] > until and specs.first(t, tag) is not None:
            until = end[i]
        while owners and end[owners[-1][0]] < i:
            owners.pop()
        if i > until:
            continue
        if k == "open" and tag == "a":
            owners.append((i, len(texts)))
            m = _HREF.search(t)
            out.append((i, next(g for g in m.groups() if g is not None)) if m else None)
            texts.append([])
        elif k == "text" and owners:
            texts[owners[-1][1]].append(t)
    return [{"pos": link[0], "href": link[1], "text": "".join(text).strip(" ")}
            for link, text in zip(out, texts) if link]


def repaired(page: str | None) -> str | None:
    """H18 alone."""
    return edited(page, [("repair", None)])
