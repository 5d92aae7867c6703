"""Turning texts with HTML, Markdown, wiki or LaTeX residue into clean text that keeps its structure.

HTML goes through the standard library's streaming parser; its events are written out as lines of text with the number of
tags each line had. Of pages with markup on most lines, the text-to-tag ratio of the lines is smoothed with a Gaussian and
split into two clusters, and lines of the low cluster that are links, page furniture or loose labels are dropped. Markdown,
wiki and LaTeX go through a scanner of their own, which cuts out code and formulas, takes the lines one by one and reads each
from left to right, token by token, with a stack of open braces; it gives events like the parser's, in time that grows with
the length of the text. Kept structure, in one notation: ``# `` headings, ``- `` items, ``a | b`` table rows,
fenced code and ``$`` formulas.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Element names that make "<name" a tag; names with a colon or hyphen count as well.
NAMES = frozenset(
    """a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite
    code col colgroup data dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame
    frameset gallery h1 h2 h3 h4 h5 h6 head header hr html i iframe img includeonly input ins kbd label legend li link main map
    mark math menu meta meter mfrac mi mn mo mover mrow msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder nav noinclude
    nobr noscript nowiki object ol optgroup option output p param picture poem pre progress q ref references rp rt ruby s samp
    script section select small source span strike strong style sub summary sup svg syntaxhighlight table tbody td template
    textarea tfoot th thead time title tr track tt u ul var video wbr""".split()
)
TAG = re.compile(r"<(?:/?([A-Za-z][A-Za-z0-9:-]*)(?:\s[^<>]*)?/?>|!--|!\[?[A-Za-z]|\?xml)")
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
FENCE = re.compile(r"^[ \t]*(?:```+|~~~+)", re.M)
COMMAND = re.compile(r"(?<![\\\w:])\\(?![nrtdwsDWSbBfv0](?![A-Za-z{\[]))[A-Za-z]+\*?|\\[A-Za-z]+\*?(?=[{\[])")
INLINE = r"\$(?=\S)(?=[^$\n]*[\\^_={}+])[^$\n]*(?<=\S)\$(?!\d)"  # a price has a space before, or figures behind its sign
FORMULA = re.compile(rf"\$\$|{INLINE}|\$[A-Za-z]\$|\\[()\[\]]")

#: (what it is, a string it needs, pattern) of a piece of Markdown, wiki or LaTeX syntax.
PIECES = [
    ("heading", "#", re.compile(r"^ {0,3}#{1,6}[ \t]+\S", re.M)),
    ("setext", "\n", re.compile(r"(?<=\S)[ \t]*\n(?:={3,}|-{3,})[ \t]*$", re.M)),
    ("rule", "", re.compile(r"^(?:\*{3,}|-{3,}|_{3,}|(?:\* ){2,}\*|(?:- ){2,}-)[ \t]*$", re.M)),
    ("fence", "", FENCE),
    ("code", "`", re.compile(r"`")),
    ("strong", "**", re.compile(r"(?<![\w)\]*])\*\*|\*\*(?![\w(*])|(?<=[A-Za-z])\*\*(?=[A-Za-z])")),
    ("emphasis", "*", re.compile(r"(?<![\w*\\])\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?![\w*])")),
    ("emphasis", "_", re.compile(r"(?<![\w.\\-])_(?=[^\s_])[^_\n]+(?<=\S)_(?![\w_])")),
    ("strong", "__", re.compile(r"(?<![A-Za-z0-9_])__(?=\S)|(?<=\S)__(?![A-Za-z0-9_])")),
    ("strike", "~~", re.compile(r"~~")),
    ("link", "](", re.compile(r"\]\(")),
    ("image", "![", re.compile(r"!\[")),
    ("reference", "][", re.compile(r"\]\[")),
    ("reference", "[", re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]*\S|\[\^\w", re.M)),
    ("autolink", "<", re.compile(r"<(?:https?|ftp|mailto):[^>\s]*>")),
    ("item", "", re.compile(r"^[ \t]*[-*+][ \t]+\S", re.M)),
    ("quote", ">", re.compile(r"^ {0,3}>[ \t]+\S", re.M)),
    ("table", "|", re.compile(r"^[ \t]*\|(?=.*\|)|^[ \t]*\|[ \t]*[\w-]+[ \t]*=|^\|[-}+]|\|[ \t]*:?-{3,}", re.M)),
    ("escape", "\\", re.compile(r"\\[*_#`|~>!{}$%&]")),
    ("link", "[[", re.compile(r"\[\[|\]\]")),
    ("link", "]]", re.compile(r"\]\]")),
    ("template", "{{", re.compile(r"\{\{")),
    ("template", "}}", re.compile(r"\}\}(?!\})")),
    ("emphasis", "''", re.compile(r"(?<![A-Za-z0-9])''|''(?![A-Za-z0-9])")),
    ("quotes", "``", re.compile(r"``")),
    ("heading", "=", re.compile(r"^={1,6}[^=\n]+={1,6}[ \t]*$", re.M)),
    ("table", "{|", re.compile(r"\{\|")),
    ("magic", "__", re.compile(r"__[A-Z]{3,}__")),
    ("item", "", re.compile(r"^[*#:;]+[ \t]*\w", re.M)),
    ("link", "[", re.compile(r"\[(?:https?:)?//[^\]\s]+[^\]]*\]")),
    ("command", "\\", COMMAND),
    ("formula", "$", FORMULA),
    ("formula", "\\", re.compile(r"\\[()\[\]]")),
    ("break", "\\\\", re.compile(r"(?<![\w:\\])\\\\(?!\w)")),
    ("comment", "%", re.compile(r"^%", re.M)),
]


NUMBERS = re.compile(r"[-\d.,;\s\[\]eE+]+")
STARRED = re.compile(r"(?<=[(,])(\s*)\*\*(?=\w+\s*[,)])|(?<=\d)\*\*(?=\d)")  # keyword arguments and powers


def matrices(text: str) -> list[tuple[int, int]]:
    """Where lists of lists of figures stand, which are no links."""
    out = []
    for m in NUMBERS.finditer(text) if "[[" in text else ():
        a, b = m[0].find("[["), m[0].rfind("]]")
        if 0 <= a < b and "," in m[0][a:b]:
            out.append((m.start() + a, m.start() + b + 2))
    return out


def pieces(text: str) -> list[str]:
    """The kinds of syntax found in the text, HTML apart."""
    for a, b in reversed(matrices(text)):
        text = f"{text[:a]} {text[b:]}"
    text = STARRED.sub(" ", text) if "**" in text else text
    return [kind for kind, need, p in PIECES if need in text and p.search(text)]


class _Reader(HTMLParser):
    """Writes the parser's events as lines; counts tags, and the tags and link characters of every line."""

    BLOCK = frozenset("menu address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form header hr html main nav ol p section summary table tbody tfoot thead tr ul".split())
    LIST, ASIDE = frozenset(("ul", "ol")), frozenset(("nav", "footer", "aside", "menu"))
    DROP = frozenset("ref references script style noscript template head iframe object svg select textarea".split())

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.lines, self.tags, self.kept, self.links = [""], [0], [False], [0]
        self.events = 0
        self.hidden, self.pre, self.anchor, self.cells, self.lists, self.aside = [], 0, 0, -1, 0, 0
        self.furniture = [False]

    def _new(self) -> None:
        for x, v in ((self.lines, ""), (self.tags, 0), (self.kept, False), (self.links, 0), (self.furniture, self.aside > 0)):
            x.append(v)

    def _line(self, keep: bool = False, gap: bool = False) -> None:
        """Goes on in an empty line; with a gap, behind an empty one."""
        if self.lines[-1].strip():
            self._new()
        if gap and len(self.lines) > 1 and self.lines[-2].strip():
            self._new()
        if keep:
            self.kept[-1] = True

    def _put(self, s: str) -> None:
        if self.anchor:
            self.links[-1] += len(s.strip())
        first, *rest = s.split("\n")
        self.lines[-1] += first
        for x in rest:
            for y, v in ((self.lines, x), (self.tags, 0), (self.kept, bool(self.pre)), (self.links, 0), (self.furniture, self.aside > 0)):
                y.append(v)

    def handle_starttag(self, tag, attrs):
        self.events += 1
        self.tags[-1] += 1
        if tag in self.DROP:
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._line(True, True)
            self._put("#" * int(tag[1]) + " ")
        elif tag == "li":
            self._line(True)
            self._put("  " * (self.lists - 1) + "- ")
        elif tag in ("pre", "syntaxhighlight"):
            self._line(True, True)
            self._put("```\n")
            self.pre += 1
        elif tag in ("td", "th"):
            self.cells += 1
            if self.cells > 0:
                self._put(" | ")
            self.kept[-1] = True
        elif tag == "tr":
            self._line(True)
            self.cells = -1
        elif tag == "br":
            self._line() if not self.pre else self._put("\n")
        elif tag == "math":
            self._put("$")
            self.kept[-1] = True
        elif tag == "img":
            self._put(next((v or "" for k, v in attrs if k == "alt"), ""))
        elif tag == "a":
            self.anchor += 1
        elif tag in self.BLOCK:
            self.aside += tag in self.ASIDE
            self._line(gap=tag not in ("tr", "tbody", "thead", "tfoot", "dd", "dt") and not (tag in self.LIST and self.lists))
            self.lists += tag in self.LIST
            self.furniture[-1] |= self.aside > 0

    def handle_endtag(self, tag):
        self.events += 1
        self.tags[-1] += 1
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if tag in ("pre", "syntaxhighlight"):
            if self.pre:
                self._put("\n```")
                self.pre -= 1
            self._line(gap=True)
        elif tag == "math":
            self._put("$")
        elif tag == "a":
            self.anchor = max(0, self.anchor - 1)
        elif tag in self.LIST:
            self.lists = max(0, self.lists - 1)
            self._line(gap=not self.lists)
        elif tag in self.BLOCK or tag in ("li", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.aside = max(0, self.aside - (tag in self.ASIDE))
            self._line(gap=tag not in ("li", "tr", "tbody", "thead", "tfoot", "dd", "dt"))
            self.furniture[-1] = self.aside > 0

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in self.DROP and self.hidden:
            self.hidden.pop()

    def handle_data(self, data):
        if not self.hidden:
            self._put(data)

    def handle_entityref(self, name):
        self._reference(f"&{name};")

    def handle_charref(self, name):
        self._reference(f"&#{name};")

    def _reference(self, s):
        self.events += 1
        self.handle_data(html.unescape(s))

    def handle_comment(self, data):
        self.events += 1
        self.tags[-1] += 1

    handle_decl = handle_pi = unknown_decl = handle_comment


STOPS = (".", "!", "?", ":", ";", "。", "！", "？", "…", ")", '"', "”")
GAUSS = np.exp(-0.5 * np.arange(-2, 3) ** 2)
GAUSS = GAUSS / GAUSS.sum()


def content_lines(chars: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Whether each line belongs to a content region: the smoothed text-to-tag ratios in two clusters."""
    ratio = np.convolve(np.pad(chars / np.maximum(tags, 1), 2, mode="edge"), GAUSS, mode="valid")
    low, high = ratio.min(), ratio.max()
    for _ in range(12):
        cut = (low + high) / 2
        a, b = ratio[ratio < cut], ratio[ratio >= cut]
        if not len(a) or not len(b):
            return np.ones(len(ratio), bool)
        if (a.mean(), b.mean()) == (low, high):
            break
        low, high = a.mean(), b.mean()
    return ratio >= (low + high) / 2 if high > 2 * low else np.ones(len(ratio), bool)


def from_html(text: str) -> tuple[str, int]:
    """(text of the HTML, number of events that were markup)."""
    guarded = re.sub("<", lambda m: "<" if _is_tag(text, m.start()) else "\ue000", text)
    guarded = re.sub("&", lambda m: "&" if ENTITY.match(text, m.start()) else "\ue001", guarded) if len(guarded) == len(text) else guarded
    r = _Reader()
    r.feed(guarded)
    r.close()
    chars = np.array([len(x.strip()) for x in r.lines])
    tags, links = np.array(r.tags), np.array(r.links)
    keep = np.ones(len(r.lines), bool)
    if r.events:
        loose = np.array([not x.strip().endswith(STOPS) and len(x.strip()) < 60 for x in r.lines]) & (tags >= 4)
        own = chars - 2 * np.array([x.lstrip().startswith("- ") for x in r.lines])
        dropped = (links >= 0.6 * own) & (links > 0) | ~np.array(r.kept) & (np.array(r.furniture) | loose)
        some = chars > 0
        keep[some] = content_lines(chars[some], tags[some]) | ~dropped[some] if some.any() else True
    out = "\n".join(x for x, k in zip(r.lines, keep) if k)
    out = re.sub(r"(?m)^```\n\n", "```\n", re.sub(r"(?m)\n\n```$", "\n```", out)) if r.events and "```" in out else out
    return out.replace("\ue000", "<").replace("\ue001", "&"), r.events


def _is_tag(text: str, at: int) -> bool:
    m = TAG.match(text, at)
    return bool(m) and (m[1] is None or m[1].lower() in NAMES or ":" in m[1] or "-" in m[1])


# LaTeX commands of mathematics, which stay, of what leaves with its argument, and of headings.
MATH = frozenset(
    """frac dfrac tfrac sqrt sum prod int oint lim infty alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa
    lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega cdot cdots ldots times div
    pm leq geq le ge neq approx equiv propto partial nabla forall exists in notin subset cup cap log ln exp sin cos tan max min
    left right mathbf mathrm mathcal mathbb hat bar vec tilde overline binom to mapsto rightarrow leftarrow""".split()
)
GONE = frozenset("cite citep citet ref eqref pageref footnotemark label vspace hspace pagestyle bibliography bibliographystyle usepackage documentclass includegraphics input include".split())
HEADS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 1, "subparagraph": 2}
FORMULAS = ("equation", "align", "gather", "displaymath")
OPEN = re.compile(rf"^[ \t]*(?P<fence>```+|~~~+)[^\n]*$|(?P<block>\$\$)|(?P<inline>{INLINE})|\\(?P<bracket>[\[(])|\\begin\{{(?P<env>verbatim|lstlisting|tabular|array|(?:{'|'.join(FORMULAS)})\*?)\}}", re.M)
TOKEN = re.compile(
    r"""(?P<esc>\\[*_#\[\]`|~>!{}$%&])|(?P<code>`[^`\n]+`)|!\[(?P<alt>[^\[\]\n]*)\]\([^()\n]*\)|\[\[(?P<wiki>[^\[\]\n]*)\]\]|\[(?P<link>[^\[\]\n]*)\](?:\([^()\n]*\)|\[[^\[\]\n]*\])
    |\[(?:https?:)?//[^\[\]\s]+[ \t]*(?P<ext>[^\[\]\n]*)\]|(?P<note>\[\^\w+\])|\{\{(?P<tpl>[^{}\n]*)\}\}|\\href\{[^{}\n]*\}(?P<href>\{)|(?P<env>\\(?:begin|end)\{[^{}\n]*\}(?:\{[^{}\n]*\})?)
    |(?P<gone>~?\\(?P<gname>[A-Za-z]+)\*?(?:\[[^\[\]\n]*\])?\{[^{}\n]*\})|\\(?P<cmd>[A-Za-z]+)\*?(?P<opt>\[[^\[\]\n]*\])?(?P<arg>\{)?|(?P<nl>(?<![\w:\\])\\\\(?!\w)[ \t]*)|(?P<open>\{)|(?P<close>\})
    |(?<![\w*\\])\*(?=[^\s*])(?P<em>[^*\n]*)(?<=[^\s*])\*(?![\w*])|(?<![\w.\\-])_(?=[^\s_])(?P<em2>[^_\n]+)(?<=\S)_(?![\w_])
    |(?P<mark>\*\*\*|(?<![\w)\]*])\*\*|\*\*(?![\w(*])|(?<=[A-Za-z])\*\*(?=[A-Za-z])|'{2,5}+(?![A-Za-z0-9])|(?<![A-Za-z0-9'])'{2,5}+|~~|(?<![A-Za-z0-9_])__(?=\S)|(?<=\S)__(?![A-Za-z0-9_])|``|\[\[|\]\])|(?P<tie>(?<=\S)~(?=\S))""",
    re.X,
)


class _Scanner:
    """Unwraps Markdown, wiki and LaTeX in one pass. Closing marks are looked for with `find`; one that is missing once is
    not looked for again, so that the time grows with the length of the text."""

    def __init__(self, text: str):
        self.text, self.missing = text, {}

    def _close(self, mark: str, at: int) -> int:
        if self.missing.get(mark, len(self.text) + 1) <= at:
            return -1
        k = self.text.find(mark, at)
        if k < 0:
            self.missing[mark] = at
        return k

    def run(self) -> str:
        out, at, text = [], 0, self.text
        while m := OPEN.search(text, at):
            stretch = text[at : m.start()]
            end, got = self._protected(m)
            if end < 0:  # it closes nowhere: read it as prose
                out.append(self._prose(stretch + m[0][:1] if m["fence"] is None else stretch + m[0]))
                at = m.start() + 1 if m["fence"] is None else m.end()
                continue
            out += [self._prose(stretch), got]
            at = end
        return "".join([*out, self._prose(text[at:])])

    def _protected(self, m: re.Match) -> tuple[int, str]:
        """(end, text) of the code or formula that begins here."""
        text, b = self.text, m.end()
        if m["fence"]:
            mark = m["fence"][:3]
            close = re.compile(rf"^[ \t]*{mark[0]}{{3,}}[ \t]*$", re.M).search(text, b)
            body = text[b : close.start() if close else len(text)]
            return (close.end() if close else len(text)), m[0].replace("~~~", "```") + body + ("```" if close else "")
        if m["block"]:
            k = self._close("$$", b)
            return (k + 2, text[m.start() : k + 2]) if k >= 0 else (-1, "")
        if m["inline"]:
            return b, m[0]
        if m["bracket"]:
            k = self._close("\\]" if m["bracket"] == "[" else "\\)", b)
            body = text[b:k].strip()
            return (-1, "") if k < 0 else (k + 2, f"\n$$ {body} $$\n" if m["bracket"] == "[" else f"${body}$")
        env = m["env"]
        k = self._close(f"\\end{{{env}}}", b)
        if k < 0:
            return -1, ""
        body, end = text[b:k], k + len(env) + 6
        if env in ("verbatim", "lstlisting"):
            return end, "```\n" + body.strip("\n") + "\n```"
        if env in ("tabular", "array"):
            body = re.sub(r"^(?:\[[^\]\n]*\])?\{[^}\n]*\}|\\hline|\\(?:top|mid|bottom)rule", "", body)
            return end, self._prose(re.sub(r"[ \t]*(?<!\\)&[ \t]*", " | ", body).strip())
        return end, "\n$$\n" + body.strip() + "\n$$\n"

    def _prose(self, s: str) -> str:
        if not s:
            return s
        lines, out, i, template = s.split("\n"), [], 0, False
        while i < len(lines):
            x, after = lines[i], lines[i + 1] if i + 1 < len(lines) else ""
            i += 1
            t = x.strip()
            if x[:1] == "%" or re.fullmatch(r"(?:\*{3,}|-{3,}|_{3,})[ \t]*|__[A-Z]{3,}__", x) or re.match(r" {0,3}\[[^\]\n]+\]:[ \t]*\S|\{\||\|[-}+]", x):
                continue
            if t and re.fullmatch(r"(?:={3,}|-{3,})[ \t]*", after) and i < len(lines):
                out.append(("# " if after[0] == "=" else "## ") + self._inline(t))
                i += 1
                continue
            if template and x.startswith("}}"):
                template, x = False, x[2:]
                if not x.strip():
                    continue
            if x.startswith("{{") and "}" not in x:
                template = True
                continue
            if template:
                out.append(self._inline(re.sub(r"^\|\s*", "", x)))
                continue
            if t[:1] == "=" and t[-1:] == "=" and (t.strip("=")).strip() and "=" not in t.strip("="):
                n = min(6, len(t) - len(t.lstrip("=")))
                out.append("#" * n + " " + self._inline(t.strip("=").strip()))
                continue
            if re.match(r" {0,3}#{1,6}[ \t]", x):
                y = x.rstrip()
                z = y.rstrip("#")
                out.append(self._inline(z.rstrip() if z != y and z[-1:] in " \t" and z.strip(" \t#") else y))
                continue
            if x[:1] in "|!" and x[:1] or t[:1] == "|" and t.count("|") > 1:
                if re.fullmatch(r"[ |:]*-{3,}[-| :]*", x):
                    continue
                row = re.split(r"\|\||!!|\|", t[1:-1] if t[-1:] == "|" and len(t) > 1 else t[1:])
                out.append(" | ".join(self._inline(c.strip()) for c in row) if x[:1] != "!" or x[1:2] in " \t!" or "!!" in x or x[1:2].isalnum() and "![" not in x[:2] else self._inline(x))
                continue
            if re.fullmatch(r"[ |:]*-{3,}[-| :]*", x) and x.strip():
                continue
            m = re.match(r"([ \t]*)(?:\+|\\item|([*:;][*#:;]*))[ \t]+", x)
            if m:
                depth = "  " * (len(m[2]) - 1) if m[2] else ""
                out.append(f"{m[1]}{depth}- {self._inline(x[m.end() :])}")
                continue
            out.append(self._inline(re.sub(r"^ {0,3}>[ \t]?", "", x)))
        return "\n".join(out)

    def _inline(self, s: str) -> str:
        out, at, braces = [], 0, []  # what a closing brace gives
        if spans := matrices(s):
            edges = [0, *(x for span in spans for x in span), len(s)]
            return "".join(self._inline(s[a:b]) if k % 2 == 0 else s[a:b] for k, (a, b) in enumerate(zip(edges, edges[1:])))
        while m := TOKEN.search(s, at):
            out.append(s[at : m.start()])
            at, kind, name = m.end(), m.lastgroup, m["cmd"]
            if m["esc"]:
                out.append(m[0][1])
            elif m["code"]:
                out.append(m[0][1:-1])
            elif m["wiki"] is not None:
                media = re.match(r"(?:File|Image|Category):", m["wiki"])
                out.append("" if media and "|" not in m["wiki"] else self._inline(m["wiki"].rpartition("|")[2]))
            elif m["tpl"] is not None:
                out.append(m["tpl"].rpartition("|")[2] if "|" in m["tpl"] else "")
            elif m["gone"] and m["gname"] in GONE:
                pass
            elif m["gone"]:  # another command with one argument: read on inside it
                at = m.start() + m[0].index("{")
                name, opened = m["gname"], True
                out.append(self._command(name, m[0][: m[0].index("{") + 1].lstrip("~"), True, braces))
                at += 1
            elif m["href"]:
                braces.append("")
            elif name:
                if not m["arg"] and re.fullmatch("[nrtdwsDWSbBfv0]", name):
                    out.append(m[0])
                else:
                    got = self._command(name, m[0], bool(m["arg"]), braces)
                    out.append(got)
                    if not m["arg"] and not got:
                        at += len(s[at:]) - len(s[at:].lstrip(" \t")) if len(s) - at < 200 else len(re.match(r"[ \t]*", s[at : at + 200])[0])
            elif kind == "open":
                out.append("{")
                braces.append("}")
            elif kind == "close":
                out.append(braces.pop() if braces else "}")
            elif kind == "mark":
                out.append(m[0] if STARRED.match(s, m.start()) or m[0] == "**" and re.search(r"[(,]\s*$", s[max(0, m.start() - 3) : m.start()]) and re.match(r"\w+\s*[,)]", s[at : at + 80]) else "")
            elif kind == "tie":
                out.append(" ")
            else:
                for g in ("alt", "link", "ext", "em", "em2"):
                    if m[g] is not None:
                        out.append(self._inline(m[g]))
        return "".join([*out, s[at:]])

    @staticmethod
    def _command(name: str, whole: str, arg: bool, braces: list[str]) -> str:
        if name in MATH:
            if arg:
                braces.append("}")
            return whole
        if arg:
            braces.append({"footnote": ")"}.get(name, "\n" if name in HEADS else ""))
        return " (" if name == "footnote" and arg else "\n" + "#" * HEADS[name] + " " if name in HEADS and arg else ""


def clean_markup(text: str | None) -> tuple[str | None, int]:
    """(clean text, pieces of markup found). Text without markup, the empty and the null one come back as they are.

    References that were escaped twice are resolved as often as they were escaped.
    """
    if not text:
        return text, 0
    n = 0
    for _ in range(3):
        if not ("<" in text and any(_is_tag(text, m.start()) for m in re.finditer("<", text)) or "&" in text and ENTITY.search(text)):
            break
        text, events = from_html(text)
        n += events
    kinds = pieces(text)
    if kinds:
        n += len(kinds)
        text = _Scanner(text).run()
    if n:
        text = "\n".join(x.rstrip(" \t") for x in text.split("\n"))
        text = re.sub(r"\n{3,}", "\n\n", text).strip("\n")
    return text, n


# What a text must hold to hold any syntax, for a filter before texts leave the JVM.
SOME = r"(?m)[<&#*`|\\{}$>]|~~|\]\(|\]\[|\[\[|\]\]|\[\^|\[(https?:)?//|''|__|(?<![\w.\\-])_|\S~\S|^[ \t]*[-+:;=%_\[]"


def may_have_markup(text: Column) -> Column:
    """False only for texts in which `strip_markup` finds no pieces."""
    return F.coalesce(text.rlike(SOME), F.lit(False))


def _clean(batches):
    for b in batches:
        got = [clean_markup(t) for t in b["text"].to_pylist()]
        yield pa.record_batch({"node_no": b["node_no"], "clean": pa.array([t for t, _ in got], pa.string()), "pieces": pa.array([n for _, n in got], pa.int32())})


def strip_markup(df: DataFrame) -> DataFrame:
    """(node_no, clean, pieces) for every row of (node_no, text); pieces is 0 for texts without markup and for null."""
    return df.select("node_no", "text").mapInArrow(_clean, "node_no long, clean string, pieces int")
