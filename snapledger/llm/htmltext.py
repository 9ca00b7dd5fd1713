"""Main text of HTML pages by composite text density.

The page is read into a light tree (a list of nodes in page order with parents; implied
ends of paragraphs, list items and cells are supplied, broken markup is tolerated). For
each node of the body: C characters and T tags below it, LC and LT of them in links. Its
composite density is

    C/T * log(C/LC * T/LT) / log(ln(C/(C-LC) * LC + LCb/Cb * C + e)),

b being the body and zero divisors 1: characters per tag, the less the more of them are
links. A node's density sum adds its children's. The node of the largest sum is the main
text; the least density on the way from it up to the body is the threshold, and a
neighbour beside that way that reaches it brings its own largest-sum subtree. Inline
elements count as tags of the block they stand in, but are not nodes to be chosen.

Left out before densities are taken: scripts, styles and other raw elements, hidden
ones, and page parts that their element, role, class or id names as navigation, header,
footer, sidebar, advert, notice, form or comments. A part with more than half of the
page's text that holds its main heading or an article is the page, whatever its name. A
name that only mentions such a part (``page-with-footer-nav``) leaves it out if the part
is mostly links or has at most a quarter of the page's text. If all that leaves no text,
only raw elements are left out.

White space in a block becomes one space, character references are decoded, blocks are
joined by \\n. Null or empty html gives an empty text. Of nodes of equal sums the first is
taken. Nothing is cut off: the work is linear in the page. Rows are independent, equal or
not; null ids and urls stay; empty tables give empty results.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import map_batches, table

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
#: One attribute from where the last one ended: its name, and its value in any quotes.
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|[^\s/>]""")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg math textarea title xmp canvas audio video head".split())
_LITERAL = frozenset("script style textarea title xmp iframe noscript".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_CELL = frozenset(("td", "th", "br", "option"))
_NAMED = frozenset("nav header footer aside form menu dialog button select input label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
#: Words in class or id that name what is not the article.
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus respond replies cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager toolbar search".split()
)
#: Words beside them that name the article all the same.
_MAIN = frozenset("article content main body post entry story text".split())
#: Words before them that say what something has or lacks, and after them that say so too.
_ABOUT = frozenset("has have with no not non without hide hides hidden show shows is are enable enabled disable disabled".split())
_STATE = frozenset("free enabled disabled hidden visible open opened closed active inactive off on wrap wrapper wrapped container layout template page root theme".split())
#: Words beside them that do not change what is named.
_PLACE = frozenset("site page global top bottom left right upper lower primary secondary inner outer list area section block box bar panel item items links link thread form container wrap wrapper reader user blog the of a".split())
_HEADS = frozenset("h1 article main".split())
_CLOSED_BY = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_SCOPE = frozenset("ul ol dl table body html".split())


def _named(token: str) -> int:
    """What a class or id says of its element: 2 that it is a part to leave out, 1 that it has to do with one, 0 neither."""
    pieces = [p.lower() for p in _PIECE.findall(token)]
    if not _WORDS.intersection(pieces) or _MAIN.intersection(pieces) or pieces[0] in _ABOUT or pieces[-1] in _STATE - _PLACE:
        return 0
    return 2 if all(p in _WORDS or p in _PLACE or p.isdigit() for p in pieces) and pieces[-1] not in _STATE else 1


def _doubt(tag: str, attributes: str) -> int:
    """3: hidden; 2: an element named as a part to leave out; 1: one with such a word in its name; 0: neither."""
    found = 2 if tag in _NAMED else 0
    if tag in ("body", "html", "article", "main") or not attributes.strip():
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return 3
        if name == "role" and value.lower() in _ROLES:
            found = 2
        elif name in ("class", "id"):
            found = max([found, *map(_named, value.split())])
    return found


class _Tree:
    """Nodes in page order; ``stream`` has texts and breaks (None) with their node."""

    def __init__(self, page: str, prune: bool):
        self.tag, self.parent, self.dropped, self.last, self.doubt = ["html"], [0], [False], [0], [0]
        self.stream: list[tuple[int, str | None]] = []
        self.at = [0]
        # where: the depths at which each tag, and at "" any block, is open
        stack, where, pos, end = [0], {"html": [0], "": [0]}, 0, len(page)

        def close(depth: int) -> None:
            while len(stack) > depth:
                k = stack.pop()
                where[self.tag[k]].pop()
                self.last[k] = len(self.tag) - 1
                if self.tag[k] in _BLOCK:
                    where[""].pop()
                    self.stream.append((k, None))

        def depth_of(tag: str) -> int:
            depths = where.get(tag)
            return depths[-1] if depths else -1

        def up_to(tag: str, scope: frozenset) -> None:
            d = depth_of(tag)
            if d > 0 and all(depth_of(t) < d for t in scope if t != tag):
                close(d)

        while pos < end:
            m = _TOKEN.search(page, pos)
            text = page[pos : m.start()] if m else page[pos:]
            if text:
                self.stream.append((stack[-1], entities.unescape(text) if "&" in text else text))
            if not m:
                break
            pos = m.end()
            slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if tag is None:
                continue
            tag = tag.lower()
            if slash:
                d = depth_of(tag)
                if d > 0 and (tag in _BLOCK or depth_of("") < d):
                    close(d)
                continue
            if tag in ("html", "body") and where.get(tag):
                continue
            if tag == "body":
                up_to("head", frozenset())
            if tag in _BLOCK:
                up_to("p", _SCOPE)
            for t in _CLOSED_BY.get(tag, "").split():
                up_to(t, _SCOPE - {"body", "html"})
            k, above = len(self.tag), stack[-1]
            self.tag.append(tag)
            self.parent.append(above)
            self.last.append(k)
            doubt = _doubt(tag, attributes) if prune else 0
            self.doubt.append(doubt)
            self.dropped.append(self.dropped[above] or tag in _RAW or doubt == 3)
            self.at.append(len(self.stream))
            if tag in _BLOCK:
                self.stream.append((k, None))
            elif tag in _CELL:
                self.stream.append((k, " "))
            if tag in _LITERAL:
                stop = re.compile(f"</{tag}", re.I).search(page, pos)
                pos = stop.start() if stop else end
                if stop:
                    pos = page.find(">", pos) + 1 or end
                continue
            if tag not in _VOID and not attributes.endswith("/"):
                where.setdefault(tag, []).append(len(stack))
                if tag in _BLOCK:
                    where[""].append(len(stack))
                stack.append(k)
        close(0)
        if prune:
            self._leave_out()

    def _leave_out(self) -> None:
        """Drop the parts that their names give away, with what is below them."""
        n = len(self.tag)
        chars, links, heads, in_link = [0] * n, [0] * n, [0] * n, [False] * n
        for k in range(1, n):
            in_link[k] = self.tag[k] == "a" or in_link[self.parent[k]]
        for k, text in self.stream:
            if text and not self.dropped[k]:
                size = len(text.strip())
                chars[k] += size
                links[k] += size if in_link[k] else 0
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            chars[p] += chars[k]
            links[p] += links[k]
            heads[p] += heads[k] + (self.tag[k] in _HEADS and not self.dropped[k])
        for k in range(1, n):
            doubt, most = self.doubt[k], 2 * chars[k] > chars[0]
            sure = doubt == 2 and not (most and heads[k])
            self.dropped[k] = self.dropped[k] or self.dropped[self.parent[k]] or sure or (doubt == 1 and not most and (4 * chars[k] <= chars[0] or 2 * links[k] > chars[k]))

    def content(self) -> list[int]:
        """The nodes whose subtrees are the main text, in page order."""
        n = len(self.tag)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link, above = [False] * n, [0] * n
        for k in range(1, n):
            p = self.parent[k]
            above[k] = p if self.tag[p] in _BLOCK or not p else above[p]
            in_link[k] = self.tag[k] == "a" or in_link[self.parent[k]]
        for k, text in self.stream:
            if text and not self.dropped[k]:
                size = len(text.strip())
                chars[k] += size
                links[k] += size if in_link[k] else 0
        for k in range(n - 1, 0, -1):
            if not self.dropped[k]:
                p = self.parent[k]
                chars[p] += chars[k]
                links[p] += links[k]
                tags[p] += tags[k] + 1
                link_tags[p] += link_tags[k] + (self.tag[k] == "a")
        body = next((k for k in range(n) if self.tag[k] == "body"), 0)
        density, total = [0.0] * n, [0.0] * n
        share = links[body] / max(1, chars[body])
        for k in range(n - 1, -1, -1):
            if chars[k] and not self.dropped[k]:
                c, t, lc, lt = chars[k], max(1, tags[k]), links[k], max(1, link_tags[k])
                base = math.log(math.log(c / max(1, c - lc) * lc + share * c + math.e) + 1e-9) if lc or share else 0.0
                ratio = math.log(max(1.0, c / max(1, lc) * t / lt))
                density[k] = c / t * ratio / max(base, 0.05) if lc or share else c / t * ratio
                if k and self.tag[k] in _BLOCK:
                    total[above[k]] += density[k]
        if not chars[body]:
            return []
        best = max(range(body, self.last[body] + 1), key=lambda k: (total[k] or density[k] * 1e-9, -k))
        if not total[best]:
            return [body]
        path = [best]
        while path[-1] != body:
            path.append(self.parent[path[-1]])
        least = min(density[k] for k in path)
        on_path, found = set(path), [best]
        for k in range(body + 1, self.last[body] + 1):
            if self.parent[k] in on_path and self.parent[k] != best and k not in on_path and self.parent[k] < k and not (best < k <= self.last[best]) and density[k] >= least and total[k]:
                found.append(max(range(k, self.last[k] + 1), key=lambda x: (total[x], -x)))
        return sorted(found)

    def text(self) -> str:
        blocks, now = [], []

        def flush() -> None:
            joined = " ".join("".join(now).split())
            if joined:
                blocks.append(joined)
            now.clear()

        for node in self.content():
            for i in range(self.at[node], len(self.stream)):
                k, text = self.stream[i]
                if k > self.last[node] or k < node:
                    break
                if text is None:
                    flush()
                elif not self.dropped[k]:
                    now.append(text)
            flush()
        return "\n".join(blocks)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return _Tree(page, True).text() or _Tree(page, False).text()


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with the main text of ``html`` in main_text; all other columns are kept, one of that name is replaced."""
    pages = pages.drop("main_text")
    schema = pages.withColumn("main_text", F.lit("")).schema
    names = pages.columns

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "main_text"])

    return map_batches(pages, run, schema)


def op9(spark, sf_dir):
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
