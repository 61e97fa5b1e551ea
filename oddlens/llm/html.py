"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. Menus, page headers, footers, sidebars, scripts and styles are left out
by tag or role. A class or id makes its element a suspect: a sure one if a whole name, or every word of it, is an
unwanted word (`sidebar`, `cookie-notice`), a likely one if a word of it is (`search-result`) or if the name tells of a
tool that may also hold the text (`search`, `share`), none after words that turn it (`has-sidebar`, `ad-free`). Sure suspects
and forms go, but where no article lies outside them, those that hold the article stay. Likely ones go unless they hold
an article or half of the page's text, or are one paragraph that is good by itself.

Pass 1 decides blocks by themselves: many links make a block bad; a long block with many stop words is good; a notice about
cookies at the edge of a page is bad. Short blocks, and long ones with few stop words, stay open. In pass 2 an open block
takes the label of the nearest decided block; good wins at equal distance. Where the page marks its article (article, main,
role=main, articleBody), only blocks inside are looked at, and the h1 right before it if it has none. Inside it links make no block bad but
the items of lists that are all links, which give their label to no neighbour. On pages without a good block, open blocks
are good: so texts in languages without known stop words, or of a few short sentences, stay.

Null, empty and markup-only pages have an empty text. Cut-off pages give what they have. Nothing is capped, and pages of
any length are read whole, in time that grows with their length. Repeated pages are extracted one by one; pages with a
null id are extracted as others. Only the key, url and html are read, so other columns cannot clash. An empty table
gives no rows.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from oddlens.llm.common import freed_rows

MIN_LONG = 70
MAX_LINK_SHARE = 0.5
MIN_STOP_SHARE = 0.1

#: Frequent function words of English, French, German, Spanish, Italian and Portuguese (fixed values).
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his in is it its not of on or she that the their there they this to was we were which who will with you
    au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui ma mais me mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous
    aber als am an auch auf aus bei bin bis bist da das dass dem den der des die doch du ein eine einem einen einer er es für hat hatte ich ihr im ist ja kann mich mir mit nach nicht noch nun nur oder sehr sich sie sind so um und uns von vor war was wenn wie wir zu zum zur über
    al como con cuando del desde donde el ella ellos entre era es esta este esto fue ha hay las lo los más me mi muy no nos o otro para pero por porque que quien se ser si sin sobre son su sus también te tiene todo una uno y ya
    che chi ci con cui da dal della delle di e ed gli ho i il io le lo ma nel non o per più quella questo se si sono sua un uno
    ao as com como da das do dos e ela ele em eu foi isso mais mas na no nas nos não o os ou para pela pelo por que se sem ser seu sua também um uma""".split()
)
#: Tags whose content is never text (raw), or never the article.
RAW = "script|style|template|textarea|title|iframe|noembed|noframes|xmp|svg|math|object|canvas|audio|video"
OUT = frozenset("nav footer aside button select menu dialog noscript head fieldset datalist".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class or id that mark what is not the article (fixed values).
OUT_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split())
#: Those of them that name a tool, which may hold the text as well (fixed values).
TOOL_WORDS = frozenset("login pager pagination related search share sharing signup skip social subscribe toolbar topbar widget widgets".split())
#: A notice about cookies speaks of them and of one of these (fixed values).
NOTICE_WORDS = frozenset("accept accepting agree agreeing consent policy privacy".split())
#: Words of a name that turn what the unwanted word beside them says (fixed values).
TURNED = frozenset("free has hide hides no non not with without".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*[^>]*>|\Z)|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/a-z][^>]*(?:>|\Z)", re.I | re.S)
_ATTR = re.compile(r"""([a-z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6".split())
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(raw)}


def _left_out(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    if name in OUT or name == "header" and not in_article:
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in OUT_ROLES:
        return True
    return bool(re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I))


def _suspect(name: str, attrs: dict[str, str], in_article: bool) -> str:
    """`sure`, `likely`, `paragraph` (a likely one that is one paragraph) or nothing."""
    if name in ("html", "body", "main"):
        return ""
    found = "sure" if name == "form" else ""
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in _CAMEL.findall(token)]
        bad = [w in OUT_WORDS or w == "header" and not in_article for w in words]
        if bad and all(bad) and not TOOL_WORDS.issuperset(words):
            return "sure"
        if any(bad) and name != "article" and TURNED.isdisjoint(words):
            found = found or ("paragraph" if name in _PARAGRAPH else "likely")
    return found


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    marked: bool  # in the marked article
    title: bool  # an h1
    listed: int  # the innermost list around it, 0 outside lists
    around: tuple[int, ...]  # suspects

    def links(self) -> bool:
        return self.linked > MAX_LINK_SHARE * len(self.text)

    def speaks(self) -> bool:
        """Long, with many stop words."""
        if len(self.text) < MIN_LONG:
            return False
        w = _WORD.findall(self.text.lower())
        return sum(map(STOP_WORDS.__contains__, w)) >= MIN_STOP_SHARE * max(1, len(w))

    def notice(self) -> bool:
        w = set(_WORD.findall(self.text.lower()))
        return len(self.text) < 6 * MIN_LONG and not w.isdisjoint(("cookie", "cookies")) and not w.isdisjoint(NOTICE_WORDS)


class _Blocks:
    """Walks over a page and cuts it into blocks."""

    def __init__(self, page: str) -> None:
        self.out: list[Block] = []
        self.lists: list[int] = []
        self.n_lists, self.title = 0, False
        self.kind: list[str] = []  # of each suspect
        self.holds: list[bool] = []  # whether an article begins in it
        self.text: list[str] = []
        self.linked, self.in_link, self.skip, self.depth = 0, False, "", 0
        self.article: list[list] = []  # [tag, open tags of that name inside]
        self.around: list[list] = []  # [tag, open tags of that name inside, suspect]
        at = 0
        for m in _TAG.finditer(page):
            self.add(page[at : m.start()])
            at = m.end()
            if m["name"]:
                self.tag(m["name"].lower(), bool(m["end"]), m["attrs"])
        self.add(page[at:])
        self.end_block()

    def add(self, piece: str) -> None:
        if piece and not self.skip:
            self.text.append(piece)
            self.linked += self.in_link and len(piece.strip())

    def end_block(self) -> None:
        if self.text and (t := " ".join(html.unescape("".join(self.text)).split())):
            listed = self.lists[-1] if self.lists else 0
            self.out.append(Block(t, self.linked, bool(self.article), self.title, listed, tuple(x[2] for x in self.around)))
        self.text.clear()
        self.linked = 0

    @staticmethod
    def close(stack: list[list], name: str) -> None:
        if stack and name == stack[-1][0]:
            stack[-1][1] -= 1
            if not stack[-1][1]:
                stack.pop()

    def tag(self, name: str, end: bool, raw: str | None) -> None:
        if self.skip:
            if name == self.skip:
                self.depth += -1 if end else name not in VOID
            elif end and name in ("body", "html") or self.skip in ("p", "li") and name in BLOCK:
                self.depth = 0
            if self.depth:
                return
            self.skip = ""
            if end:
                return
        if name in BLOCK:
            self.end_block()
            self.title = name == "h1" and not end
        if name in ("ul", "ol") and end:
            del self.lists[-1:]
        if name == "br":
            self.add(" ")
        elif end:
            if name == "a":
                self.in_link = False
            else:
                if self.around and name == self.around[-1][0]:
                    self.end_block()
                self.close(self.around, name)
                self.close(self.article, name)
        elif name not in VOID:
            attrs = _attributes(raw) if raw else {}
            if _left_out(name, attrs, bool(self.article)):
                self.end_block()
                self.skip, self.depth, self.in_link = name, 1, False
                return
            for stack in (self.around, self.article):
                if stack and name == stack[-1][0]:
                    stack[-1][1] += 1
            if kind := _suspect(name, attrs, bool(self.article)):
                self.end_block()
                self.around.append([name, 1, len(self.kind)])
                self.kind.append(kind)
                self.holds.append(False)
            if name in ("ul", "ol"):
                self.n_lists += 1
                self.lists.append(self.n_lists)
            if name == "a":
                self.in_link = True
            elif name in ("article", "main") or attrs.get("role", "").lower() == "main" or "articlebody" in attrs.get("itemprop", "").lower():
                if not self.article:
                    for x in self.around:
                        self.holds[x[2]] = True
                    self.article.append([name, 1])
                elif name != self.article[-1][0]:
                    self.article.append([name, 1])


def blocks(page: str) -> list[Block]:
    """The blocks that are not left out; left-out parts end a block."""
    p = _Blocks(page)
    sure = {k for k, kind in enumerate(p.kind) if kind == "sure"}
    if any(b.marked for b in p.out) and not any(b.marked and sure.isdisjoint(b.around) for b in p.out):
        sure -= {k for k in sure if p.holds[k]}
    rest = [b for b in p.out if sure.isdisjoint(b.around)]
    size = sum(len(b.text) for b in rest)
    within = dict.fromkeys(range(len(p.kind)), 0)
    stays = {k for k, holds in enumerate(p.holds) if holds}
    for b in rest:
        for k in b.around:
            within[k] += len(b.text)
            if p.kind[k] == "paragraph" and b.speaks() and not b.links():
                stays.add(k)
    gone = {k for k, n in within.items() if k not in sure and p.kind[k] in ("likely", "paragraph") and k not in stays and 2 * n < size}
    return [b for b in rest if gone.isdisjoint(b.around)]


def of_article(found: list[Block]) -> list[Block]:
    """The blocks of the marked article without lists of links, and the title right before it."""
    words = {b.listed for b in found if b.marked and not (b.links() and len(b.text) < MIN_LONG)}
    inside = [b for b in found if b.marked and (not b.listed or b.listed in words)]
    first = next(i for i, b in enumerate(found) if b.marked)
    for b in reversed(found[:first]):
        if b.title and not b.links() and not any(x.title for x in inside):
            return [b, *inside]
        if b.title or len(b.text) >= MIN_LONG:
            break
    return inside


def main_text(page: str) -> str:
    found = blocks(page)
    marked = any(b.marked for b in found)
    found = of_article(found) if marked else found
    titles = [i for i, b in enumerate(found) if b.title and not b.links()]
    head = titles[0] if len(titles) == 1 else 0
    label: list[bool | None] = []
    for i, b in enumerate(found):
        edge = i < max(head, 2) or i >= len(found) - 2
        if not marked and (b.links() or edge and len(found) > 2 and b.notice()):
            label.append(False)
        else:
            label.append(True if b.speaks() else None)
    # pass 2: the nearest decided block on each side
    n, some = len(found), True in label
    near: list[list[tuple[int, bool] | None]] = [[None, None] for _ in range(n)]
    for side, order in ((0, range(n)), (1, range(n - 1, -1, -1))):
        last = None
        for i in order:
            near[i][side] = last and (abs(i - last[0]), last[1])
            if label[i] is not None:
                last = (i, label[i])
    keep = []
    for i, b in enumerate(found):
        sides = [x for x in near[i] if x]
        good = label[i] if label[i] is not None else not some or min(sides, key=lambda x: (x[0], not x[1]))[1]
        if good:
            keep.append(b.text)
    return "\n".join(keep)


def extracted(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """pages (key, url, html): rows (key, url, text, n_chars)."""
    kind = pages.schema[key].dataType.simpleString()

    def extract(batches):
        for b in batches:
            text = [main_text(h) if isinstance(h, str) else "" for h in b["html"]]
            yield pd.DataFrame({key: b[key].astype("Int64") if kind == "bigint" else b[key], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select(key, "url", "html").mapInPandas(freed_rows(extract), f"{key} {kind}, url string, text string, n_chars bigint")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
