"""Main text of web pages by consensus of the pages of a host.

Pass one scores the containers of every page: a text block gives its characters outside links to its
container, half to the next one out, and so on. Lists and tables are no containers here. From the best one
the page climbs to the enclosing article or main, and on to every container around it that adds text of few
links outside other articles; the body only where it holds such text itself, a heading or a tenth as much.
The path of the container it arrives at, tags with their first class and without digits, is the page's vote
with all characters below it. Spark adds up the votes of a host, with partial sums before the
shuffle, so a host with a third of all pages sends a row for each path and task. Winning paths are the one with the most characters and all that have
two pages and a twentieth of the host's votes, so 21 at most. Pass two extracts the blocks below the
winning path that holds most of the page; where none holds a quarter of what the page's own best container
holds, or the page has none, that container is taken.

A host also votes on what the climb added. A block that stands the same outside the best container (the article or
main around it) on pages with three different articles and on a twentieth of the host's pages is one of its notices,
side columns or footers, whatever its class: such blocks go where they lie outside the page's own best container,
and inside it where it holds nothing else.

Blocks below menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments never count, by tag, role, class or id. A class or id alone does not drop what lies around main or
around the page's largest article, nor the elements of one name that together hold most of the page's text
outside links: these stay with a quarter of their score, and reader comments, adverts and notices among
them only where nothing around them is taken. Character references are decoded once; white space in a
block becomes one space; empty blocks go; blocks are joined in page order by one space. Names of classes and ids
are parted at hyphens, underscores, digits and capitals. Work grows linearly with tags, whatever their nesting.

Null and empty pages have an empty text. Pages without a host vote for themselves alone. Rows that
repeat are extracted each. Pages of any length are read whole; broken markup is read as far as it goes.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import cut, map_texts, string_field

OTHER_TOKENS = r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z<>][^<>]*>|<!\w[^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)"
#: Quotes count after an equals sign and may hold anything; one that never closes is read up to the next tag's end.
#: Where no end of the tag follows, LOOSE, which never looks past the next tag, reads the stretch once more: both are linear.
TOKEN = re.compile(OTHER_TOKENS + r"""((?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s<>"'][^\s<>]*+)?+)*+)(>?)""", re.DOTALL)
LOOSE = re.compile(OTHER_TOKENS + r"""((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+|[^<>]*)(>)""", re.DOTALL)
#: Characters from which a path is written as a hash, from which it grows on.
LONGEST_PATH = 2_000
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Drawings and formulas, whose titles are no raw text, and which end where an element of pages begins.
FOREIGN = {"svg", "math"}
#: Elements whose text is not the article's.
DROPPED = {
    "head", "nav", "footer", "aside", "form", "noscript", "template", "button", "select", "datalist", "dialog", "menu",
    "svg", "math", "canvas", "object", "audio", "video", "map",
} | RAW
CONTAINERS = {"html", "body", "main", "article", "section", "div", "center", "table", "tbody", "tr", "td", "ul", "ol", "dl", "details", "fieldset", "header"}
#: What a list or a table holds belongs to the container around it.
VOTING = CONTAINERS - {"table", "tbody", "tr", "td", "ul", "ol", "dl"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = CONTAINERS | DROPPED | {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "th", "thead", "tfoot", "caption",
    "address", "figure", "figcaption", "hgroup", "summary", "legend", "hr", "br",
}
#: Elements of pages that end a drawing or formula.
BREAKOUT = BLOCKS - DROPPED - {"summary", "legend", "details"} | {"nav", "menu"}
#: Elements that an opening tag of the key closes, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "menu", "menubar", "form"}
#: Parts of class names and ids that mark what is not the article.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie",
    "cookies", "consent", "notice", "notices", "alert", "gdpr", "menu", "nav", "navbar", "navigation", "sidebar", "breadcrumb",
    "breadcrumbs", "footer", "masthead", "comment", "comments", "disqus", "replies", "respond", "share", "sharing", "social",
    "related", "recommended", "newsletter", "subscribe", "signup", "login", "popup", "modal", "widget", "toolbar", "pagination",
    "pager", "search",
}
#: Marks of text that is never part of an article around it.
OTHERS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie",
    "cookies", "consent", "notice", "notices", "alert", "gdpr", "comment", "comments", "disqus", "replies", "respond",
}
#: Capitals inside names, and marks that begin or end a part written as one word with others.
CAPITAL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
AFFIX = re.compile(r"^(advert|adsby|adslot|comment(?!ar)|cookie|newsletter|sponsor)|(footer|sidebar|navbar|banner|comments|cookies|breadcrumbs|menu)$")
AFFIX_MARKS = {"adsby": "ads", "adslot": "ads"}
#: Score of marked text that holds most of a page, and share of a page's text that its main article has at least.
PENALTY, LEAST_ARTICLE = 0.25, 0.25
WHOLE = {"header", "site-header", "page-header", "top", "bottom", "side", "aside", "hidden", "form"}
SAFE = {"html", "body", "main", "article"}
#: Pages, and share of a host's pages, that a path needs to win beside the first; share of a page's own best container that a winner holds at least.
LEAST_PAGES, LEAST_VOTES, LEAST_HELD = 2, 0.05, 0.25
#: Different articles, and share of a host's pages, with the same block around them that make it a part of the host.
SAME_AROUND, SAME_SHARE = 3, 0.05
WINNERS_BYTES = 8_000_000


def mark_of(names: str) -> str:
    """The first class name or id that marks what is not the article; empty if there is none."""
    for name in CAPITAL.sub("-", names).lower().split():
        parts = parts_of(name)
        if name in WHOLE or not MARKS.isdisjoint(parts):
            return name
    return ""


def parts_of(name: str) -> list[str]:
    """Parts of a name, up to a word that says what it comes with."""
    parts = re.split(r"[-_]+|(?<=\D)(?=\d)", name)
    parts = parts[: next((i for i, p in enumerate(parts) if p in ("with", "has", "no", "without")), len(parts))]
    return [p if p in MARKS or not (m := AFFIX.search(p)) else AFFIX_MARKS.get(m[0], m[0]) for p in parts]


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Page:
    """Elements and text blocks of a page; an element is (tag, path, parent, dropped, mark) and knows the next block and voting container."""

    def __init__(self, source: str):
        self.tags, self.paths, self.parents, self.dropped, self.marks = [""], [""], [-1], [False], [""]
        self.owners, self.voters = [0], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.parse(source)
        self.weights, self.others = [1.0] * len(self.tags), [False] * len(self.tags)
        if any(self.marks):
            self.judge()

    def parse(self, source: str) -> None:
        stack = [0]
        opened: Counter[str] = Counter()
        parts: list[tuple[str, bool]] = []
        links = at = loose = 0

        def text(raw: str) -> None:
            if raw and not self.dropped[stack[-1]]:
                parts.append((raw, links > 0))

        def flush() -> None:
            if parts:
                clean = " ".join(references.unescape("".join(t for t, _ in parts)).split())
                if clean:
                    self.blocks.append((self.owners[stack[-1]], clean, sum(len(t) for t, link in parts if link)))
                parts.clear()

        def close(tags: set[str], bound: set[str]) -> None:
            if not any(opened[t] for t in tags):
                return
            for i in range(len(stack) - 1, 0, -1):
                tag = self.tags[stack[i]]
                if tag in tags:
                    if any(self.tags[e] in BLOCKS for e in stack[i:]):
                        flush()
                    opened.subtract(self.tags[e] for e in stack[i:])
                    del stack[i:]
                    return
                if tag in bound:
                    return

        while True:
            m = LOOSE.search(source, at, loose) if at < loose else TOKEN.search(source, at)
            if not m and at < loose:
                text(source[at:loose])
                at = loose
                continue
            if not m:
                break
            if m[2] and not m[4]:
                text(source[at : m.start()])
                at, loose = m.start(), m.end()
                continue
            text(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    links = max(0, links - 1)
                if tag in BLOCKS:
                    flush()
                close({tag}, set() if tag in SAFE else SAFE - {tag})
                continue
            if tag in BREAKOUT and (opened["svg"] or opened["math"]) and not opened["foreignobject"]:
                close(FOREIGN, SAFE)
            if tag in BLOCKS:
                flush()
                links = 0
                if tag not in VOID:
                    close({"p"}, CONTAINERS | {"blockquote", "li", "figure"})
            if tag in CLOSES:
                close(CLOSES[tag], CONTAINERS - CLOSES[tag])
            if tag in VOID:
                continue
            if tag == "a":
                links += 1
            names = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3].strip(" /") else {}
            parent = stack[-1]
            stack.append(len(self.tags))
            self.owners.append(len(self.tags) if tag in BLOCKS else self.owners[parent])
            self.voters.append(len(self.tags) if tag in VOTING else self.voters[parent])
            self.tags.append(tag)
            self.parents.append(parent)
            first = re.sub(r"\d+", "", (names.get("class", "").lower().split() or [""])[0])
            path = f"{self.paths[parent]}>{tag}.{first}" if tag in VOTING else self.paths[parent]
            self.paths.append(path if len(path) < LONGEST_PATH else f"#{digest(path)}")
            self.dropped.append(self.dropped[parent] or self.drops(tag, names, bool(opened["article"] or opened["main"])))
            opened[tag] += 1
            self.marks.append("" if tag in ("html", "body", "main") else mark_of(f"{names.get('class', '')} {names.get('id', '')}"))
            if tag in RAW and (tag in ("script", "style") or not (opened["svg"] or opened["math"])):
                end = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(source, at)
                at = end.start() if end else len(source)
        text(source[at:])
        flush()

    def drops(self, tag: str, names: dict[str, str], inside: bool) -> bool:
        if tag in DROPPED:
            return True
        if tag == "header":
            return not inside
        if tag in ("html", "body", "main"):
            return False
        hidden = "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "").lower()
        return hidden or names.get("role", "").lower() in ROLES

    def judge(self) -> None:
        """Weight of each element's text by the marks around it; blocks of weight 0 go."""
        n = len(self.tags)
        below = [0] * n
        for owner, text, linked in self.blocks:
            below[owner] += max(0, len(text) - 2 * linked)
        for e in range(n - 1, 0, -1):
            below[self.parents[e]] += below[e]
        foreign = [False] * n
        for e in range(1, n):
            foreign[e] = foreign[self.parents[e]] or not OTHERS.isdisjoint(parts_of(self.marks[e]))
        articles = [e for e in range(n) if self.tags[e] == "article" and not foreign[e] and below[e] >= max(1, LEAST_ARTICLE * below[0])]
        kept = [False] * n
        for e in [e for e in range(n) if self.tags[e] == "main" and below[e]] + sorted(articles, key=lambda e: (-below[e], e))[:1]:
            while e > 0 and not kept[e]:
                kept[e] = True
                e = self.parents[e]
        sums: dict[str, int] = {}
        around, names = [0], Counter()  # elements around the one at hand, and their marks
        for e in range(1, n):
            while around[-1] != self.parents[e]:
                names[self.marks[around.pop()]] -= 1
            mark = self.marks[e]
            if mark and not names[mark]:
                sums[mark] = sums.get(mark, 0) + below[e]
            names[mark] += 1
            around.append(e)
        for e in range(1, n):
            self.weights[e], self.others[e] = self.weights[self.parents[e]], self.others[self.parents[e]]
            if self.marks[e] and not kept[e]:
                most = 2 * sums[self.marks[e]] > below[0]
                self.weights[e] = min(self.weights[e], PENALTY if most else 0.0)
                self.others[e] = self.others[e] or not OTHERS.isdisjoint(parts_of(self.marks[e]))
        self.blocks = [b for b in self.blocks if self.weights[b[0]]]

    def best(self) -> tuple[str, float]:
        """Path of the best container after the climb, and the characters outside links below it."""
        scores: dict[int, float] = {}
        for owner, text, linked in self.blocks:
            e, share = self.voters[owner], max(0, len(text) - 2 * linked) * self.weights[owner]
            while share >= 0.5:
                scores[e] = scores.get(e, 0.0) + share * (1.25 if self.tags[e] in ("article", "main") else 1.0)
                if e == 0:
                    break
                share /= 2
                e = self.voters[self.parents[e]]
        self.core, self.chosen = 0, ""
        if not scores:
            return "", 0.0
        self.chosen = self.paths[self.climb(max(scores, key=lambda e: (scores[e], -e)))]
        return self.chosen, self.held(self.chosen)

    def climb(self, e: int) -> int:
        """The outermost container around an element that adds to the article."""
        n = len(self.tags)
        below, direct, heading = [0] * n, [0] * n, [False] * n
        for owner, text, linked in self.blocks:
            if 2 * linked < len(text) and self.others[e] >= self.others[owner]:
                below[owner] += len(text)
                at = self.voters[owner]
                direct[at] += len(text)
                heading[at] = heading[at] or self.tags[owner] in HEADINGS
        outside = below[:]  # without the text of other articles
        for i in range(n - 1, 0, -1):
            below[self.parents[i]] += below[i]
            if self.tags[i] != "article":
                outside[self.parents[i]] += outside[i]
        around = []
        at = self.voters[e]
        while at:
            around.append(at)
            at = self.voters[self.parents[at]]
        around.append(0)
        article = next((i for i, at in enumerate(around) if self.tags[at] in ("article", "main")), 0)
        chosen = last = self.core = around[article]
        for at in around[article + 1 :]:
            if self.tags[at] in ("", "html", "body"):
                adds = heading[at] or direct[at] > 0 and 10 * direct[at] >= below[chosen]
            else:
                adds = outside[at] > (0 if self.tags[last] == "article" else outside[last])
            if adds:
                chosen = at
            last = at
        return chosen

    def added(self) -> tuple[int, list[int]]:
        """After ``best``: digest of the text of the container before it climbed, and of the blocks around it that the climb took in."""
        blocks = self.taken(self.chosen)
        inside = self.below(self.core)
        around = {digest(b[1]) for b in blocks or [] if not inside[b[0]]} if self.core else set()
        return (digest(" ".join(b[1] for b in blocks if inside[b[0]])) if around else 0), sorted(around)

    def below(self, e: int) -> list[bool]:
        """For each element whether it is the given one or lies in it."""
        out = [False] * len(self.tags)
        for i in range(e, len(self.tags)):
            out[i] = i == e or i > 0 and out[self.parents[i]]
        return out

    def held(self, path: str) -> float:
        """Characters outside links below the elements of a path, by their weight."""
        return sum((max(0, len(t) - 2 * linked) * self.weights[e] for e, t, linked in self.taken(path) or []), 0.0)

    def taken(self, path: str) -> list[tuple[int, str, int]] | None:
        """Blocks below the elements of a path; those of others only if there is nothing else."""
        top = [-1] * len(self.tags)
        for e in range(len(self.tags)):
            top[e] = top[self.parents[e]] if e else -1
            if top[e] < 0 and self.paths[e] == path and (e == 0 or self.tags[e] in VOTING):
                top[e] = e
        if max(top) < 0:
            return None
        inside = [b for b in self.blocks if top[b[0]] >= 0]
        return [b for b in inside if self.others[top[b[0]]] >= self.others[b[0]]] or inside

    def extract(self, path: str, same: frozenset[int] = frozenset()) -> str | None:
        """Blocks below the elements of a path, in page order; None if the page has no such element.

        After ``best``, blocks of the digests ``same`` count only inside the page's own best container, and there only with others.
        """
        blocks = self.taken(path)
        if blocks and same and self.core:
            inside = self.below(self.core)
            kept = [digest(b[1]) not in same for b in blocks]
            own = any(k for k, b in zip(kept, blocks, strict=True) if inside[b[0]])
            blocks = [b for k, b in zip(kept, blocks, strict=True) if k or own and inside[b[0]]]
        return None if blocks is None else " ".join(t for _, t, _ in blocks)


def main_text(source: str, winners: list[str] | str | None, same: list[int] | None = None) -> tuple[str, str]:
    """(text, path used): by the winning path that holds most of the page, or by the page's own best container."""
    page = Page(source)
    same = frozenset(same or ())
    own, score = page.best()
    held = sorted((-page.held(w), i, w) for i, w in enumerate([winners] if isinstance(winners, str) else winners or []))
    for chars, _, w in held:
        if -chars >= LEAST_HELD * score and (found := page.extract(w, same)):
            return found, w
    return page.extract(own, same) or "", own


def host_of(url: str):
    found = F.lower(F.regexp_extract(F.col(f"`{url}`").cast("string"), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def winning_paths(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """What a host has agreed on: (``_fl_host``, ``_fl_paths``, ``_fl_same``).

    Paths are the one with the largest sum of scores, ties to the first, and all with enough votes. ``_fl_same`` holds
    the digests of the blocks that stand around enough different articles: at most 20 times what climbs add to a page.
    """
    vote = T.StructType([T.StructField("path", T.StringType()), T.StructField("score", T.LongType()), T.StructField("block", T.LongType()), T.StructField("core", T.LongType())])

    def votes_of(source: str) -> list[dict]:
        page = Page(source)
        path, score = page.best()
        if score <= 0:
            return []
        core, blocks = page.added()
        return [{"path": path, "score": int(score)}, *[{"block": b, "core": core} for b in blocks]]

    def make() -> Callable[[list[str]], list[list]]:
        return lambda sources: [[votes_of(s) for s in sources]]

    named = pages.select(F.col(f"`{html}`").alias("_fl_html"), host_of(url).alias("_fl_host")).where("_fl_host is not null")
    votes = map_texts(named, "_fl_html", ["_fl_host"], [T.StructField("_fl_votes", T.ArrayType(vote))], make)
    votes = votes.select("_fl_host", F.explode("_fl_votes").alias("_fl_vote"))
    key = [F.col(f"_fl_vote.{c}").alias(f"_fl_{c}") for c in ("path", "block", "core")]
    # Whole numbers add up to the same sum in any order.
    sums = votes.groupBy("_fl_host", *key).agg(F.sum("_fl_vote.score").alias("_fl_score"), F.count("*").alias("_fl_pages"))
    sums = cut(sums)  # pages are read once for all uses
    paths = sums.where("_fl_path is not null")
    best = F.min(F.struct((-F.col("_fl_score")).alias("s"), F.col("_fl_path").alias("p")))
    hosts = paths.groupBy("_fl_host").agg(best.alias("_fl_best"), F.sum("_fl_pages").alias("_fl_all"))
    enough = (F.col("_fl_pages") >= F.greatest(F.lit(LEAST_PAGES), LEAST_VOTES * F.col("_fl_all"))) | (F.col("_fl_path") == F.col("_fl_best.p"))
    won = paths.join(hosts, "_fl_host").where(enough).groupBy("_fl_host").agg(F.sort_array(F.collect_list("_fl_path")).alias("_fl_paths"))
    around = sums.where("_fl_path is null").groupBy("_fl_host", "_fl_block").agg(F.count("*").alias("_fl_articles"), F.sum("_fl_pages").alias("_fl_pages"))
    around = around.where(F.col("_fl_articles") >= SAME_AROUND).join(hosts, "_fl_host").where(F.col("_fl_pages") >= SAME_SHARE * F.col("_fl_all"))
    same = around.groupBy("_fl_host").agg(F.sort_array(F.collect_list("_fl_block")).alias("_fl_same"))
    return won.join(same, "_fl_host", "left")


def extract_pages(pages: DataFrame, html: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """``keep``, ``text``, ``n_chars`` and ``path`` of every page."""
    kept = keep or ["page_id", "url"]
    winners = cut(winning_paths(pages, html, url))
    size = winners.agg(F.sum(F.octet_length("_fl_host") + F.octet_length(F.array_join("_fl_paths", "")) + 8 * F.coalesce(F.size("_fl_same"), F.lit(0)))).first()[0] or 0
    # Up to a checked size the winners go to every task; beyond it pages and winners meet by host.
    side = F.broadcast(winners) if size <= WINNERS_BYTES else winners
    named = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").alias("_fl_html"), host_of(url).alias("_fl_host"))
    met = named.join(side, "_fl_host", "left")

    def make() -> Callable[..., list[list]]:
        return lambda sources, paths, same: [list(c) for c in zip(*map(main_text, sources, paths, same), strict=True)]

    out = map_texts(met, "_fl_html", kept, [string_field("text"), string_field("path")], make, ["_fl_paths", "_fl_same"])
    return out.select(*[f"`{c}`" for c in kept], "text", F.length("text").cast("long").alias("n_chars"), "path")
