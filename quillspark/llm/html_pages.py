"""Main text of web pages by consensus host paths.

Each page scores its containers: a block of text counts for the container around
it and half for the one around that, link text counting nothing. The best is lifted
to the container that holds its headline and its siblings too, and the page votes
for the tag-class path (digits generalised) of what it lifted. Spark adds the votes
by host; the host's strong paths then say where each of its pages keeps its text,
and every page is extracted again by them: by the first that holds enough, and by
others beside it that hold as much. A page of which they hold only a small
share of what it could give (a rarer template with a teaser, say) uses its own best.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments are left out: by tag, and by names in class, id and role. A name says so as
a whole or by its head word (`site-footer`, `ad-slot`), not where another word makes
it an article's part (`post-header`, `with-sidebar`). Names that articles have too
(`notice`, `search`, `share`) only make a container doubtful; it stays where it
holds most of the page's text, with few links.

Defined results: null html has empty text; a null or odd url belongs to the host
""; repeated rows vote each; an empty table gives an empty table; extra columns do
not matter; ties between paths go to the first by code point. A tag, comment, script
or attribute value that never ends takes the rest of the page with it, as HTML says.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from quillspark.llm.common import cut

#: Hosts up to which their paths (some hundred bytes each) are broadcast; above, the join shuffles.
BROADCAST_HOSTS = 20_000
#: Least share of a host's votes that makes a path one of its own.
LEAST_VOTES = 0.05
#: Least share, of what the page alone would give, that a host's path must hold to be believed.
LEAST_HELD = 0.2
#: Least share, of what has been chosen so far, that makes siblings part of the text.
LEAST_PART = 0.1
#: The same for a second path of the host's.
LEAST_JOINED = 0.5
#: Steps of a path that are spelled; of deeper ones these are the last, behind a digest of all.
SPELLED = 24
#: Characters of a class attribute that a path tells apart.
CLASS_CHARS = 200

BEFORE_QUOTE = re.compile(r"[^>=]*+")
VALUE = re.compile(r"=\s*+(?:([\"'])|[^\s>]*+)")
ATTRIBUTE = re.compile(r"""([^\s/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s]*+)))?""")

TELLING = frozenset("class id role style aria-hidden hidden".split())

# fixed values: HTML's elements by kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
CONTAINERS = frozenset("article body div main section td th blockquote center table tbody tr ul ol dl figure details header".split())
BLOCKS = CONTAINERS | frozenset(
    "address caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr html li p pre summary thead tfoot nav footer aside form fieldset".split()
)
DROPPED = frozenset(
    "head nav footer aside form script style noscript template iframe svg button select textarea dialog menu object canvas audio video math title".split()
)
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]),
}
ARTICLE = frozenset(["article", "main"])
# fixed values: names of what is no article. SURE: a name of which they are the first or the last word; DOUBTFUL: one made of them and of PLAIN words alone
SURE = frozenset(
    "ad adbox ads adsense adslot advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment commentform commentlist comments complementary "
    "consent contentinfo cookie cookies disqus footer gdpr masthead menu menus modal nav navbar navigation newsletter outbrain popup promo promos replies respond sidebar "
    "sidebars signup sponsor sponsored taboola toolbar topbar widget widgets".split()
)
DOUBTFUL = frozenset("alert announcement header notice notices related search share sharing social subscribe subscription teaser".split())
PLAIN = frozenset(
    "area bar block bottom box button buttons container content form global group icons inner item items left links list main page panel posts primary right row secondary "
    "section site text title top wrap wrapper".split()
)
DENIED = frozenset("has hide is no not with without".split())


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        if (name := m[1].lower()) in TELLING:
            out.setdefault(name, unescape(m[2] or m[3] or m[4] or "").lower())
    return out


def doubt(tag: str, has: dict[str, str], in_article: bool) -> int:
    """2: the element is left out; 1: unless it holds most of the page's text; 0: it stays."""
    if tag in DROPPED or "hidden" in has or has.get("aria-hidden") == "true" or "display:none" in has.get("style", "").replace(" ", ""):
        return 2
    if tag == "header" and not in_article:
        return 2
    found = 0
    if tag not in ("html", "body", "article", "main"):
        for name in " ".join(has.get(x, "") for x in ("class", "id", "role")).split():
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            if not words or not DENIED.isdisjoint(words):
                continue
            if words[0] in SURE or words[-1] in SURE:
                return 2
            if not DOUBTFUL.isdisjoint(words) and all(w in DOUBTFUL or w in PLAIN for w in words) and not (in_article and "header" in words):
                found = 1
    return found


class Page:
    """Containers (step, path, parent, doubt) and blocks (container, text, characters of link text, heading) in page order.

    Everything here takes time and memory in proportion to the page: paths are interned, and no element is looked for twice.
    """

    def __init__(self, html: str) -> None:
        self.tags: list[str] = ["page"]
        self.paths: list[int] = [0]
        self.parents: list[int] = [-1]
        self.doubts: list[bool] = [False]
        self.blocks: list[tuple[int, str, int, bool]] = []
        self._names: list[tuple[str, int, int, bytes]] = [("page", -1, 1, b"")]  # by path: step, parent, depth, digest
        self._known: dict[tuple[int, str], int] = {}
        self._open: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, container, left out
        self._counts: Counter[str] = Counter()
        self._open_blocks: list[int] = []  # places in _open
        self._text: list[str] = []
        self._links = 0
        self._read(html)
        self._settle()

    def _end_block(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                heading = any(self._counts[f"h{i}"] for i in (1, 2, 3))
                self.blocks.append((self._open[-1][1], text, self._links, heading))
            self._text, self._links = [], 0

    def _add(self, source: str) -> None:
        if source and not self._open[-1][2]:
            text = unescape(source) if "&" in source else source
            self._text.append(text)
            self._links += len(text) if self._counts["a"] else 0

    def _pop(self, to: int) -> None:
        for tag, _, _ in self._open[to:]:
            self._counts[tag] -= 1
        del self._open[to:]
        while self._open_blocks and self._open_blocks[-1] >= to:
            self._open_blocks.pop()

    def _path(self, parent: int, step: str) -> int:
        at = self._known.get((parent, step))
        if at is None:
            at = self._known[parent, step] = len(self._names)
            _, _, depth, digest = self._names[parent]
            self._names.append((step, parent, depth + 1, xxh3_128_digest(digest + b">" + step.encode())))
        return at

    def name(self, path: int) -> str:
        """A path as text of bounded length."""
        _, _, depth, digest = self._names[path]
        steps = []
        while path >= 0 and len(steps) < SPELLED:
            step, path, _, _ = self._names[path]
            steps.append(step)
        return ">".join(([digest.hex()] if depth > SPELLED else []) + steps[::-1])

    def _start(self, tag: str, source: str) -> None:
        if tag in BLOCKS:
            self._end_block()
        while len(self._open) > 1 and tag in CLOSED_BY.get(self._open[-1][0], ()):
            self._pop(len(self._open) - 1)
        if self._open_blocks and self._open[self._open_blocks[-1]][0] == "p" and tag in CLOSED_BY["p"]:  # a paragraph ends even inside open inline elements
            self._pop(self._open_blocks[-1])
        if tag == "br":
            self._text.append(" ") if self._text else None
        if tag in VOID:
            return
        _, container, out = self._open[-1]
        has = _attributes(source) if source.strip() and not out else {}
        level = 2 if out else doubt(tag, has, bool(self._counts["article"] or self._counts["main"]))
        level = 2 if level and tag not in BLOCKS else level
        if level < 2 and (tag in CONTAINERS or level):
            classes = sorted({re.sub(r"\d+", "#", x) for x in has.get("class", "")[:CLASS_CHARS].split()})
            self.tags.append(tag)
            self.paths.append(self._path(self.paths[container], ".".join([tag, *classes])))
            self.parents.append(container)
            self.doubts.append(level == 1)
            container = len(self.tags) - 1
        if tag in BLOCKS:
            self._open_blocks.append(len(self._open))
        self._open.append((tag, container, level == 2))
        self._counts[tag] += 1

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_block()
        if self._counts[tag]:
            k = len(self._open) - 1
            while self._open[k][0] != tag:
                k -= 1
            self._pop(k)

    def _read(self, html: str) -> None:
        at, closes = 0, {}
        while (to := html.find("<", at)) >= 0:
            after = html[to + 1 : to + 3]
            if after[:1].isalpha() or after[:1] == "/" and after[1:].isalpha():
                self._add(html[at:to])
                end = self._tag_end(html, to + 1)
                if end < 0:
                    at = len(html)
                    break
                at = end + 1
                source = html[to + 1 : end]
                name = re.match(r"/?([^\s/>]+)", source)
                tag = name[1].lower()
                if source[0] == "/":
                    self._end(tag)
                elif tag in RAW:
                    closes.setdefault(tag, re.compile(rf"</{re.escape(tag)}\b[^>]*+>?", re.I))
                    close = closes[tag].search(html, at)
                    at = close.end() if close else len(html)
                else:
                    self._start(tag, source[name.end() :])
            elif after[:1] in ("!", "?", "/") and after:
                self._add(html[at:to])
                comment = html.startswith("<!--", to)
                end = html.find("-->" if comment else ">", to + 4 if comment else to)
                at = len(html) if end < 0 else end + (3 if comment else 1)
            else:
                self._add(html[at : to + 1])
                at = to + 1
        self._add(html[at:])
        self._end_block()

    @staticmethod
    def _tag_end(html: str, at: int) -> int:
        """The place of the tag's ">", -1 if it has none; quotes hide one only where a value begins."""
        while True:
            at = BEFORE_QUOTE.match(html, at).end()
            if at >= len(html):
                return -1
            if html[at] == ">":
                return at
            value = VALUE.match(html, at)
            at = value.end()
            if value[1]:
                at = html.find(value[1], at) + 1
                if not at:
                    return -1

    def _sums(self, values: list[int]) -> list[int]:
        """Of each container with all inside it; a container comes before those inside it."""
        out = values[:]
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out

    def _per_container(self, value) -> list[int]:
        out = [0] * len(self.tags)
        for block in self.blocks:
            out[block[0]] += value(block)
        return out

    def _settle(self) -> None:
        """Doubtful containers stay if they hold more than half of the page's text, with few links; the blocks of others go."""
        chars, links = self._sums(self._per_container(lambda b: len(b[1]))), self._sums(self._per_container(lambda b: b[2]))
        gone = [False] * len(self.tags)
        for i in range(1, len(self.tags)):
            doubtful = self.doubts[i] and not (2 * chars[i] > chars[0] and 3 * links[i] < chars[i])
            gone[i] = gone[self.parents[i]] or doubtful
        self.blocks = [b for b in self.blocks if not gone[b[0]]]
        self.own = self._per_container(lambda b: max(0, len(b[1]) - 2 * b[2]))
        self.held = self._sums(self.own)
        self._links_held = self._sums(self._per_container(lambda b: b[2]))
        self._headed = self._sums(self._per_container(lambda b: b[3] and 2 * b[2] < len(b[1])))

    def best(self) -> int:
        """The container of the page's text: the one that scores most, lifted to what holds its headline and siblings."""
        scores: dict[int, float] = defaultdict(float)
        for i, own in enumerate(self.own):
            for at, k in ((i, 1.0), (self.parents[i], 0.5)):
                if own and at > 0:
                    scores[at] += own * k * (1.5 if self.tags[at] in ARTICLE else 1.0)
        found = at = max(scores, key=lambda i: (scores[i], -i), default=0)
        while at > 0 and self.tags[at] not in ARTICLE:
            at = self.parents[at]
            more, links = self.held[at] - self.held[found], self._links_held[at] - self._links_held[found]
            if links <= more and (more >= LEAST_PART * self.held[found] or self._headed[at] > self._headed[found]) and more > 0:
                found = at
        return found

    def votes(self) -> dict[str, float]:
        """The page's vote, by path; none without text."""
        first = self.best()
        return {self.name(self.paths[first]): 1.0} if self.held[first] else {}

    def _inside(self, chosen: set[int]) -> list[bool]:
        out = [False] * len(self.tags)
        for i, parent in enumerate(self.parents):
            out[i] = i in chosen or parent >= 0 and out[parent]
        return out

    def under(self, chosen: set[int]) -> str:
        inside = self._inside(chosen)
        return "\n".join(b[1] for b in self.blocks if inside[b[0]])

    def text(self, paths: list[str]) -> str:
        own = self.best()
        if paths:
            wanted = set(paths)
            named = {k: n for k in set(self.paths) if (n := self.name(k)) in wanted}
            places: dict[str, set[int]] = defaultdict(set)
            for i, path in enumerate(self.paths):
                if path in named:
                    places[named[path]].add(i)
            chosen: set[int] = set()
            held = 0
            for path in paths:  # best first; what holds a place already chosen, or lies in one, is no second part
                inside = self._inside(chosen)
                around = [False] * len(self.tags)
                for i in chosen:
                    while i > 0 and not around[i]:
                        around[i], i = True, self.parents[i]
                new = {i for i in places[path] if not inside[i] and not around[i]}
                more = sum(self.held[i] for i in new)  # places of one path are equally deep, so none lies in another
                if more >= (LEAST_HELD * self.held[own] if not chosen else LEAST_JOINED * held) and more:
                    chosen, held = chosen | new, held + more
            if chosen and (text := self.under(chosen)):
                return text
        return self.under({own}) or self.under({0})


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def container_votes(html: Column) -> Column:
    @F.arrow_udf("array<struct<path:string,share:double>>")
    def votes(pages: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("path", pa.string()), ("share", pa.float64())]))
        return pa.array([[{"path": k, "share": v} for k, v in sorted(Page(x.as_py() or "").votes().items())] for x in pages], kind)

    return votes(html)


def text_by_paths(html: Column, paths: Column) -> Column:
    @F.arrow_udf("string")
    def extract(pages: pa.Array, wanted: pa.Array) -> pa.Array:
        return pa.array([Page(x.as_py() or "").text(p.as_py() or []) for x, p in zip(pages, wanted, strict=True)], pa.string())

    return extract(html, paths)


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, paths: those with LEAST_VOTES of the host's votes or more, best first."""
    votes = pages.select(host(F.col(url)).alias("host"), F.explode(container_votes(F.col(html))).alias("v"))
    sums = cut(votes.groupBy("host", "v.path").agg(F.sum(F.round("v.share", 6)).alias("votes")))
    totals = sums.groupBy("host").agg(F.sum("votes").alias("all"))
    # what stays is at most 1 / LEAST_VOTES paths a host, however many its pages have
    strong = sums.join(totals, "host").where(F.col("votes") >= LEAST_VOTES * F.col("all"))
    ranked = strong.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.round("votes", 3)).alias("less"), "path"))).alias("ranked"))
    return ranked.select("host", F.transform("ranked", lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, host, paths (the host's), text, n_chars."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host(F.col(url)).alias("host"), F.col(html).alias("html"))
    paths = host_paths(pages, url, html)
    few = own.select("host").distinct().count() <= BROADCAST_HOSTS
    found = own.join(F.broadcast(paths) if few else paths, "host", "left").withColumn("text", text_by_paths(F.col("html"), F.col("paths")))
    return found.select("page_id", "url", "host", "paths", "text", F.length("text").cast("long").alias("n_chars"))


def op1(pages: DataFrame) -> DataFrame:
    return main_text(pages).select("page_id", "url", "text", "n_chars")
