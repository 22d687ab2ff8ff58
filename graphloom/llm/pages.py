"""Main text of HTML pages by equivalence classes of tokens over the pages of a host."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import small_batches, staged

#: Distinct pages of a host that have to share a token, and tokens that a class needs, to be template.
TEMPLATE_PAGES, CLASS_TOKENS = 3, 2
#: Numbers (tokens, classes, paths) up to which what all hosts know is sent to every task, some 32 MB; more is joined by shuffle,
#: each host's row to SALTS tasks.
BROADCAST_NUMBERS, SALTS = 1 << 22, 64
#: Elements that can be a slot; others are parts of a text.
SLOTS = set("html body main article div section center td".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript template iframe".split())
DROP = set("head nav aside form select button svg footer dialog menu".split())
#: Of these only the text goes; what stands round them is one text.
INLINE = ("select", "button", "svg")
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that a start tag closes if they are open where it stands.
_CELL, _ROW = {"p", "td", "th"}, {"p", "td", "th", "tr"}
CLOSES = {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "td": _CELL, "th": _CELL, "tr": _ROW, "tbody": _ROW | {"caption", "thead", "tbody"}, "tfoot": _ROW | {"caption", "thead", "tbody"}, "thead": _ROW | {"caption"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
#: Class, id and role pieces that tell of boilerplate on the containers of MARKABLE; texts, lists' items, headings and the page's own frame never match.
MARKABLE = set("div section ul ol dl table tbody tr td aside details fieldset figure center address".split())
WORDS = set("ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus share social related newsletter subscribe login popup modal widget".split())

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_END = re.compile(r">|=[ \t\r\n\f]*([\"'])")
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role)[ \t\r\n\f]*=[ \t\r\n\f]*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?![a-zA-Z0-9:-])[^>]*>", re.I) for name in RAW}


class _Node:
    """An element that can hold texts. path: a number for its step (name and marks) under its parent's path."""

    __slots__ = ("name", "above", "path", "depth", "article", "marked", "dropped", "size", "keeps", "noisy")

    def __init__(self, name: str, marks: set[str], above: _Node | None):
        self.name, self.above = name, above
        self.path = _path(above.path if above else 0, name + "".join(f".{w}" for w in sorted(marks)))
        self.depth = above.depth + 1 if above else 1
        self.article = name == "article" or bool(above and above.article)
        self.marked = name in MARKABLE and (bool(marks & WORDS) or "header" in marks and not self.article)
        self.dropped = name in DROP or name == "header" and not self.article
        self.size, self.keeps, self.noisy = 0, False, False


_PATHS: dict[tuple[int, str], int] = {}


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def _path(above: int, step: str) -> int:
    found = _PATHS.get((above, step))
    if found is None:
        if len(_PATHS) > 1 << 20:
            _PATHS.clear()
        found = _PATHS[above, step] = _number(above.to_bytes(8, "little", signed=True), step.encode("utf-8", "surrogatepass"))
    return found


class Page:
    """The elements and texts of a page in order, read in one pass: every character is looked at a bounded number of times, and an
    element knows its parent alone, so neither broken tags nor deep nesting cost more than their length."""

    def __init__(self, page: str):
        self.nodes: list[_Node] = []
        self.blocks: list[tuple[_Node | None, str]] = []
        self.order: list[tuple[bool, int]] = []  # (is a text, its number)
        self._read(page)
        self._judge()

    def _say(self, text: str) -> None:
        if not any(self.open[x] for x in INLINE):
            self.held.append(text)

    def _flush(self) -> None:
        if any(self.open[x] for x in INLINE):
            return
        text = " ".join(html.unescape("".join(self.held)).split())
        self.held.clear()
        if text:
            self.order.append((True, len(self.blocks)))
            self.blocks.append((self.stack[-1] if self.stack else None, text))
            if self.stack:
                self.stack[-1].size += len(text)

    def _pop(self) -> _Node:
        x = self.stack.pop()
        self.open[x.name] -= 1
        return x

    def _tag_end(self, page: str, at: int) -> int:
        """Where the tag that begins before `at` ends, past its >; quoted values are skipped. -1 if it never does."""
        while m := _END.search(page, at):
            if m[1] is None:
                return m.end()
            close = -1 if m[1] in self.unpaired else page.find(m[1], m.end())
            if close < 0:  # no such quote any more: from here on it is a character like others
                self.unpaired.add(m[1])
            at = m.end() if close < 0 else close + 1
        return -1

    def _read(self, page: str) -> None:
        self.stack: list[_Node] = []
        self.held: list[str] = []
        self.open: Counter = Counter()
        self.unpaired: set[str] = set()
        last = page.rfind(">")
        at = 0
        while True:
            lt = page.find("<", at)
            if lt < 0 or lt > last:
                self._say(page[at:lt] if lt >= 0 and page.startswith("<!--", lt) else page[at:])
                break
            self._say(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = len(page) if end < 0 else end + 3
                continue
            if page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                at = page.find(">", lt) + 1 if end < 0 else end + 3
                continue
            if page[lt + 1 : lt + 2] in ("!", "?"):
                at = page.find(">", lt) + 1
                continue
            m = _NAME.match(page, lt + 1)
            end = self._tag_end(page, m.end()) if m else -1
            if end < 0:
                self._say("<")
                at = lt + 1
                if m:  # a tag without an end: what is left is text
                    self._say(page[at:])
                    break
                continue
            at = end
            name = m[0].lower()
            if name[0] == "/":
                self._close(name[1:])
                continue
            if name in BLOCK:
                self._flush()
            if name in RAW:
                end = _RAW_END[name].search(page, at) if at <= last else None
                at = end.end() if end else len(page)
            elif name == "br":
                self._say(" ")
            elif name not in VOID and (name in BLOCK or name in DROP) and page[at - 2] != "/":
                self._open(name, page[m.end() : at - 1])
        self.open.clear()
        self._flush()

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self._flush()
        if self.open[name]:
            while self._pop().name != name:
                pass

    def _open(self, name: str, attributes: str) -> None:
        gone = CLOSES.get(name, {"p"} if name in BLOCK else ())
        while self.stack and self.stack[-1].name in gone:
            if self._pop().name == name and name != "p":
                break
        marks = {w for _, *v in _ATTR.findall(attributes) for w in re.split(r"[^a-z0-9]+", "".join(v).lower()) if w} if "=" in attributes else set()
        node = _Node(name, marks, self.stack[-1] if self.stack else None)
        self.order.append((False, len(self.nodes)))
        self.nodes.append(node)
        self.stack.append(node)
        self.open[name] += 1

    def _judge(self) -> None:
        """Sizes go up; what holds the main element or the page's longest article is never marked, nor is a form round it dropped;
        what is dropped or marked goes down."""
        for x in reversed(self.nodes):
            if x.above:
                x.above.size += x.size
        keepers = [x for x in self.nodes if x.name in ("article", "main")]
        longest = max((x for x in keepers if x.name == "article"), key=lambda x: x.size, default=None)
        for x in keepers:
            if x.name == "main" or x is longest:
                while x and not x.keeps:
                    x.marked, x.keeps = False, True
                    x.dropped = x.dropped and x.name not in ("form", "header")
                    x = x.above
        for x in self.nodes:
            x.dropped = x.dropped or bool(x.above and x.above.dropped)

    def tokens(self):
        """(number, is a text, node, length) of every token in order: elements, and texts that aren't in a dropped element."""
        for text, k in self.order:
            if not text:
                yield self.nodes[k].path, False, self.nodes[k], 0
            else:
                node, words = self.blocks[k]
                if not (node and node.dropped):
                    yield _number((node.path if node else 0).to_bytes(8, "little", signed=True), words.encode("utf-8", "surrogatepass")), True, node, len(words)

    def mute(self, noise: set[int]) -> None:
        for x in self.nodes:
            x.noisy = bool(x.above and x.above.noisy) or x.marked and x.path in noise


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))


# kinds of rows: a page, an element's path, a marked element's path, a text
_PAGE, _ELEMENT, _MARKED, _TEXT = range(4)
_SEEN = "host string, page long, kind int, token long, depth int, name string, n long, size long"


def _tokens(batches):
    """A row a page and token: how often the page has it, and the characters that it holds."""
    for batch in batches:
        out = []
        for host, number, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page, seen = Page(raw or ""), {}
            total = 0
            for token, text, node, size in page.tokens():
                row = seen.setdefault((_TEXT if text else _ELEMENT, token), [0, "", 0, 0])
                row[2] += 1
                row[3] += size
                total += size
                if not text:
                    row[0], row[1] = node.depth, "" if node.dropped else node.name
                    if node.marked and not node.dropped:
                        seen.setdefault((_MARKED, token), [0, "", 0, 0])[3] += node.size
            out.append((host, number, _PAGE, 0, 0, "", 1, total))
            out += [(host, number, kind, token, *row) for (kind, token), row in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["host", "page", "kind", "token", "depth", "name", "n", "size"])


def nesting(sequence: list[tuple[int, int]], sizes: dict[int, int]) -> tuple[dict[int, tuple[int, ...]], set[int]]:
    """(the tokens of each class in order, classes that aren't ordered or nested) of a page's (token, class) in order.

    A class is ordered if its tokens follow one another in the same cycle throughout; it is nested if each cycle lies in one gap of
    the classes around it. Of two that cross, the one that began later isn't."""
    cycle: dict[int, list[int]] = {}
    at: Counter = Counter()
    stack: list[int] = []
    bad: set[int] = set()
    held: Counter = Counter()
    for token, c in sequence:
        known = cycle.setdefault(c, [])
        place = at[c] % sizes[c]
        if at[c] < sizes[c]:
            if token in known:
                bad.add(c)
            known.append(token)
        elif known[place] != token:
            bad.add(c)
        at[c] += 1
        if c in bad:
            continue
        if place == 0:
            if sizes[c] > 1:
                stack.append(c)
                held[c] += 1
        elif not held[c]:
            bad.add(c)
        else:
            while stack[-1] != c:
                x = stack.pop()
                held[x] -= 1
                bad.add(x)
            if place == sizes[c] - 1:
                stack.pop()
                held[c] -= 1
    bad |= set(stack) | {c for c in at if at[c] % sizes[c]}
    return {c: tuple(t) for c, t in cycle.items()}, bad


def _ordered(batches):
    """Of each host's candidate classes: the hash of their order, 0 where a page has them out of order, of their elements alone
    (kind 0) and with their texts (kind 2). Of each element's path, and of 0 for the page: the characters under it, by class of
    their text, 0 for texts of none (kind 1). Summed over a batch."""
    for batch in batches:
        orders, own = set(), Counter()
        for host, raw, tokens, classes, texts, noise in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "tokens", "classes", "texts", "noise")), strict=True):
            if not tokens:
                continue
            of = dict(zip(zip(tokens, texts, strict=True), classes, strict=True))
            page = Page(raw or "")
            page.mute(set(noise or ()))
            sequence = []
            under: dict[int, Counter] = {}
            for token, text, node, size in page.tokens():
                c = of.get((token, text), 0)
                if c:
                    sequence.append((token, c, text))
                if text and not (node and node.noisy):
                    own[host, 0, c] += size
                    if node:
                        under.setdefault(id(node), Counter())[c] += size
            for x in reversed(page.nodes):
                held = under.pop(id(x), None)
                if held:
                    for c, size in held.items():
                        own[host, x.path, c] += size
                    if x.above:
                        into = under.setdefault(id(x.above), held)
                        if into is not held:
                            into.update(held)
            for kind, whole in ((0, False), (2, True)):
                sizes = Counter(c for (_, text), c in of.items() if whole or not text)
                cycles, bad = nesting([(t, c) for t, c, text in sequence if whole or not text], sizes)
                orders |= {(host, kind, c, 0 if c in bad else _number(np.array(t, np.int64).tobytes())) for c, t in cycles.items()}
        rows = [(*o, 0) for o in orders] + [(h, 1, p, c, n) for (h, p, c), n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "kind", "a", "b", "n"])


def with_host(pages: DataFrame, known: DataFrame, numbers: int) -> DataFrame:
    """pages (with host) and what their host knows. known: a row a host, `numbers` numbers in all."""
    if numbers <= BROADCAST_NUMBERS:
        return pages.join(F.broadcast(known), "host", "left")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def candidates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens, noise). tokens: host, token, name, depth, text, class: those on half of a host's distinct pages and on TEMPLATE_PAGES
    at least, with the class of tokens that have their occurrence vector: how often each page has them. The vector is kept as the
    exclusive or of hashes of (page, times), so it is summed before any shuffle, whatever share of all pages a host has. Vectors
    of fewer than CLASS_TOKENS tokens make no class. noise: host, noise: marked containers that are boilerplate: they recur on a tenth
    of the pages (on two at least, if the host has more than one) and hold less than half of the text."""
    lean = pages.select("host", F.xxhash64("html").alias("page"), "html")
    seen = lean.mapInArrow(_tokens, _SEEN).groupBy("host", "kind", "token", "page").agg(F.max("depth").alias("depth"), F.max("name").alias("name"), F.max("n").alias("n"), F.max("size").alias("size"))
    vector = F.bit_xor(F.xxhash64("page", "n")).alias("vector")
    seen = seen.groupBy("host", "kind", "token").agg(F.count("*").alias("pages"), vector, F.sum("size").alias("size"), F.max("depth").alias("depth"), F.max("name").alias("name"))
    seen = staged(seen.where(f"kind <> {_TEXT} OR pages >= {TEMPLATE_PAGES}"), "page-tokens")
    whole = seen.where(f"kind = {_PAGE}").select("host", F.col("pages").alias("all_pages"), F.col("size").alias("all_text"))
    seen = seen.where(f"kind <> {_PAGE}").join(whole, "host")
    often = seen.where(f"kind <> {_MARKED} AND pages * 2 >= all_pages AND pages >= {TEMPLATE_PAGES}")
    large = often.groupBy("host", "vector").agg(F.count("*").alias("tokens")).where(F.col("tokens") >= CLASS_TOKENS)
    tokens = often.join(large, ["host", "vector"]).select("host", "token", "name", "depth", (F.col("kind") == _TEXT).alias("text"), F.when(F.col("vector") == 0, 1).otherwise(F.col("vector")).alias("class"))
    noise = seen.where(f"kind = {_MARKED} AND pages * 10 >= all_pages AND (pages >= 2 OR all_pages = 1) AND size * 2 < all_text").groupBy("host").agg(F.collect_set("token").alias("noise"))
    return staged(tokens, "page-classes"), staged(noise, "page-noise")


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, noise, frame) of pages with host, as path numbers: the container of the host's text slot, its marked containers that
    are boilerplate, and its containers that hold template texts alone.

    Candidate classes are valid where every page has their tokens in one order, whole cycles of them, nested in the other classes'
    gaps; their elements may be so while their texts change places. Texts of classes valid as a whole are template, all others
    fill slots. The slot is the deepest container of a valid class that holds
    nine tenths of what fills slots."""
    tokens, noise = candidates(pages)
    known = tokens.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "class", "text"))).alias("x")).select("host", F.col("x.token").alias("tokens"), F.col("x.class").alias("classes"), F.col("x.text").alias("texts")).join(noise, "host", "left")
    numbers = (tokens.count() * 3) + (noise.agg(F.sum(F.size("noise"))).first()[0] or 0)
    met = with_host(pages.select("host", "html"), known, numbers).where("tokens IS NOT NULL").mapInArrow(_ordered, "host string, kind int, a long, b long, n long")
    met = staged(met.groupBy("host", "kind", "a", "b").agg(F.sum("n").alias("n")), "page-orders")
    one = met.where("kind <> 1").groupBy("host", "kind", F.col("a").alias("class")).agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo = hi AND lo <> 0")
    valid = one.where("kind = 0").select("host", "class")
    template = one.where("kind = 2").select("host", "class", F.lit(True).alias("template"))
    under = met.where("kind = 1").select("host", F.col("a").alias("token"), F.col("b").alias("class"), "n").join(template, ["host", "class"], "left")
    under = under.groupBy("host", "token").agg(F.sum(F.when(F.col("template"), 0).otherwise(F.col("n"))).alias("own"))
    boxes = tokens.where("NOT text AND name <> ''").join(valid, ["host", "class"]).select("host", "token", "name", "depth").join(under, ["host", "token"])
    frame = boxes.where(F.col("name").isin(*sorted(MARKABLE)) & (F.col("own") == 0)).groupBy("host").agg(F.collect_set("token").alias("frame"))
    total = under.where("token = 0").select("host", F.col("own").alias("total"))
    slots = boxes.join(total, "host").where(F.col("name").isin(*sorted(SLOTS)) & (F.col("own") * 10 >= F.col("total") * 9) & (F.col("own") > 0))
    main = slots.groupBy("host").agg(F.max(F.struct("depth", "token")).alias("x")).select("host", F.col("x.token").alias("main"))
    every = pages.select("host").distinct()
    return every.join(main, "host", "left").join(noise, "host", "left").join(frame, "host", "left")


def main_text(raw: str, main: int | None, noise=frozenset(), frame=frozenset()) -> str:
    page = Page(raw)
    page.mute(noise)
    inside: dict[int, bool] = {}
    framed: dict[int, bool] = {}
    for x in page.nodes:
        inside[id(x)] = x.path == main or bool(x.above and inside[id(x.above)])
        framed[id(x)] = not x.article and (x.path in frame and x.path != main or bool(x.above and framed[id(x.above)]))
    blocks = [b for b in page.blocks if not (b[0] and (b[0].dropped or b[0].noisy))]
    slot = [b for b in blocks if b[0] and inside[id(b[0])]] if main is not None else []
    article = [b for b in blocks if b[0] and b[0].article]
    # an article is kept whole: a slot in articles is widened to them, and they serve pages that don't have the slot
    if article and (not slot or all(b[0].article for b in slot)):
        return "\n\n".join(b[1] for b in article)
    found = slot or blocks
    return "\n\n".join(b[1] for b in found if not (b[0] and framed[id(b[0])]) or all(framed[id(y[0])] for y in found if y[0]))


def _extract(batches):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("html", "main", "noise", "frame")), strict=True)
        texts = [main_text(raw or "", main, set(noise or ()), set(frame or ())) for raw, main, noise, frame in rows]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], dtype=np.int64))], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. One row per row: page_id, url, text, n_chars.

    Elements and texts of a host's pages with equal occurrence vectors are a class; valid classes, ordered and nested, are the host's
    template; what fills the slot of the template that holds the most is the page's text. Inside an article nothing is dropped for
    being template; elsewhere containers are that hold template texts alone. A page without the slot gives its article, else all.
    Menus, headers, footers, forms and the like are left out by their element; containers whose class, id or role tells of
    sidebars, notices, adverts or comments where the host's pages confirm it.

    Null or empty html gives an empty text; a null url is a host like others; repeated rows each have their row, and count once in
    the template; broken tags, unclosed elements, deep nesting and very long pages cost time in proportion to their length; other
    columns, whatever their names, play no part; no rows give no rows.
    """
    small_batches(pages.sparkSession)
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    known = staged(templates(hosted), "page-templates")
    numbers = known.agg(F.sum(F.lit(3) + F.coalesce(F.size("noise"), F.lit(0)) + F.coalesce(F.size("frame"), F.lit(0)))).first()[0] or 0
    return with_host(hosted, known, numbers).select("page_id", "url", "html", "main", "noise", "frame").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
