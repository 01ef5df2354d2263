"""HTML extraction by equivalence-class template deduction.

A site's pages are made from a template, whose tokens show in every page that uses it, while the
data in its slots vary. Tokens are the starts and ends of elements, told by name, class and id. The
occurrence vector of a token lists how often each page of its host has it; tokens that share a vector
are an equivalence class. Vectors are compared by a fingerprint that is merged over pages, so no task
sees a host's pages together. Classes whose tokens occur once a page, in enough of the host's pages, are
valid; ordered by their mean place they nest into the host's template. The template's tokens cut a page
into slots, and its elements nest them.

The template decides what is main text. A slot whose text most of the host's distinct pages hold alike is the
template's own; contents are compared by fingerprints. Of the text that is left, outside of links, the innermost
element of the template that holds more than half is the host's main element, and everything outside of it goes,
whatever it is called and however it varies. Names of elements, and words in classes and ids, tell furniture inside the
main element, in pages of another layout, and on hosts of too few pages to compare.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, narrow_batches
from .url_filter import parts

RAW = ("script", "style", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
#: Elements that never hold main text, and words in a class or id that say the same of an element (but of none in NEVER).
FURNITURE = {"head", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "svg", "math", "object", "audio", "video", "canvas", "map", "search", *RAW}
FURNITURE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pagination", "popup", "promo", "promotion", "related", "replies", "reply", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "toolbar"}
MAIN = {"article", "main"}
NEVER = {"html", "body", *MAIN}
#: Elements of a template that may be its main one.
CONTAINERS = ("html", "body", "article", "main", "div", "section", "center", "table", "tbody", "tr", "td")
#: An end tag that is left out is implied by these start tags.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Least share of a host's pages that a class of the template has, in percent.
SHARE = 20
#: A text in more than this share of the distinct pages that have a slot is the template's, in percent; distinct pages that tell.
ALIKE, TELLING = 50, 4
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<broken>/?[a-zA-Z][^<>]*)\Z",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[a-z]+")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}


def tokens(page: str) -> Iterator[tuple[str, str, int, str]]:
    """Kind (text, open, close), name or text, whether it is furniture by itself (2) or by its words (1), and the key of a start tag."""
    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        if not found:
            break
        if found.start() > at:
            yield "text", page[at : found.start()], 0, ""
        at = found.end()
        if not found["name"]:
            continue
        name = found["name"].lower()
        if found["close"]:
            yield "close", name, 0, ""
            continue
        told = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(found["rest"])} if found["rest"].strip(" /") else {}
        label = " ".join(told.get(k, "") for k in ("class", "id"))
        odd = 2 if name in FURNITURE or told.get("role") in FURNITURE_ROLES or "hidden" in told else 0
        if told.get("role") == "main":
            name = "main"
        if not odd and name not in NEVER and not FURNITURE_WORDS.isdisjoint(_WORD.findall(label)):
            odd = 1
        yield "open", name, odd, f"{name} {label}".strip()
        if name in RAW:
            end = _END[name].search(page, at)
            at = end.end() if end else len(page)
            yield "close", name, 0, ""
    if at < len(page):
        yield "text", page[at:], 0, ""


def walk(page: str, stack: list[tuple[str, int, str, int]]) -> Iterator[tuple[str, str, int, str]]:
    """The page's tokens as a tree: each end is that of an open element and has its key after a slash, ends that are left
    out are put in, and ends of nothing are blank. stack: filled with the open elements: name, furniture, key, number."""
    number = 0
    for kind, name, odd, key in tokens(page):
        if kind == "text":
            yield kind, name, 0, ""
            continue
        at = -1
        if kind == "close":
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if at < 0:
                yield "blank", name, 0, ""
        elif closes := IMPLIED.get(name):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    at = k
                    break
                if stack[k][0] in BLOCKS and stack[k][0] != "p":
                    break
        if at >= 0:
            while len(stack) > at:
                inner, _, own, _ = stack.pop()
                yield "close", inner, 0, "/" + own
        if kind == "open":
            if name in VOID:
                yield "void", name, odd, key
            else:
                number += 1
                stack.append((name, odd, key, number))
                yield kind, name, odd, key


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and token: pages, occurrences, fingerprint of the occurrence vector and summed places."""
    for batch in batches:
        sums: dict[tuple[str, str], list[int]] = {}
        for i, host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seen: dict[str, list[int]] = {"": [1, 0]}
            for place, (_, _, _, key) in enumerate(walk(page or "", [])):
                if key:
                    seen.setdefault(key, [0, place])[0] += 1
            for key, (count, place) in seen.items():
                mark = int.from_bytes(blake2b(f"{i} {count}".encode(), digest_size=8).digest(), "little", signed=True)
                s = sums.setdefault((host, key), [0, 0, 0, 0])
                s[0], s[1], s[2], s[3] = s[0] + 1, s[1] + count, s[2] ^ mark, s[3] + place
        if sums:
            hosts, keys = zip(*sums, strict=True)
            columns = zip(*sums.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(keys), *(pa.array(c, pa.int64()) for c in columns)], names=["host", "key", "n", "total", "vector", "place"])


def templates(pages: DataFrame) -> DataFrame:
    """pages: id, host, html. Rows host, template: the keys of the host's template in order."""
    found = pages.select("id", "host", "html").mapInArrow(_occurrences, "host string, key string, n long, total long, vector long, place long")
    found = found.groupBy("host", "key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.expr("bit_xor(vector)").alias("vector"), F.sum("place").alias("place"))
    found = Scratch(pages.sparkSession).cut(found)
    hosts = found.filter("key = ''").select("host", F.col("n").alias("pages"))
    once = found.filter("key <> '' and n = total").join(hosts, "host").filter((F.col("n") * 100 >= F.col("pages") * SHARE) & (F.col("n") >= F.least(F.lit(2), F.col("pages"))))
    classes = once.groupBy("host", "vector").agg(F.collect_list(F.struct((F.col("place") / F.col("n")).alias("place"), "key")).alias("keys"))
    # a host's template has at most 100 / SHARE times the tags of a mean page
    return classes.filter(F.size("keys") > 1).groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("keys"))).alias("keys")).select("host", F.col("keys.key").alias("template"))


def mark(texts: list[str]) -> int:
    """Fingerprint of a slot's text; white space counts as between words only."""
    return int.from_bytes(blake2b(" ".join(" ".join(texts).split()).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Slots:
    """Follows a page's walk: the slot that text is in, told by the token of the template before it ('': none), and the
    elements of the template around it."""

    def __init__(self, template: set[str]):
        self.template, self.slot, self.path = template, "", []

    def see(self, kind: str, key: str) -> bool:
        """Whether a slot begins."""
        if not key or key not in self.template:
            return False
        self.slot = key
        if kind == "open":
            self.path.append(key)
        elif kind == "close" and key[1:] in self.path:
            del self.path[self.path.index(key[1:]) :]
        return True


def contents(page: str, template: set[str]) -> dict[str, tuple[int, int, str]]:
    """By slot: fingerprint, characters of text outside of links, and the template's elements around it, a line each."""
    held: dict[str, list] = {"": ["", 0, []]}
    at, stack = Slots(template), []
    for kind, name, _, key in walk(page, stack):
        if kind == "text":
            own = held[at.slot]
            text = unescape(name)
            own[2].append(text)
            if not any(e[0] == "a" or e[0] == "head" or e[0] in RAW for e in stack):
                own[1] += len("".join(text.split()))
        elif at.see(kind, key) and at.slot not in held:
            held[at.slot] = ["\n".join(at.path), 0, []]
    return {k: (mark(t), n, path) for k, (path, n, t) in held.items()}


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page: host, digest of all its slots, and the slots with their fingerprints."""
    kind = pa.list_(pa.struct([("slot", pa.string()), ("mark", pa.int64()), ("chars", pa.int64()), ("path", pa.string())]))
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            found = [contents(p or "", set(t)) for p, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            digests = [blake2b(repr([(k, x[0]) for k, x in f.items()]).encode("utf-8", "surrogatepass"), digest_size=16).digest() for f in found]
            slots = pa.array([[{"slot": k, "mark": m, "chars": n, "path": path} for k, (m, n, path) in f.items()] for f in found], kind)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), slots], names=["host", "page", "slots"])


def slots_of(pages: DataFrame, known: DataFrame) -> DataFrame:
    """pages: id, host, html; known: host, template. Rows host, fixed, spine: the slots with the fingerprint of the text that is the
    template's, and the elements down to the main one; for hosts of TELLING distinct pages or more.

    Pages of a host with equal texts in all slots count as one. More than half of the pages can agree on one text only.
    What is inside article and main elements is taken for the template's only where it is the lesser part of the main
    element's text: copies of an article are no template.
    """
    found = pages.join(known, "host").select("host", "html", "template").mapInArrow(_contents, "host string, page binary, slots array<struct<slot: string, mark: long, chars: long, path: string>>")
    found = found.groupBy("host", "page").agg(F.first("slots").alias("slots")).select("host", F.explode("slots").alias("s"))
    found = found.groupBy("host", "s.slot", "s.mark").agg(F.count("*").alias("n"), F.sum("s.chars").alias("chars"), F.max("s.path").alias("path"))
    slots = found.groupBy("host", "slot").agg(F.sum("n").alias("pages"), F.sum("chars").alias("chars"), F.max("path").alias("path"), F.max(F.struct("n", "mark")).alias("top"))
    slots = slots.withColumns({"same": (F.col("pages") >= TELLING) & (F.col("top.n") * 100 > F.col("pages") * ALIKE), "inside": F.col("path").rlike(r"(?m)^(article|main)( |$)")})
    slots = Scratch(pages.sparkSession).cut(slots.withColumn("own", F.when(~F.col("same") | F.col("inside"), F.col("chars")).otherwise(0)))
    telling = slots.filter("slot = ''").filter(F.col("pages") >= TELLING).select("host")
    total = slots.groupBy("host").agg(F.sum("own").alias("all"))
    up = F.split("path", "\n")
    nested = slots.filter("path <> ''").select("host", "own", F.explode(F.transform(F.sequence(F.lit(1), F.size(up)), lambda k: F.slice(up, 1, k))).alias("spine"))
    nested = nested.groupBy("host", "spine").agg(F.sum("own").alias("own")).join(total, "host")
    kind = F.split(F.element_at("spine", -1), " ")[0]
    wide = nested.filter(kind.isin(*CONTAINERS) & (2 * F.col("own") > F.col("all"))).groupBy("host").agg(F.min_by("spine", F.struct("own", -F.size("spine"))).alias("spine"))
    # an article or main element breaks the tie between what it holds and what is around it: the outermost one with most text
    named = nested.filter(kind.isin(*MAIN) & (F.col("own") > 0)).groupBy("host").agg(F.min_by("spine", F.struct(-F.col("own"), F.size("spine"))).alias("named"))
    spine = wide.join(named, "host", "left").select("host", F.coalesce("named", "spine").alias("spine"))
    slots = slots.join(spine, "host", "left")
    within = F.coalesce(F.slice(up, F.lit(1), F.size("spine")) == F.col("spine"), F.lit(False))
    lesser = slots.filter(within).groupBy("host").agg((2 * F.sum(F.when(F.col("same"), F.col("chars")).otherwise(0)) < F.sum("chars")).alias("lesser"))
    fixed = slots.filter("same").join(lesser, "host", "left").filter(~F.col("inside") | F.coalesce("lesser", F.lit(False)))
    fixed = fixed.groupBy("host").agg(F.collect_list(F.struct("slot", F.col("top.mark").alias("mark"))).alias("fixed"))  # no more than a template has slots
    return telling.join(fixed, "host", "left").join(spine, "host", "left")


def main_text(page: str, template: set[str], fixed: dict[str, int] | None = None, spine: list[str] = ()) -> str:
    """The blocks of the slots that hold main text, joined by two line ends. fixed: fingerprints of slots' texts that are the
    template's; spine: keys of the elements down to the host's main one."""
    at, stack = Slots(template), []
    pieces: list[tuple[str | None, str, tuple]] = []  # text or None for a block's end, slot, open elements
    mains: set[int] = set()  # article and main elements
    core: set[int] = set()  # the host's main element
    open_: tuple = ()
    for kind, name, _, key in walk(page, stack):
        if kind == "text":
            pieces.append((unescape(name), at.slot, open_))
            continue
        if kind != "void":
            open_ = tuple(stack)
        at.see(kind, key)
        if kind == "open":
            if name in MAIN:
                mains.add(stack[-1][3])
            if spine and key == spine[-1]:
                core.add(stack[-1][3])
        if name in BLOCKS:
            pieces.append((None, at.slot, open_))
        elif name == "br":
            pieces.append((" ", at.slot, open_))
    whole: dict[str, list[str]] = {}
    if fixed:
        for text, slot, _ in pieces:
            if text and text != " ":
                whole.setdefault(slot, []).append(text)
    same = {k for k, t in whole.items() if k in fixed and fixed[k] == mark(t)} if fixed else set()
    # words in a class say nothing of an element around the main one, nor, where there is none, of one with most of the text
    spared, size = set(), {}
    for text, _, open_ in pieces:
        if any(e[3] in mains or e[3] in core for e in open_):
            for e in open_:
                if e[3] in mains or e[3] in core:
                    break
                spared.add(e[3])
        if not mains and text and not any(e[1] == 2 for e in open_):
            for e in open_:
                size[e[3]] = size.get(e[3], 0) + len(text.strip())
            size[0] = size.get(0, 0) + len(text.strip())
    spared |= core | {e for e, n in size.items() if 2 * n > size[0]}

    def furniture(open_: tuple) -> bool:
        inside = False
        for name, odd, _, number in open_:
            if odd == 2 and not (inside and name == "header") or odd == 1 and number not in spared:
                return True
            inside |= name in MAIN
        return False

    told: dict[tuple, bool] = {}
    held = []
    for text, slot, open_ in pieces:
        if open_ not in told:
            told[open_] = furniture(open_)
        held.append((text, open_, not told[open_] and slot not in same))
    choice = [core] if core else []
    choice.append(mains)
    kept = None
    for elements in choice:
        if any(ok and text and not text.isspace() and any(e[3] in elements for e in open_) for text, open_, ok in held):
            kept = elements
            break
    if kept is None and core:
        return ""
    blocks: list[list[str]] = [[]]
    for text, open_, ok in held:
        if text is None:
            blocks.append([])
        elif ok and (kept is None or any(e[3] in kept for e in open_)):
            blocks[-1].append(text)
    plain = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in plain if b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            known = [set(t or ()) for t in part.column(3).to_pylist()]
            fixed = [{s["slot"]: s["mark"] for s in f or ()} for f in part.column(4).to_pylist()]
            spines = [x or [] for x in part.column(5).to_pylist()]
            text = [main_text(p or "", t, f, x) for p, t, f, x in zip(part.column(2).to_pylist(), known, fixed, spines, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars.

    On a host of TELLING distinct pages or more, its template tells: the text of its main element is extracted, but for
    slots that more than half of the distinct pages fill alike and for furniture inside of it. Pages without that element,
    and hosts of fewer pages, go by names: text lies in article or main elements if a page has them with text, else in
    all that is no furniture. Character references are decoded, white space inside a block becomes one space, blocks are
    trimmed and joined by two line ends. A null or empty page has the text ''. A null URL has the host '',
    which makes such pages one site. Repeated rows count as further pages of their host for its template's tokens, and
    as one page for its texts; tokens in the same mean place are ordered by key. An empty table gives an empty result.
    Other columns are not read, so their names don't matter.
    """
    narrow_batches(pages.sparkSession)
    host, _ = parts(F.col(url_col).cast("string"))
    pages = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    # written first: Spark then knows their size and sends them to the pages if they are few, else pages and templates meet
    # in a shuffle of their own, whose hot hosts are split
    scratch = Scratch(pages.sparkSession)
    known = scratch.cut(templates(pages))
    known = scratch.cut(known.join(slots_of(pages, known), "host", "left"))
    made = pages.join(known, "host", "left").select("id", "url", "html", "template", "fixed", "spine")
    return made.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op6_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
