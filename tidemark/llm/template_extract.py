"""Main text of web pages by template deduction from equivalence classes.

A page is read as tokens: its block elements, each named by its path, and its text blocks, named by path
and text. Tokens of one host that occur equally often on the same pages have the same occurrence vector and
form an equivalence class. Classes of several tokens on nearly all pages of the host are valid; they nest by
their paths into the host's template. What a template's elements hold beside its own fixed text are its
slots. The element whose slots hold most of the host's text is the main one (a marked article or main
element, if the template has one that holds a good part), and a page's text is what its slots hold there,
without navigation, adverts, forms and the like.

Hosts with few pages, and pages without the main element of their host, are read by their markup alone.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, need

#: Pages that a host must have before it gets a template, the share of them that a valid class is on, and its least tokens.
LEAST_PAGES, SHARE, LEAST_TOKENS = 5, 0.9, 2
#: Share of a host's slot text that its main element holds; a marked one needs less.
MOST_TEXT, MARKED_TEXT = 0.6, 0.25
#: Templates up to this size go to every task; larger ones are joined by host.
BROADCAST_BYTES = 32 << 20

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = {n: re.compile(rf"</{n}\b[^>]*>|\Z", re.I) for n in ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "xmp")}
# Names of HTML elements and of the parts of pages that are not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
SKIP = frozenset("nav footer aside form button select option dialog menu head audio video canvas map datalist".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar comment comments reply replies respond disqus related recommended share sharing social pagination pager copyright".split())
#: Of WORDS, those that as a part of a name tell what an element is only outside main text.
PLAIN = frozenset("ad ads sponsor promo promotion banner notice notices notification alert overlay subscribe subscription signup login comment comments reply replies respond related recommended share sharing social menu widget copyright".split())
#: What may stand beside one of WORDS in a name without making it another thing: related-posts, but not related-work.
BESIDE = frozenset("a ads all area article articles author bar block body bottom box btn button buttons card center col column container content cta desktop entry fixed form global group head header holder icon icons in inline inner item items layer layout left link links list lower main message mid mobile module nav of page panel placeholder popup post posts primary right root row secondary section sidebar site slot small social stack sticky stories story strip text thread title to tools top unit upper view widget wide with wrap wrapper zone".split())
HEADS = frozenset(("header", "topbar", "head"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN = frozenset("content main post entry story article body maincontent postcontent entrycontent articlebody".split())
#: Class names that begin or end so tell a state (has-sidebar, comments-open), not what the element is.
_STATE = re.compile(r"(?:has|have|no|not|with|without|is)-.*|.*-(?:open|opened|closed|enabled|disabled|on|off)")
_CONTAINERS = frozenset("div section td main article body".split())
#: Elements that, without a class or id, are told apart by their place among their like.
_NUMBERED = frozenset("div section td table".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Page:
    """Block elements (key of the path, index of the parent, rank of its own mark) and text blocks in page order.

    A rank is 3 for an article, 2 for main, 1 for a container named like main text, 0 elsewhere.
    """

    keys: list[int] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)
    #: (element, rank of the region, text, skipped, in a heading, characters in links); skipped is 2 where an element is
    #: no main text by its kind or a whole name, 1 where only a part of a name says so, which no template's main element heeds
    blocks: list[tuple[int, int, str, int, bool, int]] = field(default_factory=list)


def _named(name: str, words: frozenset[str]) -> bool:
    """Whether a class name as a whole is one of ``words``, alone or with what may stand beside it."""
    parts = [p for p in name.split("-") if p and not p.isdigit()]
    return not words.isdisjoint(parts) and all(p in words or p in BESIDE for p in parts)


def _skips(names: list[str], wrapper: bool, inside: bool) -> int:
    """How far the class names and id of an element say that it is no main text. What wraps main text is judged by plain names only, what is inside it by whole ones."""
    if wrapper:
        return 2 * (not WORDS.isdisjoint(names) or not inside and not HEADS.isdisjoint(names))
    names = [n for n in names if not _STATE.fullmatch(n)]
    if any(_named(n, WORDS) for n in names) or not inside and any(_named(n, HEADS) for n in names):
        return 2
    parts = {p for n in names for p in n.split("-")}
    return int(not inside and not parts.isdisjoint((WORDS - PLAIN) | HEADS))


def read(page: str) -> Page:
    """The elements and text blocks of a page, in one pass over its tags."""
    out = Page()
    stack: list[tuple[str, int, int, int, bool]] = []  # name, skipped, rank, element, in a heading
    text: list[str] = []
    opened: dict[str, int] = {}
    numbers: dict[tuple[int, str], int] = {}
    skipped, rank, at_node, heading, links, linked = 0, 0, -1, False, 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if said:
                out.blocks.append((at_node, rank, said, skipped, heading, min(linked, len(said))))
        linked = 0

    def back_to(k: int) -> None:
        nonlocal skipped, rank, at_node, heading
        for closed in stack[k:]:
            opened[closed[0]] -= 1
        del stack[k:]
        _, skipped, rank, at_node, heading = stack[-1] if stack else ("", 0, 0, -1, False)

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None or m.start() > at:
            said = page[at:] if m is None else page[at : m.start()]
            text.append(said)
            if links:
                linked += len(said)
            if m is None:
                break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            text.append(entities.unescape(m[0][9:].removesuffix("]]>")).replace("&", "&amp;"))
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name == "a":
            links = 0 if m[1] or m[4] else 1
        if m[1] or m[4]:
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1 if opened.get(name) else -1, -1, -1):
                if stack[k][0] == name:
                    back_to(k)
                    break
            continue
        if name in _RAW:
            if not (m[3] or m[6] or "").endswith("/"):
                at = _RAW[name].search(page, at).end()
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            text.append(" ")
        if name in VOID:
            continue
        if name == "p" and stack:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    back_to(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        attributes = m[3] or m[6] or ""
        names: list[str] = []
        bad, mark = 2 * (name in SKIP or name == "header" and rank < 2), 0
        if attributes:
            for a, v in _ATTR.findall(attributes):
                a, v = a.lower(), v.strip("\"'").lower()
                if a in ("class", "id"):
                    names += re.split(r"[\s_]+", v)
                elif a == "role":
                    bad = 2 if v in ROLES else bad
                    mark = max(mark, {"main": 2, "article": 3}.get(v, 0))
                elif a == "hidden" or a == "aria-hidden" and v == "true" or a == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v):
                    bad = 2
        if names:
            parts = {p for n in names for p in n.split("-")}
            wrapper = name in ("article", "main") or bool({n.replace("-", "") for n in names} & MAIN)
            if name not in ("body", "html"):
                bad = max(bad, _skips(names, wrapper, max(rank, mark) >= 2))
            if not bad and name in _CONTAINERS and (parts & MAIN or {n.replace("-", "") for n in names} & MAIN):
                mark = max(mark, 1)
        mark = 3 if name == "article" else max(mark, 2) if name == "main" else mark
        rank = max(rank, mark)
        skipped = max(skipped, bad)
        if name in BLOCK or name in _CONTAINERS:
            label = name + "".join(f".{n}" for n in sorted(set(names)) if n and not re.search(r"\d", n)) if names else name
            if label == name and name in _NUMBERED:
                k = numbers[at_node, name] = numbers.get((at_node, name), 0) + 1
                label = f"{name}#{k}"
            out.keys.append(_key(str(out.keys[at_node]) if at_node >= 0 else "", label))
            out.parents.append(at_node)
            out.marks.append(mark)
            at_node = len(out.keys) - 1
            heading = heading or name in _HEADINGS
        stack.append((name, skipped, rank, at_node, heading))
        opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def blocks(page: str) -> list[tuple[int, int, str, int, bool, int]]:
    """The text blocks of a page."""
    return read(page).blocks


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _key(*parts: str) -> int:
    h = xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


_TOKEN = "host long, token long, parent long, is_text boolean, pages long, total long, sig long, chars long, links long, heads long, mark long"


def page_tokens(page: str | None) -> dict[tuple[int, bool], list[int]]:
    """Per token of a page, an element's or a text's: [parent, how often, characters, of them in links, in headings, mark].

    Characters are those of text that is not skipped, an element's with all that it contains.
    """
    p = read(page or "")
    own = [[0, 0, 0] for _ in p.keys]
    found: dict[tuple[int, bool], list[int]] = {}

    def add(key: int, is_text: bool, parent: int, sizes: list[int], mark: int) -> None:
        e = found.setdefault((key, is_text), [parent, 0, 0, 0, 0, mark])
        e[1] += 1
        for k in range(3):
            e[2 + k] += sizes[k]

    for node, _, said, skipped, heading, linked in p.blocks:
        sizes = [0, 0, 0] if skipped else [len(said), linked, len(said) if heading else 0]
        add(_key("text", str(p.keys[node]) if node >= 0 else "", said), True, p.keys[node] if node >= 0 else 0, sizes, 0)
        if node >= 0:
            own[node] = [x + y for x, y in zip(own[node], sizes)]
    for node in range(len(own) - 1, -1, -1):
        up = p.parents[node]
        if up >= 0:
            own[up] = [x + y for x, y in zip(own[up], own[node])]
        add(p.keys[node], False, p.keys[up] if up >= 0 else 0, own[node], p.marks[node])
    return found


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens added up per batch and host, with the batch's part of the signature of their occurrence vectors."""
    names = [f.split()[0] for f in _TOKEN.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            rows: dict[tuple[int, int, bool], list[int]] = {}
            for url, page in zip(*(batch.column(i).slice(at, 1024).to_pylist() for i in (1, 2))):
                host, print_ = _key(host_of(url)), str(_key(page or ""))
                for (token, is_text), (parent, n, chars, links, heads, mark) in [*page_tokens(page).items(), ((0, False), (0, 1, 0, 0, 0, 0))]:
                    e = rows.setdefault((host, token, is_text), [parent, 0, 0, 0, 0, 0, 0, mark])
                    e[3] ^= _key(print_, str(n))
                    for k, v in ((1, 1), (2, n), (4, chars), (5, links), (6, heads)):
                        e[k] += v
            keys, values = list(rows), list(rows.values())
            columns = [[k[0] for k in keys], [k[1] for k in keys], [v[0] for v in values], [k[2] for k in keys], *([v[i] for v in values] for i in range(1, 8))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "is_text" else pa.int64()) for n, c in zip(names, columns)], names)


def distinct_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with one row for each html of a host; its copies are left out by their narrow keys."""
    prints = pages.select("page_id", "url", F.xxhash64("html").alias("copy")).mapInArrow(_host_prints, "page_id long, host long, copy long")
    prints = materialize(prints, "page-prints")
    first = prints.groupBy("host", "copy").agg(F.min("page_id").alias("first_id"))
    others = prints.join(first, ["host", "copy"]).where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select("page_id", "copy").distinct()
    others = materialize(others, "page-copies").select(F.col("page_id").alias("other_id"), "copy")
    return pages.join(others, F.col("page_id").eqNullSafe(F.col("other_id")) & (F.xxhash64("html") == F.col("copy")), "left_anti")


def deduce_classes(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """``(page_id, url, html)`` -> equivalence classes ``(host, host_pages, pages, sig, tokens, valid)`` of what most pages have.

    Tokens of a host with the same occurrence vector (which pages, how often on each) are one class; it is valid
    with ``least_tokens`` tokens or more on a ``share`` of the host's pages or more. Vectors are told apart by
    64-bit signatures, added up where the pages are. Hosts with fewer than ``least_pages`` pages have no classes.
    All valid classes of a host hold no more tokens than its mean page, divided by ``share``.
    """
    rows = distinct_pages(need(pages, "page_id", "url", "html")).mapInArrow(_tokens, _TOKEN)
    t = rows.groupBy("host", "token", "is_text").agg(
        *[F.sum(c).alias(c) for c in ("pages", "total", "chars", "links", "heads")], F.bit_xor("sig").alias("sig"), F.min("parent").alias("parent"), F.max("mark").alias("mark"))
    t = materialize(t.where(f"pages >= {least_pages}"), "page-tokens")
    hosts = t.where("token = 0").select("host", F.col("pages").alias("host_pages"))
    t = t.where("token <> 0").join(hosts, "host").where(F.col("pages") >= F.ceil(F.col("host_pages") * share))
    token = F.struct("token", "parent", "is_text", "total", "chars", "links", "heads", "mark")
    classes = t.groupBy("host", "host_pages", "pages", "sig").agg(F.collect_list(token).alias("tokens"))
    return classes.withColumn("valid", F.size("tokens") >= least_tokens)


def main_element(classes: list[dict]) -> tuple[int | None, bool, list[int]]:
    """(main element, whether its own markup or that around it says so, fixed texts) of one host's classes.

    Valid classes nest by the paths of their elements, of which those in smaller classes are only links. Candidates
    are elements of valid classes that every page of their class has once. Text that the template fixes is no slot's
    and doesn't count, nor does text in links.
    """
    nodes = {t["token"]: {**t, "once": c["valid"] and t["total"] == c["pages"], "slots": t["chars"] - t["links"], "inside": False} for c in classes for t in c["tokens"] if not t["is_text"]}
    fixed = [t for c in classes if c["valid"] for t in c["tokens"] if t["is_text"]]
    below: dict[int, list[int]] = {}
    for t, n in nodes.items():
        below.setdefault(n["parent"], []).append(t)
    nested = sorted(below.get(0, ()))  # elements before what they contain
    for t in nested:
        nested += sorted(below.get(t, ()))
    place = {t: k for k, t in enumerate(nested)}
    for f in fixed:
        if f["parent"] in place:
            nodes[f["parent"]].setdefault("fixed", []).append(f)
    held = {t: sum(f["chars"] - f["links"] for f in nodes[t].get("fixed", ())) for t in nested}
    for t in reversed(nested):
        nodes[t]["slots"] -= held[t]
        if nodes[t]["parent"]:
            held[nodes[t]["parent"]] += held[t]
    once = [t for t in nested if nodes[t]["once"]]
    whole = max((nodes[t]["slots"] for t in once), default=0)
    if whole <= 0:
        return None, False, []
    marked = [t for t in once if nodes[t]["mark"] >= 2 and nodes[t]["slots"] >= MARKED_TEXT * whole]
    if marked:
        main = max(marked, key=lambda t: (nodes[t]["mark"], nodes[t]["slots"], -place[t]))
    else:
        main = max((t for t in once if nodes[t]["slots"] >= MOST_TEXT * whole), key=place.get)  # these contain each other
        plain = lambda t: nodes[t]["chars"] - nodes[t]["heads"]
        while (up := nodes[main]["parent"]) and nodes[up]["once"] and plain(up) <= 1.02 * plain(main):
            main = up  # headings right above belong to the text
    said, up = False, main
    while up:
        said, up = said or nodes[up]["mark"] > 0, nodes[up]["parent"]
    inside = []
    for t in nested[place[main] :]:
        nodes[t]["inside"] = t == main or nodes[t]["parent"] in nodes and nodes[nodes[t]["parent"]]["inside"]
        if nodes[t]["inside"]:
            inside += [f["token"] for f in nodes[t].get("fixed", ())]
    return main, said, sorted(inside)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found = [main_element(c) for c in part.column(1).to_pylist()]
            # what near copies of a marked article share is their text, not their template's
            fixed = pa.array([[] if said else f for _, said, f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m for m, _, _ in found], pa.int64()), fixed], ["host", "main", "fixed"])


def deduce_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """``(page_id, url, html)`` -> per host ``(host, main, fixed)``: its main element, and texts inside it that are no slot's.

    A host's classes are gathered in one row, which is bounded by page size, however many pages the host has.
    """
    classes = deduce_classes(pages, least_pages, share)
    hosts = classes.groupBy("host").agg(F.collect_list(F.struct("pages", "tokens", "valid")).alias("classes"))
    return hosts.mapInArrow(_choose, "host long, main long, fixed array<long>").where("main IS NOT NULL")


def main_text(page: str | None, fixed: frozenset[int] | set[int] = frozenset(), main: int | None = None) -> str:
    """The slots of the element ``main`` without ``fixed`` texts; where the page has no such text, what its markup says."""
    p = read(page or "")
    if main is not None:
        inside = []
        for key, up in zip(p.keys, p.parents):
            inside.append(key == main or up >= 0 and inside[up])
        held = [(node, said) for node, _, said, skipped, _, _ in p.blocks if node >= 0 and inside[node] and skipped < 2]
        own = [said for node, said in held if not fixed or _key("text", str(p.keys[node]), said) not in fixed] or [said for _, said in held]
        if own:
            return "\n\n".join(own)
    top = max((r for _, r, _, skipped, _, _ in p.blocks if not skipped), default=0)
    return "\n\n".join(said for _, r, said, skipped, _, _ in p.blocks if r == top and not skipped)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), 256):
            part = batch.slice(at, 256)
            page, main, fixed = (part.column(i).to_pylist() for i in (2, 3, 4))
            said = [main_text(p, set(f or ()), m) for p, m, f in zip(page, main, fixed)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([s.encode("utf-8", "replace") for s in said], pa.binary()).cast(pa.string()), pa.array([len(s) for s in said], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html)`` -> ``(page_id, url, text, n_chars)``, one row per page.

    Blocks in page order, joined by an empty line; character references decoded; white space inside a block
    is one space. Null and empty pages have an empty text; pages whose url has no host form one host.
    Repeated rows are returned as often as given. Templates are broadcast up to BROADCAST_BYTES, else joined by host.
    """
    templates = materialize(deduce_templates(pages), "templates")
    size = templates.agg(F.coalesce(F.sum(F.size("fixed") * 8 + 64), F.lit(0))).first()[0]
    p = need(pages, "page_id", "url", "html").mapInArrow(_with_host, "page_id long, url string, html string, host long")
    joined = p.join(F.broadcast(templates) if size <= BROADCAST_BYTES else templates, "host", "left")
    return joined.select("page_id", "url", "html", "main", "fixed").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def _with_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = pa.array([_key(host_of(u)) for u in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, hosts], ["page_id", "url", "html", "host"])


def _host_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = pa.array([_key(host_of(u)) for u in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), hosts, batch.column(2)], ["page_id", "host", "copy"])
