"""Main text of web pages, by templates deduced from the pages of each host.

A page is a sequence of tag tokens (name and class, an end tag named after the start tag it closes) and text tokens (a text
between two block tags, with the names of the elements that hold it). Tokens of a host with the same occurrence vector - the
same count on every distinct page - form an equivalence class. A vector is compared by the sum over pages of a hash of
(page, count), so that it is aggregated like any sum and no host's pages have to meet. A class is valid if its tags keep one
order, repeated as a whole, on every page. Valid classes nest into the host's template: the elements they open and close. What
lies between is slots, each at its place: inside a template element. A text token is part of the template, and no content of a slot, if it is on every page of the host
or shares its class with tags of the template, and is on over half of the host's distinct pages, three at least. A slot is
main text if its content varies, an article or main element holds it, and no element around it is a menu, a form, an advert and
so on. Where a page has no such element the template names the holder: the innermost of its elements that stand once on
a page and hold MAIN_SHARE of the text of the host's pages. Where all text of the holder is template, all varying slots count. The text of
main slots is extracted in page order.

Hot hosts: vectors and orders are pre-aggregated in each task, and the pages of a host with more bytes than a partition's share
(there are fewer such hosts than partitions) meet their template under as many salts as it has such shares.

Defined cases: a null or empty html gives an empty text; a null url is a host of its own; a host with a single page
has a template of that page's tags; copies count as one page of a template; a host of fewer than three distinct pages has no text in its
template; equal rows give equal texts; unclosed and stray tags, comments, scripts and text of any
length are passed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import ship, slices, stage

#: A class of tags must occur on this share of its host's pages to belong to the template. It bounds a hot host's template; every article and
#: main element of a page counts, in the template or not.
SUPPORT = 0.1
#: A text must be on so many distinct pages, and on more than this share of them, to belong to the template.
TEXT_PAGES, TEXT_SHARE = 3, 0.5
#: What the holder of the main text has of the host's text, at least.
MAIN_SHARE = 0.7

#: Quoted values may hold ">". A tag, comment or element that is never closed goes on to the end of the page, so every
#: character is read a bounded number of times; nothing is tried again (possessive repeats).
_REST = r"(?:[^\"'>=]|=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|[=\"'])*+(?:>|\Z)"
TAG = re.compile(rf"<!--(?:[^-]++|-(?!->))*+(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_REST})", re.S)
OPAQUE = frozenset("script style noscript template textarea iframe svg object".split())
ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for name in OPAQUE}
CLASS = re.compile(r"(?<![\w\-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset(["article", "main"])
#: Elements that are no part of a text's place: they may be left open, or out.
FORMULA = frozenset("math semantics annotation mrow mi mo mn ms mtext mspace mfrac msqrt mroot msup msub msubsup mover munder munderover mtable mtr mtd mstyle mpadded mphantom".split())
LOOSE = INLINE | FORMULA | frozenset("html body p li dt dd thead tbody tfoot tr td th option".split())
#: Elements that can hold the main text of a page.
HOLDERS = frozenset("div section td center blockquote".split())
#: Elements, and names of a class, id or role, that are not main text.
ASIDE = frozenset("head title nav footer aside form button select option label menu dialog datalist fieldset".split())
#: Elements of these may be put around a whole page.
WRAPPERS = frozenset(["form", "fieldset"])
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay newsletter subscribe "
    "sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended comment comments reply replies respond discussion footer toolbar pagination pager login signup widget".split()
)


def label(name: str, attributes: str) -> str:
    """A start tag's token: its name and the words of its class, id (with a #) and role, digits left out."""
    found = CLASS.findall(attributes) if attributes else None
    if not found:
        return name
    held = ((kind.lower() == "id", re.sub(r"\d+", "", x.strip("\"'").lower())) for kind, x in found)
    return name + "." + " ".join("#" + x.strip() if is_id else x for is_id, x in held)


def is_aside(token: str, inside_main: bool) -> bool:
    """By element, or by a whole name of its class, role or - outside of main elements, where ids name sections - id."""
    name, _, words = token.partition(".")
    if name in ASIDE or name == "header" and not inside_main:
        return True
    if not words or name in MAIN or name in ("html", "body"):
        return False
    return any(x.strip("#-_") in ASIDE_WORDS for x in words.split() if not (inside_main and x[0] == "#"))


def asides(tags: list[tuple[int, int, str, str, int]]) -> set[int]:
    """Places of the start tags of asides. Where all main elements are in asides, names of classes and wrappers around them do not count."""
    found: set[int] = set()
    around: set[int] = set()  # what holds main elements
    stack: list[int] = []
    inside = off = 0  # open main elements and asides
    mains = free = 0  # outermost main elements, and those in no aside
    for k, (_, _, kind, token, ends) in enumerate(tags):
        if kind == "open":
            if token.partition(".")[0] in MAIN:
                if not inside:
                    mains += 1
                    free += not off
                    for x in reversed(stack):
                        if x in around:
                            break
                        around.add(x)
                inside += 1
                if is_aside(token, inside > 1):
                    found.add(k)
                    off += 1
            elif is_aside(token, inside > 0):
                found.add(k)
                off += 1
            stack.append(k)
        elif kind == "close" and ends:
            for x in stack[-ends:]:
                inside -= tags[x][3].partition(".")[0] in MAIN
                off -= x in found
            del stack[-ends:]
    if mains and not free:
        names = {k: tags[k][3].partition(".")[0] for k in around}
        found -= {k for k, name in names.items() if name not in ASIDE or name in WRAPPERS}
    return found


def walk(page: str) -> Iterator[tuple[int, int, str, str, int]]:
    """Start, end, kind ("open", "close", "void", "gone"), token and - for a close - number of elements it ends."""
    stack: list[str] = []
    open_now: Counter[str] = Counter()
    at = 0
    while m := TAG.search(page, at):
        start, at = m.span()
        name = m.group(2)
        if name is None:
            yield start, at, "gone", "", 0
            continue
        name = name.lower()
        rest = m.group(3)
        is_closed = rest.endswith("/>")
        if name in OPAQUE and not m.group(1) and not (name == "svg" and is_closed):
            end = ENDS[name].search(page, at)
            at = end.end() if end else len(page)
            yield start, at, "gone", "", 0
        elif m.group(1):
            if not open_now[name]:
                yield start, at, "close", name, 0
                continue
            depth = len(stack) - 1
            while stack[depth].partition(".")[0] != name:  # all of these end here
                depth -= 1
            token, ends = stack[depth], len(stack) - depth
            for x in stack[depth:]:
                open_now[x.partition(".")[0]] -= 1
            del stack[depth:]
            yield start, at, "close", token, ends
        elif name in VOID or is_closed:
            yield start, at, "void", name, 0
        else:
            token = label(name, rest)
            stack.append(token)
            open_now[name] += 1
            yield start, at, "open", token, 0


def scan(page: str, holder: str = "") -> Iterator[tuple[str, str, str, bool]]:
    """Kind ("open", "close", "text"), token, text (of a tag: "aside" in one) and whether a main element - or, if given, an element
    of the token holder - holds it. Texts of asides are left out. A text's token is a hash of its place and itself."""
    stack: list[tuple[bytes, int, int]] = []  # hash of the place; asides and main elements around what follows
    held: list[str] = []
    where: tuple[bytes, bool] = (b"", False)
    at = aside = main = 0

    def block() -> Iterator[tuple[str, str, str, bool]]:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            own = blake2b(where[0] + b" " + text.encode("utf-8", "replace"), digest_size=8).hexdigest()
            yield "text", "=" + own, text, where[1]

    tags = list(walk(page))
    off = asides(tags)
    place = b""
    for k, (start, end, kind, token, ends) in enumerate([*tags, (len(page), len(page), "end", "", 0)]):
        if start > at and not aside:
            if not held:
                where = place, main > 0
            held.append(entities.unescape(page[at:start]))
        at = end
        name = token.partition(".")[0]
        if name in FORMULA:
            if held:
                held.append(" ")
        elif kind != "gone" and name not in INLINE:
            yield from block()
        if kind == "open":
            stack.append((place, aside, main))
            if name not in LOOSE:
                place = blake2b(place + name.encode("utf-8", "replace"), digest_size=8).digest()
            aside += k in off
            main += token == holder if holder else name in MAIN
        elif kind == "close" and ends:
            place, aside, main = stack[-ends]
            del stack[-ends:]
        if kind in ("open", "close"):
            yield kind, token, "aside" if aside else "", False


def page_tokens(page: str) -> list[str]:
    """Tags and texts in page order, then for each holder (a token) that stands once on the page the characters in it, as
    #token, a tab and the number; # alone is the page."""
    out, total = [], 0
    count: Counter[str] = Counter()
    begun: dict[str, int] = {}
    held: dict[str, int] = {}
    for kind, token, text, _ in scan(page):
        out.append(("/" if kind == "close" else "") + token)
        if kind == "text":
            total += len(text)
        elif token.partition(".")[0] in HOLDERS:
            if kind == "open":
                count[token] += 1
                begun[token] = total
            elif token in begun:
                held[token] = total - begun[token]
    return [*out, *(f"#{t}\t{n}" for t, n in held.items() if count[t] == 1), f"#\t{total}"]


def choose_holder(slots: list[dict], tags: set[str]) -> str:
    """The template element with the least text of those that hold MAIN_SHARE of it and are on over half of the pages; none: ""."""
    total = next((x["chars"] for x in slots if x["t"] == ""), 0)
    found = [x for x in slots if x["t"] in tags and x["chars"] >= MAIN_SHARE * total and 2 * x["pages"] > x["of"]]
    return min(found, key=lambda x: (x["chars"], x["t"]))["t"] if found and total else ""


def extract(page: str, template: set[str], holder: str = "") -> str:
    """Text of the main slots of a page. template: tokens of its host's valid classes and the texts of its template; holder: the
    token of the element that holds the main text where there is no article or main element."""
    items = list(scan(page))
    texts = [(token, text, inside) for kind, token, text, inside in items if kind == "text"]
    has_main = any(kind == "open" and not text and token.partition(".")[0] in MAIN for kind, token, text, _ in items)
    if holder and not has_main:
        texts = [(token, text, inside) for kind, token, text, inside in scan(page, holder) if kind == "text"]
        has_main = any(x[2] for x in texts)
    inside = [x for x in texts if x[2]] if has_main else texts
    varying = [text for token, text, _ in inside if token not in template]
    if inside and not varying:  # the article is part of the template: the page's own text is elsewhere
        varying = [text for token, text, _ in texts if token not in template]
    return " ".join(varying)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html"):
        held = ["\n".join(page_tokens(x or "")) for x in b.column("html").to_pylist()]
        yield pa.record_batch([b.column("host"), pa.array(held, pa.string())], names=["host", "tokens"])


def _mix(x: int) -> int:
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 33)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, token, pages, total and sig, summed up in the task."""
    held: dict[tuple[str, str], list[int]] = {}

    def flush() -> pa.RecordBatch:
        # the signature is handed on in two halves whose sums cannot overflow a long
        rows = [(h, t, p, n, s & 0xFFFFFFFF, s >> 32) for (h, t), (p, n, s) in held.items()]
        held.clear()
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "token", "pages", "total", "low", "high"])

    for b in batches:
        for host, page, tokens in zip(b.column("host").to_pylist(), b.column("page").to_pylist(), b.column("tokens").to_pylist(), strict=True):
            for token, n in Counter(tokens.split("\n")).items() if tokens else ():
                if token[:1] == "#":  # characters in an element
                    token, _, n = token.partition("\t")
                    n = int(n)
                x = held.setdefault((host, token), [0, 0, 0])
                x[0] += 1
                x[1] += n
                x[2] = (x[2] + _mix((page & 0xFFFFFFFFFFFFFFFF) ^ _mix(n))) & 0xFFFFFFFFFFFFFFFF
        if len(held) > 200_000:
            yield flush()
    if held:
        yield flush()


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, class number and the order its tokens keep on a page ("": none), each once a task."""
    seen: set[tuple[str, int, str]] = set()
    for b in batches:
        for host, tokens, classes in zip(b.column("host").to_pylist(), b.column("tokens").to_pylist(), b.column("classes").to_pylist(), strict=True):
            own = json.loads(classes)
            number = {t: k for k, c in enumerate(own) for t in c}
            found: list[list[str]] = [[] for _ in own]
            for t in tokens.split("\n"):
                if t in number:
                    found[number[t]].append(t)
            for k, s in enumerate(found):
                if s:
                    n = len(own[k])
                    order = "\n".join(s[:n]) if len(set(s[:n])) == n and s == s[:n] * (len(s) // n) else ""
                    seen.add((host, k, order))
        if len(seen) > 100_000:
            yield _order_rows(seen)
            seen = set()
    if seen:
        yield _order_rows(seen)


def _order_rows(seen: set[tuple[str, int, str]]) -> pa.RecordBatch:
    rows = sorted(seen)
    kinds = [pa.string(), pa.int32(), pa.string()]
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "class", "order"])


def hot_hosts(pages: DataFrame) -> DataFrame:
    """Hosts with more bytes of html than a partition's share, so no more of them than partitions, and their salts: as many as
    make a host's pages under one salt such a share."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = pages.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 100).alias("bytes"))
    total = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 100)).first()[0] or 0
    share = max(1, total // parts)
    return stage(sizes.where(F.col("bytes") > share).select("host", F.ceil(F.col("bytes") / share).cast("int").alias("salts")), "hot")


def _salted(pages: DataFrame, hot: DataFrame) -> DataFrame:
    """pages with a salt each."""
    out = pages.join(F.broadcast(hot), "host", "left")
    return out.withColumn("salt", F.coalesce(F.pmod("page", "salts").cast("int"), F.lit(0))).drop("salts")


def _under_all(hosts: DataFrame, hot: DataFrame) -> DataFrame:
    """A host's row under each of its salts."""
    out = hosts.join(F.broadcast(hot), "host", "left")
    return out.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def templates(pages: DataFrame, hot: DataFrame) -> DataFrame:
    """host, template (a JSON list of its valid classes' tags, each in its order) and texts (a JSON list of texts t that are on over half
    of its pages, each with a tag of its class; none: on every page), and slots (a JSON list of the characters chars in each element t that
    stands once on a page, over so many pages of the host's). pages: host, page (a long), html."""
    read = pages.select("host", "html").mapInArrow(_sequences, "host string, tokens string").where("tokens <> ''")
    tokens = stage(read.distinct().withColumn("page", F.xxhash64("tokens")), "tags")
    vectors = tokens.mapInArrow(_vectors, "host string, token string, pages long, total long, low long, high long")
    vectors = vectors.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "total", "low", "high")])
    vectors = stage(vectors.where(~F.col("token").startswith("=") | (F.col("pages") >= TEXT_PAGES)), "vectors")
    sizes = tokens.groupBy("host").agg(F.count("*").alias("of"))
    volumes = vectors.where(F.col("token").startswith("#")).select("host", F.expr("substring(token, 2)").alias("t"), F.col("total").alias("chars"), "pages")
    slots = volumes.join(sizes, "host").groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct("t", "chars", "pages", "of")))).alias("slots"))
    vectors = vectors.where(~F.col("token").startswith("#"))
    # sums of halves, joined again modulo 2**64 by their own remainders
    sig = F.pmod(F.col("high") + F.shiftrightunsigned("low", 32), F.lit(1 << 32)) * (1 << 20) + F.pmod("low", F.lit(1 << 20))
    classes = vectors.groupBy("host", "pages", "total", sig.alias("sig")).agg(F.sort_array(F.collect_list("token")).alias("class"))
    is_text = lambda x: x.startswith("=")
    classes = classes.withColumn("of_text", F.filter("class", is_text)).withColumn("class", F.filter("class", lambda x: ~is_text(x)))
    classes = stage(classes.join(sizes, "host"), "classes")
    listed = classes.where((F.col("pages") >= F.col("of") * SUPPORT) & (F.size("class") > 0))
    listed = listed.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list("class"))).alias("classes"))

    tag = F.when(F.col("pages") < F.col("of"), F.get("class", F.lit(0)))
    texts = classes.where((F.col("pages") > F.col("of") * TEXT_SHARE) & ((F.size("class") > 0) | (F.col("pages") == F.col("of"))))
    texts = texts.select("host", tag.alias("tag"), F.explode("of_text").alias("t"))
    texts = texts.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct("t", "tag")))).alias("texts"))

    orders = _salted(tokens, hot).join(_under_all(listed, hot), ["host", "salt"]).select("host", "tokens", "classes").mapInArrow(_orders, "host string, class int, order string")
    valid = orders.groupBy("host", "class").agg(F.min("order").alias("least"), F.max("order").alias("most")).where("least = most and least <> ''")
    valid = valid.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.split("least", "\n")))).alias("template"))
    return valid.join(texts, "host", "full").join(slots, "host", "left")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str | None, ...], tuple[set[str], str]] = {}
    for b in slices(batches, "html"):
        out = []
        for page, *key in zip(*(b.column(c).to_pylist() for c in ("html", "template", "texts", "slots")), strict=True):
            own = known.get(tuple(key))
            if own is None:
                if len(known) > 1000:
                    known.clear()
                tags = {t for c in json.loads(key[0] or "[]") for t in c}
                holder = choose_holder(json.loads(key[2] or "[]"), tags)
                own = tags | {x["t"] for x in json.loads(key[1] or "[]") if x.get("tag") is None or x["tag"] in tags}, holder
                known[tuple(key)] = own
            out.append(extract(page or "", *own))
        yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page of pages(page_id, url, html)."""
    ship(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))
    src = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("page"))
    hot = hot_hosts(src)
    found = templates(src, hot)
    joined = _salted(src, hot).join(_under_all(found, hot), ["host", "salt"], "left").select("page_id", "url", "html", "template", "texts", "slots")
    schema = joined.select("page_id", "url").withColumn("text", F.lit("")).schema
    return joined.mapInArrow(_extract, schema)
