"""Main text of pages, by differencing each page with its nearest neighbour.

Pages of a host share menus, footers and notices. Pages of a host are put in order of their
URL path, and each is paired with the one before or after it that shares the longest beginning
of the path. The lines of text of a pair are aligned by their longest common subsequence, and
lines that both share go.

Before that, markup is read once into lines, one for each block: furniture, body text, or free.
Furniture is what stands in elements that never hold an article (menus, headers, footers, asides,
forms, and blocks named as adverts, notices, sidebars or comments) and, if a page marks an article
(or a main part), all that lies outside it. Headings and paragraphs of a marked article are body
text. Scripts and styles are no lines. Furniture and free lines of every page are differenced.
Markup has the last word where it is plain: body text stays even where another page repeats it,
for articles quote each other, and furniture goes even where no page near by has it.

Lines travel as 128-bit hashes to be ordered by range of host and path, so a large
host lies in many partitions, with the border pages handed over between neighbours. Pages of body text
alone are nobody's neighbour. Pages of a host with the same lines but for furniture are one page there, at the least of
their paths, so repeated pages keep their text. Pages are read twice, which costs less than keeping what was read.

Defined results: NULL or empty html gives an empty text; NULL and malformed URLs share one
host; a page alone in its host is compared with nothing; an empty table gives an empty result;
a script or style without its end goes on to the end of the page, other such elements
without an end, or closed in their own tag, hold nothing; a page cut inside a tag ends before
it; where quotes never close, tags end at the next ``>``. Columns other than the id, the URL
and the html are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.arrow import map_batches
from plenum.operators.skew import grouped_for_join
from plenum.session import materialize

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
BODY = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes svg math object".split())
NEVER = frozenset("head nav footer aside form menu button select dialog".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|"
    r"side-?bar|menu|nav|navbar|navigation|bread-?crumbs?|footer|header|masthead|comments?|comment-\w+|respond|replies|"
    r"disqus|share|sharing|social[_-](?:bar|buttons?|icons?|links?|media)|related|recommend\w*|popup|modal|widget|toolbar|pagination|pager|login|signup|search|"
    r"complementary|contentinfo|skip-?link)(?:$|[\s_-])",
    re.I,
)
OPENING = re.compile(r"<(?:!--|[!?]|/?([a-zA-Z][\w:-]*))")
STOP = re.compile(r"[>\"']")
UNQUOTED_END = re.compile(r"=\s*[^\s\"']+$")
NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WITHOUT = re.compile(r"(?:has|no|non|with|without)[_-]", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def next_tag(page: str, at: int, quotes: bool) -> tuple[int, int, str, bool, str, bool] | None:
    """(start, end, name, whether it ends an element, attributes, whether quotes still close)
    of the first tag from a place on; the name of a comment or declaration is empty."""
    found = OPENING.search(page, at)
    if not found:
        return None
    start, name = found.start(), (found[1] or "").lower()
    if found[0] == "<!--":
        end = page.find("-->", found.end())
        return start, end + 3 if end >= 0 else len(page), "", False, "", quotes
    end = _tag_end(page, found.end()) if name and quotes else page.find(">", found.end())
    if end < 0 and name and quotes:
        quotes, end = False, page.find(">", found.end())
    if end < 0:  # no tag ends any more
        return None
    return start, end + 1, name, found[0].startswith("</"), page[found.end() : end] if name else "", quotes


def _tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends a tag, outside the quotes of its values; -1 without one."""
    while stop := STOP.search(page, at):
        at = stop.end()
        if stop[0] == ">":
            return stop.start()
        before = stop.start() - 1
        while page[before].isspace():
            before -= 1
        if page[before] == "=":
            at = page.find(stop[0], at) + 1
            if not at:
                return -1
    return -1


FURNITURE, FREE, BODY_TEXT = range(3)


def lines(page: str) -> list[tuple[str, bool]]:
    """(text, whether it is body text) of each block that may hold the article."""
    return [(t, kind == BODY_TEXT) for t, kind in all_lines(page) if kind != FURNITURE]


def all_lines(page: str) -> list[tuple[str, int]]:
    """(text, kind) of each block."""
    found: list[tuple[str, bool, bool, bool, bool]] = []
    held: list[str] = []
    left: list[str] = []  # what stands in an element left out
    skip, depth = "", 0  # the element being left out, and how deep in its own kind
    inner = outer = 0  # open articles, open main parts
    body = False
    at, quotes = 0, True
    endless: set[str] = set()  # elements of raw text whose end does not come any more

    def close():
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            found.append((text, inner > 0, outer > 0, body, False))

    def close_left():
        text = " ".join(entities.unescape("".join(left)).split())
        left.clear()
        if text:
            found.append((text, False, False, False, True))

    while tag := next_tag(page, at, quotes):
        start, end, name, ending, attributes, quotes = tag
        (left if skip else held).append(page[at:start])
        at = end
        if not name:
            continue
        if left and (not skip or name in BLOCKS):
            close_left()
        if name in RAW and not ending:
            if _closes_itself(attributes):
                continue
            last = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if last:
                at = last.end()
            elif name in ("script", "style"):
                at = len(page)
            else:
                endless.add(name)
            continue
        if skip == "p" and name in BLOCKS:  # a paragraph ends where another block begins or ends
            skip, depth = "", 0
            if name == "p" and ending:
                continue
        if skip and not (name in ("article", "main") or name == "body"):
            if name == skip and name not in VOID:
                depth += -1 if ending else 1
                skip = skip if depth else ""
            continue
        if skip:
            if ending or _left_out(name, attributes, inner):
                continue
            skip, depth = "", 0  # an element that was never closed
        if name not in BLOCKS:
            if name == "br":
                held.append(" ")
            elif not ending and name not in VOID and name != "a" and _left_out(name, attributes, inner):
                skip, depth = name, 1
            continue
        close()
        if ending:
            inner -= name == "article" and inner > 0
            outer -= name == "main" and outer > 0
            body = False
            continue
        if name not in VOID and _left_out(name, attributes, inner):
            skip, depth = name, 1
            continue
        inner += name == "article"
        outer += name == "main"
        body = name in BODY
    (left if skip else held).append(_without_open_tag(page[at:]))
    close()
    close_left()
    place = 1 if any(f[1] for f in found) else 2 if any(f[2] for f in found) else None
    if place is None:
        return [(f[0], FURNITURE if f[4] else FREE) for f in found]
    return [(f[0], FURNITURE if not f[place] else BODY_TEXT if f[3] else FREE) for f in found]


def _closes_itself(attributes: str) -> bool:
    kept = attributes.rstrip()
    return kept.endswith("/") and not UNQUOTED_END.search(kept[kept.rfind("=") :] if "=" in kept else "")


def _without_open_tag(text: str) -> str:
    """The end of a page that was cut inside a tag."""
    text = text.partition("<!--")[0]
    cut = text.rfind("<")
    return text[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!]", text[cut:]) else text


def _left_out(name: str, attributes: str, inner: int) -> bool:
    if name in NEVER or name == "header" and not inner:
        return True
    if not attributes or name in ("html", "body"):
        return False
    if HIDDEN.search(attributes):
        return True
    if name in ("article", "main"):
        return any("comment" in v.lower() for m in NAMES.findall(attributes) for v in m)
    return any(
        NAMED.search(word) and not WITHOUT.match(word)
        for values in NAMES.findall(attributes) for value in values for word in value.split()
    )


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``. Lengths are kept as the bits
    of one number, a bit for each line of ``b``; halves of ``a`` meet where their lengths sum
    to the most, so memory stays linear in the lines."""
    other, own = set(b), set(a)
    where = [i for i, line in enumerate(a) if line in other]
    left, right = [a[i] for i in where], [line for line in b if line in own]
    head = shared_beginning(left, right)
    tail = min(shared_beginning(left[::-1], right[::-1]), min(len(left), len(right)) - head)
    kept = [*range(head), *range(len(left) - tail, len(left))]
    todo = [(head, len(left) - tail, head, len(right) - tail)]
    while todo:
        i, j, k, m = todo.pop()
        if i == j or k == m:
            continue
        if j - i == 1:
            kept += [i] if left[i] in right[k:m] else []
            continue
        middle = (i + j) // 2
        ahead = _lengths(left[i:middle], right[k:m])
        behind = _lengths(left[middle:j][::-1], right[k:m][::-1])[::-1]
        cut = k + int(np.argmax(ahead + behind))
        todo += [(i, middle, k, cut), (middle, j, cut, m)]
    return {where[i] for i in kept}


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each beginning of ``b``."""
    n, wanted = len(b), set(a)
    places = defaultdict(list)
    for j, line in enumerate(b):
        if line in wanted:
            places[line].append(j)
    every = (1 << n) - 1
    state = every
    masks: dict[str, int] = {}
    for line in a:
        if line not in places:
            continue
        mask = masks.get(line)
        if mask is None:
            mask = _mask(places[line], n)
            if len(places[line]) > 64:  # few lines come so often
                masks[line] = mask
        met = state & mask
        state = ((state + met) | (state - met)) & every
    bits = np.unpackbits(np.frombuffer(state.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits[:n].astype(np.int64))])


def _mask(places: list[int], n: int) -> int:
    if len(places) == 1:
        return 1 << places[0]
    bits = np.zeros(n, np.uint8)
    bits[places] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def shared_beginning(a, b) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def nearest_lines(path: str, near: list[tuple[str, list[str]] | None]) -> list[str]:
    """Lines of the neighbour with the longest shared beginning of the path, the first of equals."""
    near = [n for n in near if n]
    return max(near, key=lambda n: shared_beginning(path, n[0]))[1] if near else []


def main_text(df: DataFrame, id_: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: the id, the URL, ``text``."""
    whole = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(whole, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(whole, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    rows = df.select(F.col(id_).alias("_id"), F.col(url).alias("_url"), F.col(page).alias("_page"), host.alias("_host"), path.alias("_path"))
    kinds = {n: df.schema[c].dataType.simpleString() for n, c in (("_id", id_), ("_url", url))}

    def read_loose(batch):
        found = [all_lines(p or "") for p in batch.column("_page").to_pylist()]
        loose = [[(t, kind) for t, kind in own if kind != BODY_TEXT] for own in found]
        yield {
            "_lines": [digest([(t, kind == BODY_TEXT) for t, kind in own if kind != FURNITURE]) for own in found],
            "_loose": [[hashed(t) for t, _ in own] for own in loose],
            "_free": [[k for k, (_, kind) in enumerate(own) if kind == FREE] for own in loose],
            **{n: batch.column(n) for n in ("_host", "_path")},
        }

    kind = "_host string, _path string, _lines binary, _loose array<binary>, _free array<int>"
    loose = map_batches(rows, read_loose, kind).where(F.size("_loose") > 0)
    least = F.min(F.struct("_path", "_loose", "_free"))
    known = loose.groupBy("_host", "_lines").agg(least.alias("_at")).select("_host", "_at.*", "_lines")
    order = ["_host", "_path", "_lines"]
    sorted_ = known.repartitionByRange(*order).sortWithinPartitions(*order)
    sites = materialize(sorted_.withColumn("_part", F.spark_partition_id()), "sites")

    what = F.struct("_path", "_lines", "_loose")
    edges = sites.groupBy("_part", "_host").agg(F.min(what).alias("_first"), F.max(what).alias("_last"))
    by_part = Window.partitionBy("_host").orderBy("_part")
    edges = edges.select(
        "_part", "_host", F.lag("_last").over(by_part).alias("_earlier"), F.lead("_first").over(by_part).alias("_later")
    )
    inside = Window.partitionBy("_part", "_host").orderBy("_path", "_lines")
    placed = sites.select(
        "*", F.lag(what).over(inside).alias("_before"), F.lead(what).over(inside).alias("_after")
    ).join(edges, ["_part", "_host"])
    pairs = placed.select("_host", "_path", "_lines", "_loose", "_free", *[
        F.coalesce(n, edge).dropFields("_lines").alias(n) for n, edge in (("_before", "_earlier"), ("_after", "_later"))
    ])

    def align(batch):
        gone = []
        for r in batch.to_pylist():
            near = [n and (n["_path"], n["_loose"]) for n in (r["_before"], r["_after"])]
            shared = common(r["_loose"], nearest_lines(r["_path"], near))
            gone.append([k for k, place in enumerate(r["_free"]) if place in shared])
        yield {"_host": batch.column("_host"), "_lines": batch.column("_lines"), "_gone": gone}

    shared = map_batches(pairs, align, "_host string, _lines binary, _gone array<int>")
    shared = grouped_for_join(shared.where(F.size("_gone") > 0), ["_host", "_lines"], F.first("_gone").alias("_gone"))

    def read(batch):
        found = [lines(p or "") for p in batch.column("_page").to_pylist()]
        yield {
            "_lines": [digest(own) for own in found],
            "_texts": [[t for t, _ in own] for own in found],
            "_free": [[k for k, (_, body) in enumerate(own) if not body] for own in found],
            **{n: batch.column(n) for n in ("_id", "_url", "_host")},
        }

    schema = f"_id {kinds['_id']}, _url {kinds['_url']}, _host string, _lines binary, _texts array<string>, _free array<int>"
    found = map_batches(rows, read, schema).join(shared, ["_host", "_lines"], "left")
    dropped = F.transform("_gone", lambda k: F.get("_free", k))
    left = F.filter("_texts", lambda t, k: ~F.array_contains(dropped, k))
    text = F.array_join(F.when(F.col("_gone").isNull(), F.col("_texts")).otherwise(left), "\n\n")
    return found.select(F.col("_id").alias(id_), F.col("_url").alias(url), text.alias("text"))


def hashed(line: str) -> bytes:
    return hashlib.md5(line.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def digest(own: list[tuple[str, bool]]) -> bytes:
    """128 bits over the lines and their marks. Lines hold no line breaks."""
    return hashlib.md5("\n".join(f"{b:d}{t}" for t, b in own).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
