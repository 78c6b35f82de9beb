"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

1. Each page becomes a template: the tree of its block elements, with a slot for every
   text.  Siblings, or groups of siblings, that occur in a row become one repeated group.
2. Templates of the same host are aligned one after the other (longest common sequence of
   children, level by level): what one of them lacks becomes an optional group, what
   occurs in a row a repeated group, texts become slots.  The result is the host's wrapper.
   A level of very many unlike children becomes one repeated group of optional children.
3. A wrapper's slots are judged by what its pages say in them.  A slot is *template* if it
   says the same on all pages (on two distinct pages at least, on SAME_PAGES within an
   article or main element, where a title of level 1 never is one), or if half of it or
   more is links.  Elements that HTML itself sets apart (nav, footer, aside, form, ...) are
   no content.  What pages fill anew each time, as adverts and reader comments, shows in no
   statistics: there the element's role, class or id decides, but not if the element holds
   LAYOUT of all the host's text, as a frame of the whole page does.
4. Each page is read by its host's wrapper, in page order: slots within its article or main
   elements where it has some, else the others; those that are no template, or if the page
   has no such slot, all of them, so that no page loses its text to the statistics.

Scale: pages are parsed where they are read, twice (storing what was parsed would write
most of the input again); what is shuffled is templates and slot statistics, pre-aggregated
by host.  The slots of an alignment don't depend on its order, so a host with a third of all
pages is aligned in groups of at most GROUP distinct templates, then the results of those,
and so on.  Wrappers are broadcast while they are under BROADCAST_BYTES; beyond, pages are
joined to them by host.  Parsing is linear in the page, alignment at worst n log n in the
children of an element.

Edge cases: a null html has the empty text; a null url or one without a host belongs to
the host ''; repeated rows get equal texts; elements deeper than DEEPEST count as part of
the last of these; a comment, script or tag that never ends goes to the end of the page; where a
quote in a tag is never closed, that tag and later ones end at the next `>`; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relkit.llm._text import stash

GROUP = 64
BROADCAST_BYTES = 32 << 20
DEEPEST = 200
#: Distinct pages on which a slot of an article must say the same to count as template.
SAME_PAGES = 5
#: Share of a host's text from which on an element is a frame of the page, whatever its label.
LAYOUT = 0.9
#: Longest group of siblings that is looked for in a row; children and cells of an exact alignment.
_PERIOD, _LONG, _CELLS = 4, 64, 1 << 14

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed", "noframes"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "picture", "object", "video", "audio", "canvas", "map"}
#: An opening tag ends open elements of these kinds, up to the nearest of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that are set apart (header only outside an article), and words of roles, classes and ids that say so.
_NOT_CONTENT = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "label", "fieldset"}
_NOT_CONTENT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
_NOT_CONTENT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead", "cookie", "cookies", "notice", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "comment", "comments", "reply", "replies", "disqus", "share", "social", "related", "recommended", "widget", "pagination", "pager", "toolbar", "login", "search"}
#: Beside one of these in a name, words for the head of something say that it is the article's own.
_OF_ARTICLE, _HEADS = {"article", "entry", "post", "story", "content"}, {"header", "banner", "masthead"}
_SPACE = re.compile(r"\s+")


def host_of(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#]*)", url or "")
    return found[1].lower() if found else ""


def _label(tag: str, attributes: str, in_article: bool = False) -> str:
    """The element's name; `!` if HTML sets it apart, `~` if its class or id says that it is no content, `*` if it is the main part."""
    apart = tag in _NOT_CONTENT and not (tag == "header" and in_article)
    if tag in ("html", "body") or not attributes.strip(" /\t\n"):
        return tag + ("!" if apart else "*" if tag in ("article", "main") else "")
    found = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    bad = False
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
        bad = bad or bool(words & _NOT_CONTENT_WORDS - (_HEADS if words & _OF_ARTICLE or in_article else set()))
    role = found.get("role", "").lower()
    hidden = "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", ""))
    main = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articleBody"
    kind = ".".join(sorted(set(found.get("class", "").split())))
    mark = "!" if apart or role in _NOT_CONTENT_ROLES or hidden else "~" if bad else "*" if main else ""
    return f"{tag}{'.' + kind if kind else ''}".translate(_PLAIN) + mark


_PLAIN = str.maketrans("/!~*", "____")


def blocks(page: str) -> tuple[list, list[tuple[str, str, int]]]:
    """The page's template, and its blocks in order: (path of the slot, text, characters within links)."""
    root: list = ["", "", []]
    stack, names, paths = [root], [""], [""]
    opened: Counter = Counter()
    found: list[tuple[str, str, int]] = []
    parts: list[str] = []
    links, in_link = 0, 0

    def text(raw: str) -> None:
        nonlocal links
        if raw:
            parts.append(raw)
            if in_link:
                links += len(raw)

    def flush() -> None:
        nonlocal links
        if parts:
            said = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if said:
                found.append((paths[-1], said, min(links, len(said))))
                stack[-1][2].append(["#", "", []])
            links = 0

    def close() -> None:
        flush()
        node = stack.pop()
        opened[names.pop()] -= 1
        paths.pop()
        # elements that are too deep share the node of the last that is not
        if node is not stack[-1]:
            node[2] = fold(node[2])

    at, tags = 0, _TAG
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if after and after in "!?":
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else len(page)
            continue
        if not (page[lt + 2 : lt + 3] if after == "/" else after).isascii() or not (page[lt + 2 : lt + 3] if after == "/" else after).isalpha():
            text("<")
            at = lt + 1
            continue
        m = tags.match(page, lt)
        if not m and tags is _TAG:
            tags = _LOOSE
            m = tags.match(page, lt)
        if not m:
            break
        at = m.end()
        tag, ends = m[2].lower(), m[1]
        if tag in _RAW and not ends:
            done = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = done.end() if done else len(page)
        elif tag == "br":
            parts.append(" ")
        elif tag in _INLINE or tag in _VOID and tag != "hr":
            if tag == "a":
                in_link = 0 if ends else 1
        elif ends:
            if opened[tag] > 0:
                while True:
                    last = names[-1]
                    close()
                    if last == tag:
                        break
            else:
                flush()
        else:
            if names[-1] == "p":
                close()
            flush()
            if tag in _ENDS:
                kinds, fence = _ENDS[tag]
                i = len(names) - 1 if any(opened[k] > 0 for k in kinds) else 0
                while i > 0 and names[i] not in kinds and names[i] not in fence:
                    i -= 1
                if i > 0 and names[i] in kinds:
                    while len(names) > i:
                        close()
            if tag != "hr":
                node, path = stack[-1], paths[-1]
                if len(stack) < DEEPEST:
                    node = [_label(tag, m[3], "*" in path), "", []]
                    stack[-1][2].append(node)
                    path = f"{path}/{node[0]}"
                stack.append(node)
                names.append(tag)
                opened[tag] += 1
                paths.append(path)
    while len(stack) > 1:
        close()
    flush()
    root[2] = fold(root[2])
    return root, found


def _flags(*flags: str) -> str:
    return "".join(sorted(set("".join(flags))))


def _name(node: list) -> str:
    """What makes nodes alike: the label, of a group those of its members."""
    return node[0] or f"({' '.join(c[0] for c in node[2])})"


def fold(children: list) -> list:
    """Children, or groups of up to _PERIOD children, that occur in a row become one repeated group."""
    out = children
    for period in range(1, _PERIOD + 1):
        labels, i, new = [_name(c) for c in out], 0, []
        if len(labels) < 2 * period or len(set(labels)) == len(labels):
            continue
        while i < len(out):
            k = i + period
            while labels[k : k + period] == labels[i : i + period] and k + period <= len(out):
                k += period
            if k > i + period:
                members = []
                for j in range(period):
                    one = out[i + j]
                    for x in range(i + j + period, k, period):
                        one = align(one, out[x])
                    members.append(one)
                if period == 1:
                    one = members[0]
                    new.append([one[0], one[1] if one[0] == "#" else _flags(one[1], "+"), one[2]])
                else:
                    new.append(["", "+", [m for x in members for m in (x[2] if not x[0] else [x])]])
                i = k
            else:
                new.append(out[i])
                i += 1
        out = new
    return [["", "+", _distinct(out)]] if len(out) > _LONG else out


def _distinct(children: list) -> list:
    """One optional child of each label, in order of first appearance."""
    kinds: dict[str, list] = {}
    for c in children:
        for x in c[2] if not c[0] else [c]:
            kinds[x[0]] = align(kinds[x[0]], x) if x[0] in kinds else x
    return [[c[0], c[1] if c[0] == "#" else _flags(c[1], "?"), c[2]] for c in kinds.values()]


def _matched(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common sequence of labels."""
    if len(x) * len(y) > _CELLS:  # labels are distinct: the longest rising sequence of their places
        at = {label: j for j, label in enumerate(y)}
        tails, ends, before = [], [], {}
        for i, label in enumerate(x):
            j = at.get(label)
            if j is not None:
                k = bisect_left(tails, j)
                tails[k : k + 1], ends[k : k + 1] = [j], [i]
                before[i] = (j, ends[k - 1] if k else None)
        out, i = [], ends[-1] if ends else None
        while i is not None:
            out.append((i, before[i][0]))
            i = before[i][1]
        return out[::-1]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i, j, out = 0, 0, []
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _members(children: list) -> list[tuple[list, int | None]]:
    """Children with those of groups in the groups' place, and the group that each is in."""
    return [(m, None if c[0] else g) for g, c in enumerate(children) for m in (c[2] if not c[0] else [c])]


def align(a: list, b: list) -> list:
    """The least template that both are instances of: what only one has becomes optional."""
    if a[2] == b[2]:
        return [a[0], _flags(a[1], b[1]), a[2]]
    x, y = _members(a[2]), _members(b[2])
    if len(x) * len(y) > _CELLS:
        x, y = ([(c, 0) for c in _distinct(side[2])] for side in (a, b))
    merged, i, j = [], 0, 0
    optional = lambda c: [c[0], c[1] if c[0] == "#" else _flags(c[1], "?"), c[2]]
    for p, q in [*_matched([c[0] for c, _ in x], [c[0] for c, _ in y]), (len(x), len(y))]:
        merged += [(optional(c), ("a", g), None) for c, g in x[i:p]] + [(optional(c), None, ("b", g)) for c, g in y[j:q]]
        if p < len(x):
            merged.append((align(x[p][0], y[q][0]), ("a", x[p][1]), ("b", y[q][1])))
        i, j = p + 1, q + 1
    # a group goes from its first to its last member; groups that overlap are one
    spans: dict[tuple, list[int]] = {}
    for n, (_, *groups) in enumerate(merged):
        for g in groups:
            if g and g[1] is not None:
                spans.setdefault(g, [n, n])[1] = n
    out, at = [], 0
    for lo, hi in sorted(spans.values()):
        if lo < at:
            out[-1][2] += [c for c, *_ in merged[at : hi + 1]]
        else:
            out += [c for c, *_ in merged[at:lo]]
            out.append(["", "+", [c for c, *_ in merged[lo : hi + 1]]])
        at = max(at, hi + 1)
    return [a[0], _flags(a[1], b[1]), fold(out + [c for c, *_ in merged[at:]])]


def expression(node: list) -> str:
    """The wrapper as a union-free regular expression over tags and text slots."""
    label = node[0].rstrip("!~*")
    inner = "".join(map(expression, node[2]))
    said = "#text" if node[0] == "#" else f"<{label}>{inner}</{label.partition('.')[0]}>" if label else inner
    mark = {"": "", "+": "+", "?": "?", "+?": "*"}[node[1]]
    return f"({said}){mark}" if mark else said


def slots(node: list, path: str = "") -> list[str]:
    out = [path] if any(c[0] == "#" for c in node[2]) else []
    for c in node[2]:
        if c[0] != "#":
            out += slots(c, f"{path}/{c[0]}" if c[0] else path)
    return list(dict.fromkeys(out))


def content(wrapper: list, seen: dict[str, tuple[int, int, bool, int]]) -> list[str]:
    """The slots that may be content, `?` before those that are template.

    seen, by slot: characters, characters in links, whether all its pages say the same, and
    how many distinct pages have it.
    """
    open_to = [s for s in slots(wrapper) if "!" not in s]
    total = sum(seen[s][0] for s in open_to if s in seen)
    inside: Counter = Counter()
    for s in open_to:
        steps = s.split("/")
        for i, step in enumerate(steps):
            if step.endswith("~"):
                inside["/".join(steps[: i + 1])] += seen.get(s, (0,))[0]
    out = []
    for s in open_to:
        steps = s.split("/")
        if any(step.endswith("~") and inside["/".join(steps[: i + 1])] < LAYOUT * total for i, step in enumerate(steps)):
            continue
        chars, links, same, pages = seen.get(s, (0, 0, False, 0))
        title = "*" in s and steps[-1].partition(".")[0] == "h1"
        template = same and not title and pages >= (SAME_PAGES if "*" in s else 2)
        out.append(("?" if template or 2 * links >= chars > 0 else "") + s)
    return out


def main_text(found: list[tuple[str, str, int]], own: frozenset) -> str:
    """The texts of a page's main slots, or of its others where it has none; of these, those that are no template if there are any."""
    texts = [(path, path in own, t) for path, t, _ in found if path in own or f"?{path}" in own]
    texts = [x for x in texts if "*" in x[0]] or texts
    return "\n".join([t for _, sure, t in texts if sure] or [t for path, _, t in texts])


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), signed=True)


_SLOTS = pa.list_(pa.struct([("slot", pa.string()), ("chars", pa.int64()), ("links", pa.int64()), ("said", pa.int64()), ("page", pa.int64())]))


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, templates, stats = [], [], []
        for url, page in zip(batch.column("url"), batch.column("html")):
            template, found = blocks(page.as_py() or "")
            by_slot: dict[str, list] = {}
            for path, text, links in found:
                s = by_slot.setdefault(path, [0, 0, []])
                s[0], s[1] = s[0] + len(text), s[1] + links
                s[2].append(text)
            whole = _hash("\n".join(f"{path} {text}" for path, text, _ in found))
            hosts.append(host_of(url.as_py()))
            templates.append(json.dumps(template, ensure_ascii=False, separators=(",", ":")))
            stats.append([{"slot": p, "chars": c, "links": k, "said": _hash("\n".join(t)), "page": whole} for p, (c, k, t) in by_slot.items()])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(templates, pa.string()), pa.array(stats, _SLOTS)], names=["host", "template", "slots"])


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    wrapper = None
    for t in sorted(group["template"], key=lambda x: (len(x), x)):
        own = json.loads(t)
        wrapper = own if wrapper is None else align(wrapper, own)
    return pd.DataFrame({"host": group["host"].iloc[:1], "template": [json.dumps(wrapper, ensure_ascii=False, separators=(",", ":"))]})


def wrappers(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """host, template (the aligned tree as JSON), slots (array of its content slots, see `content`)."""
    seen = stash(pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(_templates, "host string, template string, slots array<struct<slot:string,chars:bigint,links:bigint,said:bigint,page:bigint>>"), "templates")
    merged = seen.groupBy("host", "template").agg(F.lit(1)).select("host", "template")
    while True:
        # distinct templates of a host, in groups of about GROUP by their hash
        salted = merged.join(merged.groupBy("host").agg(F.ceil(F.count("*") / GROUP).alias("groups")), "host").withColumn("salt", F.pmod(F.xxhash64("template"), "groups"))
        merged = stash(salted.groupBy("host", "salt").applyInPandas(_merged, "host string, template string"), "wrappers")
        if merged.groupBy("host").count().where("count > 1").isEmpty():
            break
    stats = seen.select("host", F.inline("slots")).groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"), (F.min("said") == F.max("said")).alias("same"), F.when(F.min("page") == F.max("page"), 1).otherwise(F.greatest(F.lit(2), F.approx_count_distinct("page"))).alias("pages"))
    judged = merged.join(stats.groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "links", "same", "pages")).alias("seen")), "host", "left")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["slots"] = [content(json.loads(t), {s["slot"]: (s["chars"], s["links"], s["same"], s["pages"]) for s in (() if seen is None else seen)}) for t, seen in zip(batch["template"], batch["seen"])]
            yield batch[["host", "template", "slots"]]

    return judged.mapInPandas(judge, "host string, template string, slots array<string>")


def _texts(known, has_slots: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for i, (url, page) in enumerate(zip(batch.column("url"), batch.column("html"))):
                own = batch.column("slots")[i].as_py() if has_slots else known.value.get(host_of(url.as_py()), ())
                own = frozenset(own or ())
                texts.append(main_text(blocks(page.as_py() or "")[1], own))
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("url"), pa.array(texts, pa.string())], names=["page", "url", "text"])

    return run


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text of each page."""
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), F.col(html).alias("html"))
    made = stash(wrappers(rows).select("host", "slots"), "slots")
    kind = pages.schema[page_id].dataType.simpleString()
    schema = f"page {kind}, url string, text string"
    size = made.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length(F.array_join("slots", "")) + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        known = pages.sparkSession.sparkContext.broadcast({r.host: frozenset(r.slots) for r in made.collect()})
        out = rows.mapInArrow(_texts(known, False), schema)
    else:
        host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))
        out = rows.withColumn("host", host).join(made, "host", "left").select("page", "url", "html", "slots").mapInArrow(_texts(None, True), schema)
    return out.select(F.col("page").alias(page_id), F.col("url").alias(url), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
