"""Main text of web pages by wrappers inferred for each host."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table, written

# Element names of HTML by what they do here.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = "script style noscript template textarea title iframe svg object select"
BLOCK = set("address blockquote caption center dd dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr legend li ol p pre table tbody thead tfoot tr ul summary details".split())
CONTAINER = set("html head body article main section div nav header footer aside form menu dialog button ul ol table details fieldset".split())
DROPPED = set("head nav header footer aside form menu dialog button fieldset".split())
#: Words in class, id or role that name what is not the article.
NOISE = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary"
    " consent contentinfo cookie cookies disqus footer form gdpr header masthead menu modal nav navbar navigation"
    " newsletter notice notices overlay popup promo promoted related replies reply search share sharing sidebar"
    " social sponsor sponsored subscribe toolbar widget".split()
)
#: Those of them that name a paragraph, a heading or a list item too; a heading of class "header" is none.
BLOCK_NOISE = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " disqus gdpr newsletter notice notices promo promoted sidebar sponsor sponsored subscribe".split()
)
MAIN = ("article", "main")
#: Bytes of wrappers up to which they are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20
#: Token streams that are aligned in one group; those of a host with more are aligned in rounds.
FOLD = 64
#: Slots of a stream beyond which the most frequent tokens are no anchors.
LONG = 2000
#: Slots in a group that may repeat.
GROUP = 8
#: A text is the template's if it stands at its place on so many pages of the host, and on a fifth of them.
REPEATS, SHARE = 3, 5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg\b[^>]*?/>|<(" + HIDDEN.replace(" ", "|") + r")\b[^>]*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>",  # quotes count behind = only
    re.S | re.I,
)
MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
WORD = re.compile(r"[a-z]+")


def sign(name: str, attributes: str, names: set[str] = NOISE) -> str:
    """The token of an opening tag: its name, and a mark where its attributes name noise or the main part."""
    if "=" in attributes:
        words = {w for m in MARK.findall(attributes) for w in WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m).lower())}
        if (noise := words & names) and name not in ("html", "body"):
            return f"{name}.{min(noise)}"
        if name not in MAIN and (role := re.search(r"role\s*=\s*[\"']?(main|article)\b", attributes, re.I)):
            return role[1].lower()
    return name


def blocks(page: str) -> Iterator[tuple[str, str]]:
    """(path, text) of each block of text in page order; path is the open containers, from the outside."""
    stack: list[str] = []
    parts: list[str] = []
    at, mark = 0, ""

    def flush() -> Iterator[tuple[str, str]]:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            yield "/".join(stack) + mark, text

    for m in TOKEN.finditer(page):
        parts.append(page[at : m.start()])
        at = m.end()
        closing, name = m[2], (m[3] or "").lower()
        if not name:
            continue
        if name in CONTAINER:
            yield from flush()
            mark = ""
            if not closing:
                stack.append(sign(name, m[4]))
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].partition(".")[0] == name or (stack[k] in MAIN and name in ("div", "section") and k == len(stack) - 1):
                        del stack[k:]
                        break
        elif name in BLOCK:
            yield from flush()
            named = "" if closing else sign(name, m[4], BLOCK_NOISE)
            mark = "/" + named if "." in named else ""
        elif name in ("br", "td", "th"):
            parts.append(" ")
    parts.append(page[at:])
    yield from flush()


def noise(path: str) -> bool:
    """Whether names on the path say that it is not the article. A header inside the article is part of it."""
    parts = path.split("/")
    inside = next((k for k, p in enumerate(parts) if p in MAIN), len(parts))
    return any("." in p or (p in DROPPED and not (p == "header" and k > inside)) for k, p in enumerate(parts))


def marked(path: str) -> str:
    """The article or main element that the path runs through, or ""."""
    parts = path.split("/")
    return next((m for m in MAIN if m in parts), "")


#: A slot of a wrapper: path, hash of its text (None: a text slot), optional, repeated, pages that have it.
Slot = tuple[str, str | None, bool, bool, int]


def skeleton(page: str) -> list[Slot]:
    """The token stream of a page. What names tell apart, noise and the marked article, are text slots from the start."""
    out: list[Slot] = []
    for path, text in blocks(page):
        told = noise(path) or marked(path)
        out.append((path, None if told else blake2b(text.encode(), digest_size=8).hexdigest(), False, False, 1))
    return squared(out)


def aligned(a: list[Slot], b: list[Slot]) -> list[Slot]:
    """The union-free expression that covers both token streams.

    Equal tokens are anchors and stay. Between them tokens of the same path but different texts, none of
    which stood on two pages before, become one text slot, and tokens of either alone become optional; then
    neighbours that repeat are folded.
    """
    out: list[Slot] = []

    def alone(slots: list[Slot]) -> None:
        out.extend((p, t, True, r, n) for p, t, _, r, n in slots)

    def both(x: list[Slot], y: list[Slot], text: bool) -> None:
        for (p, t, o, r, n), (_, _, u, v, m) in zip(x, y, strict=True):
            out.append((p, t if text else None, o or u, r or v, n + m))

    # in long streams tokens that stand everywhere are no anchors
    outer = SequenceMatcher(None, [s[:2] for s in a], [s[:2] for s in b], autojunk=len(b) > LONG)
    for kind, i, j, k, m in outer.get_opcodes():
        if kind == "equal":
            both(a[i:j], b[k:m], True)
            continue
        keys = [[s[0] if s[1] is None or s[4] == 1 else s[:2] for s in part] for part in (a[i:j], b[k:m])]
        inner = SequenceMatcher(None, *keys, autojunk=m - k > LONG)
        for what, e, f, g, h in inner.get_opcodes():
            if what == "equal":
                both(a[i + e : i + f], b[k + g : k + h], False)
            else:
                alone(a[i + e : i + f])
                alone(b[k + g : k + h])
    return squared(out)


def squared(slots: list[Slot], rest: bool = False) -> list[Slot]:
    """Folds repeats: text slots beside each other at one path, with the texts beside them that only one page has if `rest` says so, and groups of up to GROUP slots."""
    out: list[Slot] = []
    for p, t, o, r, n in slots:
        last = out[-1] if out else None
        one = last is not None and last[0] == p and (last[1] is None or t is None)
        if one and all(text is None or (rest and seen == 1) for text, seen in ((last[1], last[4]), (t, n))):
            out[-1] = (p, None, last[2] and o, True, max(last[4], n))
        else:
            out.append((p, t, o, r, n))
    for size in range(1, GROUP + 1):
        i, kept = 0, []
        while i < len(out):
            group = out[i : i + size]
            same = [s[:2] for s in group]
            j = i + size
            while len(same) == size and [s[:2] for s in out[j : j + size]] == same:
                j += size
            if j > i + size:
                kept += [(p, t, o, True, n) for p, t, o, _, n in group]
                i = j
            else:
                kept.append(out[i])
                i += 1
        out = kept
    return out


def template(wrapper: str) -> set[tuple[str, str]]:
    """(path, hash) of the texts that the wrapper holds as they are: alike on enough pages of the host."""
    if not wrapper:
        return set()
    pages, slots = json.loads(wrapper)
    return {(p, t) for p, t, _, _, n in slots if t is not None and n >= max(REPEATS, pages / SHARE)}


def main_text(parts: list[tuple[str, str]], fixed: set[tuple[str, str]]) -> list[str]:
    """The texts of a page's blocks that are the article's.

    Those through an article element, with those of a main element that has no article in it; else all whose path names no
    noise and whose text is not the template's; if the template's are all there are, they stay.
    """
    clean = [(path, text) for path, text in parts if not noise(path)]
    through = [path.split("/") for path, _ in clean]
    within = any("article" in path and "main" in path for path in through)
    marks = MAIN[:1] if within else MAIN
    if inside := [text for path, (_, text) in zip(through, clean, strict=True) if any(m in path for m in marks)]:
        return inside
    own = [text for path, text in clean if not fixed or (path, blake2b(text.encode(), digest_size=8).hexdigest()) not in fixed]
    return own or [text for _, text in clean]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]*://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, n) from all pages of each host; a wrapper is JSON: the pages aligned, and the slots.

    Equal token streams are counted first. The streams of a host are aligned in groups of about FOLD by
    hash, the wrappers of the groups again, until one is left; so no group grows with the host.
    """

    def skeletons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"host": batch["host"], "wrapper": [json.dumps([1, skeleton(h)]) for h in batch["html"]]})

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "wrapper"], ascending=[False, True])
        out, pages = None, 0
        for wrapper, n in zip(group["wrapper"], group["n"].tolist(), strict=True):
            weight, slots = json.loads(wrapper)
            slots = [(p, t, o, r, m * (n // weight)) for p, t, o, r, m in slots]
            pages += n
            out = slots if out is None else aligned(out, slots)
        return pd.DataFrame({"host": group["host"].iloc[:1], "wrapper": [json.dumps([pages, squared(out, True)])], "n": [pages]})

    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    shape = "host string, wrapper string, n long"
    layouts = rows.mapInPandas(skeletons, "host string, wrapper string").groupBy("host", "wrapper").agg(F.count("*").alias("n"))
    layouts = written(layouts, "layouts")
    while (most := layouts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        parts = layouts.groupBy("host").agg(F.ceil(F.count("*") / FOLD).alias("parts"))
        part = F.pmod(F.xxhash64("wrapper", F.lit(most)), F.col("parts")).alias("part")
        layouts = layouts.join(parts, "host").groupBy("host", part).applyInPandas(fold, shape)
        layouts = written(layouts, "layouts")
    return layouts


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page: its article's blocks, by marks or by its host's wrapper.

    Null or empty html gives empty text; a null url belongs to the host without a name; repeated rows
    each get their row; an empty table gives none; further columns are left aside. Broken nesting is
    read as far as it goes; a page of any length is read whole. A text that stands on many pages of a
    host, outside a marked article, is its template's and goes, unless the page has no other text.
    """
    known = wrappers(pages).select("host", "wrapper")
    if (known.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    rows = pages.select(
        F.col("page_id").cast("long").cast("string"),  # pandas would round numbers beside a null
        "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"),
    ).join(known, "host", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixed: dict[str, set[tuple[str, str]]] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch["html"], batch["wrapper"], strict=True):
                if wrapper not in fixed:
                    if len(fixed) > 1000:
                        fixed.clear()
                    fixed[wrapper] = template(wrapper)
                texts.append("\n\n".join(main_text(list(blocks(page)), fixed[wrapper])))
            yield pd.DataFrame({
                "page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]
            })

    found = rows.select("page_id", "url", "html", "wrapper").mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return found.withColumn("page_id", F.col("page_id").cast("long"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
