"""Main text of web pages by removal of site templates.

Every page is parsed once into elements. The subtree of a block element is hashed from
its tag, class, id, text and the hashes of its children. Spark counts, per host, on how many
pages with different main texts a subtree hash occurs; copies of one article are one text,
so their paragraphs are no template. A subtree found with at least `least` texts and
`share` of the host's texts is template, and is deleted from each page of the host where it
occurs. Two things are decided by the page alone, as small hosts and templates with rotating
texts show no recurrence: elements that HTML, an ARIA role, or a class or id name as
something else than the article (menus, asides, forms, adverts, comments, ..) are deleted
too, and what stays is cut to the `article` elements, else `main`, where there are any.

Recurrence never deletes what holds an `article` or `main`, or half of a page's text; nor,
within an article, paragraphs, headings and quotes: passages that articles share are text. A nested
`article` is a reader comment. White space of a block becomes one space, `br` is a space, blocks
are joined by an empty line.

Counting is by (host, hash, text) and then (host, hash), each with map-side combining, so a
host with a third of all pages is spread over its hashes; the join that marks a page's template
subtrees is salted by page. Only hashes of the templates that a page itself has return to it.

Null and empty html give an empty text. Pages without host are one host of their own. Very
long pages are parsed whole, in time linear in their length; unclosed, stray and misnested tags
close as in a browser. Repeated rows are extracted one by one and count once. Empty tables give
an empty result. Only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import html as refs
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickforge.llm.common import materialize, query, table

# Element names of HTML, ARIA roles, and words that name boilerplate in classes and ids.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - set("body caption dd dt html legend li optgroup option tbody tfoot thead tr".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd figcaption caption tr".split())
NEVER = set("head script style title textarea noscript template iframe noembed noframes xmp object svg canvas math nav footer aside form dialog button select "
            "menu search audio video".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
WORDS = set("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion sidebar sidebars comment comments disqus cookie "
            "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login menu menus nav navbar navigation breadcrumb "
            "breadcrumbs pagination pager share sharing social related recommended recommendations footer masthead toolbar replies reply respond".split())
CORE = {"article", "main"}
#: An open tag of the key ends the open elements of the value, up to an element of the last set.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
           "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select", "optgroup"}), "body": ({"head"}, {"html"})}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>""", re.S)
ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?=[\s=/]|\Z)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[a-z0-9]+|[A-Z](?:[a-z0-9]+|[A-Z0-9]*(?![a-z]))")


class Page:
    """Elements of a page in document order, and its runs of text as (block, element, text)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.named, self.digest, self.size = ["#page"], [-1], [False], [0], [0]
        self.core, self.runs = [False], []
        self._parts, self._stack, self._block, self._articles = [[]], [0], 0, 0
        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at:m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, attributes = name.lower(), (m[3] or m[6] or "")
            if m[1] or m[4]:
                self._end(name)
                continue
            self._start(name, attributes)
            if name in RAW:
                stop = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
                at = stop.end() if stop else n
                self._close()
        while self._stack:
            self._close()

    def _text(self, raw: str) -> None:
        text = refs.unescape(raw) if "&" in raw else raw
        node = self._stack[-1]
        self.runs.append((self._block, node, text))
        words = " ".join(text.split())
        if words:
            self.size[node] += len(words)
            self._parts[node].append(words)

    def _start(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._until({"p"}, {"table", "button", "article", "section", "div", "li", "td", "body"})
        if name in IMPLIED:
            self._until(*IMPLIED[name])
        if name in BLOCK:
            self._block += 1
        if name == "br":
            self.runs.append((self._block, self._stack[-1], " "))
        if name in VOID:
            return
        label, named = "", name in NEVER
        if attributes:
            found = {k.lower(): (v or "").strip("\"'") for k, v in ATTR.findall(attributes)}
            label = f"{found.get('class', '')}#{found.get('id', '')}"
            named = named or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            if name not in CORE and name not in ("html", "body"):
                named = named or found.get("role", "").lower() in ROLES or not WORDS.isdisjoint(w.lower() for w in NAME.findall(label))
            elif name == "article":
                named = named or not {"comment", "comments", "reply"}.isdisjoint(w.lower() for w in NAME.findall(label))
        # a header of an article belongs to it, an article in an article is a comment
        named = named or (name == "article" and self._articles > 0) or (name == "header" and not self._articles)
        self._articles += name == "article"
        self.tag.append(name)
        self.parent.append(self._stack[-1])
        self.named.append(named)
        self.digest.append(0)
        self.size.append(0)
        self.core.append(False)
        self._parts.append([f"{name} {label}"])
        self._stack.append(len(self.tag) - 1)
        if name in CORE and not named:
            for i in self._stack:
                self.core[i] = True

    def _close(self) -> None:
        node = self._stack.pop()
        tag = self.tag[node]
        self._articles -= tag == "article"
        if tag in BLOCK:
            self._block += 1
        elif tag in ("td", "th"):
            self.runs.append((self._block, node, " "))
        if self.size[node]:
            self.digest[node] = xxhash.xxh64_intdigest("\x00".join(self._parts[node]).encode("utf-8", "replace")) >> 1
            up = self.parent[node]
            if up >= 0:
                self.size[up] += self.size[node]
                self._parts[up].append(str(self.digest[node]))
        self._parts[node] = []

    def _until(self, names: set, barrier: set) -> None:
        """Closes the innermost open element of `names`, and all in it, if it is not beyond a barrier."""
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[k]]
            if tag in names:
                while len(self._stack) > k:
                    self._close()
                return self._until(names, barrier) if len(names) > 1 else None
            if tag in barrier:
                return None

    def _end(self, name: str) -> None:
        if name == "br":
            self.runs.append((self._block, self._stack[-1], " "))
        inline = name not in BLOCK and name not in ("td", "th", "head")
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[k]]
            if tag == name:
                while len(self._stack) > k:
                    self._close()
                return
            if inline and (tag in BLOCK or tag in ("td", "th")):
                return

    def dead(self, templates=frozenset()) -> list[bool]:
        """Per element, whether it or an element around it is named as boilerplate or is a template subtree."""
        out = []
        for i, up in enumerate(self.parent):
            gone = (self.named[i] and not self.core[i]) or (self.digest[i] in templates and self.tag[i] in BLOCK)
            out.append(gone or (up >= 0 and out[up]))
        return out

    def kept(self, dead: list[bool]) -> list[bool]:
        """Per element, whether its own text is main text: of articles, else of `main`, else of the page."""
        for name in ("article", "main", "#page"):
            roots = [t == name and not d for t, d in zip(self.tag, dead)]
            inside = []
            for i, up in enumerate(self.parent):
                inside.append(not dead[i] and (roots[i] or (up >= 0 and inside[up])))
            if name == "article" and any(roots) and not any(t == "h1" and k for t, k in zip(self.tag, inside)):
                inside = [k or (self._in_main_heading(i) and not dead[i]) for i, k in enumerate(inside)]
            if any(inside[node] and text.strip() for _, node, text in self.runs):
                return inside
        return inside

    def _in_main_heading(self, i: int) -> bool:
        around = set()
        while i >= 0:
            around.add(self.tag[i])
            i = self.parent[i]
        return {"main", "h1"} <= around

    def blocks(self, kept: list[bool]) -> list[str]:
        out, last, held = [], None, []
        for block, node, text in self.runs:
            if block != last:
                out.append("".join(held))
                last, held = block, []
            if kept[node]:
                held.append(text)
        out.append("".join(held))
        return [b for b in (" ".join(x.split()) for x in out) if b]

    def candidates(self) -> tuple[int, list[int]]:
        """Hash of the main text, and the subtree hashes that recurrence may delete."""
        kept = self.kept(self.dead())
        main = xxhash.xxh64_intdigest("\n".join(self.blocks(kept)).encode("utf-8", "replace")) >> 1
        within, out = [], set()
        for i, (tag, up) in enumerate(zip(self.tag, self.parent)):
            within.append(tag == "article" or (up >= 0 and within[up]))
            if tag in BLOCK and self.digest[i] and not self.core[i] and 2 * self.size[i] < self.size[0] and not (within[i] and tag in PROSE):
                out.add(self.digest[i])
        return main, sorted(out)


def extract(source: str, templates=frozenset()) -> str:
    """Main text of a page without the subtrees of these hashes."""
    page = Page(source)
    return "\n\n".join(page.blocks(page.kept(page.dead(templates))))


def _subtrees(source: pd.Series) -> pd.DataFrame:
    found = [Page(s).candidates() for s in source]
    return pd.DataFrame({"main": pd.Series([f[0] for f in found], dtype="int64"), "hashes": pd.Series([f[1] for f in found], dtype="object")})


def _main_text(source: pd.Series, templates: pd.Series) -> pd.Series:
    return pd.Series([extract(s, frozenset() if t is None else frozenset(t.tolist())) for s, t in zip(source, templates)], dtype="object")


def templates(found: DataFrame, least: int, share: float) -> DataFrame:
    """Rows (host, hash) of template subtrees. found: host, main, hashes."""
    # hash -1 stands for the page itself, so that its count is the host's number of texts
    seen = found.select("host", "main", F.explode(F.concat("hashes", F.array(F.lit(-1).cast("bigint")))).alias("hash")).distinct()
    counts = materialize(seen.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    hosts = counts.where("hash = -1").select(F.col("host").alias("_host"), F.col("n").alias("texts"))
    return counts.where("hash <> -1").join(hosts, F.col("host") == F.col("_host")).where(F.col("n") >= F.col("texts") * share).select("host", "hash")


def extract_pages(pages: DataFrame, least: int = 3, share: float = 0.005, salts: int = 16) -> DataFrame:
    """Rows (page_id, url, text, n_chars, n_templates), one per row of pages."""
    subtrees, main_text = pandas_udf(_subtrees, "struct<main: bigint, hashes: array<bigint>>"), pandas_udf(_main_text, "string")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.xxhash64(host).alias("host"),
                        F.xxhash64("page_id", "url", "html").alias("k1"), F.xxhash64(F.lit("page"), "html", "url", "page_id").alias("k2"))
    found = rows.select("k1", "k2", "host", subtrees("html").alias("s")).select("k1", "k2", "host", "s.main", "s.hashes")
    found = materialize(found)
    salt = F.pmod("k1", F.lit(salts)).cast("int")
    template = templates(found, least, share).select(
        F.col("host").alias("_host"), F.col("hash").alias("_hash"), F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("_salt"))
    had = found.select("k1", "k2", "host", F.explode("hashes").alias("hash"))
    marks = had.join(template, (F.col("host") == F.col("_host")) & (F.col("hash") == F.col("_hash")) & (salt == F.col("_salt"))).groupBy(
        F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.collect_set("hash").alias("templates"))
    out = rows.join(marks, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left").select(
        "page_id", "url", main_text("html", "templates").alias("text"), F.coalesce(F.size("templates"), F.lit(0)).cast("long").alias("n_templates"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.greatest("n_templates", F.lit(0)).alias("n_templates"))


@query("op13_site_templates")
def op13_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
