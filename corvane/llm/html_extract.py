"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree. A node is a path of block elements, each
with its presentation marks (tag, class, id, role; long numbers don't count); a page gives a
node one presentation (a branch: the sequence of its children; a text node: how many
blocks, how much text, whether it is links) and the texts of its blocks. Over the pages
that have the node,

* its presentation importance is the entropy of the presentations: what looks alike on
  every page has none;
* its content importance is one less the mean entropy of the features of its texts (the
  whole block, and its first words) over the pages: what reads alike on every page has none;
* a text node's importance is the weighted mean of both; a branch's importance comes from its
  children upwards: the text-weighted mean of the nodes below it, with its own
  presentation. A branch with a clearly important node below it is never low as a whole.

A host with few pages leans on the tree of all hosts, and that on UNKNOWN, in proportion
to their pages: there is no page count from which a site is treated otherwise. Names are
a prior that is added to a node's importance: being in article or main speaks for it,
menu-like tags and class words against it (those of menus, footers, sidebars, adverts and
comments outweigh any importance, as such text differs from page to page like content
does); a word inside a longer name weighs little. So is text that is mostly links.
Blocks on a branch whose sum is below LEAST go from each page.

Statistics are counted in each batch, then over the cluster; the list of low nodes is
joined to the pages by host, as a broadcast if it is small enough, else by a shuffle in
which every host is dealt over SALTS parts.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import by_bytes, stored, trimmed
from corvane.llm.url_filter import host_path

#: Importance (with prior) below which a branch goes, and from which a node protects the branches above it.
LEAST, CLEAR = 0.5, 0.6
#: Importance of a node on a single page, and the pages' worth that the tree of all hosts has in a host's.
UNKNOWN, SHARED_PAGES = 0.8, 4
#: Weight of its own presentation in a branch's importance, and pages from which entropies aren't scaled further.
OWN_WEIGHT, MOST_BASE = 0.1, 16
#: Weight of its content against its presentation in a text node's importance: what only looks alike stays.
TEXT_WEIGHT = 0.7
#: Priors: inside article or main; tags and names that say what it is (menus, footers, adverts, comments); other names and page headers; a form; a name that only has such a word.
INSIDE, CERTAIN, STRONG, FORM, WEAK = 0.3, -0.55, -0.45, -0.4, -0.2
#: Prior of text that is mostly links.
LINKS = -0.3
#: Low nodes up to which they are broadcast, parts that a host is dealt over beyond that, bytes of pages handled at once.
BROADCAST_NODES, SALTS, PAGE_BYTES = 200_000, 32, 2 << 20
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<(?:/?[a-zA-Z][^>]*)?\Z", re.S | re.I)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head button option".split())
_CLOSES_P = _BLOCKS - {"body", "html", "head"}
_VOID = frozenset({"hr"})
_NOISE_TAGS = frozenset("nav footer aside head menu dialog button option fieldset".split())
_NOISE_WORDS = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo promotion related respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets login search contentinfo complementary".split())
#: The words that count in full inside an article too.
_ARTICLE_NOISE = frozenset("ad ads adv advert advertisement advertising comment comments respond share sharing social newsletter subscribe cookie cookies promo sponsored nav navigation menu breadcrumb breadcrumbs pagination sidebar".split())
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d{3,}")


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 14)
def _step(up: tuple, tag: str, mark: str) -> tuple:
    """(hint, sticky, inside, chain, label) of an element below up: the name's hint, whether an article below keeps it, and the node hashes of its path."""
    hint, sticky, inside, chain, _ = up
    if tag in ("article", "main"):
        inside = True
        if not sticky:
            hint = 0.0
    if tag in _NOISE_TAGS:
        hint, sticky = min(hint, CERTAIN), True
    elif tag == "header" and not inside:
        hint = min(hint, STRONG)
    elif tag == "form":
        hint = min(hint, FORM)
    for name in mark.split():
        found = set(_WORD.findall(name))
        if found and found <= _ARTICLE_NOISE:
            hint, sticky = min(hint, CERTAIN), True
        elif found and not inside and found <= _NOISE_WORDS:
            hint = min(hint, STRONG)
        elif not found.isdisjoint(_NOISE_WORDS):
            hint = min(hint, WEAK)
    label = tag + (f".{mark}" if mark else "")
    return hint, sticky, inside, (*chain, _hash(f"{chain[-1] if chain else 0}/{label}")), label


_TOP = (0.0, False, False, (), "")


def _prior(state: tuple) -> float:
    return state[0] + (INSIDE if state[2] and state[0] > FORM else 0.0)


class Page:
    """blocks: (state, text) of each non-empty block in page order; children: the labels below each branch; links: blocks of a node that are links."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[tuple, str]] = []
        self.children: dict[tuple, list[str]] = {}
        self.links: Counter = Counter()
        if html:
            self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, tuple]] = []
        state, parts, at, in_link, linked = _TOP, [], 0, False, 0

        def flush():
            nonlocal parts, linked
            if parts:
                text = "".join(parts)
                share = linked * 2 > len(text)
                text = " ".join((unescape(text) if "&" in text else text).split())
                if text:
                    self.blocks.append((state, text))
                    self.links[state] += share
                parts, linked = [], 0

        for m in _TOKEN.finditer(html):
            if m.start() > at:
                parts.append(html[at : m.start()])
                linked += in_link * (m.start() - at)
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = not m[2]
            if tag not in _BLOCKS:
                continue
            flush()
            if m[2]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            else:
                if tag in _CLOSES_P and stack and stack[-1][0] == "p":
                    stack.pop()
                if tag in ("li", "tr", "td", "th", "dd", "dt") and stack and stack[-1][0] == tag:
                    stack.pop()
                if tag in _VOID:
                    continue
                up = stack[-1][1] if stack else _TOP
                mark = _DIGITS.sub("", " ".join(x for g in _MARK.findall(m[4]) for x in g if x).lower()) if m[4] else ""
                state = _step(up, tag, mark)
                self.children.setdefault(up, []).append(state[4])
                stack.append((tag, state))
            state = stack[-1][1] if stack else _TOP
        parts.append(html[at:])
        flush()


def _features(page: Page):
    """(chain, prior, chars, kind, feature): kind 0 the presentation of each node on this page, 1 the features of its texts."""
    texts: dict[tuple, list[str]] = {}
    for state, text in page.blocks:
        texts.setdefault(state, []).append(text)
    looks: dict[tuple, list] = {}  # chain -> prior, chars, presentation
    for state, own in texts.items():
        chars = sum(map(len, own))
        linked = page.links[state] * 2 > len(own)
        looks[state[3]] = [_prior(state) + LINKS * linked, chars, f"{len(own).bit_length()} {chars.bit_length()} {linked}"]
        for feature in {x for t in own for x in (_hash(t), _hash("^" + " ".join(t.split(" ", 3)[:3])))}:
            yield state[3], 0.0, 0, 1, feature
    for state, labels in page.children.items():
        look = looks.setdefault(state[3], [_prior(state), 0, ""])
        look[2] += " " + " ".join(labels)
    for chain, (prior, chars, look) in looks.items():
        yield chain, prior, chars, 0, _hash(look)


def style_nodes(pages: DataFrame) -> DataFrame:
    """host, node, prior, pages, own (importance of the node itself), importance (with what is below it), best (the highest own with prior at or below it) of each node of each host's style tree."""

    def count(batches):
        for b in by_bytes(batches, "html", PAGE_BYTES):
            seen: Counter = Counter()
            chars: Counter = Counter()
            for host, html in zip(b.column("host").to_pylist(), b.column("html")):
                for chain, prior, size, kind, feature in _features(Page(html.as_py())):
                    key = (host, chain, prior, kind, feature)
                    seen[key] += 1
                    chars[key] += size
            cols = list(zip(*((*k, n, chars[k]) for k, n in seen.items()))) if seen else [()] * 7
            kinds = [pa.string(), pa.list_(pa.int64()), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["host", "chain", "prior", "kind", "feature", "n", "chars"])

    raw = pages.mapInArrow(trimmed(count), "host string, chain array<long>, prior double, kind int, feature long, n long, chars long")
    node = F.coalesce(F.try_element_at("chain", F.lit(-1)), F.lit(0))
    counted = raw.groupBy("host", node.alias("node"), "kind", "feature").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.min("prior").alias("prior"), F.min("chain").alias("chain"))
    everywhere = counted.groupBy("node", "kind", "feature").agg(F.sum("n").alias("n"))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    n = F.col("n").cast("double")
    sums = [of(0, n).alias("pages"), of(0, n * F.log(n)).alias("looks"), of(1, n).alias("texts"), of(1, n * F.log(n)).alias("repeats")]

    def importances(pages_, looks, texts, repeats):
        """(presentation, content): entropies over the pages; null content without text."""
        base = F.log(F.least(pages_, F.lit(float(MOST_BASE))))
        presentation = F.least((F.log(pages_) - looks / pages_) / base, F.lit(1.0))
        content = F.greatest(1 - repeats / texts / F.log(pages_), F.lit(0.0))
        return F.when(pages_ > 1, presentation), F.when(pages_ > 1, content)

    columns = [F.col(c) for c in ("pages", "looks", "texts", "repeats")]
    look, content = importances(*columns)
    at_all = everywhere.groupBy("node").agg(*sums).select(F.col("node").alias("all_node"), *[(((F.col("pages") - 1) * F.coalesce(x, F.lit(0.0)) + UNKNOWN) / F.col("pages")).alias(c) for c, x in (("all_look", look), ("all_content", content))])
    at_host = counted.groupBy("host", "node").agg(*sums, F.sum("chars").alias("chars"), (of(0, n * F.col("prior")) / of(0, n)).alias("prior"), F.min("chain").alias("chain"))
    blend = lambda x, everywhere_: ((F.col("pages") - 1) * F.coalesce(x, F.lit(0.0)) + SHARED_PAGES * F.col(everywhere_)) / (F.col("pages") - 1 + SHARED_PAGES)
    nodes = at_host.join(at_all, F.col("node") == F.col("all_node")).withColumns({"look": blend(look, "all_look"), "words": blend(content, "all_content")})
    nodes = nodes.withColumn("own", F.when(F.col("texts") > 0, (1 - TEXT_WEIGHT) * F.col("look") + TEXT_WEIGHT * F.col("words")).otherwise(F.col("look")))
    # every node speaks for each branch that it is part of
    up = nodes.select("host", "node", "pages", "prior", "look", "own", "chars", F.explode(F.when(F.size("chain") > 0, F.col("chain")).otherwise(F.array("node"))).alias("branch"))
    self_ = lambda c: F.max(F.when(F.col("node") == F.col("branch"), F.col(c)))
    tree = up.groupBy("host", F.col("branch").alias("node")).agg(*[self_(c).alias(c) for c in ("pages", "prior", "look", "own")], F.sum("chars").alias("chars"), F.sum(F.col("chars") * F.col("own")).alias("mass"), F.count("*").alias("below"), F.max(F.when(F.col("chars") > 0, F.col("own") + F.col("prior"))).alias("best"))
    below = F.when(F.col("chars") > 0, OWN_WEIGHT * F.col("look") + (1 - OWN_WEIGHT) * F.col("mass") / F.col("chars")).otherwise(F.col("look"))
    return tree.where("pages is not null").select("host", "node", "prior", F.col("pages").cast("long").alias("pages"), "own", F.when(F.col("below") > 1, below).otherwise(F.col("own")).alias("importance"), "best")


def low_nodes(nodes: DataFrame, least: float = LEAST, clear: float = CLEAR) -> DataFrame:
    """The nodes of style_nodes whose branch goes; never the page itself."""
    return nodes.where((F.col("node") != 0) & (F.col("importance") + F.col("prior") < least) & (F.coalesce("best", F.lit(0.0)) < clear))


def extract(pages: DataFrame, least: float = LEAST, clear: float = CLEAR, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html; others are ignored).

    A null or empty html has an empty text; pages with a null or malformed url are one
    site; broken and very deep nesting is closed as it stands, very long pages are read
    whole; repeated rows get equal results; an empty table stays empty.
    """
    host, _ = host_path(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    low = stored(low_nodes(style_nodes(rows.select("host", "html")), least, clear).groupBy(F.col("host").alias("site")).agg(F.collect_list("node").alias("low")), "style")
    size = low.agg(F.sum(F.size("low"))).first()[0] or 0
    if size <= broadcast_nodes:
        joined = rows.join(F.broadcast(low), F.col("host") == F.col("site"), "left")
    else:
        dealt = low.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        part = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", part).join(dealt, (F.col("host") == F.col("site")) & (F.col("salt") == F.col("part")), "left")

    def run(batches):
        for b in by_bytes(batches, "html", PAGE_BYTES):
            texts = []
            for html, low_ in zip(b.column("html"), b.column("low").to_pylist()):
                gone = set(low_ or ())
                texts.append("\n".join(t for state, t in Page(html.as_py()).blocks if gone.isdisjoint(state[3] or (0,))))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "low").mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of `pages`."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
