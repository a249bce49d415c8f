"""Main-text extraction: boosted trees over DOM nodes, decoded over the hierarchy.

Every block element is described by its subtree's text, link and punctuation densities, its
attribute tokens and tag and those of its ancestors, its depth and its siblings. Gradient-boosted
trees (Spark ML) give each its log odds of holding main text. They are fitted on ``TRAIN_PAGES``
generated pages whose layouts mix semantic and class-named markup. Decoding maximises the sum of
log odds over the tree, where everything below a dropped element is dropped as well: no element is
kept inside one that is not. The texts that stand directly in kept elements are the main text.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanweave.llm.common import arrow_schema, for_tasks, record_batch
from loanweave.llm.dom import Page, parse
from loanweave.storage import fresh_path, written

TRAIN_PAGES, TREES, DEPTH = 1500, 24, 5  # bounds of the model and of what it is fitted on
PAGES_PER_CALL = 64

# Parts of class, id and role values that speak for main text or against it.
FOR = ("article", "content", "post", "story", "entry", "main", "text", "prose", "body")
AGAINST = (
    "nav", "menu", "header", "footer", "sidebar", "aside", "advert", "banner", "promo", "sponsor",
    "notice", "cookie", "consent", "alert", "popup", "modal", "comment", "reply", "discuss", "form",
    "login", "search", "subscribe", "newsletter", "share", "social", "related", "recommend",
    "breadcrumb", "widget", "toolbar", "copyright", "legal", "pagination", "complementary",
)
SHORT_AGAINST = frozenset(["ad", "ads", "adv", "ad-slot", "adbox", "ad-unit", "nav", "toc", "rail"])
BOILER_TAGS = frozenset(
    "nav header footer aside form dialog menu button select label fieldset option input textarea".split()
)
MAIN_TAGS = frozenset(["article", "main"])
TEXT_TAGS = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 figcaption".split())
LIST_TAGS = frozenset("ul ol li dl dt dd".split())
PUNCTUATION = ".,;:!?"
FEATURES = 25


def _speaks(names: str) -> tuple[int, int]:
    """How many attribute tokens speak for and against main text."""
    good = bad = 0
    for token in names.split():
        if token in SHORT_AGAINST or token.startswith(("ad-", "ad_", "ads-")) or any(w in token for w in AGAINST):
            bad += 1
        elif any(w in token for w in FOR):
            good += 1
    return good, bad


def describe(page: Page) -> np.ndarray:
    """Features of every element, in page order."""
    tags, parents = page.tags, page.parents
    n = len(tags)
    chars, linked, marks, own, words = ([0] * n for _ in range(5))
    for node, text, link in page.texts:
        if node >= 0:
            size = len(text) - text.count(" ")
            own[node] += size
            chars[node] += size
            words[node] += text.count(" ") + 1 if size else 0
            marks[node] += sum(map(text.count, PUNCTUATION))
            if link:
                linked[node] += size
    below, children = [1] * n, [[] for _ in range(n)]
    for node in range(n - 1, 0, -1):
        up = parents[node]
        chars[up] += chars[node]
        linked[up] += linked[node]
        marks[up] += marks[node]
        words[up] += words[node]
        below[up] += below[node]
        children[up].append(node)
    depth, place = [0] * n, [0.0] * n
    good, bad, boiler, main = ([0] * n for _ in range(4))
    out = np.zeros((n, FEATURES))
    log = math.log1p
    for node in range(n):
        up, tag = parents[node], tags[node]
        own_good, own_bad = _speaks(page.names[node]) if page.names[node] else (0, 0)
        is_boiler, is_main = tag in BOILER_TAGS, tag in MAIN_TAGS
        if up >= 0:
            depth[node] = depth[up] + 1
            good[node], bad[node] = good[up] + own_good, bad[up] + own_bad
            boiler[node], main[node] = boiler[up] + is_boiler, main[up] + is_main
        total = chars[node]
        out[node] = (
            depth[node], log(total), linked[node] / total if total else 0.0, total / (chars[0] or 1),
            log(own[node]), log(len(children[node])), log(total / below[node]),
            marks[node] / words[node] if words[node] else 0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
            own_good, own_bad, good[node] - own_good, bad[node] - own_bad, is_boiler, is_main,
            tag in TEXT_TAGS, tag in LIST_TAGS, tag == "div" or tag == "section",
            boiler[node] - is_boiler, main[node] - is_main, log(words[node]),
        )
    for inside in children:
        inside.reverse()
        count = len(inside)
        for i, node in enumerate(inside):
            before = chars[inside[i - 1]] if i else 0
            after = chars[inside[i + 1]] if i + 1 < count else 0
            alike = sum(tags[x] == tags[node] for x in inside[max(0, i - 8) : i + 9])
            out[node, 8:13] = (
                i / count, log(count), alike / min(count, 17), log(before), log(after),
            )
    return out


def keep(page: Page, odds: np.ndarray) -> list[bool]:
    """The choice of elements with the largest sum of log odds among those in which nothing is
    kept below a dropped element; the page itself is kept."""
    n, parents = len(page.tags), page.parents
    kept_value = odds.tolist()
    dropped_value = [-x for x in kept_value]
    for node in range(n - 1, 0, -1):
        up = parents[node]
        kept_value[up] += max(kept_value[node], dropped_value[node])
        dropped_value[up] += dropped_value[node]
    chosen = [True] * n
    for node in range(1, n):
        chosen[node] = chosen[parents[node]] and kept_value[node] >= dropped_value[node]
    return chosen


def main_text(page: Page, chosen: list[bool]) -> str:
    """Texts of the kept elements: white space as one space, blocks joined by one space."""
    return " ".join("".join([" " if e < 0 else t if chosen[e] else "" for e, t, _ in page.texts]).split())


class Forest:
    """Boosted trees as arrays: evaluated for many rows at once."""

    def __init__(self, trees: list[tuple[float, list]]) -> None:
        self.trees = []
        for weight, nodes in trees:
            at = {node["id"]: i for i, node in enumerate(nodes)}
            column = [max(0, x["feature"]) for x in nodes]
            limit = [x["limit"] if x["feature"] >= 0 else np.inf for x in nodes]
            left = [at.get(x["left"], i) for i, x in enumerate(nodes)]
            right = [at.get(x["right"], i) for i, x in enumerate(nodes)]
            values = [weight * x["value"] for x in nodes]
            self.trees.append(tuple(map(np.array, (column, limit, left, right, values))))

    def odds(self, rows: np.ndarray) -> np.ndarray:
        """Log odds; Spark's boosted classifier has half of it as its margin."""
        total, index = np.zeros(len(rows)), np.arange(len(rows))
        for column, limit, left, right, values in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = np.where(rows[index, column[node]] <= limit[node], left[node], right[node])
            total += values[node]
        return 2 * total


def training_rows(spark: SparkSession, pages: int = TRAIN_PAGES) -> DataFrame:
    """Features and label of all elements with text of ``pages`` generated pages: 1 if there is
    main text in the element."""
    schema = arrow_schema("label double, raw array<double>")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                page = parse(training_page(number))
                features, has = describe(page), [0] * len(page.tags)
                for node, text, _ in page.texts:
                    if node >= 0 and text.strip():
                        up = node
                        while up > 0 and not page.gold[up]:
                            up = page.parents[up]
                        has[node] += page.gold[up] == "c"
                for node in range(len(has) - 1, 0, -1):
                    has[page.parents[node]] += has[node]
                used = np.flatnonzero(features[:, 1] > 0)
                yield record_batch(
                    [[float(has[i] > 0) for i in used], list(features[used])], schema
                )

    return for_tasks(spark.range(0, pages, 1, 4)).mapInArrow(build, "label double, raw array<double>")


def fit(spark: SparkSession, pages: int = TRAIN_PAGES) -> Forest:
    """The forest; its trees, of bounded number and depth, come to the driver."""
    rows = written(training_rows(spark, pages).select("label", array_to_vector("raw").alias("features")), "html-train")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, maxBins=64).fit(rows)
    path = fresh_path(spark, "html-model")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", F.col("nodeData.prediction").alias("value"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("limit"),
    )
    trees: dict[int, list] = {}
    for row in nodes.orderBy("treeID", "id").collect():
        trees.setdefault(row["treeID"], []).append(row.asDict())
    return Forest([(weight, trees[i]) for i, weight in enumerate(model.treeWeights)])


def extract(pages: DataFrame, forest: Forest | None = None) -> DataFrame:
    """The main text of every row's whole html: page_id, url, text, n_chars (code points).

    A null or empty html, or one without main text, gives an empty text. Rows are treated each on
    their own, whatever their ids; other columns are not read. An empty table gives no rows.
    """
    forest = forest or fit(pages.sparkSession)
    schema = arrow_schema("page_id long, url string, text string, n_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_PER_CALL):
                part = batch.slice(at, PAGES_PER_CALL)
                parsed = [parse(source or "") for source in part.column(2).to_pylist()]
                rows = [describe(page) for page in parsed]
                odds = np.split(forest.odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                texts = [main_text(page, keep(page, x)) for page, x in zip(parsed, odds)]
                yield record_batch([part.column(0), part.column(1), texts, [len(t) for t in texts]], schema)

    rows = for_tasks(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


# Generated pages for training ---------------------------------------------------------------------

_SYLLABLES = "an be co da en fi ga ho in ka le mi no or pa re si ta un ve é ü ß ñ".split()


class _Writer:
    """A random page; what belongs to the main text is marked with data-gold."""

    def __init__(self, number: int) -> None:
        self.draw = random.Random(number)
        self.semantic = self.draw.random() < 0.6
        self.marks = self.draw.choice([0, 0, 0, 0, 1])  # prose full of odd marks

    def words(self, low: int, high: int) -> str:
        draw, out = self.draw, []
        for _ in range(draw.randint(low, high)):
            word = "".join(draw.choices(_SYLLABLES, k=draw.randint(1, 4)))
            out.append(word + draw.choice(["", "", "", "", ",", "."] if not self.marks else ["***", "%%%", "&amp;&amp;", "|", ""]))
        return " ".join(out).capitalize() + draw.choice([".", ".", ""])

    def box(self, tag: str, name: str, inside: str, gold: str = "") -> str:
        """An element by its own tag, or a div named after it."""
        mark = f' data-gold="{gold}"' if gold else ""
        draw = self.draw
        shown = draw.choice([name, f"site-{name}", f"{name}-wrap", f"page_{name}"])
        kind = draw.choice(["class", "class", "id"])
        if self.semantic and draw.random() < 0.8:
            extra = f' {kind}="{shown}"' if draw.random() < 0.3 else ""
            return f"<{tag}{extra}{mark}>{inside}</{tag}>"
        return f'<div {kind}="{shown}"{mark}>{inside}</div>'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(self.draw.randint(low, high))]
        if self.draw.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return " ".join(items)

    def article(self) -> str:
        draw, parts = self.draw, []
        title = f"<h1>{self.words(*draw.choice([(1, 1), (1, 3), (2, 20)]))}</h1>"
        parts.append(title if draw.random() < 0.8 else f"<header>{title}</header>")
        for _ in range(draw.choice([0, 1, 1, 2, 3, 5, 8, 14])):
            kind, text = draw.random(), self.words(*draw.choice([(1, 1), (1, 4), (5, 40), (30, 120)]))
            if kind < 0.6:
                parts.append(f"<p>{text}</p>")
            elif kind < 0.75:
                parts.append(f"<p><b>{text}<br>")
            elif kind < 0.82:
                parts.append(f"<h2>{self.words(1, 6)}</h2>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{self.words(3, 15)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.96:
                parts.append(f'<p>{text} <a href="/x">{self.words(1, 3)}</a> {self.words(2, 9)}</p>')
            else:
                parts.append(draw.choice([self.advert, self.share])())
        tag, name = draw.choice([("article", "article"), ("article", "post-content"), ("main", "main-content"), ("section", "entry-text"), ("article", "story-body")])
        return self.box(tag, name, "".join(parts), "c")

    def advert(self) -> str:
        name = self.draw.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "banner", "promo"])
        inside = self.words(*self.draw.choice([(3, 12), (10, 40)]))
        if self.draw.random() < 0.4:
            inside = f"<p>{inside}</p>"
        return f'<div class="{name}" data-gold="b">{inside}</div>'

    def share(self) -> str:
        return f'<div class="{self.draw.choice(["share", "social-links", "related"])}" data-gold="b">{self.links(2, 5)}</div>'

    def notice(self) -> str:
        name = self.draw.choice(["notice", "cookie-notice", "consent", "alert"])
        return f'<div class="{name}" data-gold="b"><p>{self.words(8, 40)}</p>{"<button>" + self.words(1, 2) + "</button>" if self.draw.random() < 0.5 else ""}</div>'

    def comments(self) -> str:
        each = "".join(
            f'<div class="{self.draw.choice(["comment", "reply", "comment-body"])}"><p>{self.words(4, 60)}</p></div>'
            for _ in range(self.draw.randint(1, 6))
        )
        return self.box("section", "comments", f"<h3>{self.words(1, 2)}</h3>{each}", "b")

    def form(self) -> str:
        inside = f'<label>{self.words(1, 3)}</label><input name="q"><button>{self.words(1, 2)}</button>'
        name = self.draw.choice(["search", "login", "newsletter"])
        return f'<form class="{name}-form" data-gold="b">{self.words(0, 12)}{inside}</form>'

    def page(self) -> str:
        draw = self.draw
        some = lambda chance, part: [part()] if draw.random() < chance else []
        header = lambda: self.box("header", "header", f"<h2>{self.words(1, 4)}</h2>" + (self.links(3, 7) if draw.random() < 0.5 else ""), "b")
        nav = lambda: self.box("nav", draw.choice(["nav", "menu", "breadcrumbs"]), self.links(3, 9), "b")
        aside = lambda: self.box("aside", draw.choice(["sidebar", "related", "widget"]), draw.choice([self.links(3, 8), f"<h3>{self.words(1, 3)}</h3><p>{self.words(5, 40)}</p>"]), "b")
        footer = lambda: self.box("footer", "footer", draw.choice([f"&copy; {self.words(3, 20)}", f"<p>{self.words(4, 25)}</p>", self.links(2, 6)]), "b")
        before = some(0.5, header) + some(0.8, nav) + some(0.2, self.notice) + some(0.5, self.advert) + some(0.2, self.form)
        middle = [self.article()] + some(0.3, aside)
        if draw.random() < 0.3:
            middle.reverse()
        after = some(0.2, self.advert) + some(0.35, self.comments) + some(0.2, self.form) + some(0.85, footer)
        body = "".join(before) + "".join(middle) + "".join(after)
        if draw.random() < 0.4:
            name = draw.choice(["wrapper", "container", "page", "layout"])
            body = f'<div class="{name}">{body}</div>'
        if draw.random() < 0.2:
            body = f'<main>{body}</main>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{body}</body></html>"


def training_page(number: int) -> str:
    return _Writer(number).page()
