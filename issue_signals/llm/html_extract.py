"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

Each element and each run of text of a page is a node with features of its subtree's density, its
attribute tokens and those above it, its depth and its siblings. Trees give the log odds that a node
belongs to the main text (an element: that it holds some). The choice of nodes is the likeliest in
which no node is chosen below one that is not. The trees are fitted on TRAINING_PAGES made pages
whose words come from WORD_PAGES pages of the table; every page of the table is then extracted whole.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issue_signals.llm.boosting import Trees, fit_trees
from issue_signals.llm.common import small_batches
from issue_signals.llm.html_pages import Maker
from issue_signals.llm.html_tree import Page, decode, features, text_of

#: Pages of the table whose words the training pages use, and training pages.
WORD_PAGES, TRAINING_PAGES = 200, 1_000
#: Pages that a tag or token must occur in to have a score, and the weight of an even chance in it.
LEAST_PAGES, PRIOR = 4, 3.0


@dataclass(frozen=True)
class Extractor:
    trees: Trees
    tag_scores: dict[str, float]
    token_scores: dict[str, float]

    def texts(self, pages: list[str | None]) -> list[str]:
        """The main text of each page; empty if there is none."""
        parsed = [Page(html) for html in pages]
        rows = [features(p, self.tag_scores, self.token_scores) for p in parsed]
        odds = self.trees.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
        ends = np.cumsum([len(r) for r in rows])[:-1] if rows else []
        return [text_of(p, decode(p, o)) for p, o in zip(parsed, np.split(odds, ends))]


def labelled(html: str) -> tuple[Page, np.ndarray]:
    """A made page without its marks, and which nodes hold main text."""
    page = Page(html)
    label = np.zeros(len(page.tags), bool)
    for v, text in enumerate(page.texts):
        if text is not None:
            label[v] = "\x01" in text
            page.texts[v] = text.replace("\x01", "").replace("\x02", "").strip()
    for v in range(len(label) - 1, 0, -1):
        label[page.parents[v]] |= label[v]
    return page, label


def _shares(pairs: Iterator[tuple[int, str, bool]]) -> dict[str, float]:
    """The smoothed share of main text among the nodes of each name, if LEAST_PAGES pages have it."""
    counts, pages = defaultdict(lambda: [0, 0]), defaultdict(set)
    for number, name, label in pairs:
        counts[name][label] += 1
        pages[name].add(number)
    return {k: (c[1] + PRIOR / 2) / (c[0] + c[1] + PRIOR) for k, c in counts.items() if len(pages[k]) >= LEAST_PAGES}


def learn(words: list[str], pages: int = TRAINING_PAGES, seed: int = 0) -> Extractor:
    """The same for the same words, pages and seed. Without words the made pages use one."""
    maker = Maker(words or ["text"], seed)
    made = [labelled(maker.page()) for _ in range(pages)]
    tags = _shares((k, page.tags[v], bool(label[v])) for k, (page, label) in enumerate(made) for v in range(1, len(label)))
    tokens = _shares((k, t, bool(label[v])) for k, (page, label) in enumerate(made) for v in range(1, len(label)) for t in page.tokens[v])
    rows = np.concatenate([features(page, tags, tokens)[1:] for page, _ in made])
    labels = np.concatenate([label[1:] for _, label in made])
    return Extractor(fit_trees(rows, labels.astype(float)), tags, tokens)


def trained(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> Extractor:
    """Fitted in one task on words of the WORD_PAGES pages with the smallest hashed ids."""
    small_batches(pages.sparkSession)
    key = F.col(f"`{id_col}`")
    few = pages.select(F.xxhash64(key).alias("at"), key.cast("string").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html"))
    few = few.filter("html is not null").orderBy("at", "id", F.xxhash64("html")).limit(WORD_PAGES).repartition(1)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(b.column("at").to_pylist(), b.column("id").to_pylist(), b.column("html").to_pylist()))
        words = [w for _, _, html in rows for t in Page(html).texts if t for w in t.split(" ")]
        model = learn(words)
        fields = pickle.dumps((vars(model.trees), model.tag_scores, model.token_scores))
        yield pa.RecordBatch.from_arrays([pa.array([fields], pa.binary())], names=["model"])

    trees, tags, tokens = pickle.loads(few.mapInArrow(fit, "model binary").first()[0])
    return Extractor(Trees(**trees), tags, tokens)


def extracted(pages: DataFrame, model: Extractor, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text. Null or empty html, and a page without main text, give
    the empty text; null ids and urls and repeated rows pass through. An empty table gives no rows."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(model.texts(batch.column("html").to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])

    return rows.mapInArrow(extract, "page_id long, url string, text string")
