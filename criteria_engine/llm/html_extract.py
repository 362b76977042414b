"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Each block element is described by its subtree (characters, density of text, links and
punctuation), its tag and the words of its attributes, those of the elements above it,
its depth and its siblings. Boosted trees give the odds that it holds main text; a pass
over the tree picks the elements to keep so that no kept element lies in a dropped one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from criteria_engine.llm import boosting
from criteria_engine.llm.dom import Page, decode, features, parse
from criteria_engine.llm.page_samples import MARK, Drawer
from criteria_engine.llm.tables import slices

SAMPLE_PAGES = 1200
RESULT = "page_id long, url string, text string"


def labelled(html: str) -> tuple[Page, np.ndarray]:
    """A built page without its marks, and which elements hold main text."""
    marked = parse(html)
    wanted = np.zeros(len(marked.tags), bool)
    wanted[[node for node, text, _ in marked.blocks if MARK in text]] = True
    for i in range(len(wanted) - 1, 0, -1):
        wanted[marked.parents[i]] |= wanted[i]
    return parse(html.replace(MARK, "")), wanted


def sample_pages(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of the elements of built pages."""
    drawer, rows, labels, weights = Drawer(seed), [], [], []
    for _ in range(n):
        page, wanted = labelled(drawer.page())
        rows.append(features(page))
        labels.append(wanted)
        weights.append(np.full(len(wanted), 1 / np.sqrt(len(wanted))))
    return np.vstack(rows), np.concatenate(labels).astype(float), np.concatenate(weights)


@lru_cache(maxsize=1)
def model(pages: int = SAMPLE_PAGES, seed: int = 3) -> boosting.Trees:
    return boosting.fit(*sample_pages(pages, seed))


def texts(pages: list[str], trees: boosting.Trees) -> list[str]:
    """The main text of each page, its blocks joined by line breaks."""
    parsed = [parse(html) for html in pages]
    rows = [features(page) for page in parsed]
    gains = np.split(trees.log_odds(np.vstack(rows)), np.cumsum([len(r) for r in rows])[:-1]) if rows else []
    out = []
    for page, gain in zip(parsed, gains):
        kept = decode(page, gain)
        out.append("\n".join(text for node, text, _ in page.blocks if kept[node]))
    return out


def extract(pages: DataFrame, trees: boosting.Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Null and empty pages have empty text, as have pages without an element that seems to
    hold main text. Character references are decoded once. Repeated rows are each
    extracted; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees or model())  # fixed size, some 20 kB
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = texts(batch.column("html").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"]
            )

    return rows.mapInArrow(read, RESULT).withColumn("n_chars", F.length("text").cast("long"))
