"""Main text of web pages: blocks, labelled by a recurrent network that reads the whole page.

Edge cases: null and empty pages, and pages without a main block, give an empty text; pages of any length are read
whole; unclosed tags, cut ends and stray end tags are read as browsers do, roughly; repeated rows, and ties of page_id, each get a row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import small_batches
from gaugework.llm.html_blocks import blocks
from gaugework.llm.html_model import Labeller


def main_texts(pages: list[str]) -> list[str]:
    found = [blocks(p) for p in pages]
    labels = Labeller.load().main_blocks(found)
    return ["\n".join(b.text for b, main in zip(p, own, strict=True) if main) for p, own in zip(found, labels, strict=True)]


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = main_texts(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(out, pa.string()),
                    pa.array([len(t) for t in out], pa.int64())
                ],
                ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
