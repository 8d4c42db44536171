"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Every leaf block of a page is main text or not. A block's score is the sum of the weights of its
features (ancestor tags and their classes, length, links, punctuation, cue phrases), and neighbouring
labels have weights too. The weights maximise the regularised conditional likelihood of labelled
pages (``html_labels``), found by gradient steps with forward-backward sums; a page is decoded by
Viterbi. The main text is the blocks so labelled, in page order, joined by one space.

The model is trained once per driver on a fixed number of composed pages (a few thousand blocks) and
has about a hundred numbers; the pages of the table are only read, one at a time, and never shuffled.

Defined cases: a null or empty page has an empty text; so has a page without main text. Rows with null
or repeated page_id are extracted one by one. Text outside any markup is one block. An empty table
gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.html_blocks import FEATURES, blocks
from riskweave.llm.html_labels import labelled_pages

TRAINING_PAGES, STEPS, RATE, PENALTY = 600, 150, 0.1, 1e-3


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(weights of features by label, weights of label pairs) from marked pages."""
    parsed = [p for p in map(blocks, pages) if p]
    length = np.array([len(p) for p in parsed])
    n, longest, width = len(parsed), int(length.max()), len(FEATURES)
    x = np.zeros((n, longest, width))
    y = np.zeros((n, longest), dtype=np.int64)
    for i, page in enumerate(parsed):
        for t, (_, found, main) in enumerate(page):
            x[i, t, found] = 1
            y[i, t] = main
    here = np.arange(longest)[None, :] < length[:, None]
    labels = np.eye(2)[y] * here[:, :, None]
    pairs = labels[:, :-1, :, None] * labels[:, 1:, None, :]
    weights, moves = np.zeros((width, 2)), np.zeros((2, 2))
    memory = [np.zeros_like(v) for v in (weights, weights, moves, moves)]
    for step in range(1, STEPS + 1):
        score = x @ weights
        ahead, back = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            new = score[:, t] + _log_sum(ahead[:, t - 1, :, None] + moves[None], axis=1)
            ahead[:, t] = np.where(here[:, t, None], new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _log_sum(moves[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(here[:, t + 1, None], new, 0.0)
        total = _log_sum(ahead[:, -1], axis=1)[:, None]
        single = np.exp(ahead + back - total[:, :, None]) * here[:, :, None]
        double = np.exp(ahead[:, :-1, :, None] + moves[None, None]
                        + (score[:, 1:] + back[:, 1:])[:, :, None, :]
                        - total[:, :, None, None]) * here[:, 1:, None, None]
        slopes = (np.tensordot(x, labels - single, axes=([0, 1], [0, 1])) / n - PENALTY * weights,
                  (pairs - double).sum(axis=(0, 1)) / n - PENALTY * moves)
        for k, (value, slope) in enumerate(zip((weights, moves), slopes)):
            first, second = memory[2 * k], memory[2 * k + 1]
            first += 0.1 * (slope - first)
            second += 0.01 * (slope ** 2 - second)
            value += RATE * (first / (1 - 0.9 ** step)) / (
                np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return weights, moves


@cache
def model() -> tuple[np.ndarray, np.ndarray]:
    """Weights learned from the composed pages."""
    return train(labelled_pages(TRAINING_PAGES, seed=7))


def viterbi(scores: list[tuple[float, float]], moves) -> list[int]:
    """Most likely labels of a page; ties go to label 0."""
    (m00, m01), (m10, m11) = moves
    best0, best1 = scores[0]
    back = []
    for s0, s1 in scores[1:]:
        to0, to1 = best1 + m10 > best0 + m00, best1 + m11 > best0 + m01
        back.append((to0, to1))
        best0, best1 = (s0 + (best1 + m10 if to0 else best0 + m00),
                        s1 + (best1 + m11 if to1 else best0 + m01))
    label = int(best1 > best0)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return out[::-1]


def extract(html: str | None, weights: list[tuple[float, float]], moves) -> tuple[str, int, int]:
    """(main text, blocks, blocks of main text) of one page."""
    found = blocks(html) if html else []
    if not found:
        return "", 0, 0
    scores = [(sum(weights[f][0] for f in features), sum(weights[f][1] for f in features))
              for _, features, _ in found]
    labels = viterbi(scores, moves)
    text = " ".join(value for (value, _, _), label in zip(found, labels) if label)
    return text, len(found), sum(labels)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) of every page."""
    weights, moves = model()
    pair = [tuple(map(float, w)) for w in weights]
    step = moves.tolist()

    def run(batches):
        for batch in batches:
            rows = [extract(x.as_py(), pair, step) for x in batch.column(2)]
            texts = [r[0] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64()),
                 pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
