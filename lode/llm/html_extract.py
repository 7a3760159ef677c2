"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block is a vector: its tag path and its words, hashed, and
a few measures. A bidirectional LSTM in numpy reads the whole sequence, so that a block is classed in
the context of the document. The labeller is trained, by one task, on made-up pages with known main text; the
blocks that it classes as main text are joined by newlines.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches
from .html_blocks import PATH_BITS, Block, blocks, bucket
from .html_pages import Maker

WORD_BITS, MEASURES = 48, 8
WIDTH = PATH_BITS + WORD_BITS + MEASURES
HIDDEN = 20
SEED = 7
STEPS = 260
BATCH = 24
#: Blocks labelled together, about; a longer page is labelled alone.
GROUP = 4_096
_known: dict[tuple[str, int], Labeller] = {}


def vectors(page: list[Block]) -> np.ndarray:
    """One row per block: hashed tag path, all its hashed words, measures."""
    x = np.zeros((len(page), WIDTH), np.float32)
    raw = b"".join(b.path.to_bytes(PATH_BITS // 8, "little") for b in page)
    x[:, :PATH_BITS] = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(page), -1), axis=1, bitorder="little")
    for i, b in enumerate(page):
        words = b.text.lower().split()
        n = len(words)
        share = np.bincount([bucket(w, WORD_BITS) for w in words], minlength=WORD_BITS) / n
        x[i, PATH_BITS : PATH_BITS + WORD_BITS] = np.minimum(share, 0.25)  # a block may be one word over and over
        x[i, PATH_BITS + WORD_BITS :] = (np.log1p(n) / 4, np.log1p(len(b.text)) / 6, b.linked, b.text[-1] in ".!?\"", min(b.depth, 64) / 8, i / len(page), min(i, 8) / 8, n < 4)
    return x


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _lstm(x: np.ndarray, live: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """(time, pages, width) -> (time, pages, hidden); rows past a page's end leave its state alone."""
    t, n, _ = x.shape
    hid = len(u)
    gates_in = x.reshape(t * n, -1) @ w
    gates_in = gates_in.reshape(t, n, 4 * hid) + b
    h, c = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
    out = np.zeros((t, n, hid), np.float32)
    for k in range(t):
        g = gates_in[k] + h @ u
        i, f, o = np.split(_sigmoid(g[:, : 3 * hid]), 3, 1)
        z = np.tanh(g[:, 3 * hid :])
        m = live[k][:, None]
        new_c = m * (f * c + i * z) + (1 - m) * c
        tc = np.tanh(new_c)
        new_h = m * (o * tc) + (1 - m) * h
        if keep is not None:
            keep.append((i, f, o, z, c, tc, h, m))
        h, c = new_h, new_c
        out[k] = h
    return out


def _lstm_back(d_out: np.ndarray, x: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of w, u and b."""
    t, n, hid = d_out.shape
    dg_all = np.zeros((t, n, 4 * hid), np.float32)
    dh_next, dc_next, du = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32), np.zeros_like(u)
    for k in range(t - 1, -1, -1):
        i, f, o, z, c, tc, h, m = kept[k]
        dh = d_out[k] + dh_next
        dc = m * dh * o * (1 - tc**2) + dc_next
        dg = np.concatenate([m * dc * z * i * (1 - i), m * dc * c * f * (1 - f), m * dh * tc * o * (1 - o), m * dc * i * (1 - z**2)], 1)
        dg_all[k] = dg
        du += h.T @ dg
        dh_next = dg @ u.T + (1 - m) * dh
        dc_next = m * dc * f + (1 - m) * dc
    return x.reshape(t * n, -1).T @ dg_all.reshape(t * n, -1), du, dg_all.sum((0, 1))


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, live = np.zeros((t, len(pages), WIDTH), np.float32), np.zeros((t, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], live[: len(p), j] = p, 1
    return x, live


class Labeller:
    """Two LSTMs, one from each end, and a logistic output per block."""

    def __init__(self, seed: int = SEED, hidden: int = HIDDEN):
        r = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {"v": r.normal(0, 0.3, 2 * hidden).astype(np.float32), "a": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": r.normal(0, 0.15, (WIDTH, 4 * hidden)).astype(np.float32), f"u{d}": r.normal(0, 0.15, (hidden, 4 * hidden)).astype(np.float32), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1

    def _forward(self, x: np.ndarray, live: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        p = self.p
        f = _lstm(x, live, p["wf"], p["uf"], p["bf"], keep and keep[0])
        b = _lstm(x[::-1], live[::-1], p["wb"], p["ub"], p["bb"], keep and keep[1])[::-1]
        h = np.concatenate([f, b], 2)
        return h, _sigmoid(h @ p["v"] + p["a"])

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for each block of each page (pages have a block at least)."""
        x, live = _padded(pages)
        _, y = self._forward(x, live)
        return [y[: len(p), j] for j, p in enumerate(pages)]

    def train(self, seed: int = SEED, steps: int = STEPS, batch: int = BATCH, rate: float = 0.01) -> Labeller:
        maker, hid = Maker(seed), len(self.p["uf"])
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            data = []
            while len(data) < batch:
                page, truth = maker.page()
                found = blocks(page)
                if [b.text for b in found] == [t for t, _ in truth]:
                    data.append((vectors(found), np.array([y for _, y in truth], np.float32)))
            x, live = _padded([d[0] for d in data])
            y = np.zeros_like(live)
            for j, (_, t) in enumerate(data):
                y[: len(t), j] = t
            kept: tuple[list, list] = ([], [])
            h, got = self._forward(x, live, kept)
            d = (got - y) * live / live.sum()
            dh = d[:, :, None] * self.p["v"]
            g = {"v": np.tensordot(d, h, ((0, 1), (0, 1))), "a": d.sum(keepdims=True).reshape(1)}
            g["wf"], g["uf"], g["bf"] = _lstm_back(dh[:, :, :hid], x, self.p["uf"], kept[0])
            g["wb"], g["ub"], g["bb"] = _lstm_back(dh[::-1, :, hid:], x[::-1], self.p["ub"], kept[1])
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            pace = rate * (1 - 0.9 * step / steps)
            for k, v in g.items():
                v = v / max(1.0, norm)
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v**2
                self.p[k] = (self.p[k] - pace * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


@functools.lru_cache(maxsize=2)
def trained(seed: int = SEED) -> Labeller:
    """The labeller, trained once in a process; the same weights for the same seed."""
    return Labeller(seed).train(seed)


def trained_by(spark: SparkSession, seed: int = SEED) -> Labeller:
    """The labeller, trained by one task on an executor, once an application; the driver gets its weights, some hundred kB."""
    key = spark.sparkContext.applicationId, seed
    if key not in _known:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    p = trained(seed).p
                    flat = [v.astype("<f4").tobytes() for v in p.values()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(p), pa.string()), pa.array([list(v.shape) for v in p.values()], pa.list_(pa.int64())), pa.array(flat, pa.binary())], names=["name", "shape", "data"])

        rows = spark.range(0, 1, 1, 1).mapInArrow(run, "name string, shape array<long>, data binary").collect()
        labeller = Labeller(seed)
        labeller.p = {r["name"]: np.frombuffer(bytes(r["data"]), "<f4").reshape(r["shape"]) for r in rows}
        _known[key] = labeller
    return _known[key]


def main_texts(pages: list[str | None], labeller: Labeller) -> list[str]:
    """The main text of each page; pages are labelled in groups of similar length."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        till, most = at + 1, len(found[order[at]])
        while till < len(order) and max(most, len(found[order[till]])) * (till + 1 - at) <= GROUP:
            most = max(most, len(found[order[till]]))
            till += 1
        group = order[at:till]
        for i, y in zip(group, labeller.label([vectors(found[i]) for i in group]), strict=True):
            out[i] = "\n".join(b.text for b, v in zip(found[i], y, strict=True) if v >= 0.5)
        at = till
    return out


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """(page_id, url, html, ...) -> page_id, url, text, n_chars: one row per input row.

    Null or empty html, and pages without a block of main text, have the empty text. Repeated rows
    get equal texts; an empty table gives an empty result. page_id and url are passed on as they are,
    null or not. Every block of a page and every word of a block is read, in time in proportion to the
    page; a page of more than GROUP blocks is labelled by itself. Other columns are not read, whatever
    their names.
    """
    arrow_batches(pages.sparkSession, 500)
    held = pages.sparkSession.sparkContext.broadcast(labeller or trained_by(pages.sparkSession))  # some hundred kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = main_texts(b.column(2).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
