"""Document quality from a linear-chain conditional random field over lines.

Every line gets a label, good or bad, from features of its own and of the lines beside it. The chain's
forward-backward marginals of "good", weighted by line length, are a document's raw quality; a logistic
calibration turns that into the score.

Lines carry no labels of their own; they are latent. The field first takes each line to be as its document, then
goes on with what it expects of the lines given that a document's label speaks for each of its lines with odds of
``TRUST``: so a good text may hold bad lines, and neighbours learn from where labels change. Gradient steps on at
most ``SAMPLE_DOCS`` labelled documents, chosen by a hash of their ids; only line features come to the driver, of texts
with more than ``BLOCK_LINES`` lines those of one run of lines (placed by a hash of the text) with their true neighbours.
Scoring reads every whole text, however long, line by line.

Null and empty texts are one empty line and get a score as well; null ids or labels are not learned from; of
repeated labels the smallest counts; with fewer than two classes to learn from, every score is the share of
good labels (0.5 without any). Repeated rows are scored alike; a score that ties with the threshold is kept; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log
from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import map_batches

SAMPLE_DOCS = 2000
BLOCK_LINES = 400
TRUST = 20.0
THRESHOLD = 0.3
STEPS = 200
LATENT_STEPS = 80
SYMBOLS = "#*$%&|<>"
#: Own features of a line; the line before and the line after contribute the same ones.
FEATURES = ("empty", "length", "word_len", "unlike", "repeated", "upper", "title", "symbols", "exclaims", "stops", "numbers", "seen")
WIDE = 3 * len(FEATURES) + 1


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, lengths) of a text."""
    rows, lengths, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = line.split()
        n = len(words)
        lengths.append(len(line))
        if not n:
            rows.append((1.0,) + (0.0,) * (len(FEATURES) - 1))
            continue
        rows.append((
            0.0, log(1 + n) / 5, min(len(line) / n, 20) / 10, len(set(words)) / n,
            sum(map(eq, words, words[1:])) / n, sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n,
            min(sum(map(line.count, SYMBOLS)) / n, 3), min(line.count("!") / n, 2),
            min((line.count(".") + line.count(",")) / n, 1), sum(map(str.isnumeric, words)) / n, float(line in seen),
        ))
        seen.add(line)
    return np.array(rows, np.float32), np.array(lengths, np.int64)


def widen(own: np.ndarray) -> np.ndarray:
    """Features of each line, of the line before and of the line after, and a constant."""
    edge = np.zeros((1, own.shape[1]), own.dtype)
    edge[0, 0] = 1.0
    before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
    return np.concatenate([own, before, after, np.ones((len(own), 1), own.dtype)], axis=1)


def marginals(node: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """P(good) of each line of a chain, by forward-backward.

    ``node`` holds each line's log-odds of good, ``pair`` the 2 x 2 log-weights of neighbouring labels.
    """
    n = len(node)
    (bb, bg), (gb, gg) = np.exp(pair - pair.max()).tolist()
    good = np.clip(node, -30, 30).tolist()
    ahead = [0.0] * n  # log-odds of good from the lines up to here
    held = ahead[0] = good[0]
    for i in range(1, n):
        x = exp(held)
        held = ahead[i] = min(max(log((x * gg + bg) / (x * gb + bb)) + good[i], -60.0), 60.0)
    out = [0.0] * n
    back = 0.0  # log-odds of good from the lines after this one
    for i in range(n - 1, -1, -1):
        out[i] = 1 / (1 + exp(-(ahead[i] + back)))
        x = exp(min(max(good[i] + back, -60.0), 60.0))
        back = log((x * gg + gb) / (x * bg + bb))
    return np.array(out)


@dataclass
class Field:
    """A fitted field: feature weights, label-pair weights, and the calibration of a document's quality."""

    weights: np.ndarray
    pair: np.ndarray
    slope: float
    shift: float

    def quality(self, text: str | None) -> float:
        """Length-weighted marginal of good over the lines."""
        own, lengths = line_features(text)
        p = marginals(widen(own) @ self.weights, self.pair)
        size = np.maximum(lengths, 1)
        return float((p * size).sum() / size.sum())

    def score(self, text: str | None) -> float:
        return calibrated(self.quality(text), self.slope, self.shift)


def calibrated(quality: float, slope: float, shift: float) -> float:
    q = min(max(quality, 1e-4), 1 - 1e-4)
    return 1 / (1 + exp(-min(max(slope * log(q / (1 - q)) + shift, -30.0), 30.0)))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, steps: int = STEPS, latent: int = LATENT_STEPS) -> Field:
    """Maximises the chains' likelihood; ``docs`` are (wide features, lengths), ``good`` their labels.

    The last ``latent`` steps take the lines' labels as hidden behind their document's.

    Chains run side by side, padded to the longest; forward-backward goes over positions. Each document weighs
    the same, spread over its lines by length.
    """
    if len(docs) == 0 or good.min() == good.max():
        share = float(good.mean()) if len(docs) else 0.5
        return Field(np.zeros(WIDE), np.zeros((2, 2)), 0.0, log(min(max(share, 1e-3), 1 - 1e-3) / (1 - min(max(share, 1e-3), 1 - 1e-3))))
    order = sorted(range(len(docs)), key=lambda i: len(docs[i][0]))
    groups = [order[at : at + 256] for at in range(0, len(order), 256)]
    packs = []
    for group in groups:
        most = max(len(docs[i][0]) for i in group)
        x = np.zeros((len(group), most, WIDE), np.float32)
        mask = np.zeros((len(group), most), bool)
        for row, i in enumerate(group):
            n = len(docs[i][0])
            x[row, :n], mask[row, :n] = docs[i][0], True
        packs.append((x, mask, good[group].astype(np.float64), 1 / mask.sum(1)))
    weights, pair = np.zeros(WIDE), np.zeros((2, 2))
    theta = np.zeros(WIDE + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + latent + 1):
        weights, pair = theta[:WIDE], theta[WIDE:].reshape(2, 2)
        grad = np.zeros_like(theta)
        for x, mask, y, share in packs:
            node = x @ weights
            p, both = _expect(node, mask, pair)
            scale = share / len(docs)
            if step <= steps:
                held = np.broadcast_to(y[:, None], p.shape)
                seen = mask[:, 1:].sum(1)[:, None, None] * np.stack([np.diag([1 - v, v]) for v in y])
            else:
                held, seen = _expect(node + log(TRUST) * (2 * y[:, None] - 1), mask, pair)
            grad[:WIDE] += np.einsum("dl,dlf->f", (np.where(mask, held - p, 0) * scale[:, None]), x)
            grad[WIDE:] += ((seen - both) * scale[:, None, None]).sum(0).ravel()
        grad -= 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    made = Field(theta[:WIDE].copy(), theta[WIDE:].reshape(2, 2).copy(), 1.0, 0.0)
    raw = []
    for wide, lengths in docs:
        p, size = marginals(wide @ made.weights, made.pair), np.maximum(lengths, 1)
        raw.append((p * size).sum() / size.sum())
    q = np.clip(np.array(raw), 1e-4, 1 - 1e-4)
    z = np.log(q / (1 - q))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic calibration, lightly held at slope 1
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((good - p) * z).sum() - (a - 1.0), (good - p).sum() - 0.1 * b])
        h = np.array([[(w * z * z).sum() + 1.0, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        move = np.linalg.solve(h, g)
        a, b = a + move[0], b + move[1]
        if abs(move).max() < 1e-8:
            break
    made.slope, made.shift = float(max(a, 0.05)), float(b)
    return made


def _expect(node: np.ndarray, mask: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) per line and expected label-pair counts per chain, for padded chains."""
    d, most = node.shape
    e = np.exp(pair - pair.max())
    up = np.exp(np.clip(node, -30, 30))
    local = np.stack([1 / (1 + up), up / (1 + up)], axis=2)
    ahead = np.zeros((d, most, 2))
    ahead[:, 0] = local[:, 0]
    for i in range(1, most):
        a = (ahead[:, i - 1] @ e) * local[:, i]
        ahead[:, i] = np.where(mask[:, i, None], a / a.sum(1, keepdims=True), 0.5)
    back = np.ones((d, most, 2)) / 2
    both = np.zeros((d, 2, 2))
    for i in range(most - 1, 0, -1):
        b = (local[:, i] * back[:, i]) @ e.T
        joint = ahead[:, i - 1, :, None] * e[None] * (local[:, i] * back[:, i])[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        both += np.where(mask[:, i, None, None], joint, 0)
        back[:, i - 1] = np.where(mask[:, i, None], b / b.sum(1, keepdims=True), 0.5)
    p = ahead * back
    return p[:, :, 1] / np.maximum(p.sum(2), 1e-300), both


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS) -> Field:
    """Fits a field on labelled documents (``labels``: doc_id, quality) whose crc32(doc_id) mod 5 is not 0."""
    marked = (
        labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("quality").cast("int").alias("_good")).dropna()
        .where(F.crc32(F.col("_id").cast("string")) % 5 != 0).groupBy("_id").agg(F.min("_good").alias("_good"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    # at most ``sample`` rows of two numbers: a broadcast of proven size
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(marked), "_id").dropDuplicates(["_id"])

    def run(batch):
        own, lengths, lead, tail = [], [], [], []
        for t in batch.column("text").to_pylist():
            f, n = line_features(t)
            spare = len(f) - BLOCK_LINES
            begin = crc32((t or "").encode("utf-8", "surrogatepass")) % (spare + 1) if spare > 0 else 0
            end = min(len(f), begin + BLOCK_LINES)
            lead.append(int(begin > 0))
            tail.append(int(end < len(f)))
            own.append(f[begin - lead[-1] : end + tail[-1]].tobytes())
            lengths.append(n[begin:end].tobytes())
        return {"id": batch.column("_id"), "good": batch.column("_good"), "own": own, "lengths": lengths, "lead": lead, "tail": tail}

    held = sorted(map_batches(rows, run, "id bigint, good int, own binary, lengths binary, lead int, tail int").collect())
    docs_ = []
    for r in held:
        wide = widen(np.frombuffer(r.own, np.float32).reshape(-1, len(FEATURES)))
        docs_.append((wide[r.lead : len(wide) - r.tail], np.frombuffer(r.lengths, np.int64)))
    return fit(docs_, np.array([r.good for r in held], np.float64))


def score(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    run = lambda batch: {"doc_id": batch.column("doc_id"), "score": [field.score(t) for t in batch.column("text").to_pylist()]}
    return map_batches(rows, run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``; texts pass through the scoring task."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(_mask([field.score(t) >= threshold for t in batch.column(text).to_pylist()]))

    return docs.mapInArrow(run, docs.schema)


def _mask(flags: list[bool]):
    import pyarrow as pa

    return pa.array(flags, pa.bool_())
