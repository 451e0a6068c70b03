"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Each word is an embedding of the word (if the training sample holds it often
enough) beside an embedding of its characters (hashed trigrams).  A forward and
a backward GRU read a window of words, attention pools their states, and a
logistic unit gives the window's probability.  Windows overlap and cover
the whole text; the text's score is its highest window.

Training is plain numpy with hand-written gradients and Adam.  A label belongs
to a text, not to a window, so each round the windows that score highest stand
for their text (multiple-instance learning), beside random ones.

Null, empty and wordless texts score 0.  Repeated rows score alike and are
learnt from once.  Rows with a null doc_id are scored like others; no label
meets them.  A text of any length is scored in pieces of bounded size.  An empty
table gives no rows; without labels of both kinds nothing is toxic.  Other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_buffer, by_bytes, crc_mod, ddl, fresh, mixed, quoted, word_hashes, words

#: Letters, digits and everything beyond ASCII make words.
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True
WINDOW, STRIDE = 32, 24
WORD_DIMS, CHAR_DIMS, HIDDEN, ATTENTION, TRIGRAMS = 8, 12, 8, 8, 4096


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigram ids of all words, where each word's begin); a word is wrapped in spaces."""
    n = ends - starts
    at = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())
    first, last = np.cumsum(n) - n, np.cumsum(n) - 1
    mid = data[at].astype(np.uint64)
    left, right = np.full(len(mid), 32, np.uint64), np.full(len(mid), 32, np.uint64)
    left[1:], right[:-1] = mid[:-1], mid[1:]
    left[first], right[last] = 32, 32
    code = (left << np.uint64(16)) | (mid << np.uint64(8)) | right
    return (mixed(code + np.uint64(1)) % np.uint64(TRIGRAMS)).astype(np.int64), first


class Network:
    """Parameters as float32 arrays, by name."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary  # sorted hashes; row 0 of the embedding is for other words
        d = WORD_DIMS + CHAR_DIMS
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"word": 0.1 * init(len(vocabulary) + 1, WORD_DIMS), "char": rng.standard_normal((TRIGRAMS, CHAR_DIMS)).astype(np.float32) * 0.1}
        self.p["word"] *= np.sqrt(len(vocabulary) + 1, dtype=np.float32)
        for side in "fb":
            self.p |= {f"W{side}": init(d, 3 * HIDDEN), f"U{side}": init(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"Wa": init(2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "va": init(ATTENTION, 1)[:, 0], "wo": init(2 * HIDDEN, 1)[:, 0], "bo": np.full(1, -1, np.float32)}

    def known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, known: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The vectors of distinct words."""
        n = np.diff(np.append(first, len(grams)))[:, None].astype(np.float32)
        chars = np.add.reduceat(self.p["char"][grams], first, axis=0) / np.sqrt(n)
        return np.concatenate([self.p["word"][known], chars], 1)

    def _gru(self, x: list[np.ndarray], side: str) -> tuple[list[np.ndarray], list[tuple]]:
        """x: per step the projected inputs (windows, 3 hidden)."""
        h, u = np.zeros((len(x[0]), HIDDEN), np.float32), self.p[f"U{side}"]
        states, saved = [], []
        for a in x:
            b = h @ u
            zr = sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
            z, r, bn = zr[:, :HIDDEN], zr[:, HIDDEN:], b[:, 2 * HIDDEN :]
            n = np.tanh(a[:, 2 * HIDDEN :] + r * bn)
            new = n + z * (h - n)
            saved.append((h, z, r, n, bn))
            h = new
            states.append(h)
        return states, saved

    def forward(self, projected: tuple[np.ndarray, np.ndarray], index: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits of windows and what gradients() needs; index: (windows, steps) into the projected distinct words."""
        steps = index.shape[1]
        f, sf = self._gru([projected[0][index[:, t]] for t in range(steps)], "f")
        b, sb = self._gru([projected[1][index[:, t]] for t in range(steps - 1, -1, -1)], "b")
        h = np.concatenate([np.stack(f, 1), np.stack(b[::-1], 1)], 2)
        a = np.tanh(h @ self.p["Wa"] + self.p["ba"])
        e = np.exp(a @ self.p["va"])
        w = e / e.sum(1, keepdims=True)
        pooled = (w[:, :, None] * h).sum(1)
        logit = pooled @ self.p["wo"] + self.p["bo"]
        return logit, (h, a, w, pooled, sf, sb)

    def infer(self, projected: tuple[np.ndarray, np.ndarray], index: np.ndarray) -> np.ndarray:
        """The logits of forward(), with no state kept and arrays reused."""
        n, steps = index.shape
        h = np.empty((steps, n, 2 * HIDDEN), np.float32)
        a, b = np.empty((n, 3 * HIDDEN), np.float32), np.empty((n, 3 * HIDDEN), np.float32)
        for side, table, order in ((0, projected[0], range(steps)), (1, projected[1], range(steps - 1, -1, -1))):
            u, last = self.p[f"U{'fb'[side]}"], np.zeros((n, HIDDEN), np.float32)
            for t in order:
                np.take(table, index[:, t], 0, out=a, mode="clip")
                np.matmul(last, u, out=b)
                a[:, : 2 * HIDDEN] += b[:, : 2 * HIDDEN]
                zr = np.tanh(0.5 * a[:, : 2 * HIDDEN])
                zr += 1
                zr *= 0.5
                new = b[:, 2 * HIDDEN :] * zr[:, HIDDEN:]
                new += a[:, 2 * HIDDEN :]
                np.tanh(new, out=new)
                last -= new
                last *= zr[:, :HIDDEN]
                last += new
                h[t, :, side * HIDDEN : (side + 1) * HIDDEN] = last
        att = h.reshape(-1, 2 * HIDDEN) @ self.p["Wa"]
        att += self.p["ba"]
        np.tanh(att, out=att)
        w = np.exp(att @ self.p["va"]).reshape(steps, n)
        score = (h.reshape(-1, 2 * HIDDEN) @ self.p["wo"]).reshape(steps, n)
        return (w * score).sum(0) / w.sum(0) + self.p["bo"]

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]

    def _gru_back(self, dh: np.ndarray, saved: list[tuple], side: str, g: dict) -> np.ndarray:
        """dh: (windows, steps, hidden) in the order read; the gradient of the projected inputs."""
        u, out, later = self.p[f"U{side}"], np.empty((*dh.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(dh[:, 0])
        for t in range(dh.shape[1] - 1, -1, -1):
            h, z, r, n, bn = saved[t]
            d = dh[:, t] + later
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * bn * r * (1 - r)
            da = np.concatenate([dz, dr, dn], 1)
            db = np.concatenate([dz, dr, dn * r], 1)
            g[f"U{side}"] += h.T @ db
            later = d * z + db @ u.T
            out[:, t] = da
        return out

    def gradients(self, known, grams, first, index, y) -> tuple[dict, dict]:
        """(rows of the tables used, gradients of the mean log loss); those of a table are for its rows used."""
        x = self.inputs(known, grams, first)
        projected = self.project(x)
        logit, (h, a, w, pooled, sf, sb) = self.forward(projected, index)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "char")}
        p = sigmoid(logit)
        dl = ((p - y) / len(y)).astype(np.float32)
        g["wo"], g["bo"][0] = pooled.T @ dl, dl.sum()
        dp = dl[:, None] * self.p["wo"]
        dw = (h * dp[:, None, :]).sum(2)
        ds = w * (dw - (w * dw).sum(1, keepdims=True))
        g["va"] = np.einsum("wt,wta->a", ds, a)
        da = ds[:, :, None] * self.p["va"] * (1 - a * a)
        g["Wa"], g["ba"] = np.einsum("wth,wta->ha", h, da), da.sum((0, 1))
        dh = w[:, :, None] * dp[:, None, :] + da @ self.p["Wa"].T
        af = self._gru_back(dh[:, :, :HIDDEN], sf, "f", g)
        ab = self._gru_back(dh[:, ::-1, HIDDEN:], sb, "b", g)[:, ::-1]
        dx = np.zeros_like(x)
        for side, d in (("f", af), ("b", ab)):
            order = np.argsort(index.ravel(), kind="stable")
            at = np.add.reduceat(d.reshape(-1, 3 * HIDDEN)[order], np.searchsorted(index.ravel()[order], np.arange(len(x))), axis=0)
            g[f"W{side}"], g[f"c{side}"] = x.T @ at, at.sum(0)
            dx += at @ self.p[f"W{side}"].T
        n = np.diff(np.append(first, len(grams)))
        rows = {}
        for k, ids, d in (("word", known, dx[:, :WORD_DIMS]), ("char", grams, np.repeat(dx[:, WORD_DIMS:] / np.sqrt(n)[:, None], n, axis=0))):
            rows[k], at = np.unique(ids, return_inverse=True)
            order = np.argsort(at, kind="stable")
            g[k] = np.add.reduceat(d[order], np.searchsorted(at[order], np.arange(len(rows[k]))), axis=0)
        return rows, g


def _all_windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, document) of all windows of a batch of texts."""
    n = np.diff(bounds)
    full = np.maximum(n - WINDOW, 0)
    count = np.where(n > 0, 1 + -(-full // STRIDE), 0)
    doc = np.repeat(np.arange(len(n)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[:-1][doc] + np.minimum(inner * STRIDE, full[doc])
    return first, np.minimum(n[doc], WINDOW), doc


class Batch:
    """Texts as distinct words and windows over them."""

    def __init__(self, net: Network, data: np.ndarray, offsets: np.ndarray) -> None:
        data = LOWER[data]
        starts, ends, self.bounds = words(data, offsets, INSIDE)
        hashes = word_hashes(data, starts, ends)
        distinct, sample, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        self.known = net.known(distinct)
        self.grams, self.first = trigrams(data, starts[sample], ends[sample])
        self.at, self.size, self.doc = _all_windows(self.bounds)

    def logits(self, net: Network, rows: int = 4096) -> np.ndarray:
        """One for each window."""
        out = np.empty(len(self.at), np.float32)
        if not len(out):
            return out
        projected = net.project(net.inputs(self.known, self.grams, self.first))
        for size in np.unique(self.size).tolist():  # windows of one length at a time; nothing is padded
            same = np.flatnonzero(self.size == size)
            for i in range(0, len(same), rows):
                part = same[i : i + rows]
                out[part] = net.infer(projected, self.index[self.at[part][:, None] + np.arange(size)])
        return out

    def scores(self, net: Network) -> np.ndarray:
        """The highest window of each text; 0 without words."""
        best = np.full(len(self.bounds) - 1, -np.inf)
        np.maximum.at(best, self.doc, self.logits(net))
        return np.where(np.isfinite(best), sigmoid(best), 0.0)


def _document_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted word hashes, in how many texts each is)."""
    found = [np.zeros(0, np.uint64)]
    for i, j in by_bytes(offsets, 1 << 20):
        part = LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, bounds = words(part, offsets[i : j + 1] - offsets[i], INSIDE)
        hashes = word_hashes(part, starts, ends)
        found += [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    return np.unique(np.concatenate(found), return_counts=True)


def train(texts: list[str], labels: np.ndarray, seed: int = 0, rounds: int = 6, min_steps: int = 600, min_docs: int = 3, min_share: float = 0.003) -> Network:
    """Fits a network to labelled texts; without both labels it scores nothing as toxic."""
    rng = np.random.default_rng(seed)
    data, offsets = as_buffer(pa.array(texts, pa.string()))
    distinct, n_docs = _document_counts(data, offsets)
    net = Network(distinct[n_docs >= max(min_docs, min_share * len(texts))], seed)
    if not 0 < labels.sum() < len(labels):
        net.p["bo"][:] = -20
        return net
    b = Batch(net, data, offsets)
    adam = Adam(net.p)
    truth = labels[b.doc].astype(np.float32)
    positive, negative = np.flatnonzero(truth == 1), np.flatnonzero(truth == 0)
    for r in range(rounds):
        if r == 0:  # windows of toxic texts, as many of others
            pick = np.concatenate([positive, rng.permutation(negative)[: max(len(positive), 2000)]])
        else:  # the two highest windows of each toxic text, the highest of others, those that mislead, and random ones of clean texts
            logit = b.logits(net)
            order = np.lexsort((-logit, b.doc))
            rank = np.arange(len(order)) - np.searchsorted(b.doc[order], b.doc[order])
            top = order[(rank == 0) | (rank == 1) & (truth[order] == 1) | (rank < 4) & (truth[order] == 0) & (logit[order] > -1)]
            pick = np.concatenate([top, rng.permutation(negative)[: len(top) // 2]])
        passes = max(1, round(min_steps / rounds / (len(pick) / 128 + 1)))
        for _ in range(passes):
            pick = rng.permutation(pick)
            for size in np.unique(b.size[pick]).tolist():
                same = pick[b.size[pick] == size]
                for i in range(0, len(same), 128):
                    part = same[i : i + 128]
                    index = b.index[b.at[part][:, None] + np.arange(size)]
                    used, local = np.unique(index, return_inverse=True)
                    n = np.diff(np.append(b.first, len(b.grams)))[used]
                    take = np.repeat(b.first[used] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    known = np.where(rng.random(len(used)) < 0.3, 0, b.known[used])  # so that characters count, too
                    rows, g = net.gradients(known, b.grams[take], np.cumsum(n) - n, local.reshape(index.shape), truth[part])
                    adam.update(rows, g, 0.01 if r < rounds - 2 else 0.003)
    return net


class Adam:
    """Adam; of a table of embeddings, only the rows that a batch has used are moved."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p, self.step = p, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def update(self, rows: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        lr = rate * min(1, self.step / 50) * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, d in g.items():
            at = rows.get(k, slice(None))
            m, v = 0.9 * self.m[k][at] + 0.1 * d, 0.999 * self.v[k][at] + 0.001 * d * d
            self.m[k][at], self.v[k][at] = m, v
            self.p[k][at] -= (lr * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def training_sample(docs: DataFrame, labels: DataFrame, toxic: int, clean: int, sample_bytes: int) -> tuple[list[str], np.ndarray]:
    """At most so many texts of each label and so many bytes in all, outside the held-out fold.

    The bounds are on the sample of labelled rows that the classifier is fitted
    to.  Labelled documents are taken by a hash of doc_id, one text each; each
    label has its share of the bytes, and a text that no longer fits is passed
    over.  Rows without a doc_id, text or label are not used.
    """
    known = labels.where((crc_mod("doc_id", 3) != 1) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("k")).agg(F.max("toxic").alias("toxic"))
    sized = docs.where("text is not null").select("doc_id", F.struct(F.xxhash64("text").alias("x"), F.octet_length("text").alias("n")).alias("t"))
    met = sized.join(known, F.col("doc_id") == F.col("k")).groupBy("doc_id").agg(F.min("t").alias("t"), F.max("toxic").alias("toxic"))
    chosen = []
    for label, most in ((1, toxic), (0, clean)):
        left = sample_bytes * most // max(1, toxic + clean)
        for r in met.where((F.col("toxic") == 1) == F.lit(label == 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect():
            if r.t.n <= left:
                left -= r.t.n
                chosen.append((r.doc_id, r.t.x, label))
    few = docs.sparkSession.createDataFrame(chosen, f"k {docs.schema['doc_id'].dataType.simpleString()}, x long, y int")  # at most toxic + clean rows of three numbers
    got = docs.select("doc_id", "text").join(F.broadcast(few), (F.col("doc_id") == F.col("k")) & (F.xxhash64("text") == F.col("x"))).select("k", "y", "text").dropDuplicates(["k"])
    rows = sorted(got.collect(), key=lambda r: r.k)
    return [r.text for r in rows], np.array([r.y for r in rows], np.int64)


def fit(docs: DataFrame, labels: DataFrame, toxic: int = 1000, clean: int = 2500, sample_bytes: int = 8 << 20, seed: int = 0) -> Network:
    return train(*training_sample(docs, labels, toxic, clean, sample_bytes), seed)


def score(docs: DataFrame, net: Network, text: str = "text", out: str = "score", batch_bytes: int = 2 << 20) -> DataFrame:
    """Adds the toxicity score, 0 to 1, of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of the vocabulary of a bounded sample
    at = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_buffer(batch.column(at))
            parts = [Batch(shared.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).scores(shared.value) for i, j in by_bytes(offsets, batch_bytes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *parts]))], names=[*batch.schema.names, out])

    return docs.mapInArrow(scan, f"{ddl(docs)}, {quoted(out)} double")


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    net = fit(docs, labels, **options)
    scored = score(docs.select("doc_id", "text"), net).drop("text")
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The documents, all columns, that score below the threshold."""
    net = fit(docs, labels, **options)
    (own,) = fresh(docs, "__score")
    return score(docs, net, out=own).where(F.col(own) < threshold).drop(own)
