"""Mixing of sources to target weights of the tokens.

A naive Bayes classifier, fitted on documents of the listed sources, gives each document a soft membership in every source's domain. Projected
gradient descent fits a nonnegative rate to each document, at most its source's max_repeats: the least squares are those of the
*expected* domain tokens, the sum of rate x tokens x membership, against the targets, among the rates that give each named source its target,
which the task asks for. So of a source's documents those get higher rates that look like the domains that the others
leave short. A rate follows from the document's memberships and from the multipliers of all steps, so a step is one aggregation over the
documents, and nothing but k x k sums comes to the driver. The rates are then rounded to whole copies under one shift for each source, the largest
that keeps its total within its target, and the document that brings the source nearest to its target is added as long as one does. The mix is as
large as the scarcest source allows without breaking a weight or a cap.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_folder
from .subjects import sample
from .tokenize import TOKENIZERS, encoder

BINS = 1 << 15
#: Documents that the classifier is fitted on (a documented bound).
TRAIN_DOCUMENTS = 4000
#: Factors of the classifier's scores to choose from.
SCALES = (0.25, 0.5, 1.0, 2.0, 4.0)
#: Passes of the descent, weight of the residual by named source in its loss, and its first ridge as a share of the trace.
STEPS, HARD, RIDGE = 12, 10.0, 2.0
#: Weight of the expected domain totals; without them all documents of a source have one rate.
SOFT = 1.0
#: Resolution of the shift in each of the two rounds of its search.
CELLS = 4096


def word_bins(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the words of a block of texts, and the text of each."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}\p{M}]+")
    coded = pc.list_flatten(lists).dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    bins = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % BINS if w else -1 for w in coded.dictionary.to_pylist()], np.int64)
    at, row = bins[index] if len(index) else np.empty(0, np.int64), np.repeat(np.arange(len(size)), size)
    return at[at >= 0], row[at >= 0]


class Domains:
    """Naive Bayes over words. The words of a text aren't independent: their sum is divided by the root of their number and
    scaled by the factor of SCALES under which every fifth document, left out of the first fit, has the likeliest label."""

    def __init__(self, texts: list[str], labels: np.ndarray, k: int):
        self.k = k
        bins, row = word_bins(pa.array(texts, pa.string()))
        held = np.arange(len(labels)) % 5 == 0
        self.fit(bins, row, labels, ~held)
        score, at = self.sums(bins, row, len(labels))[held], labels[held]
        loss = {}
        for scale in SCALES if len(at) else SCALES[:1]:
            p = softmax(scale * score + self.prior)
            loss[scale] = -np.log(p[np.arange(len(at)), at].clip(1e-9)).sum()
        self.scale = min(loss, key=loss.get)
        self.fit(bins, row, labels, np.ones(len(labels), bool))

    def fit(self, bins: np.ndarray, row: np.ndarray, labels: np.ndarray, used: np.ndarray) -> None:
        keep = used[row]
        n = np.zeros((BINS, self.k))
        np.add.at(n, (bins[keep], labels[row[keep]]), 1.0)
        self.log = np.log((n + 0.1) / (n + 0.1).sum(0)).astype(np.float32)
        self.prior = np.log((np.bincount(labels[used], minlength=self.k) + 1) / (used.sum() + self.k))

    def sums(self, bins: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        total = np.stack([np.bincount(row, self.log[bins, c], n) for c in range(self.k)], 1)
        return total / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[:, None]

    def posteriors(self, texts: pa.Array) -> np.ndarray:
        return softmax(self.scale * self.sums(*word_bins(texts), len(texts)) + self.prior)


def softmax(score: np.ndarray) -> np.ndarray:
    if not len(score):
        return score
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def rates(label: np.ndarray, soft: np.ndarray, start: np.ndarray, caps: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The rate of each document after the steps whose multipliers (by soft membership, and by named source) are given."""
    r = start[label]
    for mild, hard in history:
        r = np.clip(r - soft @ mild - hard[label], 0, caps[label])
    return r


class Descent:
    """The steps of the projected gradient, from what one pass over the documents gives for the rates so far.

    The gradient of half the squared residual of the expected domain totals is, for each token of a document, its memberships times the
    residuals; the projection on the totals by named source takes the same off all free documents of a source. The gradient is scaled
    by the free documents' products of memberships plus a ridge. A step that makes things worse is taken again with a larger ridge, which is a shorter
    step nearer to the plain gradient.
    """

    def __init__(self, wanted: np.ndarray, weight: float):
        self.wanted, self.weight, self.ridge = wanted, weight, RIDGE
        self.history: list[tuple[np.ndarray, np.ndarray]] = []
        self.least, self.kept = np.inf, None

    def loss(self, expected: np.ndarray, named: np.ndarray) -> float:
        return float(((expected - self.wanted) ** 2).sum() * self.weight**2 + HARD * ((named - self.wanted) ** 2).sum())

    def step(self, *state: np.ndarray) -> None:
        """state: expected totals by domain and totals by named source; tokens of the free documents by source, by source and membership, and by two memberships."""
        now = self.loss(*state[:2])
        if now > self.least:
            self.history.pop()
            self.ridge *= 8
        else:
            self.least, self.kept = now, state
            self.ridge /= 2
        expected, named, free, cross, square = self.kept
        each = 1 / np.maximum(free, 1)
        inner = square - cross.T @ (each[:, None] * cross)
        residual = expected - cross.T @ (each * (named - self.wanted)) - self.wanted
        mild = self.weight * np.linalg.solve(inner + np.eye(len(free)) * max(self.ridge * np.trace(inner), 1e-9), residual)
        self.history.append((mild, each * (named - self.wanted - cross @ mild)))


def events(rate: np.ndarray, u: np.ndarray, cap: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The shifts in [-1, 1] at which a document gets one more copy, and which documents do; at a shift of -1 it has floor(rate + u - 1)."""
    base = np.floor(rate + u - 1)
    out = []
    for k in (1, 2):
        at = base + k - rate - u
        out.append((at, np.flatnonzero((at <= 1) & (base + k <= cap) & (base + k >= 1))))
    return out


MIX = "doc_id long, source string, n_tokens int, rate double, copies int, memberships array<float>"


def mix(spark: SparkSession, docs: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies, memberships) of the documents that are in the mix.

    Documents without a listed source, and those without tokens, stay out. A listed source without tokens gets none, and the others keep
    their weights against each other. With an empty table of targets the mix is empty.
    """
    rows = targets.groupBy("source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("cap")).filter("source is not null and weight > 0 and cap > 0").orderBy("source").collect()
    if not rows:
        return spark.createDataFrame([], MIX)
    names = [r.source for r in rows]
    k, caps, weight = len(names), np.array([r.cap for r in rows], float), np.array([r.weight for r in rows], float)
    label = F.array_position(F.array(*map(F.lit, names)), F.col("source")).cast("int") - 1
    listed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), label.alias("label"), "text").filter(F.col("source").isin(names))
    train = sample(listed.filter("text is not null"), TRAIN_DOCUMENTS, 3).orderBy("doc_id").collect()
    domains = spark.sparkContext.broadcast(Domains([r.text for r in train], np.array([r.label for r in train], np.int64), k))

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, tokenizers)
        for b in batches:
            n = pc.list_value_length(enc.encode(b.column(2)))
            soft = domains.value.posteriors(b.column(2)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.FixedSizeListArray.from_arrays(pa.array(soft.ravel()), k).cast(pa.list_(pa.float32()))], names=["doc_id", "label", "n_tokens", "soft"])

    sized = listed.mapInArrow(size, "doc_id long, label int, n_tokens int, soft array<float>").filter("n_tokens > 0")
    checkpoint_folder(spark)
    sized = sized.checkpoint()

    def arrays(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        soft = np.asarray(pc.list_flatten(b.column(3))).reshape(-1, k).astype(float)
        key = b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        u = ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)).astype(float) / float(1 << 53)
        return b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy().astype(float), soft, u

    def total(what: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
        """The sum of a vector over all batches."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = np.zeros(width)
            for b in batches:
                if b.num_rows:
                    x += what(b)
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(x[at])], names=["k", "x"])

        got = sized.mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).toArrow()
        out = np.zeros(width)
        out[got["k"].to_numpy()] = got["x"].to_numpy()
        return out

    def sums(b: pa.RecordBatch) -> np.ndarray:
        l, t, _, _ = arrays(b)
        return np.bincount(l, t, k)

    there = total(sums, k)
    if not there.any():
        return spark.createDataFrame([], MIX)
    weight = np.where(there > 0, weight, 0) / weight[there > 0].sum()
    wanted = weight * min(caps[s] * there[s] / weight[s] for s in range(k) if weight[s] > 0)
    start = wanted / np.maximum(there, 1)
    descent = Descent(wanted, SOFT)

    def rate_of(l: np.ndarray, soft: np.ndarray) -> np.ndarray:
        return rates(l, soft, start, caps, descent.history)

    for _ in range(STEPS if SOFT else 0):

        def state(b: pa.RecordBatch) -> np.ndarray:
            l, t, soft, _ = arrays(b)
            r = rate_of(l, soft)
            free = np.where((r > 0) & (r < caps[l]), t, 0)
            cross = np.stack([np.bincount(l, free * soft[:, c], k) for c in range(k)], 1)
            return np.concatenate([(r * t) @ soft, np.bincount(l, r * t, k), np.bincount(l, free, k), cross.ravel(), (soft * free[:, None]).T.dot(soft).ravel()])

        got = total(state, 3 * k + 2 * k * k)
        descent.step(got[:k], got[k : 2 * k], got[2 * k : 3 * k], got[3 * k : 3 * k + k * k].reshape(k, k), got[3 * k + k * k :].reshape(k, k))
    if SOFT:
        descent.history.pop()  # not seen by a pass

    # The shift of each source, first to one of CELLS cells of [-1, 1], then to one of as many within that cell.
    low, width = np.full(k, -1.0), 2.0
    for _ in range(2):

        def cells(b: pa.RecordBatch) -> np.ndarray:
            l, t, soft, u = arrays(b)
            rate = rate_of(l, soft)
            x = np.bincount(l * (CELLS + 1), np.clip(np.floor(rate + u - 1), 0, caps[l]) * t, k * (CELLS + 1))
            for at, i in events(rate, u, caps[l]):
                c = np.floor((at[i] - low[l[i]]) / width * CELLS).clip(-1, CELLS).astype(np.int64) + 1
                ok = c <= CELLS
                x += np.bincount(l[i][ok] * (CELLS + 1) + c[ok], t[i][ok], k * (CELLS + 1))
            return x

        grown = np.cumsum(total(cells, k * (CELLS + 1)).reshape(k, CELLS + 1), axis=1)
        cell = np.array([np.searchsorted(g, w + 1e-6, side="right") for g, w in zip(grown, wanted)]).clip(1, CELLS) - 1
        low, width, gap = low + cell * width / CELLS, width / CELLS, wanted - grown[np.arange(k), cell]
    shift = low
    added: dict[int, int] = {}

    def given(l: np.ndarray, rate: np.ndarray, u: np.ndarray, doc: list[int]) -> np.ndarray:
        n = np.clip(np.floor(rate + u - 1), 0, caps[l])
        for at, i in events(rate, u, caps[l]):
            n[i] += at[i] < shift[l[i]]
        return n + np.array([added.get(d, 0) for d in doc]) if added else n

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block and source the document whose tokens come nearest to the gap."""
        for b in batches:
            if b.num_rows:
                l, t, soft, u = arrays(b)
                doc = b.column(0).to_numpy(zero_copy_only=False)
                rate = rate_of(l, soft)
                miss = np.abs(gap[l] - t)
                can = np.flatnonzero((given(l, rate, u, doc.tolist()) < caps[l]) & (gap[l] > 0) & (miss < gap[l]))
                can = can[np.lexsort((doc[can], rate[can] <= 0, miss[can], l[can]))]
                can = can[np.r_[True, l[can][1:] != l[can][:-1]]] if len(can) else can
                yield pa.RecordBatch.from_arrays([pa.array(l[can].astype(np.int32)), pa.array(miss[can]), pa.array(rate[can] <= 0), pa.array(doc[can]), pa.array(t[can])], names=["label", "miss", "unlikely", "doc_id", "n"])

    more = True
    while more:
        best = sized.mapInArrow(nearest, "label int, miss double, unlikely boolean, doc_id long, n double").groupBy("label").agg(F.min(F.struct("miss", "unlikely", "doc_id", "n")).alias("x")).collect()
        for r in best:
            gap[r.label] -= r.x.n
            added[r.x.doc_id] = added.get(r.x.doc_id, 0) + 1
        more = bool(best)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                l, t, soft, u = arrays(b)
                rate = rate_of(l, soft)
                n = given(l, rate, u, b.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names).take(b.column(1)), b.column(2), pa.array(rate), pa.array(n.astype(np.int32)), b.column(3)], names=["doc_id", "source", "n_tokens", "rate", "copies", "memberships"]).filter(pa.array(n > 0))

    return sized.mapInArrow(copies, MIX)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each listed source: weight, documents, the most copies of one, tokens in the mix, and their share; ``expected_share`` is the share of its
    domain by the soft memberships, ``off_by`` (against the weights of the sources that are in the mix) the tokens that it has too many (too few if negative), and ``reached`` whether that is no more than
    its longest document in the mix. A source without documents in the mix has 0 of all and isn't reached."""
    size = F.col("n_tokens").cast("long") * F.col("copies")
    by = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"), F.sum(size).alias("tokens"), F.max("n_tokens").alias("longest"))
    domains = mixed.select(size.alias("size"), F.posexplode("memberships").alias("k", "p")).groupBy("k").agg(F.sum(F.col("size") * F.col("p")).alias("expected"))
    listed = targets.groupBy("source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    # The memberships stand in the order of the sources that can be in the mix; the table of targets is as small as the number of sources.
    order = Window.partitionBy("usable").orderBy("source")
    usable = F.coalesce(F.col("source").isNotNull() & (F.col("weight") > 0) & (F.col("max_repeats") > 0), F.lit(False))
    out = listed.withColumn("usable", usable).withColumn("k", F.when(F.col("usable"), F.row_number().over(order) - 1)).join(by, "source", "left").join(domains, "k", "left")
    all_tokens = mixed.agg(F.sum(size).alias("all_tokens"))
    out = out.crossJoin(F.broadcast(all_tokens))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    present = F.sum(F.when(zero("tokens") > 0, F.col("weight"))).over(Window.partitionBy(F.lit(0)))
    off = zero("tokens") - F.when(zero("tokens") > 0, F.col("weight") / F.col("present")).otherwise(F.col("weight")) * F.col("all_tokens")
    return out.withColumn("present", present).select(
        "source", "weight", "max_repeats", *[zero(c).alias(c) for c in ("n_docs", "most_copies", "tokens")], (zero("tokens") / F.col("all_tokens")).alias("share"),
        F.round(zero("expected") / F.col("all_tokens"), 6).alias("expected_share"), F.round(off, 3).alias("off_by"), (F.abs(off) <= zero("longest")).alias("reached"),
    )
