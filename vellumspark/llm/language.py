"""Languages of documents and of the segments of mixed ones, with a confidence.

A text is a mean of hashed subword embeddings (character n-grams of its words, and the words themselves) under a linear softmax,
trained by stochastic gradient descent in numpy on sentences of labelled documents. The labels are noisy, so a repeated sentence
counts once with the label of most of its documents, and a first model corrects the labels for the second. Its temperature is fitted on
held-out sentences, and so is the confidence below which a text gets no language. As the model is linear, each
worker keeps the score of each word it has met and adds those up.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import readable
from .lookalike import form

LANGUAGES = ("en", "my", "fr", "de", "es", "pt", "nl")
#: Spellings of labels (fixed values: ISO 639 codes, English and own names); region and script subtags don't matter.
NAMES = {
    "en": "en eng english", "my": "my mya bur burmese myanmar", "fr": "fr fra fre french français francais", "de": "de deu ger german deutsch",
    "es": "es spa spanish español espanol castellano", "pt": "pt por portuguese português portugues", "nl": "nl nld dut dutch nederlands",
}
CODE_OF = {n: code for code, names in NAMES.items() for n in names.split()}
BUCKETS = 1 << 15
DIM = 16
#: Labelled documents that the classifier is fitted on, at most (a documented bound; all else covers all data).
TRAIN_DOCUMENTS = 3000
EPOCHS = 5
RATE = 0.5
BATCH = 128
SEED = 20260101
CACHE_SENTENCES = 100_000
#: Share of right answers that the texts just above the rejection have.
LOCALLY_RIGHT = 0.8

WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯါ-ှ�][^\W\d_]*)*|[က-ဿ၌-႟]+")
#: Ends of sentences: after a stop with its closing marks before something that isn't a small letter, after the Myanmar stop, at line breaks.
SENTENCE = re.compile(r"(?<=။)\s*|(?<=[.!?;])\s+(?![a-zà-ÿ])|(?<=[.!?][”“»’)\]])\s+(?![a-zà-ÿ])|\s*[\n\r]+\s*|\s+\|\s+")
STOPS, CLOSERS = tuple(".!?။;．。"), "'\"”“»’)]"


def label_code(label: str | None) -> str | None:
    """The language that a label names, if it is one of LANGUAGES; another one's primary subtag; None if it names none."""
    main = re.split(r"[-_ .@]", (label or "").strip().lower())[0]
    return CODE_OF.get(main)


def words(text: str) -> list[str]:
    """The words in small letters, without codes in capitals."""
    found = WORD.findall(text)
    if len(found) > 1 and not text.isupper():
        found = [w for w in found if not (w.isupper() and len(w) > 1 and w.isascii())]
    return [w.lower() for w in found]


def subwords(word: str) -> list[int]:
    """Buckets of the word and of its n-grams of 2 to 4 characters with its ends marked."""
    w = f"<{word}>"
    grams = {w} | {w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)}
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in sorted(grams)]


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s and not s.isspace()]


def is_whole(sentence: str, words: list[str]) -> bool:
    """Whether it ends in a stop, doesn't begin with a small letter (as list items do), and is no mere number or word."""
    first = next((c for c in sentence if c.isalpha()), "")
    size = sum(map(len, words))
    return sentence.rstrip().rstrip(CLOSERS).endswith(STOPS) and not first.islower() and (len(words) >= 4 and size >= 12 or "က" <= first <= "႟" and size >= 12)


class Model:
    def __init__(self, embed: np.ndarray, out: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least: float = 0.5):
        self.table = (embed @ out).astype(np.float32)  # the score that each bucket adds to each language
        self.bias, self.temperature, self.least = bias, temperature, least
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((1024, len(LANGUAGES)), np.float32)
        self.sizes = np.zeros(1024, np.float32)

    def __getstate__(self):
        return {"table": self.table, "bias": self.bias, "temperature": self.temperature, "least": self.least}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.ids, self.scores, self.sizes = {}, np.zeros((1024, len(LANGUAGES)), np.float32), np.zeros(1024, np.float32)

    def _id(self, word: str) -> int:
        k = self.ids.get(word)
        if k is None:
            k = self.ids[word] = len(self.ids)
            if k >= len(self.sizes):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            grams = subwords(word)
            self.scores[k], self.sizes[k] = self.table[grams].sum(0), len(grams)
        return k

    def predict(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Language (-1: none) and confidence of texts given as lists of words."""
        if len(self.ids) > 300_000:
            self.__setstate__(self.__getstate__())
        n = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        ids = np.fromiter((self._id(w) for t in texts for w in t), np.int64, int(n.sum()))
        cut = np.concatenate(([0], np.cumsum(n)))
        total = lambda x: np.diff(np.concatenate((np.zeros((1, *x.shape[1:]), np.float64), np.cumsum(x, 0, np.float64)))[cut], axis=0)
        score = total(self.scores[ids]) / np.maximum(total(self.sizes[ids]), 1)[:, None] + self.bias
        p = np.exp((score - score.max(1, keepdims=True)) / self.temperature) if len(score) else score
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1) if len(p) else np.empty(0, int)
        conf = p.max(1) if len(p) else np.empty(0)
        return np.where((n > 0) & (conf >= self.least), best, -1), conf


def train(texts: list[list[str]], labels: np.ndarray, seed: int = SEED) -> Model:
    """Stochastic gradient descent with adaptive rates over embeddings and softmax; classes weigh alike."""
    rng = np.random.default_rng(seed)
    known = {w: subwords(w) for w in {w for t in texts for w in t}}
    grams = [np.array([g for w in t for g in known[w]], np.int64) for t in texts]
    keep = np.array([k for k, g in enumerate(grams) if len(g)])
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, len(LANGUAGES))).astype(np.float32), np.zeros(len(LANGUAGES), np.float32)
    square_embed, square_out, square_bias = np.full(BUCKETS, 1e-6, np.float32), np.full(out.shape, 1e-6, np.float32), np.full(bias.shape, 1e-6, np.float32)
    count = np.bincount(labels[keep], minlength=len(LANGUAGES))
    weight = np.where(count > 0, len(keep) / np.maximum(count, 1) / max(1, (count > 0).sum()), 0).clip(0, 5)
    for epoch in range(EPOCHS):
        order = rng.permutation(keep)
        rate = RATE * (1 - epoch / EPOCHS)
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            size = np.array([len(grams[k]) for k in at])
            flat = np.concatenate([grams[k] for k in at])
            row = np.repeat(np.arange(len(at)), size)
            mean = np.add.reduceat(embed[flat], np.concatenate(([0], np.cumsum(size)[:-1])), axis=0) / size[:, None]
            score = mean @ out + bias
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), labels[at]] -= 1
            p *= weight[labels[at]][:, None]
            back = (p @ out.T / size[:, None]).astype(np.float32)
            step = mean.T @ p / len(at)
            square_out += step**2
            out -= rate * 0.2 * step / np.sqrt(square_out)
            square_bias += p.mean(0) ** 2
            bias -= rate * 0.2 * p.mean(0) / np.sqrt(square_bias)
            by = np.argsort(flat, kind="stable")
            bucket, first = np.unique(flat[by], return_index=True)
            step = np.add.reduceat(back[row[by]], first, axis=0)
            square_embed[bucket] += (step**2).mean(1)
            embed[bucket] -= rate * step / np.sqrt(square_embed[bucket])[:, None]
    return Model(embed, out, bias)


def calibrate(model: Model, texts: list[list[str]], labels: np.ndarray) -> Model:
    """Fits the temperature by likelihood, and the rejection: texts are rejected below the confidence at which LOCALLY_RIGHT of them are right.

    Held-out texts that the model reads with certainty as another language than their label are taken for wrongly labelled and left out.
    """
    model.temperature, model.least = 1.0, 0.0
    got, conf = model.predict(texts)
    keep = np.flatnonzero((got == labels) | (conf < 0.8))
    texts, labels = [texts[k] for k in keep], labels[keep]
    best = None
    for t in (0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.5, 2.0):
        model.temperature = t
        got, conf = model.predict(texts)
        right = got == labels
        loss = -np.log(np.where(right, conf, (1 - conf) / (len(LANGUAGES) - 1)).clip(1e-6)).mean() if len(labels) else 0
        if best is None or loss < best[0]:
            best = loss, t, right, conf
    _, model.temperature, right, conf = best
    for c in np.arange(0.5, 0.9, 0.05):
        here = (conf >= c) & (conf < c + 0.1)
        if here.sum() < 5 or right[here].mean() >= LOCALLY_RIGHT:
            break
    model.least = float(c)
    return model


def examples(rows: list[tuple[int, list[list[str]]]]) -> tuple[list[list[str]], np.ndarray]:
    """Each different sentence of (language, sentences) once, with the language of most of its documents; ties are left out."""
    votes: dict[tuple[str, ...], Counter] = {}
    for lang, texts in rows:
        for t in texts:
            votes.setdefault(tuple(t), Counter())[lang] += 1
    texts, labels = [], []
    for t, v in sorted(votes.items()):
        (lang, n), *rest = v.most_common(2)
        if not rest or n > rest[0][1]:
            texts.append(list(t))
            labels.append(lang)
    return texts, np.array(labels, np.int64)


def fit(rows: list[tuple[str, list[str]]]) -> Model:
    """A model from (language, paragraphs) of labelled documents.

    The first model gives each document the language of most of its text, whatever its label says, and takes out the sentences that
    it reads with certainty as another language; the second is trained on what is left.
    """
    given = [(LANGUAGES.index(lang), [w for p in paragraphs or () for s in sentences(form(p or "")) if len(w := words(s)) >= 2]) for lang, paragraphs in rows]
    texts, labels = examples(given)
    if not len(labels):
        return Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES), np.float32), 1.0, 1.0)
    first = train(texts, labels)
    first.least = 0.0
    clean = []
    for _, ts in given:
        if ts:
            got, conf = first.predict(ts)
            main = int(np.bincount(got, weights=[sum(map(len, t)) for t in ts], minlength=len(LANGUAGES)).argmax())
            clean.append((main, [t for t, g, c in zip(ts, got, conf) if g == main or c < 0.8]))
    texts, labels = examples(clean)
    order = np.random.default_rng(SEED).permutation(len(labels))
    held, rest = order[: len(order) // 10], order[len(order) // 10 :]
    model = train([texts[k] for k in rest], labels[rest], SEED + 1)
    return calibrate(model, [texts[k] for k in held], labels[held])


def training_rows(docs: DataFrame) -> list[tuple[str, list[str]]]:
    """About TRAIN_DOCUMENTS labelled documents, at most twice as many, the same ones each time; with few labels, all of them."""
    labelled = docs.select("doc_id", label_column("lang").alias("code"), "paragraphs").filter("code is not null")
    n = labelled.count()
    if n > TRAIN_DOCUMENTS:
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * TRAIN_DOCUMENTS / n)))
    return [(r.code, r.paragraphs) for r in labelled.select("code", "paragraphs").limit(2 * TRAIN_DOCUMENTS).collect()]


SEGMENTS = "doc_id string, label string, main string, main_confidence double, para_idx int, lang string, confidence double, n_chars int, whole boolean"


def segments(docs: DataFrame, model) -> DataFrame:
    """Runs of sentences of one language in each paragraph, with the language of the document.

    ``main`` is the language with the most text of the document (by letters of words; of equal ones the first of LANGUAGES), null
    if no text has one, ``main_confidence`` the mean over that text. ``lang`` is null for runs without a language, ``whole`` says whether a run
    holds a whole sentence. A document without words gives one row with a null para_idx. All of a document is in its row, so
    nothing is shuffled. model: broadcast. Texts of misread UTF-8 or of look-alike characters are read as
    they were meant.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        parts: dict[str, list[str]] = {}
        known: dict[str, tuple[int, float, int, bool]] = {}  # repeated sentences, as of headings and standing phrases, are read once
        for b in batches:
            where, order, fresh = [], [], {}
            if len(known) > CACHE_SENTENCES:
                known.clear()
            if len(parts) > CACHE_SENTENCES:
                parts.clear()
            for k, paragraphs in enumerate(b.column(2).to_pylist()):
                for i, p in enumerate(paragraphs or ()):
                    if p:
                        if p not in parts:
                            parts[p] = sentences(form(readable(p)))
                        for s in parts[p]:
                            where.append((k, i))
                            order.append(s)
                            if s not in known and s not in fresh:
                                fresh[s] = words(s)
            got, conf = net.predict(list(fresh.values()))
            for (s, w), lang, c in zip(fresh.items(), got.tolist(), conf.tolist()):
                known[s] = (lang, c, sum(map(len, w)), bool(w) and is_whole(s, w))
            rows: list[list] = []
            total = np.zeros((b.num_rows, len(LANGUAGES), 2))
            for (k, i), s in zip(where, order):
                lang, c, n, full = known[s]
                if not n:
                    continue
                if lang >= 0:
                    total[k, lang] += n, c * n
                last = rows[-1] if rows else None
                if last and last[0] == k and last[1] == i and last[2] == lang:
                    last[3], last[4], last[5] = last[3] + c * n, last[4] + n, last[5] or full
                else:
                    rows.append([k, i, lang, c * n, n, full])
            with_rows = {r[0] for r in rows}
            rows += [[k, None, -1, 0.0, 0, False] for k in range(b.num_rows) if k not in with_rows]
            main = total[:, :, 0].argmax(1) if b.num_rows else np.empty(0, int)
            size = total[np.arange(b.num_rows), main]
            code = [LANGUAGES[m] if n[0] > 0 else None for m, n in zip(main.tolist(), size)]
            sure = [float(n[1] / n[0]) if n[0] > 0 else None for n in size]
            at = [r[0] for r in rows]
            where = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(where), b.column(1).take(where), pa.array([code[k] for k in at], pa.string()), pa.array([sure[k] for k in at], pa.float64()),
                    pa.array([r[1] for r in rows], pa.int32()), pa.array([LANGUAGES[r[2]] if r[2] >= 0 else None for r in rows], pa.string()),
                    pa.array([r[3] / r[4] if r[4] else None for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.int32()), pa.array([r[5] for r in rows], pa.bool_()),
                ],
                names=["doc_id", "label", "main", "main_confidence", "para_idx", "lang", "confidence", "n_chars", "whole"],
            )

    return docs.select("doc_id", F.col("lang").alias("label"), "paragraphs").mapInArrow(run, SEGMENTS)


def label_column(label: str):
    """label_code as a column."""
    main = F.element_at(F.split(F.lower(F.trim(F.coalesce(label, F.lit("")))), "[-_ .@]"), 1)
    return F.coalesce(*[F.when(main.isin(names.split()), c) for c, names in NAMES.items()])


def detect(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The segments of all documents, by a model fitted on the labelled ones."""
    model = spark.sparkContext.broadcast(fit(training_rows(docs)))
    return segments(docs, model)


def wrong_labels(found: DataFrame) -> DataFrame:
    """(doc_id, para_idx, lang): documents whose label isn't their language (-1), and paragraphs with a whole sentence in another."""
    wrong = F.when(F.col("main").isNotNull() & ~F.col("main").eqNullSafe(label_column("label")), F.struct("doc_id", F.lit(-1).alias("para_idx"), F.col("main").alias("lang")))
    mixed = F.when(F.col("whole") & (F.col("lang") != F.col("main")), F.struct("doc_id", "para_idx", "lang"))
    return found.select(F.explode(F.array_compact(F.array(wrong, mixed))).alias("x")).select("x.*").distinct()
