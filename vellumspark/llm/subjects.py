"""Subject areas of documents by n-gram language models.

Each subject has an interpolated bigram model: its share of a bigram is mixed with the background's bigram probability scaled by how much
more often the subject has the word than its share of each language lets expect, with the more weight on its own share the
more often the background would let expect that bigram. The background models count all documents, words and bigrams by
language, in hashed tables of fixed size; each of the frequent language labels has a slot of its own, and the counts then tell the language of every document, as labels may be missing or wrong. The score of a sentence for a subject is its cross-entropy under
the background less the one under the subject, summed over its tokens. A sentence is on the subject of its highest score
if that, less half of the next one, reaches a threshold; a paragraph is about the subject of most of its sentences if their sum reaches a second threshold, so that a single sentence on another
subject doesn't count, and of equal ones about the one that the document has more sentences on; a document has each
subject that at least two of its paragraphs are about. The thresholds, that of a paragraph for each subject, are fitted on labelled documents that the models haven't seen.

The hand labels are few and name the document, not the sentence: a sentence of a document with several subjects belongs to all
of them at first, then in each round to the one that the models give it, and a sentence that points to a subject the document isn't
labelled with is left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 1 << 17
#: Slots for languages: 0 for texts without a label, one for each of the most frequent labels.
LANGS = 16
#: Labelled documents that the models are fitted on, at most (a documented bound).
LABELLED = 6000
#: Expected counts of a bigram and of a word at which the subject's own share and the background weigh alike.
MU_PAIR, MU_WORD = 1.0, 1.0
ROUNDS = 3
#: Thresholds to choose from, of a sentence and of the sum over a paragraph's sentences on its subject.
THRESHOLDS, PARAGRAPH_THRESHOLDS = (0.4, 0.7, 1.0, 1.5, 2.0, 2.5, 3.0), (0.0, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0)
#: Labels that the common threshold counts for against a subject's own.
SHRINK = 40
#: Thresholds of the first rounds.
FIRST = (2.0, 0.0)
#: How much of the second highest score of a sentence is taken from its highest one.
MARGIN = 0.5
STEP = 2000

#: Marks of ends of sentences and paragraphs as tokens, and of paragraphs that don't end in a stop: titles, headings, list items.
STOP, PARAGRAPH, NO_PROSE = "\x02", "\x03", "\x04"


class Tokens:
    """Hashed tokens of a block of texts, with their sentence, paragraph and document. slots: the language of each text, or what tells it."""

    def __init__(self, texts: pa.Array, slots: np.ndarray | Languages):
        s = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        s = pc.replace_substring_regex(s, r"([^\s.!?;။\"”“»)\]])[ \t]*([\r\n\x0b\x0c]|$)", rf"\1 {NO_PROSE} \2")
        s = pc.replace_substring_regex(s, r"[\r\n\x0b\x0c]+", f" {STOP} {PARAGRAPH} ")
        s = pc.replace_substring_regex(s, r"([.!?;])([\"”“»’)\]]*)\s", rf"\1\2 {STOP} ")
        s = pc.replace_substring_regex(s, "။", f" {STOP} ")
        s = pc.replace_substring_regex(s, r"[\"“”„«»()\[\],:;!?‘’'/|•၊]+", " ")
        lists = pc.split_pattern_regex(s, r"\s+")
        flat = pc.list_flatten(lists).dictionary_encode()
        values = flat.dictionary.to_pylist()
        index = flat.indices.to_numpy(zero_copy_only=False)
        kind = np.array([0 if not v.strip(".-–—…") else 1 if v == STOP else 2 if v == PARAGRAPH else -1 if v == NO_PROSE else 4 if any(c.isdigit() for c in v) else 3 for v in values], np.int8)
        code = np.array([0 if k < 3 else 1 if k == 4 else zlib.crc32(v.strip(".-–—…").encode("utf-8", "surrogatepass")) for v, k in zip(values, kind)], np.uint64)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(size)), size)
        k = kind[index] if len(index) else np.empty(0, np.int8)
        new_doc = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.empty(0, bool)
        sentence = np.cumsum((k == 1) | (k == 2) | new_doc)
        paragraph = np.cumsum((k == 2) | new_doc)
        word = k >= 3
        bare = np.zeros(int(paragraph[-1]) + 1 if len(paragraph) else 1, bool)
        bare[paragraph[k == -1]] = True
        h = code[index][word] if len(index) else np.empty(0, np.uint64)
        self.doc, self.sentence, self.paragraph = doc[word], sentence[word], paragraph[word]
        self.prose = ~bare[self.paragraph]
        self.n_docs = len(size)
        self.slots = slots = slots.assign((h % np.uint64(BINS)).astype(np.int64), self.doc, self.n_docs) if isinstance(slots, Languages) else slots
        slot = slots[self.doc].astype(np.uint64)
        h = np.where(h == 1, slot + np.uint64(101), h)  # codes and numbers, and below starts of sentences, are told apart by language
        self.first = np.r_[True, self.sentence[1:] != self.sentence[:-1]] if len(h) else np.empty(0, bool)
        before = np.where(self.first, slot + np.uint64(11), np.r_[np.uint64(11), h[:-1]] if len(h) else h)
        self.word = (h % np.uint64(BINS)).astype(np.int64)
        # Pairs, and the words that begin them, are counted by language.
        self.before = ((before + (slot << np.uint64(40)) * np.uint64(0xC2B2AE35)) % np.uint64(BINS)).astype(np.int64)
        mixed = before * np.uint64(0x9E3779B1) + h * np.uint64(0x85EBCA6B) + slot * np.uint64(0x27D4EB2F165667C5)
        self.pair = ((mixed ^ (mixed >> np.uint64(19))) % np.uint64(BINS)).astype(np.int64)
        self.starts = np.flatnonzero(self.first)


def code_of(label: str | None) -> str:
    """The primary subtag of a language label."""
    return re.match("[a-z]*", (label or "").strip().lower())[0]


def lang_slot(labels: list[str | None], codes: list[str]) -> np.ndarray:
    """The slot of the language label of each document; missing labels and those not among the codes share slot 0."""
    slot = {c: k + 1 for k, c in enumerate(codes)}
    return np.array([slot.get(code_of(x), 0) for x in labels], np.int64)


def frequent_codes(docs: DataFrame) -> list[str]:
    """The LANGS - 1 most frequent codes of language labels, of equal ones the first."""
    code = F.regexp_extract(F.lower(F.trim("lang")), "^[a-z]+", 0).alias("code")
    top = docs.select(code).filter("code <> ''").groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(LANGS - 1).collect()
    return [r.code for r in top]


class Languages:
    """Word counts by language slot; the language of a document is the one under which its words are likeliest, whatever its label says."""

    def __init__(self, words: np.ndarray):
        used = words.sum(1) > 0
        used[0] &= not used[1:].any()  # texts without a label are no language if there are others
        self.slots = np.flatnonzero(used) if used.any() else np.array([0])
        n = words[self.slots]
        self.log = np.log((n + 0.05) / (n + 0.05).sum(1, keepdims=True)).astype(np.float32)

    def assign(self, word: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        score = np.stack([np.bincount(doc, row[word], n_docs) for row in self.log])
        return self.slots[score.argmax(0)]


def background_counts(docs: DataFrame, codes: list[str]) -> DataFrame:
    """(slot, bin, n) over all documents: words by language slot, pairs (slot LANGS) and the words before others (LANGS + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((LANGS + 2) * BINS, np.int64)
        for b in batches:
            slots = lang_slot(b.column(1).to_pylist(), codes)
            for a in range(0, b.num_rows, STEP):
                total += background(Tokens(b.column(0).slice(a, STEP), slots[a : a + STEP]), slots[a : a + STEP])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // BINS).astype(np.int32)), pa.array((at % BINS).astype(np.int32)), pa.array(total[at])], names=["slot", "bin", "n"])

    return docs.select("text", "lang").mapInArrow(run, "slot int, bin int, n long").groupBy("slot", "bin").agg(F.sum("n").alias("n"))


def background(t: Tokens, slots: np.ndarray) -> np.ndarray:
    at = np.r_[slots[t.doc] * BINS + t.word, LANGS * BINS + t.pair, (LANGS + 1) * BINS + t.before]
    return np.bincount(at, minlength=(LANGS + 2) * BINS)


def certainty(scores: np.ndarray) -> np.ndarray:
    """The highest score of each sentence, less a part of the second if that speaks for its subject too."""
    two = np.sort(scores, 1)[:, -2:]
    return two[:, -1] - MARGIN * np.maximum(two[:, 0], 0) if scores.shape[1] > 1 else two[:, -1]


class Models:
    """Background and subject counts; scores tokens and decides subjects."""

    def __init__(self, counts: np.ndarray, n_subjects: int):
        counts = counts.reshape(LANGS + 2, BINS).astype(np.float64)
        words = counts[:LANGS]
        self.by_slot = words / np.maximum(words.sum(1, keepdims=True), 1)
        self.pairs, self.befores = counts[LANGS].astype(np.float32), counts[LANGS + 1].astype(np.float32)
        self.languages = Languages(words)
        self.k = n_subjects
        self.threshold = FIRST

    def count(self, t: Tokens, weight: np.ndarray) -> None:
        """Takes subject counts from tokens; weight: of each token for each subject."""
        self.word_s, self.pair_s, self.before_s = (np.zeros((BINS, self.k), np.float32) for _ in range(3))
        expected = np.zeros((BINS, self.k))
        for s in range(self.k):
            w = weight[:, s]
            self.word_s[:, s] = np.bincount(t.word, w, BINS)
            self.pair_s[:, s] = np.bincount(t.pair, w, BINS)
            self.before_s[:, s] = np.bincount(t.before, w, BINS)
            share = np.bincount(t.slots[t.doc], w, LANGS)
            expected[:, s] = share @ self.by_slot
        self.ratio = ((self.word_s + MU_WORD) / (expected + MU_WORD)).astype(np.float32)
        del self.word_s

    def scores(self, t: Tokens) -> np.ndarray:
        """Of each sentence and subject: what the subject's model saves."""
        if not len(t.word):
            return np.zeros((0, self.k), np.float32)
        p = (self.pairs[t.pair] / np.maximum(self.befores[t.before], 1)).clip(1e-7, 1)[:, None]
        gain = np.log((self.pair_s[t.pair] + MU_PAIR * self.ratio[t.word]) / (self.before_s[t.before] * p + MU_PAIR))
        return np.add.reduceat(gain, t.starts, axis=0)

    def decide(self, t: Tokens, scores: np.ndarray, threshold: tuple[float, float | np.ndarray]) -> list[tuple[int, int, int]]:
        """(document, subject, paragraphs) of each document and subject with two paragraphs about it. threshold: of a sentence, and of a paragraph for all or each subject."""
        if not len(scores):
            return []
        doc, paragraph = t.doc[t.starts], t.paragraph[t.starts]
        best = scores.argmax(1)
        weight = certainty(scores)
        least = np.broadcast_to(threshold[1], self.k)
        sure = (weight >= threshold[0]) & t.prose[t.starts]
        doc, paragraph, best, weight = doc[sure], paragraph[sure], best[sure], weight[sure]
        if not len(doc):
            return []
        in_doc = np.bincount(doc * self.k + best, minlength=t.n_docs * self.k)
        key, place, n = np.unique(paragraph * self.k + best, return_inverse=True, return_counts=True)
        total = np.bincount(place, weight)
        of = dict(zip(paragraph.tolist(), doc.tolist()))
        chosen: dict[int, tuple] = {}
        for x, c, w in zip(key.tolist(), n.tolist(), total.tolist()):
            q, s = divmod(x, self.k)
            rank = (c, int(in_doc[of[q] * self.k + s]), -s)
            if q not in chosen or rank > chosen[q][0]:
                chosen[q] = (rank, s, w)
        about: dict[tuple[int, int], int] = {}
        for q, (_, s, w) in chosen.items():
            if w < least[s]:
                continue
            about[of[q], s] = about.get((of[q], s), 0) + 1
        return [(d, s, c) for (d, s), c in about.items() if c >= 2]


def spread(models: Models | None, t: Tokens, labels: list[set[int]], k: int) -> np.ndarray:
    """Weight of each token for each subject, by its document's labels and, with models, its sentence."""
    allowed = np.zeros((t.n_docs, k), np.float32)
    for d, subjects in enumerate(labels):
        for s in subjects:
            allowed[d, s] = 1
    of_sentence = allowed[t.doc[t.starts]]
    if models is not None:
        score = models.scores(t)
        best, sure = score.argmax(1), certainty(score) >= models.threshold[0]
        inside = of_sentence[np.arange(len(best)), best] > 0
        one = np.zeros_like(of_sentence)
        one[np.arange(len(best)), best] = 1
        of_sentence = np.where((sure & inside)[:, None], one, np.where((sure & ~inside)[:, None], 0, of_sentence))
    of_sentence = of_sentence / np.maximum(of_sentence.sum(1, keepdims=True), 1)
    return np.repeat(of_sentence, np.diff(np.append(t.starts, len(t.word))), axis=0)


def f_score(found: set, true: set) -> float:
    return 2 * len(found & true) / max(1, len(found) + len(true))


def own_thresholds(decided: dict[float, set], true: set, k: int, best: float) -> np.ndarray:
    """The threshold of a paragraph of each subject: the one with the highest F-score on its held-out labels, where the score of the best common threshold counts as SHRINK labels more."""
    out = np.full(k, best)
    for s in range(k):
        of = lambda x: {p for p in x if p[1] == s}  # noqa: E731, B023
        right = of(true)
        base = f_score(of(decided[best]), right)
        score = {b: (2 * len(of(found) & right) + SHRINK * base) / max(1, len(of(found)) + len(right) + SHRINK) - 1e-6 * abs(b - best) for b, found in decided.items()}
        out[s] = max(score, key=score.get)
    return out


def fit(counts: np.ndarray, labelled: list[tuple[str, set[int]]], k: int) -> Models:
    """Models from (text, subjects)."""
    m = Models(counts, k)
    labels = [x[1] for x in labelled]
    t = Tokens(pa.array([x[0] for x in labelled], pa.string()), m.languages)
    train = np.arange(len(labels)) % 4 > 0

    def learn(given: list[set[int]]) -> None:
        m.threshold = FIRST
        m.count(t, spread(None, t, given, k))
        for _ in range(ROUNDS):
            m.count(t, spread(m, t, given, k))

    learn([s if train[d] else set() for d, s in enumerate(labels)])
    true = {(d, s) for d, subjects in enumerate(labels) if not train[d] for s in subjects}
    score = m.scores(t)
    held = lambda x: {(d, s) for d, s, _ in m.decide(t, score, x) if not train[d]}
    m.held_out, best = max((f_score(held(x), true), x) for x in ([(a, b) for a in THRESHOLDS for b in PARAGRAPH_THRESHOLDS] if true else [FIRST]))
    own = own_thresholds({b: held((best[0], b)) for b in PARAGRAPH_THRESHOLDS}, true, k, best[1]) if true else np.full(k, best[1])
    learn(labels)
    m.threshold = (best[0], own)
    return m


FOUND = "doc_id long, subject int, paragraphs int"


def classify(docs: DataFrame, models) -> DataFrame:
    """(doc_id, subject number, paragraphs) for each subject of each document. models: broadcast. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = models.value
        for b in batches:
            for a in range(0, b.num_rows, STEP):
                t = Tokens(b.column(1).slice(a, STEP), m.languages)
                rows = m.decide(t, m.scores(t), m.threshold)
                at = pa.array([a + r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=["doc_id", "subject", "paragraphs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def sample(df: DataFrame, n_max: int, salt: int) -> DataFrame:
    """About n_max rows by a hash of doc_id, at most a half more; all of them if there are fewer."""
    n = df.count()
    if n > n_max:
        df = df.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < F.lit(int(1_000_000 * n_max / n)))
    return df.limit(n_max + n_max // 2)


def fit_models(spark: SparkSession, docs: DataFrame, labels: DataFrame, subject_ids: list[int]) -> Models | None:
    """None without labelled documents. At most (LANGS + 2) * BINS counts and 1.5 * LABELLED documents come to the driver."""
    counts = background_counts(docs, frequent_codes(docs)).toArrow()
    total = np.zeros((LANGS + 2, BINS))
    total[counts["slot"].to_numpy(), counts["bin"].to_numpy()] = counts["n"].to_numpy()
    number = {s: k for k, s in enumerate(subject_ids)}
    given = labels.filter(F.col("subject_id").isin(subject_ids)).groupBy("doc_id").agg(F.collect_set("subject_id").alias("subjects"))
    # The sample has at most 1.5 * LABELLED rows of an id and a few numbers, so it goes to the texts, not the texts to it.
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample(given, LABELLED, 1)), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return fit(total, [(r.text, {number[s] for s in r.subjects}) for r in rows], len(subject_ids)) if rows else None


def document_subjects(spark: SparkSession, docs: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject, paragraphs) of all documents, each once; no row without subjects or labelled documents."""
    names = sorted((r.subject_id, r.subject) for r in areas.filter("subject_id is not null").groupBy("subject_id").agg(F.min("subject").alias("subject")).collect())
    fitted = fit_models(spark, docs, labels, [n[0] for n in names]) if names else None
    if fitted is None:
        return spark.createDataFrame([], "doc_id long, subject string, paragraphs int")
    models = spark.sparkContext.broadcast(fitted)
    named = F.element_at(F.array(*[F.lit(n[1]) for n in names]), F.col("subject") + 1)
    return classify(docs, models).groupBy("doc_id", named.alias("subject")).agg(F.max("paragraphs").alias("paragraphs"))
