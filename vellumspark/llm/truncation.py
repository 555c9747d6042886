"""Values that were cut off inside a word or a sentence.

Intact values are cut artificially, some of them at the lengths at which the tables have many values without a stop, and get what
systems put after a cut; a hashed logistic regression learns from their closing characters, words, punctuation and length-to-limit
features to tell them from the values as they are. Further features say how the value stands in the paragraphs of its source document: whether it
ends with a paragraph, ends with a sentence, goes on, or isn't there. A source may be cut itself, so a share of the artificial cuts is seen with a source that ends there too.

Each half of the values is judged by a fit on the other half, without the source, and the values that are probably cut themselves, or go on in their source, are taken out of the intact ones before the last fit.
Documents left out of all fits calibrate the score: the share of cut values among them is estimated from their scores, and the score is the probability under that
share. Every value is scored, and a value is cut if its score is at least 0.5; there is no other rule. How often each word stands inside a text and at
the end of a sentence, and the lengths of values, are counted over all values, the words in a table of fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import readable

FEATURES = 1 << 18
WORDS = 1 << 18
#: Least number of entries of the table of frequent lengths; it is longer if a longer length is frequent.
LENGTHS = 1 << 13
#: Values that the classifier is fitted on (a documented bound).
TRAIN_VALUES = 20_000
EPOCHS, RATE, DECAY = 6, 0.5, 1e-6
SEED = 20260102
#: Score from which a value is cut: the likelier half of a calibrated probability.
CUT = 0.5
#: Score above which a value is left out of the intact ones, and share of the artificial cuts whose source is cut there too.
TAKEN_OUT, SOURCE_CUT = 0.9, 0.3
#: Share of cut values that the calibration assumes at least, so that the first cut value of a table is found too.
LEAST_SHARE = 0.01
#: One document in so many is left out of the fits and calibrates the score.
HELD_OUT = 5
#: Values of a document, and deliveries of it, above which it is split over several tasks, and how many such documents are looked up by broadcast.
HOT_VALUES, HOT_DELIVERIES, HOT_DOCUMENTS = 20_000, 1_000, 50_000

STOPS = ".!?။．。;"
CLOSERS = "\"'”“’»)]"
MARKER = re.compile(r"\s*(?:\[(?:\.{3}|…)\]|\((?:\.{3}|…)\)|\.{3,}|…)\s*\Z")
SENTENCE_END = re.compile(r"[.!?။;．。]['\"”“»’)\]]*(?:\s|\Z)|။|[\n\r]")
BULLET = re.compile(r"^\s*[•◦▪●*\-–]\s+")


LABEL = re.compile(r"[^.!?။\n]{2,30}:\s")


def bin_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS


def core(token: str) -> str:
    return token.strip("\"'“”„«»‘’()[]{}.,:;!?။၊…–—-•|/").lower()


def word_counts(texts: pa.Array) -> np.ndarray:
    """How often each word stands before another word, and before the end of a sentence; the last word of a text doesn't count."""
    total = np.zeros(2 * WORDS, np.int64)
    texts = pc.utf8_trim_whitespace(pc.drop_null(texts).cast(pa.large_string()))
    lists = pc.split_pattern_regex(texts, r"\s+")
    coded = pc.list_flatten(lists).dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    if not len(index):
        return total
    last = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)) - 1
    n = np.bincount(index, minlength=len(coded.dictionary)) - np.bincount(index[last[last >= 0]], minlength=len(coded.dictionary))
    for token, c in zip(coded.dictionary.to_pylist(), n.tolist()):
        word = core(token)
        if c > 0 and word:
            total[bin_of(word) + WORDS * (token.rstrip(CLOSERS)[-1:] in STOPS)] += c
    return total


def length_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of values, without blanks at the ends, and without a stop at the end, and how many values have each."""
    s = pc.utf8_trim_whitespace(pc.drop_null(texts).cast(pa.large_string()))
    s = s.filter(pc.invert(pc.match_substring_regex(s, r"[.!?;:။][\"'”“»’)\]]*$")))
    return np.unique(pc.utf8_length(s).to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)


def limits(counts: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """Which lengths (of values without a stop) are far more frequent than those around them; counts: of each of ``lengths``,
    of 0, 1, ... without them. At least 8 values must have a length, and in a table of under 8,000 values one in 1,000, at least 5."""
    lengths = np.arange(len(counts)) if lengths is None else lengths
    n = dict(zip(lengths.tolist(), counts.tolist()))
    least = min(8, max(5, int(counts.sum()) // 1000))
    found = [k for k, c in n.items() if c >= least and c > 6 * np.median([n.get(j, 0) for j in range(max(0, k - 12), k + 13)]) + 4]
    spikes = np.zeros(max([LENGTHS, *(k + 2 for k in found)]), bool)
    spikes[found] = True
    return spikes


class Tail:
    """How a value ends."""

    def __init__(self, text: str):
        s = text.rstrip()
        m = MARKER.search(s)
        self.marker = m[0].strip() if m and m.start() > 0 else ""
        self.body = s[: m.start()] if self.marker else s
        bare = self.body.rstrip(CLOSERS)
        self.stop = bare[-1:] if bare[-1:] in STOPS else ""
        self.closed = self.body[len(bare) :]


class Source:
    """The paragraphs of a document, to be searched for its values."""

    def __init__(self, paragraphs: list[str | None]):
        self.joined = "\x00".join(["", *(readable(p) for p in paragraphs if p), ""])
        self.known_flat: str | None = None

    @property
    def flat(self) -> str:
        """The same with single spaces for all white space."""
        if self.known_flat is None:
            self.known_flat = re.sub(r"\s+", " ", self.joined)
        return self.known_flat

    def place(self, text: str) -> str:
        """How a value stands in the source: ``p`` it ends where a paragraph does, ``s`` where a sentence does, ``i`` it goes on in all places
        where it begins as a paragraph or a sentence, ``-`` it isn't there; with a digit for the form that was found: whole, last line, flattened.
        """
        if len(self.joined) < 2:
            return "-"
        forms = decoration(text)
        for number, group, source in ((0, lambda: forms, lambda: self.joined), (1, lambda: [x for x in (f.rpartition("\n")[2].strip() for f in forms) if len(x) > 3], lambda: self.joined), (2, lambda: [" ".join(f.split()) for f in forms], lambda: self.flat)):
            found = self._ends(group(), source())
            if found:
                return f"{found}{number}"
        return "-"

    def _ends(self, forms: list[str], source: str) -> str:
        inside = sentence = False
        for form in forms:
            stopped = form[-1] == "။" or form.rstrip(CLOSERS)[-1:] in STOPS
            at = source.find(form)
            while at >= 0:
                stop = at + len(form)
                rest, lead = source[stop : stop + 2], source[max(0, at - 3) : at]
                if lead[-1:] in ("\x00", "\n") or not lead.strip() or SENTENCE_END.search(lead):
                    if rest[:1] == "\x00" or rest[:1] in ".;,:!?။" and rest[1:2] == "\x00":
                        return "p"
                    if rest[:1] == "\n" or rest == " •" or stopped and not rest[:1].isalnum() or rest[:1] in ".!?။" and rest[1:2].isspace():
                        sentence = True
                    else:
                        inside = True
                at = source.find(form, at + 1)
        return "s" if sentence else "i" if inside else ""


NO_SOURCE = Source([])
#: The place of a value whose source isn't looked at.
UNSEEN = "?"


def features(raw: str, text: str, place: str, words: np.ndarray, spikes: np.ndarray) -> list[int]:
    """Bins of the features of a value. text: the value as it can be read; place: how it stands in its source."""
    size = len(raw.strip())
    t = Tail(text)
    body = t.body
    inner = body.rstrip(CLOSERS).rstrip(STOPS) if t.stop else body
    cut = 0
    for m in SENTENCE_END.finditer(inner):
        if m.end() < len(inner):
            cut = m.end()
    sentence = inner[cut:].strip()
    tokens = sentence.split()
    last = core(tokens[-1]) if tokens else ""
    before = core(tokens[-2]) if len(tokens) > 1 else "<"
    first = " ".join(core(x) for x in tokens[:2])
    stop = t.stop + ("+" if t.closed else "") + t.marker
    end = body[-1:]
    kind = "a" if end.islower() else "A" if end.isupper() else "9" if end.isdigit() else "m" if "က" <= end <= "႟" else end
    k = bin_of(last) if last else 0
    inside, ends = (int(words[k]), int(words[WORDS + k])) if last else (0, 0)
    seen = inside + ends
    rate = -1 if seen < 3 else round(4 * ends / seen)
    head = next((c for c in sentence if c.isalpha()), "")
    up = "u" if head.isupper() else "m" if "က" <= head <= "႟" else "l" if head else "-"
    shape = f"{up}{min(len(tokens), 12)}{'i' if cut else ''}{'b' if BULLET.match(text) else ''}{'|' if '|' in text else ''}{':' if ':' in sentence else ''}"
    longest = len(spikes) - 1
    spike = bool(spikes[min(size, longest)]) or bool(t.marker and spikes[min(len(body), longest)]) or bool(t.stop and spikes[min(len(inner), longest)])
    quotes = sum(sentence.count(c) for c in "“„«(") - sum(sentence.count(c) for c in "”»)") - ("“" in sentence and "„" in sentence)
    bucket = 0 if seen == 0 else 1 if seen < 3 else 2 if seen < 20 else 3
    prose = unstopped_prose(t)
    found = (
        f"k{kind}", f"m{t.marker}", f"s{stop}", f"v{bucket}{rate}{stop}", f"w{last}{stop}", f"b{before} {last}{stop}", f"3{last[-3:]}{stop}", f"2{last[-2:]}{kind}",
        f"l{min(len(last), 7)}{stop}{up}", f"h{shape}{stop}", f"p{spike}{stop}", f"q{quotes > 0}{stop}", f"f{first}|{last}|{stop}", f"n{first}|{min(len(tokens), 30)}|{stop}", f"g{before}|{stop}|{kind}",
        f"c{shape}{spike}{kind}", f"r{bucket}{kind}{up}",
        f"S{place}", f"T{place[0]}{prose}{bool(t.stop)}", f"U{place}{shape}", f"V{place[0]}{bucket}{rate}{stop}", f"W{place[0]}{kind}{up}{t.marker}", f"X{place[0]}{spike}{bool(stop)}{prose}",
    )
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % FEATURES for f in found]


Value = tuple[str, str, str]  # as it is, as it can be read, its place in its source


def value(text: str, source: Source) -> Value:
    clear = readable(text)
    return text, clear, source.place(clear)


def cut_values(texts: list[tuple[str, Source]], spikes: np.ndarray, rng: np.random.Generator) -> list[Value]:
    """A cut form of each value that can be cut inside a sentence."""
    at_limit = np.flatnonzero(spikes)
    out = []
    for text, source in texts:
        s = text.strip()
        if len(s) < 24 or not (Tail(s).stop or "\n" in s or "|" in s):
            continue
        for _ in range(4):
            here = at_limit[at_limit < len(s) - 3]
            n = int(rng.choice(here)) if len(here) and rng.random() < 0.5 else int(rng.integers(12, len(s) - 2))
            piece, rest = s[:n].rstrip(), s[n:]
            ended = SENTENCE_END.search(piece[-4:] + rest[:1])
            if not (piece and (Tail(piece).stop or ended and ended.end() >= len(piece[-4:]))):
                break
        else:
            continue
        r = rng.random()
        new = value(piece if r < 0.55 else piece + ("…" if r < 0.65 else "..." if r < 0.75 else " [...]" if r < 0.83 else "။" if "က" <= piece[-1] <= "႟" else "."), source)
        out.append((*new[:2], "p" + new[2][1:]) if new[2][0] == "i" and rng.random() < SOURCE_CUT else new)
    return out


class Model:
    def __init__(self, words: np.ndarray, spikes: np.ndarray):
        self.words, self.spikes = words, spikes
        self.weight, self.bias, self.shift = np.zeros(FEATURES, np.float32), 0.0, 0.0

    def rows(self, values: list[Value]) -> np.ndarray:
        return np.array([features(*v, self.words, self.spikes) for v in values], np.int64) if values else np.zeros((0, 1), np.int64)

    def train(self, rows: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        self.weight[:] = 0
        self.bias = 0.0
        square = np.full(FEATURES, 0.1, np.float32)
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            for a in range(0, len(order), 64):
                at = order[a : a + 64]
                p = 1 / (1 + np.exp(-(self.weight[rows[at]].sum(1) + self.bias)))
                g = (p - y[at]).astype(np.float32)
                flat, step = rows[at].ravel(), np.repeat(g, rows.shape[1])
                by, inverse = np.unique(flat, return_inverse=True)
                total = np.bincount(inverse, step).astype(np.float32) + DECAY * self.weight[by]
                square[by] += total**2
                self.weight[by] -= RATE * total / np.sqrt(square[by])
                self.bias -= 0.02 * float(g.mean())

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return self.weight[rows].sum(1) + self.bias if len(rows) else np.zeros(0)

    def score(self, values: list[Value]) -> np.ndarray:
        """The calibrated probability that each value is cut."""
        return 1 / (1 + np.exp(-(self.logits(self.rows(values)) + self.shift).clip(-50, 50)))

    def calibrate(self, cuts: np.ndarray, share: float) -> None:
        """Fits the shift of the log odds from values as they are: the share of cut ones among them is that which their scores under it give again.

        cuts: rows of the values; share: of the positives in training.
        """
        odds = self.logits(cuts)
        trained = np.log(share / (1 - share))
        prior = share
        for _ in range(200):
            self.shift = np.log(prior / (1 - prior)) - trained
            new = float((1 / (1 + np.exp(-(odds + self.shift).clip(-50, 50)))).mean().clip(LEAST_SHARE, 0.9))
            if abs(new - prior) < 1e-6:
                break
            prior = new


def fit(given: list[tuple[str, Source, bool]], words: np.ndarray, spikes: np.ndarray) -> Model:
    """The classifier from values as they are, most of them intact: text, source, and whether it is held out for the calibration."""
    rng = np.random.default_rng(SEED)
    m = Model(words, spikes)
    given = [g for g in given if g[0] and not g[0].isspace()]
    if not given:
        m.bias = -50.0
        return m
    texts, sources, held = zip(*given)
    values = [value(t, s) for t, s in zip(texts, sources)]
    whole, bare, held = m.rows(values), m.rows([(a, b, UNSEEN) for a, b, _ in values]), np.array(held)
    share = 0.5

    def train(part: np.ndarray, rows: np.ndarray, seen: bool) -> None:
        nonlocal share
        made = cut_values([(texts[k], sources[k]) for k in part], spikes, rng)
        cuts = m.rows(made if seen else [(a, b, UNSEEN) for a, b, _ in made])
        both = np.concatenate([rows[part], cuts]) if len(cuts) else rows[part]
        share = float(np.clip(len(cuts) / max(1, len(both)), 1e-3, 0.999))
        m.train(both, np.r_[np.zeros(len(part)), np.ones(len(cuts))], rng)

    # Without the source first. Values that go on in their source are in doubt, so none of them is taken as intact in the last fit.
    fold = rng.integers(0, 2, len(texts))
    good = ~held & np.array([v[2][0] != "i" for v in values])
    for k in (0, 1):
        train(np.flatnonzero((fold != k) & ~held), bare, False)
        good &= (fold != k) | (m.logits(bare) < np.log(TAKEN_OUT / (1 - TAKEN_OUT)))
    train(np.flatnonzero(good), whole, True)
    m.calibrate(whole[held] if held.any() else whole, share)
    return m


def decoration(text: str) -> list[str]:
    """Forms of a value that its source may hold: without marks before it, what was put after the cut, and blanks."""
    t = Tail(text)
    plain = BULLET.sub("", text).strip()
    body = BULLET.sub("", t.body).strip()
    out = [plain, body]
    if t.stop and not t.closed:
        out += [plain[:-1].rstrip(), body[:-1].rstrip()]
    if body.endswith("�"):
        out.append(body.rstrip("�"))
    return list(dict.fromkeys(x for x in out if x))


def unstopped_prose(t: Tail) -> bool:
    """Whether a value ends in running text without a stop."""
    last = t.body.rpartition("\n")[2].strip()
    head = next((c for c in last if c.isalpha()), "a")
    words = last.split()
    return not (t.stop and not t.marker) and len(last) >= 40 and (not head.islower()) and "|" not in last and "/" not in words[-1] and not (LABEL.match(last) and len(last) < 80)


def values(section_slots: DataFrame, slot_assignments: DataFrame) -> DataFrame:
    """(tab, doc_id, slot_id, para_idx, text) of both tables; null and blank texts are left out."""
    a = section_slots.select(F.lit("section_slots").alias("tab"), "doc_id", "slot_id", F.posexplode("content_paragraphs").alias("para_idx", "text"))
    b = slot_assignments.select(F.lit("slot_assignments").alias("tab"), "doc_id", "slot_id", F.lit(-1).alias("para_idx"), F.col("chunk_text").alias("text"))
    return a.unionByName(b).filter(F.col("text").rlike(r"\S"))


def statistics(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, word counts and frequent lengths of all values; 2 * WORDS numbers and one for each different length come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * WORDS, np.int64)
        lengths: Counter[int] = Counter()
        size = 0
        for b in batches:
            size += b.num_rows
            total += word_counts(b.column(0))
            for k, n in zip(*map(np.ndarray.tolist, length_counts(b.column(0)))):
                lengths[k] += n
        at = np.flatnonzero(total)
        bins, n = [-1, *at.tolist(), *(2 * WORDS + k for k in lengths)], [size, *total[at].tolist(), *lengths.values()]
        yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), pa.array(n, pa.int64())], names=["bin", "n"])

    got = df.select("text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    at, n = got["bin"].to_numpy(), got["n"].to_numpy()
    size, at, n = int(n[at < 0].sum()), at[at >= 0], n[at >= 0]
    word = at < 2 * WORDS
    total = np.zeros(2 * WORDS, np.int64)
    total[at[word]] = n[word]
    return size, total, limits(n[~word], at[~word] - 2 * WORDS)


def training_values(df: DataFrame, cleaned: DataFrame, n: int) -> list[tuple[str, Source, bool]]:
    """About TRAIN_VALUES values, at most twice as many, of documents chosen by a hash of their id, with their sources; all if there are fewer."""
    if n > TRAIN_VALUES:
        chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(max(1, int(1_000_000 * TRAIN_VALUES / n)))
        df, cleaned = df.filter(chosen), cleaned.filter(chosen)
    rows = df.select("doc_id", "text").distinct().limit(2 * TRAIN_VALUES).collect()
    docs: dict[str, Source] = {}
    for r in sorted(cleaned.filter("doc_id is not null and paragraphs is not null").select("doc_id", "paragraphs").distinct().limit(2 * TRAIN_VALUES).collect()):
        docs[r.doc_id] = Source(r.paragraphs)
    rows.sort(key=lambda r: (r.doc_id or "", r.text))
    return [(r.text, docs.get(r.doc_id, NO_SOURCE), zlib.crc32((r.doc_id or "").encode("utf-8", "surrogatepass")) % HELD_OUT == 0) for r in rows]


def by_document(spark: SparkSession, vals: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(doc_id, salt, kind, tab, slot_id, para_idx, text, paragraphs): the values of each document (kind 1) after its source (kind 0), one shuffle for both.

    A document with more than HOT_VALUES values is split by a salt, its source copied to each part; one with more than HOT_DELIVERIES
    deliveries makes all sources be reduced to one a document before the shuffle.
    """
    counts = vals.groupBy("doc_id").agg(F.count("*").alias("n_values"), F.lit(0).alias("n_docs")).unionByName(cleaned.groupBy("doc_id").agg(F.lit(0).alias("n_values"), F.count("*").alias("n_docs")))
    hot = counts.filter(f"doc_id is not null and (n_values > {HOT_VALUES} or n_docs > {HOT_DELIVERIES})").groupBy("doc_id").agg(F.sum("n_values").alias("n_values"), F.sum("n_docs").alias("n_docs"))
    few = hot.limit(HOT_DOCUMENTS + 1).collect()
    docs = cleaned.filter("doc_id is not null").select("doc_id", "paragraphs")
    salt = F.lit(0)
    if any(r.n_docs > HOT_DELIVERIES for r in few):
        docs = docs.groupBy("doc_id").agg(F.max("paragraphs").alias("paragraphs"))
    if few:
        parts = hot.select("doc_id", F.ceil(F.col("n_values") / HOT_VALUES).cast("int").alias("parts")).filter("parts > 1")
        parts = F.broadcast(parts) if len(few) <= HOT_DOCUMENTS else parts
        vals, docs = vals.join(parts, "doc_id", "left"), docs.join(parts, "doc_id", "left")
        docs = docs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        salt = F.pmod(F.xxhash64("tab", "slot_id", "para_idx", "text"), F.coalesce("parts", F.lit(1))).cast("int")
    # Values without a document have no source; they are spread by their text.
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(1 << 20)).cast("int")).otherwise(salt)
    docs = docs if "salt" in docs.columns else docs.withColumn("salt", F.lit(0))
    null = lambda kind: F.lit(None).cast(kind)
    a = docs.select("doc_id", "salt", F.lit(0).alias("kind"), null("string").alias("tab"), null("int").alias("slot_id"), null("int").alias("para_idx"), null("string").alias("text"), "paragraphs")
    b = vals.select("doc_id", salt.alias("salt"), F.lit(1).alias("kind"), "tab", "slot_id", "para_idx", "text", null("array<string>").alias("paragraphs"))
    return a.unionByName(b).repartition("doc_id", "salt").sortWithinPartitions("doc_id", "salt", "kind")


SCORED = "tab string, doc_id string, slot_id int, para_idx int, text string, score double"


def score_values(rows: DataFrame, model, least: float = 0.0) -> DataFrame:
    """The values of ``by_document`` with the probability that each is cut, those of at least ``least``. model: broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        doc, best, source = None, None, NO_SOURCE
        known: dict[str, int] = {}
        for b in batches:
            fresh: list[Value] = []
            known.clear()
            at, of = [], []
            texts = b.column(6).to_pylist()
            sources = b.column(7)
            for k, (d, kind) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                if d is None or d != doc:
                    doc, best, source = d, None, NO_SOURCE
                    known.clear()
                if kind == 0:
                    # Of several deliveries the largest counts, whatever their order.
                    paragraphs = sources[k].as_py()
                    if paragraphs and (best is None or [p or "" for p in paragraphs] > [p or "" for p in best]):
                        best, source = paragraphs, None
                    continue
                if source is None:
                    source = Source(best)
                text = texts[k]
                if text not in known:
                    known[text] = len(fresh)
                    fresh.append(value(text, source))
                at.append(k)
                of.append(known[text])
            score = m.score(fresh)[of] if fresh else np.zeros(0)
            keep = score >= least
            at = pa.array(np.array(at, np.int64)[keep])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in (3, 0, 4, 5, 6)), pa.array(score[keep], pa.float64())], names=["tab", "doc_id", "slot_id", "para_idx", "text", "score"])

    return rows.mapInArrow(run, SCORED)


def cut_off(spark: SparkSession, section_slots: DataFrame, slot_assignments: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(tab, doc_id, slot_id, para_idx, text, score) of the values that were cut, each once; of repeated ones with different texts the likeliest.

    Null and blank texts are no cases; values of a null document, or one without a source, are scored without a source. Empty tables give no row.
    """
    all_values = values(section_slots, slot_assignments)
    n, counts, spikes = statistics(all_values)
    model = spark.sparkContext.broadcast(fit(training_values(all_values, cleaned, n), counts.astype(np.int32), spikes))
    found = score_values(by_document(spark, all_values, cleaned), model, CUT)
    best = F.max_by(F.struct("text", "score"), F.struct("score", "text")).alias("x")
    return found.groupBy("tab", "doc_id", "slot_id", "para_idx").agg(best).select("tab", "doc_id", "slot_id", "para_idx", "x.text", "x.score")


def by_source(section_slots: DataFrame, slot_assignments: DataFrame, found: DataFrame, extracted: DataFrame) -> DataFrame:
    """How many values of each source there are and how many are cut: source, n_values, n_cut, share. A null source is one of its own."""
    keys = ["tab", "doc_id", "slot_id", "para_idx"]
    per_doc = values(section_slots, slot_assignments).select(keys).distinct().groupBy("doc_id").agg(F.count("*").alias("n_values"))
    cut = found.groupBy("doc_id").agg(F.count("*").alias("n_cut"))
    source = extracted.groupBy("doc_id").agg(F.max("source").alias("source"))
    out = per_doc.join(cut, "doc_id", "left").join(source, "doc_id", "left").groupBy("source").agg(F.sum("n_values").alias("n_values"), F.coalesce(F.sum("n_cut"), F.lit(0)).alias("n_cut"))
    return out.withColumn("share", F.col("n_cut") / F.col("n_values"))
