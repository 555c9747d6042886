"""Text decoded with a wrong character encoding: detection and repair.

A unit (a run of characters outside ASCII and of entities and escapes of such, with the two characters before and after it) is repaired by a search over operations: misread UTF-8 under a code page is
decoded again, text of one single-byte code page that was read as another is mapped back, a no-break space that was
stored as a plain space is put back, and entities and escapes are resolved. The search is best-first: of the open states the cheapest is
visited next, and visited states are hashed. It goes on until no state is
open: all operations but the mapping, of which a way has one, shorten the text or can't follow themselves, so the states of a unit are
finite (at most 7,740 in the test tables) and the result is the cheapest of all. The cost of a state is only added up as far as it can
still win, whatever stands around the run. The cost of a text is the implausibility of its characters: the sum, over the
windows of three characters with at least one outside ASCII, of the negative log share of that window among all such windows of
the corpus; a window that the corpus lacks counts twice. An entity or escape of a character outside ASCII costs as much as a character
that the corpus lacks; those of ASCII characters are markup or code and no sign of a wrong encoding. The window counts are taken over all paragraphs, in a hashed table of fixed
size. A unit is garbled if the cheapest text reached saves at least ``MIN_GAIN``, or if it holds U+FFFD, the mark of a lost
character. Units repeat a lot in any language, so each worker searches each different one once.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from html.entities import html5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 1 << 20
MIN_GAIN = 3.0
CACHE_UNITS = 200_000
LOST = "�"

#: Code pages that UTF-8 is misread in, and pairs (read as, really) of single-byte pages (parameters).
MISREAD = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250")
SWAPPED = (("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"))
#: Cost of each operation on the way.
STEP = 0.5


def code_page(name: str) -> list[str]:
    """The characters of the upper 128 bytes; an undefined byte is the control character of its number."""
    return [bytes([b]).decode(name, "ignore") or chr(b) for b in range(128, 256)]


class Misread:
    """UTF-8 that was read in a code page: each well-formed sequence is decoded, all else stays."""

    def __init__(self, name: str):
        page = code_page(name)
        self.byte = {c: 128 + k for k, c in enumerate(page)}
        self.decoded: dict[str, str] = {}
        part = lambda a, b: "[" + "".join(re.escape(page[x - 128]) for x in range(a, b + 1)) + "]"
        tail = part(0x80, 0xBF)
        self.sequence = re.compile(f"{part(0xC2, 0xDF)}{tail}|{part(0xE0, 0xEF)}{tail}{{2}}|{part(0xF0, 0xF4)}{tail}{{3}}")

    def _decode(self, m: re.Match) -> str:
        found = m[0]
        new = self.decoded.get(found)
        if new is None:
            try:
                new = bytes(self.byte[c] for c in found).decode("utf-8")
            except UnicodeDecodeError:
                new = found
            if len(self.decoded) < CACHE_UNITS:
                self.decoded[found] = new
        return new

    def __call__(self, text: str) -> str:
        return self.sequence.sub(self._decode, text)


class Swapped:
    """Text of one single-byte code page that was read in another."""

    def __init__(self, read: str, really: str):
        pairs = zip(code_page(read), code_page(really))
        self.table = {ord(a): b for a, b in pairs if a != b and unicodedata.category(a) not in ("Zs", "Cf")}

    def __call__(self, text: str) -> str:
        return text.translate(self.table)


def entities(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def escapes(text: str) -> str:
    return re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1] or m[2], 16)), text) if "\\" in text else text


def lost_space(text: str) -> str:
    """The second byte of a misread letter was a no-break space and has become a plain one."""
    return text[:-1] + "à" if text.endswith("Ã") else text


#: A way holds at most one operation of the last kind, since two of them in a row can turn any letter into nearly any other.
OPERATIONS = [*((op, False) for op in (*map(Misread, MISREAD), entities, escapes, lost_space)), *((Swapped(*n), True) for n in SWAPPED)]

MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint64)


def windows(token: str) -> np.ndarray:
    """Bins of the token's windows that hold a character outside ASCII; the token stands between spaces."""
    code = np.frombuffer(f" {token} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    high = code > 127
    keep = high[:-2] | high[1:-1] | high[2:]
    mixed = code[:-2][keep] * MIX[0] + code[1:-1][keep] * MIX[1] + code[2:][keep] * MIX[2]
    return ((mixed ^ (mixed >> np.uint64(17))) % np.uint64(BINS)).astype(np.int64)


def window(three: str) -> int:
    """The bin of one window."""
    mixed = sum(ord(c) * m for c, m in zip(three, MIX.tolist()))
    return (mixed ^ (mixed >> 17)) % BINS


#: Runs of characters outside ASCII and Myanmar, with single visible ASCII characters between them.
OUTSIDE = "[^\x00-\x7fက-႟]"
RUN = re.compile(f"{OUTSIDE}+(?:[!-~]{OUTSIDE}+)*")
#: An entity, also one whose & was made an entity again, or an escape.
ESCAPE = re.compile(r"&(?:amp;)*(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z]\w{1,30});|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}")
#: The same runs in texts with a & or backslash, where entities and escapes belong to them.
RUN_ESCAPED = re.compile(f"(?:{OUTSIDE}|{ESCAPE.pattern})+(?:[!-~](?:{OUTSIDE}|{ESCAPE.pattern})+)*")
#: Characters that no operation changes.
INERT = re.compile("[\x00-\x7fက-႟]*\\Z")
BEFORE, AFTER = re.compile(r"\S{0,2}\Z"), re.compile(r"\S{0,2}")


def hidden(token: str) -> int:
    """How many characters outside ASCII stand in the token as entities or escapes."""

    def is_one(found: str) -> bool:
        if found[0] == "\\":
            return not escapes(found).isascii()
        name = found[1:].replace("amp;", "")
        return (name[:1] == "#" or name in html5) and not html.unescape(f"&{name}").isascii()

    return sum(map(is_one, ESCAPE.findall(token))) if "&" in token or "\\" in token else 0


class Repairer:
    """Searches units under a table of window costs; keeps the results of up to CACHE_UNITS units."""

    def __init__(self, cost: np.ndarray):
        self.table = cost
        self.escaped = 3 * float(cost.max())
        self.around = 4 * float(cost.max()) + STEP  # what the windows at the ends of a run can make up for
        self.known: dict[str, str | None] = {}
        self.by_window: dict[str, float] = {}
        self.runs: dict[tuple[str, bool], list[tuple[str, str, str, float]]] = {}
        self.n_runs = 0

    def cost(self, token: str) -> float:
        return self.sum(f" {token} ") + self.escaped * hidden(token)

    def sum(self, text: str, limit: float = np.inf) -> float:
        """The cost of the windows of a text with what stands around it; infinite as soon as it is above the limit."""
        total = 0.0
        for k in range(len(text) - 2):
            w = text[k : k + 3]
            c = self.by_window.get(w)
            if c is None:
                if len(self.by_window) >= CACHE_UNITS:
                    self.by_window.clear()
                c = self.by_window[w] = 0.0 if w.isascii() else float(self.table[window(w)])
            total += c
            if total > limit:
                return np.inf
        return total

    def reachable(self, text: str, cost: Callable[[str, float], float], slack: float = 0.0) -> dict[str, tuple[float, int]]:
        """All texts that operations lead to, with their cost, or infinity if that is more than ``slack`` above another's, and their least number of steps.

        cost: of a text, up to a limit.
        """
        least = cost(text, np.inf)
        seen = {text: False}
        found = {text: (least, 0)}
        heap = [(least, 0, 0, text, False)]
        number = 0
        while heap:
            _, steps, _, old, swapped = heappop(heap)
            if swapped and not seen[old]:
                continue
            for op, swaps in OPERATIONS:
                if swaps and swapped:
                    continue
                new, now = op(old), swapped or swaps
                if new not in seen:
                    found[new] = (cost(new, least + slack), steps + 1)
                    least = min(least, found[new][0])
                elif not seen[new] or now:
                    if found[new][1] > steps + 1:
                        found[new] = (found[new][0], steps + 1)
                    continue
                seen[new] = now
                number += 1
                heappush(heap, (found[new][0], steps + 1, number, new, now))
        return found

    def inner(self, run: str, ends: bool) -> list[tuple[str, str, str, float]]:
        """Of a run between inert characters, each text reachable that can win with its two first and two last characters and the cost of
        the windows within it, those of fewer steps first. A run that doesn't end its unit is searched with a character after it."""
        key = (run, ends)
        if key not in self.runs:
            if self.n_runs >= CACHE_UNITS:
                self.runs.clear()
                self.n_runs = 0
            cut = None if ends else -1
            found = self.reachable(run if ends else run + "x", lambda t, limit: self.sum(t[:cut], limit), self.around)
            least = min(c for c, _ in found.values())
            texts = sorted((steps, number, t[:cut], c) for number, (t, (c, steps)) in enumerate(found.items()) if c <= least + self.around or number == 0)
            self.runs[key] = [(t, t[:2], t[-2:], c) for _, _, t, c in texts]
            self.n_runs += len(texts)
        return self.runs[key]

    def search(self, before: str, run: str, after: str) -> tuple[str, float]:
        """The cheapest text of the run and what it saves; of equal ones the one of fewest steps."""
        around = before + run + after
        best = run
        if INERT.match(before + after) and "&" not in around and "\\" not in around:
            left, right = f" {before}"[-2:], f"{after} "[:2]
            heads: dict[str, float] = {}
            tails: dict[str, float] = {}
            start = least = None
            for text, head, tail, within in self.inner(run, not after):
                if len(text) < 2:
                    total = self.sum(left + text + right)
                else:
                    if head not in heads:
                        heads[head] = self.sum(left + head)
                    if tail not in tails:
                        tails[tail] = self.sum(tail + right)
                    total = heads[head] + within + tails[tail]
                if start is None:  # the run itself has no steps
                    start = least = total
                elif total + STEP < least - 1e-9:
                    best, least = text, total + STEP
        else:
            start = least = self.cost(around)
            for text, (cost, steps) in sorted(self.reachable(around, lambda t, _: self.cost(t)).items(), key=lambda x: x[1][1]):
                total = cost + STEP * (steps > 0)
                if total < least - 1e-9:
                    best, least = text[len(before) : len(text) - len(after)], total
        return best, start - least

    def unit(self, before: str, run: str, after: str) -> str | None:
        """The run repaired, or None if it isn't garbled."""
        key = f"{before}\0{run}\0{after}"
        if key not in self.known:
            if len(self.known) >= CACHE_UNITS:
                self.known.clear()
            best, gain = self.search(before, run, after)
            self.known[key] = best if gain >= MIN_GAIN else run if LOST in run else None
        return self.known[key]

    def text(self, text: str, hard: int | None = None) -> tuple[str, bool, str | None]:
        """The repaired text, whether any unit of it is garbled, and None; or, with ``hard``, the text as it is, False and its first run of so many characters if it has one."""
        if text.isascii() and "&" not in text and "\\" not in text:
            return text, False, None
        out: list[str] = []
        done = 0
        for m in (RUN_ESCAPED if "&" in text or "\\" in text else RUN).finditer(text):
            a, b = m.span()
            if hard and b - a >= hard:
                return text, False, m[0]
            before, after = BEFORE.search(text[max(0, a - 2) : a])[0], AFTER.match(text, b)[0]
            new = self.unit(before, m[0], after)
            if new is not None:
                out += text[done:a], new
                done = b
        return ("".join(out) + text[done:], True, None) if out else (text, False, None)


def _readings() -> tuple[list[Misread], re.Pattern, re.Pattern]:
    ops = [op for op, _ in OPERATIONS if isinstance(op, Misread)]
    of = lambda a, b: "[" + "".join(sorted({re.escape(c) for op in ops for c, byte in op.byte.items() if a <= byte <= b})) + "]"
    return ops, re.compile(of(0xC2, 0xF4) + of(0x80, 0xBF)), re.compile("(?:" + "|".join(dict.fromkeys(op.sequence.pattern for op in ops)) + ")")


#: The readings of UTF-8, two characters that begin a misread sequence in some code page, and a whole one in any; texts without are left as they are.
READINGS, PAIR, SUSPECT = _readings()


def readable(text: str) -> str:
    """The text with misread UTF-8 decoded as far as it gets shorter, so that its words and stops can be seen; no search and no counts are needed."""
    for _ in range(3):
        if text.isascii() or not PAIR.search(text) or not SUSPECT.search(text):
            return text
        best = min((op(text) for op in READINGS if op.sequence.search(text)), key=len, default=text)
        if len(best) >= len(text):
            return text
        text = best
    return text


_last: Repairer | None = None


def repairer(cost: np.ndarray) -> Repairer:
    """The worker's repairer for a broadcast table, whose results its later tasks use again."""
    global _last
    if _last is None or _last.table is not cost:
        _last = Repairer(cost)
    return _last


def window_counts(*columns: DataFrame) -> DataFrame:
    """(bin, n): how often the windows of each bin stand in all texts of one-column tables of arrays of strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for b in batches:
            flat = pc.drop_null(pc.list_flatten(b.column(0)))
            flat = flat.filter(pc.invert(pc.string_is_ascii(flat)))
            tokens = pc.value_counts(pc.list_flatten(pc.split_pattern_regex(flat.cast(pa.large_string()), r"[ \t\r\n]+")))
            if not len(tokens):
                continue
            values, counts = tokens.field("values"), tokens.field("counts")
            keep = pc.invert(pc.string_is_ascii(values.cast(pa.string())))
            for token, n in zip(values.filter(keep).to_pylist(), counts.filter(keep).to_pylist()):
                np.add.at(total, windows(token), n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bin", "n"])

    parts = [c.toDF("texts").mapInArrow(run, "bin int, n long") for c in columns]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    return union.groupBy("bin").agg(F.sum("n").alias("n"))


def costs(n: np.ndarray) -> np.ndarray:
    return ((np.log(n.sum() + BINS) - np.log(n + 0.5)) * np.where(n > 0, 1, 2)).astype(np.float32)


def window_costs(spark: SparkSession, *columns: DataFrame) -> np.ndarray:
    """Cost of each bin. At most BINS counts come to the driver, whatever the size of the corpus."""
    got = window_counts(*columns).toArrow()
    n = np.zeros(BINS)
    n[got["bin"].to_numpy()] = got["n"].to_numpy()
    return costs(n)


#: Length of a run from which its search takes long, so that equal ones are brought together, and how many of one task stay together.
HARD, TOGETHER = 24, 1000
FOUND = "tab string, doc_id string, para_idx int, text string, repaired string, hard string, salt int"


def garbled_paragraphs(docs: DataFrame, tab: str, cost) -> DataFrame:
    """The garbled paragraphs of (doc_id, paragraphs) with their repaired text, and those with a long run unrepaired with that run in ``hard``; cost: a broadcast table.

    Null paragraphs and lists give no row. ``salt`` spreads the rows: by their key, and the many of one long run in groups of TOGETHER of each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = repairer(cost.value)
        met: Counter[str] = Counter()
        for b in batches:
            out: list[tuple] = []
            for doc, texts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, text in enumerate(texts or ()):
                    if text:
                        new, bad, hard = r.text(text, HARD)
                        if hard is not None:
                            out.append((tab, doc, k, text, None, hard, met[hard] // TOGETHER))
                            met[hard] += 1
                        elif bad:
                            out.append((tab, doc, k, text, new, None, zlib.crc32(f"{doc} {k}".encode("utf-8", "surrogatepass")) >> 4))
            if len(met) > CACHE_UNITS:
                met.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [()] * 7, FOUND_TYPES)], names=FOUND_NAMES)

    return docs.select("doc_id", "paragraphs").mapInArrow(run, FOUND)


FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]
FOUND_TYPES = [pa.int32() if x.endswith("int") else pa.string() for x in FOUND.split(", ")]


def find_garbled(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The garbled paragraphs of several tables (doc_id, paragraphs), each once: tab, doc_id, para_idx, text, repaired.

    ``repaired`` is the cheapest text; characters that were lost stay U+FFFD. Of repeated deliveries one counts.
    """
    cost = spark.sparkContext.broadcast(window_costs(spark, *(t.select("paragraphs") for t in tables.values())))
    out = None
    for name, table in tables.items():
        part = garbled_paragraphs(table, name, cost)
        out = part if out is None else out.unionByName(part)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = repairer(cost.value)
        for b in batches:
            repaired, keep = [], []
            for text, new, hard in zip(*(b.column(k).to_pylist() for k in (3, 4, 5))):
                bad = True
                if hard is not None:
                    new, bad, _ = r.text(text)
                repaired.append(new)
                keep.append(bad)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(repaired, pa.string())], names=FOUND_NAMES[:5]).filter(pa.array(keep, pa.bool_()))

    together = out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "hard", "salt")
    return together.mapInArrow(finish, ", ".join(FOUND.split(", ")[:5])).dropDuplicates(["tab", "doc_id", "para_idx"])
