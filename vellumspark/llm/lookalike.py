"""One consistent form of texts that look the same.

For each token the script sets of its letters (Unicode script extensions) are intersected. A token whose letters have no common script is mixed; it is spelt
in the one script in which every letter of it is written or has a look-alike, Latin before the others, which keep a word with a letter that Latin has no look-alike of.
A token wholly in one script is left alone even if all its letters have look-alikes in another, since words of another script are meant;
``whole_script_words`` reports those. Letters of phonetic writing among plain ones, and a digit that stands for a letter inside a word, are put right the same way. What
remains is normalised: other widths and joined forms, accents apart from their letters, invisible characters, other
spaces and other hyphens. Texts of inert characters alone are left as they are at once; a character is inert if no rule here changes it, alone or beside others.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import repairer, window_costs

# Letters that look like a Latin letter, by script, and phonetic letters that do, from the public table of confusable characters.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝӏкАВСЕНІЈКМОРЅТХУԚԜ", "aeopcyxijshdqwlkABCEHIJKMOPSTXYQW"))
GREEK = dict(zip("οανρικυϲϳχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavpikucjxyABEZHIKMNOPTYX"))
ARMENIAN = dict(zip("օոսհցզյՍՏՕ", "onuhgqjUSO"))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏒᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZ4RWVSLCPKB"))
COPTIC = dict(zip("ⲟⲣⲥⲭⲞⲢⲤⲬⲘⲚⲒⲎ", "opcxOPCXMNIH"))
PHONETIC = dict(zip("ɑɡᴄᴏᴠᴡᴢꜱ", "agcovwzs"))
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Myanmar", "Hebrew", "Arabic", "Devanagari", "Thai", "Georgian", "Han", "Hiragana", "Katakana", "Hangul")
DIGITS = {"0": "o", "1": "l"}
OTHERS = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN, "Cherokee": {k: v for k, v in CHEROKEE.items() if v.isalpha()}, "Coptic": COPTIC}
LATIN_OF = {k: v for table in OTHERS.values() for k, v in table.items()}
BACK = {name: {v: k for k, v in table.items()} for name, table in OTHERS.items()}
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
SPACES = "               　"
HYPHENS = "‐‑﹣－"
#: Blocks of other widths and joined forms, and of letters in a mathematical style.
FORMS = "ﬀ-ﬆ！-，．-￯\U0001d400-\U0001d7ffĲĳǄ-ǌǱ-ǳ"

TABLE = {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in SPACES} | {ord(c): "-" for c in HYPHENS}
FORM = re.compile(f"[{FORMS}]")
SPECIAL = re.compile(f"[{INVISIBLE}{SPACES}{HYPHENS}{FORMS}]")
#: Letters of the scripts that have look-alikes in Latin, and phonetic ones.
OTHER_SCRIPT = re.compile("[Ͱ-ԯ԰-֏Ꭰ-Ᏽ\u2c80-\u2cff" + "".join(PHONETIC) + "]")
PHONETIC_TABLE = str.maketrans(PHONETIC)
WORD = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")
HEX = re.compile(r"[0-9a-fA-F]+\Z")
DIGIT_IN_WORD = re.compile(r"(?<=[A-Za-z])[01](?=[a-z])")
ZERO_IN_WORD = re.compile("(?<![၀-၉])၀(?![၀-၉])")
WA_IN_NUMBER = re.compile("(?<=[၀-၉])ဝ(?=[၀-၉]|(?![က-ဿ]))")
BURMESE = re.compile("[က-ဿ၌-႟]")


@lru_cache(maxsize=100_000)
def scripts(c: str) -> frozenset[str] | None:
    """The scripts that a letter is used in; None for characters of all scripts, a name of its own for scripts not listed."""
    if not c.isalpha() or regex.match(r"\p{scx=Common}|\p{scx=Inherited}|[ªºµ]", c):
        return None
    found = frozenset(s for s in SCRIPTS if regex.match(rf"\p{{scx={s}}}", c))
    return found or frozenset([unicodedata.name(c, "UNKNOWN").split()[0].title()])


def spell(word: str) -> tuple[str, str | None]:
    """The word in one script, and ``mixed`` or ``whole_script`` if its letters say so."""
    own = [(c, s) for c in word if (s := scripts(c)) is not None]
    if not own:
        return word, None
    resolved = frozenset.intersection(*(s for _, s in own))
    if resolved:
        if "Latin" in resolved:
            plain = word.translate(PHONETIC_TABLE)
            return (plain, "mixed") if plain != word and plain.isascii() and any(c.isascii() for c, _ in own) else (word, None)
        return word, "whole_script" if all(c in LATIN_OF for c, _ in own) else None
    if all("Latin" in s or c in LATIN_OF for c, s in own):
        return "".join(LATIN_OF.get(c, c) for c in word), "mixed"
    for name, back in BACK.items():
        if all(name in s or c in back for c, s in own) and any(name in s for _, s in own):
            return "".join(c if (s := scripts(c)) is None or name in s else back[c] for c in word), "mixed"
    return word, None


def _digits(m: re.Match) -> str:
    word = m[0]
    if HEX.match(word) or sum(c.isalpha() for c in word) < 3 or any(c in "23456789" for c in word):
        return word
    return DIGIT_IN_WORD.sub(lambda d: DIGITS[d[0]], word)


def _zero(text: str) -> str:
    def put(m: re.Match) -> str:
        a, b = m.span()
        return "ဝ" if (a and BURMESE.match(text[a - 1])) or (b < len(text) and BURMESE.match(text[b])) else m[0]

    return ZERO_IN_WORD.sub(put, text)


def form(text: str) -> str:
    """The consistent form of a text. Curly quotes, dashes, superscripts, fractions, ordinals and signs stay."""
    if text.isascii() and not DIGIT_IN_WORD.search(text):
        return text
    new = text
    if SPECIAL.search(new):
        new = FORM.sub(lambda m: unicodedata.normalize("NFKC", m[0]), new.translate(TABLE))
    if not unicodedata.is_normalized("NFC", new):
        new = unicodedata.normalize("NFC", new)
    if OTHER_SCRIPT.search(new):
        new = unicodedata.normalize("NFC", WORD.sub(lambda m: spell(m[0])[0] if not m[0].isascii() else m[0], new))
    if DIGIT_IN_WORD.search(new):
        new = WORD.sub(_digits, new)
    if "၀" in new or "ဝ" in new:
        new = WA_IN_NUMBER.sub("၀", _zero(new))
    return new


@lru_cache(maxsize=1)
def candidate() -> str:
    """A pattern of any character that isn't inert, and of digits inside words: of all texts that differ from their form.

    Inert is a character that is its own form, isn't the second of a canonical composition or moved by normalisation, and has no look-alike.
    Characters beyond the first plane aren't.
    """
    second = {int(d[1], 16) for c in range(0x110000) if (d := unicodedata.decomposition(chr(c)).split()) and d[0][0] != "<" and len(d) == 2}
    jamo = range(0x1100, 0x1200)
    calm = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and c not in second and c not in jamo and not unicodedata.combining(chr(c)) and chr(c) not in "၀ဝ" and not OTHER_SCRIPT.match(chr(c)) and form(chr(c)) == chr(c)]
    ranges: list[list[int]] = []
    for c in calm:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]|[A-Za-z][01][a-z]"


def looks_alike(text: str, plain: str) -> bool:
    """Whether the text is made of other characters than its form; another order of the same characters is no case."""
    return text != plain and (len(text) != len(plain) or sorted(text) != sorted(plain))


ROWS = "row_key string, para_idx int, text string, form string"


def forms(df: DataFrame, key: str, text: str, cost=None, changed_only: bool = False) -> DataFrame:
    """(row_key, para_idx, text, form) of a column of texts (para_idx 0) or of arrays of texts.

    cost: a broadcast table of window costs; with it, texts garbled by a wrong encoding come out unchanged.
    changed_only: only the texts that aren't in their form; another order of the same characters doesn't count. Null texts and lists give no row.
    """
    pattern = candidate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = repairer(cost.value) if cost is not None else None
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            if pa.types.is_list(texts.type):
                parent = pc.list_parent_indices(texts).to_numpy()
                flat = pc.list_flatten(texts)
                first = np.r_[True, parent[1:] != parent[:-1]] if len(parent) else np.empty(0, bool)
                at = np.arange(len(parent))
                place = at - np.maximum.accumulate(np.where(first, at, 0)) if len(parent) else at
                keys, texts = keys.take(pa.array(parent)), flat
            else:
                place = np.zeros(len(texts), np.int64)
            maybe = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
            if changed_only:
                keys, texts, place = keys.filter(maybe), texts.filter(maybe), place[maybe.to_numpy(zero_copy_only=False)]
                maybe = pa.array(np.ones(len(texts), bool))
            elif texts.null_count:
                there = texts.is_valid()
                keys, texts, maybe, place = keys.filter(there), texts.filter(there), maybe.filter(there), place[there.to_numpy(zero_copy_only=False)]
            plain, keep = [], []
            for t, m in zip(texts.to_pylist(), maybe.to_pylist()):
                new = form(t) if m else t
                if new != t and (changed_only and not looks_alike(t, new) or (repair is not None and repair.text(t)[1])):
                    new = t
                plain.append(new)
                keep.append(not changed_only or new != t)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([keys.cast(pa.string()).filter(mask), pa.array(place.astype(np.int32)).filter(mask), texts.cast(pa.string()).filter(mask), pa.array(plain, pa.string()).filter(mask)], names=["row_key", "para_idx", "text", "form"])

    return df.select(F.col(key).cast("string").alias("row_key"), F.col(text).alias("text")).mapInArrow(run, ROWS)


def all_forms(spark: SparkSession, rich: DataFrame, extracted: DataFrame, cleaned: DataFrame, changed_only: bool = False) -> DataFrame:
    """(tab, row_key, para_idx, text, form) of the texts of rich_paragraphs and extracted_documents, each once; garbled ones are unchanged."""
    cost = spark.sparkContext.broadcast(window_costs(spark, extracted.select("paragraphs"), cleaned.select("paragraphs")))
    parts = (forms(rich, "line_id", "text", cost, changed_only).withColumn("tab", F.lit("rich_paragraphs"))).unionByName(forms(extracted, "doc_id", "paragraphs", cost, changed_only).withColumn("tab", F.lit("extracted_documents")))
    return parts.select("tab", "row_key", "para_idx", "text", "form").dropDuplicates(["tab", "row_key", "para_idx"])


def find_lookalikes(spark: SparkSession, rich: DataFrame, extracted: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The texts of rich_paragraphs and extracted_documents that aren't in their form, each once."""
    return all_forms(spark, rich, extracted, cleaned, True)


def whole_script_words(rich: DataFrame, extracted: DataFrame) -> DataFrame:
    """(word, looks_like, n): words wholly in another script all of whose letters have Latin look-alikes, over all texts of both tables; they are left as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter[str] = Counter()
            texts = b.column(0).filter(pc.fill_null(pc.match_substring_regex(b.column(0), "[\\x{370}-\\x{58f}\\x{13a0}-\\x{13f5}\\x{2c80}-\\x{2cff}]"), False))
            for t in texts.to_pylist():
                found.update(m[0] for m in WORD.finditer(t) if not m[0].isascii() and spell(m[0])[1] == "whole_script")
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(("".join(LATIN_OF.get(c, c) for c in w) for w in found), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "looks_like", "n"])

    texts = rich.select("text").unionByName(extracted.select(F.explode("paragraphs").alias("text")))
    return texts.mapInArrow(run, "word string, looks_like string, n long").groupBy("word", "looks_like").agg(F.sum("n").alias("n"))
