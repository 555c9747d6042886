"""Corpus encoding with a public byte-level BPE vocabulary by merge replay.

A block of documents (one Arrow batch) is cut into segments at single spaces, which byte-level patterns
never join to the text before them, and the segments are dictionary-encoded, so that each different
segment of a block is looked at once. Different words that the worker hasn't met yet are merged together:
an inverted index holds, for each pair of adjacent tokens, the places in all those words where it stands, and the merges
are applied to all of them in rank order; a merge touches only the two neighbours of each place.
No shuffle, and no state beyond a bounded cache of words in each Python worker.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Pre-tokenisation of the byte-level vocabularies (fixed value, part of the public format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"
CACHE_WORDS = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a rank file of lines ``base64 id``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes words with the ranks; ``encode_words`` replays the merges over all given words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {i: b for b, i in ranks.items()}
        self.byte_id = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(self.byte_id) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        self.merged: dict[tuple[int, int], int] = {}

    def _pair(self, a: int, b: int) -> int:
        """The id of the merge of two tokens, -1 when there is none."""
        found = self.merged.get((a, b))
        if found is None:
            found = self.merged[(a, b)] = self.ranks.get(self.text[a] + self.text[b], -1)
        return found

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[list[int] | None] = [None] * len(raw)
        token: list[int] = []
        word_of: list[tuple[int, int, int]] = []
        for k, b in enumerate(raw):
            whole = self.ranks.get(b)
            if whole is not None:
                out[k] = [whole]
                continue
            start = len(token)
            token.extend(self.byte_id[x] for x in b)
            token.append(-1)  # ends a word; no pair reaches over it
            word_of.append((k, start, len(token) - 1))
        n = len(token)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        places: dict[tuple[int, int], list[int]] = {}
        queue: list[tuple[int, int, int]] = []

        def note(i: int, a: int, b: int) -> None:
            if (at := places.get((a, b))) is None:
                rank = self._pair(a, b)
                if rank < 0:
                    return
                places[(a, b)] = [i]
                heapq.heappush(queue, (rank, a, b))
            else:
                at.append(i)

        for i in range(n - 1):
            if token[i] >= 0 and token[i + 1] >= 0:
                note(i, token[i], token[i + 1])
        while queue:
            rank, a, b = heapq.heappop(queue)
            at = places.pop((a, b))
            at.sort()  # of overlapping places of a pair the leftmost one counts
            for i in at:
                j = right[i]
                if token[i] != a or j >= n or token[j] != b:
                    continue
                token[i], token[j] = rank, -2
                k = right[j]
                right[i] = k
                if k < n:
                    left[k] = i
                    if token[k] >= 0:
                        note(i, rank, token[k])
                if (h := left[i]) >= 0 and token[h] >= 0:
                    note(h, token[h], rank)
        for k, start, end in word_of:
            out[k] = [t for t in token[start:end] if t >= 0]
        return out  # type: ignore[return-value]


class BlockEncoder:
    """Encodes columns of texts; keeps the ids of up to ``CACHE_WORDS`` different words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.replay = MergeReplay(ranks)
        self.words = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def segments(self, parts: Iterable[str]) -> list[np.ndarray]:
        cut = [self.words.findall(p) for p in parts]
        fresh = sorted({w for ws in cut for w in ws if w not in self.known})
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known.clear()
            fresh = sorted({w for ws in cut for w in ws})
        self.known.update(zip(fresh, self.replay.encode_words(fresh)))
        known = self.known
        return [np.fromiter((i for w in ws for i in known[w]), np.int32) for ws in cut]

    def encode(self, texts: pa.Array) -> pa.Array:
        """A list of ids for each text; null and empty texts give an empty list."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # A space between two characters that aren't white space starts a token, so the text may be cut there.
        lists = pc.split_pattern(texts, " ")
        flat = pc.list_flatten(lists)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        coded = flat.dictionary_encode()
        vocabulary, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # A segment is safe when it and the one before it are not empty and meet the space with a non-space character.
        head = np.array([bool(v) and not v[0].isspace() and v[0] not in _ODD for v in vocabulary], bool)
        tail = np.array([bool(v) and not v[-1].isspace() and v[-1] not in _ODD for v in vocabulary], bool)
        first = np.zeros(len(index), bool)
        first[starts[:-1][sizes > 0]] = True
        safe = first.copy()
        if len(index) > 1:
            safe[1:] |= head[index[1:]] & tail[index[:-1]]
        # Runs of unsafe segments are joined to the segment before them.
        unit_start = np.flatnonzero(safe)
        unit_len = np.diff(np.append(unit_start, len(index)))
        key = index[unit_start] * 2 + (~first[unit_start])
        strings: list[str] = []
        place = np.empty(len(unit_start), np.int64)
        single = unit_len == 1
        values, inverse = np.unique(key[single], return_inverse=True)
        strings += [(" " if v & 1 else "") + vocabulary[v >> 1] for v in values.tolist()]
        place[single] = inverse
        seen: dict[str, int] = {}
        for u in np.flatnonzero(~single).tolist():
            s = unit_start[u]
            text = ("" if first[s] else " ") + " ".join(vocabulary[x] for x in index[s : s + unit_len[u]].tolist())
            place[u] = seen.setdefault(text, len(values) + len(seen))
        strings += list(seen)
        ids = self.segments(strings)
        lengths = np.fromiter((len(x) for x in ids), np.int64, len(ids))
        bank = np.concatenate(ids) if ids else np.empty(0, np.int32)
        bank_start = np.concatenate(([0], np.cumsum(lengths)))[:-1] if ids else np.empty(0, np.int64)
        take = lengths[place]
        ends = np.cumsum(take)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total, dtype=np.int64) + np.repeat(bank_start[place] - (ends - take), take)
        doc_of_unit = np.searchsorted(starts, unit_start, side="right") - 1
        per_doc = np.bincount(doc_of_unit, weights=take, minlength=len(sizes)).astype(np.int64) if len(take) else np.zeros(len(sizes), np.int64)
        offsets = np.concatenate(([0], np.cumsum(per_doc))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(bank[at]))


#: Characters that one of the two regex engines counts as white space and str.isspace may not (fixed values).
_ODD = frozenset("\x1c\x1d\x1e\x1f\x85\xa0")
_ENCODERS: dict[str, BlockEncoder] = {}


def encoder(name: str, tokenizers: str = TOKENIZERS) -> BlockEncoder:
    """The encoder of a rank file, made once in each worker."""
    path = os.path.join(tokenizers, f"{name}.tiktoken")
    if path not in _ENCODERS:
        _ENCODERS[path] = BlockEncoder(load_ranks(path))
    return _ENCODERS[path]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """One row ``(key, ids array<int>)`` for each row of ``df``.

    No special tokens are added and their spellings are ordinary text. Empty and null texts give an empty
    list, a null key is kept, repeated rows stay repeated, other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, tokenizers)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), enc.encode(b.column(1))], names=["key", "ids"])

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
