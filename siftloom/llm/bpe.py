"""BPE encoding and decoding with a pair occurrence index.

The file is a public tokenizer's JSON: normalisation (NFC, white space, lower case), a split into words,
the byte alphabet, merges ranked by their place in the list, and a mark at the end of each word. A batch's distinct new
words lie in one symbol sequence; an index maps each mergeable pair to all of its positions there. Ranks are
taken from a heap in ascending order; all positions of the rank's pair are merged and the lists of the pairs
beside them are updated. Words do not touch, so each word's merges come in the order a word-by-word encoder
takes them: if a merge makes a pair of lower rank, that rank goes first and the rest of the list waits.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Capitals, with their small letters, that the tokenizer's tables have and this Python's may not; the second line has pairs in two rows of so many letters.
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_CAPITAL_ROWS = ((0x10D50, 0x10D70, 22), (0x16EA0, 0x16EBB, 25))
# Letters and numbers of Unicode 16, the tokenizer's, that 15.1 lacks: first and last of each run.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# End of fixed values.
ADDED = {"L": {chr(c) for a, b in LETTERS_16 for c in range(a, b + 1)}, "N": {chr(c) for a, b in NUMBERS_16 for c in range(a, b + 1)}}
LOWER = NEW_CAPITALS | {a + i: b + i for a, b, n in NEW_CAPITAL_ROWS for i in range(n)}

#: Words kept with their ids by a worker; the table is emptied beyond that.
CACHE = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def newer_letters(pattern: str) -> tuple[frozenset[str], regex.Pattern[str]]:
    """Characters that only the pattern library's tables, newer than the tokenizer's, call letters or numbers, and those of LOWER; and the pattern without the former.

    The tokenizer's letters are those of Unicode 16; the tests hold every code point against it.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    newer: set[str] = set()
    for kind in "LN":
        more = [c for c in regex.findall(rf"\p{{{kind}}}", every) if unicodedata.category(c)[0] != kind and c not in ADDED[kind]]
        newer.update(more)
        if more:
            pattern = pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{''.join(map(regex.escape, more))}]]")
    return frozenset(newer | set(map(chr, LOWER))), regex.compile(f"(?V1){pattern}")


class Bpe:
    """A tokenizer of the given file, which must be of the kind named above."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"] or spec["decoder"]:
            raise ValueError(f"{path}: another kind of tokenizer")
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.newer, self.pinned = newer_letters(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.mark = next(iter(self.special))[:2]
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.end] for c in alphabet]
        #: pair of ids, as one number, to its rank; rank to the id made
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for i, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault(vocab[a] << 32 | vocab[b], i)
            self.made.append(vocab[a + b])
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word."""
        ids: list[int] = []
        starts = [0]
        for w in words:
            raw = w.encode()
            ids += [self.inner[b] for b in raw[:-1]]
            ids.append(self.last[raw[-1]])
            starts.append(len(ids))
        n, rank, made = len(ids), self.rank, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for s in starts:
            if s:
                after[s - 1] = -1
            if s < n:
                before[s] = -1
        index: dict[int, list[int]] = {}
        get = rank.get
        for i, j in enumerate(after):
            if j >= 0 and (r := get(ids[i] << 32 | ids[j])) is not None:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
        heap = list(index)
        heapq.heapify(heap)
        pair_of = dict.fromkeys(heap)

        def note(i: int, j: int) -> int:
            if (r := get(ids[i] << 32 | ids[j])) is None:
                return n_ranks
            if r in index:
                index[r].append(i)
            else:
                index[r] = [i]
                heapq.heappush(heap, r)
            return r

        n_ranks = len(made)
        pairs = self.pairs
        while heap:
            r = heapq.heappop(heap)
            where = index.pop(r)
            where.sort()
            left, right = pairs[r]
            new = made[r]
            for k, i in enumerate(where):
                j = after[i]
                if ids[i] != left or j < 0 or ids[j] != right:
                    continue  # an earlier merge took part of it
                ids[i], ids[j] = new, -1
                after[i] = f = after[j]
                low = n_ranks
                if f >= 0:
                    before[f] = i
                    low = note(i, f)
                if (p := before[i]) >= 0:
                    low = min(low, note(p, i))
                if low <= r and k + 1 < len(where):
                    if low == r:
                        index[r] += where[k + 1 :]
                    else:
                        index.setdefault(r, []).extend(where[k + 1 :])
                        heapq.heappush(heap, r)
                    break
        return [tuple([x for x in ids[a:b] if x >= 0]) for a, b in zip(starts, starts[1:])]

    @property
    def pairs(self) -> list[tuple[int, int]]:
        if not hasattr(self, "_pairs"):
            self._pairs = [(0, 0)] * len(self.made)
            for p, r in self.rank.items():
                self._pairs[r] = (p >> 32, p & 0xFFFFFFFF)
        return self._pairs

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not text.isascii():
            # Lower case is by character here: no final sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if max(text) >= "\u0500" and not self.newer.isdisjoint(text):
                return self.pinned.findall(text.translate(LOWER).lower())
        return self.words.findall(text.lower())

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; none: no ids."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
        parts: list[list[list[str] | int]] = []
        fresh: dict[str, None] = {}
        for text in texts:
            text = text or ""
            pieces = self.special_at.split(text) if self.mark in text else (text,)
            row: list[list[str] | int] = []
            for at, piece in enumerate(pieces):
                if at % 2:
                    row.append(self.special[piece])
                else:
                    words = self.split(piece)
                    fresh.update(dict.fromkeys([w for w in words if w not in known]))
                    row.append(words)
            parts.append(row)
        if fresh:
            known.update(zip(fresh, self.merge(list(fresh))))
        get = known.__getitem__
        return [list(chain.from_iterable((p,) if isinstance(p, int) else chain.from_iterable(map(get, p)) for p in row)) for row in parts]

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined by spaces: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(1)
def tokenizer(path: str) -> Bpe:
    return Bpe(path)


def slices(texts: list, chars: int = 4_000_000) -> Iterator[list]:
    """Runs of texts of about so many characters at most, or one longer text."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t or "") > chars:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t or "")
    if run:
        yield run


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Documents' columns with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` in place of the text.

    ``with_ids``: ``token_ids array<int>`` too. Null and empty texts, and texts of white space, have no ids; repeated rows
    are encoded each; columns of these names are replaced. Needs no shuffle.
    """
    path = path or default_path()
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"token_ids": "array<int>"} if with_ids else {})
    other = [c for c in docs.columns if c not in {*made, "text"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            at = 0
            for texts in slices(b.column(b.num_columns - 1).to_pylist()):
                n, sha, back, held = [], [], [], []
                for ids in bpe.encode_batch(texts):
                    raw = np.array(ids, "<u4")
                    n.append(len(ids))
                    sha.append(hashlib.sha256(raw.tobytes()).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                    held.append(raw)
                cols = [c.slice(at, len(texts)) for c in b.columns[:-1]]
                cols += [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                if with_ids:
                    ends = np.r_[0, np.cumsum(n)].astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).view(np.int32))))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(cols, [*other, *made])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in other] + [f"{k} {v}" for k, v in made.items()])
    return docs.select(*[F.col(f"`{c}`") for c in other], F.col("text").cast("string")).mapInArrow(run, schema)


def decode_ids(df: DataFrame, column: str = "token_ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded string``, the text of the ids; null ids give null."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text(ids):  # noqa: ANN001, ANN202
        bpe = tokenizer(path)
        return ids.map(lambda x: None if x is None else bpe.decode(list(x)))

    return df.withColumn("decoded", text(column))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
