"""Problem 6: token ids of a whole corpus by a public byte-level BPE vocabulary, by prefix dynamic programming.

A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours are the encoding of
their own bytes. So every prefix of a piece has one last token that can follow the last token of what
precedes it. That token is stored for each prefix: the ids are read off backwards, an append goes on where
the table ends, and an edit needs the table only from the edited byte to where it agrees with the former one again.
Of a text with known ids only the pieces round an edit are encoded again.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.sources import spread

#: Where the vocabulary files lie on the driver's machine; a parameter everywhere. Executors that lack them are sent them.
FOLDER = "/opt/tokenizers"
#: Fixed value: the published pattern that splits a text into pieces before byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers, and the bytes up to which a piece is worth it.
REMEMBERED, SHORT = 200_000, 64


class Vocabulary:
    """Ranks of a .tiktoken file; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the neighbours of least rank until none can be merged."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether b can stand after a."""
        ok = self._pairs.get((a, b))
        if ok is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            ok = self._pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def piece(self, text: str) -> list[int]:
        """Ids of a piece of the split text."""
        ids = self._pieces.get(text)
        if ids is None:
            data = text.encode("utf-8", "replace")
            whole = self.ranks.get(data)
            # A token's own bytes encode to it; anything else goes through the table of its prefixes.
            ids = [whole] if whole is not None else PrefixTable(self).append(data).ids()
            if len(data) <= SHORT:
                if len(self._pieces) >= REMEMBERED:
                    self._pieces.clear()
                self._pieces[text] = ids
        return ids


class PrefixTable:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.data, self.last = vocabulary, bytearray(), []

    def append(self, more: bytes) -> PrefixTable:
        begin = len(self.data)
        self.data += more
        low = max(0, begin - self.v.longest)
        window = bytes(self.data[low:])
        for end in range(begin + 1, len(self.data) + 1):
            self.last.append(self._token(window, low, end))
        return self

    def _token(self, window: bytes, low: int, end: int) -> int:
        """The last token of the prefix of length end; window are the bytes from low on."""
        v, ranks, last = self.v, self.v.ranks, self.last
        for start in range(max(0, end - v.longest), end):
            token = ranks.get(window[start - low : end - low])
            if token is not None and (start == 0 or v.follows(last[start - 1], token)):
                return token
        raise ValueError("a byte is missing in the vocabulary")

    def replace(self, at: int, until: int, by: bytes) -> PrefixTable:
        """Replace data[at:until]. What precedes it stays as it is; what follows is encoded until it agrees again.

        A last token depends on those of the prefixes that are shorter by at most the longest token. So if as many
        in a row, all behind the edit, are what they were, so are all that follow.
        """
        former, rest = self.last[until:], bytes(self.data[until:])
        del self.data[at:], self.last[at:]
        self.append(by)
        begin, agree = len(self.data), 0
        low = max(0, begin - self.v.longest)
        self.data += rest
        window = bytes(self.data[low:])
        for i in range(len(rest)):
            token = self._token(window, low, begin + i + 1)
            self.last.append(token)
            agree = agree + 1 if token == former[i] else 0
            if agree >= self.v.longest:
                self.last += former[i + 1 :]
                break
        self.encoded = len(by) + (i + 1 if rest else 0)  # bytes whose last token was looked for
        return self

    def ids(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.v.bytes_of[out[-1]])
        return out[::-1]


def _send(spark: SparkSession, path: str) -> None:
    """Send a vocabulary file to the executors, once per application; executors that start later get it too."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_vecloom_vocabularies", {})
    if sent.setdefault(os.path.basename(path), path) != path:
        return  # another file of that name was sent before: this one is read at its path
    if os.path.exists(path) and path not in sent.setdefault("", set()):
        sc.addFile(path)
        sent[""].add(path)


def _here(path: str) -> str:
    """The file on this machine: at its path, or as it was sent."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@functools.lru_cache(2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(_here(path))


@functools.lru_cache(2)
def _split(pattern: str):
    return regex.compile(pattern).findall


@functools.lru_cache(2)
def _matches(pattern: str):
    return regex.compile(pattern).finditer


def encode_texts(texts: list[str | None], path: str, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of texts."""
    piece, split = _vocabulary(path).piece, _split(pattern)
    remembered = _vocabulary(path)._pieces
    flat: list[int] = []
    ends = [0]
    for text in texts:
        if text:
            for p in split(text):
                ids = remembered.get(p)
                flat += piece(p) if ids is None else ids
        ends.append(len(flat))
    return np.array(ends, np.int32), np.array(flat, np.int32)


def reencode(old: str, ids: list[int], new: str, path: str, pattern: str = PATTERN) -> tuple[list[int], int]:
    """The ids of new, of which old with its ids is a former state, and how many of its pieces were encoded.

    The ids of the pieces before and behind the edited span are taken over. How a text is split from a boundary on
    depends on what follows only, so it is split again from a little before the edit until a boundary behind it meets
    one of the former text.
    """
    v, split = _vocabulary(path), _split(pattern)
    most = min(len(old), len(new))
    a = next((k for k in range(0, most, 4096) if old[k : k + 4096] != new[k : k + 4096]), most)
    a = min(a, most)
    while a < most and old[a] == new[a]:
        a += 1
    z = 0
    while z < most - a and old[len(old) - 1 - z] == new[len(new) - 1 - z]:
        z += 1
    if a == len(old) == len(new):
        return list(ids), 0
    # Boundaries of the former pieces, in characters and in tokens.
    ends, at_token = [0], [0]
    done, n, token = 0, 0, 0
    for p in split(old):
        n += len(p.encode("utf-8", "replace"))
        while done < n:
            done += len(v.bytes_of[ids[token]])
            token += 1
        ends.append(ends[-1] + len(p))
        at_token.append(token)
    # Three pieces before the edit: where one ends may depend on a few characters behind it.
    k = max(0, int(np.searchsorted(ends, a)) - 3)
    out = list(ids[: at_token[k]])
    former = {e + len(new) - len(old): t for e, t in zip(ends, at_token)}
    at, count = ends[k], 0
    for m in _matches(pattern)(new, at):
        if at >= len(new) - z and at in former:
            break
        out += v.piece(m[0])
        count += 1
        at = m.end()
    return out + list(ids[former[at] :]) if at < len(new) else out, count


def edited_ids(df: DataFrame, ident: str, old: str, ids: str, new: str, folder: str = FOLDER, name: str = "byte_bpe_50k", pattern: str = PATTERN) -> DataFrame:
    """ident and ids: the ids of the text new of each row, of which old has the given ids; only near edits is it encoded.

    A null new text has the empty list, as in token_ids; where old or ids is null new is encoded whole. Repeated rows
    come out as often as they come in; other columns are dropped.
    """
    path = f"{folder}/{name}.tiktoken"
    _send(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for o, i, n in zip(*(b.column(c).to_pylist() for c in (1, 2, 3))):
                made.append(reencode(o, i, n, path, pattern)[0] if n and o and i else encode_texts([n], path, pattern)[1].tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.int32()))], ["k", "ids"])

    rows = df.select(F.col(ident).alias("k"), F.col(old).cast("string").alias("o"), F.col(ids).cast("array<int>").alias("i"), F.col(new).cast("string").alias("n"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, ids array<int>").withColumnRenamed("k", ident)


def token_ids(df: DataFrame, ident: str, text: str, folder: str = FOLDER, name: str = "byte_bpe_50k", pattern: str = PATTERN) -> DataFrame:
    """ident and ids (array<int>): every row of df with the ids of its text, without special tokens.

    A null or empty text has the empty list. Blanks have ids like any text. Strings of special tokens in a
    text are ordinary text. Repeated rows come out as often as they come in; other columns are dropped.
    """
    return _encoded(df, ident, text, f"{folder}/{name}.tiktoken", pattern, False)


def token_sizes(df: DataFrame, ident: str, text: str, folder: str = FOLDER, name: str = "byte_bpe_50k", pattern: str = PATTERN) -> DataFrame:
    """ident and size (int): the number of ids that token_ids gives; 0 for null and empty texts."""
    return _encoded(df, ident, text, f"{folder}/{name}.tiktoken", pattern, True)


def _encoded(df: DataFrame, ident: str, text: str, path: str, pattern: str, sizes: bool) -> DataFrame:
    _send(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, flat = encode_texts(b.column(1).to_pylist(), path, pattern)
            made = pa.array(np.diff(ends)) if sizes else pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), made], ["k", "size" if sizes else "ids"])

    rows = spread(df.select(F.col(ident).alias("k"), F.col(text).cast("string").alias("t")))
    made = "size int" if sizes else "ids array<int>"
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, {made}").withColumnRenamed("k", ident)
