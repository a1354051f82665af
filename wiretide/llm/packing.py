"""Packing documents into training windows by sum-of-squares online packing.

A document's full windows are cut off first. The rest goes whole into one open window: of all fill levels that have
room, the one after which the sum over levels of (number of windows at the level)^2 is smallest. Each task packs the
rows it reads, in their order, and holds one level array, so nothing is shuffled. What is still open at the end of a
task is cut freely: windows of a power-of-two length stay (they need no padding), the others are laid end to end and cut into
full windows, and the last rest is cut into powers of two. So there is no padding at all.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

MODEL = "word_bpe_49k.json"
WINDOW = 2048
END_ID = 1
#: Open windows of one task (8 KB each at most); with more, the fuller half is cut as all are at the end of the task.
MAX_OPEN = 8192
# The rules of the tokenizer under which chunks between white space can be encoded by themselves.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Chunks whose ids one task keeps, and as many older ones; results don't depend on it.
CACHED_CHUNKS = 400_000
LONGEST_CACHED = 64
TOKEN_ID = attrgetter("id")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Chunks(dict):
    """Ids, as bytes, of white-space chunks: those met lately, and by ``encode`` all others."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self.encode(chunk)
        if len(chunk) <= LONGEST_CACHED and len(self) < CACHED_CHUNKS:
            self[chunk] = found
        return found

    def age(self) -> None:
        """Makes room when full: of the chunks kept, those that come again stay."""
        if len(self) >= CACHED_CHUNKS:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        """Drops all chunks: a worker outlives its task, and other stages need its memory."""
        self.clear()
        self.old = {}


class Encoder:
    """Ids of whole texts, by white-space chunk; the same as the library's on the whole text.

    Pre-tokens never hold white space, so a text's ids are its chunks' ids. A chunk of letters up to U+00FF and closing ASCII
    punctuation is two pre-tokens, which go straight to the merges; any other chunk goes through the library whole. ``proved`` reads from the
    tokenizer's own file that its rules are those; without it every text goes through the library whole.
    """

    def __init__(self, path: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or public_tokenizers.path(MODEL))
        self.proven = self.proved(json.loads(self.library.to_str()))
        self.merge = self.library.model.tokenize
        self.letters = byte_letters()
        self.chunks = Chunks(self.chunk)

    @staticmethod
    def proved(settings: dict) -> bool:
        normalizer, before, model = (settings.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
        split, to_bytes = (before.get("pretokenizers") or [{}, {}])[:2] if len(before.get("pretokenizers") or []) == 2 else ({}, {})
        by_split = split.get("pattern") == {"Regex": SPLIT} and split.get("behavior") == "Removed" and split.get("invert")
        by_bytes = to_bytes.get("type") == "ByteLevel" and not to_bytes.get("add_prefix_space") and not to_bytes.get("use_regex", True)
        plain = not settings.get("truncation") and not settings.get("padding") and not model.get("dropout")
        # No string of an added token reaches over white space.
        apart = not any(c.isspace() for t in settings.get("added_tokens") or [] for c in t["content"])
        return bool(normalizer.get("normalizers") == NORMALIZERS and by_split and by_bytes and model.get("type") == "BPE" and plain and apart)

    def ids(self, text: str) -> np.ndarray:
        if not self.proven:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        chunks = text.replace("\n", " ").replace("\t", " ").split(" ")
        found = b"".join(map(self.chunks.__getitem__, chunks))
        self.chunks.age()
        return np.frombuffer(found, "<u4")

    def chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() and chunk.isascii() and chunk.islower():
            return self.merged(chunk)
        core = chunk.rstrip(PUNCTUATION)
        if not core:
            return self.merged(chunk) if chunk else b""
        if not (core.isalpha() and (core.isascii() or max(core) <= "\xff")):
            return self.pack(self.library.encode(chunk, add_special_tokens=False).ids)
        word = core.lower()
        if word == chunk:
            return self.merged("".join(map(self.letters.__getitem__, word.encode())))
        return self.chunks[word] + self.chunks[chunk[len(core) :]]

    def merged(self, letters: str) -> bytes:
        return self.pack(map(TOKEN_ID, self.merge(letters)))

    @staticmethod
    def pack(ids: Iterable[int]) -> bytes:
        packed = array("I", ids)
        if sys.byteorder != "little":
            packed.byteswap()
        return packed.tobytes()


@cache
def encoder_of(path: str | None) -> Encoder:
    """One for all tasks of a worker: reading the tokenizer's file takes as long as encoding a megabyte. Tasks forget its chunks at their end."""
    return Encoder(path)


class Packer:
    """The level array and the open windows of one task. A piece is (id, start, ids, tokens of its document)."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.sequence = window, first_sequence
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, full = len(ids), len(ids) // self.window * self.window
        for a in range(0, full, self.window):
            self.close([(doc_id, a, ids[a : a + self.window], n)])
        if n > full:
            self.place((doc_id, full, ids[full:], n))

    def place(self, piece: tuple) -> None:
        size = len(piece[2])
        level = self.best_level(size)
        pieces = self.open[level].pop() if level else []
        self.counts[level] -= bool(level)
        self.n_open -= bool(level)
        pieces.append(piece)
        if level + size == self.window:
            self.close(pieces)
            return
        self.open[level + size].append(pieces)
        self.counts[level + size] += 1
        self.n_open += 1
        if self.n_open > MAX_OPEN:
            self.drain(MAX_OPEN // 2)

    def best_level(self, size: int) -> int:
        """The level whose choice changes the sum of squares least; the fullest of equals. 0 is a new window."""
        counts = self.counts[: self.window - size + 1]
        after = self.counts[size : self.window + 1].copy()
        # counts[window] is 0: a window that gets full is no partial one.
        change = 2 * (after - counts) + 2
        change[-1] -= 1
        change[0] = 2 * after[0] + 1
        change[1:][counts[1:] == 0] = np.iinfo(np.int64).max
        return int(len(change) - 1 - change[::-1].argmin())

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def drain(self, keep: int = 0) -> None:
        """Cuts the open windows, the fullest first, until ``keep`` are left."""
        line = []
        for level in range(self.window - 1, 0, -1):
            windows = self.open[level]
            while windows and self.n_open > keep:
                pieces = windows.pop()
                self.counts[level] -= 1
                self.n_open -= 1
                if level & (level - 1) == 0:
                    self.close(pieces)
                else:
                    line += pieces
        total = sum(len(p[2]) for p in line)
        cuts = [self.window] * (total // self.window)
        cuts += [1 << b for b in range(self.window.bit_length(), -1, -1) if total % self.window >> b & 1]
        line.reverse()
        for length in cuts:
            pieces = []
            while length:
                doc_id, start, ids, n = line.pop()
                if len(ids) > length:
                    line.append((doc_id, start + length, ids[length:], n))
                    ids = ids[:length]
                pieces.append((doc_id, start, ids, n))
                length -= len(ids)
            self.close(pieces)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 7
        self.rows = []
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one token, the closing id. Texts are packed whole, however long; each repeated row is packed
    anew; other columns are ignored; an empty table gives an empty table. Rows keep the order in which Spark reads them, so
    a rerun over the same files agrees.
    """
    end = np.array([END_ID], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = None, Packer(TaskContext.get().partitionId() << 40)
        try:
            for batch in pieces(batches):
                encoder = encoder or encoder_of(path)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    packer.add(doc_id, np.concatenate([encoder.ids(text), end]))
                yield packer.take()
        finally:
            if encoder:
                encoder.chunks.forget()
        packer.drain()
        yield packer.take()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)
