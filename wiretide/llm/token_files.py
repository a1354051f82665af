"""Token ids of documents in compressed binary shards, in ascending order of document ids, and reading them back.

Rows are cut into ranges of the order of ids; each task encodes the texts of its range, and every ``SHARD_IDS`` ids or so become one
shard, compressed by itself (``re_pair``). A folder holds Parquet files whose rows are shards: the range's number, the shard's number in it,
its number of ids, the ids before it in the range, and the shard's bytes, from which any stretch of ids can be read alone.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import scratch_path
from .common import pieces, reuse_memory
from .packing import byte_letters
from .re_pair import Shard, write_shard

MODEL = "byte_bpe_50k.json"
END_ID = 0
#: Ids after which a shard is closed; documents aren't cut, so a longer document is a longer shard.
SHARD_IDS = 1 << 18
SHARD_SCHEMA = "part int, shard int, n_ids long, ids_before long, n_docs long, data binary"
#: Characters cut at a time, and characters whose different chunks are merged together; results don't depend on them.
BLOCK_CHARS = 1 << 20
HELD_CHARS = 1 << 25
LETTER, NUMBER, SPACE, OTHER, CHANGED = range(1, 6)
WHITE_SPACE = frozenset(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CUT = re.compile(r"(?<=\w)[ \n]")


def prove_ranks(settings: dict, alone: Callable[[str], int]) -> dict[bytes, int] | None:
    """The vocabulary by bytes, if merging by ranks of bytes gives the library's ids; None without proof.

    The tokenizer must split by the byte-level rule and change no text, its ids must be the 256 bytes and then the merges in their
    order, and each merged string must encode ``alone`` as one token. Then, wherever two neighbouring parts make up such a
    string, they are the two that its merge names: what happens inside the string doesn't depend on what is around it, and ends
    in that merge. So the lowest rank of the bytes is the first merge.
    """
    before, model = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    plain = not any(settings.get(k) for k in ("normalizer", "truncation", "padding")) and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    )
    if not (byte_level and plain and model.get("type") == "BPE"):
        return None
    byte_of = {letter: b for b, letter in byte_letters().items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    added = {t["content"] for t in settings.get("added_tokens") or []}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    in_order = all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs))
    whole = len(vocab) == 256 + len(pairs) and {t for t, i in vocab.items() if i < 256} == set(byte_of)
    if not (in_order and whole and all(alone(a + b) == 1 for a, b in pairs)):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}


def steady(char: str) -> bool:
    """Whether all versions of the character tables since 3.2 agree on what the split needs to know: letter, number, space or other."""
    old, now = unicodedata.ucd_3_2_0.category(char), unicodedata.category(char)
    return old != "Cn" and (old[0] in "LNZ" and old[0]) == (now[0] in "LNZ" and now[0])


def kind(char: str) -> int:
    """The class of a character under the split: LETTER, NUMBER, SPACE or OTHER; CHANGED if it isn't steady."""
    if not steady(char):
        return CHANGED
    return SPACE if char in WHITE_SPACE else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(char)[0], OTHER)


def chunk_starts(points: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a chunk of the byte-level split starts at each code point.

    The split is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Texts begin at ``bounds``, of which the
    last is their end; two more characters behind it are texts of their own.
    """
    first = np.zeros(len(points), bool)
    first[bounds] = first[-2:] = True
    space = kinds == SPACE
    starts = np.ones(len(points), bool)
    # A space alone goes with what follows it; the last of several white-space characters is apart if the text goes on.
    starts[1:] = (kinds[1:] != kinds[:-1]) & ~((points[:-1] == 32) & ~space[1:]) | first[1:]
    starts[1:-1] |= space[:-2] & space[1:-1] & ~space[2:] & ~first[2:]
    quotes = np.flatnonzero(points[:-2] == 39)
    quotes = quotes[starts[quotes] & ~first[quotes + 1]]
    one, two = points[quotes + 1], points[quotes + 2]
    length = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
    pair = np.zeros(len(quotes), bool)
    for a, b in ("re", "ve", "ll"):
        pair |= (one == ord(a)) & (two == ord(b))
    length[pair & ~first[quotes + 2]] = 2
    quotes, length = quotes[length > 0], length[length > 0]
    starts[quotes + 1] = False
    starts[quotes + 1 + length] = True
    return starts


@dataclass
class Coded:
    """Texts cut into chunks: the number of texts, the ids of those that went to the library whole, the chunks of all others after each
    other, and the place of each one's first chunk, with their end."""

    size: int
    whole: dict[int, np.ndarray]
    chunks: pa.DictionaryArray
    cuts: np.ndarray


class Encoder:
    """Ids of whole texts, equal to the library's.

    With ``prove_ranks`` many texts are cut at once, by the classes of their characters, into the chunks that the byte-level rule
    merges by themselves. Of the different chunks of ``HELD_CHARS`` characters, a vocabulary string is its id, and the library's model
    merges every other one once. Texts that hold the string of an added token, or a character whose class changed between versions, and
    all texts without the proof go to the library whole.
    """

    def __init__(self, path: str | None, ranks: dict[bytes, int] | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or public_tokenizers.path(MODEL))
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ranked = ranks or prove_ranks(json.loads(self.library.to_str()), lambda t: len(self.library.model.tokenize(t)))
        self.vocabulary = pa.array(list(self.ranked or {}), pa.large_binary())
        self.vocabulary_ids = np.array(list((self.ranked or {}).values()), np.uint32)
        self.kinds = np.zeros(0x110000, np.uint8)
        letters = byte_letters()
        self.letters = np.array([ord(letters[b]) for b in range(256)], "<u4")

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        return [ids for _, ids in self.stream(enumerate(texts))]

    def stream(self, rows: Iterable[tuple[object, str]]) -> Iterator[tuple[object, np.ndarray]]:
        """Keys of rows and the ids of their texts, in the order of the rows."""
        keys, block, held, size, total = [], [], [], 0, 0
        opened: list[np.ndarray] = []

        def joined() -> Iterator[tuple[object, np.ndarray]]:
            for (key, last), ids in zip(keys, self.expanded(held), strict=True):
                opened.append(ids)
                if last:
                    yield key, opened[0] if len(opened) == 1 else np.concatenate(opened)
                    opened.clear()

        for key, text in rows:
            parts = self.parts(text)
            for k, part in enumerate(parts, 1):
                keys.append((key, k == len(parts)))
                block.append(part)
                size += len(part) + 1
                if size >= BLOCK_CHARS:
                    held.append(self.coded(block))
                    block, size, total = [], 0, total + size
                if total >= HELD_CHARS:
                    yield from joined()
                    keys, held, total = [], [], 0
        if block:
            held.append(self.coded(block))
        yield from joined()

    def parts(self, text: str) -> list[str]:
        """A long text cut before white space behind a letter or number, where a chunk ends whatever comes before or after."""
        if len(text) <= BLOCK_CHARS or not self.ranked or self.apart(text):
            return [text]
        cuts = [0]
        while hit := CUT.search(text, cuts[-1] + BLOCK_CHARS):
            cuts.append(hit.start())
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]

    def apart(self, text: str) -> bool:
        return any(a in text for a in self.added)

    def coded(self, texts: list[str]) -> Coded:
        alone = {k for k, t in enumerate(texts) if not self.ranked or self.apart(t)}
        points = self.points([t for k, t in enumerate(texts) if k not in alone])
        if (self.kinds[points] == CHANGED).any():
            alone |= {k for k, t in enumerate(texts) if k not in alone and (self.kinds[self.points([t])] == CHANGED).any()}
            points = self.points([t for k, t in enumerate(texts) if k not in alone])
        whole = {k: np.array(self.library.encode(texts[k], add_special_tokens=False).ids, np.uint32) for k in alone}
        rest = [t for k, t in enumerate(texts) if k not in alone]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in rest], dtype=np.int64)])
        # Behind the last text the marks start chunks of their own, whose first is the end of the last one.
        at = np.flatnonzero(chunk_starts(points, self.kinds[points], bounds))[:-1]
        data = ("".join(rest) + "\0").encode()
        # Bytes that start a character are all but 0x80 to 0xBF, the lowest as signed numbers.
        offsets = np.flatnonzero(np.frombuffer(data, np.int8) >= -64)[at]
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return Coded(len(texts), whole, chunks.dictionary_encode(), np.searchsorted(at, bounds))

    def points(self, texts: list[str]) -> np.ndarray:
        """Code points of all texts and of two characters behind them; their classes are known from then on."""
        points = np.frombuffer(("".join(texts) + "\0\0").encode("utf-32-le"), "<u4")
        unknown = points[self.kinds[points] == 0]
        for point in np.unique(unknown).tolist():
            self.kinds[point] = kind(chr(point))
        return points

    def expanded(self, held: list[Coded]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if not held:
            return
        shared = pa.chunked_array([c.chunks for c in held]).unify_dictionaries()
        counts, kept = self.merged(shared.chunk(0).dictionary)
        places = np.cumsum(counts) - counts
        for coded, chunks in zip(held, shared.chunks, strict=True):
            numbers = chunks.indices.to_numpy()
            sizes = counts[numbers]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = np.repeat(places[numbers] - ends[:-1], sizes)
            at += np.arange(len(at))
            ids = kept.take(at)
            cuts = ends[coded.cuts].tolist()
            rest = zip(cuts, cuts[1:], strict=False)
            for k in range(coded.size):
                yield coded.whole[k] if k in coded.whole else ids[slice(*next(rest))]

    def merged(self, chunks: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each chunk, and all their ids."""
        known = pc.index_in(chunks, value_set=self.vocabulary).fill_null(-1).to_numpy()
        _, bounds, data = chunks.buffers()
        bounds = np.frombuffer(bounds, np.int64)[chunks.offset :][: len(chunks) + 1]
        letters = self.letters[np.frombuffer(data, np.uint8)].tobytes().decode("utf-32-le")
        others = np.flatnonzero(known < 0)
        tokenize, sizes, merged = self.library.model.tokenize, [], array("I")
        for a, b in zip(bounds[others].tolist(), bounds[others + 1].tolist(), strict=True):
            tokens = tokenize(letters[a:b])
            sizes.append(len(tokens))
            merged.extend([t.id for t in tokens])
        counts = np.ones(len(chunks), np.int64)
        counts[others] = sizes
        kept = np.empty(int(counts.sum()), np.uint32)
        of_vocabulary = np.repeat(known >= 0, counts)
        kept[of_vocabulary] = self.vocabulary_ids[known[known >= 0]]
        kept[~of_vocabulary] = np.frombuffer(merged, np.uint32)
        return counts, kept


class Writer:
    """The open shard of one task."""

    def __init__(self, part: int, shard_ids: int):
        self.part, self.shard_ids = part, shard_ids
        self.shard, self.before = 0, 0
        self.start()

    def start(self) -> None:
        self.size, self.ids, self.doc_ids = 0, [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.ids.append(ids)
        self.size += len(ids)

    def close(self) -> pa.RecordBatch:
        data = write_shard(np.concatenate(self.ids), self.doc_ids, [len(i) for i in self.ids])
        row = (self.part, self.shard, self.size, self.before, len(self.doc_ids), data)
        self.shard, self.before = self.shard + 1, self.before + self.size
        self.start()
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = [part.split()[0] for part in SHARD_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    shard_ids: int = SHARD_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Writes the ids of all rows to ``folder``, each row's followed by ``end_id``, in ascending order of ``id_col``.

    Null ids come first; rows of one id are in the order of a hash of their texts, and may lie in several ranges, so one id may
    hold any share of the rows. Null and empty texts are the end id alone. Texts are written whole, however long; repeated rows are written
    each; other columns are ignored; an empty table gives a folder without shards. ``tokenizer`` is the file's path on every executor.
    """
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("r"), text.alias("t"))
    order = [F.col("id").asc_nulls_first(), F.col("h").asc(), F.col("r").asc()]
    ranged = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    proven = docs.sparkSession.sparkContext.broadcast(Encoder(tokenizer).ranked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        writer = Writer(TaskContext.get().partitionId(), shard_ids)
        end = np.array([end_id], np.uint32)
        rows = (row for b in pieces(batches) for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if first := next(rows, None):
            for doc_id, ids in Encoder(tokenizer, proven.value).stream(chain([first], rows)):
                writer.add(doc_id, np.concatenate([ids, end]))
                if writer.size >= shard_ids:
                    yield writer.close()
        if writer.doc_ids:
            yield writer.close()

    ranged.select("id", "t").mapInArrow(run, SHARD_SCHEMA).write.parquet(folder)


def token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard, with ``first``: the number of ids in the folder before it."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    # One row per range, as many as the writing job had partitions.
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return shards.join(bases, "part").withColumn("first", F.col("base") + F.col("ids_before")).drop("base")


def _map_shards(shards: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` of (first, opened shard) gives columns by name."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        for batch in batches:
            for first, data in zip(batch.column(0), batch.column(1), strict=True):
                columns = fn(first.as_py(), Shard(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return shards.select("first", "data").mapInArrow(run, schema)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), ids, with the closing one."""

    def fn(first: int, shard: Shard):
        ids, cuts = shard.ids().astype(np.int64), shard.doc_starts[1:]
        return shard.doc_ids, shard.doc_starts + first, [part.tolist() for part in np.split(ids, cuts)]

    return _map_shards(token_shards(spark, folder), fn, "doc_id long, start long, ids array<long>")


def read_stretch(spark: SparkSession, folder: str, start: int, length: int) -> DataFrame:
    """Columns first, ids (little-endian 32-bit): the parts, shard by shard, of ``length`` ids from number ``start`` of the folder on.

    Only the shards that hold some of them are opened, and of these only the symbols in reach are expanded.
    """

    def fn(first: int, shard: Shard):
        low = max(0, start - first)
        part = shard.ids(low, max(0, start + length - first - low))
        return [first + low], [part.astype("<u4").tobytes()]

    shards = token_shards(spark, folder).where((F.col("first") < start + length) & (F.col("first") + F.col("n_ids") > start))
    return _map_shards(shards, fn, "first long, ids binary")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian 32-bit numbers)."""

    def fn(first: int, shard: Shard):
        ids = memoryview(shard.ids().astype("<u4").tobytes())
        starts, ends = shard.doc_starts, shard.doc_starts + shard.doc_lengths
        crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return shard.doc_ids, starts + first, shard.doc_lengths, crcs

    return _map_shards(token_shards(spark, folder), fn, "doc_id long, start long, n_tokens long, ids_crc32 long")


def rewrite_and_digest(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Writes token files (to the shared scratch folder without ``folder``) and returns ``token_digests`` of them."""
    folder = folder or scratch_path(docs.sparkSession)
    write_token_files(docs, folder, tokenizer)
    return token_digests(docs.sparkSession, folder)
