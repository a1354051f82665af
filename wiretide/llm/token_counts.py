"""Token counts of whole texts under a sentencepiece model, with the whole-token shortcut.

Before any document is read, ``prove_shortcut`` checks on the vocabulary itself that pieces never reach across a
run of spaces that follows another character, nor across a line feed, and that the library changes no character. Then
the count of a text is the sum over its pre-tokens, and the vocabulary strings that encode alone as one token need no
merging at all. Other pre-tokens are merged by the library, once per worker as long as they stay in a bounded cache.
Without the proof every text goes to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

MODEL = "piece_bpe_32k.model"
#: Pre-tokens whose counts one worker keeps besides the proven ones; results don't depend on it.
CACHED_PRETOKENS = 200_000
LONGEST_CACHED = 64
SPACE = "▁"
_RUNS = re.compile(r" *[^ ]+| +$")
# Texts on which a normaliser that changes, folds or drops characters shows.
_PROBES = ["a  b", " a ", "ﬁ①Ａ", "é", "a\tb", "x　y", "A B", "­​"]


def load_model(path: str | None):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))


def prove_shortcut(path: str | None = None) -> tuple[list[str], list[str]] | None:
    """Vocabulary strings that encode alone as one token, after a space and at the start of a line; None without proof."""
    sp = load_model(path)
    if any(sp.decode(sp.encode(t)) != t.lstrip(" ") and sp.decode(sp.encode(t)) != t for t in _PROBES):
        return None
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(sp.get_piece_size())]
    pieces = [p for i, p in enumerate(map(sp.id_to_piece, range(sp.get_piece_size()))) if not special[i]]
    if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
        return None
    if len(sp.encode("a  b")) != len(sp.encode("a")) + len(sp.encode(" b")) or len(sp.encode("\n")) != 2:
        return None
    after_space = [p[1:] for p in pieces if p[0] == SPACE and SPACE not in p[1:] and len(p) > 1]
    bare = [p for p in pieces if SPACE not in p]
    one = lambda strings, lead, n: [s for s, ids in zip(strings, sp.encode([lead + s for s in strings]), strict=True) if len(ids) == n]
    return one(after_space, "", 1), one(bare, "\n", 3)


class Counts(dict):
    """Tokens by pre-token. ``lead`` is put before one for the library, and its tokens are taken off again."""

    def __init__(self, sp, whole: list[str], lead: str):
        super().__init__()
        self.sp, self.whole, self.lead = sp, whole, lead
        self.off = len(sp.encode(lead))
        self.start()

    def start(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.whole, 1))
        # An empty pre-token after a space is the space alone; at the start of a line it is nothing.
        self[""] = 0 if self.lead else 1

    def __missing__(self, key: str) -> int:
        n = len(self.sp.encode(self.lead + key)) - self.off
        if len(key) <= LONGEST_CACHED:
            if len(self) >= CACHED_PRETOKENS + len(self.whole):
                self.start()
            self[key] = n
        return n


class TokenCounter:
    def __init__(self, path: str | None, proven: tuple[list[str], list[str]] | None):
        self.sp = load_model(path)
        self.proven = proven is not None
        if self.proven:
            self.spaced, self.bare = Counts(self.sp, proven[0], ""), Counts(self.sp, proven[1], "\n")

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if not self.proven:
            return len(self.sp.encode(text))
        spaced, bare = self.spaced, self.bare
        if SPACE in text:
            text = text.replace(SPACE, " ")
        lines = text.split("\n")
        total = len(lines) - 1
        for k, line in enumerate(lines):
            if "  " in line or not k and line[:1] == " ":
                # The library puts one space before the text.
                for run in _RUNS.findall(line if k else " " + line):
                    total += spaced[run[1:]] if run[0] == " " else bare[run]
                continue
            items = line.split(" ")
            if k:
                total += bare[items[0]]
                del items[0]
            total += sum(map(spaced.__getitem__, items))
        return total


def count_tokens(
    docs: DataFrame, limit: int = 4096, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Columns ``id_col``, n_bytes, n_tokens, over_limit: one row per input row, whatever other columns it has.

    Null and empty texts have 0 bytes and 0 tokens. Texts are counted whole, however long; repeated rows are counted one by
    one; an empty table gives an empty table. ``path`` is the model's file on every executor.
    """
    proven = docs.sparkSession.sparkContext.broadcast(prove_shortcut(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in pieces(batches):
            counter = counter or TokenCounter(path, proven.value)
            tokens = [counter(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))
    counted = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
