"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are tokenised, ended with id 0 and, if longer than the capacity, cut
into pieces. Pieces are then packed into sequences in rounds:

1. All pieces and all gaps (what is left in the sequences that are open) are
   ordered by size. Pieces of one length are interchangeable, as are gaps of
   one size, so the order is kept run-length coded: a class per size with a
   count. Spark counts the classes; there are at most ``capacity`` of them
   however many documents there are, and only they reach the driver.
2. A sweep from the largest size down gives each piece the smallest gap that
   fits (its successor). A gap takes one piece a round; when several want it,
   the longer comes first, then the lower rank in its length.
3. Gaps are updated, and the next round begins. When nothing fits any more, as
   many new sequences are opened by the longest pieces as the rest needs at
   least, until no piece is left.

The rounds yield flows: "the pieces of this length with ranks r to s go to
sequences n to n + s - r at this offset". Ranks are counted inside tasks and
shifted by the counts of the tasks before, so no length, however frequent, is
gathered; each piece then looks its flow up.

Ids are those of the tokenizers library for the given vocabulary. Most text is
encoded with tiktoken from the same vocabulary's ranks, word by word with a
cache; words with characters outside plain Latin text, or with special token
strings, go to the tokenizers library itself.

Defined results: a null text is empty, an empty text is one piece with id 0
alone; null ids and repeated rows are separate documents; an empty table gives
no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.session import cut_lineage

from .common import share, shared
from .words import text_slices

CAPACITY, END, CACHE = 2048, 0, 100_000
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
# Characters whose classes every Unicode version agrees on; words of others go to the library itself.
OTHER = re.compile("[^\n\r\t -~À-ɏ]|<\\|")
# A blank before a character that is not white space begins a word of the vocabulary's pattern.
LOOSE, BREAK = re.compile(r" (?=\s|\Z)"), re.compile(r"(?= \S)")


def encoder(vocabulary: str, ranks: str) -> Callable[[str], bytes]:
    """text -> little-endian 32-bit ids, without special tokens added."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    library: list[Tokenizer] = []

    def word(w: str) -> bytes:
        if OTHER.search(w):
            if not library:
                library.append(Tokenizer.from_file(vocabulary))
            ids = library[0].encode(w, add_special_tokens=False).ids
        else:
            ids = fast.encode_ordinary(w)
        return np.array(ids, "<u4").tobytes()

    class Cache(dict):
        def __missing__(self, w: str) -> bytes:
            if len(self) >= CACHE:
                self.clear()
            self[w] = out = word(w)
            return out

    cache = Cache()

    def encode(text: str) -> bytes:
        if LOOSE.search(text):
            return b"".join([cache[w] for w in BREAK.split(text)])
        first, *rest = text.split(" ")
        return b"".join([cache[first] if first else b"", *[cache[" " + w] for w in rest]])

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for the first if n is no multiple."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(vocabulary: str, ranks: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        part, rank = TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for some in text_slices(batch, "text"):
                ids, rows = some.column("doc_id").to_pylist(), []
                for i, t in zip(ids, some.column("text").to_pylist(), strict=True):
                    raw = encode(t or "") + end
                    for k, (start, n) in enumerate(cut(len(raw) // 4, capacity)):
                        own = raw[4 * start:4 * (start + n)]
                        rows.append((i, k, start, n, zlib.crc32(own), part, rank[n], own if with_ids else None))
                        rank[n] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    return run


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None,
           ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their rank within (part, length), as a written table."""
    import public_tokenizers
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    run = _pieces(vocabulary or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS), capacity, with_ids)
    out = d.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long, ids binary")
    return cut_lineage(out if with_ids else out.drop("ids"), "pieces")


def rounds(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Flows (length, first rank, number, first sequence, offset) that pack ``counts`` pieces per length."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)           # pieces of a length placed so far
    gaps: dict[int, list[list[int]]] = {}   # gap -> runs [first sequence, number]
    flows, sequences = [], 0

    def place(n: int, number: int, first: int, gap: int, into: dict[int, list[list[int]]]) -> None:
        flows.append((n, used[n], number, first, capacity - gap))
        used[n] += number
        left[n] -= number
        if not left[n]:
            del left[n]
        if gap > n:
            into.setdefault(gap - n, []).append([first, number])

    while left:
        smallest = min(left)
        updated: dict[int, list[list[int]]] = {}
        open_: list[tuple[int, list[int]]] = []  # gaps met so far, the smallest on top
        matched = False
        # One sweep over both orders: at equal size the gap comes first, so that it fits.
        for size in sorted(set(left) | {g for g in gaps if g >= smallest}, reverse=True):
            open_ += [(size, run) for run in gaps.pop(size, [])]
            while size in left and open_:
                gap, run = open_[-1]
                number = min(left[size], run[1])
                place(size, number, run[0], gap, updated)
                matched = True
                run[0] += number
                run[1] -= number
                if not run[1]:
                    open_.pop()
        for gap, run in open_:
            gaps.setdefault(gap, []).append(run)
        for gap, runs in updated.items():
            gaps.setdefault(gap, []).extend(runs)
        if not matched:
            # No piece fits any gap, so the rest needs this many sequences at least.
            need = max(-(-sum(n * c for n, c in left.items()) // capacity), sum(c for n, c in left.items() if 2 * n > capacity))
            for n in sorted(left, reverse=True):
                number = min(left[n], need)
                if number:
                    place(n, number, sequences, capacity, gaps)
                    sequences += number
                    need -= number
    return flows


class Lookup:
    """Flows by length, for arrays of (length, rank)."""

    def __init__(self, flows: list[tuple[int, int, int, int, int]]):
        f = np.array(sorted(flows), np.int64).reshape(-1, 5)
        self.length, self.rank, self.sequence, self.offset = f[:, 0], f[:, 1], f[:, 3], f[:, 4]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset): the flow of a piece is the last of its length that begins at or before its rank."""
        wide = np.int64(1) << 48
        at = np.searchsorted(self.length * wide + self.rank, length * wide + rank, "right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def _place(sent, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup: Lookup = shared(sent)
        for batch in batches:
            sequence, offset = lookup.place(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(sequence), pa.array(offset)],
                                             [*columns, "sequence_id", "offset"])
    return run


def pack(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces."""
    spark = cut_up.sparkSession
    per_part = cut_lineage(cut_up.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = per_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("shift"))
    columns = [c for c in cut_up.columns if c not in ("part", "rank")]
    ranked = cut_up.join(shifts, ["part", "length"]).select(*columns, (F.col("rank") + F.col("shift")).alias("rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(_place(share(spark, Lookup(rounds(counts, capacity))), columns), f"{kinds}, sequence_id long, offset long")


def op6(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs))
