"""Best-fit packing by a linear grouping scheme.

Sizes are whole numbers up to the sequence length, so a histogram of at most ``LENGTH``
counts describes all pieces of a corpus of any size.  The plan is made from it on the driver:

1. Large sizes are sorted and cut into groups of equal cardinality; each is rounded up to the
   largest of its group.
2. Configurations of the few rounded sizes are chosen one after the other, each the fullest
   that an exact knapsack finds among what is left, and used as often as the counts allow.
3. Actual sizes take the places of the rounded ones, group by group, largest first.
4. Small sizes go into the gaps, each into the fullest sequence that still has room.

Pieces then find their places by rank within their size.  Ranks come from counts per
(size, bucket) and row numbers within a bucket, so no size's pieces meet in one task.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailspark.llm.common import settle, table, utf8

LENGTH = 1_024
END = 2
GROUPS = 1_024
SMALL = 1 / 8
_BUCKET_ROWS = 20_000


# -- tokens ---------------------------------------------------------------------------------

#: Texts of these characters alone are split the same way by every Unicode version.
_PLAIN = r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ſ]*"


class PieceEncoder:
    """Ids of a byte-level BPE as little-endian 32-bit bytes.

    ``tokenizers`` defines the ids.  Texts of ``_PLAIN`` characters without overlong words or
    gaps take the same vocabulary's faster encoder, which gives the same ids for them: both
    split such texts alike and merge by the same ranks.  All other texts go through
    ``tokenizers`` itself.
    """

    LONGEST = 400

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.plain = re.compile(_PLAIN).fullmatch
        letter = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(letter[c] for c in token): n for token, n in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.plain(text):
            parts = text.split()
            sizes = list(map(len, parts))
            if max(sizes, default=0) <= self.LONGEST and len(text) - sum(sizes) <= 3 * len(parts) + self.LONGEST:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next code from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Shared:
    """One encoder for all tasks of a Python worker, made there; sent as a broadcast, it goes when the worker turns to other work."""

    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern = path, pattern

    @cached_property
    def encoder(self) -> PieceEncoder:
        return PieceEncoder(self.path, self.pattern)


def pieces(docs: DataFrame, tokenizer: str, pattern: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``length``: doc_id, piece, start, length, ids_crc32 (and ids).

    A document is its ids and then id ``END``.  Longer ones are cut into pieces of ``length``,
    the first of which takes the remainder.  Null text counts as empty: one piece of one id.
    """
    base = docs.select("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    end = np.array([END], dtype="<u4").tobytes()
    shared = docs.sparkSession.sparkContext.broadcast(_Shared(tokenizer, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encoder.encode
        for batch in batches:
            row, piece, start, size, crc, ids = [], [], [], [], [], []
            for k, raw in enumerate(utf8(batch.column(1))):
                data = (encode(raw.decode()) if raw else b"") + end
                n = len(data) // 4
                s, e = 0, n % length or min(n, length)
                number = 0
                while s < n:
                    part = data[4 * s : 4 * e]
                    row.append(k)
                    piece.append(number)
                    start.append(s)
                    size.append(e - s)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int64))
                    s, e, number = e, e + length, number + 1
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return base.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


# -- the plan -------------------------------------------------------------------------------


def _fullest(sizes: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """(index, copies) of the fullest configuration that holds the first size left and at most ``counts`` of each.

    Ties go to larger sizes.  A bounded knapsack over bit sets: one integer of reachable fills
    per size.
    """
    first = next(i for i, c in enumerate(counts) if c)
    room -= sizes[first]
    avail = [c - (i == first) for i, c in enumerate(counts)]
    mask = (1 << (room + 1)) - 1
    reach, history = 1, []
    for i in range(first, len(sizes)):
        history.append((i, reach))
        top = min(avail[i], room // sizes[i])
        step, left = 1, top
        while left > 0:
            step = min(step, left)
            reach |= (reach << (step * sizes[i])) & mask
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    fill = reach.bit_length() - 1
    taken = {first: 1}
    last = history[-1][0]
    for i, before in reversed(history):
        if i > last:
            continue
        n = 0
        while not before >> fill & 1:
            fill -= sizes[i]
            n += 1
        if n:
            taken[i] = taken.get(i, 0) + n
    return sorted(taken.items())


def plan(histogram: dict[int, int], length: int = LENGTH, groups: int = GROUPS, small: float = SMALL) -> list[tuple[int, list[int]]]:
    """Sequences as (copies, sizes): each stands for ``copies`` sequences holding these sizes in order."""
    limit = max(1, int(length * small))
    bins: list[tuple[int, list[int]]] = []
    if full := histogram.get(length, 0):
        bins.append((full, [length]))
    large = sorted((s for s in histogram if limit < s < length and histogram[s]), reverse=True)
    total = sum(histogram[s] for s in large)
    # 1. groups of equal cardinality, rounded up to their largest size
    share = max(1, -(-total // groups))
    stock: list[list[list[int]]] = []  # per group: [size, count] with the largest first
    free = 0
    for s in large:
        left = histogram[s]
        while left:
            if not free:
                stock.append([])
                free = share
            n = min(left, free)
            stock[-1].append([s, n])
            left -= n
            free -= n
    rounded = [g[0][0] for g in stock]
    merged: dict[int, list[list[int]]] = {}
    for r, g in zip(rounded, stock, strict=True):
        merged.setdefault(r, []).extend(g)
    sizes = sorted(merged, reverse=True)
    counts = [sum(n for _, n in merged[s]) for s in sizes]
    fillers = sorted((s for s in histogram if s <= limit and histogram[s]), reverse=True)
    rest = {s: histogram[s] for s in fillers}
    while any(counts):
        config = _fullest(sizes, counts, length)
        times = min(counts[i] // n for i, n in config)
        for i, n in config:
            counts[i] -= n * times
        # 3. actual sizes in the places of the rounded ones; runs end where an actual size runs out
        while times:
            run = min(times, *(max(1, merged[sizes[i]][0][1] // n) for i, n in config))
            taken: list[tuple[int, int]] = []
            for i, n in config:
                queue = merged[sizes[i]]
                left = n * run
                while left:
                    m = min(left, queue[0][1])
                    taken += [(queue[0][0], m)]
                    queue[0][1] -= m
                    left -= m
                    if not queue[0][1]:
                        queue.pop(0)
            bins.append((run, [s for s, m in taken for _ in range(m // run)]))
            times -= run
    # 4. small sizes, largest first, into the fullest sequence with room
    gaps: list[tuple[int, int]] = []
    keys = count()
    kept: dict[int, tuple[int, list[int]]] = {}

    def put(copies: int, own: list[int]) -> None:
        gap = length - sum(own)
        if not gap:
            done.append((copies, own))
            return
        key = next(keys)
        kept[key] = (copies, own)
        insort(gaps, (gap, key))

    done: list[tuple[int, list[int]]] = []
    for copies, own in bins:
        put(copies, own)
    for s in fillers:
        left = rest[s]
        while left:
            at = bisect_left(gaps, (s, -1))
            if at == len(gaps):
                fit = length // s
                if left >= fit:
                    put(left // fit, [s] * fit)
                    left %= fit
                else:
                    put(1, [s] * left)
                    left = 0
                continue
            gap, key = gaps.pop(at)
            copies, own = kept.pop(key)
            fit = gap // s
            whole = min(copies, left // fit)
            if whole:
                put(whole, own + [s] * fit)
                left -= whole * fit
            if copies > whole and left and left < fit:
                put(1, own + [s] * left)
                left, whole = 0, whole + 1
            if copies > whole:
                put(copies - whole, own)
    return done + list(kept.values())


def _places(bins: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By size: first rank of each run of places, its first sequence, places in a sequence, first offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for copies, own in bins:
        at = 0
        k = 0
        while k < len(own):
            s = own[k]
            n = 1
            while k + n < len(own) and own[k + n] == s:
                n += 1
            runs.setdefault(s, []).append((used.get(s, 0), base, n, at))
            used[s] = used.get(s, 0) + copies * n
            at += n * s
            k += n
        base += copies
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for s, r in runs.items()}


def pack(cut: DataFrame, length: int = LENGTH, groups: int = GROUPS, small: float = SMALL) -> DataFrame:
    """Add sequence_id and offset to pieces (any columns; ``length``, ``doc_id`` and ``piece`` are used).

    Sequences are gapless from offset 0 and hold at most ``length`` ids.  An empty table gives
    an empty table; repeated rows are packed as often as they occur.
    """
    spark = cut.sparkSession
    held = settle(cut)
    counted = {r[0]: r[1] for r in held.groupBy("length").count().collect()}  # at most `length` rows
    total = sum(counted.values())
    buckets = max(64, -(-total // _BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets))
    marked = held.withColumn("__bucket", bucket)
    sums = marked.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("length").alias("__size"), F.col("__bucket").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece")
    ranked = (
        marked.withColumn("__own", F.row_number().over(own) - 1)
        .join(base, (F.col("length") == F.col("__size")) & (F.col("__bucket") == F.col("__at")))
        .withColumn("__rank", F.col("__own") + F.col("__base"))
        .drop("__own", "__base", "__size", "__at", "__bucket")
    )
    places = spark.sparkContext.broadcast(_places(plan(counted, length, groups, small)))  # bounded by sizes and groups
    at, rank = ranked.columns.index("length"), ranked.columns.index("__rank")
    out = [c for c in ranked.columns if c != "__rank"]
    keep = [ranked.columns.index(c) for c in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(at).to_numpy(zero_copy_only=False)
            r = batch.column(rank).to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                where = np.flatnonzero(size == s)
                first, start, n, offset = places.value[int(s)]
                k = np.searchsorted(first, r[where], "right") - 1
                within = r[where] - first[k]
                seq[where] = start[k] + within // n[k]
                off[where] = offset[k] + within % n[k] * s
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(seq), pa.array(off)], [*out, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*out).schema)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Cut, encode and pack documents; ``tokenizer`` is the path of a byte-level BPE file."""
    import public_tokenizers

    return pack(pieces(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, length, with_ids), length)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
