"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Features are all words of the labelled examples.  Evidence (the log-likelihood ratio of a
feature's presence with label 1) is a factor of a word's weight and leaves none out; beginnings
of words, which are no words of the text, join where they have evidence of their own.  Inverse
document frequencies are counted over *all* documents.

The index is an inverted one with block maxima.  Examples are put in order of likeness and cut
into blocks of ``BLOCK``.  The lists of rare features are read in full; the long lists of the
``HEAD`` most frequent ones are kept block by block (as rows of a matrix, so that a block is
read for many queries at a time) beside the largest weight that each feature has in the block.
A block whose maxima, with the best that its examples have from the rare features, stay below a
query's k-th best cosine so far is skipped.  Sums are in single precision with a margin;
whatever may belong to the nearest is summed up again in double precision: the neighbours are
exact.  Votes are weighted by similarity and calibrated by isotonic regression of leave-one-out
votes on the examples.

Scale: the model is bounded by the words of ``MAX_EXAMPLES`` texts and is broadcast.  Documents
are read once and turned into feature numbers, which are written to the shared folder (some
three tenths of the texts' size); frequencies and scores are made from those.  Nothing is
shuffled but counts.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tailspark.llm.common import WORD_TABLE, free_name, one_thread_a_task, settle, small_batches, store, table, utf8

#: Bound on the labelled rows that the classifier is fitted on.
MAX_EXAMPLES = 20_000
#: Bound on the examples whose leave-one-out votes calibrate the score.
MAX_CALIBRATION = 4_000
#: Evidence at which a word has about half of the full weight, and that a beginning needs; the weight of words without any.
MIN_EVIDENCE = 15.0
PLAIN = 0.1
NEIGHBOURS = 15
#: Features that are multiplied as a matrix, queries at a time, and the bound on what single precision may be off by, twice.
HEAD, QUERIES, MARGIN = 512, 128, 1e-4
#: Examples in a block of the index; blocks that a query reads in each round, best bounds first, before the rest.
BLOCK, ROUNDS = 128, (1, 8)
#: Groups of like examples, and rounds of moving examples between them.
GROUPS, MOVES = 32, 3
#: Postings of rare features that are read at a time.
READ = 1 << 16
#: Place of the upper half of a 64-bit number among its halves.
_UPPER = int(sys.byteorder == "little")
#: Examples at a time while the lists are made.
CHUNK = 500
#: Entries that a Python worker remembers: scores, counts, occurrences, words with beginnings.
CACHED, FLUSH, PENDING, REMEMBERED = 5_000, 150_000, 1_000_000, 20_000
#: Rows with texts that a Python worker gives back at a time.
ROWS = 1_024
_BEGINNINGS = (4, 5, 6, 7)


def features(data: bytes | None) -> Counter:
    """Counts of words; beginnings are derived from them by ``expand``."""
    return Counter(data.decode().lower().encode().translate(WORD_TABLE).split()) if data else Counter()


def expand(word: bytes) -> list[bytes]:
    """A word and its beginnings of a few bytes, marked so that they differ from words."""
    return [word, *(b"^" + word[:n] for n in _BEGINNINGS if len(word) > n)]


def _starts(vocab: dict[bytes, int]) -> set[bytes]:
    """First bytes of the words that some beginning in the vocabulary may fit."""
    return {x[1 : 1 + _BEGINNINGS[0]] for x in vocab if x[:1] == b"^"}


class _Beginnings(dict):
    """Numbers of the beginnings of words, remembered."""

    def __init__(self, vocab: dict[bytes, int]) -> None:
        self.vocab = vocab

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = [f for x in expand(word)[1:] if (f := self.vocab.get(x)) is not None]
        return found


def _occurrences(counts: Counter, vocab: dict[bytes, int], starts: set[bytes], beginnings: _Beginnings) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features of a text in order, and how often each occurs."""
    fs = np.fromiter(map(vocab.get, counts, repeat(-1)), np.int64, len(counts))
    ns = np.fromiter(counts.values(), np.int64, len(counts))
    known = fs >= 0
    fs, ns = fs[known], ns[known]
    if starts:
        cut, more = _BEGINNINGS[0], {}
        for word in [w for w in counts if w[:cut] in starts]:
            for f in beginnings[word]:
                more[f] = more.get(f, 0) + counts[word]
        fs, ns = np.concatenate((fs, np.fromiter(more, np.int64, len(more)))), np.concatenate((ns, np.fromiter(more.values(), np.int64, len(more))))
    order = np.argsort(fs)
    return fs[order], ns[order]


def _code(fs: np.ndarray, ns: np.ndarray) -> bytes:
    """Feature numbers and counts as steps, byte plane by byte plane, compressed."""
    both = np.concatenate((np.diff(fs, prepend=0), ns)).astype("<u4")
    return len(fs).to_bytes(4, "little") + pa.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) if len(fs) else b""


def _coded_size(data: bytes) -> int:
    return int.from_bytes(data[:4], "little")


def _decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = _coded_size(data)
    both = np.frombuffer(pa.decompress(data[4:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    return np.cumsum(both[:n]), both[n:]


def _likeness(head: np.ndarray) -> np.ndarray:
    """Order of examples in which like ones are neighbours: groups about moving centres, sparse examples first."""
    n = len(head)
    size = np.concatenate([np.zeros(0, np.int64), *((head[a : a + CHUNK] > 0).sum(axis=1) for a in range(0, n, CHUNK))])
    if n <= BLOCK:
        return np.argsort(size, kind="stable")

    def unit(rows: np.ndarray) -> np.ndarray:
        rows = rows.astype(np.float32)
        return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-9)

    centres = unit(head[np.linspace(0, n - 1, GROUPS).astype(int)])
    group = np.zeros(n, dtype=np.int64)
    for _ in range(MOVES):
        total = np.zeros_like(centres)
        for a in range(0, n, CHUNK):
            rows = unit(head[a : a + CHUNK])
            group[a : a + CHUNK] = (rows @ centres.T).argmax(axis=1)
            np.add.at(total, group[a : a + CHUNK], rows)
        met = np.bincount(group, minlength=GROUPS) > 0
        centres[met] = unit(total[met])
    return np.lexsort((size, group))


def _pack(x: np.ndarray | None) -> tuple | None:
    """An array, compressed byte plane by byte plane."""
    return None if x is None else (x.dtype.str, len(x), pa.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), "zstd", asbytes=True) if len(x) else b"")


def _unpack(packed: tuple | None) -> np.ndarray | None:
    if packed is None:
        return None
    kind, n, data = packed
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def _packed(words: pa.Array) -> tuple:
    """Words without line ends, and how many."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"\n")[0]
    return _pack(np.frombuffer(joined.as_buffer(), np.uint8)), len(words)


@dataclass
class Model:
    """Weights of the features, unit vectors of the examples, and the calibration of their votes.

    Words may be given packed, and examples are learnt as codes: both are unpacked by those who search.
    """

    vocab: dict[bytes, int] | tuple
    idf: np.ndarray
    labels: np.ndarray
    ids: list
    vectors: list[tuple[np.ndarray, np.ndarray]]
    blank: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0), np.zeros(0)))

    def __post_init__(self) -> None:
        if isinstance(self.vocab, tuple):
            self.packed = self.__dict__.pop("vocab")
        else:
            self.packed = _packed(pa.array(list(self.vocab), pa.binary()))
        self.codes, self.times = None, None
        self.value = np.concatenate([np.zeros(0), *(ws for _, ws in self.vectors)]).astype(np.float64)
        self.first = np.concatenate(([0], np.cumsum([len(fs) for fs, _ in self.vectors], dtype=np.int64))).astype(np.int64)
        self.feature = np.concatenate([np.zeros(0, np.int32), *(fs for fs, _ in self.vectors)]).astype(np.int32)
        self.vectors = []
        self._forget()

    def learn(self, labels: list[int], ids: list, codes: list[bytes]) -> None:
        """Take examples as codes of their features; their weights are worked out where they are needed."""
        self.labels, self.ids, self.codes = np.array(labels, dtype=np.float64), ids, codes
        self.first = self.feature = self.times = self.value = None
        self._forget()

    def _read_codes(self) -> None:
        """Features of the examples, and how often each occurs, in arrays of just their size."""
        self.first = np.concatenate(([0], np.cumsum([_coded_size(x) for x in self.codes], dtype=np.int64))).astype(np.int64)
        self.feature, self.times = np.empty(self.first[-1], np.int32), np.empty(self.first[-1], np.uint16)
        for e, x in enumerate(self.codes):
            span = slice(self.first[e], self.first[e + 1])
            self.feature[span], ns = _decode(x)
            if self.times.dtype == np.uint16 and ns.max(initial=0) >= 1 << 16:
                self.times = self.times.astype(np.uint32)
            self.times[span] = ns
        if self.sent:  # nobody sends it on
            self.codes = None

    def _forget(self) -> None:
        self.at = self.starts = None
        self.sent = False
        self.cache: dict = {}
        self.read = self.seen = 0

    def __getstate__(self) -> dict:
        """What is broadcast, small; each reader makes its own lists."""
        learnt = ("codes",) if self.codes is not None else ("first", "feature", "value")
        return {k: getattr(self, k) for k in ("packed", "idf", "labels", "ids", "blank", "steps", *learnt)}

    def __setstate__(self, state: dict) -> None:
        self.codes = self.times = self.value = None
        self.vectors = []
        self.__dict__.update(state)
        self._forget()
        self.sent = True

    def __getattr__(self, name: str):
        """The vocabulary is made where a text is looked up, and nowhere else."""
        if name == "vocab" and "packed" in self.__dict__:
            words, n = self.packed
            self.vocab = {w: i for i, w in enumerate(_unpack(words).tobytes().split(b"\n"))} if n else {}
            return self.vocab
        raise AttributeError(name)

    def _weights(self, at) -> np.ndarray:
        """Weights of entries of the examples, before they are divided by their example's norm."""
        return self.value[at] if self.times is None else self.logs[self.times[at]] * self.idf[self.feature[at]]

    def _index(self) -> None:
        """Matrix of the most frequent features, lists of the others; made from a few hundred examples at a time."""
        n, v = len(self.labels), len(self.idf)
        if self.codes is not None:
            self._read_codes()
        parts = [(e, min(e + CHUNK, n)) for e in range(0, n, CHUNK)]
        self.logs = None if self.times is None else np.concatenate(([0.0], 1 + np.log(np.arange(1, 1 + int(self.times.max(initial=0))))))
        self.df = sum((np.bincount(self.feature[self.first[a] : self.first[b]], minlength=v) for a, b in parts), np.zeros(v, dtype=np.int64))
        often = np.argsort(-self.df, kind="stable")[:HEAD]
        self.place = np.full(v, -1, dtype=np.int32)
        self.place[often] = np.arange(len(often))
        rare = np.where(self.place < 0, self.df, 0)
        self.at = np.concatenate(([0], np.cumsum(rare)))
        self.norm, self.scratch = np.ones(n), np.zeros(v)
        head = np.zeros((n, len(often)), dtype=np.float16)  # for the order only
        for a, b in parts:
            span = slice(self.first[a], self.first[b])
            fs, ws, own = self.feature[span], self._weights(span), np.repeat(np.arange(a, b), np.diff(self.first[a : b + 1]))
            if self.times is not None:
                self.norm[a:b] = np.sqrt(np.bincount(own - a, weights=ws * ws, minlength=b - a))
                ws = ws / self.norm[own]
            column = self.place[fs]
            head[own[column >= 0], column[column >= 0]] = ws[column >= 0]
        self.order = _likeness(head)
        spot = np.empty(n, dtype=np.int64)
        spot[self.order] = np.arange(n)
        blocks = -(-n // BLOCK)
        del head
        self.head = np.zeros((blocks, BLOCK, len(often)), dtype=np.float32)
        flat = self.head.reshape(blocks * BLOCK, len(often))
        self.spot = spot
        # a posting is the example's spot and, in the upper half, the bits of its weight (never negative)
        self.posting = np.zeros(self.at[-1], dtype=np.int64)
        self.buffer = np.zeros(max(READ, int(rare.max(initial=0))), dtype=np.int64)
        free = self.at[:-1].copy()
        for a, b in parts:
            span = slice(self.first[a], self.first[b])
            fs, own = self.feature[span], np.repeat(np.arange(a, b), np.diff(self.first[a : b + 1]))
            column, ws = self.place[fs], (self._weights(span) / self.norm[own]).astype(np.float32)
            flat[spot[own[column >= 0]], column[column >= 0]] = ws[column >= 0]
            rest = np.flatnonzero(column < 0)
            rest = rest[np.argsort(fs[rest], kind="stable")]
            ws = ws[rest]
            kinds, begin, sizes = np.unique(fs[rest], return_index=True, return_counts=True)
            to = np.arange(len(rest)) + np.repeat(free[kinds] - begin, sizes)
            self.posting[to] = ws.view(np.uint32).astype(np.int64) << 32 | spot[own[rest]]
            free[kinds] += sizes
        self.top = self.head.max(axis=1) if blocks else np.zeros((0, len(often)), dtype=np.float32)

    def example_vector(self, e: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.first[e], self.first[e + 1])
        return self.feature[span], self._weights(span) / self.norm[e]

    def occurrences(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers in order, and how often each occurs."""
        if self.starts is None:
            self.starts, self.beginnings = _starts(self.vocab), _Beginnings(self.vocab)
        return _occurrences(counts, self.vocab, self.starts, self.beginnings)

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector over the vocabulary: feature numbers in order, and weights."""
        return self.weighted(*self.occurrences(counts))

    def weighted(self, fs: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ws = (1 + np.log(ns)) * self.idf[fs]
        return fs, ws / np.sqrt((ws * ws).sum()) if len(fs) else ws

    def search(self, fs: np.ndarray, ws: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine (ties: smaller number first), exactly."""
        return self.search_all([(fs, ws)], k, [without])[0]

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.at is None:
            self._index()
        n, blocks = len(self.labels), len(self.head)
        if not n or not queries:
            return [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(queries)
        rows = np.zeros((len(queries), self.head.shape[2]), dtype=np.float32)
        about = np.zeros((len(queries), blocks * BLOCK), dtype=np.float32)
        for row, near, (fs, ws), skip in zip(rows, about, queries, without, strict=True):
            own, begin, size = self.place[fs], self.at[fs], self.df[fs]
            row[own[own >= 0]] = ws[own >= 0]
            lists = np.flatnonzero((own < 0) & (size > 0))
            if len(lists):
                self._add_rare(near, begin[lists], size[lists], ws[lists])
            near[n:] = -4.0
            if skip >= 0:
                near[self.spot[skip]] = -4.0
        enough = self._add_head(rows, about, k)
        out = []
        for near, low, (fs, ws) in zip(about, enough.tolist(), queries, strict=True):
            some = np.flatnonzero(near[:n] >= low - MARGIN)
            sums = near[some]
            least = float(np.partition(sums, len(sums) - k)[len(sums) - k]) - MARGIN if len(sums) > k else 0.0
            some = np.sort(self.order[some[sums >= least if least > 0 else sums > 0]])
            if not len(some):
                out.append((some, np.zeros(0)))
                continue
            self.scratch[fs] = ws
            sizes = self.first[some + 1] - self.first[some]
            heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            at = np.repeat(self.first[some] - heads, sizes) + np.arange(int(sizes.sum()))
            terms = self.scratch[self.feature[at]]
            both = np.flatnonzero(terms)
            terms[both] *= self._weights(at[both])
            exact = np.add.reduceat(terms, heads) / self.norm[some]
            self.scratch[fs] = 0
            top = np.lexsort((some, -exact))[:k]
            out.append((some[top], exact[top]))
        return out

    def _add_rare(self, near: np.ndarray, begin: np.ndarray, size: np.ndarray, ws: np.ndarray) -> None:
        """Add the cosines' part from rare features, whose lists are read through a buffer that stays in the cache."""
        ends, done = np.cumsum(size), 0
        spans = list(zip(begin.tolist(), (begin + size).tolist(), strict=True))
        while done < len(spans):
            before = int(ends[done - 1]) if done else 0
            to = max(done + 1, int(np.searchsorted(ends, before + READ, "right")))
            found = np.concatenate([self.posting[a:b] for a, b in spans[done:to]], out=self.buffer[: int(ends[to - 1]) - before])
            weights = np.repeat(ws[done:to], size[done:to])
            weights *= found.view(np.float32)[_UPPER::2]
            found &= 0xFFFFFFFF
            near += np.bincount(found, weights=weights, minlength=len(near))
            done = to

    def _add_head(self, rows: np.ndarray, about: np.ndarray, k: int) -> np.ndarray:
        """Add the cosines' part from frequent features, of those blocks that may hold one of the k nearest.

        Returns a bound for each row that its k-th best cosine reaches.
        """
        cells = about.reshape(len(about), -1, BLOCK)
        bound = rows @ self.top.T + cells.max(axis=2) + MARGIN
        todo = np.argsort(-bound, axis=1, kind="stable")
        done, least = 0, np.full(len(rows), -np.inf)
        for width in (*ROUNDS, bound.shape[1]):
            part = todo[:, done : done + width]
            q, at = np.nonzero(np.take_along_axis(bound, part, axis=1) >= least[:, None])
            block = part[q, at]
            by = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[by], prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own, j = q[by[a:b]], block[by[a]]
                cells[own, j] += rows[own] @ self.head[j].T
            self.read += len(block)
            done += width
            if done >= bound.shape[1]:
                break
            best = np.take_along_axis(cells, todo[:, :done, None], axis=1).reshape(len(rows), -1)
            if best.shape[1] > k:  # no sum so far is more than its cosine
                least = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k]
        self.seen += bound.size
        return least

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Similarity-weighted share of label 1 among the neighbours, shrunk by one blank vote, and the neighbours."""
        out, prior = [], 0.05
        for best, score in self.search_all(queries, NEIGHBOURS, without or [-1] * len(queries)):
            w = score * score
            out.append((float((w @ self.labels[best] + prior * self.blank) / (w.sum() + prior)), best, score))
        return out

    def left_out(self, examples: list[int]) -> list[float]:
        """Votes on examples as if they were no examples: words of their own only are unknown then."""
        if self.at is None:
            self._index()
        queries = []
        for e in examples:
            fs, ws = self.example_vector(e)
            known = self.df[fs] > 1
            fs, ws = fs[known], ws[known]
            queries.append((fs, ws / np.sqrt((ws * ws).sum()) if len(fs) else ws))
        return [v for at in range(0, len(queries), QUERIES) for v, _, _ in self.votes(queries[at : at + QUERIES], examples[at : at + QUERIES])]

    def calibrate(self, pairs: list[tuple[float, float]]) -> None:
        """Isotonic regression of labels on leave-one-out votes (pool adjacent violators)."""
        pools: list[list[float]] = []
        for x, y in sorted(pairs):
            pools.append([y, 1.0, x])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                y2, n2, _ = pools.pop()
                pools[-1][0] += y2
                pools[-1][1] += n2
        if pools:
            self.steps = (np.array([p[2] for p in pools]), np.array([(p[0] + 0.5 * self.blank) / (p[1] + 0.5) for p in pools]))

    def scores(self, keys: list[bytes], vector_of) -> list[tuple[float, list[tuple[int, float]]]]:
        """Score and three nearest examples for each key; ``vector_of`` gives the unit vector of one of them."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        vectors = {key: vector_of(at) for at, key in enumerate(keys) if key not in self.cache}
        self.cache.update((key, (self.blank, [])) for key, (fs, _) in vectors.items() if not len(fs))
        full = [key for key, (fs, _) in vectors.items() if len(fs)]
        for key, (raw, best, sims) in zip(full, self.votes([vectors[key] for key in full]), strict=True):
            if len(self.steps[0]):
                raw = float(self.steps[1][max(0, int(np.searchsorted(self.steps[0], raw, "right")) - 1)])
            self.cache[key] = min(1.0, max(0.0, raw)), list(zip(best[:3].tolist(), sims[:3].tolist(), strict=True))
        return [self.cache[key] for key in keys]

    def stream(self, texts: Iterator[bytes | None]) -> Iterator[tuple[float, list[tuple[int, float]]]]:
        """Scores of texts, a few at a time."""
        texts = iter(texts)
        while part := list(islice(texts, QUERIES)):
            yield from self.scores([xxhash.xxh3_128_digest(x or b"") for x in part], lambda at, part=part: self.vector(features(part[at])))

    def stream_codes(self, codes: Iterator[bytes]) -> Iterator[tuple[float, list[tuple[int, float]]]]:
        """Scores of coded texts, a few at a time."""
        codes = iter(codes)
        while part := list(islice(codes, QUERIES)):
            yield from self.scores([xxhash.xxh3_128_digest(x) for x in part], lambda at, part=part: self.weighted(*_decode(part[at])))


def held_out(column) -> F.Column:
    """True for rows that are never learnt from: crc32 of the id as text leaves 0 modulo 5, or no id."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, n_toxic, n_clean) over the sample's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(both), pa.binary()), *(pa.array([v[i] for v in both.values()], pa.int64()) for i in (1, 0))], ["feature", "n_toxic", "n_clean"])
            both.clear()
            return out

        for batch in batches:
            for data, toxic in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for f in {x for w in features(data) for x in expand(w)}:
                    both.setdefault(f, [0, 0])[toxic] += 1
                if len(both) > FLUSH:
                    yield flush()
        yield flush()

    parts = sample.select("text", "toxic").mapInArrow(run, "feature binary, n_toxic long, n_clean long")
    return parts.groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def _vocabulary(counts: DataFrame, n_toxic: int, n_clean: int) -> tuple[tuple, np.ndarray]:
    """All words, and the beginnings with evidence, packed; and the share of the full weight that each has.

    The most frequent come first, so that what most texts look up lies close together in memory.
    """
    a, c = F.col("n_toxic").cast("double"), F.col("n_clean").cast("double")
    rate = (a + c) / F.lit(float(n_toxic + n_clean))
    part = lambda x, n: F.when(x > 0, x * F.ln(x / (F.lit(float(n)) * n_of))).otherwise(0.0)
    n_of = rate
    absent = 1 - rate
    off = lambda x, n: F.when(F.lit(float(n)) > x, (F.lit(float(n)) - x) * F.ln((F.lit(float(n)) - x) / (F.lit(float(n)) * absent))).otherwise(0.0)
    ratio = 2 * (part(a, n_toxic) + part(c, n_clean) + off(a, n_toxic) + off(c, n_clean))
    for_toxic = (a * float(n_clean) > c * float(n_toxic)) & (rate < 1)
    rows = counts.select("feature", (F.col("n_toxic") + F.col("n_clean")).alias("n"), F.when(for_toxic, ratio).otherwise(0.0).alias("g2"))
    word = F.substring(F.col("feature"), 1, 1) != F.lit(b"^")
    found = rows.filter(word | (F.col("g2") >= MIN_EVIDENCE)).toArrow().sort_by([("n", "descending"), ("feature", "ascending")])
    names, g2 = found["feature"].combine_chunks(), found["g2"].to_numpy()
    share = g2 * g2 / (g2 * g2 + MIN_EVIDENCE**2)
    plain = np.where(pc.starts_with(names, b"^").to_numpy(zero_copy_only=False), 0.0, PLAIN)
    return _packed(names), plain + (1 - plain) * share


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that neither side holds many texts twice."""
    for batch in batches:
        yield from (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))


def _coded(docs: DataFrame, shared, columns: tuple, code: str = "code") -> DataFrame:
    """``columns`` of ``docs``, and the features of every text, in the vocabulary of a ``shared`` model, in a binary column ``code`` (empty where a text has none)."""
    own, at = [docs.columns.index(c) for c in columns], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in _slices(batches):
            codes = [_code(*m.occurrences(features(x))) for x in utf8(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), pa.array(codes, pa.binary())], [*columns, code])

    return docs.mapInArrow(run, StructType([*(docs.schema.fields[i] for i in own), StructField(code, BinaryType())]))


def _document_frequency(coded: DataFrame, code: str, size: int) -> tuple[np.ndarray, int]:
    """In how many of all documents each of ``size`` features occurs, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, dtype=np.int64)
        pending, held = [], 0
        for batch in batches:
            df[-1] += batch.num_rows
            for code in batch.column(0):
                fs, _ = _decode(code.as_py())
                pending.append(fs)
                held += len(fs)
                if held > PENDING:
                    df += np.bincount(np.concatenate(pending), minlength=len(df))
                    pending, held = [], 0
        if pending:
            df += np.bincount(np.concatenate(pending), minlength=len(df))
        at = np.flatnonzero(df)
        for part in np.array_split(at, -(-len(at) // FLUSH)) if len(at) else ():
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(df[part])], ["feature", "n"])

    out = np.zeros(size + 1, dtype=np.int64)
    found = coded.select(code).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out[found["feature"].to_numpy()] = found["n"].to_numpy()
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """Fit on at most ``max_examples`` labelled rows that are not held out (those of least id hash).

    Ids may be of any type; rows without id or label are never learnt from.  A doc_id labelled
    more than once counts as toxic if any of its rows says so; one with several texts gives the
    least of them.  Examples of equal text and label count once.  Null and empty texts count as
    texts without words; long ones are read whole.  Without usable labels, or with empty
    tables, every score is 0.  Other columns are ignored, whatever their names.
    """
    model, _, shared = _fit(docs, labels, max_examples)
    shared.destroy()
    return model


def _fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, columns: tuple = ("doc_id",), code: str = "code") -> tuple:
    """The model; the coded documents that its frequencies were counted on: ``columns``, and ``code``; and the model as sent, but for its ``steps``."""
    spark = docs.sparkSession
    one_thread_a_task(spark)
    small_batches(spark)
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples).select(F.col("doc_id").alias("label_id"), "toxic").toArrow()
    if not chosen.num_rows:
        none = Model({}, np.zeros(0), np.zeros(0), [], [])
        shared = spark.sparkContext.broadcast(none)
        return none, _coded(docs, shared, columns, code), shared
    # at most max_examples rows, so that they may be broadcast; Arrow tables take no Python workers, as lists would
    ids = spark.createDataFrame(chosen)
    base = docs.select("doc_id", "text")
    sample = settle(base.join(F.broadcast(ids), base["doc_id"] == ids["label_id"]).select("doc_id", "text", "toxic"))

    # equal texts (by SHA-256) of one label count once: the row of least doc_id
    kept = sample.groupBy(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), "toxic").agg(F.min("doc_id").alias("kept_id")).select("kept_id").toArrow()
    keep = spark.createDataFrame(kept)
    least = sample.join(F.broadcast(keep), sample["doc_id"] == keep["kept_id"], "left_semi").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = settle(least.select("doc_id", "text", "toxic"))
    totals = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    names, share = _vocabulary(_counts(sample), n_toxic, n_clean)
    shared = spark.sparkContext.broadcast(Model(names, np.zeros(0), np.zeros(0), [], []))
    wanted = docs if "text" in columns else docs.select("doc_id", "text")
    coded = store(_coded(wanted, shared, columns, code), "toxicity-codes")
    df, n_docs = _document_frequency(coded, code, len(share))
    rows = _coded(sample, shared, ("doc_id", "toxic")).toArrow().sort_by("doc_id")
    shared.destroy()
    ids, toxic, codes = (rows[x].to_pylist() for x in ("doc_id", "toxic", "code"))
    blank = [y for y, x in zip(toxic, codes, strict=True) if not x]
    full = [e for e, x in enumerate(codes) if x]
    model = Model(names, (np.log((1 + n_docs) / (1 + df)) + 1) * share, np.zeros(0), [], [], blank=(sum(blank) + 0.1) / (len(blank) + 1))
    model.learn([toxic[e] for e in full], [ids[e] for e in full], [codes[e] for e in full])
    del rows, codes
    shared = spark.sparkContext.broadcast(model)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.left_out(b.column(0).to_pylist()), pa.float64())], ["e", "vote"])

    n = len(full)
    spread = np.unique(np.linspace(0, n - 1, min(MAX_CALIBRATION, n)).astype(int)).tolist() if n else []
    if spread:
        chosen = spark.createDataFrame(pa.table({"e": pa.array(spread, pa.int64())}))
        model.calibrate([(r["vote"], float(model.labels[r["e"]])) for r in chosen.mapInArrow(left_out, "e long, vote double").collect()])
    return model, coded, shared


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and evidence (up to three nearest examples) of every row.

    Null and empty texts, and texts without any word of the examples, get the share of label 1
    among such examples.  Long texts are read whole, repeated rows are scored each, ids may be
    null and of any type.  Columns other than doc_id and text are ignored.
    """
    return _scored(docs.select("doc_id", "text"), docs.sparkSession.sparkContext.broadcast(model), model.steps, Model.stream)


def _scored(base: DataFrame, shared, steps: tuple, stream) -> DataFrame:
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        m.steps = steps
        for batch in batches:
            evidence = pa.list_(pa.struct([("doc_id", batch.column(0).type), ("similarity", pa.float64()), ("toxic", pa.int32())]))
            got = list(stream(m, utf8(batch.column(1))))
            near = [[{"doc_id": m.ids[e], "similarity": s, "toxic": int(m.labels[e])} for e, s in x] for _, x in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= 0.5) for s, _ in got], pa.int32()), pa.array(near, evidence)],
                ["doc_id", "score", "predicted", "evidence"],
            )

    return base.mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id:{kind},similarity:double,toxic:int>>")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """Documents that are not predicted toxic; all columns and rows otherwise as they are.

    Null, empty and long texts and repeated rows are scored as ``score`` does, each row by its text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([x < 0.5 for x, _ in shared.value.stream(utf8(batch.column(at)))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that a model of their own, fitted on ``labels``, does not predict toxic; all columns and rows otherwise as they are.

    The same as ``drop_toxic`` with ``fit``, but texts are looked up once, and what scores them holds no vocabulary.
    """
    code = free_name("code", docs.columns)
    model, coded, shared = _fit(docs, labels, columns=tuple(docs.columns), code=code)
    steps, n = model.steps, len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        m.steps = steps  # its lists are there since the calibration
        for batch in _slices(batches):
            good = [x < 0.5 for x, _ in m.stream_codes(utf8(batch.column(n)))]
            yield batch.select(list(range(n))).filter(pa.array(good, pa.bool_()))

    return coded.mapInArrow(run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, coded, shared = _fit(docs, table(spark, sf_dir, "labels"))
    return _scored(coded, shared, model.steps, Model.stream_codes).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
