"""Benchmark decontamination with a generalised suffix automaton.

All benchmark items become one suffix automaton over word ids.  Document words stream
through it; the state holds the longest suffix of the words read so far that occurs in some
item.  A state whose match reaches ``window`` words names, through its suffix-link ancestor
of that length, every item that holds the window.

Only stretches in which every pair of neighbouring words also neighbours in some item can
hold a match of two words or more, so the automaton steps through those stretches alone.
The pair test is a hashed bit table: it may let a stretch through, never hold one back.

Scale: documents are never shuffled.  The benchmark is cut into pieces of about
``MAX_AUTOMATON_WORDS`` words.  A task builds the automaton of each; driver and workers hold one
at a time.  A benchmark of one piece (the usual case) is one pass over the documents; each
further piece is a further pass, between which documents and what was found in them are kept
in the shared folder.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tailspark.llm.common import free_name, settle, store, table, utf8, words

WINDOW = 13
#: A document is contaminated when hits make up at least one word in so many.
COVERAGE = 20
MAX_AUTOMATON_WORDS = 100_000
_TABLE_BITS = 22
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """Generalised suffix automaton of items, each a list of words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = []
        for item, ws in items:
            if ws:
                ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws]
                coded.append((item, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.shortest = min([window, *(len(ids) for _, ids in coded)])
        #: Items by the state that stands for a window; short items by the state that is the whole item.
        self.items: dict[int, set[str]] = {}
        self.whole: dict[int, tuple[int, set[str]]] = {}
        self.pairs = np.zeros(1 << _TABLE_BITS, dtype=bool)
        for item, ids in coded:
            a = np.array(ids, dtype=np.int64)
            self.pairs[self._slot(a[:-1], a[1:])] = True
            state = 0
            for k, c in enumerate(ids):
                state = self.next[state][c]
                if k + 1 >= window:
                    self.items.setdefault(self._window_state(state), set()).add(item)
            if len(ids) < window:
                self.whole.setdefault(state, (len(ids), set()))[1].add(item)
        self.nearest = self._nearest()

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _nearest(self) -> list[int]:
        """For each state the nearest of itself and its suffix-link ancestors that is a whole short item, or -1."""
        out = [-1] * len(self.next)
        if self.whole:
            for s in sorted(range(len(self.next)), key=self.length.__getitem__):
                out[s] = s if s in self.whole else out[self.link[s]] if s else -1
        return out

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 7_919) & ((1 << _TABLE_BITS) - 1)

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Half-open ranges of words outside of which no match of the shortest wanted length can lie."""
        need = self.shortest
        if len(ids) < need or not self.vocab:
            return []
        ok = (ids[:-1] > 0) & (ids[1:] > 0) & self.pairs[self._slot(ids[:-1], ids[1:])] if need > 1 else ids > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        extra = 1 if need > 1 else 0
        return [(int(s), int(e) + extra) for s, e in zip(edge[::2], edge[1::2], strict=True) if e - s + extra >= need]

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit word ranges (half-open, disjoint, in order), the items found, and the longest match."""
        ids = np.fromiter(map(self.vocab.get, ws, repeat(0)), dtype=np.int64, count=len(ws))
        hits: list[tuple[int, int]] = []
        found: set[str] = set()
        longest = 0
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for start, end in self.stretches(ids):
            state = n = 0
            for i, c in enumerate(ids[start:end].tolist(), start):
                while state and c not in nxt[state]:
                    state = link[state]
                    n = length[state]
                if c in nxt[state]:
                    state = nxt[state][c]
                    n += 1
                else:
                    n = 0
                longest = max(longest, n)
                if n >= window:
                    found |= self.items[self._window_state(state)]
                    hits.append((i + 1 - n, i + 1))
                t = self.nearest[state] if state else -1
                while t >= 0:
                    size, items = self.whole[t]
                    if size <= n:
                        found |= items
                        hits.append((i + 1 - size, i + 1))
                    t = self.nearest[link[t]]
        return _merge(hits), found, longest


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def automata(benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_AUTOMATON_WORDS) -> tuple[DataFrame, list[int]]:
    """Pickled automata (piece, automaton) over the benchmark, each of about ``max_words`` words, and the pieces' numbers."""
    text = F.encode("text", "UTF-8")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), text.alias("text")).filter("item IS NOT NULL AND text IS NOT NULL").distinct()
    size = F.size(F.split(F.decode("text", "UTF-8"), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    total = items.agg(F.sum(size)).first()[0] or 0
    cut = items.withColumn("piece", F.pmod(F.xxhash64("item", "text"), F.lit(max(1, -(-total // max_words)))))

    def build(rows: pa.Table) -> pa.Table:
        both = sorted(zip(rows["item"].to_pylist(), rows["text"].to_pylist(), strict=True))
        made = SuffixAutomaton([(item, words(t)) for item, t in both], window)
        return pa.table({"piece": [rows["piece"][0].as_py()], "automaton": pa.array([pickle.dumps(made)], pa.binary())})

    built = settle(cut.groupBy("piece").applyInArrow(build, "piece long, automaton binary"))
    return built, sorted(r["piece"] for r in built.select("piece").collect())


#: What is found in a text: hit word ranges, disjoint and in order; items; the longest match; the number of words.
_FOUND = pa.struct([("hits", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("n_words", pa.int64())])
_FOUND_DDL = "struct<hits:array<array<bigint>>,items:array<string>,longest:bigint,n_words:bigint>"


def _passes(docs: DataFrame, made: tuple[DataFrame, list[int]], finish: Callable, schema: StructType) -> DataFrame:
    """``finish(batch, found, scan)`` of all rows, with what all automata find in their texts; ``scan`` is the last one's."""
    spark = docs.sparkSession
    built, pieces = made
    names = docs.columns
    at, extra, n = names.index("text"), free_name("found", names), len(names)

    def step(number: int, last: bool):
        blob = built.filter(F.col("piece") == pieces[number]).first()["automaton"] if pieces else pickle.dumps(SuffixAutomaton([]))
        shared, key = spark.sparkContext.broadcast(bytes(blob)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = _automaton(key, shared).scan
            for batch in batches:
                before = batch.column(batch.num_columns - 1).to_pylist() if number else [None] * batch.num_rows
                found = []
                for data, old in zip(utf8(batch.column(at)), before, strict=True):
                    ws = words(data)
                    hits, items, longest = scan(ws)
                    if old:
                        hits, items, longest = _merge([*hits, *map(tuple, old["hits"])]), items | set(old["items"]), max(longest, old["longest"])
                    found.append({"hits": hits, "items": sorted(items), "longest": longest, "n_words": len(ws)})
                if last:
                    yield finish(batch.select(list(range(n))), found, scan)
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, _FOUND)], [*names, extra])

        return run

    kind = StructType([*docs.schema.fields, StructField(extra, StructType.fromDDL(f"x {_FOUND_DDL}")["x"].dataType)])
    now = docs
    for k in range(len(pieces) - 1):
        now = store(now.mapInArrow(step(k, False), kind), "decontamination")
    return now.mapInArrow(step(max(0, len(pieces) - 1), True), schema)


_HELD: dict[str, SuffixAutomaton] = {}


def _automaton(key: str, shared) -> SuffixAutomaton:
    """The automaton of a broadcast, unpickled once a worker; a worker holds one at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = pickle.loads(shared.value)
    return _HELD[key]


_SCHEMA = (
    "n_words long, n_hit long, longest long, n_items long, items_sha256 string, contaminated boolean, "
    "item_ids array<string>, hits array<struct<start:long,end:long>>"
)


def _covered(found: dict, coverage: int = COVERAGE) -> tuple[int, bool]:
    """Hit words, and whether they are at least one word in ``coverage``."""
    n_hit = sum(e - s for s, e in found["hits"])
    return n_hit, n_hit > 0 and coverage * n_hit >= found["n_words"]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_AUTOMATON_WORDS) -> DataFrame:
    """Find benchmark passages in documents.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` needs ``item_id`` and ``text``;
    other columns of either are ignored, whatever their names.  One row per document row
    (repeated rows stay): doc_id, word counts, hit word ranges, items, and the verdict
    (any hit, and hits of at least one word in ``COVERAGE``).  Null or empty text has no
    words and no hit; long texts are read whole.  Repeated items count once; items of no words
    and items without id match nothing; an empty benchmark finds nothing.
    """
    base = docs.select("doc_id", "text")
    kinds = {"items_sha256": pa.string(), "contaminated": pa.bool_(), "item_ids": pa.list_(pa.string()), "hits": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    names = ("n_words", "n_hit", "longest", "n_items", "items_sha256", "contaminated", "item_ids", "hits")

    def finish(batch: pa.RecordBatch, found: list[dict], _) -> pa.RecordBatch:
        rows = []
        for x in found:
            n_hit, bad = _covered(x)
            digest = hashlib.sha256(",".join(x["items"]).encode()).hexdigest()
            rows.append((x["n_words"], n_hit, x["longest"], len(x["items"]), digest, bad, x["items"], [{"start": s, "end": e} for s, e in x["hits"]]))
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds.get(n, pa.int64())) for n, v in zip(names, cols, strict=True))], ["doc_id", *names])

    schema = StructType([base.schema["doc_id"], *StructType.fromDDL(_SCHEMA).fields])
    return _passes(base, automata(benchmark, window, max_words), finish, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int | None = None, max_words: int = MAX_AUTOMATON_WORDS) -> DataFrame:
    """Documents without benchmark contamination; all columns of ``docs`` stay.

    Documents whose hits reach ``COVERAGE`` are removed.  With ``max_span``, hit spans of more
    than that many words are also cut from the text of the documents that stay (a cut leaves
    one space), again and again until none is left; ``n_chars``, where there is one, follows the
    text.  Other documents are left alone.  Null and empty texts stay, repeated rows are judged
    each, long texts are read whole; an empty benchmark removes nothing.
    """
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    mark = free_name("cut", docs.columns)

    def finish(batch: pa.RecordBatch, found: list[dict], scan, limit: int = COVERAGE) -> pa.RecordBatch:
        keep = [not _covered(x, limit)[1] for x in found]
        changed = {}
        for k, x in enumerate(found):
            hits = x["hits"]
            if keep[k] and max_span is not None and any(e - s > max_span for s, e in hits):
                text = batch.column(at)[k].as_py()
                while long := [h for h in hits if h[1] - h[0] > max_span]:
                    text = _cut(text, long)
                    hits = scan(words(text.encode()))[0]
                changed[k] = text
        if changed:
            text = batch.column(at).to_pylist()
            for k, t in changed.items():
                text[k] = t
            batch = batch.set_column(at, batch.schema.field(at), pa.array(text, batch.schema.field(at).type))
            if size is not None:
                chars = [len(changed[k]) if k in changed else n for k, n in enumerate(batch.column(size).to_pylist())]
                batch = batch.set_column(size, batch.schema.field(size), pa.array(chars, batch.schema.field(size).type))
        batch = batch.append_column(mark, pa.array([k in changed for k in range(len(keep))], pa.bool_()))
        return batch.filter(pa.array(keep, pa.bool_()))

    schema = StructType([*docs.schema.fields, StructField(mark, BooleanType())])
    made = automata(benchmark, window, max_words)
    plain = [F.col(f"`{c}`") for c in docs.columns]
    if max_span is None or len(made[1]) < 2:
        return _passes(docs, made, finish, schema).select(*plain)
    kept = []  # of several pieces, a cut may bring words of another one together: what was cut is looked at again
    while True:
        out = store(_passes(docs, made, finish if not kept else partial(finish, limit=0), schema), "decontamination")  # documents are judged as they came
        kept.append(out.filter(~F.col(f"`{mark}`")).select(*plain))
        docs = out.filter(F.col(f"`{mark}`")).select(*plain)
        if not docs.limit(1).count():
            return reduce(DataFrame.unionAll, kept)


def _cut(text: str, ranges: list[tuple[int, int]]) -> str:
    lowered = text.translate({c: c + 32 for c in range(65, 91)})
    spans = [m.span() for m in _WORD.finditer(lowered)]
    out, at = [], 0
    for s, e in ranges:
        out.append(text[at : spans[s][0]].rstrip())
        at = spans[e - 1][1]
    out.append(text[at:].lstrip() if out else text[at:])
    return " ".join(x for x in out if x)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
