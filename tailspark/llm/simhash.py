"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is a set of eight (position, byte) items.  Fingerprints that differ in
at most four bits share at least four of their eight items, so four shared items is the
guaranteed minimum the count filter asks for.  Posting lists of single items would hold
1/256 of all fingerprints each.  The index therefore posts *triples* of positional bytes,
and only the triples of a Turan system: 20 triples of positions such that any four positions
contain one of them.  Every pair with four shared items meets in a posting list, lists hold
1/2^24 of unrelated fingerprints, and the tally of shared items is a popcount on the pair.

Scale: equal fingerprints are one entry (exact copies never meet in a list); a pair is emitted
only from the first triple it shares and only after verification, so the join's rows are the
true links.  A fingerprint has at most 679,120 others within four bits, whatever the size of
the corpus.  Lists of hot keys are split by the adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tailspark.llm.common import LOWER_TABLE, settle, table, utf8

SHINGLE = 4
SEED = 42
MAX_BITS = 4
MIN_SHARED = 8 - MAX_BITS


def turan_triples(n: int = 8) -> list[tuple[int, int, int]]:
    """Triples of ``range(n)`` of which every four elements contain one (Turan's three-part design)."""
    part = [i % 3 for i in range(n)]
    out = []
    for t in combinations(range(n), 3):
        count = [sum(part[i] == p for i in t) for p in range(3)]
        if 3 in count or any(count[p] == 2 and count[(p + 1) % 3] == 1 for p in range(3)):
            out.append(t)
    return out


TRIPLES = turan_triples()
#: By mask of equal byte positions: the first triple within it, -1 if none.
FIRST = [next((k for k, t in enumerate(TRIPLES) if all(m >> i & 1 for i in t)), -1) for m in range(256)]


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of whole text: majority bits of the XXH64 values of its word shingles, repeats included."""
    ws = data.translate(LOWER_TABLE).split() if data else []
    if not ws:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(ws) <= shingle:
        hashes = [digest(b" ".join(ws), SEED)]
    else:
        flat = b" ".join(ws)
        ends = np.cumsum(np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(ws) - shingle + 1
        hashes = [digest(flat[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, dtype=np.int64)
    h = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    for k in range(0, len(h), 16_384):
        counts += np.unpackbits(h[k : k + 16_384], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint as a signed 64-bit integer) of every row; null text has fingerprint 0."""
    base = docs.select("doc_id", "text")
    id_type = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x, shingle) for x in utf8(batch.column(1))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return base.mapInArrow(run, f"doc_id {id_type}, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints ``fp`` within ``MAX_BITS`` bits, each once."""

    def byte(col, i):
        return F.shiftrightunsigned(col, 8 * i).bitwiseAND(F.lit(255))

    def keys(name):
        triples = [
            byte(F.col("fp"), i) + F.shiftleft(byte(F.col("fp"), j), 8) + F.shiftleft(byte(F.col("fp"), k), 16) + F.lit(n << 24)
            for n, (i, j, k) in enumerate(TRIPLES)
        ]
        return distinct.select(F.col("fp").alias(name), F.explode(F.array(*triples)).alias("post"))

    a, b = keys("a"), keys("b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    mask = sum((F.when(byte(x, i) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(8)), F.lit(0))
    met = a.join(b, (a["post"] == b["post"]) & (F.col("a") < F.col("b"))).select("a", "b", a["post"].alias("post"), mask.alias("mask"))
    # a pair counts once, in the list of the first triple that it shares
    first = F.element_at(F.array(*map(F.lit, FIRST)), F.col("mask") + 1) == F.shiftrightunsigned("post", 24).cast("int")
    tallied = met.filter(first).select("a", "b", F.bit_count("mask").alias("tally"))
    retained = tallied.filter(F.col("tally") >= MIN_SHARED)
    return retained.filter(F.bit_count(x) <= MAX_BITS).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the pointers to their
    roots by doubling, and contracts the edges to edges between roots.  Edges within a root
    go, so the work of later rounds shrinks at least by half each time.
    """
    edges = settle(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = None
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")))
        while True:
            far = up.select(F.col("node").alias("via"), F.col("root").alias("far"))
            step = settle(up.join(far, up["root"] == far["via"]).select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
            up = step.select("node", "root")
            if not step.filter("moved").limit(1).count():
                break
        here = up.select(F.col("node").alias("at"), F.col("root").alias("to"))
        known = up if known is None else settle(known.join(here, known["root"] == here["at"], "left").select("node", F.coalesce("to", "root").alias("root")))
        left = edges.join(here, edges["a"] == here["at"]).select(F.col("to").alias("a"), "b")
        other = up.select(F.col("node").alias("at2"), F.col("root").alias("to2"))
        joined = left.join(other, left["b"] == other["at2"]).select("a", F.col("to2").alias("b")).filter("a <> b")
        edges = settle(joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if known is None else known


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Near-duplicate classes of whole texts: doc_id, fp, component_id and n_links of its fingerprint.

    One row per document row.  Texts without words (null, empty, white space) have
    fingerprint 0 and link like any other.  component_id is the smallest non-null doc_id
    reachable over links, null if none has an id.  n_links counts other distinct
    fingerprints.  Columns other than doc_id and text are ignored; an empty table gives
    no rows.
    """
    prints = settle(fingerprints(docs, shingle))
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = settle(links(distinct.select("fp")))
    roots = components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    member = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "least", "root")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = member.join(least, "root").join(degree, F.col("fp") == degree["node"]).select("fp", "component_id", "n_links")
    alone = distinct.join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    classes = settle(linked.unionByName(alone).withColumnRenamed("fp", "own"))
    return prints.join(classes, F.col("fp") == F.col("own")).select("doc_id", "fp", "component_id", "n_links")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents of smallest doc_id in each near-duplicate class; rows without doc_id stay.

    All columns of ``docs`` are kept as they are.  Rows of one doc_id are judged each by its own
    text; those of equal fingerprint become one row, the least by all its columns.
    """
    classes = near_duplicates(docs, shingle)
    keep = classes.filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id"), F.col("fp").alias("kept_fp")).distinct()
    names, at = [*docs.columns, "__fp"], docs.columns.index("text")
    kind = StructType([*docs.schema.fields, StructField("__fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x, shingle) for x in utf8(batch.column(at))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names)

    named = docs.filter(F.col("doc_id").isNotNull()).mapInArrow(run, kind)
    kept = named.join(keep, (named["doc_id"] == keep["kept_id"]) & (named["__fp"] == keep["kept_fp"]), "left_semi")
    least = kept.groupBy("doc_id", "__fp").agg(F.min(F.struct(*(F.col(c) for c in docs.columns))).alias("row")).select("row.*")
    return least.unionByName(docs.filter(F.col("doc_id").isNull()))


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")
