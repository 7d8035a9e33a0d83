"""WARC fixity audit with Merkle trees.

Records are hashed with their headers.  A record's place in its file follows from its id alone,
so that a lost or added record moves no other one.  A tree per archive file hashes ordered
ranges of ``FANOUT`` places each, up to one root.  Two replicas are compared by their roots, and
only below differing nodes are the next ranges compared, down to single places; there records
are told apart as changed, missing or extra.

Scale: records of one place are aggregated (sums of digest words, which combine before the
shuffle), however often an id is repeated; a file has at most ``FILE_RECORDS`` places by number,
so a window or a node never gathers more than that; everything else is a join on (file, node).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailspark.llm.common import settle, table

FANOUT = 16
FILE_RECORDS = 1_024
LEVELS = 3  # FANOUT ** LEVELS >= FILE_RECORDS
_EOL = "\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record as text; its bytes are the text's UTF-8."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{_EOL}WARC-Type: response{_EOL}WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">{_EOL}WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"{_EOL}Content-Type: text/html{_EOL}Content-Length: "), F.octet_length(body).cast("string"),
        F.lit(f"{_EOL}{_EOL}"), body, F.lit(f"{_EOL}{_EOL}"),
    )


#: Files of records without a number are numbered below this, and so many.
_LOOSE, _LOOSE_FILES = -(1 << 60), 1 << 20


def leaves(pages: DataFrame) -> DataFrame:
    """file, node, page_id, loose, n_records, length and digest of every id: what one place of a file holds.

    Files take page numbers in runs of ``FILE_RECORDS``, a number's place in its run is its node.
    Records without a number are dealt to further files and places by their content, and told
    apart by it (``loose``).  Records that repeat an id share its place: their digest is that of
    the sums of all their digests' words, so that their order does not matter.
    """
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    number = F.col("page_id").cast("long")
    cut = pages.select(number.alias("page_id"), F.octet_length(text).cast("long").alias("length"), F.sha2(text.cast("binary"), 256).alias("digest"))
    spread = lambda salt, n: F.pmod(F.xxhash64("digest", F.lit(salt)), F.lit(n))
    placed = cut.select(
        F.coalesce(F.floor(F.col("page_id") / FILE_RECORDS), F.lit(_LOOSE) - spread(0, _LOOSE_FILES)).alias("file"),
        F.coalesce(F.pmod("page_id", F.lit(FILE_RECORDS)), spread(1, FILE_RECORDS)).alias("node"),
        "page_id", F.when(F.col("page_id").isNull(), F.col("digest")).alias("loose"), "length", "digest",
    )
    parts = [F.sum(F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")).cast("string") for k in range(8)]
    several = F.sha2(F.concat_ws(",", F.count("*").cast("string"), *parts).cast("binary"), 256)
    one = F.when(F.count("*") == 1, F.min("digest")).otherwise(several)
    return placed.groupBy("file", "node", "page_id", "loose").agg(F.count("*").alias("n_records"), F.sum("length").alias("length"), one.alias("digest"))


def places(records: DataFrame) -> DataFrame:
    """The leaves with ``position`` (their number in the file) and ``offset``, in order of place."""
    order = Window.partitionBy("file").orderBy("node", "loose")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return records.select("*", (F.row_number().over(order) - 1).cast("long").alias("position"), offset.alias("offset"))


def tree(records: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Nodes (file, node, digest) by level, places first and roots last; a node hashes its children in order of place."""

    def hashed(rows: DataFrame, key) -> DataFrame:
        children = F.array_sort(F.collect_list(F.struct(*(c for c in ("node", "loose", "digest") if c in rows.columns))))
        joined = F.array_join(F.transform(children, lambda c: c["digest"]), "")
        return rows.groupBy("file", key).agg(F.when(F.count("*") == 1, F.min("digest")).otherwise(F.sha2(joined.cast("binary"), 256)).alias("one"), F.sha2(joined.cast("binary"), 256).alias("digest"))

    at = hashed(records, F.col("node")).select("file", "node", F.col("one").alias("digest"))  # mostly one leaf a place
    out = [at]
    for _ in range(levels):
        at = hashed(at, F.floor(F.col("node") / FANOUT).alias("up")).select("file", F.col("up").alias("node"), "digest")
        out.append(at)
    return out


def differing(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """(file, node): the places that differ between two trees, found from the roots down."""
    suspect = None
    for a, b in zip(reversed(one), reversed(other), strict=True):
        if suspect is not None:
            branch = suspect.select(F.col("file").alias("f"), F.col("node").alias("up"))
            under = lambda t: t.join(branch, (t["file"] == F.col("f")) & (F.floor(t["node"] / FANOUT) == F.col("up")), "left_semi")  # noqa: B023, E731
            a, b = under(a), under(b)
        b = b.select(F.col("file").alias("file2"), F.col("node").alias("node2"), F.col("digest").alias("digest2"))
        pairs = a.join(b, (a["file"] == b["file2"]) & (a["node"] == b["node2"]), "full_outer")
        suspect = settle(pairs.filter(~F.col("digest").eqNullSafe(F.col("digest2"))).select(F.coalesce("file", "file2").alias("file"), F.coalesce("node", "node2").alias("node")))
    return suspect


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """Every id of ``pages`` with its place, and whether the replica holds the same bytes.

    Columns: page_id, file, position, offset, length, digest (of the first copy), n_records,
    status (same, changed, missing: not in the replica, extra: only there) and intact.  Extra
    ids come without position, offset, length and digest.  Records without id are told apart by
    their content, so they are missing or extra, never changed.  Repeated rows and ids are one
    row; null urls and bodies count as empty; long ones are hashed whole; empty tables give no
    rows; columns other than page_id, url and html are ignored.
    """
    first, second = settle(leaves(pages)), settle(leaves(replica))
    found = settle(differing(tree(first), tree(second)).select(F.col("file").alias("bad_file"), F.col("node").alias("bad_node")))
    below = lambda t: t.join(found, (t["file"] == F.col("bad_file")) & (t["node"] == F.col("bad_node")), "left_semi")
    theirs = below(second).select(F.col("file").alias("file2"), F.col("node").alias("node2"), F.col("page_id").alias("id2"), F.col("loose").alias("loose2"), F.col("n_records").alias("n2"), F.col("digest").alias("digest2"))
    mine = below(first).select("file", "node", "page_id", "loose", "digest")
    met = mine.join(theirs, (F.col("file") == F.col("file2")) & (F.col("node") == F.col("node2")) & F.col("page_id").eqNullSafe(F.col("id2")) & F.col("loose").eqNullSafe(F.col("loose2")), "full_outer")
    status = F.when(F.col("digest2").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    bad = settle(met.filter(~F.col("digest").eqNullSafe(F.col("digest2"))).select(F.coalesce("file", "file2").alias("f"), F.coalesce("node", "node2").alias("n"), F.coalesce("page_id", "id2").alias("i"), F.coalesce("loose", "loose2").alias("l"), "n2", status.alias("status")))
    placed = places(first)
    hurt = bad.filter("status <> 'extra'").drop("n2")
    held = placed.join(hurt, (placed["file"] == hurt["f"]) & (placed["node"] == hurt["n"]) & placed["page_id"].eqNullSafe(hurt["i"]) & placed["loose"].eqNullSafe(hurt["l"]), "left")
    held = held.select("page_id", "file", "position", "offset", "length", "digest", "n_records", F.coalesce("status", F.lit("same")).alias("status"))
    none = [F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ("position", "offset", "length", "digest")]
    more = bad.filter("status = 'extra'").select(F.col("i").alias("page_id"), F.col("f").alias("file"), *none, F.col("n2").alias("n_records"), "status")
    return held.unionByName(more).withColumn("intact", F.col("status") == "same")


def damaged(pages: DataFrame, one_in: int = 101) -> DataFrame:
    """A replica with one changed character in some pages, chosen by a checksum of page_id."""
    hit = F.coalesce(F.crc32(F.col("page_id").cast("string").cast("binary")) % one_in == 0, F.lit(False)) & (F.length("html") > 0)
    flipped = F.overlay("html", F.lit("\u0001"), F.floor(F.length("html") / 2) + 1)
    return pages.select("page_id", "url", F.when(hit, flipped).otherwise(F.col("html")).alias("html"))


def op7_warc_fixity(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages))
