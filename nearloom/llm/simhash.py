"""SimHash near-duplicates by multi-index hashing.

Norouzi, Punjani and Fleet, "Fast Search in Hamming Space with Multi-Index
Hashing" (2012).  A fingerprint is cut in segments and entered once in a table
per segment, under the segment's value.  Two fingerprints of at most r
differing bits have a segment in which they differ in few of them, so probes
enumerate that segment's small Hamming ball, fetch what the table holds under
each value, and verify complete distances.

A bucket of a table may hold a large family of near copies.  One with more
than ``LARGE`` members is split: its members are entered again under the
values of the segments of what is still free in them, and a probe that came
to it enumerates the balls of those within what is left of its r bits.  After
two such steps the key is the whole fingerprint, so no bucket stays large,
and nothing is dropped.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearloom.llm.components import components
from nearloom.llm.runtime import cut, ship, slices, stored

SEED = 42
SHINGLE = 3
SEGMENTS = 2
#: Members of a bucket that each probe is compared with; a larger one is split.
LARGE = 64
#: Buckets to be split that are few enough to be broadcast (24 bytes each).
FEW_BUCKETS = 50_000
#: Shingles whose bits are unpacked at once: bounds memory on very long texts.
CHUNK = 1 << 15


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text (unsigned); 0 for null or no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = zip(*(words[i:] for i in range(shingle)), strict=False)
    total = len(words) - shingle + 1
    hashes = np.fromiter((digest(join(g), SEED) for g in grams), dtype="<u8", count=total)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed 64-bit integer, one row per row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.fromiter((simhash(t) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def radii(bits: int, segments: int) -> list[int]:
    """Radii of the segments' balls such that two fingerprints of ``bits`` differing bits meet in one of them; -1: none needed."""
    each, more = divmod(bits, segments)
    return [each if i <= more else each - 1 for i in range(segments)]


def _ball(mask: int, radius: int) -> list[int]:
    """All changes of at most ``radius`` of the bits of ``mask``."""
    ones = [1 << i for i in range(64) if mask >> i & 1]
    return [sum(c) for r in range(radius + 1) for c in combinations(ones, r)]


def _cut_up(mask: int, segments: int) -> list[int]:
    """The bits of ``mask`` in so many runs."""
    ones = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << i for i in ones[k * len(ones) // segments : (k + 1) * len(ones) // segments]) for k in range(segments)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


ALL = (1 << 64) - 1


class _Table(NamedTuple):
    fixed: int  # the bits that its keys hold
    segment: int  # of those, the ones that its probes change
    parent: int | None  # the table whose large buckets it splits
    place: int  # among the tables of one parent
    among: int  # how many those are


def _tables(parents: list[_Table | None], segments: int) -> list[_Table]:
    """Under each parent a table per segment of its free bits; the last step leaves nothing free."""
    out = []
    for i, p in enumerate(parents):
        free = ALL & ~p.fixed if p else ALL
        parts = _cut_up(free, segments)
        out += [_Table((p.fixed if p else 0) | m, m, i if p else None, k, segments) for k, m in enumerate(parts)]
    return out


def _members(rows: DataFrame, tables: list[_Table]) -> DataFrame:
    """``(table, key, fp, rep)``: ``rows (fp, rep, parent)`` entered in each table of their parent."""
    known = [(i, -1 if t.parent is None else t.parent, _signed(t.fixed)) for i, t in enumerate(tables)]
    known = rows.sparkSession.createDataFrame(known, "table int, parent int, fixed long")
    # A row per table: a handful.
    return rows.join(F.broadcast(known), "parent").select("table", F.col("fp").bitwiseAND(F.col("fixed")).alias("key"), "fp", "rep")


def _probes(rows: DataFrame, tables: list[_Table], max_bits: int) -> DataFrame:
    """``(table, key, fp, rep, flips)``: ``rows (fp, rep, flips, parent)`` with each member of the balls that may meet."""
    balls = []
    for i, t in enumerate(tables):
        for left in [max_bits] if t.parent is None else range(max_bits + 1):
            radius = radii(left, t.among)[t.place]
            if radius >= 0:
                balls += [(i, -1 if t.parent is None else t.parent, left, _signed(m), _signed(t.fixed)) for m in _ball(t.segment, radius)]
    known = rows.sparkSession.createDataFrame(balls, "table int, parent int, left int, change long, fixed long")
    # A row per member of a ball: fixed by the parameters, not by the data.
    out = rows.withColumn("left", F.lit(max_bits) - F.bit_count("flips")).join(F.broadcast(known), ["parent", "left"])
    out = out.select("table", "fp", "rep", F.col("flips").bitwiseXOR(F.col("change")).alias("flips"), "fixed")
    return out.select("table", F.col("fp").bitwiseXOR(F.col("flips")).bitwiseAND(F.col("fixed")).alias("key"), "fp", "rep", "flips")


def _met(probes: DataFrame, members: DataFrame, max_bits: int) -> DataFrame:
    """``(a, b)`` of probes and members of one bucket whose complete distance is small."""
    m = members.select(F.col("table").alias("_t"), F.col("key").alias("_k"), F.col("fp").alias("_fp"), F.col("rep").alias("_rep"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("_fp"))) <= max_bits
    at = (F.col("table") == F.col("_t")) & (F.col("key") == F.col("_k"))
    return probes.join(m, at & near & (F.col("fp") < F.col("_fp"))).select(F.col("rep").alias("a"), F.col("_rep").alias("b"))


def links(classes: DataFrame, segments: int = SEGMENTS, max_bits: int = 2, large: int = LARGE) -> DataFrame:
    """Edges ``(a, b)`` between the representatives of all pairs of fingerprints at ``max_bits`` or fewer differing bits.

    ``classes`` has one row ``(fp, rep)`` per different fingerprint.  Each
    link is found, once; a fingerprint has no more links than there are
    fingerprints so near to it.  No fingerprints give no rows.
    """
    if not 0 <= max_bits <= 8 or segments not in (1, 2, 3, 4):
        raise ValueError("max_bits must lie in 0..8 and segments in 1..4")
    tables, found = _tables([None], segments), []
    start = classes.withColumns({"flips": F.lit(0).cast("long"), "parent": F.lit(-1)})
    members, probes = _members(start, tables), _probes(start, tables, max_bits)
    while True:
        whole = all(t.fixed == ALL for t in tables)
        if not whole:
            hot = cut(members.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") > large).select(F.col("table").alias("_t"), F.col("key").alias("_k")))
            count = hot.count()
        if whole or not count:
            found.append(_met(probes, members, max_bits))
            break
        hot = F.broadcast(hot) if count <= FEW_BUCKETS else hot
        at = lambda df: (df["table"] == hot["_t"]) & (df["key"] == hot["_k"])  # noqa: E731, B023
        found.append(_met(probes.join(hot, at(probes), "left_anti"), members.join(hot, at(members), "left_anti"), max_bits))
        again = lambda df, *more: df.join(hot, at(df), "left_semi").select("fp", "rep", *more, F.col("table").alias("parent"))  # noqa: E731, B023
        tables = _tables(list(tables), segments if bin(ALL & ~tables[0].fixed).count("1") > 16 else 1)
        members, probes = stored(_members(again(members), tables), "members"), _probes(stored(again(probes, "flips"), "probes"), tables, max_bits)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, fingerprint, component_id)``.

    ``component_id`` is the smallest id among all documents reachable over
    links of at most ``max_bits`` differing bits.  Null and empty texts have
    fingerprint 0 and are linked like any other.  Rows without an id are
    fingerprinted and carry their group's id (null if nobody there has one);
    they link nothing by themselves.  Repeated rows are repeated; an empty
    table gives no rows; other columns of ``docs`` are not touched.
    """
    return grouped(fingerprints(docs, id_col, text_col), max_bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` of :func:`fingerprints`; see :func:`near_duplicates`."""
    fps = cut(fps)
    named = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = components(links(named.where(F.col("rep").isNotNull()), max_bits=max_bits))
    of_fp = named.join(groups, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of_fp, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def shingles(text: Column, size: int) -> Column:
    """The set of a text's word shingles as hashes; a text of fewer words is one shingle, one without words none."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    starts = lambda ws: F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.greatest(F.size(ws) - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    # The words are bound by a lambda, or each use would split again.
    return F.get(F.transform(F.array(words), lambda ws: F.array_distinct(F.transform(starts(ws), lambda i: F.xxhash64(F.array_join(F.slice(ws, i + 1, size), " "))))), F.lit(0))


def similar(docs: DataFrame, fps: DataFrame, id_col: str, text_col: str = "text", max_bits: int = 5, segments: int = 3, size: int = 5, at_least: float = 0.8) -> DataFrame:
    """``(a, b, likeness)``: pairs of ``docs`` within ``max_bits`` whose shingles of ``size`` words are ``at_least`` as alike.

    ``fps (doc_id, fp)`` are their fingerprints.  Fingerprints find the
    candidates, which their whole texts confirm.  Of documents with one
    fingerprint only that with the smallest id is compared; ids are not null
    and name one row each; an empty table gives no rows.
    """
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    pairs = stored(links(classes, segments, max_bits), "candidates")
    of = pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()
    sets = stored(docs.join(of, F.col(id_col) == F.col("_id"), "left_semi").select(F.col(id_col).alias("id"), shingles(F.col(text_col), size).alias("set")), "shingles")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    scored = both.withColumn("n", common).select("a", "b", F.when(F.size("x") + F.size("y") == 0, 1.0).otherwise(F.col("n") / (F.size("x") + F.size("y") - F.col("n"))).alias("likeness"))
    return scored.where(F.col("likeness") >= at_least)
