"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: 64 bits over the 4-word shingles of a text (repeats included), each shingle hashed by XXH64 (seed 42);
a bit is set if it is set in over half of the hashes. Two fingerprints link at ``max_bits`` or fewer differing bits.

Plan: equal fingerprints collapse first (map-side), so copies never meet. The distinct ones are dealt out by
``max_bits + 1`` disjoint bit masks: two fingerprints within ``max_bits`` agree on all bits of at least one mask, so no
link is lost. A mask value that too many fingerprints share is dealt out again by finer masks over its remaining bits,
by the same argument. Within a dealt group the fingerprints are sorted by Gray rank and every run of ``FANOUT``
neighbours is factored into an upper node that holds the bits its members share; a join of the index with itself
descends pairs of nodes and prunes a whole pair as soon as the differences on shared bits exceed ``max_bits``.
The links of a group leave it as stars, and connected components are found on stars only.

``keep_one`` looks for near copies: word shingles of ``NEAR_SHINGLE`` words and a similarity of about 0.8 or more. At that similarity 64 bits differ
in 10 places on average, with much spread, so it takes two independent fingerprints: candidates differ in ``NEAR_BITS`` or fewer bits of one of
them, and link if both together differ in ``NEAR_TOTAL`` or fewer of 128. Both are read off the index; no text is compared.

Defined cases: null and empty texts, and texts without words, have fingerprint zero and link like any other; one to
three words give one shingle; a null doc_id never names a component (``component_id`` is null only if all of its
doc_ids are); repeated rows give repeated rows; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from erspark.operators.components import connected_components
from erspark.plans.lineage import cut, small_batches

SEED = 42
SHINGLE = 4
MAX_BITS = 4
FANOUT = 8
NEAR_SHINGLE = 5
NEAR_BITS = 8
NEAR_TOTAL = 20
#: A group of more distinct fingerprints is dealt out again by finer masks.
DENSE = 8192
LEVELS = 4
_STEP = 1 << 15
_PAIRS = 1 << 20


def _second(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(text: str | None, shingle: int = SHINGLE, count: int = 1) -> list[int]:
    """``count`` fingerprints, one or two, of one text, as unsigned integers."""
    words = text.encode().lower().split() if text else []
    if not words:
        return [0] * count
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    first = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros((count, 64), np.int64)
    for k in range(0, n, _STEP):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[k : k + _STEP], last[k : k + _STEP], strict=True)], "<u8")
        for which in range(count):
            bits = np.unpackbits((_second(hashes) if which else hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[which] += bits.sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * c > n, bitorder="little").tobytes(), "little") for c in counts]


def fingerprint(text: str | None) -> int:
    return fingerprints(text)[0]


@F.pandas_udf(LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="uint64").astype("int64")


@F.pandas_udf(StructType([StructField("fp", LongType()), StructField("other", LongType())]))
def near_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fingerprints(t, NEAR_SHINGLE, 2) for t in texts], columns=["fp", "other"], dtype="uint64").astype("int64")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(free: list[int], parts: int) -> list[list[int]]:
    """``free`` bit positions dealt into ``parts`` disjoint sets of neighbours."""
    size, rest = divmod(len(free), parts)
    cuts = [0]
    for k in range(parts):
        cuts.append(cuts[-1] + size + (k < rest))
    return [free[a:b] for a, b in pairwise(cuts)]


def _finer(fixed: int, parts: int) -> list[int]:
    """Masks that extend ``fixed`` by one of ``parts`` disjoint sets of its unused bits."""
    free = [b for b in range(64) if not fixed >> b & 1]
    return [fixed | sum(1 << b for b in own) for own in _masks(free, parts)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each fingerprint in the Gray-code order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Levels of nodes over fingerprints sorted by (group, Gray rank); level 0 holds the leaves, the top one root per
    group. A node keeps AND and OR of its leaves: bits on which they agree form its masked pattern."""

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        self.order = np.lexsort((gray_rank(prints), group))
        prints, group = prints[self.order], group[self.order]
        self.levels = [(prints, prints)]
        self.starts: list[np.ndarray] = []
        while True:
            change = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            if len(change) == len(group):
                break
            within = np.arange(len(group)) - np.repeat(change, np.diff(np.append(change, len(group))))
            start = np.flatnonzero(within % FANOUT == 0)
            low, high = self.levels[-1]
            self.levels.append((np.bitwise_and.reduceat(low, start), np.bitwise_or.reduceat(high, start)))
            self.starts.append(np.append(start, len(group)))
            group = group[start]

    def links(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions in the input whose fingerprints differ in ``max_bits`` or fewer bits, in chunks."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                real = a != b
                if real.any():
                    yield self.order[a[real]], self.order[b[real]]
                continue
            start = self.starts[level - 1]
            na, nb = start[a + 1] - start[a], start[b + 1] - start[b]
            total = np.cumsum(na * nb)
            if total[-1] > _PAIRS and len(a) > 1:
                half = max(1, min(len(a) - 1, int(np.searchsorted(total, _PAIRS))))
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            each = np.repeat(np.arange(len(a)), na * nb)
            k = np.arange(len(each)) - np.repeat(total - na * nb, na * nb)
            i, j = start[a[each]] + k // nb[each], start[b[each]] + k % nb[each]
            low, high = self.levels[level - 1]
            shared = ~(low[i] ^ high[i]) & ~(low[j] ^ high[j])
            near = (i <= j) & (np.bitwise_count((low[i] ^ low[j]) & shared) <= max_bits)
            if near.any():
                stack.append((level - 1, i[near], j[near]))


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest label of each set after the links i-j."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _stars(group: np.ndarray, rows: np.ndarray, max_bits: int, total: int) -> pa.RecordBatch | None:
    """``rows``: fingerprint and, if there is a second one, that and the node that both name; else the fingerprint is the node."""
    prints, nodes = np.ascontiguousarray(rows[:, 0]).view(np.uint64), rows[:, -1]
    label = np.arange(len(prints))
    for i, j in GrayIndex(group, prints).links(max_bits):
        if rows.shape[1] > 1:
            near = np.bitwise_count(prints[i] ^ prints[j]) + np.bitwise_count((rows[i, 1] ^ rows[j, 1]).view(np.uint64)) <= total
            i, j = i[near], j[near]
        label = _merge(label, i, j)
    own = np.flatnonzero(label != np.arange(len(prints)))
    if not len(own):
        return None
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], ["u", "v"])


def _link_groups(batches: Iterator[pa.RecordBatch], max_bits: int, total: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, val, fp) or (mask, val, fp, other, node) sorted by (mask, val); whole groups are indexed as soon as they are complete."""
    held: list[np.ndarray] = []

    def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        change = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
        group = np.concatenate(([0], np.cumsum(change)))
        if (out := _stars(group, rows[:, 2:], max_bits, total)) is not None:
            yield out

    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        held.append(rows)
        if sum(map(len, held)) < 4 * DENSE:
            continue
        rows = np.ascontiguousarray(np.concatenate(held))
        last = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
        if len(last):
            yield from done(np.ascontiguousarray(rows[: last[-1] + 1]))
            rows = rows[last[-1] + 1 :]
        held = [rows]
    if held and len(rows := np.ascontiguousarray(np.concatenate(held))):
        yield from done(rows)


def links(prints: DataFrame, max_bits: int = MAX_BITS, total: int = 128) -> DataFrame:
    """Star edges (u, v) that connect every two rows whose fingerprints (column ``fp``) differ in ``max_bits`` or fewer bits: of fingerprints
    if they are the only column, else of nodes (column ``node``) whose second fingerprints (``other``) let both together differ in
    ``total`` bits at most."""
    parts = max_bits + 1
    level = _finer(0, parts)
    own = ["fp", *(c for c in ("other", "node") if c in prints.columns)]

    def masked(rows: DataFrame, masks) -> DataFrame:
        return rows.select(*own, F.explode(masks).alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("val"), *own)

    rows = masked(prints, F.array(*[F.lit(_signed(m)) for m in level]))
    dealt = None
    for depth in range(LEVELS):
        if depth == LEVELS - 1:
            light, dense = rows, None
        else:
            heavy = cut(rows.groupBy("mask", "val").count().filter(F.col("count") > DENSE).select("mask", "val"))
            if heavy.isEmpty():
                light, dense = rows, None
            else:
                light, dense = rows.join(heavy, ["mask", "val"], "left_anti"), rows.join(heavy, ["mask", "val"], "left_semi")
        dealt = light if dealt is None else dealt.union(light)
        if dense is None:
            break
        finer = {m: _finer(m, parts) for m in level}
        level = [m for masks in finer.values() for m in masks]
        pick = F.create_map(*[x for m, masks in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(o)) for o in masks]))])
        rows = masked(dense.withColumnRenamed("mask", "coarse"), pick[F.col("coarse")])
    ordered = dealt.repartition("mask", "val").sortWithinPartitions("mask", "val")
    return ordered.mapInArrow(lambda it: _link_groups(it, max_bits, total), "u long, v long")


def simhash_groups(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as (doc_id, fingerprint, component_id)."""
    small_batches(docs.sparkSession)
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(F.col(text_col)).alias("fp")))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("id")))
    classes = classes_of(prints.withColumnRenamed("fp", "node"), links(prints.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classes_of(nodes: DataFrame, stars: DataFrame) -> DataFrame:
    """(node, component, component_id) from nodes (node, id) and edges (u, v)."""
    found = cut(connected_components(stars))
    member = nodes.join(found, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    lowest = member.groupBy("component").agg(F.min("id").alias("component_id"))
    return member.join(lowest, "component").select("node", "component", "component_id")


def keep_one(docs: DataFrame, max_bits: int = NEAR_BITS, total: int = NEAR_TOTAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one row of each class of near copies does: the one with the smallest id;
    among rows that share that id, the one with the smallest hash of its text; of equal rows, any one."""
    small_batches(docs.sparkSession)
    told = F.xxhash64(F.col(text_col), F.col(text_col).isNull())
    rows = docs.select(F.col(id_col).alias("doc_id"), told.alias("told"), near_udf(F.col(text_col)).alias("near"))
    # both fingerprints name a node by a hash of 64 bits
    rows = cut(rows.select("doc_id", "told", "near.fp", "near.other", F.xxhash64("near.fp", "near.other").alias("node")))
    prints = cut(rows.groupBy("node", "fp", "other").agg(F.min("doc_id").alias("id")))
    stars = links(prints.select("fp", "other", "node"), max_bits, total).union(links(prints.select(F.col("other").alias("fp"), F.col("fp").alias("other"), "node"), max_bits, total))
    first = rows.join(classes_of(prints.select("node", "id"), stars), "node").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("component", F.col("doc_id").alias("kept_id")).agg(F.min("told").alias("kept_told"))
    first = cut(first.select("kept_id", "kept_told").distinct())
    kept = docs.join(first, docs[id_col].eqNullSafe(first.kept_id) & (told == first.kept_told), "left_semi")
    again = rows.groupBy("doc_id", "told").count().filter(F.col("count") > 1).select(F.col("doc_id").alias("again_id"), F.col("told").alias("again_told"))
    again = cut(again.join(first, again.again_id.eqNullSafe(first.kept_id) & (again.again_told == first.kept_told), "left_semi"))
    if again.isEmpty():
        return kept
    same = docs[id_col].eqNullSafe(again.again_id) & (told == again.again_told)
    one = kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(again, same, "left_anti").union(one)
