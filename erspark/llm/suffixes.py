"""Suffix dedup of bytes by a distributed difference-cover algorithm.

A byte goes if it is covered by a ``WINDOW``-byte string that also starts earlier: in a smaller doc_id, or earlier in the same text.
So suffixes matter up to their first WINDOW bytes, their prefixes. The stages:

1. Filter. Every prefix names an anchor, the ``ANCHOR``-byte string that begins at the least of the hashes of its first ``SPREAD``
   positions; equal prefixes name equal anchors at equal offsets. Consecutive starts that share an anchor make one row with digests of the anchor
   and of its context, the bytes that these prefixes cover. Rows are sorted by both digests and read as a stream: a row whose context stands
   earlier as well is settled as a whole; of an anchor with several contexts the first row of each stays open; all others are done. No repeat is lost.
   Each batch of texts settles what it can itself and sends settled rows of a text as joined runs.
2. Difference cover. The open contexts, grouped by anchor, are dealt out; no two groups share a prefix, so each task orders the suffixes of
   its groups by itself (``suffix_ranks``): triples at the positions of the cover {1, 2} modulo 3 are sorted and named, names are
   sorted by recursion, the remaining suffixes are merged by (symbol, rank), and adjacent prefixes are compared byte by byte. Of a run of equal
   prefixes all but the first are repeats.
3. A group of over ``HELD`` bytes isn't held: its prefixes are dealt out once more, each by its own digest, sorted, and adjacent ones compared
   as a stream. So a group may have any size.

Only texts with an open or settled row are shuffled, once (``common.marked``); all others finish in the scan. Digests of contexts have 128 bits.

Defined cases: null texts are empty; texts shorter than a window keep all; rows with equal doc_id are ordered by a hash of
their text, and equal rows count as one text; a null doc_id is larger than any other; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erspark.llm.common import by_text, keyed, marked, met
from erspark.llm.cover import digests, finisher, listed
from erspark.plans.lineage import small_batches, stored

WINDOW = 100
SPREAD = 64
ANCHOR = WINDOW - SPREAD + 1
GRAM = 8
#: Bytes of contexts that a task orders at once, and that one group may hold.
HELD = 1 << 20
_BLOCK = 1 << 16
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 20) - 1)
with np.errstate(over="ignore"):
    _BYTES = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    _BYTES ^= _BYTES >> np.uint64(29)


def byte_numbers(data: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(data, np.uint8)]


def anchors(data: np.ndarray, valid: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, n, anchor digest, context digest) of each run of n starts, valid ones, that share an anchor; block by block. A run may
    end at a block's end, which only makes two rows of one."""
    for at in range(0, max(0, len(data) - WINDOW + 1), _BLOCK):
        own = valid[at : at + _BLOCK]
        tokens = _BYTES[data[at : at + _BLOCK + WINDOW - 1]]
        n = len(tokens) - WINDOW + 1
        hashes = digests(tokens, GRAM, _B1)
        least = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while width < SPREAD:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        place = np.where(own[:n], (least[:n] & _LOW).astype(np.int64), -1)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], n) - 1
        some = place[first] >= 0
        first, last = first[some], last[some]
        if not len(first):
            continue
        whole = digests(tokens, WINDOW, _B2)
        context = (whole[first] * _B1 + whole[last]) * _B2 + (last - first).astype(np.uint64)
        yield first + at, last - first + 1, digests(tokens, ANCHOR, _B1)[place[first]], context


_ROWS = "k1 long, k2 long, doc_id long, told long, start int, n int"
_RUNS = "key long, doc_id long, told long, start int, n int"


def _joined(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts, sorted by (doc, start), joined where they follow each other."""
    if not len(doc):
        return doc, start, n
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > (start + n)[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], start[last] + n[last] - start[first]


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, told, text) to rows of anchors. Rows with k2 = 0 are runs that the batch has settled."""
    with np.errstate(over="ignore"):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            size = np.array([len(t) for t in texts], np.int64)
            begin = np.cumsum(size) - size
            data = np.frombuffer(b"".join(texts), np.uint8)
            edge = np.zeros(len(data) + 1, np.int32)
            long = size >= WINDOW
            np.add.at(edge, begin[long], 1)
            np.add.at(edge, (begin + size - WINDOW + 1)[long], -1)
            found = list(anchors(data, np.cumsum(edge)[:-1] > 0))
            if not found:
                continue
            start, n, k1, k2 = (np.concatenate(x) for x in zip(*found, strict=True))
            k2 |= np.uint64(1)
            own = np.searchsorted(begin + size, start, side="right")
            start = start - begin[own]
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc, told = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((start, told[own], doc[own], null[own], k2, k1))
            a, b = order[:-1], order[1:]
            again = (k1[a] == k1[b]) & (k2[a] == k2[b])
            same = (doc[own[a]] == doc[own[b]]) & (null[own[a]] == null[own[b]]) & (told[own[a]] == told[own[b]]) & (start[a] == start[b])
            settled = np.zeros(len(own), bool)
            # a row that equals the one before it (rows that stand twice) is settled only if that one is
            first = np.concatenate(([True], ~again))
            new = np.concatenate(([True], ~(again & same)))
            settled[order] = ~first
            run = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            settled[order] = ~first[run]
            done = np.flatnonzero(settled)
            d, s, m = _joined(own[done], start[done], n[done])
            k3 = digests(d.astype(np.uint64) * _B1 + s.astype(np.uint64), 1, _B1) if len(d) else np.empty(0, np.uint64)
            left = ~settled
            own, start, n = np.concatenate([own[left], d]), np.concatenate([start[left], s]), np.concatenate([n[left], m])
            k1, k2 = np.concatenate([k1[left], k3]).view(np.int64), np.concatenate([k2[left], np.zeros(len(d), np.uint64)]).view(np.int64)
            for k in range(0, len(own), 1 << 18):
                p = slice(k, k + (1 << 18))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[p]), pa.array(k2[p]), pa.array(doc[own[p]], mask=null[own[p]]), pa.array(told[own[p]]), pa.array(start[p].astype(np.int32)), pa.array(n[p].astype(np.int32))],
                    ["k1", "k2", "doc_id", "told", "start", "n"],
                )


def _runs(key: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """``rows``: columns k1, k2, null, doc_id, told, start, n."""
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(rows[:, 3], mask=rows[:, 2] == 1), pa.array(rows[:, 4]), pa.array(rows[:, 5].astype(np.int32)), pa.array(rows[:, 6].astype(np.int32))], ["key", "doc_id", "told", "start", "n"]
    )


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of anchors to settled runs (key 0) and open contexts (key: the anchor). The state is one row: the last that was read, and
    whether the first context of its anchor has still to be emitted."""
    last, waits = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        null = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), null.astype(np.int64), batch.column(2).fill_null(0).to_numpy(), *(batch.column(k).to_numpy().astype(np.int64) for k in (3, 4, 5))], axis=1)
        alone = rows[:, 1] == 0
        if alone.any():
            yield _runs(np.zeros(int(alone.sum()), np.int64), rows[alone])
            rows = rows[~alone]
        if last is not None:
            rows = np.concatenate([last[None], rows])
        if not len(rows):
            continue
        distinct = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))
        rows = rows[distinct]
        one = np.concatenate(([True], rows[1:, 0] != rows[:-1, 0]))
        two = one | np.concatenate(([True], rows[1:, 1] != rows[:-1, 1]))
        two[0] = last is None
        settled, opened = ~two, two & ~one
        if last is not None:
            settled[0] = False
        if settled.any():
            yield _runs(np.zeros(int(settled.sum()), np.int64), rows[settled])
        # the first context of an anchor is open if another one follows
        first = np.flatnonzero(one)
        more = np.logical_or.reduceat(opened, first)
        if last is not None:
            if more[0] and waits is not None:
                yield _runs(waits[None, 0], waits[None])
            begun = first[1:][more[1:]]
        else:
            begun = first[more]
        opened[begun] = True
        if opened.any():
            yield _runs(rows[opened][:, 0], rows[opened])
        k = len(first) - 1
        if k > 0 or last is None:
            waits = None if more[k] else rows[first[k]]
        elif more[0]:
            waits = None
        last = rows[-1]


_CONTEXTS = "k1 long, context binary, doc_id long, told long, start int, n int"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, told, text, named) to open contexts and, with a null context, joined settled runs."""
    with np.errstate(over="ignore"):
        for batch in batches:
            ends, (keys, starts, counts) = listed(batch.column(3), ("key", "start", "n"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            opened = keys != 0
            order = np.lexsort((starts, row))
            order = order[~opened[order]]
            runs = _joined(row[order], starts[order], counts[order])
            row, starts, counts, keys = row[opened], starts[opened], counts[opened], keys[opened]
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            context = [texts[i][a:b] for i, a, b in zip(row.tolist(), starts.tolist(), (starts + counts + WINDOW - 1).tolist(), strict=True)]
            context += [None] * len(runs[0])
            keys = np.concatenate([keys, _BYTES[runs[0] & 255].view(np.int64) * (2 * runs[1] + 1)])
            row, starts, counts = (np.concatenate([x, y]) for x, y in zip((row, starts, counts), runs, strict=True))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(context, pa.binary()), batch.column(0).take(at), batch.column(1).take(at), pa.array(starts.astype(np.int32)), pa.array(counts.astype(np.int32))],
                ["k1", "context", "doc_id", "told", "start", "n"],
            )


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """The rank of each suffix of ``text`` (symbols from 1), by the difference cover {1, 2} modulo 3."""
    n = len(text)
    if n < 4:
        order = sorted(range(n), key=lambda i: text[i:].tolist())
        return np.argsort(np.array(order, np.int64))
    padded = np.concatenate([text, [0, 0, 0]])
    ones, twos = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    base = int(text.max()) + 1
    triples = (padded[sample] * base + padded[sample + 1]) * base + padded[sample + 2]
    names, name = np.unique(triples, return_inverse=True)
    if len(names) < len(sample):
        # one symbol parts the names at 1 modulo 3 from those at 2 modulo 3
        ranks = suffix_ranks(np.concatenate([name[: len(ones)] + 2, [1], name[len(ones) :] + 2]))
        name = np.argsort(np.argsort(np.delete(ranks, len(ones)), kind="stable"), kind="stable")
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name + 1
    zeros, many = np.arange(0, n, 3), len(sample) + 2
    by_one = lambda i: padded[i] * many + rank[i + 1]
    by_two = lambda i: (padded[i] * base + padded[i + 1]) * many + rank[i + 2]
    zeros = zeros[np.argsort(by_one(zeros), kind="stable")]
    merged = np.arange(len(zeros)) + np.searchsorted(np.sort(by_one(ones)), by_one(zeros)) + np.searchsorted(np.sort(by_two(twos)), by_two(zeros))
    free = np.ones(n, bool)
    free[merged] = False
    out = np.empty(n, np.int64)
    out[zeros] = merged
    out[sample] = np.flatnonzero(free)[name]
    return out


def repeated(contexts: list[bytes], counts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of the prefixes, ``counts`` per context, that equal one at an earlier place. ``places``: null, doc_id, told, start by row."""
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    size = np.array([len(c) + 1 for c in contexts], np.int64)
    begin = np.cumsum(size) - size
    symbols = data.astype(np.int64) + 2
    symbols[begin + size - 1] = 1
    ranks = suffix_ranks(symbols)
    row = np.repeat(np.arange(len(contexts)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begin[row] + offset
    order = np.argsort(ranks[at])
    row, offset, at = row[order], offset[order], at[order]
    prefixes = sliding_window_view(data, WINDOW)
    equal = np.zeros(len(at), bool)
    for k in range(1, len(at), _BLOCK):
        stop = min(len(at), k + _BLOCK)
        own = prefixes[at[k - 1 : stop]]
        equal[k:stop] = (own[1:] == own[:-1]).all(axis=1)
    some = equal | np.append(equal[1:], False)
    group = np.cumsum(~equal)[some]
    row, offset = row[some], offset[some]
    if not len(row):
        return row, offset
    place = places[row].copy()
    place[:, 3] += offset
    order = np.lexsort((place[:, 3], place[:, 2], place[:, 1], place[:, 0], group))
    new = np.concatenate(([True], group[order][1:] != group[order][:-1]))
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = order[(place[order] != place[lead]).any(axis=1)]
    later = later[np.lexsort((offset[later], row[later]))]
    return row[later], offset[later]


_FOUND = "k1 long, prefix binary, doc_id long, told long, start int, n int"


def _found(key: np.ndarray, prefix: list | None, places: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.nulls(len(key), pa.binary()) if prefix is None else pa.array(prefix, pa.binary()), pa.array(places[:, 1], mask=places[:, 0] == 1), pa.array(places[:, 2]), pa.array(places[:, 3].astype(np.int32)), pa.array(n.astype(np.int32))],
        ["k1", "prefix", "doc_id", "told", "start", "n"],
    )


def _places(batch: pa.RecordBatch) -> np.ndarray:
    null = batch.column(2).is_null().to_numpy(zero_copy_only=False)
    return np.stack([null.astype(np.int64), batch.column(2).fill_null(0).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy().astype(np.int64)], axis=1)


def _ordered(held: int):
    """Open contexts, sorted by anchor, to repeated runs (null prefix) and the prefixes of groups too large to hold."""

    def compared(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        contexts = [c for p in parts for c in p[0]]
        counts, places = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        if len(contexts) < 2:
            return
        row, offset = repeated(contexts, counts, places)
        row, offset, n = _joined(row, offset, np.ones(len(row), np.int64))
        if len(row):
            own = places[row].copy()
            own[:, 3] += offset
            yield _found(own[:, 1] * 31 + own[:, 3], None, own, n)

    def dealt(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for contexts, counts, places in parts:
                for context, n, place in zip(contexts, counts.tolist(), places, strict=True):
                    own = np.repeat(place[None], n, axis=0)
                    own[:, 3] += np.arange(n)
                    yield _found(digests(byte_numbers(context), WINDOW, _B2)[:n].view(np.int64), [context[k : k + WINDOW] for k in range(n)], own, np.ones(n, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, ready_size, group, group_size, key, large = [], 0, [], 0, None, False
        for batch in batches:
            alone = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            if alone.any():
                own = batch.filter(pa.array(alone))
                yield _found(own.column(0).to_numpy(), None, _places(own), own.column(5).to_numpy())
                batch = batch.filter(pa.array(~alone))
            if not batch.num_rows:
                continue
            k1, places, counts, contexts = batch.column(0).to_numpy(), _places(batch), batch.column(5).to_numpy().astype(np.int64), batch.column(1).to_pylist()
            bounds = [0, *(np.flatnonzero(k1[1:] != k1[:-1]) + 1).tolist(), len(k1)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if key != k1[a]:
                    if large:
                        yield from dealt(group)
                    elif group:
                        ready, ready_size = ready + group, ready_size + group_size
                    if ready_size > held:
                        yield from compared(ready)
                        ready, ready_size = [], 0
                    group, group_size, key, large = [], 0, k1[a], False
                group.append((contexts[a:b], counts[a:b], places[a:b]))
                group_size += sum(map(len, contexts[a:b]))
                large = large or group_size > held
                if large:
                    yield from dealt(group)
                    group = []
        if not large and group:
            ready = ready + group
        if ready:
            yield from compared(ready)

    return run


_SPANS = "doc_id long, told long, start int, stop int"


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs pass; prefixes, sorted, are compared with the first of their run as a stream."""
    lead, place = None, None
    for batch in batches:
        places, n = _places(batch), batch.column(5).to_numpy()
        out = np.ones(batch.num_rows, bool)
        if batch.column(1).null_count < batch.num_rows:
            for i, prefix in enumerate(batch.column(1).to_pylist()):
                if prefix is None:
                    continue
                if prefix != lead:
                    lead, place = prefix, places[i]
                out[i] = (places[i] != place).any()
        own = places[out]
        stop = own[:, 3] + n[out] + WINDOW - 1
        yield pa.RecordBatch.from_arrays([pa.array(own[:, 1], mask=own[:, 0] == 1), pa.array(own[:, 2]), pa.array(own[:, 3].astype(np.int32)), pa.array(stop.astype(np.int32))], ["doc_id", "told", "start", "stop"])


def _finish(data: bytes, spans: np.ndarray) -> tuple[int, int, int, str]:
    if not len(spans):
        return len(data), 0, 0, hashlib.sha256(data).hexdigest()
    gone = np.zeros(len(data) + 1, np.int64)
    np.add.at(gone, spans[:, 0], 1)
    np.add.at(gone, spans[:, 1], -1)
    out = np.cumsum(gone[:-1]) > 0
    kept = np.frombuffer(data, np.uint8)[~out].tobytes()
    n_spans = int((out & ~np.concatenate(([False], out[:-1]))).sum())
    return len(data), len(data) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()


def dedup_bytes(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""
    small_batches(docs.sparkSession, rows=1 << 15, size="8m")
    rows = keyed(docs)
    last = F.col("doc_id").asc_nulls_last()
    sampled = rows.mapInArrow(_sampler, _ROWS).repartition("k1").sortWithinPartitions("k1", "k2", last, "told", "start", "n")
    named = sampled.mapInArrow(_named, _RUNS)
    lists = stored(by_text(named, F.struct("key", "start", "n"), "named"), "named-contexts")
    asked, free = marked(rows, lists.select(F.col("d").alias("doc_id"), F.col("t").alias("told")))
    contexts = met(asked, lists, "inner").mapInArrow(_contexts, _CONTEXTS).repartition("k1").sortWithinPartitions("k1")
    found = contexts.mapInArrow(_ordered(held), _FOUND).repartition("k1").sortWithinPartitions("k1", "prefix", last, "told", "start")
    spans = by_text(found.mapInArrow(_adjacent, _SPANS), F.struct("start", "stop"), "spans")
    names, types = ["n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    done = met(asked, spans, "left").select("doc_id", "text", "spans").mapInArrow(finisher(_finish, names, types), out)
    return free.select("doc_id", "text").mapInArrow(finisher(_finish, names, types), out).union(done)
