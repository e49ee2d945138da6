"""Repeated windows of token sequences through difference-cover samples.

A difference cover D of period v meets every difference: for any i, j there is a k below v with (i + k) mod v and (j + k) mod v
both in D. So if two windows of L tokens are equal, they hold at the same offset an equal sample of L - v + 1 tokens that starts at a
position of D in both. The stages, for windows of L tokens:

1. Sample: positions of D modulo v in every text, each with a digest of the L - v + 1 tokens from there.
2. Sort: samples are sorted by digest, then by (doc_id, text, position). Equal neighbours have one name, and their first is the
   name's leader. Runs are read as a stream with constant memory, so a name may have any number of samples.
3. Names along a text: samples whose leaders follow each other on one diagonal of one text, without a gap, prove that the whole
   stretch also stands at the leaders' place; windows inside it are settled.
   Each batch of texts settles the repeats that it can itself before the shuffle (a leader need only be earlier, not the first of all), so
   a name that is very frequent sends one sample per batch.
4. Extend: of the windows left that hold a sample with a name of two or more, each is extended to its L tokens and
   sorted by a 128-bit digest; every equal neighbour but the first of its run is a repeat. A window
   that stage 3 settled is never a first occurrence, so leaving those out loses nothing.

Only texts that may hold a repeated sample are shuffled, once: a bitmap of fixed size (``common.marked``) lets all others finish in the
scan, and the exchange of the texts serves both the extension and the result. Texts are in no stored table. No group is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erspark.llm.common import by_text, keyed, marked, met
from erspark.plans.lineage import small_batches, stored

#: Perfect difference sets by period.
COVERS = {
    7: (1, 2, 4),
    13: (0, 1, 3, 9),
    31: (1, 5, 11, 24, 25, 27),
    57: (1, 6, 7, 9, 19, 38, 42, 49),
    73: (1, 2, 4, 8, 16, 32, 37, 55, 64),
}
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Task:
    """What a window is. ``tokens`` gives a number for each token of a text. Only windows of a smaller doc_id make a repeat."""

    length: int
    period: int
    tokens: Callable[[bytes], np.ndarray]

    @property
    def sample(self) -> int:
        return self.length - self.period + 1


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(tokens: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """A 64-bit digest of the ``length`` tokens from each position, by doubling."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, at, size = None, 0, base, tokens, 1
    rest = length
    while rest:
        if rest & 1:
            part = at[done : done + n]
            out = part.copy() if out is None else out * power + part
            done += size
        rest >>= 1
        if rest:
            at = at[:-size] * power + at[size:]
            power = power * power
            size *= 2
    return _scramble(out)


def samples_of(n: int, task: Task) -> np.ndarray:
    """Cover positions at which a whole sample fits into a text of ``n`` tokens; none if no window fits."""
    if n < task.length:
        return np.empty(0, np.int64)
    every = np.arange(0, n - task.sample + 1, task.period)[:, None] + np.array(COVERS[task.period])
    every = every.ravel()
    return every[every <= n - task.sample]


def _local(key: list[np.ndarray], null: np.ndarray, doc: np.ndarray, told: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Combining rows before a shuffle: each row's local leader (the first of its key in the batch), whether the leader settles the
    row as a repeat, and whether it settles any row of the key. Settled rows needn't meet the rest of their key."""
    n = len(pos)
    if not n:
        return np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)
    order = np.lexsort((pos, told, doc, null, *reversed(key)))
    new = np.zeros(n, bool)
    new[0] = True
    for k in key:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    lead = np.empty(n, np.int64)
    lead[order] = order[first][run]
    settled = ~null[lead] & (null | (doc != doc[lead]))
    some = np.empty(n, bool)
    some[order] = np.logical_or.reduceat(settled[order], first)[run]
    return lead, settled, some


def _sampler(task: Task):
    """Samples as rows. A sample that its batch settles carries its leader and is routed by itself, not by its digest; ``ask`` marks
    others whose name the batch has proved to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                own, hashes, places = [], [], []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    tokens = task.tokens((text or "").encode())
                    at = samples_of(len(tokens), task)
                    if len(at):
                        own.append(np.full(len(at), i))
                        hashes.append(digests(tokens, task.sample, _B1)[at])
                        places.append(at)
                if not own:
                    continue
                own, hashes, places = np.concatenate(own), np.concatenate(hashes), np.concatenate(places)
                null = batch.column(0).is_null().to_numpy(zero_copy_only=False)[own]
                doc, told = batch.column(0).fill_null(0).to_numpy()[own], batch.column(1).to_numpy()[own]
                lead, settled, some = _local([hashes], null, doc, told, places)
                route = np.where(settled, _scramble(hashes + doc.view(np.uint64) * _B2 + places.view(np.uint64)), hashes)
                zero = lambda x: np.where(settled, x[lead], 0)
                columns = [route.view(np.int64), settled.astype(np.int64), doc, told, places.astype(np.int32), some, zero(doc), zero(told), zero(places).astype(np.int32)]
                for k in range(0, len(own), 1 << 18):
                    part = slice(k, k + (1 << 18))
                    arrays = [pa.array(c[part], mask=null[part]) if i == 2 else pa.array(c[part]) for i, c in enumerate(columns)]
                    yield pa.RecordBatch.from_arrays(arrays, _NAMES)

    return run


_NAMES = ["k1", "k2", "doc_id", "told", "pos", "ask", "lead_doc", "lead_told", "lead_pos"]
_ROWS = "k1 long, k2 long, doc_id long, told long, pos int, ask boolean, lead_doc long, lead_told long, lead_pos int"
_NAMED = "doc_id long, told long, pos int, repeat boolean, lead_doc long, lead_told long, lead_pos int"


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2", F.col("doc_id").asc_nulls_last(), "told", "pos")


def _names(only_asked: bool):
    """Reads sorted rows and emits members of runs with a repeat, each with the run's leader. The rows that share the
    leader's document come first; they are held until the run proves to have a repeat. Rows with k2 = 1 were settled before the shuffle
    and pass. ``only_asked``: just repeats with ``ask``, and rows that pass don't count as repeats."""
    names = ["doc_id", "told", "pos", "repeat", "lead_doc", "lead_told", "lead_pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead, held, proved = None, None, [], False

        def emit(doc, null, told, pos, repeat, lead_doc, lead_told, lead_pos):
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, mask=null), pa.array(told), pa.array(pos.astype(np.int32)), pa.array(repeat), pa.array(lead_doc), pa.array(lead_told), pa.array(lead_pos.astype(np.int32))], names
            )

        for batch in batches:
            if batch.num_rows:
                alone = pc.equal(batch.column(1), 1)
                if pc.any(alone).as_py():
                    own = batch.filter(alone)
                    yield pa.RecordBatch.from_arrays([*(own.column(k) for k in (2, 3, 4)), pa.array(np.full(own.num_rows, not only_asked)), *(own.column(k) for k in (6, 7, 8))], names)
                    batch = batch.filter(pc.invert(alone))
            n = batch.num_rows
            if not n:
                continue
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            null = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            doc = batch.column(2).fill_null(0).to_numpy()
            told, pos = batch.column(3).to_numpy(), batch.column(4).to_numpy().astype(np.int64)
            ask = batch.column(5).to_numpy(zero_copy_only=False)
            new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
            run_no = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            leads = np.stack([doc[first], null[first].astype(np.int64), told[first], pos[first]], axis=1)
            follows = key == (k1[0], k2[0])
            if follows:
                leads[0] = lead
            own = leads[run_no]
            repeat = ((doc != own[:, 0]) | null) & (own[:, 1] == 0)
            some = np.logical_or.reduceat(repeat if only_asked else repeat | ask, first)
            if follows:
                some[0] |= proved
                if some[0] and not proved and not only_asked:
                    yield from held
                if some[0]:
                    held = []
            else:
                held = []
            last = len(first) - 1
            out = repeat & ask if only_asked else some[run_no]
            if out.any():
                yield emit(doc[out], null[out], told[out], pos[out], repeat[out], own[out, 0], own[out, 2], own[out, 3])
            if not some[last] and not only_asked:
                wait = run_no == last
                held = (held if follows and last == 0 else []) + [emit(doc[wait], null[wait], told[wait], pos[wait], repeat[wait], own[wait, 0], own[wait, 2], own[wait, 3])]
            key, lead, proved = (k1[-1], k2[-1]), leads[last], bool(some[last])

    return run


def _spans(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the half-open spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(starts, 0, n), 1)
    np.add.at(edge, np.clip(stops, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def settle(n: int, pos: np.ndarray, repeat: np.ndarray, lead: np.ndarray, task: Task) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a text of n tokens and its named samples (positions, whether they repeat, leaders as rows of doc, text and position): covered
    tokens, windows to enter in the merge, and which of those ask."""
    a, lead = pos[repeat], lead[repeat]
    shift = lead[:, 2] - a
    order = np.lexsort((a, shift, lead[:, 1], lead[:, 0]))
    a, lead, shift = a[order], lead[order], shift[order]
    windows = n - task.length + 1
    covered, settled = np.zeros(n, bool), np.zeros(windows, bool)
    if len(a):
        joined = (lead[1:, 0] == lead[:-1, 0]) & (lead[1:, 1] == lead[:-1, 1]) & (shift[1:] == shift[:-1]) & (a[1:] <= a[:-1] + task.sample)
        begin = np.flatnonzero(np.concatenate(([True], ~joined)))
        start, stop = a[begin], a[np.append(begin[1:], len(a)) - 1] + task.sample
        long = stop - start >= task.length
        covered = _spans(start[long], stop[long], n)
        settled = _spans(start[long], stop[long] - task.length + 1, windows)
    reach = task.period - 1
    candidate = _spans(pos - reach, pos + 1, windows) & ~settled
    ask = _spans(a - reach, a + 1, windows) & candidate
    total = np.concatenate(([0], np.cumsum(covered)))
    ask &= total[task.length :] - total[: windows] < task.length
    at = np.flatnonzero(candidate)
    return covered, at, ask[at]


def _runs(flags: np.ndarray) -> np.ndarray:
    """Flags as rows (start, stop) of their runs."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))).reshape(-1, 2)


def _extender(task: Task):
    """Rows (doc_id, told, text, named) to rows of the merge: windows that are still open, by their whole digest, and the runs that
    samples have settled, which pass (k2 = 1) with their stop as lead_pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                doc, told = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
                own, k1, k2, places, asks, runs = [], [], [], [], [], []
                ends, (pos, repeat, *lead) = listed(batch.column(3), ("pos", "repeat", "lead_doc", "lead_told", "lead_pos"))
                lead = np.stack(lead, axis=1)
                for i, text in enumerate(batch.column(2).to_pylist()):
                    tokens, mine = task.tokens((text or "").encode()), slice(ends[i], ends[i + 1])
                    covered, at, ask = settle(len(tokens), pos[mine], repeat[mine], lead[mine], task)
                    k1.append(digests(tokens, task.length, _B1)[at])
                    k2.append(digests(_scramble(tokens), task.length, _B2)[at] | np.uint64(2))
                    places.append(at)
                    asks.append(ask)
                    own.append(np.full(len(at), i))
                    runs += [(i, a, b) for a, b in _runs(covered).tolist()]
                own, k1, k2, places, asks = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (own, k1, k2, places, asks))
                own, asks = own.astype(np.int64), asks.astype(bool)
                _, found, _ = _local([k1, k2], null[own], doc[own], told[own], places)
                runs += [(i, a, a + task.length) for i, a in zip(own[found & asks].tolist(), places[found & asks].tolist(), strict=True)]
                done = np.array(runs, np.int64).reshape(-1, 3)
                left = ~found
                own, n = np.concatenate([own[left], done[:, 0]]), len(done)
                none = np.zeros(len(own), np.int64)
                last = np.concatenate([none[n:], done[:, 2]]).astype(np.int32)
                k1 = np.concatenate([k1[left].view(np.int64), _scramble(doc[done[:, 0]].view(np.uint64) + done[:, 1].view(np.uint64)).view(np.int64)])
                k2 = np.concatenate([k2[left].view(np.int64), np.ones(n, np.int64)])
                places = np.concatenate([places[left], done[:, 1]]).astype(np.int32)
                columns = [k1, k2, doc[own], told[own], places, np.concatenate([asks[left], np.zeros(n, bool)]), none, none, last]
                for k in range(0, len(own), 1 << 18):
                    part = slice(k, k + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(c[part], mask=null[own[part]]) if i == 2 else pa.array(c[part]) for i, c in enumerate(columns)], _NAMES)

    return run


def listed(lists: pa.ListArray, fields: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The bounds of each list among all elements, and fields of these (numbers and flags, never null) as arrays. A null list is empty."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    arrays = [flat.field(name).to_numpy(zero_copy_only=False) for name in fields]
    return np.concatenate(([0], np.cumsum(lengths))), [a if a.dtype == bool else a.astype(np.int64) for a in arrays]


def finisher(finish: Callable[[bytes, np.ndarray], tuple], names: list[str], types: list[pa.DataType]):
    """Rows (doc_id, text) or (doc_id, text, spans), spans (start, stop) of tokens to remove, to the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, spans = np.zeros(batch.num_rows + 1, np.int64), np.empty((0, 2), np.int64)
            if batch.num_columns > 2:
                ends, own = listed(batch.column(2), ("start", "stop"))
                spans = np.stack(own, axis=1)
            rows = [finish((t or "").encode(), spans[ends[i] : ends[i + 1]]) for i, t in enumerate(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["doc_id", *names])

    return run


def without_repeats(docs: DataFrame, task: Task, finish: Callable[[bytes, np.ndarray], tuple], names: list[str], types: list[pa.DataType], ddl: str) -> DataFrame:
    """One row per row of ``docs``: doc_id and what ``finish`` makes of the text's bytes and the token spans to remove."""
    small_batches(docs.sparkSession, rows=1 << 15, size="8m")
    rows = keyed(docs)
    named = _sorted(rows.mapInArrow(_sampler(task), _ROWS)).mapInArrow(_names(False), _NAMED)
    lists = stored(by_text(named, F.struct("pos", "repeat", "lead_doc", "lead_told", "lead_pos"), "named"), "named-samples")
    asked, free = marked(rows, lists.select(F.col("d").alias("doc_id"), F.col("t").alias("told")))
    opened = met(asked, lists, "inner").mapInArrow(_extender(task), _ROWS)
    found = _sorted(opened).mapInArrow(_names(True), _NAMED)
    stop = F.when(F.col("repeat"), F.col("pos") + task.length).otherwise(F.col("lead_pos"))
    spans = by_text(found, F.struct(F.col("pos").alias("start"), stop.alias("stop")), "spans")
    out = f"doc_id long, {ddl}"
    done = met(asked, spans, "left").select("doc_id", "text", "spans").mapInArrow(finisher(finish, names, types), out)
    return free.select("doc_id", "text").mapInArrow(finisher(finish, names, types), out).union(done)
