"""SimHash groups, suffix and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from erspark.llm import cover, simhash, substrings, suffixes
from erspark.llm.cover import COVERS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(rows, max_bits=4):
    """Class of each fingerprint, and the smallest doc_id of each class, by definition."""
    prints = {f for _, f in rows}
    label = {f: f for f in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(a ^ b).count("1") <= max_bits and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    lowest = {}
    for d, f in rows:
        if d is not None:
            lowest[label[f]] = min(d, lowest.get(label[f], d))
    return label, lowest


def groups(rows, max_bits=4):
    label, lowest = classes_of(rows, max_bits)
    return Counter((d, f"{f:016x}", lowest.get(label[f])) for d, f in rows)


@pytest.mark.parametrize("source", ["edges", "documents"])
def test_simhash_groups(spark, edges, sf, source):
    docs = edges if source == "edges" else spark.read.parquet(f"{sf}/documents.parquet")
    got = Counter(tuple(r) for r in simhash.simhash_groups(docs).select("doc_id", "fingerprint", "component_id").collect())
    assert got == groups([(r.doc_id, fingerprint(r.text)) for r in docs.collect()])


def near_prints(n, seed):
    draw = random.Random(seed)
    out = set()
    while len(out) < n:
        x = draw.getrandbits(64)
        out.add(x)
        for _ in range(draw.randint(0, 6)):
            for b in draw.sample(range(64), draw.randint(1, 6)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def linked(pairs, prints):
    label = {f: f for f in prints}
    for a, b in pairs:
        x, y = label[a], label[b]
        if x != y:
            for f in prints:
                if label[f] in (x, y):
                    label[f] = min(x, y)
    return label


@pytest.mark.parametrize("dense", [8192, 3])
def test_links_lose_nothing(spark, monkeypatch, dense):
    """Also where groups are dealt out again by finer masks."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    prints = near_prints(250, 4)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in prints], "fp long")
    stars = [(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in simhash.links(df).collect()]
    want = [(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 4]
    assert linked(stars, prints) == linked(want, prints)


def test_gray_index_finds_exactly_the_near_pairs():
    prints = np.array(near_prints(300, 8), np.uint64)
    group = np.arange(len(prints)) % 3
    got = {tuple(sorted((int(a), int(b)))) for i, j in simhash.GrayIndex(group, prints).links(4) for a, b in zip(i, j, strict=True)}
    want = {(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if group[a] == group[b] and int(prints[a] ^ prints[b]).bit_count() <= 4}
    assert got == want


def test_gray_ranks_of_neighbours_differ_in_one_bit():
    codes = np.arange(64, dtype=np.uint64)
    order = np.argsort(simhash.gray_rank(codes))
    assert all(int(codes[a] ^ codes[b]).bit_count() == 1 for a, b in zip(order[:-1], order[1:], strict=True))


def near_prints_of(text):
    """Two fingerprints over shingles of five words, the second from a mix of the first one's hashes."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0, 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode(), 42) for i in range(max(1, len(words) - 4))]
    mixed = [int(x) for x in simhash._second(np.array(hashes, np.uint64))]
    return tuple(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)) for own in (hashes, mixed))


def near_classes(rows):
    """The smallest doc_id of each class of near copies, by definition."""
    prints = sorted({p for _, p in rows})
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for k, x in enumerate(prints):
            for y in prints[:k]:
                one, two = (x[0] ^ y[0]).bit_count(), (x[1] ^ y[1]).bit_count()
                if min(one, two) <= 8 and one + two <= 20 and label[x] != label[y]:
                    label[x] = label[y] = min(label[x], label[y])
                    changed = True
    lowest = {}
    for d, p in rows:
        if d is not None:
            lowest[label[p]] = min(d, lowest.get(label[p], d))
    return Counter(lowest.get(c) for c in set(label.values()))


def test_keep_one_of_each_class(spark, edges, empty):
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    assert Counter(r.doc_id for r in kept.collect()) == near_classes([(r.doc_id, near_prints_of(r.text)) for r in edges.collect()])
    assert simhash.keep_one(empty).count() == 0 and simhash.simhash_groups(empty).count() == 0


def test_near_copies_are_found_and_others_stay(spark):
    """Texts of 100 to 400 words with one per cent of the words changed (a similarity of about 0.9), beside unrelated ones."""
    draw = random.Random(12)
    rows, copies = [], []
    for k in range(150):
        words = [f"v{draw.randint(0, 3000)}" for _ in range(draw.randint(100, 400))]
        rows.append((2 * k, " ".join(words)))
        if k % 2:
            for _ in range(len(words) // 100):
                words[draw.randrange(len(words))] = f"edit{draw.randint(0, 9)}"
            rows.append((2 * k + 1, " ".join(words)))
            copies.append(2 * k + 1)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, _ in rows} - set(copies) <= kept and sum(d not in kept for d in copies) >= 0.9 * len(copies)


def dedup_words(rows):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), []).append(d)
    out = Counter()
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - 49) if any(x is not None and (d is None or x < d) for x in first[tuple(w[i : i + 50])]) for j in range(i, i + 50)}
        out[d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()] += 1
    return out


def passages(seed, n=40):
    """Texts that share passages around the window's length, at all alignments, with edits."""
    draw = random.Random(seed)
    pool = [" ".join(f"w{draw.randint(0, 400)}" for _ in range(draw.randint(40, 140))) for _ in range(6)]
    out = []
    for d in range(n):
        parts = []
        for _ in range(draw.randint(1, 4)):
            p = draw.choice(pool).split()
            a = draw.randint(0, 20)
            p = p[a : len(p) - draw.randint(0, 20)]
            if draw.random() < 0.4 and p:
                p[draw.randrange(len(p))] = "edit"
            parts += [f"u{draw.randint(0, 9999)}" for _ in range(draw.randint(0, 30))] + p
        out.append((d, " ".join(parts)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = passages(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1 if seed == 1 else 7)
    got = Counter(tuple(r) for r in substrings.dedup_words(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == dedup_words(rows)
    assert sum(r[2] for r in got) > 0


def test_substring_dedup_of_edge_cases(edges, empty):
    got = Counter(tuple(r) for r in substrings.dedup_words(edges).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == dedup_words([(r.doc_id, r.text) for r in edges.collect()])
    assert substrings.dedup_words(empty).count() == 0


def dedup_bytes(rows):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("seed", [3, 4])
def test_suffix_dedup(spark, seed):
    rows = passages(seed, 25) + [(100, "ab" * 300), (101, "é" * 120 + "x" + "é" * 120), (102, "ab" * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1 if seed == 3 else 7)
    got = Counter(tuple(r) for r in suffixes.dedup_bytes(df).select(*COLUMNS).collect())
    assert got == dedup_bytes(rows)


def test_suffix_dedup_of_edge_cases(edges, empty):
    rows = [r for r in edges.filter("doc_id IS NOT NULL AND doc_id NOT IN (7, 8)").collect()]
    df = edges.filter("doc_id IS NOT NULL AND doc_id NOT IN (7, 8)")
    got = Counter(tuple(r) for r in suffixes.dedup_bytes(df).select(*COLUMNS).collect())
    assert got == dedup_bytes([(r.doc_id, r.text) for r in rows])
    all_rows = suffixes.dedup_bytes(edges).select(*COLUMNS).collect()
    assert len(all_rows) == edges.count()
    assert {r.n_removed for r in all_rows if r.doc_id == 7} == {next(r.n_bytes for r in all_rows if r.doc_id == 7)}
    assert suffixes.dedup_bytes(empty).count() == 0


@pytest.mark.parametrize("period", COVERS)
def test_covers_meet_every_difference(period):
    assert {(a - b) % period for a in COVERS[period] for b in COVERS[period]} == set(range(period))


def test_digests_tell_windows_apart():
    draw = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        tokens = suffixes.byte_numbers(bytes(draw.integers(0, 2, 3000).astype(np.uint8)))
    raw = (tokens == tokens[0]).astype(np.uint8)
    for n in (1, 7, 20, 28, 100):
        with np.errstate(over="ignore"):
            d = cover.digests(tokens, n, cover._B1)
        same = {}
        for i, x in enumerate(d.tolist()):
            assert same.setdefault(x, raw[i : i + n].tobytes()) == raw[i : i + n].tobytes()
        assert len(same) == len({raw[i : i + n].tobytes() for i in range(len(raw) - n + 1)})


def test_streamed_names_do_not_depend_on_batches():
    """One run over many batches: leaders, held rows and repeats come out the same."""
    import pyarrow as pa

    draw = random.Random(6)
    rows = sorted((draw.randint(0, 3), 0, draw.randint(0, 2), 0, draw.randint(0, 50), False, 0, 0, 0) for _ in range(60))

    def run(size):
        types = [pa.int64()] * 4 + [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + size]], t) for k, t in enumerate(types)], cover._NAMES) for i in range(0, len(rows), size)]
        return Counter(tuple(x.values()) for b in cover._names(False)(iter(batches)) for x in b.to_pylist())

    assert run(60) == run(1) == run(7) and sum(run(60).values()) > 40


def test_suffix_ranks_are_those_of_sorted_suffixes():
    draw = random.Random(9)
    for n in (1, 2, 3, 4, 5, 7, 50, 200, 301):
        for symbols in (1, 2, 5, 300):
            text = np.array([draw.randint(1, symbols) for _ in range(n)], np.int64)
            order = sorted(range(n), key=lambda i: text[i:].tolist())
            assert np.argsort(suffixes.suffix_ranks(text)).tolist() == order


@pytest.mark.parametrize("held", [200, 5000])
def test_groups_too_large_to_hold_are_dealt_out_again(spark, held):
    """An anchor whose surroundings differ in every document, so none of its contexts is settled by digest."""
    line = " ".join(f"line{k}" for k in range(20))
    rows = passages(6, 12) + [(1000 + k, f"before {k * k} {line} after {k * 7}" + " end" * (k % 9)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in suffixes.dedup_bytes(df, held=held).select(*COLUMNS).collect())
    assert got == dedup_bytes(rows) and sum(r[2] > 0 for r in got if r[0] >= 1000) > 40


def test_streamed_contexts_do_not_depend_on_batches():
    import pyarrow as pa

    draw = random.Random(7)
    rows = sorted((draw.randint(0, 3), draw.choice([1, 3, 5]), draw.randint(0, 2), 0, draw.randint(0, 9), 4) for _ in range(60))
    types = [pa.int64()] * 4 + [pa.int32()] * 2

    def run(size):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + size]], t) for k, t in enumerate(types)], ["k1", "k2", "doc_id", "told", "start", "n"]) for i in range(0, len(rows), size)]
        return Counter(tuple(x.values()) for b in suffixes._named(iter(batches)) for x in b.to_pylist())

    distinct = sorted(set(rows))
    want = Counter()
    for i, r in enumerate(distinct):
        if i and distinct[i - 1][:2] == r[:2]:
            want[(0, *r[2:])] += 1
        elif len({x[1] for x in distinct if x[0] == r[0]}) > 1:
            want[(r[0], *r[2:])] += 1
    assert run(60) == run(1) == run(7) == want
