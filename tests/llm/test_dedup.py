"""Operators 3, 5, 7 and 10 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import compact_windows, pq_dedup, simhash, suffix_dedup
from tessera.llm.components import components

from .conftest import words


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("kind", ["path", "star", "random", "loops"])
def test_components(spark, kind):
    r = random.Random(3)
    edges = {"path": [(i, i + 1) for i in range(200)], "star": [(900, i) for i in range(100)], "random": [(r.randrange(300), r.randrange(300)) for _ in range(150)], "loops": [(1, 1), (None, 2)]}[kind]
    g = Groups({x for e in edges for x in e if x is not None})
    linked = set()
    for a, b in edges:
        if a is not None and a != b:
            g.join(a, b)
            linked |= {a, b}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: g.find(x) for x in linked}


def brute_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    sh = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(documents, odd):
    base = words(120, 5)
    rows = [(500 + k, " ".join(base[:k] + ["new"] + base[k:])) for k in range(0, 120, 10)] + [(90, " ".join(base)), (91, " ".join(base).upper())]
    docs, more = odd
    rows += [r for r in more if r[0] is not None]
    docs = documents(rows)
    fp = {i: brute_fingerprint(t) for i, t in rows}
    g = Groups(fp)
    for a in fp:
        for b in fp:
            if a < b and bin(fp[a] ^ fp[b]).count("1") <= 3:
                g.join(a, b)
    got = simhash.simhash_query(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fp[i]:016x}", g.find(i)) for i in fp}
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {g.find(i) for i in fp}


def test_simhash_dedup_keeps_one_of_each_group(documents):
    text = lambda seed: " ".join(words(80, seed))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (3, text(3)), (3, text(3)), (None, text(3)), (4, text(4)), (4, text(5))]
    kept = simhash.simhash_dedup(documents(rows)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text) for r in kept), key=key) == sorted([(3, text(3)), (4, text(4)), (4, text(5)), (None, text(1)), (None, text(2))], key=key)


def test_groups_of_given_fingerprints(spark):
    rows = [(1, 0x0), (None, 0x7), (2, 0x3F), (5, 1 << 40), (5, 0xFF << 50), (9, 0xFF << 50), (None, -1), (3, 1 << 41)]
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.print_groups(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert got == {(1, 0x0): 1, (None, 0x7): 1, (2, 0x3F): 1, (5, 1 << 40): 1, (3, 1 << 41): 1, (5, 0xFF << 50): 5, (9, 0xFF << 50): 5, (None, -1): None}


def test_simhash_of_odd_tables(spark, documents):
    assert simhash.simhash_query(documents([])).count() == 0
    assert simhash.simhash_dedup(documents([])).count() == 0
    d = spark.createDataFrame([(1, "a b c d", 5, 6, 7), (1, "a b c d", 5, 6, 7), (None, None, 1, 1, 1), (4, "", 2, 2, 2)], "doc_id long, text string, __id int, row int, whole int")
    kept = simhash.simhash_dedup(d)
    assert kept.columns == d.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "a b c d", 5, 6, 7), (4, "", 2, 2, 2)]
    assert sorted((r.doc_id is None, r.component_id) for r in simhash.simhash_query(d).collect()) == [(False, 1), (False, 1), (False, 4), (True, 4)]


def test_simhash_links_all_distances(spark):
    r = random.Random(1)
    base = r.getrandbits(64)
    prints = {base} | {base ^ sum(1 << b for b in r.sample(range(64), d)) for d in (1, 2, 3, 4, 5) for _ in range(60)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {(x.a, x.b) for x in simhash.fingerprint_links(spark.createDataFrame([(signed(p),) for p in prints], "fp long")).collect()}
    s = [signed(p) for p in prints]
    want = {(a, b) for a in s for b in s if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert got == want
    with pytest.raises(ValueError, match="distances"):
        simhash.fingerprint_links(spark.createDataFrame([(1,)], "fp long"), distance=4)


def brute_removed(rows, length):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_suffix_dedup(documents, odd, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 100)
    r = random.Random(9)
    shared = [" ".join(words(90, 100 + k)) for k in range(3)]
    rows = [(100 + k, " ".join(words(30, k)) + " " + r.choice(shared)[: r.randint(380, 600)] + " " + " ".join(words(r.randint(0, 90), 50 + k))) for k in range(20)]
    rows += [(200, rows[0][1]), (201, shared[0] + " middle " + shared[0]), (202, "ab" * 700), (203, "a" * 399), (204, "b" * 400), (205, "c" * 401)]
    docs, more = odd
    rows += more
    got = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.suffix_dedup_query(documents(rows)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(brute_removed(rows, 400), key=key)


@pytest.mark.parametrize("short", [0, 1 << 15])
def test_suffix_arrays(monkeypatch, short):
    monkeypatch.setattr(suffix_dedup, "SHORT", short)
    r = random.Random(4)
    for _ in range(300):
        t = [r.randint(1, r.choice([1, 2, 26])) for _ in range(r.randint(0, 40))] + [0]
        sa = suffix_dedup.suffix_array(np.array(t))
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = suffix_dedup.permuted_lcp(np.array(t), sa, 5, 4)
        for x, y in zip(sa, sa[1:], strict=False):
            n = 0
            while max(x, y) + n < len(t) and t[x + n] == t[y + n]:
                n += 1
            assert min(lcp[y], 5) == min(n, 5)


def test_suffix_dedup_of_nothing(documents):
    assert suffix_dedup.suffix_dedup_query(documents([])).count() == 0


@pytest.mark.parametrize("values", [5, 50, 10**9])
def test_compact_windows_hold_each_stretch_once(values):
    r = np.random.default_rng(2)
    for n, width in ((120, 20), (20, 20), (19, 20), (60, 1)):
        s = r.integers(0, values, n).astype(np.uint64)
        value, first, place, last = compact_windows.compact_windows(s, width, 7)
        h = compact_windows.mixed(s, 7)
        for i in range(n):
            for j in range(i + width - 1, n):
                inside = np.flatnonzero((first <= i) & (i <= place) & (place <= j) & (j <= last))
                assert len(inside) == 1
                assert value[inside[0]] == h[i : j + 1].min()
        assert all(last - first + 1 >= width)


def varied(passage, changes, seed):
    r, out = random.Random(seed), list(passage)
    for _ in range(changes):
        out[r.randrange(len(out))] = "".join(r.choice("qrstuv") for _ in range(6))
    return out


@pytest.mark.parametrize("bundled", [False, True])
def test_passage_classes_equal_all_pairs(documents, monkeypatch, bundled):
    """Groups of 8 variants around similarity 0.8, beside texts that share a phrase too short to count with all of them."""
    groups, size = (40, 8) if not bundled else (6, 40)
    rows = []
    for g in range(groups):
        passage, phrase = words(75, 900 + g), words(14, 5)
        for k in range(size):
            seed = 1000 * g + k
            rows.append((seed, " ".join(words(40, 7 * seed + 1) + phrase + varied(passage, k % 4 if bundled else k % 5, seed) + words(50, 7 * seed + 2))))
    shingled = {i: compact_windows.shingles(t) for i, t in rows}
    want, true = Groups(shingled), set()
    for a in shingled:
        for b in shingled:
            if b < a and a // 1000 == b // 1000 and compact_windows.matching_passages(shingled[a], shingled[b], 46):
                want.join(a, b)
                true.add((a, b))
    got = compact_windows.passage_query(documents(rows)).collect()
    links = {(r.doc_id, r.other_id) for r in got}
    assert links <= true
    assert bundled or len(links) >= 0.9 * len(true)
    found = Groups(shingled)
    for a, b in links:
        found.join(a, b)
    classes = [(want.find(i), found.find(i)) for i in shingled]
    assert sum(a != b for a, b in classes) <= 0.02 * len(classes)
    assert all(r.component_id == found.find(r.doc_id) for r in got)


def test_passages(documents, odd):
    passage = words(70, 1)
    near = passage[:33] + ["changed"] + passage[34:]
    rows = [(k, " ".join(words(80, 10 + k) + (near if k % 2 else passage) + words(60, 40 + k))) for k in range(8)]
    rows += [(20, " ".join(words(200, 90))), (21, " ".join(words(100, 91) + passage[:40])), (22, " ".join(words(60, 92)).upper()), (23, " ".join(words(60, 92)))]
    docs = documents(rows + [(i + 300 if i is not None else None, t) for i, t in odd[1]])
    got = compact_windows.passage_query(docs).collect()
    found = {r.doc_id for r in got if r.doc_id is not None and r.doc_id < 300}
    assert found == {1, 2, 3, 4, 5, 6, 7, 23}
    assert all(r.component_id == 0 for r in got if r.doc_id is not None and r.doc_id < 8)
    assert all(r.other_id < r.doc_id or r.other_id == r.doc_id == 305 for r in got)  # 305 says one word over and over
    exact = [r for r in got if r.doc_id in (2, 4, 6) and r.other_id == 0]
    assert exact
    assert all(r.start_word <= 80 and r.start_word + r.n_words >= 150 and r.n_words >= 50 for r in exact)
    left = {r.doc_id: r for r in compact_windows.passage_dedup(docs).collect() if r.doc_id is not None and r.doc_id < 300}
    assert 23 not in left  # all of it repeats document 22
    assert left[0].text == rows[0][1]
    assert left[20].text == rows[8][1]
    assert not set(passage[5:60]) & set(left[2].text.split())
    assert left[2].n_chars == len(left[2].text)
    assert set(words(70, 12)) <= set(left[2].text.split())
    assert compact_windows.passage_dedup(docs).columns == docs.columns
    assert compact_windows.passage_query(documents([])).count() == 0


def grouped_rows(seed=1):
    """Sorted rows (key, th, at, to) of groups of 1 to 60 texts, some with several windows, some rows twice."""
    r, rows = random.Random(seed), []
    for key in range(40):
        for th in r.sample(range(-500, 500), r.choice([1, 2, 5, 10, 11, 12, 60])):
            windows = [(key, th, r.randrange(1 << 40), r.randrange(1 << 40)) for _ in range(r.choice([1, 1, 1, 3]))]
            rows += windows * r.choice([1, 1, 2])
    return sorted(rows)


def pairs_by_hand(rows):
    groups, out = {}, set()
    for key, th, at, to in sorted(set(rows)):
        groups.setdefault(key, {}).setdefault(th, []).append((at, to))
    for texts in groups.values():
        order = sorted(texts)
        for k, th in enumerate(order):
            large = len(order) > compact_windows.SMALL
            near = {order[j] for j in (range(k) if not large else {j for j in (*range(compact_windows.FIRST), k - 1) if 0 <= j < k})}
            out |= {(th, o, at, to) for o in near for at, to in texts[th]}
            out |= {(th, th, at, to) for at, to in texts[th][1:]}
    return out


@pytest.mark.parametrize("held", [1 << 20, 15])
@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_candidates_of_groups(monkeypatch, held, size):
    monkeypatch.setattr(compact_windows, "HELD", held)
    rows = grouped_rows()
    batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[k : k + size])], names=["key", "th", "at", "to"]) for k in range(0, len(rows), size)]
    assert {tuple(x.values()) for b in compact_windows._group_pairs(iter(batches)) for x in b.to_pylist()} == pairs_by_hand(rows)


def test_rows_do_not_depend_on_partitions(spark, documents):
    """Copies, near copies, groups of two to forty, null ids and repeats inside texts: the same rows from 1, 7 and 24 partitions, and from small batches."""
    rows = []
    for g in range(8):
        passage = words(80, 300 + g)
        rows += [(100 * g + k, " ".join(words(30, 50 * g + k) + varied(passage, k % 6, 7 * g + k) + words(20, 90 * g + k))) for k in range((2, 3, 5, 9, 11, 12, 24, 40)[g])]
    rows += [(2000 + k, rows[k % 5][1]) for k in range(30)] + [(None, rows[9][1]), (None, " ".join(words(60, 1) * 2)), (3000, "a " * 400)]
    found = set()
    for n, batch in ((1, "10000"), (7, "10000"), (24, "10000"), (5, "3")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            found.add(tuple(sorted(map(str, compact_windows.passage_query(documents(rows).repartition(n)).collect()))))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 1 and len(next(iter(found))) > 80


def test_passages_with_recurring_phrases():
    width, one = 46, lambda t: compact_windows.shingles(" ".join(t))
    passage, filler, phrase = words(60, 1), words(1400, 2), words(7, 3)
    texts = [
        (words(30, 4) + passage + words(30, 5), passage[25:35] + filler + passage + words(20, 6)),
        (passage[:30] + phrase + passage[30:], phrase + filler[:90] + phrase + passage[:30] + phrase + passage[30:]),
        (passage[:50], passage[28:34] + filler[:100] + passage[:25] + ["two", "more"] + passage[25:]),
        (["x"] * 80 + filler[:60], filler[60:90] + ["x"] * 70),
        (passage, filler[:200] + passage[10:30]),
    ]
    for first, second in texts:
        a, b = one(first), one(second)
        stretches = [set(b[y : y + n].tolist()) for n in range(width, 58) for y in range(len(b) - n + 1)]
        want = set()
        for s in range(len(a) - width + 1):
            x = set(a[s : s + width].tolist())
            if any(5 * len(x & y) >= 4 * len(x | y) for y in stretches):
                want |= set(range(s, s + width))
        assert {k for i, j, _, _ in compact_windows.matching_passages(a, b, width) for k in range(i, j)} == want
        both = np.concatenate([b, a])  # and inside one text, by all places
        want = set()
        for s in range(len(both) - width + 1):
            x = set(both[s : s + width].tolist())
            if any(5 * len(x & y) >= 4 * len(x | y) for n in range(width, 58) for y in (set(both[k : k + n].tolist()) for k in range(s - n + 1))):
                want |= set(range(s, s + width))
        assert {k for i, j, _, _ in compact_windows.matching_passages(both[:400], None, width) for k in range(i, j)} <= want
        if len(both) < 400:
            assert {k for i, j, _, _ in compact_windows.matching_passages(both, None, width) for k in range(i, j)} == want


def test_passage_whose_smallest_shingles_stand_earlier_too(documents):
    passage = words(50, 1)
    first = words(70, 2) + passage + words(70, 3)
    s = compact_windows.shingles(" ".join(first))
    places = [k for salt in compact_windows._SALTS for k in sorted(compact_windows.compact_windows(s, 46, salt)[2].tolist()) if 70 <= k <= 115]
    early = [w for k, at in enumerate(places * 3) for w in words(150, 100 + k) + first[at : at + 5]]
    rows = [(1, " ".join(first)), (2, " ".join(early + words(60, 4) + passage + words(60, 5)))]
    got = compact_windows.passage_query(documents(rows)).collect()
    assert [(r.doc_id, r.other_id) for r in got] == [(2, 1)]
    assert got[0].start_word <= len(early) + 60 <= len(early) + 110 <= got[0].start_word + got[0].n_words


def test_passages_further_up_in_the_same_text_and_copies(documents):
    passage = words(60, 1)
    rows = [(1, " ".join(words(50, 2) + passage + words(50, 3) + passage + words(50, 4))), (2, " ".join(words(80, 5))), (3, " ".join(words(80, 5))), (None, " ".join(words(80, 5))), (5, "too short"), (6, "too short")]
    got = {(r.doc_id, r.other_id): r for r in compact_windows.passage_query(documents(rows)).collect()}
    assert set(got) == {(1, 1), (3, 2), (None, 2)}
    assert abs(got[1, 1].start_word - 160) <= 12 and abs(got[1, 1].other_start_word - 50) <= 12
    assert (got[3, 2].start_word, got[3, 2].n_words, got[3, 2].component_id) == (0, 80, 2)
    left = {r.doc_id: r.text for r in compact_windows.passage_dedup(documents(rows + rows[1:2])).collect()}
    assert set(left) == {1, 2, 5, 6}
    assert left[1].split().count(passage[30]) == 1


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_pairs_agree_across_batches(size):
    names = ["th", "other_th", "at", "to"]
    window = lambda f: (10 << 32 | 40, 99 << 8 | f)
    pairs = [((5, -1), [0, 0, 2]), ((5, 1), [1, 1, 1, 1]), ((5, 7), [3, 1]), ((6, 6), [0]), ((6, 7), [0, 1, 2, 3, 0])]
    rows = [(*pair, *window(f)) for pair, functions in pairs for f in functions]
    batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[k : k + size], strict=True)], names=names) for k in range(0, len(rows), size)]
    empty = batches[0].slice(0, 0)
    found = [tuple(r.values()) for b in compact_windows._agreed_pairs(iter([empty, *batches, empty]), 46, 2) for r in b.to_pylist()]
    assert found == [(5, -1), (5, 7), (6, 7)]
    assert not list(compact_windows._agreed_pairs(iter([empty]), 46, 2))


def test_windows_agree_on_a_stretch():
    def agree(*windows):
        at, to = zip(*((a << 32 | m, b << 8 | f) for a, m, b, f in windows), strict=True)
        return compact_windows._agreeing(np.array(at), np.array(to), 46, 2)

    assert agree((0, 20, 80, 0), (10, 50, 90, 1))
    assert agree((0, 20, 80, 0), (500, 520, 560, 1), (490, 530, 555, 0))
    assert not agree((0, 20, 80, 0), (10, 50, 90, 0))  # one function
    assert not agree((0, 20, 80, 0), (30, 50, 90, 1))  # no stretch of the second holds the first's place
    assert not agree((0, 20, 54, 0), (10, 50, 90, 1))  # 45 in common


def brute_links(rows, cosine=0.9):
    """One (id, n_links, component, kept) per row."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    g, n = Groups(range(len(rows))), np.zeros(len(rows), int)
    for d in {len(rows[k][1]) for k in range(len(rows)) if good[k]}:
        at = [k for k in range(len(rows)) if good[k] and len(rows[k][1]) == d]
        m = np.stack([np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in at])
        near = m @ m.T >= cosine
        n[at] = near.sum(1) - 1
        for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            g.join(at[a], at[b])
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(g.find(k), []).append(i)
    name = {k: min((i for i in ids if i is not None), default=None) for k, ids in least.items()}
    return [(i, int(n[k]), name[g.find(k)], name[g.find(k)] is None or i == name[g.find(k)]) for k, (i, _) in enumerate(rows)]


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "BLOCK", 64)
    r = np.random.default_rng(5)
    rows = [(k, r.normal(size=16).tolist()) for k in range(60)]
    centre = r.normal(size=16)
    rows += [(1000 + k, (centre + 0.05 * r.normal(size=16)).tolist()) for k in range(90)]
    rows += [(2000 + k, rows[3][1]) for k in range(50)] + [(3000, (2 * np.array(rows[3][1])).tolist())]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [None] + [1.0] * 15), (5003, [float("nan")] + [1.0] * 15), (5005, []), (5006, [float("inf")] + [1.0] * 15)]
    rows += [(6000, [1.0] * 8), (6001, [1.0] * 8), (6002, [1.0] * 7 + [2.0]), (6003, [1.0] + [0.0] * 7)]  # another length
    rows += [(7, rows[7][1]), (7, r.normal(size=16).tolist()), (None, rows[9][1]), (None, None), (None, [0.0] * 16)]  # ids that repeat or are null
    rows += [(None, (2 * centre).tolist()), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links int, good string")
    got = [(x.vec_id, x.n_links, x.component_id, x.kept) for x in pq_dedup.embedding_groups(df).collect()]
    key = lambda x: tuple((y is None, y or 0) for y in x)
    assert sorted(got, key=key) == sorted(brute_links(rows), key=key)
    assert pq_dedup.embedding_groups(df.where("vec_id < 0")).count() == 0


def test_embedding_recall_with_many_lists_and_a_dense_group(spark):
    """Far more lists than probes: pairs at all cosines from 0.9 on, and a third of the rows in one dense group."""
    r = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(r.normal(size=(4000, 64)))
    noise = unit(r.normal(size=(2000, 64)))
    tilt = r.uniform(0.0, 0.46, size=(2000, 1))
    dense = unit(unit(r.normal(size=64)) + 0.03 * r.normal(size=(2000, 64)))
    x = np.concatenate([base, unit(base[:2000] + tilt * noise), dense]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert len(x) / pq_dedup.LIST_ROWS > 32
    got = {t.vec_id: t.n_links for t in pq_dedup.embedding_groups(df).collect()}
    m = unit(x.astype(float))
    want = (m @ m.T >= 0.9).sum(1) - 1
    n = np.array([got[k] for k in range(len(x))])
    assert (n <= want).all()
    assert want[:6000].sum() > 3000
    assert want[6000:].sum() > 1_000_000
    print("recall of pairs", n[:6000].sum() / want[:6000].sum(), "of the dense group", n[6000:].sum() / want[6000:].sum())
    assert n[:6000].sum() >= 0.95 * want[:6000].sum()
    assert n[6000:].sum() >= 0.95 * want[6000:].sum()
