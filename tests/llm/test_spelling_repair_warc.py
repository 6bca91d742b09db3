"""Spelling variants, conversation repair and WARC archives against brute force, and on odd rows and damaged files."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import repair, spelling, warc

# ---------------------------------------------------------------- spelling


def edits(word, alphabet):
    out = {word[:k] + word[k + 1 :] for k in range(len(word))}
    out |= {word[:k] + x + word[k:] for k in range(len(word) + 1) for x in alphabet}
    return (out | {word[:k] + x + word[k + 1 :] for k in range(len(word)) for x in alphabet}) - {word}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abcé", max_size=5), max_size=40), st.text("abcé", max_size=5))
def test_trie_gives_each_neighbour_once(words, word):
    words = sorted(words - {""})
    trie = spelling.Trie(*spelling.Trie.arrays(words, [len(w) + 1 for w in words]))
    got = list(trie.neighbours(word))
    assert sorted(got) == sorted((w, len(w) + 1) for w in set(words) & edits(word, "abcé"))


def brute_spelling(docs):
    import re

    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    alphabet, form, near = set("".join(counts)), {}, {}
    for w, n in counts.items():
        near[w] = sorted(edits(w, alphabet) & set(counts), key=lambda o: (-counts[o], o))
        form[w] = near[w][0] if near[w] and counts[near[w][0]] >= 5 * n else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(rows)


def spelled(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_spelling_against_brute_force(documents, monkeypatch):
    r = random.Random(4)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randint(5, 8))) for _ in range(40)]
    base += [w[:3] + r.choice("abé") + w[4:] for w in base] + ["aaaaaaa", "aaaaaaaa", "ÀÿÀÿÀÿ×", "ÀÿÀÿÀÿ÷"]
    docs = [(k, " ".join(r.choices(base, weights=[5 ** (k % 4) for k in range(len(base))], k=300)).replace("b", r.choice("bB"))) for k in range(40)]
    docs += [(None, "Harmonic " * 9), (900, None), (901, ""), (902, "12 34"), (903, "z" * 100_000 + " "), (903, "z" * 100_000)] + [(904, "harmonc " * 5)] * 2
    docs += [(1000 + k, " ".join([w[k % 3 :] + x for w in ("gardens", "Rivière", "obelisk") for x, n in (("es", 200), ("ez", 36), ("emz", 6)) for _ in range(n)])) for k in range(3)]
    monkeypatch.setattr(spelling, "HELD", 50)
    monkeypatch.setattr(spelling, "SHARD_LETTERS", 60)
    monkeypatch.setattr(spelling, "BROADCAST_BYTES", 3000)  # several blocks
    got = spelled(spelling.spelling_query(documents(docs).repartition(5)))
    want = brute_spelling(docs)
    assert got == want
    assert sum(x[1] is not None for x in want) >= 10 and any(x[2] not in (x[0], x[1]) for x in want)


def test_spelling_of_nothing(documents):
    assert spelled(spelling.spelling_query(documents([]))) == []
    assert spelled(spelling.spelling_query(documents([(1, None), (2, "short words")]))) == []


def test_tries_stay_small(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_LETTERS", 500)
    words = spark.range(3000).selectExpr("lpad(conv(id, 10, 26), 8, 'q') as word", "5L as n")
    shards = spelling.trie_shards(words, 3).collect()
    assert len(shards) >= 3000 * 8 // 500
    assert max(len(s.labels.decode()) for s in shards) <= 501


# ---------------------------------------------------------------- repair


def brute_repair(turns, most=3):
    """(cost, audit, roles) over all edit sequences with at most `most` insertions in a row."""
    best = None
    sound = {""} | {s + "ua" * k for s in ("", "s") for k in range(1, 9)}
    fates = []
    for initial, fault in turns:
        extra = fault == "truncated"
        here = [("D", 3, "")]
        if fault not in ("blank", "duplicate"):
            here += [("K", extra, initial or "-"), ("R", 2 + extra, "u"), ("R", 2 + extra, "a")]
        fates.append(here)
    runs = [x for k in range(most) for x in itertools.product("ua", repeat=k)]
    for fate in itertools.product(*fates):
        for gaps in itertools.product(runs, repeat=len(turns) + 1):
            roles = "".join("".join(g) + f[2] for g, f in zip(gaps, fate)) + "".join(gaps[-1])
            if roles in sound:
                audit = "".join("I" * len(g) + f[0] for g, f in zip(gaps, fate)) + "I" * len(gaps[-1])
                found = (2 * sum(map(len, gaps)) + sum(f[1] for f in fate), audit, roles)
                best = found if best is None or found < best else best
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_edits_against_all_sequences(n):
    r = random.Random(n)
    kinds = [(x, f) for x in ("u", "a", "s", "t", "") for f in ("", "blank", "truncated")]
    for turns in itertools.product(kinds, repeat=n) if n < 2 else (r.choices(kinds, k=n) for _ in range(12 if n == 3 else 60)):
        cost, codes = repair.cheapest_edits(iter(turns))
        got = [x[2][:1] for x in repair.repaired_turns(codes, iter([(x, "") for x, _ in turns]))]
        assert (cost, "".join(codes), "".join(got)) == brute_repair(turns)


def plain_repair(turns):
    """(cost, audit) by a program that keeps the audit strings themselves."""
    step = {0: 1, 1: 2, 2: 1, 3: 1}  # 0 nothing, 1 user, 2 assistant, 3 system
    layer = {0: (0, "")}
    inserted = lambda layer: {end: min((c + 2 * k, a + "I" * k) for s, (c, a) in layer.items() for k in range(4) if (s if k == 0 else (step[s] if k == 1 else (step[step[s]] if k == 2 else step[step[step[s]]]))) == end) for end in range(4) if any(end in (s, step[s], step[step[s]]) for s in layer)}
    for initial, fault in turns:
        found = {}
        for s, (c, a) in inserted(layer).items():
            options = [(s, 3, "D")]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                options.append((step[s], 2 + extra, "R"))
                options += [(step[s], extra, "K")] * (initial == ("a" if step[s] == 2 else "u"))
                options += [(3, extra, "K")] * (initial == "s" and s == 0 and not a.endswith("I"))
            for end, price, letter in options:
                found[end] = min(found.get(end, (99**9, "")), (c + price, a + letter))
        layer = found
    return min(x for s, x in inserted(layer).items() if s in (0, 2))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["u", "a", "s", "x"]), st.sampled_from(["", "", "blank", "duplicate", "truncated"])), max_size=30))
def test_edits_against_whole_strings(turns):
    cost, codes = repair.cheapest_edits(iter(turns))
    assert (cost, "".join(codes)) == plain_repair(turns)


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


ROWS = [
    (1, 0, "system", "Rules."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."), (1, 9, "user", "Hi?"),
    (2, None, "user", "a."), (2, None, None, None), (2, 4, "assistant", "cut"), (2, 4, "tool", "x!"),
    (3, 5, "assistant", " \t"), (None, 1, "assistant", "b."), (None, 2, "user", "c?\n "), (4, 1, "", "é." * 50_000), (4, 2, "assistant", "\xa0"),
]


def test_repair_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, "x", 7) for r in ROWS], "conv_id long, turn long, role string, text string, kind string, cost int").repartition(3)
    ids = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 5, 5, None)], "conv_id long")
    got = {r.conv_id: r for r in repair.repair_summaries(df, ids).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for conv in (1, 2, 3, 4, None, 5):
        rows = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ROWS if c == conv]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        faults, g = faults_of(rows), got[conv]
        cost, codes = repair.cheapest_edits(iter([(r[:1], f) for (_, r, _), f in zip(rows, faults)]))
        turns = [t for t, _, _ in rows if t is not None]
        lines = [f"{role}:{text}" for _, _, role, text in repair.repaired_turns(codes, iter([(r, x) for _, r, x in rows]))]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        assert (g.gaps, g.cost, g.audit) == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, cost, "".join(codes))
        assert (g.blank, g.duplicate, g.truncated, g.illegal) == (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs))
        assert g.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        kept = [(r.edit, r.role, r.text) for r in repair.repair_conversations(df).where("conv_id <=> " + ("null" if conv is None else str(conv))).orderBy("place").collect()]
        assert [f"{role}:{text}" for _, role, text in kept] == lines
        assert "".join(e for e, _, _ in kept) == g.audit.replace("D", "")
    assert repair.repair_summaries(df.limit(0), ids.limit(0)).count() == 0


def test_repair_of_one_hot_conversation(spark):
    """A conversation that holds nearly all rows, half of them one repeated turn."""
    df = spark.range(60_000).selectExpr("if(id % 500 = 0, id, -1) as conv_id", "id div 2 as turn", "if(id % 2 = 0, 'user', 'tool') as role", "if(id % 2 = 0, concat('q', id, '?'), 'same') as text")
    g = repair.repair_summaries(df).where("conv_id = -1").first()
    rows = [("user"[:1] if k % 2 == 0 else "t", "" if k % 2 == 0 else "truncated" if k == 1 else "duplicate") for k in range(60_000) if k % 500]
    want = []  # rows of a turn go by role: tool before user
    for k in range(0, 60_000, 2):
        want += [x for x in ((("t", "truncated" if k == 0 else "duplicate")), (("u", "") if k % 500 else None)) if x]
    cost, codes = repair.cheapest_edits(iter(want))
    assert len(rows) == len(want)
    assert (g.cost, g.audit) == (cost, "".join(codes))


def test_damage_is_the_hash_alone(spark):
    rows = [(c, t, "assistant", "Is it? No. Yes!") for c in range(30) for t in range(8)] + [(None, 3, None, None), (7, None, "user", "x.")]
    got = Counter(tuple(r) for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if h:
            want[(c, t, "user" if h == 4 else role, "" if h == 1 else "Is it No Yes" if h == 2 and text[0] == "I" else text.replace(".", "") if h == 2 else text)] += 1 + (h == 3)
    assert got == want


# ---------------------------------------------------------------- warc


def packed(data):
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def some_records(n=40):
    payloads = [(f"<p>{k}</p>é" * (k * 7 % 90)).encode() for k in range(n)]
    return [warc.record_bytes(k, f"http://x.org/{k}", p, hashlib.sha256(p).hexdigest(), refers_to=0 if k == 9 else None) for k, p in enumerate(payloads)]


def read(data):
    rows = list(warc.salvage(pa.BufferReader(data)))
    assert [r[0] for r in rows if r[0]] == sorted(r[0] for r in rows if r[0])
    return [r[2].headers["warc-record-id"] for r in rows if r[2]], [(a, b, why) for a, b, r, why in rows if r is None], rows


NAMES = [f"<urn:page:{k}>" for k in range(40)]


@pytest.mark.parametrize("pack", [packed, bytes, lambda x: packed(x) if len(x) % 2 else x], ids=["gzip", "plain", "mixed"])
def test_whole_archives(pack):
    names, gaps, rows = read(b"".join(map(pack, some_records())))
    assert (names, gaps) == (NAMES, [])
    assert rows[9][2].kind == "revisit" and rows[9][2].payload == b""
    assert read(b"") == ([], [], [])


@pytest.mark.parametrize("pack", [packed, bytes], ids=["gzip", "plain"])
@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_damage_costs_only_the_records_it_hits(pack, chunk, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    parts = [pack(r) for r in some_records()]
    starts = [0, *itertools.accumulate(map(len, parts))]
    whole = b"".join(parts)
    r = random.Random(1)
    for k in (0, 7, 20, 39):
        flip = starts[k] + (r.randrange(len(parts[k]) // 3, len(parts[k]) - 6) if pack is packed else len(parts[k]) - r.randrange(5, 50))
        names, gaps, _ = read(whole[:flip] + bytes([whole[flip] ^ 0x55]) + whole[flip + 1 :])
        assert names == NAMES[:k] + NAMES[k + 1 :]
        assert [g[:2] for g in gaps] == [(starts[k], starts[k + 1])]
    names, gaps, _ = read(whole[: starts[12]] + b"\0" * 999 + whole[starts[12] :])
    assert names == NAMES and [g[:2] for g in gaps] == [(starts[12], starts[12] + 999)]
    names, gaps, _ = read(whole[: starts[5] + 40] + whole[starts[8] :])  # a record cut off, two lost
    assert names == NAMES[:5] + NAMES[8:] and [g[:2] for g in gaps] == [(starts[5], starts[5] + 40)]
    names, gaps, _ = read(whole[:-9])
    assert names == NAMES[:-1] and gaps[0][:2] == (starts[39], len(whole) - 9)
    names, gaps, _ = read(b"no archive \x1f\x8b\x08 WARC/1.0 at all")
    assert names == [] and gaps[0][:2] == (0, len(b"no archive \x1f\x8b\x08 WARC/1.0 at all"))


def test_a_member_of_several_records():
    records = some_records(4)
    bad = bytearray(records[1])
    bad[-20] ^= 1
    names, gaps, rows = read(packed(records[0] + bytes(bad) + records[2]) + packed(records[3]))
    assert names == [NAMES[0], NAMES[2], NAMES[3]]
    assert [g[2] for g in gaps] == ["block digest"]


def test_foreign_digests_and_folded_headers():
    block = b"hello"
    sha1 = "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"  # none of this block
    head = lambda d: b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:a:b>\r\nX: a\r\n b\r\nWARC-Block-Digest: " + d + b"\r\nContent-Length: 5\r\n\r\n" + block + b"\r\n\r\n"
    import base64

    good = b"sha1:" + base64.b32encode(hashlib.sha1(block).digest())
    assert read(head(good))[0] == ["<urn:a:b>"] and read(head(b"crc9:00"))[0] == ["<urn:a:b>"]
    assert read(head(good))[2][0][2].headers["x"] == "a b"
    assert read(head(b"sha1:" + sha1.encode()))[1][0][2] == "block digest"


PAGES = [(5, "http://a/\r\nWARC/1.1", "x" * 200), (3, None, "x" * 200), (3, "http://b/é", "x" * 200), (8, "u", "x" * 200), (9, "u", "short"), (10, "u", "short"), (11, "u", None), (12, "u", ""), (None, "u", "x" * 200), (13, "u", "WARC/1.1\r\n\r\n" * 50), (14, "u", "é" * 50), (15, "u", "é" * 50), (16, "u", "y" * 3_000_000)]


def expected_pages(rows):
    out = []
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    for page, _, html in rows:
        size, same = len((html or "").encode()), [p for p, _, h in rows if p is not None and digest(h) == digest(html)]
        first = min(same, default=None) if size >= 100 else None
        again = first is not None and page != first
        out.append((page, size, digest(html), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [0, 250_000])
def test_pages_come_back(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", broadcast)
    pages = spark.createDataFrame([(*r, 1, "x") for r in PAGES], "page_id long, url string, html string, start int, digest string").repartition(3)
    got = [tuple(r) for r in warc.warc_query(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == expected_pages(PAGES)
    assert warc.warc_query(pages.limit(0)).count() == 0


def test_archives_roll_and_gaps_are_rows(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    archives = warc.write_warc(warc.with_revisits(pages), f"file://{tmp_path}/a", archive_bytes=500)
    paths = [r.path for r in archives.collect()]
    assert len(paths) > 2
    (tmp_path / "a" / "stray.warc.gz").write_bytes(b"left by a lost attempt")
    name = paths[0].removeprefix("file://")
    data = open(name, "rb").read()
    open(name, "wb").write(data[:50] + b"????" + data[54:])
    rows = warc.read_warc(archives).collect()
    gaps = [r for r in rows if r.gap is not None]
    assert len(gaps) == 1 and gaps[0].path == paths[0] and gaps[0].start == 0
    assert sum(r.warc_type is not None for r in rows) == len(PAGES) - 1
    assert {r.payload.decode() for r in rows if r.payload is not None and r.record_id in ("<urn:page:9>", "<urn:page:16>")} >= {"y" * 3_000_000}
    assert all(r.payload is None for r in rows if r.warc_type == "revisit")
