"""Operators 1, 2, 8 and 9."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tessera.llm import merge_dropout, packing, sharding, token_files
from tessera.llm.bpe import Encoder, vocabulary_path

from .conftest import words

Tokenizer = pytest.importorskip("tokenizers").Tokenizer


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library(library):
    r = random.Random(7)
    texts = ["".join(r.choice(" \n\t ab'sé9.,,  \n\xa0!s字<|>") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += [f"some{a}<|endoftext|>{b}words" for a in ("", " ", "  ", "\n", "<|endoftext|>") for b in ("", " ", " \n")] + ["x " * 60_000]
    assert any(50256 in library(t) for t in texts)
    code = Encoder(vocabulary_path(), max_units=500)
    for k in range(0, len(texts), 300):
        for text, ids in zip(texts[k : k + 300], code.encode(texts[k : k + 300]), strict=True):
            assert ids.tolist() == library(text)


def test_token_files(spark, odd, library):
    docs, rows = odd
    got = sorted(((r.doc_id is not None, r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_files_query(spark, docs).collect())
    want, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = [*library(text), 0]
        want.append(((doc is not None, doc), at, len(ids), crc(ids)))
        at += len(ids)
    assert got == sorted(want)


def test_sequences_are_equal_length_and_masked(spark, documents, tmp_path, library):
    docs = documents([(k, " ".join(words(300, k))) for k in range(20)])
    shards = token_files.write_token_files(docs, f"file://{tmp_path}/t", shards=2, sequence=64).collect()
    stream = {r.shard: np.concatenate([ids[mask] for ids, mask in token_files.sequences(r.path)]) for r in shards}
    whole = [x for k in range(20) for x in [*library(" ".join(words(300, k))), 0]]
    assert np.concatenate([stream[k] for k in sorted(stream)]).tolist() == whole
    assert all(ids.shape[1] == 64 for r in shards for ids, _ in token_files.sequences(r.path))
    assert token_files.sequence(shards[0].path, 3).tolist() == stream[shards[0].shard][192:256].tolist()
    assert not token_files.sequence(shards[0].path, 3).flags.owndata  # the file's memory
    assert token_files.mask(shards[0].path, 3).all()
    n = len(stream[shards[0].shard])
    assert token_files.mask(shards[0].path, n // 64).tolist() == [k < n % 64 for k in range(64)]


def test_sharding_replaces_columns_of_its_names(spark):
    d = spark.createDataFrame([(1, "mine", 7)], "k long, shard_name string, shard_slot int")
    out = sharding.assign_shards(d, "k")
    assert sorted(out.columns) == ["k", "shard_id", "shard_name", "shard_slot"] and out.first().shard_name.startswith("shard-")


def test_empty_tables(spark, documents):
    none = documents([])
    assert token_files.token_files_query(spark, none).count() == 0
    assert packing.pack(none).count() == 0
    assert merge_dropout.encode_with_dropout(none).count() == 0
    assert sharding.sharding_query(none).count() == 0


def test_packing(odd, documents, library):
    docs, rows = odd
    docs = docs.unionByName(documents([(100 + k, " ".join(words(40 * k, k))) for k in range(30)]))
    out = packing.pack(docs).collect()
    texts = {**dict(rows), **{100 + k: " ".join(words(40 * k, k)) for k in range(30)}}
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, parts in by_doc.items():
        ids = [*library(texts[doc]), 0]
        copies = 2 if doc == 5 else 1
        assert sum(p.length for p in parts) == copies * len(ids)
        assert all(p.ids == ids[p.start : p.start + p.length] and p.ids_crc32 == crc(p.ids) and p.doc_tokens == len(ids) for p in parts)
        assert sorted({i for p in parts for i in range(p.start, p.start + p.length)}) == list(range(len(ids)))
    assert set(by_doc) == set(texts)
    for members in by_sequence.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY


def test_pieces_cover_and_classes_fill():
    for n in range(1, 4000):
        assert sum(packing.pieces(n)) == n
    bins = packing.Bins(0)
    placed = [x for _ in range(64) for x in bins.put((60,))]
    assert max(len([1 for s, _, _ in placed if s == k]) for k in {s for s, _, _ in placed}) == 1024 // 60


def test_packing_leaves_little_padding(spark, documents):
    docs = documents([(k, " ".join(words(20 + 13 * k % 700, k))) for k in range(300)]).repartition(2)
    rows = packing.pack(docs, with_ids=False).groupBy("sequence_id").sum("length").collect()
    total = sum(r[1] for r in rows)
    assert total > 100_000
    assert len(rows) * 1024 - total < 0.02 * total + 2 * 1024  # two tasks, a part-filled sequence or two each


def brute_table(names, size):
    """Turns written out: each shard walks its own permutation of the slots and takes the first one that is free."""
    import hashlib

    def digest(name, key):
        return int.from_bytes(hashlib.blake2b(name.encode(), key=key, digest_size=8).digest(), "big")

    orders = [[(digest(n, b"offset") + j * (digest(n, b"skip") % (size - 1) + 1)) % size for j in range(size)] for n in names]
    owner, turn = {}, 0
    while len(owner) < size:
        k = turn % len(names)
        owner[next(slot for slot in orders[k] if slot not in owner)] = k
        turn += 1
    return [owner[slot] for slot in range(size)]


def test_lookup_table():
    names = [f"s{k}" for k in range(20)]
    table = sharding.lookup_table(names, 1009)
    assert table.tolist() == brute_table(names, 1009)
    n = np.bincount(table, minlength=20)
    assert n.max() - n.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = (table != fewer) & (table != 19)
    assert moved.mean() < 0.2
    assert sharding.lookup_table(["a", "b"], 3).tolist() == brute_table(["a", "b"], 3)
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(names, 1000)


def test_assign_shards(odd):
    docs, rows = odd
    out = sharding.assign_shards(docs.withColumnRenamed("n_words", "shard_id"), "doc_id").collect()
    assert len(out) == len(rows)
    assert len({r.shard_name for r in out if r.doc_id == 5}) == 1
    table = brute_table(["a", "b", "c"], 101)
    placed = {r.doc_id: r for r in sharding.assign_shards(docs, "doc_id", ["a", "b", "c"], 101).collect()}
    for doc, r in placed.items():
        h = 42 if doc is None else xxhash.xxh64_intdigest(int(doc).to_bytes(8, "little", signed=True), 42)  # of a null, Spark's hash is the seed
        slot = (h - (1 << 64) if h >> 63 else h) % 101
        assert (r.shard_slot, r.shard_id, r.shard_name) == (slot, table[slot], "abc"[table[slot]])


def test_sharding_query(odd):
    docs, rows = odd
    got = sharding.sharding_query(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes) for r in got) == sorted((i is None, i or 0, len((t or "").encode())) for i, t in rows)


def brute_dropout(codec, text, key, dropout, seed):
    """The agenda as it is defined: of all candidates that were not skipped, the best-ranked and then leftmost is taken."""
    m, a, b = (1 << 64) - 1, merge_dropout._A, merge_dropout._B
    sp = __import__("sentencepiece").SentencePieceProcessor(model_file=vocabulary_path(merge_dropout.MODEL))
    pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not sp.is_byte(i) and not sp.is_control(i) and not sp.is_unknown(i)}
    document = xxhash.xxh64_intdigest(b"%d" % key, seed)
    out = []
    units = re.findall("L|▁+[^▁L]*|[^▁L]+", (" " + text).replace("▁", "L").replace(" ", "▁")) if text else []
    for n, unit in enumerate(units):
        x = (document + n) & m
        x = (x ^ x >> 30) * b & m
        base = (x ^ x >> 27) * a & m
        parts, skipped = ["▁"] if unit == "L" else list(unit), set()
        while unit != "L":
            best = None
            place = 0
            for p, q in zip(parts, parts[1:], strict=False):
                if p + q in pieces and (place, p + q) not in skipped:
                    c = (-sp.get_score(pieces[p + q]), place, p + q)
                    best = min(best or c, c)
                place += len(p)
            if best is None:
                break
            x = base ^ (best[1] << 20 | pieces[best[2]]) * a & m
            x = (x ^ x >> 29) * b & m
            if (x ^ x >> 31) * a & m < int(dropout * 2**64):
                skipped.add(best[1:])
                continue
            place, k = 0, 0
            while place < best[1]:
                place, k = place + len(parts[k]), k + 1
            parts[k : k + 2] = [best[2]]
        for p in parts:
            out += [pieces[p]] if unit != "L" and p in pieces else [codec.byte[x] for x in p.encode("utf-8", "surrogatepass")]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_dropout_equals_the_agenda_written_out(dropout):
    r = random.Random(3)
    codec = merge_dropout.Codec(vocabulary_path(merge_dropout.MODEL), dropout, 11)
    texts = ["".join(r.choice("   \n\teeeaaattnnsrioéß字▁😀.,1") for _ in range(r.randint(0, 60))) for _ in range(120)]
    texts += [" ".join(words(60, 1)), "the " * 30, "", " ", "     " * 9, "▁", "▁▁ ▁", "internationalisation" * 20, "The quick, brown fox.\nNew  line"]
    keys = [r.randrange(10**6) for _ in texts]
    got = codec.encode_all(texts, keys)
    for text, key, ids in zip(texts, keys, got, strict=True):
        assert ids.tolist() == brute_dropout(codec, text, key, dropout, 11)
        assert codec.decode(ids) == text.encode()


def test_dropout_draws_are_even():
    """A tenth of the candidates of each kind is skipped, whatever was drawn for the others."""
    base = np.arange(200_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a = merge_dropout.draws(base, np.full(len(base), 3), np.full(len(base), 700)) < np.uint64(int(0.1 * 2**64))
    b = merge_dropout.draws(base, np.full(len(base), 4), np.full(len(base), 701)) < np.uint64(int(0.1 * 2**64))
    assert abs(a.mean() - 0.1) < 0.005
    assert abs((a & b).mean() - 0.01) < 0.002


def test_merge_dropout(odd):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=vocabulary_path(merge_dropout.MODEL))
    plain, varied = merge_dropout.Codec(vocabulary_path(merge_dropout.MODEL), dropout=0), merge_dropout.Codec(vocabulary_path(merge_dropout.MODEL))
    text = " ".join(words(200, 1)) + " The quick, brown fox.\nNew  line"
    assert plain.encode(text).tolist() == sp.encode(text)
    assert len({tuple(varied.encode(text, k).tolist()) for k in range(50)}) == 50
    assert len({tuple(varied.encode("international", k).tolist()) for k in range(300)}) > 8
    docs, rows = odd
    out = merge_dropout.encode_with_dropout(docs).collect()
    assert len(out) == len(rows)
    assert all(r.lossless for r in out)
    assert all(r.n_tokens == 0 for r in out if r.n_bytes == 0)
    for r in out:
        assert crc(r.ids) == r.ids_crc32
        assert r.ids in [varied.encode(t or "", i or 0).tolist() for i, t in rows if i == r.doc_id]
