"""Operators 4 and 6, and the pipeline."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from tessera.llm import chat, quality, simhash

from .conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    ws = WORD.findall(text)
    grams = list(zip(ws, ws[1:], ws[2:], strict=False))
    count, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_measures(documents, odd):
    docs, rows = odd
    rows = rows + [(60, "a b c d a b c d"), (61, "x x x x"), (62, " ".join(words(100, 1)) + "\n" + "l m\nl m\n l m"), (63, " ".join(words(30, 2) * 3)), (64, "é ü #$ |x| y")]
    got = quality.quality_query(documents(rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, *brute_measures(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def test_adaptive_fences(documents):
    clean = [(k, " ".join(words(120, k))) for k in range(80)]
    junk = [(100, " ".join(w + "$$$" for w in words(120, 500))), (101, "\n".join([" ".join(words(9, 1))] * 3 + [" ".join(words(60, 2))] + [" ".join(words(9, 1))] * 5))]
    # what is odd in one source is usual in another
    tables = [(1000 + k, " | ".join(words(120, 2000 + k))) for k in range(80)]
    docs = documents(clean + junk, source="plain").unionByName(documents(tables, source="tables"))
    kept = {r.doc_id for r in quality.quality_filter(docs).collect()}
    assert kept == {i for i, _ in clean + tables}
    assert quality.quality_filter(docs).columns == docs.columns
    assert {r.doc_id for r in quality.quality_query(docs).where("kept").collect()} == kept


def test_quality_of_nothing_and_null_groups(documents):
    assert quality.quality_query(documents([])).count() == 0
    lost = documents([(k, " ".join(words(80, k))) for k in range(5)], lang=None, source=None)
    assert quality.quality_query(lost).where("kept").count() == 5


def test_sketch_merges(documents):
    docs = documents([(k, " ".join(words(60 + k, k))) for k in range(40)])
    m = quality.quality_measures(docs)
    halves = quality.quality_sketch(m.where("__row.doc_id < 20")).unionByName(quality.quality_sketch(m.where("__row.doc_id >= 20")))
    merged = halves.groupBy("level", "lang", "source", "metric", "bucket").sum("n")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, quality.quality_sketch(m).select("level", "lang", "source", "metric", "bucket", "n").collect()))


def test_template_language():
    t = "{% set a = 'x' ~ 1 %}{{ a }}{% for m in messages %}{% if loop.first and not loop.last %}<{% endif %}{{ m['text'] | trim | upper }}{% if m.role != 'user' or false %}!{% else %}?{% endif %}{% endfor %}"
    text, spans = chat.compile_template(t)([{"role": "user", "text": " a "}, {"role": "bot", "text": "b"}])
    assert (text, spans) == ("x1<A?B!", [])
    assert chat.parse("{{ 'a' ~ 'b' }}c{% if 1 == 2 %}d{% elif true %}e{% endif %}") == [("text", "abce")]
    assert chat.parse("a {%- if true -%} b {%- endif -%} c") == [("text", "abc")]
    assert chat.parse("a  {{- 1 }} b {% if true -%}\n c{% endif %}") == [("text", "a1 b c")]
    for bad in ("{% if x %}", "{{ x.__class__() }}", "{% include 'x' %}", "{{ open('f') }}", "{{ x | evil }}", "{{ }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    for bad in ("{{ messages.append.x }}{{ loop }}{{ 'a'.b }}", "{{ nobody }}", "{{ messages[0] }}", "{{ messages[-1] }}", "{% for m in 'ab' %}{% endfor %}", "{% for m in 3 %}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)([])
    for bad in ("{{ 1 < 'a' }}", "{{ 1 + 'a' }}", "a {% if true", "{% endfor %}", "{% else %}", "{% for m of messages %}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_chat(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\", "\\[INST]", "[[]]<<>>", "", None, "é\n\\n", "[TURN x]"]
    rows = [(1, k, ("user", "assistant", "system", "tool]</s>", None)[k % 5], t) for k, t in enumerate(tricky * 2)]
    rows += [(2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 0, "user", "x"), (3, 1, "user", "later"), (3, None, "user", "first")]
    alone = [(None, 1, "assistant", "y"), (None, 0, "user", "x")]
    spread = chat.chat_query(spark.createDataFrame(alone * 3, "conv_id long, turn long, role string, text string")).where("conv_id is null").collect()
    assert sorted((r.n_turns, r.loss_chars) for r in spread) == [(1, 0)] * 3 + [(1, 1)] * 3
    got = {r.conv_id: r for r in chat.chat_query(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted")).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    convs = {}
    for c, turn, role, text in [*rows, (-1, 0, "user", tricky[0]), (-1, 1, "assistant", tricky[0])]:
        convs.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), digest(learnt))


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.chat_query(none).collect()] == [-1]


def test_pipeline(spark, documents, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    passage = words(60, 7)
    base = words(150, 8)
    rows = [(k, " ".join(words(100, 20 + k))) for k in range(60)]
    rows += [(100, " ".join(base)), (101, " ".join(base)), (102, " ".join(base[:40] + ["x"] + base[41:]))]
    rows += [(110, " ".join(words(90, 300) + passage)), (111, " ".join(words(90, 301) + passage)), (120, "short"), (121, None), (122, " ".join(w + "###" for w in words(90, 302)))]
    documents(rows).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    assert not kept & {101, 120, 121, 122}
    assert {*range(60), 100, 110, 111} <= kept
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    d = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns
    texts = {r.doc_id: r.text for r in d.collect()}
    assert set(texts) == kept
    assert " ".join(passage) in texts[110]
    assert passage[30] not in texts[111].split()
    unique = {r.doc_id for r in simhash.simhash_dedup(quality.quality_filter(docs)).collect()}
    whole_repeats = unique - kept
    assert whole_repeats <= {102}
