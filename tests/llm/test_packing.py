"""Packing: exact pieces of the library's ids, windows mixed to the targets."""

import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from shelfscope.llm import packing as P
from shelfscope.llm.queries import vocabulary


@pytest.fixture(scope="module")
def path():
    return vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def expected(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = ["", None, " ", "it's we'll   they'RE", "á ́b Å", "x\x0by\x0cz\x1cw\x85v\xa0u　t s", "ΑΣ ΑΣ. Σ",
         "<|endoftext|> a<|endoftext|>b <|startoftext|>", "12345 3.14 §§--", "İstanbul ǅ ß", "퟿\U0001f600\U0001f600",
         "日本語 テキスト 한국어", "A" * 5000, "\x00\x01﻿ ée", "don't\tstop\r\nnow", "''s 's' 't",
         "A<|ENDOFTEXT|> Word$$$.,x (Été)! été×÷ñ.Ñ", "naïve's; ΑΣ,b", "a.b,c;d'll'd<|", "ÀÖØöøÿ½ª.º"]


def test_ids_are_the_librarys(path, tokenizer):
    rng = random.Random(1)
    texts = list(TEXTS)
    for alphabet in ("ab'sSΣé ́\t\n\x0b\x1f\x85\xa0<|>1٣½．", "abcdESTilrvm''É.,$&!  \n1-×"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    coder = P.WordCoder(path, 1, np.uint16, store_bytes=2000)      # forgets again and again
    for at in range(0, len(texts), 10):
        for text, ids in zip(texts[at:at + 10], coder.ids(texts[at:at + 10])):
            assert ids.tolist() == expected(tokenizer, text), repr(text)


def check(rows, docs, tokenizer, length):
    """Every id of every row in exactly one piece; windows gapless, full or of a power of two."""
    per_doc, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    texts = defaultdict(list)
    for d in docs:
        texts[d["doc_id"]].append(expected(tokenizer, d["text"]))
    assert set(per_doc) == set(texts)
    for doc, pieces in per_doc.items():
        want = []
        for ids in texts[doc]:
            want += [(k, i, len(ids)) for k, i in enumerate(ids)]
        assert sum(p["length"] for p in pieces) == len(want)
        if len(texts[doc]) == 1:
            ids, at = np.array(texts[doc][0], "<u4"), 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
                at += p["length"]
                assert p["ids_crc32"] == zlib.crc32(ids[p["start"]:at].tobytes())
    sizes = {}
    for w, pieces in windows.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        sizes[w] = at
        assert at == length or (at < length and at & (at - 1) == 0)
    assert sorted(sizes) == list(range(len(sizes)))
    total = sum(sizes.values())
    assert len(sizes) == len(P.window_lengths(total, length))
    return windows, sizes


def test_packs_every_id_once(spark, docs, path, tokenizer):
    rows = P.pack(docs, path, length=256, block=4, grain=16).collect()
    windows, sizes = check(rows, docs.collect(), tokenizer, 256)
    total, own = sum(sizes.values()), defaultdict(int)
    for r in rows:
        own[r["source"]] += r["length"]
    behind = defaultdict(float)
    for w in sorted(sizes):
        for s in own:
            behind[s] += own[s] / total * sizes[w] - sum(p["length"] for p in windows[w] if p["source"] == s)
        assert max(map(abs, behind.values())) < 48      # no drift over windows and blocks
    for r in P.pack(docs, path).collect():
        assert r["length"] <= 2048


def test_odd_rows(spark, odd, none, path, tokenizer):
    rows = P.pack(odd, path, length=512, block=2).collect()
    check(rows, odd.collect(), tokenizer, 512)
    assert P.pack(none, path).collect() == []
    again = P.pack(odd.coalesce(1), path, length=512, block=2, max_queues=2).collect()      # sources share a queue
    check(again, odd.collect(), tokenizer, 512)
    texts = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    check(P.pack(texts, path, length=64).collect(), texts.collect(), tokenizer, 64)


def test_windows_follow_given_weights(spark, path, tokenizer):
    rng = random.Random(4)
    docs = [(i, "word " * rng.randint(5, 60), "ab"[i % 3 == 0], 0) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, queue int").repartition(4)
    rows = P.pack(df, path, length=256, block=8, grain=8, weights={"a": 1, "b": 3}).collect()
    windows, sizes = check(rows, df.collect(), tokenizer, 256)
    share = [sum(p["length"] for p in windows[w] if p["source"] == "b") / 256 for w in sorted(windows)]
    spent = next(i for i, s in enumerate(share) if s < 0.6)
    assert all(abs(s - 0.75) < 0.1 for s in share[:spent - 8]) and not any(share[spent + 9:])
    with pytest.raises(ValueError):
        P.pack(df, path, weights={"a": 1, "b": 0})


def test_schedule_is_monotone_and_near_the_targets():
    rng = random.Random(2)
    for trial in range(60):
        tokens = [rng.randint(1, 40) if rng.random() < 0.5 else rng.randint(1, 4000) for _ in range(rng.randint(1, 12))]
        weights = tokens if trial % 2 else [rng.randint(1, 9) for _ in tokens]
        s = P.Schedule(tokens, weights)
        plain = sorted((Fraction(2 * j + 1, 2 * w), q) for q, (t, w) in enumerate(zip(tokens, weights)) for j in range(t))
        for n in sorted({0, s.total, *(rng.randint(0, s.total) for _ in range(20))}):
            counts = [0] * len(tokens)
            for _, q in plain[:n]:
                counts[q] += 1
            assert s.taken(n) == counts
            assert sum(s.flow(n)) == n
        size = rng.randint(1, 300)
        for q, t in enumerate(tokens):
            for place in (0, t // 2, t - 1):
                block, upto = s.block_of(q, place, size)
                assert s.taken(block * size)[q] <= place < upto


def test_fill_empties_every_queue():
    rng = random.Random(3)
    for _ in range(100):
        left = [rng.randint(0, 500) for _ in range(rng.randint(1, 8))]
        total = sum(left)
        lengths = P.window_lengths(total, 64)
        served = P.fill(left, [n / max(1, total) for n in left], [0.0] * len(left), lengths, rng.choice([1, 8, 32]))
        got = [0] * len(left)
        for q, n, _, _ in served:
            got[q] += n
        assert got == left and sum(n for _, n, _, _ in served) == sum(lengths)
