"""Each operator against a plain computation over whole small tables, and on odd inputs."""

import base64
import hashlib
import math
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from shelfscope.llm import bpe, components, exact_dedup, lattice_lm, mixing, quality_rules, simhash, suffix_dedup, warc
from shelfscope.llm.common import stored
from shelfscope.llm.queries import vocabulary

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in WHITE.split(text or "") if w]


# ------------------------------------------------------------------ 1 archives
@pytest.fixture(scope="module")
def page_rows():
    inner = ("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")
    rows = [(i, f"http://x/{i}", f"<html>page {i % 5} é {'z' * (i * 40)}</html>") for i in range(20)]
    rows += [(30, "u", None), (31, None, ""), (32, "a\r\nWARC/1.0", "<b>x"), (33, "u", "text " + inner + "rest"),
             (34, "u", inner * 3), (35, "u", "WARC/1.0\r\n"), (36, "u", inner), (37, "u", rows[4][2]),
             (38, "u", rows[4][2]), (39, "u", "WARC/1.0 Content-Length: 9\r\n\r\n\r\n\r\n" + "y" * 3000)]
    return rows


@pytest.mark.parametrize("compression,split", [("gzip", "128m"), ("none", "20k")])
def test_archives_give_back_every_page(spark, page_rows, compression, split):
    path = f"/tmp/warc-{uuid.uuid4().hex}"
    pages = spark.createDataFrame(page_rows, "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(2), path, compression=compression)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = warc.read_archives(spark, path, with_payload=True).collect()
        got = {tuple(r) for r in warc.page_records(warc.read_archives(spark, path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    first = {}
    for i, _, html in page_rows:
        first[html or ""] = min(first.get(html or "", i), i)
    expected = set()
    for i, _, html in page_rows:
        body, one = (html or "").encode(), first[html or ""]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        expected.add((i, len(body), digest, "response" if one == i else "revisit", None if one == i else one))
    assert got == expected
    stored = {r.record_id: bytes(r.payload) for r in records if r.type == "response"}
    assert stored == {f"<urn:page:{i}>": (h or "").encode() for i, _, h in page_rows if first[h or ""] == i}


def test_archives_of_no_pages(spark):
    path = f"/tmp/warc-{uuid.uuid4().hex}"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.page_records(warc.read_archives(spark, path)).count() == 0


# ------------------------------------------------------------------ 2 quality rules
def base(text):
    w = words(text)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(docs, rows):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, b = got[r[0]], base(r[1])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == b
        assert g.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0])
        assert not (g.base_failed and g.kept)


def test_quality_fences_follow_their_group(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["word#" if rng.random() < (0.05 if i < 300 else 0.9) else "word"] * 1 + [
        rng.choice(["word", "text", "line", "more"]) + rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)]),
        "en", "s") for i in range(290)]
    rows += [(1000 + i, " ".join(f"w{rng.random()}###" for _ in range(50)), "en", "s") for i in range(10)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(290)) and not any(kept[1000 + i] for i in range(10))


def test_sketches_merge_to_the_whole(docs):
    measured = stored(quality_rules.with_measures(quality_rules.base_measures(docs)), "test-measures")
    halves = [quality_rules.sketches(measured.where(F.col("doc_id") % 2 == k)) for k in (0, 1)]
    merged = halves[0].unionByName(halves[1]).groupBy("lang", "source", "measure", "bin").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted(
        map(tuple, quality_rules.sketches(measured).collect()), key=repr)


# ------------------------------------------------------------------ 3 exact copies
@pytest.mark.parametrize("hash_bits,capacity", [(64, 1 << 14), (64, 8), (3, 4)])
def test_exact_copies(docs, rows, hash_bits, capacity):
    groups = {}
    for r in rows:
        groups.setdefault(WHITE.sub(" ", r[1] or ""), []).append(r[0])
    got = {r.doc_id: r for r in exact_dedup.dedup(docs, capacity, hash_bits).collect()}
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(ids), len(ids), i == min(ids))
            assert got[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_directory_splits_overfull_buckets(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    slots, depth = exact_dedup.directory(hashes, 5000, 100)
    sizes = hashes.withColumn("slot", exact_dedup.slot_of(F.col("h"), depth)).join(slots, "slot").groupBy("bucket").count()
    crowded = spark.range(40).select((F.col("id") + F.lit(5 << 40)).alias("h"))      # 35 leading bits in common and more
    deep, far = exact_dedup.directory(crowded, 40, 8)
    held = crowded.withColumn("slot", exact_dedup.slot_of(F.col("h"), far)).join(deep, "slot").groupBy("bucket").count()
    assert far > 50 and max(r["count"] for r in held.collect()) <= 8
    assert sizes.agg(F.max("count")).first()[0] <= 100 and sizes.agg(F.sum("count")).first()[0] == 5000


def test_exact_copies_odd(odd, none):
    assert exact_dedup.dedup(odd).count() == odd.count()
    kept = exact_dedup.deduplicated(odd)
    assert kept.columns == odd.columns
    distinct = {WHITE.sub(" ", r.text or "") for r in odd.collect()}
    assert sorted(WHITE.sub(" ", r.text or "") for r in kept.collect()) == sorted(distinct)
    assert exact_dedup.dedup(none).count() == 0


# ------------------------------------------------------------------ 4 repeated passages
def removal(texts, width=100):
    seen, out = set(), []
    for t in texts:
        t, cover = (t or "").encode(), set()
        for p in range(len(t) - width + 1):
            if t[p:p + width] in seen:
                cover.update(range(p, p + width))
            seen.add(t[p:p + width])
        kept = bytes(b for i, b in enumerate(t) if i not in cover)
        out.append((len(t), len(cover), sum(i - 1 not in cover for i in cover), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [50_000, 2])
def test_repeated_passages(docs, rows, hot):
    expected = dict(zip([r[0] for r in rows], removal([r[1] for r in rows])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, hot).collect()}
    assert got == expected and sum(v[1] for v in got.values()) > 0


def test_repeated_passages_odd(odd, none):
    got = suffix_dedup.dedup(odd).collect()
    ordered = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(ordered)
    # rows with one id have an order of their own; what is left over does not depend on it where texts are equal
    by_id = Counter((r.doc_id, r.n_bytes) for r in got)
    assert by_id == Counter((r.doc_id, len((r.text or "").encode())) for r in ordered)
    assert suffix_dedup.dedup(none).count() == 0


def test_merge_of_front_coded_runs():
    rng = random.Random(3)
    runs = []
    for _ in range(9):
        s = sorted(bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 40)))
        shares = [0] + [len(re.match(b"(?s)", a)[0]) + next((i for i, (x, y) in enumerate(zip(a, b)) if x != y),
                                                              min(len(a), len(b))) for a, b in zip(s, s[1:])]
        runs.append((s, shares[:len(s)]))
    order, shared = suffix_dedup.merge_runs(runs)
    merged = [runs[r][0][i] for r, i in order]
    assert merged == sorted(x for s, _ in runs for x in s)
    for a, b, h in zip(merged, merged[1:], shared[1:]):
        assert a[:h] == b[:h] and (len(a) == h or len(b) == h or a[h] != b[h])


# ------------------------------------------------------------------ 6 near copies
def fingerprint(text):
    w = [x for x in WHITE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_copies(docs, rows):
    prints = {r[0]: fingerprint(r[1]) for r in rows}
    root = {i: i for i in prints}
    for i in sorted(prints):
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                for k, v in root.items():
                    if v == max(a, b):
                        root[k] = min(a, b)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.groups(docs).collect()}
    assert got == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


def test_links_of_crowded_prints(spark):
    rng = random.Random(9)
    core = rng.getrandbits(64)
    prints = {core ^ sum(1 << b for b in rng.sample(range(0, 64, 3), rng.randint(0, 4))) for _ in range(400)}
    prints |= {rng.getrandbits(64) for _ in range(200)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    a = np.array(signed, np.int64)
    pairs = [(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]) & (2**64 - 1)
             and bin(int(a[i] ^ a[j]) & (2**64 - 1)).count("1") <= 2]
    expected = simhash.forest(len(a), *np.array(pairs).T)
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, run_limit=32)
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert [roots.get(p, p) for p in signed] == [signed[k] for k in expected]
    i, j = simhash.links(simhash.build_index(a), 2)
    assert {(min(x), max(x)) for x in zip(i.tolist(), j.tolist())} == set(pairs)


def test_links_with_a_tiny_run_limit(spark):
    core = random.Random(10).getrandbits(63)
    prints = sorted({core} | {core ^ 1 << b for b in range(63)})
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"), 2, run_limit=1)
    assert {r.node: r.root for r in components.components(links).collect()} == dict.fromkeys(prints, prints[0])


def test_links_of_short_runs_come_from_the_tree(monkeypatch):
    import pyarrow as pa

    prints = np.array(sorted([0b1011, 0b1010, 1 << 40, 1 << 41, 7 << 50]), np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(5, np.int64)), pa.array(prints)], names=["bucket", "fp"])

    def found():
        return {(int(a), int(b)) for out in simhash._run_links(2)(iter([batch])) for a, b in zip(*out.to_pydict().values())}
    assert {frozenset(p) for p in found()} == {frozenset({0b1010, 0b1011}), frozenset({1 << 40, 1 << 41})}
    monkeypatch.setattr(simhash, "links", lambda levels, bits: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert found() == set()


def test_near_copies_odd(odd, none):
    assert simhash.groups(odd).count() == odd.count()
    stay = simhash.representatives(odd)
    assert stay.columns == odd.columns
    assert stay.count() == simhash.groups(odd).select("root").distinct().count()
    assert simhash.groups(none).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {1000 + i: 1000 for i in range(60)}


# ------------------------------------------------------------------ 7 language model
def test_lattice_sums_all_segmentations():
    path = vocabulary("piece_bpe_32k.model")
    pieces, logp, _ = lattice_lm._pieces(path)
    lattice = lattice_lm.Lattice(path, logp)

    def total(s):
        if not s:
            return 1.0
        spelt = math.prod(math.exp(logp[lattice.byte[x]]) for x in s[0].encode())
        return spelt * total(s[1:]) + sum(math.exp(logp[i]) * total(s[n:]) for n in range(1, len(s) + 1)
                                          if (i := lattice.index.get(s[:n])) is not None)
    sample = ["the", "éa", "house", "q中", "a" * 9, "x" * 40]
    got = lattice.score(sample)
    for w, g in zip(sample[:5], got):
        assert math.isclose(g, math.log(total("▁" + w)), rel_tol=1e-9)
    # expected counts spell every word out in full
    mass = np.zeros(len(logp))
    lattice.score(["there", "éa"], np.array([2.0, 1.0]), mass)
    chars = sum(m * (len(p) if not re.fullmatch("<0x..>", p) else 0) for p, m in zip(pieces, mass))
    spelt = sum(mass[i] for i in lattice.byte)
    assert abs(chars + spelt - (2 * 6 + 3)) < 1e-2


@pytest.mark.parametrize("head", [10, 100_000])
def test_language_model(docs, rows, head):
    def tokens(text):
        return words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    c = Counter(t for r in rows if not held[r[0]] for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lattice_lm.score(docs, vocabulary("piece_bpe_32k.model"), head=head).collect()}
    for r in rows:
        t, g = tokens(r[1]), got[r[0]]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r[0]], len(t), sum(c[x] > 0 for x in t), n)
        assert math.isclose(g.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
        assert -math.inf < g.score < 0


def test_language_model_odd(odd, none):
    assert lattice_lm.score(odd, vocabulary("piece_bpe_32k.model")).count() == odd.count()
    assert lattice_lm.score(none, vocabulary("piece_bpe_32k.model")).count() == 0


# ------------------------------------------------------------------ 8 tokens
@pytest.mark.parametrize("chunk", [16, 512])
def test_tokens(docs, rows, chunk):
    from tokenizers import Tokenizer
    path = vocabulary("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    outputs = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    got = {r.doc_id: r for r in bpe.encode(docs, path, outputs, chunk=chunk).collect()}
    for r in rows:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids
        g = got[r[0]]
        assert g.ids == ids and g.n_tokens == len(ids)
        assert g.decoded == plain.decode(ids, skip_special_tokens=False) == (r[1] or "")
        assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest()


def test_shared_chunks_are_encoded_once(rows):
    coder = bpe.ChunkCoder(vocabulary("byte_bpe_50k.json"), 64)
    text = rows[-3][1].encode()
    one = [i for p in coder.text(text) for i in p[0]]
    before = coder.reused
    assert [i for p in coder.text(b"something else before " + text) for i in p[0]][-200:] == one[-200:]
    assert coder.reused > before + 20


def test_tokens_odd(odd, none):
    assert bpe.encode(odd, vocabulary("byte_bpe_50k.json")).count() == odd.count()
    assert bpe.encode(none, vocabulary("byte_bpe_50k.json")).count() == 0


# ------------------------------------------------------------------ 10 mixing
def water_fill(sizes, share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, rest, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def test_mixing(docs, rows):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    target = water_fill(sizes)
    got = mixing.mix(docs, block=16).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    taken = Counter()
    for r in got:
        assert r.size == len(words(dict((x[0], x[1]) for x in rows)[r.doc_id]))
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    largest = max(len(words(r[1])) for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest for s in sizes)
    assert {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7), block=16).collect()} == {
        (r.doc_id, r.taken) for r in got}


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 500, 1000).astype(float), np.full(1000, 0.37)
    out = mixing._fly(size, p, rng)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert math.isclose(out @ size, p @ size, rel_tol=1e-9) and math.isclose(out.sum(), p.sum(), rel_tol=1e-9)


def test_mixing_odd(odd, none):
    assert mixing.mix(odd).count() == odd.count()
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() > 0
    assert mixing.mix(none).count() == 0


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark, docs, odd, none):
    for table in (docs, odd, none):
        now = table.select("doc_id", "text", "lang", "source", "n_chars")
        n = now.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, None)
            if name != "bpe":
                assert out.columns == now.columns
            m = out.count()
            assert m <= (n if name != "mixing" else 2 * n) or name == "bpe" and m == n
            now, n = out, m


def fences(passed):
    """(lowest, highest) allowed value of each measure, over all documents that pass the base rules."""
    out = []
    for k, (high, low) in enumerate(quality_rules.MEASURES.values()):
        bins = sorted(v >> max(0, v.bit_length() - 6) << max(0, v.bit_length() - 6) for v in (m[k] for m in passed))
        q25, q75 = (next(b for i, b in enumerate(bins) if (i + 1) * 4 >= len(bins) * q) for q in (1, 3))
        out.append((q25 - 3 * max(q75 - q25, low) if low else -math.inf, q75 + 3 * max(q75 - q25, high)))
    return out


def measures(text):
    n, chars, symbols, copies, repeats = base(text)
    lines = sum(1 for x in (text or "").split("\n") if words(x))
    upper = len(re.findall("[A-ZÀ-ÖØ-Þ]", text or ""))
    return (1000 * symbols // n, 1000 * copies // lines, 1000 * repeats // n, 1000 * upper // chars, 100 * chars // n)


def test_pipeline_rows(spark, rows, tmp_path, monkeypatch):
    """Every stage of ``run`` against a plain computation; all groups are small, so fences are those of all."""
    from tokenizers import Tokenizer
    rng = random.Random(12)
    long_text = dict((r[0], r[1]) for r in rows)[207]
    more = [(300 + i, long_text + " " + "tail" * (i + 1), "de", "s3", 0, "k", "h", "i") for i in range(4)]
    more += [(310 + i, " ".join(f"w{rng.random()}###" for _ in range(40)), "en", "s1", 0, "k", "h", "i") for i in range(3)]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    table = [r[:5] for r in [*rows, *more]]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    written = {}

    def keep(df, name):
        written[name] = stored(df, name)
        return written[name]
    monkeypatch.setattr(corpus_pipeline, "stored", keep)
    final = corpus_pipeline.run(spark, str(tmp_path))
    got = {name.removeprefix("pipeline-"): df for name, df in written.items()}
    assert list(got) == [name for name, _ in corpus_pipeline.STAGES]
    text = {r[0]: r[1] for r in table}

    def same(name, ids):
        assert got[name].columns == columns
        assert sorted(map(tuple, got[name].collect()), key=repr) == sorted(
            (r for r in table for _ in range(ids.count(r[0]))), key=repr)

    passed = {r[0]: measures(r[1]) for r in table if (b := base(r[1]))[0] >= 20 and 100 * b[4] <= 30 * b[0]}
    limits = fences(passed.values())
    clean = [i for i, m in passed.items() if all(lo <= v <= hi for v, (lo, hi) in zip(m, limits))]
    same("quality_rules", clean)
    first = {}
    for i in sorted(clean):
        first.setdefault(WHITE.sub(" ", text[i] or ""), i)
    single = sorted(first.values())
    same("exact_dedup", single)
    prints, root = {i: fingerprint(text[i]) for i in single}, {i: i for i in single}
    for i in single:
        for j in single:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    apart = sorted(set(root.values()))
    same("simhash", apart)
    assert len(table) > len(passed) > len(clean) > len(single) > len(apart) > 0
    # the mix's choice is random by hash: its own verdicts, held to the targets
    source, sizes, taken = {r[0]: r[3] for r in table}, Counter(), Counter()
    for i in apart:
        sizes[source[i]] += len(words(text[i]))
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(got["simhash"]).collect()}
    mix = [i for i in apart for _ in range(times[i])]
    same("mixing", mix)
    for i in mix:
        taken[source[i]] += len(words(text[i]))
    largest, target = max(len(words(text[i])) for i in apart), water_fill(sizes)
    assert all(abs(taken[s] - target[s]) <= largest for s in sizes)
    plain, expected = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), []
    for i in mix:
        ids = plain.encode(text[i], add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(text[i].encode()).hexdigest()))
    assert sorted(map(tuple, final.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(expected)
