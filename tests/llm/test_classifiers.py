"""Trained operators: held-out accuracy on made-up labelled texts, and odd inputs."""

import math
import random
import zlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from shelfscope.llm import cotrain, toxicity

from .conftest import prose


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(2)
    insults = ["grobnix", "zwackel", "flumph", "dreckor"]
    rows = []
    for i in range(400):
        text = prose(rng, rng.randint(20, 80))
        toxic = i % 5 == 0
        if toxic:
            word = rng.choice(insults)
            if held_out(i) and i % 2:  # gapped and inserted characters, met only in scoring
                word = rng.choice([word[:3] + "x" + word[3:], "-".join(word), " ".join(word), word + "s"])
            parts = text.split(" ")
            parts.insert(len(parts) // 2, word)
            text = " ".join(parts)
        rows.append((i, text, "en", "s", int(toxic)))
    return rows


def test_toxicity_held_out(spark, toxic_rows):
    docs = spark.createDataFrame([r[:4] for r in toxic_rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in toxic_rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == len(toxic_rows)
    unseen = [r for r in toxic_rows if held_out(r[0])]
    assert all(got[r[0]].held_out == held_out(r[0]) for r in toxic_rows)
    assert sum(got[r[0]].predicted == r[4] for r in unseen) >= 0.95 * len(unseen)
    assert sum(got[r[0]].predicted for r in unseen if r[4]) >= 0.9 * sum(r[4] for r in unseen)


def test_similarity_tolerates_gaps():
    kernel = toxicity.Similarity(["grobnix"])
    near = kernel.of(["grobnix", "gro-b.nix", "GROBNIX!", "groxbnix", "grobnixen", "garten", "", "12", "x" * 200])
    assert {0, 1, 2, 3, 4} <= set(near) and not {5, 6, 7, 8} & set(near)
    assert near[0][0] == pytest.approx(1) and near[1][0] == pytest.approx(1) and near[3][0] < 1


def _kernel(a, b):
    """Normalised three-letter subsequence kernel of two words of a to z, by all choices of letters."""
    def weights(w):
        out = {}
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN:
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.DECAY ** (k - i + 1)
        return out

    def product(x, y):
        return sum(v * y.get(t, 0) for t, v in x.items())
    x, y = weights(a), weights(b)
    return product(x, y) / math.sqrt(product(x, x) * product(y, y)) if x and y else 0


def test_kernel_values_equal_all_choices_of_letters():
    rng = random.Random(8)
    landmarks = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) for _ in range(30)]
    landmarks = list(dict.fromkeys(landmarks + ["grobnix", "grobnax", "zwackel"]))
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["grobxnix", "zwakcel"]
    got, kernel = {}, toxicity.Similarity(landmarks)
    got = kernel.of(words)
    for i, w in enumerate(words):
        exp = [_kernel(w, m) for m in landmarks]
        own = got.get(i, [0] * len(landmarks))
        for value, have in zip(exp, own):
            if abs(value - toxicity.FLOOR) > 1e-5:
                assert have == pytest.approx(value ** toxicity.POWER if value > toxicity.FLOOR else 0, abs=1e-4), w
    assert len(got) > 100


def test_letters_of_other_scripts_are_told_apart():
    kernel = toxicity.Similarity(["дура", "βλαξ"])
    near = kernel.of(["дура", "йшхе", "ду\u200bра", "βλαξ", "γρκψ", "жопа"])
    assert set(near) == {0, 2, 3} and near[0][0] == pytest.approx(1) and near[2][0] == pytest.approx(1)


def test_all_sentences_of_training_documents_count(spark):
    landmarks = ["grobnix", "zwackel"]
    lines = {0: "grobnix a\ngrobnix b.\nzwackel c! grobnix grobnux d", 1: "x\ngrobnix\n" * 50, 2: "nothing", 3: "zwackel zwackol"}
    table = spark.createDataFrame([(i, t, int(i == 3)) for i, t in lines.items()], "_id long, text string, toxic int").repartition(3)
    rows = table.mapInArrow(toxicity._vector_batches(landmarks), "_id long, toxic int, rows array<float>, times array<long>")
    import numpy as np

    m = len(landmarks)
    sums = toxicity._summed(rows, toxicity._step_sums(m, np.eye(m), np.ones(m), np.zeros(m + 1)), 2 * (1 + 3 + 9))
    toxic, clean = np.split(sums, 2)
    # of the toxic document one sentence; of the others every one with a similar word, and a vector that stands for the rest
    assert toxic[0] == 1 and clean[0] == (4 + 1) + (50 + 1) + 1
    assert clean[1] == pytest.approx(3 + 50, abs=0.7) and clean[3] == clean[0]


def test_spaced_words_of_any_length_and_script():
    for spaced, joined in (("x y z", "xyz"), ("x y y x", "xyyx"), ("Д У Р А", "дура"), ("β λ α ξ", "βλαξ"),
                           ("so a b\tc. No", "so abc. no"), ("f o o, b a r!", "foo, bar!")):
        assert toxicity.Sentences.read(spaced.encode()) == (joined, set(joined.split()))
    for plain in ("a b", "it is a b case", "1 2 3 4", "a - b - c", "a\nb\nc", "", "word"):
        assert toxicity.Sentences.read(plain.encode()) == (plain, set(plain.split()))


def test_toxicity_finds_short_and_foreign_spaced_words(spark, toxic_rows):
    insults = ["zwk", "ыжща"]
    rows = [(r[0], r[1] if not r[4] else "the lor mi " + insults[r[0] // 5 % 2] + " tan er", "en", "s", r[4])
            for r in toxic_rows]
    rows += [(1000 + i, "the lor mi " + " ".join(insults[i % 2]) + " tan er", "en", "s", 1) for i in range(20)]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows if r[0] < 1000], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert all(got[1000 + i].predicted for i in range(20))


def test_scores_of_odd_tables(spark, docs, odd, none):
    labels = spark.createDataFrame([(i, i % 2, None if i % 5 == 0 else i % 3 == 0) for i in range(50)] + [(None, 1, True)],
                                   "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    empty = labels.where("doc_id < 0")
    for table in (docs, odd, none):
        for told in (labels, empty):
            for module in (toxicity, cotrain):
                got = module.score(table, told).collect()
                assert len(got) == table.count() and all(0 <= r.score <= 1 for r in got)


def test_cotraining_held_out(spark):
    rng = random.Random(4)
    rows, told = [], []
    for i in range(600):
        good = i % 4 != 0
        text = prose(rng, rng.randint(30, 90))
        if not good:
            text = " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in text.split())
        # sources tell something about quality, lines and lengths nothing
        rows.append((i, text, "en", f"s{rng.randint(0, 3) if good else rng.randint(2, 6)}"))
        if i % 3:
            told.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame(told, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in cotrain.score(docs, labels).collect()}
    unseen = [i for i in range(600) if held_out(i) or i % 3 == 0]
    assert sum(got[i].kept == (i % 4 != 0) for i in unseen) >= 0.97 * len(unseen)


def test_cotraining_learns_from_every_unlabelled_document(spark):
    """A source without labels, all of whose documents come late in the order of the id hashes."""
    n, late = 26_000, 2_000
    order = spark.range(n).select("id", F.xxhash64("id").alias("h")).orderBy("h").collect()
    last = {r.id for r in order[-late:]}
    told = [r.id for r in order[:800]]
    rng = random.Random(6)
    rows = []
    for i in range(n):
        bad = i in last or i % 2 == 0
        text = " ".join(rng.choice(["text", "word", "line", "more"]) + ("###" if bad else "abc") for _ in range(8))
        rows.append((i, text, "en", "late" if i in last else f"s{i % 2}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in told], "doc_id long, quality int")
    got = {r.doc_id: r for r in cotrain.score(docs, labels).collect()}
    unseen = [i for i in last if held_out(i)]
    assert unseen and all(got[i].metadata_score < 0.3 for i in unseen)
    assert all(got[i].kept == (i % 2 == 1 and i not in last) for i in range(n))


def test_sums_of_partitions_are_the_whole(spark):
    rng = random.Random(7)
    rows = [([rng.random() for _ in range(3)], [rng.random() for _ in range(2)]) for _ in range(500)]
    table = spark.createDataFrame(rows, "x array<float>, m array<float>").repartition(7)
    got = cotrain._summed(table, cotrain._moments, 11)
    assert got[0] == 500
    assert got[1:4] == pytest.approx([sum(r[0][k] for r in rows) for k in range(3)])
    assert got[9:11] == pytest.approx([sum(r[1][k] ** 2 for r in rows) for k in range(2)])
    assert not cotrain._summed(table.where("false"), cotrain._moments, 11).any()
