"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary and their scores weight every
segmentation of a text; a forward recursion in log space sums them all, so a
score is the text's marginal probability and not that of one best split.
Pieces do not cross word starts, hence a text's lattice is a chain of word
lattices and its log probability a sum over its words and one end.

What is learnt from the training documents:

* piece probabilities: the vocabulary's scores (merge ranks, read as a Zipf
  law) are the prior, expected piece counts over all segmentations of all
  training words (forward and backward recursion) the evidence;
* whole-word arcs: a training word also has an arc of its own across its
  lattice with its relative frequency.  The arcs share the mass by Good and
  Turing's estimate: words seen once stand for what has not been seen.

Words meet their counts in two ways with one result: the ``HEAD`` most frequent
words travel to the tasks as a table of that fixed size, all others are joined
by shuffle, so no frequent word makes a hot key and nothing broadcast grows.

Defined results: null and blank texts consist of the end alone; without
training documents whole-word arcs have no mass and all words are unknown; a
null doc_id is never held out; equal rows get equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import id_remainder, stored, text_batches, utf8

HEAD = 150_000      # most frequent words sent to every task
END = "\n"          # stands for the end of a text: no word contains white space
PRIOR = 2000.0      # how many observed pieces the vocabulary's own scores weigh
MAX_BATCHED = 32    # characters of a word in the array recursion; longer words are done singly
_FLUSH = 400_000    # distinct words a task counts before it sends them on
_PIECE = 8 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_START = "▁"


# ------------------------------------------------------------------ vocabulary
@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[list[str], np.ndarray, int]:
    """(piece texts, prior log probabilities, index of the end piece); control pieces get no mass."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    rank = np.array([-sp.get_score(i) for i in range(n)])
    weight = 1.0 / (np.maximum(rank, 0) + 2.7)
    end = sp.eos_id()
    for i in range(n):
        if sp.is_control(i) and i != end or sp.is_unknown(i):
            weight[i] = 0
        elif sp.is_byte(i):
            weight[i] = 1e-6 / 256
    weight[end] = 1e-3
    with np.errstate(divide="ignore"):
        return [sp.id_to_piece(i) for i in range(n)], np.log(weight / weight.sum()), end


class Lattice:
    """Marginal log probabilities (natural) of words, and expected piece counts."""

    def __init__(self, path: str, logp: np.ndarray):
        self.pieces, _, self.end = _pieces(path)
        self.logp = logp
        usable = [i for i, p in enumerate(self.pieces) if np.isfinite(logp[i]) and i != self.end]
        self.byte = np.zeros(256, int)
        plain = []
        for i in usable:
            p = self.pieces[i]
            if len(p) == 6 and p.startswith("<0x") and p.endswith(">"):
                self.byte[int(p[3:5], 16)] = i
            else:
                plain.append(i)
        self.index = {self.pieces[i]: i for i in plain}
        self.longest = max(map(len, self.index))
        hashes = np.array([self._hash(self.pieces[i]) for i in plain], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(plain)[order]
        # first place of each leading bit pattern: a lookup looks at a few neighbours only
        self.bits = 20
        top = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << self.bits) + 1))
        self.depth = int(np.diff(self.first).max())

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = ((h + ord(c) + 1) * int(_PRIME)) & 0xFFFFFFFFFFFFFFFF
        return h ^ (h >> 29)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 where there is none."""
        h = h ^ (h >> np.uint64(29))
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.full(len(h), -1)
        for k in range(self.depth):
            here = np.minimum(at + k, len(self.hashes) - 1)
            hit = self.hashes[here] == h
            out[hit] = self.ids[here[hit]]
        return out

    def _bytes_logp(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each character spelt in byte pieces."""
        values, back = np.unique(codes, return_inverse=True)
        spelt = [sum(self.logp[self.byte[x]] for x in chr(v).encode("utf-8", "surrogatepass")) for v in values]
        return np.array(spelt, float)[back].reshape(codes.shape)

    def score(self, words: list[str], counts: np.ndarray | None = None, expected: np.ndarray | None = None):
        """Log marginal of each word; adds ``counts`` times the expected pieces to ``expected``."""
        out = np.empty(len(words))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(k)
        for n, where in by_length.items():
            size = max(1, 200_000 // n) if n <= MAX_BATCHED else 1
            for at in range(0, len(where), size):
                own = where[at:at + size]
                text = "".join(_START + words[k] for k in own)
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n)
                out[own] = self._forward(codes.T.astype(np.uint64), None if counts is None else counts[own], expected)
        return out

    def _forward(self, codes: np.ndarray, counts, expected) -> np.ndarray:
        """``codes``: characters by words, words of one length."""
        n, words = codes.shape
        alpha = np.full((n + 1, words), -np.inf)
        alpha[0] = 0
        spelt = self._bytes_logp(codes)
        arcs = []
        for i in range(n):
            h = np.zeros(words, np.uint64)
            for j in range(i, min(n, i + self.longest)):
                h = (h + codes[j] + np.uint64(1)) * _PRIME
                ids = self._find(h)
                hit = np.flatnonzero(ids >= 0)
                if j == i:
                    alpha[j + 1] = np.logaddexp(alpha[j + 1], alpha[i] + spelt[i])
                if len(hit):
                    step = self.logp[ids[hit]]
                    alpha[j + 1, hit] = np.logaddexp(alpha[j + 1, hit], alpha[i, hit] + step)
                    if expected is not None:
                        arcs.append((i, j + 1, hit, ids[hit], step))
        if expected is not None:
            beta = np.full((n + 1, words), -np.inf)
            beta[n] = 0
            by_start: dict[int, list] = {}
            for a in arcs:
                by_start.setdefault(a[0], []).append(a)
            for i in reversed(range(n)):
                beta[i] = np.logaddexp(beta[i], spelt[i] + beta[i + 1])
                for _, j, hit, ids, step in by_start.get(i, []):
                    beta[i, hit] = np.logaddexp(beta[i, hit], step + beta[j, hit])
                    np.add.at(expected, ids, counts[hit] * np.exp(alpha[i, hit] + step + beta[j, hit] - alpha[n, hit]))
                through = counts * np.exp(alpha[i] + spelt[i] + beta[i + 1] - alpha[n])
                values, back = np.unique(codes[i], return_inverse=True)
                for v, mass in zip(values, np.bincount(back, through)):
                    for x in chr(int(v)).encode("utf-8", "surrogatepass"):
                        expected[self.byte[x]] += mass
        return alpha[n]


# ------------------------------------------------------------------ counting
def _words(text: bytes | None) -> list[str]:
    return [w.decode() for w in (text or b"").lower().split()]


def _count_batches(batches):
    """Partial (word, count in training documents), words of other documents with count 0."""
    seen: Counter = Counter()

    def send():
        # in pieces, so that one message stays small
        items = list(seen.items())
        seen.clear()
        for at in range(0, len(items), 50_000):
            part = items[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in part], pa.string()),
                                              pa.array([c for _, c in part], pa.int64())], names=["word", "c"])
    for batch in text_batches(batches, "text", _PIECE):
        for text, held_out in zip(utf8(batch.column("text")), batch.column("held_out").to_pylist()):
            words = (text or b"").lower().split()
            if held_out:
                for w in words:
                    if w not in seen:
                        seen[w] = 0
            else:
                seen.update(words)
                seen[b"\n"] += 1
            if len(seen) > _FLUSH:
                yield from send()
    yield from send()


def _expect_batches(path: str, logp: np.ndarray):
    def run(batches):
        lattice, total = Lattice(path, logp), np.zeros(len(logp))
        for batch in batches:
            lattice.score(batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float), total)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["piece", "mass"])
    return run


def _word_batches(path: str, logp: np.ndarray, n: int, v: int, known: float):
    """Word table with its two log10 terms: base (add one) and model."""
    def run(batches):
        lattice = Lattice(path, logp)
        for batch in batches:
            c = batch.column("c").to_numpy()
            spelt = lattice.score(batch.column("word").to_pylist())
            model = np.logaddexp(np.log(np.maximum(c, 1) / max(n, 1)) + np.where(c > 0, math.log(known or 1), -np.inf)
                                 if known else np.full(len(c), -np.inf), spelt + math.log1p(-known))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("c"), pa.array(np.log10((c + 1) / (n + v + 1))),
                 pa.array(model / math.log(10))], names=["word", "c", "base", "model"])
    return run


def _document_batches(head, end_terms):
    """Documents with the sums over head words, and their other words with counts."""
    def run(batches):
        from pyspark import TaskContext

        table, row = head.value, TaskContext.get().partitionId() << 33
        for batch in text_batches(batches, "text", _PIECE):
            out = []
            for text in utf8(batch.column("text")):
                counts = Counter((text or b"").lower().split())
                n_known, base, model, tail = 1 if end_terms[0] else 0, [end_terms[1]], [end_terms[2]], []
                for w, k in counts.items():
                    found = table.get(w)
                    if found is None:
                        tail.append((w.decode(), k))
                    else:
                        n_known += k
                        base.append(k * found[0])
                        model.append(k * found[1])
                out.append((row, sum(counts.values()) + 1, n_known, math.fsum(base), math.fsum(model), tail))
                row += 1
            cols = list(zip(*out))
            kind = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))
            tails = pa.array([[{"word": w, "k": k} for w, k in t] for t in cols[5]], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *(pa.array(c) for c in cols[:5]), tails],
                names=["doc_id", "held_out", "row", "n_tokens", "known0", "base0", "model0", "tail"])
    return run


def score(docs: DataFrame, path: str, modulus: int = 7, remainder: int = 2, rounds: int = 1,
          head: int = HEAD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    (log10).  ``path``: a sentencepiece model; documents whose id remainder is ``remainder`` do not train."""
    spark = docs.sparkSession
    held_out = F.coalesce(id_remainder(F.col("doc_id"), modulus) == remainder, F.lit(False))
    texts = docs.select("doc_id", held_out.alias("held_out"), "text")
    counted = stored(texts.select("held_out", "text").mapInArrow(_count_batches, "word string, c long")
                     .groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
    seen = counted.where("c > 0").agg(F.sum("c"), F.count(F.lit(1)), F.sum((F.col("c") == 1).cast("long")),
                                      F.max(F.when(F.col("word") == END, F.col("c")))).first()
    n, v, once, ends = (x or 0 for x in seen)
    known = 1 - (once + 1) / (n + 1) if n else 0.0
    pieces, prior, end = _pieces(path)
    logp = prior
    words = counted.where(F.col("word") != END)
    for _ in range(rounds if n else 0):
        mass = np.exp(prior) * PRIOR
        # at most one row per piece of the vocabulary
        for r in (words.where("c > 0").mapInArrow(_expect_batches(path, logp), "piece long, mass double")
                  .groupBy("piece").agg(F.sum("mass").alias("mass")).collect()):
            mass[r.piece] += r.mass
        mass[end] += ends
        with np.errstate(divide="ignore"):
            logp = np.log(mass / mass.sum())
    model = stored(words.mapInArrow(_word_batches(path, logp, n, v, known),
                                    "word string, c long, base double, model double"), "lm-words")
    top = (model.where("c > 0").orderBy(F.desc("c"), "word").limit(head).select("word", "base", "model")
           .toArrow().to_pydict())
    table = spark.sparkContext.broadcast(
        {w.encode(): (b, m) for w, b, m in zip(top["word"], top["base"], top["model"])})
    end_model = math.log10((known * ends / n if n else 0) + (1 - known) * math.exp(logp[end]))
    ends_known = (ends, math.log10((ends + 1) / (n + v + 1)), end_model)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(texts.mapInArrow(
        _document_batches(table, ends_known),
        f"doc_id {id_type}, held_out boolean, row long, n_tokens long, known0 long, base0 double, model0 double, "
        "tail array<struct<word: string, k: long>>"), "lm-documents")
    rare = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.k")
    sums = (rare.join(model, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(F.lit(0))).alias("known1"),
        F.sum(F.col("k") * F.col("base")).alias("base1"), F.sum(F.col("k") * F.col("model")).alias("model1")))
    return rows.drop("tail").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known0") + F.coalesce("known1", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base0") + F.coalesce("base1", F.lit(0.0))).alias("base_score"),
        (F.col("model0") + F.coalesce("model1", F.lit(0.0))).alias("score"))
