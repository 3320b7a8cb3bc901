"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks.

A word's features are all its three-letter subsequences within ``SPAN``
letters, weighted ``DECAY`` to the power of the stretch they cover; the kernel
of two words is the normalised product.  Letters are compared without case and
accents (those of other scripts than Latin keep codes of their own); other
characters inside a word are skipped, digits that stand for letters are read as
these, and runs of three or more single letters of any script are read as one
word, so gapped and inserted characters change a kernel value only in part.
Alike landmarks form groups; a word is compared with the landmarks of a group only
if a bound on its kernel values with them reaches the floor.

Landmarks are the words of the training documents that most tell toxic from
other documents.  A sentence is described by its greatest kernel value with
each landmark, mapped through the inverse root of the landmarks' own kernel
matrix (Nystroem), and judged by a linear support vector machine.  It is
trained on sentences: all of a clean document are clean, of a toxic one the
sentence that the machine itself finds most toxic is taken, in rounds.  A
document scores as its most toxic sentence, through a logistic calibration.

Fitting reads at most ``SAMPLE`` labelled documents (those with the smallest
hash of their id).  Their sentences' vectors are stored once; each Newton step of
the machine is a pass over them whose sums (their size is set by the number of
landmarks) meet at the driver.  Scoring reads every whole text.

Defined results: null and blank texts score as a sentence without any similar
word; labels that are null are ignored, a document labelled more than once is
toxic if one label says so; with only one class among the labels every score is
that class's smoothed share; repeated rows score alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import id_remainder, stored, text_batches, utf8

SAMPLE = 8000     # labelled documents used for fitting, at most
LANDMARKS = 160
SPAN = 6          # letters a subsequence may stretch over
DECAY = 0.7
FLOOR = 0.45      # kernel values up to this count as no similarity
POWER = 3         # values enter the machine to this power, again a kernel
LEAST_GAIN = 15.0 # evidence (likelihood ratio statistic) that a landmark must have
GROUPS = 16       # of alike landmarks
_FOLDS = 8        # partitions of the stored sentence vectors
LONGEST = 32      # longer words are read through overlapping windows of this many letters
_CACHE = 200_000  # words a task remembers
_PIECE = 8 << 20
_SPACED = re.compile(r"(?:(?<=\s)|^)[^\W\d_](?:[ \t][^\W\d_]){2,}(?=\s|[.,!?]|$)")
_PAIRS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


_BITS = 7         # of a letter code


def _alphabet() -> np.ndarray:
    """Code point -> letter code, 0 for what is skipped: 1..26 for Latin letters whatever their accents, 27..123 for
    others below 0x250."""
    out = np.zeros(0x250, np.int32)
    for c in range(0x250):
        base = unicodedata.normalize("NFKD", chr(c).lower())[0]
        if "a" <= base <= "z":
            out[c] = ord(base) - 96
        elif chr(c).isalpha():
            out[c] = 27 + c % 97
    for digit, letter in zip("013457", "oieast"):
        out[ord(digit)] = ord(letter) - 96
    return out


_LETTERS = _alphabet()
_EDGES = "".join(chr(c) for c in range(33, 127) if not _LETTERS[c])    # skipped characters that words often end with
_TWO = array("I", [1, 1]).tobytes()  # lengths of two single characters in a row; every spaced word has such
# letters as text, for showing landmarks; codes above z stand for themselves in the private-use area
_SHOWN = [chr(96 + c) if c < 27 else chr(0xE000 + c) for c in range(1 << _BITS)]


def letter_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all words in a row, skipped characters left out, and where each word ends.

    From 0x250 on code points that follow each other have different codes, so letters of one script do; combining
    marks, general punctuation and zero-width characters are skipped."""
    text = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _LETTERS[np.minimum(text, 0x24F)]
    far = np.flatnonzero(text >= 0x250)
    if len(far):
        t = text[far]
        own = np.where((t >= 0xE01B) & (t < 0xE080), t - 0xE000, 27 + t % 97)
        codes[far] = np.where(((t >= 0x300) & (t < 0x370)) | ((t >= 0x2000) & (t < 0x2070)) | (t == 0xFEFF), 0, own)
    breaks = text == 10
    ends = np.cumsum((codes > 0) & ~breaks)[breaks]
    return codes[(codes > 0) & ~breaks], ends


def _grouped(words: list[str]):
    """(indices, codes as words by letters) for each length; long words give several windows."""
    codes, ends = letter_codes(words)
    begins = np.r_[0, ends[:-1]]
    length = ends - begins
    index = np.arange(len(words))
    long_ = np.flatnonzero(length > LONGEST)
    if len(long_):
        # windows at every half length; the last one ends with the word
        at = [np.unique(np.minimum(np.arange(0, n, LONGEST // 2), n - LONGEST)) for n in length[long_]]
        index = np.r_[index[length <= LONGEST], np.repeat(long_, [len(x) for x in at])]
        begins = np.r_[begins[length <= LONGEST], np.repeat(begins[long_], [len(x) for x in at]) + np.concatenate(at)]
        length = np.minimum(length[index], LONGEST)
    order = np.argsort(length, kind="stable")
    cuts = np.searchsorted(length[order], np.arange(3, LONGEST + 2))
    for n, lo, hi in zip(range(3, LONGEST + 1), cuts, cuts[1:]):
        for k in range(lo, hi, 4096):
            own = order[k:min(hi, k + 4096)]
            yield index[own], codes[begins[own][:, None] + np.arange(n)]


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(subsequence numbers, weights) of words of one length; a column per choice of letters."""
    n = codes.shape[1]
    at = [(i, i + j, i + k, DECAY ** (k + 1)) for i in range(n) for j, k in _PAIRS if i + k < n]
    a, b, c, weight = (np.array(x) for x in zip(*at))
    return codes[:, a] << 2 * _BITS | codes[:, b] << _BITS | codes[:, c], weight


def _norms(numbers: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Root of each word's kernel value with itself (equal subsequences add up first)."""
    rows = np.repeat(np.arange(len(numbers)), numbers.shape[1])
    keys, back = np.unique(rows << 3 * _BITS | numbers.ravel(), return_inverse=True)
    sums = np.bincount(back, np.tile(weight, len(numbers)))
    return np.sqrt(np.bincount(keys >> 3 * _BITS, sums ** 2, len(numbers)))


def _alike(table: np.ndarray, groups: int) -> np.ndarray:
    """Group of each column: that of the most similar of ``groups`` columns that are far from each other."""
    unit = table / np.maximum(np.linalg.norm(table, axis=0), 1e-12)
    near = unit.T @ unit
    chosen, best = [0], near[0].copy()
    while len(chosen) < min(groups, len(near)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, near[chosen[-1]])
    return np.argmax(near[:, chosen], axis=1)


class Similarity:
    """Kernel values of words with the landmarks, above the floor."""

    def __init__(self, landmarks: list[str]):
        self.m = len(landmarks)
        found = [(i, row, weight / norm) for k, codes in _grouped(landmarks) for numbers, weight in [subsequences(codes)]
                 for i, row, norm in zip(k, numbers, _norms(numbers, weight))]
        known = np.unique(np.concatenate([row for _, row, _ in found])) if found else np.zeros(0, np.int64)
        self.row_of = np.zeros(1 << 3 * _BITS, np.int32)      # subsequence -> row of the table, 0 for those of no landmark
        self.row_of[known] = np.arange(1, len(known) + 1)
        table = np.zeros((len(known) + 1, self.m))
        for i, row, value in found:
            np.add.at(table[:, i], self.row_of[row], value)
        self.table = table.astype(np.float32)
        group = _alike(self.table, GROUPS) if self.m else np.zeros(0, int)
        self.columns = [np.flatnonzero(group == g) for g in range(group.max(initial=-1) + 1)]
        self.parts = [np.ascontiguousarray(self.table[:, c]) for c in self.columns]
        self.most = np.stack([p.max(axis=1) for p in self.parts], axis=1) if self.m else np.zeros((1, 0), np.float32)

    def of(self, words: list[str]) -> dict[int, np.ndarray]:
        """Index -> values, only for words above the floor with some landmark."""
        found: dict[int, np.ndarray] = {}
        if not self.m:
            return found
        for where, codes in _grouped(words):
            numbers, weight = subsequences(codes)
            rows, w = self.row_of[numbers], weight.astype(np.float32)
            # no value can exceed this: greatest weight of each subsequence in the group, least possible norm
            bound = np.einsum("wsg,s->wg", self.most[rows], w) * np.float32(1.001 / math.sqrt(float((weight ** 2).sum())))
            near = np.flatnonzero((bound > FLOOR).any(axis=1))
            if not len(near):
                continue
            bound, rows, norms = bound[near], rows[near], _norms(numbers[near], weight)
            values = np.zeros((len(near), self.m), np.float32)
            for g, (columns, part) in enumerate(zip(self.columns, self.parts)):
                own = np.flatnonzero(bound[:, g] > FLOOR)
                if len(own):
                    values[np.ix_(own, columns)] = np.einsum("wsm,s->wm", part[rows[own]], w) / norms[own][:, None]
            values = np.where(values > FLOOR, values, 0) ** POWER
            for k in np.flatnonzero(values.any(axis=1)):
                i = int(where[near[k]])
                found[i] = np.maximum(found[i], values[k]) if i in found else values[k]
        return found


class Sentences:
    """Feature vectors of the sentences of texts that have a similar word."""

    def __init__(self, landmarks: list[str]):
        self.kernel = Similarity(landmarks)
        self._forget()

    def _forget(self) -> None:
        # words met, words without skipped characters at their edges that were compared, values of words and of these
        self.known, self.compared, self.similar, self.values = set(), set(), {}, {}

    @staticmethod
    def read(text: bytes | None) -> tuple[str, set]:
        """Lower-case text with runs of single letters put together, and its distinct words."""
        text = (text or b"").decode().lower()
        words = text.split()
        if _TWO in array("I", map(len, words)).tobytes():
            text = _SPACED.sub(lambda m: m[0].replace(" ", "").replace("\t", ""), text)
            words = text.split()
        return text, set(words)

    def learn(self, words: list[set]) -> None:
        """Kernel values of the words not met before."""
        if len(self.known) > _CACHE:
            self._forget()
        new = set().union(*words) - self.known
        self.known |= new
        bare = {w: w.strip(_EDGES) for w in new}
        open_ = list(set(bare.values()) - self.compared)
        self.compared.update(open_)
        self.values.update((open_[i], v) for i, v in self.kernel.of(open_).items())
        self.similar.update((w, self.values[c]) for w, c in bare.items() if c in self.values)

    def features(self, text: str, words: set) -> np.ndarray | None:
        """Rows of features, one for each sentence with a similar word; None if there is none."""
        similar = {w: self.similar[w] for w in words & self.similar.keys()}
        if not similar:
            return None
        rows = []
        for line in text.split("\n"):
            line, near = line.split(), []
            if similar.keys().isdisjoint(line):
                continue
            for w in line:
                if w in similar:
                    near.append(similar[w])
                if w[-1] in ".!?" and near:
                    rows.append(np.max(near, axis=0))
                    near = []
            if near:
                rows.append(np.max(near, axis=0))
        return np.array(rows)


def _texts(batches, landmarks):
    """(batch, [features or None for each row])"""
    reader = Sentences(landmarks)
    for batch in text_batches(batches, "text", _PIECE):
        texts = [reader.read(t) for t in utf8(batch.column("text"))]
        reader.learn([w for _, w in texts])
        yield batch, [reader.features(t, w) for t, w in texts]


def _unit_batches(batches):
    for batch in text_batches(batches, "text", _PIECE):
        words, toxic = [], []
        for text, label in zip(utf8(batch.column("text")), batch.column("toxic").to_pylist()):
            codes, ends = letter_codes(list(Sentences.read(text)[1]))
            line = "".join(map(_SHOWN.__getitem__, codes.tolist()))
            own = {line[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist()) if 3 <= j - i <= LONGEST}
            words += own
            toxic += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())],
                                         names=["word", "toxic"])


def _vector_batches(landmarks):
    """Vectors of all sentences with a similar word, a document a row."""
    def run(batches):
        for batch, found in _texts(batches, landmarks):
            rows = [[] if f is None else np.unique(f, axis=0, return_counts=True) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("toxic"),
                 pa.array([r[0].ravel() if r else [] for r in rows], pa.list_(pa.float32())),
                 pa.array([r[1] if r else [] for r in rows], pa.list_(pa.int64()))], names=["_id", "toxic", "rows", "times"])
    return run


def _score_batches(landmarks, v: np.ndarray, b: float, slope: float, shift: float):
    def run(batches):
        for batch, found in _texts(batches, landmarks):
            margin = np.array([b if f is None else max(b, float((f @ v).max() + b)) for f in found])
            score = 1 / (1 + np.exp(-(slope * margin + shift)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)],
                                             names=["doc_id", "held_out", "score"])
    return run


def _bags(batch, m: int):
    """(toxic?, vectors, how often each occurs) of documents; the last vector stands for sentences without a similar word."""
    for toxic, rows, times in zip(batch.column("toxic").to_pylist(), batch.column("rows"), batch.column("times")):
        x = rows.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, m)
        yield toxic > 0, np.vstack([x, np.zeros((1, m))]), np.append(times.values.to_numpy(zero_copy_only=False), 1)


def _step_sums(m: int, root: np.ndarray, v: np.ndarray, w: np.ndarray):
    """What a batch adds to a Newton step: for toxic and clean documents the number of sentences, and of those
    inside the margin the vectors' sum and the sum of their products."""
    def part(batch):
        picked, clean, often = [np.zeros((0, m))], [np.zeros((0, m))], [np.zeros(0)]
        for toxic, x, times in _bags(batch, m):
            if toxic:
                picked.append(x[[int(np.argmax(x @ v))]])
            else:
                clean.append(x)
                often.append(times)
        out = []
        for sign, x, times in ((1, np.vstack(picked), None), (-1, np.vstack(clean), np.concatenate(often))):
            x = np.hstack([x @ root, np.ones((len(x), 1))])
            times = np.ones(len(x)) if times is None else times
            inside = sign * (x @ w) < 1
            a = x[inside] * times[inside][:, None]
            out += [[times.sum()], a.sum(axis=0), (a.T @ x[inside]).ravel()]
        return np.concatenate(out)
    return part


def _summed(table: DataFrame, part, width: int) -> np.ndarray:
    """Sum over the partitions of ``table``, in their order, of the numbers that ``part`` makes of a batch."""
    def run(batches):
        from pyspark import TaskContext

        total = sum((part(b) for b in batches if b.num_rows), np.zeros(width))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          pa.array([total], pa.list_(pa.float64()))], names=["part", "sums"])
    rows = table.mapInArrow(run, "part int, sums array<double>").toArrow()      # a row a partition
    order = np.argsort(rows.column("part").to_numpy())
    sums = [row.values.to_numpy() for row in rows.column("sums")]
    return sum((sums[i] for i in order), np.zeros(width))


def _svm(table: DataFrame, root: np.ndarray, v: np.ndarray, w: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss, classes weighed alike, by Newton steps from ``w``: weights and constant."""
    m = len(root)
    keep = np.eye(m + 1) * 1e-2
    keep[-1, -1] = 1e-6
    size = 1 + (m + 1) + (m + 1) ** 2
    for _ in range(rounds):
        both = np.split(_summed(table, _step_sums(m, root, v, w), 2 * size), 2)
        left, right = keep.copy(), np.zeros(m + 1)
        for sign, one in zip((1, -1), both):
            c = cost / (2 * max(1.0, one[0]))
            right += sign * c * one[1:m + 2]
            left += c * one[m + 2:].reshape(m + 1, m + 1)
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _margins(m: int, v: np.ndarray, b: float):
    def run(batches):
        for batch in batches:
            own = [(int(toxic), float((x @ v).max() + b)) for toxic, x, _ in _bags(batch, m)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in own], pa.int32()), pa.array([x for _, x in own], pa.float64())],
                                             names=["toxic", "margin"])
    return run


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label)."""
    x = np.column_stack([margin, np.ones(len(margin))])
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - t) + 1e-3 * (w - [1, 0])
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2), grad)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, sample: int = SAMPLE,
        n_landmarks: int = LANDMARKS) -> dict:
    """Landmarks, sentence weights and calibration from the training documents among the labelled ones."""
    chosen = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                           & (id_remainder(F.col("doc_id"), modulus) != remainder))
              .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = (docs.select("doc_id", "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")),
                                                F.col("doc_id") == F.col("_id")).select("_id", "text", "toxic"))
    n1, n = (x or 0 for x in texts.agg(F.sum("toxic"), F.count(F.lit(1))).first())
    if not 0 < n1 < n:
        share = (n1 + 1) / (n + 2)
        return {"landmarks": [], "v": np.zeros(0), "b": 0.0, "slope": 0.0, "shift": math.log(share / (1 - share))}
    n0 = n - n1
    told = (texts.mapInArrow(_unit_batches, "word string, toxic int").groupBy("word")
            .agg(F.sum("toxic").alias("a"), (F.count(F.lit(1)) - F.sum("toxic")).alias("b")))
    gain = F.col("a") * F.log((F.col("a") + 0.5) / (F.col("b") + 0.5) * F.lit(n0 / n1))
    rows = (told.where(F.col("a") * n0 > 2 * F.col("b") * n1).where(2 * gain > LEAST_GAIN)
            .orderBy(F.desc(gain), "word").limit(n_landmarks).select("word").collect())
    landmarks = [r.word for r in rows]
    if not landmarks:
        share = (n1 + 1) / (n + 2)
        return {"landmarks": [], "v": np.zeros(0), "b": 0.0, "slope": 0.0, "shift": math.log(share / (1 - share))}
    id_type = docs.schema["doc_id"].dataType.simpleString()
    table = stored(texts.mapInArrow(_vector_batches(landmarks), f"_id {id_type}, toxic int, rows array<float>, times array<long>")
                   .repartition(_FOLDS, "_id").sortWithinPartitions("_id", F.size("rows"), "rows"), "toxicity-vectors")
    m = len(landmarks)
    kernel = Similarity(landmarks)
    gram = np.zeros((m, m))
    for k, codes in _grouped(landmarks):
        numbers, weight = subsequences(codes)
        gram[k] = ((kernel.table[kernel.row_of[numbers]] * weight[None, :, None]).sum(axis=1) / _norms(numbers, weight)[:, None]) ** POWER
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    v, w = np.ones(m), np.zeros(m + 1)
    for _ in range(4):
        w = _svm(table, root, v, w)
        v, b = root @ w[:-1], float(w[-1])
    judged = table.mapInArrow(_margins(m, v, b), "toxic int, margin double").toPandas()    # SAMPLE rows at most
    judged = judged.sort_values(["margin", "toxic"])      # sums depend on the order
    y = np.where(judged["toxic"].to_numpy() > 0, 1.0, -1.0)
    slope, shift = _calibrate(judged["margin"].to_numpy(), y)
    return {"landmarks": landmarks, "v": v, "b": b, "slope": slope, "shift": shift}


def score(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = 0.3,
          **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``."""
    model = fit(docs, labels, modulus, remainder, **options)
    held_out = F.coalesce(id_remainder(F.col("doc_id"), modulus) == remainder, F.lit(False))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        _score_batches(**model), f"doc_id {id_type}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
