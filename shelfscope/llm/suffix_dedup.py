"""Suffix de-duplication: bytes covered by a ``WIDTH``-byte string that also starts earlier are removed.

Two equal windows of WIDTH bytes have the same least-hashed GRAM-byte string at
the same place, so comparing the contexts of these *anchors* (about one byte in
35) finds every repeated window.  Four steps, all over the whole table:

1. Fingerprints.  Tasks send the fingerprints of their anchors' first GRAM
   bytes; only anchors whose fingerprint occurs again stay in play: for all
   others that prefix already tells the suffix apart from every other one.
2. Runs.  The suffixes at these anchors (up to WIDTH bytes, with up to
   WIDTH - GRAM bytes to their left) are sorted in the tasks.  Of equal
   contexts a run keeps the earliest, the others are repeats at once, which
   holds frequent passages to one entry a run.  Runs are front-coded: the
   length of the prefix shared with the string before, then the rest.
3. Merge.  Runs meet by prefix and are merged by loser trees that carry the
   length of the prefix each loser shares with the last string put out: where
   two lengths differ the order is known, where they are equal comparison
   starts behind them.  The merge yields the order and the shared lengths.  A
   window with ``x`` bytes left of its anchor repeats an earlier one if both
   share WIDTH - x bytes to the right and x to the left.
4. Removal.  Documents meet their covered stretches; the rest is hashed.

A prefix with more than ``hot`` anchors is not gathered: each of its windows
becomes a string of its own, dealt by its full content, so that only equal
windows meet, of which every run sends one.

The documents' texts cross the network once: both joins use one exchange.

Defined results: a null text is empty; documents come in the order of doc_id;
repeated or null ids get an order of their own first (null first, then id and
content), and equal rows are documents like any other, the later a copy of the
earlier; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import row_key, small, stored, text_batches, utf8

WIDTH = 100
GRAM = 32
LEFT = WIDTH - GRAM   # bytes to the left of an anchor that its windows can reach
HOT = 50_000          # anchors of one prefix that are gathered, at most
FAN_IN = 512          # runs a loser tree merges at a time
_PIECE = 4 << 20
_RUN = 60_000         # contexts sorted into one run
_PRIME = 0x9E3779B97F4A7C15


# ------------------------------------------------------------------ anchors
def _slide(a: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of a[i : i + width] for every i (shorter at the end), by doubling."""
    out, have = a.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = best(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of texts laid end to end, and their fingerprints."""
    n = len(data)
    if n < WIDTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_PRIME)
    h ^= h >> np.uint64(31)
    factor, width = 0xD6E8FEB86659FD93, 1
    while width < GRAM:  # h[i]: hash of data[i : i + width]
        h[:-width] = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor & 0xFFFFFFFFFFFFFFFF, width * 2
    prints = h * np.uint64(_PRIME)
    prints ^= prints >> np.uint64(32)
    rank = (prints >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    left = np.repeat(ends, ends - begins) - np.arange(n)  # bytes to the end of the text
    rank[left < GRAM] = 0xFFFFFFFF
    least = _slide(rank, WIDTH - GRAM + 1, np.minimum)
    least[left < WIDTH] = 0  # no window begins here
    # greatest of the least values of the windows that hold place i: equal to its rank if it is one of them
    most = _slide(least[::-1], WIDTH - GRAM + 1, np.maximum)[::-1]
    places = np.flatnonzero((most == rank) & (left >= GRAM))
    return places, prints[places]


def _pack(**arrays) -> bytes:
    import zstandard

    body = b"".join(a.tobytes() for a in arrays.values())
    head = ",".join(f"{k}:{a.dtype.str}:{len(a)}" for k, a in arrays.items()).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + body)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, out = int.from_bytes(raw[:4], "little"), {}
    at = 4 + n
    for name, kind, size in (x.split(":") for x in raw[4:at].decode().split(",")):
        a = np.frombuffer(raw, np.dtype(kind), int(size), at)
        out[name], at = a, at + a.nbytes
    return out


def _blobs(bucket: np.ndarray, **arrays):
    """One packed row for each bucket; entries keep their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), _pack(**{k: a[part] for k, a in arrays.items()})


def _send(rows):
    rows = list(rows)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()),
                                          pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"])


def _laid_out(batch):
    """(data, begins, ends) of a batch's texts end to end."""
    texts = [t or b"" for t in utf8(batch.column("text"))]
    ends = np.cumsum([0, *map(len, texts)])
    return np.frombuffer(b"".join(texts), np.uint8), ends[:-1], ends[1:]


def _print_batches(buckets: int):
    def run(batches):
        for batch in text_batches(batches, "text", _PIECE):
            data, begins, ends = _laid_out(batch)
            places, prints = anchors(data, begins, ends)
            which = np.searchsorted(ends, places, side="right")
            docs = batch.column("id").to_numpy()[which]
            order = np.argsort(prints, kind="stable")
            prints, docs, at = prints[order], docs[order], (places - begins[which])[order].astype(np.int32)
            first = np.r_[True, prints[1:] != prints[:-1]] if len(prints) else np.empty(0, bool)
            times = np.diff(np.r_[np.flatnonzero(first), len(prints)])
            # the first of equal prints speaks for all of them; the others are known to occur again
            n = np.zeros(len(prints), np.int32)
            n[first] = times
            known = np.repeat(times > 1, times)
            bucket = np.where(first, prints >> np.uint64(32), (prints >> np.uint64(7)) + np.arange(len(prints), dtype=np.uint64))
            yield from _send(_blobs((bucket % np.uint64(buckets)).astype(np.int32), p=prints, d=docs, at=at, n=n,
                                    k=known.astype(np.uint8)))
    return run


def _by_bucket(batches):
    """(bucket, [unpacked blobs]) from rows that come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append(_unpack(blob))
    if held:
        yield now, held


def _repeat_batches(hot: int):
    """Anchors whose print occurs again (hot null), and prints with more than ``hot`` anchors (id null)."""
    def run(batches):
        for _, blobs in _by_bucket(batches):
            p, d, at, n, k = (np.concatenate([b[c] for b in blobs]) for c in ("p", "d", "at", "n", "k"))
            values, back, times = np.unique(p, return_inverse=True, return_counts=True)
            own = np.bincount(back, n > 0, len(values))[back] > 1
            stay = (k > 0) | own
            many = values[np.bincount(back, n, len(values)) > hot].view(np.int64)
            none = pa.nulls(len(many), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(d[stay]), none]), pa.concat_arrays([pa.array(at[stay]), none.cast(pa.int32())]),
                 pa.array(np.r_[p[stay].view(np.int64), many])], names=["id", "at", "print"])
    return run


# ------------------------------------------------------------------ runs
def _words(m: np.ndarray) -> list[np.ndarray]:
    """Columns for sorting byte rows, most significant first."""
    wide = np.zeros((len(m), -(-m.shape[1] // 8) * 8), np.uint8)
    wide[:, :m.shape[1]] = m
    return list(wide.view(">u8").astype(np.uint64).T)


def _shared(m: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the row before (0 for the first)."""
    if len(m) < 2:
        return np.zeros(len(m), np.int64)
    differs = m[1:] != m[:-1]
    first = differs.argmax(axis=1)
    return np.r_[0, np.where(differs.any(axis=1), first, m.shape[1])]


class Contexts:
    """Suffixes of anchors (``right``), what stands before them (``left``, nearest byte first), and whose they are.

    ``llen`` -1: the window as such, dealt by all its bytes."""

    def __init__(self, right, left, rlen, llen, doc, at):
        self.right, self.left, self.rlen, self.llen, self.doc, self.at = right, left, rlen, llen, doc, at

    @classmethod
    def read(cls, data, begins, ends, which, places, docs, reach: int = LEFT):
        pad = np.r_[data, np.zeros(WIDTH, np.uint8)]
        rlen = np.minimum(WIDTH, ends[which] - places)
        llen = np.minimum(reach, places - begins[which])
        right = pad[places[:, None] + np.arange(WIDTH)]
        right[np.arange(WIDTH) >= rlen[:, None]] = 0
        left = pad[np.maximum(places[:, None] - 1 - np.arange(LEFT), 0)]
        left[np.arange(LEFT) >= llen[:, None]] = 0
        return cls(right, left, rlen, llen, docs[which], (places - begins[which]))

    @classmethod
    def together(cls, parts):
        return cls(*(np.concatenate([getattr(p, f) for p in parts])
                     for f in ("right", "left", "rlen", "llen", "doc", "at")))

    def take(self, index):
        return Contexts(self.right[index], self.left[index], self.rlen[index], self.llen[index], self.doc[index],
                        self.at[index])

    def whole(self, index):
        """(doc, from, to) that all windows of entries cover."""
        least, most = np.maximum(0, WIDTH - self.rlen[index]), np.maximum(self.llen[index], 0)
        ok = least <= most
        return (self.doc[index][ok], (self.at[index] - most)[ok], (self.at[index] - least + WIDTH)[ok])

    def distinct(self):
        """Entries in string order, the earliest of equal contexts; and the others, which are repeats."""
        order = np.lexsort([self.at, self.doc, self.llen, self.rlen, *_words(self.left)[::-1], *_words(self.right)[::-1]])
        s = self.take(order)
        if not len(order):
            return s, order
        same = ((s.right[1:] == s.right[:-1]).all(axis=1) & (s.left[1:] == s.left[:-1]).all(axis=1)
                & (s.rlen[1:] == s.rlen[:-1]) & (s.llen[1:] == s.llen[:-1]))
        first = np.r_[True, ~same]
        return s.take(np.flatnonzero(first)), order[~first]


def _covered_blobs(stretches, buckets: int):
    doc, a, b = stretches
    yield from _blobs((doc % buckets).astype(np.int32), cd=doc, ca=a.astype(np.int64), cb=b.astype(np.int64))


def _run_batches(buckets: int):
    """Front-coded sorted runs, and the stretches of repeats met while sorting."""
    def send(parts):
        if not parts:
            return
        kept, repeats = Contexts.distinct(every := Contexts.together(parts))
        if len(repeats):
            yield from _send(_covered_blobs(every.whole(repeats), buckets))
        if not len(kept.doc):
            return
        # strings that share GRAM bytes (all bytes, where nothing to the left counts) must meet
        key = np.zeros(len(kept.doc), np.uint64)
        single = kept.llen < 0
        for j, word in enumerate(_words(kept.right)):
            use = np.uint64(0xFFFFFFFFFFFFFFFF) if j < GRAM // 8 else np.where(single, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
            key = (key ^ (word & use)) * np.uint64(_PRIME)
            key ^= key >> np.uint64(29)
        bucket = (key >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        rows = []
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            s = kept.take(part)
            shared = np.minimum(_shared(s.right), s.rlen)
            cols = np.arange(WIDTH)
            rest = s.right[(cols >= shared[:, None]) & (cols < s.rlen[:, None])]
            before = s.left[np.arange(LEFT) < s.llen[:, None]]
            rows.append((int(bucket[part[0]]), _pack(
                shared=shared.astype(np.uint8), rlen=s.rlen.astype(np.uint8), llen=s.llen.astype(np.int8), rest=rest,
                before=before, doc=s.doc, at=s.at.astype(np.int32))))
        yield from _send(rows)

    def run(batches):
        parts, held = [], 0
        for batch in text_batches(batches, "text", _PIECE):
            data, begins, ends = _laid_out(batch)
            docs = batch.column("id").to_numpy()
            for column, hot in (("at", False), ("hot_at", True)):
                lists = batch.column(column)
                which = np.repeat(np.arange(len(docs)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                places = begins[which] + lists.flatten().to_numpy()
                if hot and len(places):
                    # every window around a hot anchor is a string of its own
                    starts = np.unique((places[:, None] - np.arange(LEFT + 1)).ravel())
                    which = np.searchsorted(ends, np.maximum(starts, 0), side="right")
                    ok = (starts >= 0) & (which < len(ends))
                    ok[ok] = starts[ok] + WIDTH <= ends[which[ok]]
                    which, places = which[ok], starts[ok]
                for at in range(0, len(places), _RUN):
                    part = Contexts.read(data, begins, ends, which[at:at + _RUN], places[at:at + _RUN], docs,
                                         0 if hot else LEFT)
                    if hot:
                        part.llen = np.full(len(part.llen), -1)
                    parts.append(part)
                    held += len(part.doc)
                    if held >= _RUN:
                        yield from send(parts)
                        parts, held = [], 0
        yield from send(parts)
    return run


# ------------------------------------------------------------------ merge
def _decode(blob) -> tuple[list[bytes], list[int]]:
    """Strings of a front-coded run and the lengths each shares with the one before."""
    shared, rlen, rest = blob["shared"].tolist(), blob["rlen"].tolist(), blob["rest"].tobytes()
    out, last, at = [], b"", 0
    for s, n in zip(shared, rlen):
        last = last[:s] + rest[at:at + n - s]
        at += n - s
        out.append(last)
    return out, shared


def merge_runs(runs: list[tuple[list, list]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Loser-tree merge of (strings, shared lengths): order as (run, place), and the shared lengths of the result."""
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    shares = [r[1] for r in runs] + [[]] * (k - len(runs))
    head, have = [0] * k, [0 if s else -1 for s in strings]  # have: bytes shared with the last string put out
    loser = [0] * k

    def contest(c: int, o: int) -> tuple[int, int]:
        """(winner, loser); the loser's length becomes what it shares with the winner."""
        a, b = have[c], have[o]
        if a != b:
            return (c, o) if a > b else (o, c)
        if a < 0:
            return c, o
        x, y = strings[c][head[c]], strings[o][head[o]]
        end = min(len(x), len(y))
        while a < end and x[a] == y[a]:
            a += 1
        if a == end:
            first = len(x) < len(y) or len(x) == len(y) and c < o
        else:
            first = x[a] < y[a]
        win, lose = (c, o) if first else (o, c)
        have[lose] = a
        return win, lose

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, loser[node] = contest(build(2 * node), build(2 * node + 1))
        return win
    winner = build(1)
    order, shared = [], []
    while have[winner] >= 0:
        place = head[winner]
        order.append((winner, place))
        shared.append(have[winner])
        head[winner] = place = place + 1
        have[winner] = shares[winner][place] if place < len(strings[winner]) else -1
        node = (winner + k) >> 1
        while node:
            winner, loser[node] = contest(winner, loser[node])
            node >>= 1
    return order, shared


def _merged(blobs: list[dict]) -> tuple[Contexts, np.ndarray]:
    """All entries of a bucket in string order, and the lengths neighbours share."""
    level = [(*_decode(b), [(i, j) for j in range(len(b["doc"]))]) for i, b in enumerate(blobs)]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), FAN_IN):
            own = level[at:at + FAN_IN]
            order, shared = merge_runs([(s, h) for s, h, _ in own])
            above.append(([own[r][0][i] for r, i in order], shared, [own[r][2][i] for r, i in order]))
        level = above
    strings, shared, origin = level[0]
    offset = np.r_[0, np.cumsum([len(b["doc"]) for b in blobs])]
    order = offset[[i for i, _ in origin]] + np.array([j for _, j in origin], np.int64)
    rlen = np.concatenate([b["rlen"] for b in blobs]).astype(np.int64)[order]
    llen = np.concatenate([b["llen"] for b in blobs]).astype(np.int64)
    right = np.zeros((len(order), WIDTH), np.uint8)
    right[np.arange(WIDTH) < rlen[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    left = np.zeros((len(order), LEFT), np.uint8)
    left[np.arange(LEFT) < llen[:, None]] = np.concatenate([b["before"] for b in blobs])
    doc, at = (np.concatenate([b[c] for b in blobs])[order] for c in ("doc", "at"))
    return Contexts(right, left[order], rlen, np.maximum(llen[order], 0), doc, at.astype(np.int64)), np.array(shared)


def repeats(c: Contexts, shared: np.ndarray):
    """(doc, from, to) of the stretches whose windows start earlier elsewhere; ``c`` in string order."""
    n = len(c.doc)
    by_left = np.lexsort(_words(c.left)[::-1])
    left_shared = _shared(c.left[by_left])
    early = np.lexsort([c.at, c.doc])  # earliest first: the first of a class is the original
    hit = np.zeros((n, LEFT + 2), bool)
    left_class = np.empty(n, np.int64)
    for x in range(LEFT + 1):
        ok = (c.rlen >= WIDTH - x) & (c.llen >= x)
        if not ok.any():
            continue
        right_class = np.cumsum(shared < WIDTH - x)
        left_class[by_left] = np.cumsum(left_shared < x) if x else 0
        own = early[ok[early]]
        key = right_class[own] * (n + 1) + left_class[own]
        _, first = np.unique(key, return_index=True)
        if len(first) < len(own):
            again = np.ones(len(own), bool)
            again[first] = False
            hit[own[again], x + 1] = True
    # runs of neighbouring x: windows at - x, each WIDTH bytes long
    edge = np.diff(hit.astype(np.int8), axis=1, append=0)
    row, start = np.nonzero(edge > 0)
    row2, stop = np.nonzero(edge < 0)
    return c.doc[row], c.at[row] - (stop - 1), c.at[row] - start + WIDTH


def _merge_batches(batches):
    """Covered stretches (id, from, to)."""
    for _, blobs in _by_bucket(batches):
        found = [(b["cd"], b["ca"], b["cb"]) for b in blobs if "cd" in b]
        runs = [b for b in blobs if "doc" in b]
        if runs:
            merged, shared = _merged(runs)
            # prefixes that occur once need no comparison
            group = np.cumsum(shared < GRAM)
            many = np.flatnonzero(np.bincount(group)[group] > 1)
            if len(many):
                # what a dropped entry shares with its neighbour is less than GRAM, and so stays below every test
                part = shared[many].copy()
                part[0] = 0
                found.append(repeats(merged.take(many), part))
        if found:
            doc, a, b = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))],
                                             names=["id", "a", "b"])


# ------------------------------------------------------------------ removal
def _removal_batches(with_text: bool):
    def run(batches):
        for batch in text_batches(batches, "text", 4 * _PIECE):
            out = []
            lists = [batch.column(c).to_pylist() for c in ("a", "b")]
            for text, a, b in zip(utf8(batch.column("text")), *lists):
                text, kept, end, removed, spans = text or b"", [], 0, 0, 0
                for lo, hi in sorted(zip(a or (), b or ())):
                    if lo > end or not spans:
                        spans += 1
                        kept.append(text[end:lo])
                        removed += hi - lo
                        end = hi
                    elif hi > end:
                        removed += hi - end
                        end = hi
                kept.append(text[end:])
                kept = b"".join(kept)
                out.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:5 if with_text else 4]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds[:len(names)]))],
                                             names=["doc_id", *names])
    return run


def dedup(docs: DataFrame, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for,
    the bytes that are left as ``kept``."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("doc_id").cast("long").alias("id"), "text")
    if not texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").isEmpty():
        texts = stored(docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("k"), "text")
                       .repartitionByRange(F.col("doc_id").asc_nulls_first(), "k")
                       .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "k")
                       .select("doc_id", F.monotonically_increasing_id().alias("id"), "text"), "suffix-documents")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    prints = texts.select("id", "text").mapInArrow(_print_batches(buckets), "bucket int, blob binary")
    again = stored(prints.repartition("bucket").sortWithinPartitions("bucket")
                   .mapInArrow(_repeat_batches(hot), "id long, at int, print long"), "suffix-anchors")
    places = again.where("id is not null")
    many = again.where("id is null").select("print").distinct()
    if many.isEmpty():
        places = places.withColumn("hot", F.lit(False))
    else:
        places = places.join(small(many.withColumn("hot", F.lit(True))), "print", "left")
    places = places.groupBy("id").agg(F.collect_list(F.when(~F.coalesce("hot", F.lit(False)), F.col("at"))).alias("at"),
                                      F.collect_list(F.when(F.col("hot"), F.col("at"))).alias("hot_at"))
    runs = (texts.join(places, "id").select("id", "text", "at", "hot_at")
            .mapInArrow(_run_batches(buckets), "bucket int, blob binary"))
    covered = (runs.repartition("bucket").sortWithinPartitions("bucket")
               .mapInArrow(_merge_batches, "id long, a long, b long")
               .groupBy("id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return (texts.join(covered, "id", "left").select("doc_id", "text", "a", "b")
            .mapInArrow(_removal_batches(with_text), schema + (", kept binary" if with_text else "")))
