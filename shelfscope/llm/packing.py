"""Mixture-controlled packing of documents into training windows.

Each source is a queue of its documents' tokens.  Deficit round-robin fills the
windows: at every window a queue's deficit grows by its target share of the window,
the queue that is furthest behind is served next (what it is behind, ``grain`` tokens
at least, so that documents aren't cut to crumbs), and what a queue got too much or too
little is carried to the next window.  Documents are cut only where a window or a
serving ends; no token is lost and none is padding, because the last tokens of the
table, too few for a window, become windows whose lengths are powers of two.

The round-robin runs in parallel over blocks of windows.  Which tokens of a queue a
block gets follows from the targets alone: ordered by ``(2j+1) / (2 * weight)`` for the
j-th token of a queue, the first N tokens of all queues hold every queue's share within
one token or so, for every N, and more tokens never take one away again.  A block thus
starts with the deficits that the block before it leaves.  Steps:

1. tokens of every document and their place in the queue within the task (stored once);
2. sums per task and source (narrow) turn these into places in the whole queue;
3. documents are cut at block borders and dealt out by block, once;
4. each block, of bounded size, is filled by the round-robin.

Token ids travel as 2 bytes where the vocabulary allows.  A source's hot share is split
over all blocks.  Sources beyond the ``MAX_QUEUES - 1`` largest share one queue, which
bounds the state of a block.

Defined results: a null text counts as empty, so its document is the end token alone;
rows are independent, so repeated rows and null ids are packed as they are; a null
source is a source of its own; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
import math
import os
import re
import zlib
from bisect import bisect_left
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import small, stored, text_batches

LENGTH = 2048
GRAIN = 64              # tokens of a serving, at least
BLOCK = 256             # windows of a block
MAX_QUEUES = 4096
PIECE = 4 << 20         # bytes of text handled at a time
STORE_BYTES = 64 << 20  # of words whose ids a task remembers


# ------------------------------------------------------------------ tokens
@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"    # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


# bytes of a text: how they are told apart
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), list(b" \t\n\r"))
_ASCII_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"))
_MARK = np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_LETTERS_ONLY = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")    # a to z and Latin-1 letters
_JOINED = 1000      # words of letters that are encoded in one call


@lru_cache(maxsize=2)
def _word_ends(path: str) -> np.ndarray | None:
    """Which ids end a word, for a tokenizer that lower-cases and reads a run of letters by itself; None for others
    (probed: letters of any case, a mark behind letters, words side by side)."""
    t = _tokenizer(path)

    def ids(text):
        return t.encode(text, add_special_tokens=False).ids
    suffix = getattr(t.model, "end_of_word_suffix", None)
    if not suffix or ids("Word") != ids("word") or ids("word \u00e9t\u00e9\nx") != ids("word") + ids("\u00e9t\u00e9") + ids("x"):
        return None
    if any(ids(f"it{chr(m)}{more}") != ids("it") + ids(chr(m) + more) for m in np.flatnonzero(_MARK) for more in ("", "s", "'ll.", "!")):
        return None
    vocabulary = t.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True
    return out


class WordCoder:
    """Ids of whole texts by a tokenizer that drops white space, each distinct word encoded once while it is remembered.

    Texts are handled as the bytes of a whole batch.  Words are what stands between blanks; where the tokenizer
    allows it (``_word_ends``) they are lower-cased in ASCII and cut between a letter and a mark, and words of
    letters are encoded many in one call, told apart by the ids that end a word.  Texts that hold a capital sigma
    (its lower case depends on what is around it) or ``<|`` (special tokens) are cut at blanks only."""

    def __init__(self, path: str, end: int, kind, store_bytes: int = STORE_BYTES):
        self.tokenizer, self.end, self.kind, self.limit = _tokenizer(path), end, kind, store_bytes
        self.ends_word = _word_ends(path)
        self._forget()

    def _forget(self) -> None:
        self.store, self.held = {}, 0
        self.flat, self.lengths = [], []

    def _learn(self, words: list[bytes]) -> None:
        """Put the ids of new words behind those known."""
        joined = [w for w in words if _LETTERS_ONLY.fullmatch(w)] if self.ends_word is not None else []
        if joined:
            lines = [b" ".join(joined[k:k + _JOINED]).decode() for k in range(0, len(joined), _JOINED)]
            coded = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(c.ids for c in coded), self.kind)
            self._add(joined, ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1))
        letters = set(joined)
        others = [w for w in words if w not in letters]
        if others:
            coded = [c.ids for c in self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False)]
            self._add(others, np.fromiter(chain.from_iterable(coded), self.kind), np.array([len(i) for i in coded], np.int64))

    def _add(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        if len(lengths) != len(words):
            raise ValueError("the tokenizer did not end every word")
        self.store.update(zip(words, range(len(self.store), len(self.store) + len(words))))
        self.flat.append(ids)
        self.lengths.append(lengths)
        self.held += sum(map(len, words)) + 120 * len(words) + ids.nbytes

    def _words(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of all texts in a row, and how many each text and those before it have."""
        data = column.cast(pa.binary()).fill_null(b"")
        at = np.frombuffer(data.buffers()[1], np.int32)[data.offset:data.offset + len(data) + 1]
        raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
        at = at - at[0]
        blank = _BLANK[raw]
        start = np.zeros(len(raw), bool)
        start[at[:-1][at[:-1] < at[1:]]] = True
        start[1:] |= blank[:-1]
        if self.ends_word is not None:
            special = np.zeros(len(raw), bool)
            special[1:] = ((raw[:-1] == 0xCE) & (raw[1:] == 0xA3)) | ((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))
            low = _LOWER[raw]
            letter = _ASCII_LETTER[low]
            letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
            cut = np.zeros(len(raw), bool)
            cut[1:] = letter[:-1] & _MARK[raw[1:]]
            for text in np.unique(np.searchsorted(at, np.flatnonzero(special), side="right") - 1):
                low[at[text]:at[text + 1]] = raw[at[text]:at[text + 1]]
                cut[at[text]:at[text + 1]] = False
            raw, start = low, start | cut
        starts = np.flatnonzero(start & ~blank)
        kept = raw[~blank]
        places = np.append((np.cumsum(~blank) - ~blank)[starts], len(kept)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(kept)])
        return words, np.searchsorted(starts, at[1:])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each text's followed by the end id; where each text's ids end)."""
        words, counts = self._words(column)
        coded = words.dictionary_encode()
        own = coded.dictionary.to_pylist()
        self._learn([w for w in own if w not in self.store])
        flat, lengths = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.flat, self.lengths))
        self.flat, self.lengths = [flat], [lengths]
        word = np.fromiter(map(self.store.__getitem__, own), np.int64, len(own))[coded.indices.to_numpy()]
        n = lengths[word]
        ends = np.cumsum(n)
        place = np.repeat(((np.cumsum(lengths) - lengths)[word] - (ends - n)).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        ids = flat[place].astype(self.kind, copy=False)
        upto = np.append(0, ends)[counts]
        if self.held > self.limit:
            self._forget()
        return np.insert(ids, upto, self.end), upto + np.arange(1, len(upto) + 1)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, ends = self.encode(pa.array(texts, pa.string()))
        return np.split(ids, ends[:-1]) if texts else []


def _tokens(path: str, end: int, kind: str, n_keys: int):
    def run(batches):
        from pyspark import TaskContext

        coder, seen, task = WordCoder(path, end, np.dtype(kind)), {}, TaskContext.get().partitionId()
        for batch in text_batches(batches, "text", PIECE):
            ids, ends = coder.encode(batch.column("text"))
            n, before = np.diff(ends, prepend=0), []
            for source, more in zip(batch.column("source").to_pylist(), n.tolist()):
                at = seen.get(source, 0)
                before.append(at)
                seen[source] = at + more
            places = np.append(0, ends * ids.itemsize).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n_keys)), batch.column("source"),
                 pa.array(np.full(len(n), task, np.int32)), pa.array(before, pa.int64()), pa.array(n, pa.int64()),
                 pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(places), pa.py_buffer(ids)])],
                names=[*batch.schema.names[:n_keys], "source", "task", "before", "n", "ids"])
    return run


# ---------------------------------------------------------------- schedule
class Schedule:
    """Which tokens of each queue are among the first N of all, for any N."""

    def __init__(self, tokens: list[int], weights: list[int]):
        self.tokens, self.weights, self.total = tokens, weights, sum(tokens)
        # a queue is used up at level tokens/weight; between two such levels the flow is constant
        order = sorted(range(len(tokens)), key=lambda q: Fraction(tokens[q], weights[q]))
        active, level, count, self.phases = sum(weights), Fraction(0), Fraction(0), []
        for q in order:
            end = Fraction(tokens[q], weights[q])
            if end > level:
                self.phases.append((count, level, active))
                count, level = count + (end - level) * active, end
            active -= weights[q]
        self._starts = [p[0] for p in self.phases]
        self._taken: dict[int, list[int]] = {}

    def level(self, n: int) -> Fraction:
        count, level, active = self.phases[max(0, bisect_left(self._starts, n) - 1)]
        return level + (n - count) / active

    def flow(self, n: int) -> list[Fraction]:
        """Target tokens of each queue among the first ``n``."""
        level = self.level(n)
        return [min(Fraction(t), w * level) for t, w in zip(self.tokens, self.weights)]

    def taken(self, n: int) -> list[int]:
        """Tokens of each queue among the first ``n``, in whole numbers whose sum is ``n``."""
        found = self._taken.get(n)
        if found is None:
            p, q = self.level(n).as_integer_ratio()
            found = [min(t, (2 * w * p + q) // (2 * q)) for t, w in zip(self.tokens, self.weights)]
            rest = n - sum(found)
            if rest > 0:
                heap = [(Fraction(2 * a + 1, 2 * w), k) for k, (a, w) in enumerate(zip(found, self.weights))
                        if a < self.tokens[k]]
            else:
                heap = [(-Fraction(2 * a - 1, 2 * w), -k) for k, (a, w) in enumerate(zip(found, self.weights)) if a]
            heapq.heapify(heap)
            for _ in range(abs(rest)):
                k = abs(heapq.heappop(heap)[1])
                found[k] += 1 if rest > 0 else -1
                if rest > 0 and found[k] < self.tokens[k]:
                    heapq.heappush(heap, (Fraction(2 * found[k] + 1, 2 * self.weights[k]), k))
                elif rest < 0 and found[k]:
                    heapq.heappush(heap, (-Fraction(2 * found[k] - 1, 2 * self.weights[k]), -k))
            if len(self._taken) > 1000:
                self._taken.clear()
            self._taken[n] = found
        return found

    def block_of(self, queue: int, place: int, size: int) -> tuple[int, int]:
        """(block, first place of the queue's next block) of a place in a queue."""
        last = (self.total - 1) // size
        level = Fraction(2 * place + 1, 2 * self.weights[queue])
        count, start, active = self.phases[max(0, bisect_left([p[1] for p in self.phases], level) - 1)]
        block = min(last, max(0, int(count + (level - start) * active) // size))
        while block and self.taken(block * size)[queue] > place:
            block -= 1
        while block < last and self.taken((block + 1) * size)[queue] <= place:
            block += 1
        return block, self.taken(min(self.total, (block + 1) * size))[queue]


def window_lengths(tokens: int, length: int) -> list[int]:
    """Full windows, then powers of two for the rest."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def fill(left: list[int], shares: list[float], deficits: list[float], lengths: list[int],
         grain: int) -> list[tuple[int, int, int, int]]:
    """Deficit round-robin: servings (queue, tokens, window, offset) until all queues are empty.

    ``left``: tokens of each queue, ``lengths`` in total; ``shares`` of a window; ``deficits`` at the start."""
    left, deficits, out = list(left), list(deficits), []
    live = [q for q, n in enumerate(left) if n]
    for window, length in enumerate(lengths):
        for q in live:
            deficits[q] += shares[q] * length
        room = length
        while room:
            q = max(live, key=lambda k: (deficits[k], -k))
            take = min(room, left[q], max(math.floor(deficits[q]), grain))
            out.append((q, take, window, length - room))
            deficits[q] -= take
            left[q] -= take
            room -= take
            if not left[q]:
                live.remove(q)
    return out


# ------------------------------------------------------------------ blocks
def _cut(schedule: Schedule, size: int, width: int, keys: list[str]):
    """Documents cut at block borders."""
    def run(batches):
        ranges: dict[int, tuple[int, int, int]] = {}     # queue: places [from, to) of a block
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, blocks, places, starts, ids = [], [], [], [], []
            for k, (queue, place, n, data) in enumerate(zip(*(batch.column(c).to_pylist()
                                                              for c in ("queue", "place", "n", "ids")))):
                at = 0
                while at < n:
                    low, high, block = ranges.get(queue, (0, 0, 0))
                    if not low <= place + at < high:
                        block, high = schedule.block_of(queue, place + at, size)
                        ranges[queue] = (schedule.taken(block * size)[queue], high, block)
                    to = min(n, high - place)
                    rows.append(k)
                    blocks.append(block)
                    places.append(place + at)
                    starts.append(at)
                    ids.append(data[at * width:to * width])
                    at = to
            again = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(again) for c in [*keys, "source", "queue"]), pa.array(blocks, pa.int64()),
                 pa.array(places, pa.int64()), pa.array(starts, pa.int64()), batch.column("n").take(again),
                 pa.array(ids, pa.binary())],
                names=[*keys, "source", "queue", "block", "place", "start", "doc_tokens", "ids"])
    return run


def _fill_block(schedule: Schedule, size: int, length: int, grain: int, kind: str, keys: list[str]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("queue", "ascending"), ("place", "ascending")])
        block = table.column("block")[0].as_py()
        begin, end = block * size, min(schedule.total, (block + 1) * size)
        had, has = schedule.taken(begin), schedule.taken(end)
        flow, after = schedule.flow(begin), schedule.flow(end)
        left = [b - a for a, b in zip(had, has)]
        servings = fill(left, [float((b - a) / (end - begin)) for a, b in zip(flow, after)],
                        [float(a - b) for a, b in zip(flow, had)], window_lengths(end - begin, length), grain)
        data = np.frombuffer(b"".join(table.column("ids").to_pylist()), kind).astype("<u4")
        # a queue's tokens stand together in data: servings and documents cut it at these places
        at = list(accumulate(left, initial=0))
        froms = np.empty(len(servings), np.int64)
        for k, (queue, take, _, _) in enumerate(servings):
            froms[k] = at[queue]
            at[queue] += take
        bytes_ = np.array([len(b) for b in table.column("ids").to_pylist()], np.int64) // np.dtype(kind).itemsize
        rows_from = np.concatenate([[0], np.cumsum(bytes_)[:-1]])
        cuts = np.union1d(froms, rows_from)
        lengths = np.diff(np.append(cuts, len(data)))
        row = np.searchsorted(rows_from, cuts, side="right") - 1
        order = np.argsort(froms)
        serving = order[np.searchsorted(froms[order], cuts, side="right") - 1]
        windows, offsets = (np.array([s[k] for s in servings], np.int64) for k in (2, 3))
        view = memoryview(data).cast("B")
        crc = [zlib.crc32(view[4 * a:4 * (a + n)]) for a, n in zip(cuts.tolist(), lengths.tolist())]
        again = pa.array(row)
        start = table.column("start").to_numpy()[row] + cuts - rows_from[row]
        return pa.table([*(table.column(c).take(again) for c in [*keys, "source"]), pa.array(start),
                         pa.array(lengths), pa.array(crc, pa.int64()), table.column("doc_tokens").take(again),
                         pa.array(block * (size // length) + windows[serving]),
                         pa.array(offsets[serving] + cuts - froms[serving])],
                        names=[*keys, "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def _queues(tokens: DataFrame, weights: dict | None, most: int) -> tuple[DataFrame, list[int], list[int]]:
    """(source and task with queue and first place there, tokens and weight of each queue)."""
    spark = tokens.sparkSession
    spans = stored(tokens.groupBy("source", "task").agg(F.sum("n").alias("tokens")), "packing-spans")
    sums = spans.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    top = sums.orderBy(F.desc("tokens"), F.asc_nulls_first("source")).limit(most).collect()
    names = [r["source"] for r in (top if len(top) < most else top[:most - 1])]
    own = spark.createDataFrame([(i, s is None, s or "") for i, s in enumerate(names)], "queue int, no boolean, name string")
    spans = (spans.join(F.broadcast(own), (F.col("source").isNull() == F.col("no"))
                        & (F.coalesce("source", F.lit("")) == F.col("name")), "left")
             .withColumn("queue", F.coalesce("queue", F.lit(len(names)))).drop("no", "name"))
    line = Window.partitionBy("queue").orderBy("task", F.asc_nulls_first("source"))
    placed = spans.withColumn("base", F.sum("tokens").over(line) - F.col("tokens"))
    counts = {r["queue"]: r["tokens"] for r in spans.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect()}
    totals = [counts[q] for q in sorted(counts)]
    if weights is None:
        shares = list(totals)
    else:
        given = [Fraction(str(weights[s])) for s in names]
        if len(totals) > len(names):
            rest = [Fraction(str(w)) for s, w in weights.items() if s not in set(names)]
            given.append(sum(rest, Fraction(0)))
        scale = math.lcm(*(g.denominator for g in given)) if given else 1
        shares = [int(g * scale) for g in given]
        if any(w <= 0 for w in shares):
            raise ValueError("every source needs a positive weight")
    return placed.select(F.col("source").alias("_source"), F.col("task").alias("_task"), "queue", "base"), totals, shares


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = 1, keys: tuple[str, ...] = ("doc_id",),
         weights: dict | None = None, grain: int = GRAIN, block: int = BLOCK, max_queues: int = MAX_QUEUES) -> DataFrame:
    """One row per piece: the keys, ``source, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``weights``: target proportion of each source while it lasts (by default its share of all tokens, so that
    every window is mixed like the whole table and all sources last to the end)."""
    spark = docs.sparkSession
    kind = "<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"
    held = [f"k{i}" for i in range(len(keys))]
    kinds = [f"{h} {docs.schema[k].dataType.simpleString()}" for h, k in zip(held, keys)]
    rows = docs.select(*[F.col(f"`{k}`").alias(h) for k, h in zip(keys, held)],
                       F.col("source").cast("string").alias("source"), F.col("text").alias("text"))
    tokens = stored(rows.mapInArrow(_tokens(path, end, kind, len(keys)),
                                    ", ".join([*kinds, "source string, task int, before long, n long, ids binary"])),
                    "packing-tokens")
    placed, totals, shares = _queues(tokens, weights, max_queues)
    result = ", ".join([*kinds, "source string, start long, length long, ids_crc32 long, doc_tokens long, "
                                "sequence_id long, offset long"])
    if not totals:
        out = spark.createDataFrame([], result)
    else:
        schedule, size = Schedule(totals, shares), block * length
        queued = (tokens.join(small(placed), (F.col("task") == F.col("_task")) & F.col("source").eqNullSafe(F.col("_source")))
                  .select(*held, "source", "queue", (F.col("base") + F.col("before")).alias("place"), "n", "ids"))
        cut = queued.mapInArrow(_cut(schedule, size, np.dtype(kind).itemsize, held),
                                ", ".join([*kinds, "source string, queue int, block long, place long, start long, "
                                                   "doc_tokens long, ids binary"]))
        out = cut.groupBy("block").applyInArrow(_fill_block(schedule, size, length, grain, kind, held), result)
    return out.select(*[F.col(h).alias(k) for k, h in zip(keys, held)], "start", "length", "ids_crc32", "doc_tokens",
                      "sequence_id", "offset", *(["source"] if "source" not in keys else []))
