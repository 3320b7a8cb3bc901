"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 bytes cuts every text into chunks that depend only on
nearby content, so passages that documents share give the same chunks.  Each
distinct chunk is encoded once per task and reused.  Tokens at a cut can
differ from those of the whole text, so a chunk contributes only what lies
between its first and last *agreeing* position; what lies between the last
such position of one chunk and the first of the next is encoded again as one
piece, over as many chunks as it takes.  A position agrees if it is a single
space between two printable ASCII characters: the pre-tokenising pattern starts
a new token there whatever surrounds it and looks no further back, so the
encodings of both sides put together are the encoding of the whole.

Reuse is kept inside a task: sharing chunks across tasks would shuffle the
whole text and all its tokens to save the copies' share of the encoding.

Defined results: a null text counts as empty and has no tokens; any other
column is ignored (``encode``) or kept (``encoded``); rows are independent, so
repeated rows and null ids need no rule; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import text_batches, utf8

CHUNK = 512              # mean bytes of a chunk
CACHE_BYTES = 48 << 20   # chunks kept for reuse in a task; then the store starts anew
PIECE = 8 << 20          # bytes of text handled at a time


@lru_cache(maxsize=2)
def _vocabulary(path: str):
    """(encoding of ordinary text, {special text: id}, decimal form of each id) of a byte-level BPE file."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onward
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding, special, [str(i) for i in range(max(ranks.values()) + 1)]


def _rolling(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of the 16 bytes that end at each place, by doubling."""
    table = np.random.default_rng(16).integers(0, 1 << 32, 256, dtype=np.uint32)
    h, factor, width = table[data], 0x9E3779B1, 1
    while width < 16:
        h[width:] = h[width:] + np.uint32(factor) * h[:-width]
        factor, width = factor * factor & 0xFFFFFFFF, width * 2
    return h


class ChunkCoder:
    """Encodes texts, reusing chunks it has met before."""

    def __init__(self, path: str, chunk: int = CHUNK, cache_bytes: int = CACHE_BYTES):
        self.encoding, self.special, self.decimal = _vocabulary(path)
        self.limit, self.cache_bytes = np.uint32((1 << 32) // chunk), cache_bytes
        self.store, self.held, self.reused = {}, 0, 0

    def marks(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cut positions and agreeing positions of a stretch of bytes."""
        cuts = np.flatnonzero(_rolling(data) < self.limit) + 1
        printable = (data > 0x20) & (data < 0x7F)
        agree = np.flatnonzero((data[1:-1] == 0x20) & printable[:-2] & printable[2:]) + 1
        return cuts, agree

    def parts(self, data: bytes, cuts, agree) -> list[tuple]:
        """(ids, decimal ids, decoded bytes) of the stretches whose encodings together are the text's."""
        out, begin, chunk_from = [], 0, 0
        places = np.searchsorted(agree, [*cuts, len(data)]).tolist()
        before = 0
        for cut, upto in zip([*cuts, len(data)], places):
            # agreeing positions inside the chunk, not at its edges: their neighbours lie in it too
            first, last = before, upto
            while first < last and agree[first] <= chunk_from:
                first += 1
            while last > first and agree[last - 1] + 1 >= cut:
                last -= 1
            if last - first >= 2:
                lo, hi = int(agree[first]), int(agree[last - 1])
                if lo > begin:
                    out.append(self.encode(data[begin:lo]))
                chunk = data[lo:hi]
                found = self.store.get(chunk)
                if found is None:
                    found = self.encode(chunk)
                    self.held += 24 * len(chunk)
                    if self.held > self.cache_bytes:
                        self.store.clear()
                        self.held = 24 * len(chunk)
                    self.store[chunk] = found
                else:
                    self.reused += 1
                out.append(found)
                begin = hi
            chunk_from, before = cut, upto
        if begin < len(data):
            out.append(self.encode(data[begin:]))
        return out

    def encode(self, piece: bytes) -> tuple:
        ids = self.encoding.encode_ordinary(piece.decode())
        decimal = self.decimal
        return ids, ",".join([decimal[i] for i in ids]), self.encoding.decode_bytes(ids)

    def text(self, data: bytes, cuts=None, agree=None) -> list[tuple]:
        """The parts of a whole text; strings of special tokens in it are these tokens."""
        if any(t.encode() in data for t in self.special):
            out, rest = [], data
            while True:
                at, token = min(((i, t) for t in self.special if (i := rest.find(t.encode())) >= 0), default=(-1, ""))
                plain = rest if at < 0 else rest[:at]
                if plain:
                    out += self.parts(plain, *self.marks(np.frombuffer(plain, np.uint8)))
                if at < 0:
                    return out
                out.append(([self.special[token]], str(self.special[token]), token.encode()))
                rest = rest[at + len(token.encode()):]
        if cuts is None:
            cuts, agree = self.marks(np.frombuffer(data, np.uint8))
        return self.parts(data, cuts, agree) if data else []


_OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string",
            "decoded_sha256": "string"}


def _encode_batches(path: str, n_keys: int, outputs: tuple[str, ...], chunk: int):
    def run(batches):
        coder = ChunkCoder(path, chunk)
        for batch in text_batches(batches, "text", PIECE):
            texts = [b or b"" for b in utf8(batch.column("text"))]
            ends = np.cumsum([0, *map(len, texts)])
            data = b"".join(texts)
            cuts, agree = coder.marks(np.frombuffer(data, np.uint8)) if len(data) > 2 else (np.array([], int),) * 2
            cols = {o: [] for o in outputs}
            for k in range(batch.num_rows):
                a, b = int(ends[k]), int(ends[k + 1])
                # the hash window of the first places reaches into the text before: no cut there
                own = cuts[np.searchsorted(cuts, a + 16):np.searchsorted(cuts, b)] - a
                near = agree[np.searchsorted(agree, a + 1):np.searchsorted(agree, b - 1)] - a
                parts = coder.text(texts[k], own.tolist(), near)
                if "n_tokens" in cols:
                    cols["n_tokens"].append(sum(len(p[0]) for p in parts))
                if "ids" in cols:
                    cols["ids"].append([i for p in parts for i in p[0]])
                if "ids_sha256" in cols:
                    cols["ids_sha256"].append(hashlib.sha256(",".join(p[1] for p in parts).encode()).hexdigest())
                decoded = b"".join(p[2] for p in parts).decode("utf-8", "replace")
                if "decoded" in cols:
                    cols["decoded"].append(decoded)
                if "decoded_sha256" in cols:
                    cols["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n_keys)),
                 *(pa.array(cols[o], kinds.get(o, pa.string())) for o in outputs)],
                names=[*batch.schema.names[:n_keys], *outputs])
    return run


def encode(docs: DataFrame, path: str, outputs=("n_tokens", "ids", "decoded"), keys=("doc_id",),
           chunk: int = CHUNK) -> DataFrame:
    """``keys`` and the chosen outputs of every row: ``n_tokens``, ``ids``, ``decoded`` (the ids decoded
    again), ``ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256``."""
    keyed = docs.select(*[F.col(k) for k in keys], F.col("text").alias("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields[:-1]),
                        *(f"{o} {_OUTPUTS[o]}" for o in outputs)])
    return keyed.mapInArrow(_encode_batches(path, len(keys), tuple(outputs), chunk), schema)
