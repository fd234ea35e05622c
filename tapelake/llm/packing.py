"""Packing into token windows by multiway differencing.

A document's ids (byte-level BPE, then an end id) are cut into pieces: whole windows as long as they last, then the
rest, halved once if it is over `piece`. Full pieces fill a window each. The others are packed block by block as the
partition streams by: every piece starts as a partial partition of its own, and again and again the two partial
partitions of greatest imbalance are merged, the largest sums of one with the smallest of the other. If a window is
over capacity, the block is partitioned anew into more windows. No shuffle: each task packs what it reads, and window
ids are unique by the task's partition number.

Rules: a null text is empty and has the end id only; rows that repeat a doc_id are documents of their own; very long
texts are cut like others; an empty table gives an empty result. Further columns of the input are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tapelake.llm.common import pick

TOKENIZER = "byte_bpe_50k.json"
BLOCK = 2048
#: Whitespace characters in a row beyond which a run is encoded on its own: tiktoken's regex fails near a million.
RUN = 100_000
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str | None):
    """Encodes text to ids of the byte-level BPE vocabulary in a tokenizers JSON file; special strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        known = json.load(f)
    special = {x["content"] for x in known.get("added_tokens", [])}
    byte = byte_alphabet()
    ranks = {bytes(byte[c] for c in token): n for token, n in known["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(tokens, text: str, run: int = RUN) -> list[int]:
    r"""Ids of a text, whitespace runs of more than `run` characters cut as the pattern would cut them.

    The pattern takes such a run whole at the text's end (\s+(?!\S)) and else all but its last character, which goes on
    with what follows; no token reaches into the run from before.
    """
    ids, at = [], 0
    for found in re.finditer(f"{SPACE}{{{run + 1},}}", text) if len(text) > run else ():
        end = found.end() - (found.end() < len(text))
        ids += tokens.encode_ordinary(text[at : found.start()])
        ids += tokens._encode_single_piece(text[found.start() : end])
        at = end
    return ids + tokens.encode_ordinary(text[at:])


def difference(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """Multiway differencing: (sum, members) for each non-empty window, ascending by sum."""
    first = lambda slot: slot[0]
    heap = [(-s, k, [(s, [k])]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        b.reverse()
        free = windows - len(a)  # empty slots of a take b's largest
        tail, b = b[:free], b[free:]
        if b:
            met = [(s + t, m + n) for (s, m), (t, n) in zip(a, b, strict=False)]
            a = a[len(b) :]
            tail += met
        for slot in tail if len(tail) < 8 else ():
            insort(a, slot, key=first)
        if len(tail) >= 8:
            a = sorted(a + tail, key=first)
        spread = a[-1][0] - (a[0][0] if len(a) == windows else 0)
        heapq.heappush(heap, (-spread, turn, a))
        turn += 1
    return heap[0][2] if heap else []


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Members of near-equal windows of at most `capacity`; their number rises until all fit."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        slots = difference(sizes, count)
        if not slots or slots[-1][0] <= capacity:
            return [m for _, m in slots]
        count += max(1, int(count * (slots[-1][0] / capacity - 1) / 8))


def cut(total: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `total` ids."""
    whole = total // capacity * capacity
    out = [(k, capacity) for k in range(0, whole, capacity)]
    rest = total - whole
    if rest > piece:
        out += [(whole, piece)]
        whole, rest = whole + piece, rest - piece
    return out + ([(whole, rest)] if rest else [])


def pack(docs: DataFrame, capacity: int = 1024, piece: int = 512, block: int = BLOCK, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` the ids."""
    kind = docs.schema["doc_id"].dataType
    ddl = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 33
        made = 0
        rows: list[tuple] = []
        pool: list[tuple] = []
        arrow_id = None

        def flush() -> None:
            nonlocal made, pool
            for members in windows_of([p[2] for p in pool], capacity):
                at = 0
                for k in members:
                    rows.append((*pool[k][:5], base + made, at, *pool[k][5:]))
                    at += pool[k][2]
                made += 1
            pool = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * (8 if with_ids else 7)
            kinds = [arrow_id, *[pa.int64()] * 6, *([pa.list_(pa.int32())] if with_ids else [])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            arrow_id = batch.schema.field("doc_id").type
            ids_of_docs, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for name, text in zip(ids_of_docs, texts, strict=True):
                got = encode(tokens, text.as_py() or "")
                got.append(end_id)
                ids = np.array(got, dtype="<u4")
                for start, length in cut(len(ids), capacity, piece):
                    own = ids[start : start + length]
                    row = (name, start, length, zlib.crc32(own.tobytes()), len(ids), *([own.tolist()] if with_ids else []))
                    if length == capacity:
                        rows.append((*row[:5], base + made, 0, *row[5:]))
                        made += 1
                    else:
                        pool.append(row)
                if len(pool) >= block:
                    flush()
                if len(rows) >= 20_000:
                    yield out()
        if pool:
            flush()
        if rows:
            yield out()

    return pick(docs, "doc_id", "text").mapInArrow(run, ddl)
