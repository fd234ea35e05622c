"""Removal of repeated byte strings with two-stage suffix sorting.

Every `window`-byte string belongs to the least hash among its byte grams, so equal strings belong to equal hashes,
wherever they stand. Consecutive strings of a document with one least hash form a context; contexts whose hash has no
partner are done with. The distinct contexts of the others are dealt to blocks by hash, and each block is sorted by
suffix in two stages: suffixes smaller than their successors are sorted directly (by their first `window` bytes), all
others are induced by scanning the buckets of first bytes upwards. Adjacent common prefixes of `window` bytes or more
mark strings that occur again. Suffixes that start no string of a context are sorted only as far as they induce others.

Contexts that are equal throughout are sorted once and carry their count, so copies of documents cost a block one
context. A hash with more context bytes than a block holds is dealt to pairs of parts, each pair a block of its own.

Rules: a null text is empty; a text shorter than a window keeps all; rows that repeat a doc_id are documents of their
own, so that the copies count as places of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.llm.common import pick, total, written
from tapelake.llm.rolling import BASES, TABLES, U, prefix, stretches

WINDOW = 400
GRAM = 32
BLOCK_BYTES = 1 << 20
PIECE = 1 << 20


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by running minima of blocks from both sides."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(U).max, U)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def contexts(raw: bytes, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each context: hash, digest (two hashes), first and last start of its strings, and if several places hold the hash."""
    whole = np.frombuffer(raw, np.uint8)
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(whole) - window + 1, PIECE):
        part = whole[at : at + PIECE + window - 1]
        sums = [prefix(TABLES[k][part], BASES[k]) for k in range(2)]
        h = stretches(sums[0], np.arange(len(part) - gram + 1), gram, BASES[0])
        place = np.arange(len(h), dtype=U)
        least = sliding_min((h & ~U(0xFFFFFFFF)) | place, window - gram + 1)
        where = (least & U(0xFFFFFFFF)).astype(np.int64)
        value = h[where]  # whole: grams may agree in the upper half alone
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        last = np.r_[first[1:], len(value)] - 1
        length = last - first + window
        digest = [stretches(sums[k], first, length, BASES[k]) for k in range(2)]
        out.append((value[first], *digest, first + at, last + at, where[first] != where[last]))
    if not out:
        return tuple(np.empty(0, k) for k in (U, U, U, np.int64, np.int64, bool))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def reach(raw: bytes, start: int) -> int:
    """The first place from `start` on whose suffix is smaller than its successor (the text's end at the latest)."""
    n = len(raw)
    while start < n:
        k = start + 1
        while k < n and raw[k] == raw[start]:
            k += 1
        if k < n and raw[k] > raw[start]:
            return start
        start = k
    return n


def suffix_order(text: np.ndarray, base: np.ndarray, active: np.ndarray, window: int) -> np.ndarray:
    """Active suffixes of all contexts in order of (at least) their first `window` bytes.

    Context k lies at base[k] and has active[k] suffixes from its start; the last of them is smaller than its successor.
    """
    final = base + active - 1
    place = np.repeat(base - (np.cumsum(active) - active), active) + np.arange(int(active.sum()))
    step = text[place + 1].astype(np.int16) - text[place]
    step[np.cumsum(active) - 1] = 1
    known = np.flatnonzero(step)
    small = step[known[np.searchsorted(known, np.arange(len(step)))]] > 0  # smaller than its successor
    larger = np.zeros(len(text), bool)
    larger[place[~small]] = True
    starts = np.zeros(len(text) + 1, bool)
    starts[base] = True
    raw = text.tobytes()
    direct = sorted(place[small].tolist(), key=lambda p: raw[p : p + window])  # stage one
    direct = np.array(direct, np.int64)
    edge = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for c in range(256):  # stage two: bucket by bucket, what precedes a placed suffix and is larger goes to its own bucket
        now = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        sent = []
        while len(now):
            order.append(now)
            before = now[~starts[now]] - 1
            before = before[larger[before]]
            same = text[before] == c
            sent.append(before[~same])
            now = before[same]
        own = direct[edge[c] : edge[c + 1]]
        if len(own):
            order.append(own)
            before = own[~starts[own]] - 1
            sent.append(before[larger[before]])
        out = np.concatenate(sent) if sent else np.empty(0, np.int64)
        if len(out):
            to = text[out]
            turn = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[turn], np.arange(257))
            for d in np.flatnonzero(np.diff(cut)):
                waiting[d].append(out[turn[cut[d] : cut[d + 1]]])
    assert len(final) == 0 or sum(map(len, order)) == len(place)
    return np.concatenate(order) if order else np.empty(0, np.int64)


def same_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Whether the suffixes at a and b have a common prefix of `window` bytes."""
    wide = np.ndarray((len(text) - 7,), "<u8", text.tobytes(), strides=(1,))
    alive = np.arange(len(a))
    for k in [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]:
        alive = alive[wide[a[alive] + k] == wide[b[alive] + k]]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def repeats(texts: list[bytes], own: np.ndarray, active: np.ndarray, count: np.ndarray, window: int) -> list[np.ndarray]:
    """For each context a mask over its strings: which occur more than once. count: places that hold the very context."""
    size = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(size) - size
    text = np.frombuffer(b"".join(texts), np.uint8)
    order = suffix_order(text, base, active, window)
    ctx = np.searchsorted(base, order, "right") - 1
    ours = order - base[ctx] < own[ctx]
    order, ctx = order[ours], ctx[ours]
    marked = np.zeros(len(text), bool)
    if len(order):
        joint = same_prefix(text, order[:-1], order[1:], window)
        group = np.r_[0, np.cumsum(~joint)]
        often = (np.bincount(group) > 1) | (np.bincount(group, weights=count[ctx] > 1) > 0)
        marked[order] = often[group]
    return [marked[b : b + n] for b, n in zip(base.tolist(), own.tolist(), strict=True)]


def runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    """First places and ends of the stretches of true."""
    step = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return step[::2].tolist(), step[1::2].tolist()


def repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and spans (start, end) of each row."""
    text = F.coalesce("text", F.lit(""))
    held = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["m", "c1", "c2", "doc_id", "th", "a", "b", "several"]
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            count = np.zeros(batch.num_rows, np.int64)
            for k, t in enumerate(batch.column("text")):
                found = contexts(t.as_py().encode("utf-8", "surrogatepass"), window, gram)
                count[k] = len(found[0])
                for c, x in zip(cols, found, strict=True):
                    c.append(x)
            if not count.sum():
                continue
            m, c1, c2, a, b, several = (np.concatenate(c) for c in cols)
            row = pa.array(np.repeat(np.arange(batch.num_rows), count))
            kinds = [pa.array(x.view(np.int64)) for x in (m, c1, c2)]
            yield pa.RecordBatch.from_arrays([*kinds, batch.column("doc_id").take(row), batch.column("th").take(row), pa.array(a), pa.array(b), pa.array(several)], names=names)

    places = written(held.where(F.octet_length("text") >= window).mapInArrow(send, "m long, c1 long, c2 long, doc_id long, th long, a long, b long, several boolean"), "contexts")
    places = places.withColumn("strings", F.col("b") - F.col("a") + 1)
    key = ["m", "c1", "c2", "strings"]
    distinct = places.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "a")).alias("at"), F.max("several").alias("several"))
    partners = distinct.groupBy("m").agg(F.sum("n").alias("_n"), F.max("several").alias("_s"), F.sum(F.col("strings") + window).alias("_bytes")).where("_n > 1 OR _s")
    parts = F.ceil(F.col("_bytes") / block_bytes).cast("int")
    asked = written(distinct.join(partners.select(F.col("m").alias("_m"), parts.alias("parts")), F.col("m") == F.col("_m")).select(*key, "n", "at", "parts"), "asked")
    blocks = max(1, -(-total(asked.where("parts = 1"), F.col("strings") + window) // block_bytes))

    wanted = asked.groupBy(F.col("at.doc_id").alias("_id"), F.col("at.th").alias("_th")).agg(F.collect_list(F.struct(*key, "n", "parts", F.col("at.a").alias("a"))).alias("want"))
    cut_from = held.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("text", "want")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for t, want in zip(batch.column("text").to_pylist(), batch.column("want").to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                for w in want:
                    end = reach(raw, w["a"] + w["strings"])  # induces the last strings
                    ctx = raw[w["a"] : end + window]
                    rows.append((w["m"], w["c1"], w["c2"], w["strings"], w["n"], w["parts"], end - w["a"] + 1, ctx + bytes(end + window - w["a"] - len(ctx))))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*key, "n", "parts", "active", "ctx"])

    mine = F.pmod(F.xxhash64("c1"), F.col("parts")).cast("int")
    tile = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.xxhash64(F.col("m"), F.least(mine, o), F.greatest(mine, o)))
    block = F.when(F.col("parts") > 1, tile).otherwise(F.array(F.pmod(F.xxhash64("m"), F.lit(blocks)).cast("long")))
    sent = cut_from.mapInArrow(cut, "m long, c1 long, c2 long, strings long, n long, parts int, active long, ctx binary").withColumn("block", F.explode(block)).drop("parts")

    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        got = repeats(table.column("ctx").to_pylist(), *(table.column(c).to_numpy() for c in ("strings", "active", "n")), window)
        some = [k for k, mask in enumerate(got) if mask.any()]
        lo, hi = zip(*(runs(got[k]) for k in some), strict=True) if some else ((), ())
        ints = pa.list_(pa.int64())
        return table.select(key).take(pa.array(some, pa.int64())).append_column("lo", pa.array(list(lo), ints)).append_column("hi", pa.array(list(hi), ints))

    found = sent.groupBy("block").applyInArrow(find, "m long, c1 long, c2 long, strings long, lo array<long>, hi array<long>")
    spans = places.join(found, key).select("doc_id", "th", F.transform(F.arrays_zip("lo", "hi"), lambda s: F.struct((s["lo"] + F.col("a")).alias("s"), (s["hi"] + F.col("a") + (window - 1)).alias("e"))).alias("x"))
    of_doc = spans.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.flatten(F.collect_set("x")).alias("x"))  # a set: rows that repeat a document give the same spans
    last = held.join(of_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select("doc_id", "text", "x")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, count, kept, spans = [], [], [], [], []
            for t, x in zip(batch.column("text").to_pylist(), batch.column("x"), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                if x.is_valid:
                    s, e = (np.array(x.values.field(k).to_pylist(), np.int64) for k in (0, 1))
                    order = np.argsort(s, kind="stable")
                    for a, b in zip(s[order].tolist(), e[order].tolist(), strict=True):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                edge = [0, *(p for m in merged for p in m), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)))
                sizes.append(len(raw))
                gone.append(sum(b - a for a, b in merged))
                count.append(len(merged))
                spans.append(merged)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, gone, count)), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
            )

    return last.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<array<long>>")

