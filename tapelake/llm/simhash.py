"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint takes the majority of each bit over the XXH64 hashes of its word shingles. Fingerprints that differ
in at most `radius` bits are linked, and links are closed to components.

Candidates meet by keys: with b blocks of a fingerprint of which e must be equal whenever at most b - e bits differ, all
choices of e blocks as keys lose no link (64 bits, radius 4: five blocks and one equal, more as the corpus grows, so
that a key's rows stay few). A key with more rows than TILE is dealt to pairs of parts, which are compared in tasks of
their own, so nothing is skipped.

Groups by Jaccard similarity s meet by fingerprints, as above, and, for what these leave out, by prefixes: with all shingles in one order, rare ones first, sets of similarity s
share one of the first n - ceil(s n) + 1 of each, so no pair is lost to the keys. Sets of up to SMALL shingles are
compared by parities of 256 buckets, which differ in no more places than the sets do in shingles, so that the bound
loses nothing either; larger ones by wide fingerprints (lanes > 1) within a radius. Links are checked on the sets.
Parities and wide fingerprints are compared as bit planes too, where each pair has a limit of its own.

Within a key, fingerprints are held as bit planes: plane p has bit p of 64 fingerprints in a word. All pairs at offset d
are compared at once: planes are xored with themselves shifted by d, and the differing bits are summed by carry-save
adders into bitwise counters; words in which all pairs exceed the radius are abandoned. Only a spanning forest of the
links leaves a task.

Rules: a null text has no words; a text without words has fingerprint zero and is linked like any other; texts with
fewer words than a shingle are one shingle; rows that share a doc_id are one node; a null doc_id is in no component
unless its fingerprint has other rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.llm.common import drop, pick, pieces, written
from tapelake.llm.components import components

SEED = 42
TILE = 4096
#: Rows and bytes of shingle sets of half a tile, about.
SET_TILE, SET_BYTES = 512, 8 << 20
#: Sets of up to SMALL shingles are compared by parities; fingerprints within CLOSE of 64 bits make candidates of sets of any size.
SMALL, CLOSE = 400, 4
#: Of one document in SAMPLE, shingles that COMMON have come last in the order, at most MOST of them.
SAMPLE, COMMON, MOST = 16, 8, 50_000
#: Shingles that are hashed at once, and beyond which a text is summed on its own.
STRETCH, LONG = 100_000, 1_000_000
U = np.uint64
#: 8 bits of each byte value, least first.
BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def shingle_hashes(text: str, shingle: int, stretch: int = STRETCH) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, in stretches."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z are lowered, only ASCII gaps split
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= shingle:
        yield np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=U)
        return
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: len(words) - shingle + 1], end[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(first), stretch):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(first[k : k + stretch].tolist(), last[k : k + stretch].tolist(), strict=True)], dtype=U)


def majority(hashes: np.ndarray, owner: np.ndarray, count: int, lanes: int) -> np.ndarray:
    """(count, lanes, 64) sums of bits: how many of each owner's hashes have each bit."""
    out = np.empty((count, lanes, 64), np.int64)
    for lane in range(lanes):
        h = hashes if lane == 0 else mix(hashes + U(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        octets = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            seen = np.bincount(owner * 256 + octets[:, k], minlength=count * 256).reshape(count, 256)
            out[:, lane, 8 * k : 8 * k + 8] = seen @ BITS
    return out


def parity(hashes: np.ndarray) -> np.ndarray:
    """256 of 0/1: whether a bucket holds an odd number of the hashes. Two sets' parities differ in no more places than the sets."""
    return (np.bincount((mix(hashes) % U(256)).astype(np.int64), minlength=256) & 1).astype(np.uint8)


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of common shingles, rarer ones first, and about how many documents have each, from a sample of documents."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for text in batch.column("text"):
                parts = list(shingle_hashes(text.as_py() or "", shingle))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(parts)).view(np.int64))], names=["h"])

    sample = pick(docs, "doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(sets, "h long")
    found = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).orderBy(F.col("n").desc(), "h").limit(MOST).collect()
    return np.array([r["h"] for r in reversed(found)], np.int64).view(U), np.array([r["n"] for r in reversed(found)], np.int64) * SAMPLE


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of a set's ascending hashes the first in order that sets of the similarity share one of; common: ascending, rank: its order."""
    size = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    if not len(common) or not len(hashes):
        return hashes[:size]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    late = common[at] == hashes
    return np.concatenate([hashes[~late], hashes[late][np.argsort(rank[at[late]])]])[:size]


def fingerprints(docs: DataFrame, shingle: int = 4, lanes: int = 1, distinct: bool = False, stretch: int = STRETCH, long: int = LONG, similarity: float | None = None, common: np.ndarray | None = None) -> DataFrame:
    """doc_id and fp (8 bytes a lane, most significant first) of each row; distinct: repeated shingles count once.

    With `similarity` (and `distinct`) also the number of shingles, their prefix (8 bytes a shingle) and parity.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    common = np.empty(0, U) if common is None else common
    rank = np.argsort(common)
    common = common[rank]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sums, sizes = [], []
            held: list[np.ndarray] = []
            owner: list[int] = []
            start = 0
            set_of: list[tuple[int, bytes, bytes]] = []

            def flush(end: int) -> None:
                nonlocal start, held, owner
                if end > start:
                    h = np.concatenate(held) if held else np.empty(0, U)
                    who = np.repeat(np.array(owner, np.int64), [len(x) for x in held]) if held else np.empty(0, np.int64)
                    got = majority(h, who, end - start, lanes)
                    sizes.append(np.bincount(who, minlength=end - start))
                    sums.append(got)
                start, held, owner = end, [], []

            pending = 0
            for k, text in enumerate(batch.column("text")):
                parts = shingle_hashes(text.as_py() or "", shingle, stretch)
                if distinct and len(many := list(parts)):
                    once = np.unique(np.concatenate(many))
                    parts = (once[a : a + stretch] for a in range(0, len(once), stretch))
                if similarity is not None:
                    own_set = once if len(many) else np.empty(0, U)
                    set_of.append((len(own_set), prefix(own_set, similarity, common, rank).tobytes(), np.packbits(parity(own_set)).tobytes()))
                total, counted = 0, None
                own: list[np.ndarray] = []
                for h in parts:
                    own.append(h)
                    total += len(h)
                    if total > long:  # a very long text is summed on its own, stretch by stretch
                        whole = np.concatenate(own)
                        more = majority(whole, np.zeros(len(whole), np.int64), 1, lanes)
                        counted, own = more if counted is None else counted + more, []
                if counted is not None:
                    flush(k)
                    sums.append(counted)
                    sizes.append(np.array([total]))
                    start, pending = k + 1, 0
                    continue
                held += own
                owner += [k - start] * len(own)
                pending += total
                if pending >= 200_000:
                    flush(k + 1)
                    pending = 0
            flush(batch.num_rows)
            if batch.num_rows:
                ones = 2 * np.concatenate(sums) > np.concatenate(sizes)[:, None, None]
                value = np.packbits(ones.reshape(batch.num_rows, lanes, 64)[:, :, ::-1], axis=2)  # most significant first
                flat = value.reshape(batch.num_rows, lanes * 8)
                more = [pa.array([x[k] for x in set_of], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))] if similarity is not None else []
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([row.tobytes() for row in flat], pa.binary()), *more], names=["doc_id", "fp", "n", "prefix", "parity"][: 2 + len(more)])

    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp binary" + (", n long, prefix binary, parity binary" if similarity is not None else ""))


def block_keys(rows: int, radius: int, bits: int = 64) -> list[np.ndarray]:
    """Bit positions of each exact key: the fewest equal blocks that leave about 64 rows a key or fewer."""
    for equal in range(1, 6):
        blocks = np.array_split(np.arange(bits), radius + equal)
        keys = [np.concatenate(c) for c in combinations(blocks, equal)]
        if rows / 2 ** min(len(k) for k in keys) <= 64:
            break
    return keys


def planes_of(bits: np.ndarray) -> np.ndarray:
    """(rows, bits) of 0/1 to (bits, words): word w of a plane has the bit of rows 64w..64w+63; two spare words at the end."""
    n = len(bits)
    padded = np.zeros((-(-n // 64) * 64, bits.shape[1]), np.uint8)
    padded[:n] = bits
    packed = np.packbits(padded.T, axis=1, bitorder="little")
    return np.concatenate([np.ascontiguousarray(packed).view("<u8"), np.zeros((bits.shape[1], 2), U)], axis=1)


def exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int | np.ndarray) -> np.ndarray:
    """Bit mask: counter value (or overflow) greater than radius, which is one number or, as bit planes, one of each pair."""
    greater, equal = over.copy(), ~over
    for k in range(len(counters) - 1, -1, -1):
        c = counters[k]
        if not isinstance(radius, int):
            greater |= equal & c & ~radius[k]
            equal = equal & ~(c ^ radius[k])
        elif radius >> k & 1:
            equal = equal & c
        else:
            greater |= equal & c
            equal = equal & ~c
    return greater


def near_at(planes: np.ndarray, d: int, valid: np.ndarray, radius: int | np.ndarray) -> np.ndarray:
    """Words whose bit i says: rows i and i + d are valid and differ in at most radius bits (of each pair, as bit planes of numbers)."""
    step, shift = divmod(d, 64)
    live = np.flatnonzero(valid)
    out = np.zeros(len(valid), U)
    one = isinstance(radius, int)
    width = max(1, radius.bit_length()) if one else len(radius)
    within = lambda: ~exceeds(counters, over, radius if one else radius[:, live]) & valid[live]
    counters = [np.zeros(len(live), U) for _ in range(width)]
    over = np.zeros(len(live), U)
    last = planes.shape[1] - 1

    def differ(p: int) -> np.ndarray:
        row = planes[p]
        far = row[np.minimum(live + step, last)]
        if shift:
            far = (far >> U(shift)) | (row[np.minimum(live + step + 1, last)] << U(64 - shift))
        return row[live] ^ far

    total = len(planes)
    for p in range(0, total, 2):
        a = differ(p)
        b = differ(p + 1) if p + 1 < total else np.zeros_like(a)
        c = counters[0]
        x = a ^ b
        counters[0], carry = c ^ x, (a & b) | (c & x)  # a full adder
        for k in range(1, width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % 16 == 14 and p + 2 < total:  # abandon words without a pair within the radius
            alive = np.flatnonzero(within())
            if len(alive) < 0.6 * len(live):
                live, over, counters = live[alive], over[alive], [k[alive] for k in counters]
                if not len(live):
                    return out
    out[live] = within()
    return out


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merges the sets of a and b; labels point to each set's least row."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(far := labels[labels], labels):
            labels = far


def forest(group: np.ndarray, bits: np.ndarray, radius: int) -> np.ndarray:
    """Labels (least row of the set) of rows sorted by group, sets being rows of a group linked within radius."""
    n = len(group)
    labels = np.arange(n)
    border = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, np.int64)
    size = np.diff(np.r_[border, n])
    run = np.repeat(np.arange(len(border)), size)
    rows = np.flatnonzero(size[run] > 1)
    d = 1
    while len(rows):
        planes, own = planes_of(bits[rows]), run[rows]
        words = -(-len(rows) // 64)
        for offset in range(d, 2 * d):
            same = np.zeros(words * 64, np.uint8)
            same[: len(rows) - offset] = own[offset:] == own[:-offset] if offset < len(rows) else 0
            if not same.any():
                break
            hit = near_at(planes, offset, np.packbits(same, bitorder="little").view("<u8"), radius)
            found = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
            labels = unite(labels, rows[found], rows[found + offset])
        d *= 2
        # groups that are one set already, or have no pair further apart, are done
        split = np.zeros(len(border), bool)
        split[run[rows[labels[rows] != labels[border[run[rows]]]]]] = True
        rows = rows[split[run[rows]] & (size[run[rows]] > d)]
    return labels


def links(nodes: DataFrame, radius: int, keys: list[np.ndarray], lanes: int) -> DataFrame:
    """u, v: a forest over nodes (node, fp) that links all within radius that meet in a key."""
    width = lanes * 64

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(n, width // 8), axis=1)
            for k, places in enumerate(keys):
                packed = np.packbits(bits[:, places], axis=1)
                wide = np.zeros((n, 8), np.uint8)
                wide[:, : min(8, packed.shape[1])] = packed[:, :8]
                key = mix(wide.view("<u8").ravel() + mix(np.array([k + 1], U)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("node"), batch.column("fp")], names=["key", "node", "fp"])

    rows = nodes.mapInArrow(keyed, "key long, node long, fp binary")
    hot = rows.groupBy("key").count().where(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).cast("int").alias("parts"))
    dealt = rows.join(hot, "key", "left")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    tiles = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(mine, o) * F.col("parts") + F.greatest(mine, o)))
    dealt = dealt.select("key", F.explode(tiles).alias("tile"), "node", "fp").select(F.xxhash64("key", "tile").alias("g"), "node", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, node, fp = np.empty(0, np.int64), np.empty(0, np.int64), []

        def done(end: int) -> pa.RecordBatch:
            nonlocal g, node, fp
            bits = np.unpackbits(np.frombuffer(b"".join(fp[:end]), np.uint8).reshape(end, width // 8), axis=1)
            labels = forest(g[:end], bits, radius)
            low = np.flatnonzero(labels != np.arange(end))
            a, b = node[:end][low], node[:end][labels[low]]
            g, node, fp = g[end:], node[end:], fp[end:]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

        for batch in batches:
            g = np.concatenate([g, batch.column("g").to_numpy()])
            node = np.concatenate([node, batch.column("node").to_numpy()])
            fp += batch.column("fp").to_pylist()
            if len(g) >= 30_000:
                end = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if end:
                    yield done(end)
        if len(g):
            yield done(len(g))

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "u long, v long")


def near_sets(group: np.ndarray, n: np.ndarray, sketch: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """Labels (least row of the set) of rows sorted by group, sets being rows of a group linked as may be similar.

    n: shingles, negative where the sketch (four words) is a fingerprint, linked within the radius, and not a parity,
    linked within a share of the two sets' shingles. Both are compared as bit planes, each pair against its own limit.
    """
    labels = np.arange(len(group))
    border = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    size = np.diff(np.r_[border, len(group)])
    run = np.repeat(np.arange(len(border)), size)
    rows = np.flatnonzero(size[run] > 1)
    share, d = (1 - similarity) / (1 + similarity), 1
    pack = lambda b: np.packbits(b, bitorder="little").view("<u8")
    while len(rows):
        own, count, wide = run[rows], np.abs(n[rows]), n[rows] < 0
        lanes = (np.ascontiguousarray(sketch[rows, k]).view(np.uint8).reshape(-1, 8) for k in range(sketch.shape[1]))
        planes = np.concatenate([planes_of(np.unpackbits(x, axis=1)) for x in lanes])
        room = -(-len(rows) // 64) * 64
        for offset in range(d, min(2 * d, len(rows))):
            at = np.flatnonzero(own[offset:] == own[:-offset])
            if not len(at):
                break
            x, y = count[at], count[at + offset]
            apart = labels[rows[at]] != labels[rows[at + offset]]  # others are linked already
            fits = apart & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9)
            at, x, y = at[fits], x[fits], y[fits]
            if not len(at):
                continue
            valid, limit = np.zeros(room, np.uint8), np.zeros(room, np.int64)
            valid[at] = 1
            limit[at] = np.where(wide[at], radius, (share * (x + y) + 1e-9).astype(np.int64))
            limits = np.stack([pack((limit >> k & 1).astype(np.uint8)) for k in range(max(1, int(limit.max()).bit_length()))])
            hit = near_at(planes, offset, pack(valid), limits)
            found = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
            labels = unite(labels, rows[found], rows[found + offset])
        d *= 2
        # groups that are one set already, or have no pair further apart, are done
        split = np.zeros(len(border), bool)
        split[run[rows[labels[rows] != labels[border[run[rows]]]]]] = True
        rows = rows[split[run[rows]] & (size[run[rows]] > d)]
    return labels


def set_links(nodes: DataFrame, radius: int, similarity: float, common: np.ndarray, often: np.ndarray) -> DataFrame:
    """u, v: a forest over nodes (node, fp, n, prefix, parity) that links all that may be similar and share a shingle of their prefixes.

    Sets of up to SMALL shingles meet by parity, those that may meet a larger one by fingerprint. Shingles that are in
    many documents (`often`, about) are dealt to pairs of parts.
    """
    order = np.argsort(common)
    known, dealt = common[order], -(-often[order] // TILE)
    small = SMALL

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            made = 0

            def rows() -> pa.RecordBatch:
                g, node, n, sketch = zip(*out, strict=True)
                many = [len(x) for x in g]
                body = np.repeat(np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, 32), many, axis=0)
                ends = pa.py_buffer(np.arange(0, 32 * len(body) + 1, 32, dtype=np.int32))
                arrays = [pa.array(np.concatenate(g).view(np.int64)), pa.array(np.repeat(node, many)), pa.array(np.repeat(n, many)), pa.Array.from_buffers(pa.binary(), len(body), [None, ends, pa.py_buffer(body)])]
                return pa.RecordBatch.from_arrays(arrays, names=["g", "node", "n", "sketch"])

            for node, fp, n, first, odd in zip(*(batch.column(c).to_pylist() for c in ("node", "fp", "n", "prefix", "parity")), strict=True):
                key = np.frombuffer(first, U)
                if len(known) and len(key):
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    parts = np.where(known[at] == key, dealt[at], 1).astype(U)
                    key = np.repeat(key, parts.astype(np.int64))
                    parts = np.repeat(parts, parts.astype(np.int64))
                    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                    other = (np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))).astype(U)
                    mine = mix(np.array([node], np.int64).view(U))[0] % parts
                    key = mix(key + mix(np.minimum(mine, other) * parts + np.maximum(mine, other)))
                if not len(key):
                    continue
                if n <= small:
                    out.append((key, node, n, odd))
                    made += len(key)
                if n >= math.floor(similarity * (small + 1)):
                    out.append((mix(key + U(1)), node, -n, fp))
                    made += len(key)
                if made >= 20_000:
                    yield rows()
                    out, made = [], 0
            if out:
                yield rows()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, node, n, sketch = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 4), U)

        def done(end: int) -> pa.RecordBatch:
            nonlocal g, node, n, sketch
            labels = near_sets(g[:end], n[:end], sketch[:end], radius, similarity)
            low = np.flatnonzero(labels != np.arange(end))
            a, b = node[:end][low], node[:end][labels[low]]
            g, node, n, sketch = g[end:], node[end:], n[end:], sketch[end:]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

        for batch in batches:
            g, node, n = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((g, "g"), (node, "node"), (n, "n")))
            sketch = np.concatenate([sketch, np.frombuffer(b"".join(batch.column("sketch").to_pylist()), U).reshape(-1, 4)])
            if len(g) >= 100_000:
                end = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if end:
                    yield done(end)
        if len(g):
            yield done(len(g))

    rows = nodes.select("node", "fp", "n", "prefix", "parity").mapInArrow(keyed, "g long, node long, n long, sketch binary")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "u long, v long").where("u != v")


def shingle_sets(edges: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """node, hashes (8 bytes a shingle, ascending, once each) of the documents at the ends of edges."""
    ends = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = []
            for text in batch.column("text"):
                parts = list(shingle_hashes(text.as_py() or "", shingle))
                found.append(np.unique(np.concatenate(parts)).tobytes() if parts else b"")
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "hashes"])

    texts = pick(docs, "doc_id", "text").join(ends, F.col("doc_id") == F.col("node"), "left_semi").select(F.col("doc_id").cast("long").alias("node"), "text")
    return written(texts.mapInArrow(sets, "node long, hashes binary"), "sets")


def jaccard(x: bytes, y: bytes) -> float:
    p, q = np.frombuffer(x, U), np.frombuffer(y, U)
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both / max(1, len(p) + len(q) - both)


def alike(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (u, v) whose documents' shingle sets have at least the Jaccard similarity."""
    a = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keep = [jaccard(x, y) >= similarity for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return edges.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(near, "u long, v long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each pair of sets shares: common ones by products of incidence matrices, others pair by pair."""
    n, frequent = len(sets), 16
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    found, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros(n * n, np.int64)
    rare = (count[column] > 1) & (count[column] < frequent)
    own, col = owner[rare], column[rare]
    for d in range(1, frequent):
        at = np.flatnonzero(col[d:] == col[:-d])
        if not len(at):
            break
        both += np.bincount(own[at] * n + own[at + d], minlength=n * n)
    both = both.reshape(n, n)
    both += both.T
    dense = np.flatnonzero(count >= frequent)
    own, col = owner[count[column] >= frequent], column[count[column] >= frequent]
    for k in range(0, len(dense), 4096):
        some = dense[k : k + 4096]
        low, high = np.searchsorted(col, [some[0], some[-1] + 1])
        held = np.zeros((n, len(some)), np.float32)
        held[own[low:high], np.searchsorted(some, col[low:high])] = 1
        both += (held @ held.T).astype(np.int64)
    return both


def join_sets(node: np.ndarray, side: np.ndarray, part: np.ndarray, hashes: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Links between rows of different parts, each of which joins two sets; rows of two sides are compared across them only."""
    made, labels = [], np.unique(part, return_inverse=True)[1]
    sets = [np.frombuffer(h, U) for h in hashes]
    size, both = np.array([len(x) for x in sets]), overlaps(sets)
    near = both / np.maximum(1, size[:, None] + size[None, :] - both) >= similarity
    if len(np.unique(side)) > 1:
        near &= side[:, None] != side[None, :]
    for i in range(len(node)):
        while len(others := np.flatnonzero(near[i] & (labels != labels[i]))):
            low, high = sorted((labels[i], labels[others[0]]))
            labels[labels == high] = low
            made.append((int(node[i]), int(node[others[0]])))
    return made


def settled(tried: DataFrame, parts: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """u, v: what joins the parts (node, root: components of the checked links) of each component of `tried`.

    `tried` is a forest, so that a pair of alike documents may have no edge of its own. Components that checked edges
    leave in several parts are compared whole, in pairs of tiles of bounded rows and bytes; only joining links leave a task. Also the written tables that they are read from.
    """
    parts = parts.select(F.col("node").alias("_n"), F.col("root").alias("part"))
    whole = components(tried)
    every = whole.union(whole.select("root", "root").distinct())  # a component's root is a member too
    members = every.join(parts, F.col("node") == F.col("_n"), "left").select("node", "root", F.coalesce("part", "node").alias("part"))
    members = written(members.join(sets.groupBy("node").agg(F.max(F.octet_length("hashes")).alias("bytes")), "node"), "members", whole)
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / SET_TILE), F.ceil(F.sum("bytes") / SET_BYTES)).cast("int")
    mixed = written(members.groupBy("root").agg(F.min("part").alias("least"), F.max("part").alias("most"), tiles.alias("tiles")).where("least != most").select("root", "tiles"), "mixed")
    mine = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = members.join(mixed, "root").withColumn("side", mine)
    tile = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.least("side", o) * F.col("tiles") + F.greatest("side", o))
    dealt = dealt.select("root", F.explode(tile).alias("tile"), "node", "side", "part").select(F.xxhash64("root", "tile").alias("g"), "node", "side", "part")
    rows = dealt.join(sets, "node").select("g", "node", "side", "part", "hashes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            _, node, side, part, hashes = zip(*held, strict=True)
            made = join_sets(np.array(node), np.array(side), np.array(part), list(hashes), similarity)
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in made], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "node", "side", "part", "hashes")), strict=True):
                if held and held[0][0] != row[0]:
                    yield done()
                    held = []
                held.append(row)
        if held:
            yield done()

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "u long, v long"), [members, mixed]


def components_by_print(prints: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of each row of prints."""
    named = nodes.join(components(links), "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def nodes_of(prints: DataFrame) -> DataFrame:
    """fp and node, the least doc_id that has it (null if none)."""
    return written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")


def near_components(prints: DataFrame, radius: int) -> DataFrame:
    """doc_id, fp, component_id for the written table of prints (doc_id, fp): no link is lost."""
    nodes = nodes_of(prints)
    linkable = nodes.where("node IS NOT NULL").select("node", "fp")
    return components_by_print(prints, nodes, links(linkable, radius, block_keys(linkable.count(), radius), 1))


def near_dedup(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id of every row of docs: links of at most `radius` of 64 bits, none lost."""
    return near_components(written(fingerprints(docs, shingle), "prints"), radius)


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two shingle sets of a Jaccard similarity: the angle of their vectors over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, slack: float = 5.0) -> DataFrame:
    """doc_id, fp, component_id: groups of documents of a Jaccard similarity of shingles.

    Documents whose fingerprints of 64 bits differ in at most CLOSE meet as in `near_dedup`. For the rest, sets that share
    a shingle of their prefixes are candidates unless a bit-sliced bound rules them out: parities for sets of up to
    SMALL shingles, which lose none; for larger ones wide fingerprints, with a radius of the expected distance at
    `similarity` plus `slack` standard deviations. Links are then checked on the sets, and candidates' components that
    this leaves in parts are compared whole.
    """
    share, lanes = differing_share(similarity), 4
    bits = lanes * 64
    radius = int(share * bits + slack * math.sqrt(bits * share * (1 - share)))
    common, often = common_shingles(docs, shingle)
    prints = written(fingerprints(docs, shingle, lanes, distinct=True, similarity=similarity, common=common), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("n", "prefix", "parity"), "doc_id").alias("s")).select("fp", "node", "s.*"), "nodes")
    linkable = nodes.where("node IS NOT NULL")
    close = links(linkable.select("node", F.substring("fp", 1, 8).alias("fp")), CLOSE, block_keys(linkable.count(), CLOSE), 1)
    tried = written(close.union(set_links(linkable, radius, similarity, common, often)).distinct(), "links")
    sets = shingle_sets(tried, docs, shingle)
    parts = components(alike(tried, sets, similarity))
    stars = parts.select(F.col("node").alias("u"), F.col("root").alias("v"))  # closed already, so that few steps are left
    joining, read = settled(tried, parts, sets, similarity)
    out = components_by_print(prints.select("doc_id", "fp"), nodes.select("fp", "node"), stars.union(joining))
    drop(tried, sets, parts, *read)
    return out


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that stay, all columns: of each group the smallest doc_id, and rows without a doc_id."""
    gone = similar_groups(docs, **how).where("doc_id != component_id").select(F.col("doc_id").alias("__tl_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__tl_gone"), "left_anti")
