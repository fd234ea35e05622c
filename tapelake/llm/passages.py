"""Removal of repeated word passages through difference-cover anchors.

Windows of `window` words are compared. With a cover D of the residues modulo `period` whose differences are all
residues, any two places have a common shift below the period that puts both on D; so only the shorter windows of
window - period + 1 words that start on D (counted from the document's start) are hashed, and two equal windows share
an anchor. Anchors that occur once are done with; from the others the match is extended to all windows that hold them:
these are hashed, and the earliest place of each is found.

Documents are dealt to batches by doc_id and text, so that no id makes a batch hot. A batch sends each anchor hash once
(twice if it has it more than once), dealt to buckets by hash; a bucket answers with those that occur again. Window
hashes go the same way with the first document and the place that the batch has them at; a bucket answers the batches
whose document is not the first with the places. Windows that a batch holds twice it settles itself. So a passage that
every document holds costs a batch one entry, and no task holds more than a batch of texts or a bucket of hashes; the
last round reads places only and hashes nothing. Window hashes have 96 bits.

Rules: a null text has no words; documents go by doc_id, null last; rows that repeat a doc_id are documents of their
own, in the order of their batches and there of their texts; a text with fewer words than a window keeps all; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.llm.common import pick, total
from tapelake.llm.rolling import BASES, U, prefix, stretches, word_hashes

WINDOW = 20
#: A perfect difference set: every residue modulo 13 is a difference of two of these.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes of text of a batch, and of all texts for each bucket (their windows' hashes may be four times that).
BATCH_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
LAST = np.iinfo(np.int64).max


def in_order(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """The ids and texts of a batch's documents in their order."""
    ids, texts = table.column("doc_id").to_pylist(), [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda k: (LAST if ids[k] is None else ids[k], texts[k]))
    return [ids[k] for k in order], [texts[k] for k in order]


class Batch:
    """A batch's documents in order, their words and hashes."""

    def __init__(self, table: pa.Table, both: bool) -> None:
        ids, self.texts = in_order(table)
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        size = np.array([len(t) + 1 for t in self.texts], np.int64)
        begin = np.cumsum(size) - size
        at, self.first, self.second = word_hashes(b"\n".join(self.texts), both)
        self.doc = np.searchsorted(begin, at, "right") - 1  # document of each word
        self.words = np.bincount(self.doc, minlength=len(self.ids))
        self.edge = np.cumsum(self.words) - self.words
        self.place = np.arange(len(at)) - self.edge[self.doc]
        self.left = self.words[self.doc] - self.place  # words from here to the document's end

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and hashes of the anchors."""
        size = window - PERIOD + 1
        on = np.isin(self.place % PERIOD, COVER) & (self.left >= size) & (self.words[self.doc] >= window)
        at = np.flatnonzero(on)
        return at, stretches(prefix(self.first, BASES[0]), at, size, BASES[0])

    def windows(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        two = stretches(prefix(self.second, BASES[1]), at, window, BASES[1])
        return stretches(prefix(self.first, BASES[0]), at, window, BASES[0]), (two >> U(32)).astype(np.uint32)


def dealt(batch: int, buckets: int, bucket_of: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """One row a bucket: bucket, batch and each column's values as bytes."""
    order = np.argsort(bucket_of, kind="stable")
    edge = np.searchsorted(bucket_of[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(edge))
    out = {"bucket": pa.array(full, pa.int64()), "batch": pa.array(np.full(len(full), batch), pa.int64())}
    for name, x in columns.items():
        x = x[order]
        out[name] = pa.array([x[edge[b] : edge[b + 1]].tobytes() for b in full], pa.binary())
    return pa.table(out)


def loaded(table: pa.Table, name: str, kind=U) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]


def joined(parts: list[np.ndarray], kind=U) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def owners(parts: list[np.ndarray]) -> np.ndarray:
    return np.repeat(np.arange(len(parts)), [len(x) for x in parts])


def told(table: pa.Table, who: np.ndarray, rows: int, **column: np.ndarray) -> pa.Table:
    """One row for each row of table that `who` names: its batch, and its values as bytes."""
    (name, x), order = *column.items(), np.argsort(who, kind="stable")
    edge = np.searchsorted(who[order], np.arange(rows + 1))
    found = np.flatnonzero(np.diff(edge))
    x = x[order]
    return pa.table({"batch": table.column("batch").combine_chunks().cast(pa.int64()).take(pa.array(found, pa.int64())), name: pa.array([x[edge[k] : edge[k + 1]].tobytes() for k in found], pa.binary())})


def repeated_passages(docs: DataFrame, window: int = WINDOW, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and removed (runs of word numbers: start, length) of each row."""
    slim = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = total(slim, F.octet_length("text") + 1)
    batches = max(1, -(-size // batch_bytes))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    held = slim.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)))

    def send_anchors(table: pa.Table) -> pa.Table:
        _, h = Batch(table, False).anchors(window)
        value, count = np.unique(h, return_counts=True)
        value = np.concatenate([value, value[count > 1]])
        return dealt(table.column("batch")[0].as_py(), buckets, ((value >> U(20)) % U(buckets)).astype(np.int64), anchors=value)

    def answer_anchors(table: pa.Table) -> pa.Table:
        parts = loaded(table, "anchors")
        value, who = joined(parts), owners(parts)
        order = np.argsort(value, kind="stable")
        value, who = value[order], who[order]
        same = value[1:] == value[:-1]
        once = ~np.r_[False, same & (who[1:] == who[:-1])]  # a batch that sent it twice is told once
        again = (np.r_[False, same] | np.r_[same, False]) & once
        return told(table, who[again], len(parts), again=value[again])

    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = np.empty(0, np.int64)
        if not left.num_rows or not right.num_rows:
            return dealt(0, 0, empty, one=empty, two=empty, least=empty, place=empty)
        own = Batch(left, True)
        at, h = own.anchors(window)
        hit = at[np.isin(h, joined(loaded(right, "again")))]
        edge = np.zeros(len(own.doc) + 1, np.int64)  # windows that hold an anchor that occurs again
        np.add.at(edge, np.maximum(hit - PERIOD + 1, own.edge[own.doc[hit]]), 1)
        np.add.at(edge, hit + 1, -1)
        near = np.flatnonzero((np.cumsum(edge)[:-1] > 0) & (own.left >= window))
        one, two = own.windows(near, window)
        order = np.lexsort((two, one))  # stable: the earliest place leads
        one, two, near = one[order], two[order], near[order].astype(np.int32)
        lead = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(one) else np.empty(0, bool)
        number = left.column("batch")[0].as_py()
        late = near[~lead]  # this batch's own bucket, after all others
        sent = dealt(number, buckets, ((one[lead] >> U(20)) % U(buckets)).astype(np.int64), one=one[lead], two=two[lead], least=own.ids[own.doc[near[lead]]], place=near[lead])
        mine = {"bucket": [buckets + number], "batch": [number], "one": [b""], "two": [b""], "least": [b""], "place": [np.sort(late).tobytes()]}
        return pa.concat_tables([sent, pa.table(mine, schema=sent.schema)]) if len(late) else sent

    def answer_windows(table: pa.Table) -> pa.Table:
        batch = table.column("batch").combine_chunks().cast(pa.int64())
        if table.column("bucket")[0].as_py() >= buckets:
            return pa.table({"batch": batch, "place": table.column("place").combine_chunks().cast(pa.binary())})
        parts = loaded(table, "one")
        one, who = joined(parts), owners(parts)
        order = np.argsort(one, kind="stable")
        same = one[order][1:] == one[order][:-1]
        some = order[np.r_[False, same] | np.r_[same, False]]  # the others stand alone
        one, who = one[some], who[some]
        two, least, place = (joined(loaded(table, c, kind), kind)[some] for c, kind in (("two", np.uint32), ("least", np.int64), ("place", np.int32)))
        order = np.lexsort((batch.to_numpy()[who], least, two, one))
        one, two = one[order], two[order]
        later = order[np.r_[False, (one[1:] == one[:-1]) & (two[1:] == two[:-1])]] if len(one) else order
        return told(table, who[later], len(parts), place=place[later])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = in_order(left)
        late = np.sort(joined(loaded(right, "place", np.int32), np.int32)).astype(np.int64)
        count, dropped, kept, runs, first = [], [], [], [], 0
        for raw in texts:
            words = raw.split()
            low, high = np.searchsorted(late, [first, first + len(words)])
            spans: list[list[int]] = []
            n = len(words)
            if low < high:
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, late[low:high] - first, 1)
                np.add.at(step, late[low:high] - first + window, -1)
                dead = np.cumsum(step)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.r_[False, dead, False].astype(np.int8)))
                spans = [[int(a), int(b - a)] for a, b in zip(edge[::2], edge[1::2], strict=True)]
                words = [words[i] for i in np.flatnonzero(~dead)]
            first += n
            count.append(n)
            dropped.append(n - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            runs.append(spans)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(count, pa.int64()), "n_removed": pa.array(dropped, pa.int64()), "kept": pa.array(kept, pa.string()), "removed": pa.array(runs, pa.list_(pa.list_(pa.int64())))})

    again = held.groupBy("batch").applyInArrow(send_anchors, "bucket long, batch long, anchors binary").groupBy("bucket").applyInArrow(answer_anchors, "batch long, again binary")
    sent = held.groupBy("batch").cogroup(again.groupBy("batch")).applyInArrow(send_windows, "bucket long, batch long, one binary, two binary, least binary, place binary")
    later = sent.groupBy("bucket").applyInArrow(answer_windows, "batch long, place binary")
    return held.groupBy("batch").cogroup(later.groupBy("batch")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept string, removed array<array<long>>")
