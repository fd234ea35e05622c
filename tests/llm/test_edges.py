"""Awkward tables for the training-data operators: ties, repeats, null ids, very long texts, huge numbers, empty tables, state that lasts."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapelake.llm import chat, components, exact_dedup, packing, passages, quality, queries, shards, simhash, suffixes, topk
from tests.llm.test_llm import brute_bytes, brute_groups, brute_passages, docs


def tables(spark, folder, **frames):
    """Parquet tables as the queries read them; those that aren't given are empty."""
    kinds = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int",
        "conversations": "conv_id long, turn long, role string, text string", "embeddings": "vec_id long, embedding array<float>, label int",
    }
    for name, kind in kinds.items():
        spark.createDataFrame(frames.get(name, []), kind).repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def sql(folder, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con.sql(queries.ORACLES[name]).df()


def rows_of(df):
    return sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


def test_queries_on_empty_tables(spark, tmp_path):
    folder = tables(spark, tmp_path / "none")
    for name, query in queries.QUERIES.items():
        assert query(spark, folder).count() == (name == "op7_chat"), name  # the added conversation


def test_suffix_owners_follow_the_string_when_hashes_tie(monkeypatch):
    whole = suffixes.stretches
    monkeypatch.setattr(suffixes, "stretches", lambda *a: whole(*a) & np.uint64(0x00000003_FFFFFFFF))  # four values of the upper half
    rng = random.Random(5)
    shared = bytes(rng.choice(b"abc") for _ in range(120))
    owner = {}
    for _ in range(20):
        raw = bytes(rng.choice(b"abc") for _ in range(rng.randint(20, 90))) + shared[rng.randint(0, 30) : rng.randint(80, 120)] + bytes(rng.choice(b"abc") for _ in range(40))
        m, _, _, a, b, _ = suffixes.contexts(raw, 40, 8)
        assert a[0] == 0 and b[-1] == len(raw) - 40 and (a[1:] == b[:-1] + 1).all()
        for value, low, high in zip(m.tolist(), a.tolist(), b.tolist(), strict=True):
            for k in range(low, high + 1):
                assert owner.setdefault(raw[k : k + 40], value) == value


def test_planted_strings_go_and_nothing_else(spark):
    """Repeats of 300 to 900 bytes: every string of 400 bytes or more goes whole, shorter ones stay."""
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(n))
    planted = [noise(n) for n in (300, 350, 390, 400, 401, 500, 650, 900)]
    rows, want = [], {}
    for k in range(60):
        own, size = planted[k % 8], rng.randint(0, 600)
        rows.append((k, f"{noise(size)}<{k}>{own}<{k}>{noise(500)}", "a"))
        want[k] = len(own) if len(own) >= 400 else 0
    rows += [(k, noise(900), "a") for k in range(60, 90)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.repeated_bytes(docs(spark, rows)).collect()}
    assert all(0 <= got[k][0] - want[k] <= 6 and got[k][1] == (want[k] > 0) for k in want)  # bytes beside a copy may agree too
    assert all(got[k] == (0, 0) for k in range(60, 90))
    assert {k: v[0] for k, v in got.items()} == {k: v[1] for k, v in brute_bytes(rows, 400).items()}


def test_repeated_rows_are_documents_of_their_own(spark):
    rows = [(5, "".join(random.Random(1).choice("abcd ") for _ in range(900)), "a")] * 30 + [(None, "x" * 3, None)] * 3
    got = suffixes.repeated_bytes(docs(spark, rows)).collect()
    assert [(r.n_removed, r.n_spans) for r in got if r.doc_id == 5] == [(900, 1)] * 30 and len(got) == 33


def test_long_texts_are_read_whole(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
    passage = " ".join(word() for _ in range(90))
    long = [word() for _ in range(350_000)]  # 2.4 MB
    for at in (10, 160_000, 349_000):
        long[at] = passage
    rows = [(1, " ".join(long), "a"), (2, f"{word()} {passage} {word()}", "a"), (3, word(), "a")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in passages.repeated_passages(docs(spark, rows)).collect()}
    assert got == brute_passages(rows, 20)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.repeated_bytes(docs(spark, rows)).collect()}
    whole = [t.encode() for _, t, _ in rows]
    at, places = passage.encode(), []
    for k, raw in enumerate(whole):
        start = raw.find(at)
        while start >= 0:
            places.append((k, start))
            start = raw.find(at, start + 1)
    assert len(places) == 4 and found[1][2] == 3 and found[2][2] == 1 and found[3][1] == 0
    assert all(3 * len(at) <= found[1][1] <= 3 * len(at) + 12 for _ in [0]) and at not in found[1][3] and at not in found[2][3]


def test_null_ids_are_dealt_by_text(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(30)]
    rows = [(None, " ".join([*[word() for _ in range(40)], *passage, word()]), "a") for _ in range(50)] + [(None, " ".join(passage), "a")] * 9
    got = passages.repeated_passages(docs(spark, rows), 20, 1000).collect()
    assert sum(" ".join(passage) in r.kept for r in got) == 1 and sum(r.n_removed for r in got) == 58 * 30


def test_topk_takes_huge_components(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=6) * 10.0 ** rng.integers(-2, 3)).tolist()) for k in range(120)]
    rows += [(50 * k, [s * 1e20, 1.0, -1e20 * s, 3.0, 0.5, 0.0]) for k, s in ((3, 1), (4, -1), (5, 1))] + [(301, [1e20] * 6), (302, [-1e20] * 6), (303, [1e300] * 6), (304, [1e307] * 6), (350, [-1e300] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [(i, v) for i, e in rows for v in [[int(np.floor(256 * x)) if np.isfinite(256 * x) else None for x in e]] if None not in v]
    assert len(whole) == len(rows) - 1
    score = lambda u, v: min(topk.MOST, max(topk.LEAST, sum(a * b for a, b in zip(u, v, strict=True))))
    want = {(q, k + 1, c, s) for q, u in whole if q % 50 == 0 for k, (s, c) in enumerate(sorted(((-score(u, v), c) for c, v in whole if c != q))[:5]) for s in [-s]}
    for block in (16, 2048):
        assert {tuple(r) for r in topk.top_k(table, 5, 50, 256, query_block=2, block=block).collect()} == want


def test_bounds_are_no_less_than_scores():
    rng = np.random.default_rng(8)
    q, x = np.floor(rng.normal(size=(20, 32)) * 256), np.floor(rng.normal(size=(300, 32)) * 256)
    known = np.full(20, -np.inf)
    best = {}
    for at in range(0, 300, 60):
        for i, c, s in topk.best_of(np.arange(20) + 1000, q, np.arange(at, at + 60), x[at : at + 60], 5, known):
            best.setdefault(i - 1000, []).append((-s, c))
    exact = q @ x.T
    assert all(sorted(best[i])[:5] == sorted((-int(s), c) for c, s in enumerate(exact[i]))[:5] for i in range(20))
    assert all(known[i] <= np.sort(exact[i])[-5] for i in range(20))


@pytest.mark.parametrize(("held", "parts"), [(64 << 20, 4), (600, 7)])
def test_topk_tiles(spark, monkeypatch, held, parts):
    monkeypatch.setattr(topk, "HELD", held)
    monkeypatch.setattr(topk, "SOME", 2)
    monkeypatch.setattr(topk, "WAITING", 500)
    rng = np.random.default_rng(12)
    rows = [(k, rng.integers(-2, 3, 3 + k % 2).astype(float).tolist()) for k in range(900)]  # many ties
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    embeddings = table.toPandas()  # noqa: F841
    want = duckdb.sql(queries.ORACLES["op10_topk"]).fetchall()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert sorted(map(tuple, topk.top_k(table, query_block=4, block=16).collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_topk_blocks_and_copies_are_bounded(spark):
    rows = [(k, [0.5] * 20_000) for k in range(40)] + [(k, [1e6] * 64) for k in range(40, 5000)]
    found = topk.blocks(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(1), 2048, 256)
    sizes = {r.dim: r.most for r in found.groupBy("dim").agg(F.max(F.octet_length("vectors")).alias("most")).collect()}
    assert sizes == {20_000: 6 * 20_000 * 2, 64: 2048 * 64 * 4}  # narrow numbers; a megabyte as doubles
    for gb in (0.02, 0.24, 6, 30):  # as the check tool sets partitions
        n = int(gb * 1e9 / 406 / 50)
        groups, shares = topk.tiles(max(12, round(100 * gb)), n, n * 512, 50, 2048)
        assert groups <= 50 * shares and n * 512 / shares <= topk.HELD and shares <= max(topk.COPIES, -(-n * 512 // topk.HELD))


def test_chat_keeps_rows_that_tie(spark, tmp_path):
    rows = [(1, 0, "user", "a<b"), (1, 0, "user", "a<b"), (1, 0, "assistant", "zz"), (1, 1, "assistant", None), (1, 1, "assistant", ""), (2, None, "user", "q"), (2, None, "assistant", "r"), (2, None, None, "&"), (2, 0, "assistant", "é\n")]
    rows += [(3, k % 3, "assistant" if k % 2 else "user", f"{k % 5}") for k in range(40)]
    folder = tables(spark, tmp_path / "ties", conversations=rows)
    got = queries.QUERIES["op7_chat"](spark, folder).toPandas()
    assert rows_of(got) == rows_of(sql(folder, "op7_chat")) and dict(zip(got.conv_id, got.n_turns, strict=True)) == {1: 5, 2: 4, 3: 40, -7: 2}


def test_chat_events_of_several_messages_in_a_turn(spark):
    log = [(1, 0, "b", 1, "open", "user", "x"), (1, 0, "a", 2, "delta", "user", "y"), (1, 0, "a", 3, "delta", "user", "z"), (1, 0, "b", 4, "delete", "user", None)]
    done = chat.format_chats(spark.createDataFrame(log, "conv_id long, turn long, m string, seq long, kind string, role string, text string"), message="m")
    assert [tuple(t) for t in chat.read_back(done).first().turns] == [("user", "yz")]


def weak(text):
    return F.unhex(F.lpad(F.hex(F.length(text) % 4), 2, "0"))


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, weak])
def test_state_lasts_over_calls(spark, tmp_path, digest):
    parts = [[(k, f"text {k % 5}", "a") for k in range(20)], [(k, f"text {k % 8}", "a") for k in range(20, 40)], [(100, None, "a"), (101, "", "a")]]
    state, seen = f"file://{tmp_path}/state", []
    for n, rows in enumerate(parts):
        docs(spark, rows).write.parquet(f"{tmp_path}/docs{n}")
        seen += rows
        table = spark.read.parquet(f"{tmp_path}/docs{n}")
        if digest is weak:
            entries = exact_dedup.exact_dedup(table, digest, state, f"call{n}")
            assert entries.count() == len(rows)
            if n == 0:  # all texts are of one length, so that one digest is in dispute
                assert {(r.doc_id, r.keep_id, r.group_size) for r in entries.collect()} == {(k, max(j for j in range(20) if j % 5 == k % 5), 4) for k in range(20)}
            continue
        for _ in range(2):  # a call that is made again changes nothing
            got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(table, digest, state, f"call{n}").collect()}
            same = {i: [j for j, u, _ in seen if (u or "") == (t or "")] for i, t, _ in rows}
            assert got == {i: (max(g), len(g), max(g) == i) for i, g in same.items()}


def test_earlier_content_is_found_by_its_locator(spark, tmp_path):
    docs(spark, [(1, "ab", "a"), (2, "cdef", "a")]).write.parquet(f"{tmp_path}/one")
    docs(spark, [(7, "xy", "a")]).write.parquet(f"{tmp_path}/two")
    state = f"file://{tmp_path}/state"
    exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/one"), weak, state, "one").collect()
    found = exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/two"), weak, state, "two").collect()
    assert [(r.doc_id, r.keep_id, r.group_size) for r in found] == [(7, 7, 1)]  # "ab" has the digest, not the bytes


def test_exact_keep_one_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "beside", lambda small, rows: small)
    rows = [(k, f"t{k % 7}", "a") for k in range(50)] + [(49, "t0", "b"), (49, "t0", "b"), (None, "alone", "a"), (None, "alone", "a")]
    kept = exact_dedup.keep_one(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, "alone"), (49, "t0"), *[(max(k for k in range(50) if k % 7 == j), f"t{j}") for j in range(1, 7)]])


def test_shards_by_hand(spark):
    rng = random.Random(6)
    rows = [(k, "y" * rng.randint(0, 9), rng.choice(["a", "b", "c", None, "b"])) for k in range(211)]
    mixed = lambda i: hashlib.md5(f"{shards.SEED}:{i}".encode()).hexdigest()
    ranks = []
    for source in ("a", "b", "c", None):
        own = sorted((mixed(i), i) for i, _, s in rows if s == source)
        ranks += [((k + 0.5) / len(own), source is None, source or "", m, i) for k, (m, i) in enumerate(own)]
    want, n, count = {}, len(rows), {}
    for place, (*_, i) in enumerate(sorted(ranks)):
        shard = place * 16 // n
        want[i] = (shard, count.setdefault(shard, 0))
        count[shard] += 1
    got = shards.shard_documents(docs(spark, rows), 16).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want
    assert all(r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) for r in got for t in [dict((i, t) for i, t, _ in rows)[r.doc_id]])


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES["op1_quality"](spark, folder).toPandas().set_index("doc_id")
    marks = pd.read_parquet(f"{folder}/labels.parquet").dropna(subset=["quality"]).set_index("doc_id").quality
    held = [i for i in marks.index if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) >= 50 and got.held_out[held].all() and (got.predicted[held] == marks[held]).mean() >= 0.95
    assert (got.predicted == (got.score >= 0.3)).all()


def test_bradley_terry_is_the_least_loss():
    """Newton's weights against plain gradient descent on the same pairs."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    label = (x @ [1.0, -2.0, 0.5] + rng.normal(size=80) > 0).astype(int)
    ranker = quality.bradley_terry(x, label, pairs=4000, seed=7)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    draw = np.random.default_rng(7)
    better, worse = draw.choice(np.flatnonzero(label == 1), 4000), draw.choice(np.flatnonzero(label == 0), 4000)
    d, w = z[better] - z[worse], np.zeros(3)
    for _ in range(4000):
        w -= 0.5 * (-d.T @ (1 / (1 + np.exp(d @ w))) / len(d) + 1e-3 * w)
    assert np.abs(w - ranker.weights).max() < 1e-3


def test_quality_labels_of_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(30)) if k % 2 else "!!! " * 30, "a") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    once, often = quality.fit(docs(spark, rows), labels), quality.fit(docs(spark, rows + rows[:10] * 5), labels)
    assert np.allclose(once.weights, often.weights)


def test_packing_ids_follow_long_texts(spark):
    text = "word " * 60_000
    got = packing.pack(docs(spark, [(1, text, "a"), (2, None, "a"), (2, None, "a")])).collect()
    own = sorted((r.start, r.length) for r in got if r.doc_id == 1)
    assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) == own[-1][0] + own[-1][1]
    assert sum(r.length for r in got if r.doc_id == 2) == 2


def test_roots_are_compared_too(spark):
    """The least node of a candidate component is alike to one that the forest links through others."""
    hashes = lambda *k: np.array(sorted(k), np.uint64).tobytes()
    sets = spark.createDataFrame([(1, hashes(*range(10))), (2, hashes(*range(6, 16))), (3, hashes(*range(9), 99)), (7, hashes(*range(50, 60))), (8, hashes(70))], "node long, hashes binary")
    tried = spark.createDataFrame([(2, 1), (3, 2), (8, 7)], "u long, v long")
    parts = components.components(simhash.alike(tried, sets, 0.8))
    joining, _ = simhash.settled(tried, parts, sets, 0.8)
    assert [tuple(sorted(r)) for r in joining.collect()] == [(1, 3)]


def test_sets_are_compared_in_bit_planes(monkeypatch):
    rng = np.random.default_rng(31)
    n = np.r_[rng.integers(1, 400, 300), -rng.integers(321, 900, 200)]
    n = np.repeat(n, 3) + 0
    base = rng.integers(0, 2, (500, 256), dtype=np.uint8)
    bits = np.repeat(base, 3, axis=0) ^ (rng.random((1500, 256)) < rng.choice([0.0, 0.02, 0.15, 0.2], (1500, 1)))
    sketch = np.packbits(bits.astype(np.uint8), axis=1).view(simhash.U).reshape(-1, 4)
    group = np.sort(np.r_[np.repeat(np.arange(240), 5), np.full(300, 1000)])
    order = np.argsort(np.arange(1500) % 1200 // 300, kind="stable")  # groups mix neighbours of several bases
    n, bits, sketch = n[order], bits[order], sketch[order]
    seen, bare = [], simhash.near_at
    monkeypatch.setattr(simhash, "near_at", lambda planes, d, valid, radius: seen.append(planes.shape[0]) or bare(planes, d, valid, radius))
    got = simhash.near_sets(group, n, sketch, 67, 0.8)
    assert set(seen) == {256}  # all pairs went through the planes
    near = lambda i, j: group[i] == group[j] and min(abs(n[i]), abs(n[j])) >= 0.8 * max(abs(n[i]), abs(n[j])) - 1e-9 and (bits[i] != bits[j]).sum() <= (67 if n[i] < 0 else (abs(n[i]) + abs(n[j])) / 9 + 1e-9)
    want = np.arange(1500)
    for i in range(1500):
        for j in range(i):
            if group[i] == group[j] and want[i] != want[j] and near(j, i):
                want[want == max(want[i], want[j])] = min(want[i], want[j])
    assert np.array_equal(got, want) and len(np.unique(want)) < 1400


def test_similar_groups_take_fingerprint_links(spark, monkeypatch):
    taken, bare = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, radius, keys, lanes: taken.append((radius, lanes, nodes.count())) or bare(nodes, radius, keys, lanes))
    rows = [(k, " ".join(f"w{k // 3}x{j}" for j in range(60 + k % 3)), "a") for k in range(30)]
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs(spark, rows)).collect()} == {k: k // 3 * 3 for k in range(30)}
    assert taken == [(4, 1, 30)]


def test_near_groups_do_not_depend_on_partitions(spark):
    rng = random.Random(21)
    rows = []
    for c in range(6):  # chains of copies around 0.8, so that most links are no direct candidates of the least document
        text = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
        for k in range(25):
            text = text.copy()
            for _ in range(rng.randint(1, 3)):
                text[rng.randrange(120)] = f"n{rng.randint(0, 9999)}"
            rows.append((100 * c + rng.randrange(100), " ".join(text), "a"))
    rows = list({i: (i, t, s) for i, t, s in rows}.values())
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t, _ in rows for w in [t.split()]}
    want = brute_groups(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    for parts in (1, 3, 8):
        assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs(spark, rows, parts)).collect()} == want
