"""The training-data operators against brute force, on awkward tables: nulls, empties, repeats, ties, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tapelake.llm import chat, components, exact_dedup, mixture, packing, passages, quality, queries, shards, simhash, suffixes, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, batch string, th string, digest string, _rank int"


def docs(spark, rows, parts=3):
    """rows (doc_id, text, source); the further columns clash with names that operators use inside."""
    return spark.createDataFrame([(*r, "b", "t", "d", 1) for r in rows], DOCS).repartition(parts)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    rows = [(0, None, None), (1, "", "a"), (2, " \n\t", "a"), (3, "one", "b"), (4, "one", "b"), (5, passage, "a"), (6, passage, "c"), (7, "x " * 900, "a"), (8, "a" * 2000, None), (9, "ab" * 700 + "a" * 500, "a")]
    for k in range(10, 60):
        body = [word() for _ in range(rng.randint(1, 120))]
        if k % 3 == 0:
            cut = rng.randint(0, len(body))
            body[cut:cut] = passage.split()[rng.randint(0, 20) : rng.randint(30, 60)]
        rows.append((k, rng.choice([" ", "  ", "\n"]).join(body), rng.choice("abc")))
    rows += [(k, rows[20][1], "a") for k in range(60, 75)] + [(75, rows[21][1] + " end", "a"), (76, "é" * 40 + passage[:500], "b")]
    return rows


def words(text):
    return (text or "").encode().split()


def brute_passages(rows, window):
    seen, out = set(), {}
    for i, t in sorted((r[:2] for r in rows), key=lambda r: r[0]):
        w = words(t)
        dead = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                dead[k : k + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(dead), b" ".join(x for x, d in zip(w, dead, strict=True) if not d).decode())
    return out


@pytest.mark.parametrize("batch_bytes", [1 << 20, 3000])
def test_passages(spark, corpus, batch_bytes):
    got = passages.repeated_passages(docs(spark, corpus), 20, batch_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute_passages(corpus, 20)
    assert all(sum(n for _, n in r.removed) == r.n_removed for r in got)


def test_cover_has_all_differences():
    assert {(a - b) % passages.PERIOD for a in passages.COVER for b in passages.COVER} == set(range(passages.PERIOD))


def brute_bytes(rows, window):
    where = defaultdict(list)
    raw = {i: (t or "").encode() for i, t, *_ in rows}
    for i, b in raw.items():
        for k in range(len(b) - window + 1):
            where[b[k : k + window]].append((i, k))
    dead = {i: bytearray(len(b)) for i, b in raw.items()}
    for places in where.values():
        if len(places) > 1:
            for i, k in places:
                dead[i][k : k + window] = b"\1" * window
    return {i: (len(b), sum(dead[i]), len(re.findall(rb"\x01+", bytes(dead[i]))), bytes(x for x, d in zip(b, dead[i], strict=True) if not d)) for i, b in raw.items()}


@pytest.mark.parametrize(("window", "gram", "block"), [(400, 32, 1 << 20), (60, 8, 4000), (33, 8, 700)])
def test_suffixes(spark, corpus, window, gram, block):
    got = suffixes.repeated_bytes(docs(spark, corpus), window, gram, block).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == brute_bytes(corpus, window)


def test_suffix_order_is_lexicographic():
    rng = random.Random(3)
    for _ in range(30):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(4)]
        padded, active = [t + bytes(16) for t in texts], np.array([len(t) + 1 for t in texts])
        base = np.cumsum([0, *map(len, padded[:-1])])
        whole = np.frombuffer(b"".join(padded), np.uint8)
        order = suffixes.suffix_order(whole, base, active, 16)
        keys = [whole.tobytes()[p : p + 16] for p in order]
        assert keys == sorted(keys) and len(order) == active.sum()


def brute_groups(names, near):
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(names)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if near(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in names}


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, corpus):
    rows = [*corpus, (80, "One", "a"), (81, "É one", "a")]
    got = {r.doc_id: (r.fp.hex(), r.component_id) for r in simhash.near_dedup(docs(spark, rows)).collect()}
    fp = {i: fingerprint(t) for i, t, _ in rows}
    groups = brute_groups(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    assert got == {i: (f"{fp[i]:016x}", groups[i]) for i in fp}


@pytest.mark.parametrize("distinct", [False, True])
def test_long_texts_are_summed_whole(spark, distinct):
    rng = random.Random(8)
    long = lambda n: " ".join(f"w{rng.randint(0, 999)}" for _ in range(n))
    rows = [(k, t, "a") for k, t in enumerate([long(95), "one", long(30), long(260), long(64), "", long(131), long(63), long(40)])]
    got = {r.doc_id: r.fp.hex() for r in simhash.fingerprints(docs(spark, rows, 1), distinct=distinct, stretch=10, long=60).collect()}
    assert got == {i: f"{fingerprint(t):016x}" for i, t, _ in rows}
    again = {r.doc_id: r.fp.hex() for r in simhash.fingerprints(docs(spark, rows[::-1], 1), distinct=distinct, stretch=10, long=60).collect()}
    assert again == got


def test_simhash_tiles_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = sorted({b ^ sum(1 << k for k in rng.sample(range(12), rng.randint(0, 6))) for b in base for _ in range(80)})
    prints = spark.createDataFrame([(i, v.to_bytes(8, "big")) for i, v in enumerate(values)], "doc_id long, fp binary")
    got = {r.doc_id: r.component_id for r in simhash.near_components(prints, 2).collect()}
    assert got == brute_groups(range(len(values)), lambda a, b: (values[a] ^ values[b]).bit_count() <= 2)


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (150, 64)).astype(np.uint8)
    bits[75:] = bits[:75] ^ (rng.random((75, 64)) < 0.06)
    planes = simhash.planes_of(bits)
    for d in (1, 64, 75, 130):
        valid = np.zeros(192, np.uint8)
        valid[: 150 - d] = 1
        hit = simhash.near_at(planes, d, np.packbits(valid, bitorder="little").view("<u8"), 4)
        got = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
        assert got.tolist() == [i for i in range(150 - d) if (bits[i] != bits[i + d]).sum() <= 4]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert {r for n, r in got.items() if n <= 40} == {0} and got[100] == 99


@pytest.mark.parametrize("seed", range(2))
def test_components_of_random_edges(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500, k) for k in range(400, 440)] + [(7, 7), (None, 3), (3, None), (500, 400)]
    root = {n: n for p in pairs if None not in p and p[0] != p[1] for n in p}
    for _ in root:
        for a, b in pairs:
            if a in root and b in root and a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    linked = {r.node: r.root for r in got}
    assert all(linked.get(n, n) == r for n, r in root.items())
    assert len(linked) == len(got) and set(linked) <= set(root)
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_similar_groups_are_checked(spark):
    rng = random.Random(2)
    text = [f"w{rng.randint(0, 9999)}" for _ in range(400)]
    near, far = text.copy(), text.copy()
    for k in (50, 200):
        near[k] = "new"
    far[:200] = [f"v{k}" for k in range(200)]
    rows = [(1, " ".join(text), "a"), (2, " ".join(near), "a"), (3, " ".join(far), "a"), (4, None, "a")]
    assert sorted(r.doc_id for r in simhash.keep_one(docs(spark, rows)).collect()) == [1, 3, 4]


@pytest.mark.parametrize(("tile", "size"), [(512, 8 << 20), (7, 8 << 20), (512, 20_000)])
def test_similar_groups_lose_no_link(spark, monkeypatch, tile, size):
    monkeypatch.setattr(simhash, "SET_TILE", tile)
    monkeypatch.setattr(simhash, "SET_BYTES", size)
    rng = random.Random(11)
    rows = [(500, "spam " * 400 + " ".join(f"p{k}" for k in range(90)), "a"), (501, "spam " * 400 + " ".join(f"q{k}" for k in range(90)), "a")]
    for c in range(3):  # copies with 0 to 9 of 250 words changed: similarities on both sides of 0.8
        base = [f"w{rng.randint(0, 9999)}" for _ in range(250)]
        for k in range(40):
            text = base.copy()
            for _ in range(rng.randint(0, 9)):
                text[rng.randrange(250)] = f"n{rng.randint(0, 9999)}"
            rows.append((100 * c + k, " ".join(text), "a"))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t, _ in rows for w in [t.split()]}
    want = brute_groups(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(spark, rows)).collect()}
    assert got == want and got[501] == 501


@pytest.mark.parametrize("common", [8, 1])
def test_similar_pairs_are_all_found(spark, monkeypatch, common):
    if common == 1:  # common shingles last, and dealt to parts
        monkeypatch.setattr(simhash, "SAMPLE", 2)
        monkeypatch.setattr(simhash, "TILE", 8)
        monkeypatch.setattr(simhash, "COMMON", 2)
    rng = random.Random(9)
    rows, want = [], set()
    line = " ".join(f"line{k}" for k in range(12))
    for k in range(400):  # pairs alone in their groups, at 0.8 (each second one just below), of 5 to 640 shingles
        n = 5 * rng.choice([1, 2, 3, 5, 8, 16, 40, 63, 64, 70, 79, 80, 81, 100, 128])
        words = [f"w{rng.getrandbits(40)}" for _ in range(n + 4)]
        if n >= 40 and k % 3 == 0:
            words[2:14] = line.split()
        less = n // 5 + k % 2
        rows += [(2 * k, " ".join(words), "a"), (2 * k + 1, " ".join(words[:-less]), "a")]
        if k % 2 == 0:
            want.add(2 * k + 1)
    got = {r.doc_id for r in simhash.similar_groups(docs(spark, rows)).where("doc_id != component_id").collect()}
    assert got == want


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 5), 2, "0"))])
def test_exact_dedup(spark, corpus, digest):
    rows = [*corpus, (5, corpus[5][1], "z"), (None, "one", "a"), (None, "alone", "a")]
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = sorted((repr(i), repr(k := max((x for x in g if x is not None), default=None)), len(g), i == k) for g in groups.values() for i in g)
    got = exact_dedup.exact_dedup(docs(spark, rows), digest).collect()
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.kept) for r in got) == want
    kept = exact_dedup.keep_one(docs(spark, rows))
    assert kept.count() == len(groups) and kept.columns == ["doc_id", "text", "source", "batch", "th", "digest", "_rank"]


def test_shards(spark, corpus):
    rows = [*corpus, (5, "again", "z"), (None, "x", None)]
    got = shards.shard_documents(docs(spark, rows), 4).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(rows) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    for source in "abc":  # the mixture of each shard
        n = sum(r[2] == source for r in rows)
        assert all(abs((g.source == source).sum() - n / 4) <= 2 for _, g in got.groupby("shard"))
    assert dict(zip(got.doc_id, got.text_crc32, strict=True))[3] == zlib.crc32(b"one")
    assert shards.shard_documents(docs(spark, rows), 4).exceptAll(shards.shard_documents(docs(spark, rows, 7), 4)).count() == 0


def test_mixture(spark, corpus):
    rows = [(*r[:2], r[2]) for r in corpus] + [(90 + k, "w " * (k + 1), "d") for k in range(3)] + [(99, None, "e")]
    got = mixture.mix_documents(docs(spark, rows)).toPandas()
    goal = got.drop_duplicates("source_size").set_index("source_size").target
    assert abs(got.drop_duplicates(["source_size", "target"]).target.sum() - 1.5 * got["size"].sum()) < 1e-6
    assert (got.target <= 2 * got.source_size + 1e-9).all() and (got.copies <= 2).all() and (got.copies >= 0).all()
    for size, g in got.groupby("source_size"):
        assert abs((g.copies * g["size"]).sum() - goal[size]) <= 2 * g["size"].max()
    out = mixture.mix(docs(spark, rows))
    assert out.count() == got.copies.sum() and out.columns[0] == "doc_id"


def test_packing_round_trip(spark, corpus):
    from tokenizers import Tokenizer
    import public_tokenizers

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ref.encode_special_tokens = True
    rows = [*corpus, (77, "<|endoftext|> naïve  中文 \U0001f600 don't 123", "a"), (78, "w" * 5000, "a")]
    got = packing.pack(docs(spark, rows), 256, 128, block=16, with_ids=True).toPandas()
    for i, text, _ in rows:
        ids = [*ref.encode(text or "", add_special_tokens=False).ids, 0]
        mine = got[got.doc_id == i].sort_values("start")
        assert [x for p in mine.ids for x in p] == ids and (mine.doc_tokens == len(ids)).all()
        assert mine.start.tolist() == np.r_[0, np.cumsum(mine.length)[:-1]].tolist()
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(mine.ids, mine.ids_crc32, strict=True))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 256 and g.offset.tolist() == np.r_[0, np.cumsum(g.length)[:-1]].tolist()


def test_packing_takes_long_whitespace(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = lambda t: ref.encode(t, add_special_tokens=False).ids
    texts = ["a" + " " * 1_200_000 + "b  c", "\n" * 1_100_000, "x \t" + " \u3000\n" * 400_000 + "\n'll"]
    got = packing.pack(docs(spark, [(k, t, "a") for k, t in enumerate(texts)]), with_ids=True).orderBy("doc_id", "start").collect()
    for k, text in enumerate(texts):
        assert [x for r in got if r.doc_id == k for x in r.ids] == [*want(text), 0]
    tokens = packing.encoder(None)
    rng = random.Random(3)
    for _ in range(300):  # runs of all kinds, cut from a length of 3 on
        text = "".join(rng.choice([" ", "  ", "\n", "\xa0", "\x1c", "\x85", " \t \n", "a", "é", "7", "'s", "!", "\u2003 "]) for _ in range(rng.randint(0, 40)))
        assert packing.encode(tokens, text, 2) == want(text)


def test_differencing_balances():
    sizes = np.random.default_rng(0).integers(1, 300, 500).tolist()
    slots = packing.difference(sizes, 80)
    assert sorted(k for _, m in slots for k in m) == list(range(500)) and slots[-1][0] - slots[0][0] <= 12
    windows = packing.windows_of(sizes, 1024)
    assert max(sum(sizes[k] for k in w) for w in windows) <= 1024 and len(windows) <= sum(sizes) / 1024 + 2
    assert packing.windows_of([], 10) == []


def test_quality_learns_pairs(spark):
    rng = random.Random(4)
    rows, marks = [(0, None, "a")], []
    for k in range(1, 400):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(40)]
        rows.append((k, " ".join(w) if k % 4 else "!! ".join(x.upper() for x in w), "a"))
        marks.append((k, int(k % 4 > 0), 0))
    table, labels = docs(spark, rows), spark.createDataFrame([*marks, (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(table, quality.fit(table, labels)).toPandas().set_index("doc_id")
    held = [k for k in range(1, 400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got.predicted[k] == int(k % 4 > 0) for k in held) and got.score.between(0, 1).all()
    assert quality.keep_good(table, quality.fit(table, labels)).count() == got.predicted.sum()
    none = quality.score(table, quality.fit(table, labels.limit(0))).toPandas()
    assert (none.score - 0.5).abs().max() < 1e-9


def test_chat_folds_and_reads_back(spark):
    e = "conv_id long, turn long, seq long, kind string, role string, text string, log string"
    log = [
        (1, 0, 1, "open", "user", "a<b> & \\l", "x"), (1, 1, 2, "delta", "assistant", "he", "x"), (1, 1, 3, "delta", "assistant", "llo", "x"), (1, 1, 3, "delta", "assistant", "llo", "x"),
        (1, 2, 4, "open", "user", "no", "x"), (1, 2, 5, "edit", "user", "yes", "x"), (1, 3, 6, "delta", "assistant", "bad", "x"), (1, 3, 7, "regenerate", "assistant", "</turn>\n&lt;", "x"),
        (1, 4, 8, "open", "user", "gone", "x"), (1, 4, 9, "delete", "user", None, "x"), (None, 0, 0, "open", None, None, "x"), (2, None, 0, "open", "assistant", "é", "x"),
    ]
    done = chat.format_chats(spark.createDataFrame(log, e))
    back = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_texts) for r in chat.read_back(done).collect()}
    assert back == {1: ([("user", "a<b> & \\l"), ("assistant", "hello"), ("user", "yes"), ("assistant", "</turn>\n&lt;")], ["hello", "</turn>\n&lt;"]), None: ([("", "")], []), 2: ([("assistant", "é")], ["é"])}
    assert done.where("conv_id = 1").first().formatted.count("</turn>") == 4


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).round(1).tolist()) for k in range(300)]
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (304, []), (350, [1.0, 2.0]), (351, [1e6, 1.0]), (None, [0.0] * 8), (7, rows[7][1])]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, g int").repartition(3)
    got = defaultdict(list)
    for r in topk.top_k(table, 5, 50, 256, query_block=2, block=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = {q: sorted(((c, int(whole[q] @ x)) for c, x in whole.items() if c != q and len(x) == len(whole[q])), key=lambda p: (-p[1], p[0]))[:5] for q in whole if q % 50 == 0}
    assert got == {q: w for q, w in want.items() if w}


@pytest.mark.parametrize("block", [8, 2048])
def test_topk_counts_repeated_rows(spark, block):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8).round(1).tolist()) for k in range(120)]
    rows += [(201, [9.0] * 8)] * 9 + [(50, rows[50][1])] + [(202, [5.0] * 8)] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    embeddings = table.toPandas()  # noqa: F841
    want = duckdb.sql(queries.ORACLES["op10_topk"]).fetchall()
    assert sorted(map(tuple, topk.top_k(table, block=block).collect())) == sorted(want)


OPERATORS = {
    "passages": lambda d: passages.repeated_passages(d), "suffixes": lambda d: suffixes.repeated_bytes(d), "simhash": lambda d: simhash.near_dedup(d), "keep_one": lambda d: simhash.keep_one(d), "exact": lambda d: exact_dedup.exact_dedup(d),
    "shards": lambda d: shards.shard_documents(d), "mixture": lambda d: mixture.mix_documents(d), "mix": lambda d: mixture.mix(d), "packing": lambda d: packing.pack(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_and_repeated(spark, name):
    assert OPERATORS[name](docs(spark, [])).count() == 0
    rows = [(1, "same text", "a"), (1, "same text", "a"), (1, "other text", "a"), (None, None, None)]
    assert OPERATORS[name](docs(spark, rows)).count() >= 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    cols = sorted(want.columns)
    key = lambda df: sorted(tuple(round(float(v), 6) if isinstance(v, float) else v for v in r) for r in df[cols].astype(object).itertuples(index=False))
    assert sorted(got.columns) == cols and key(got) == key(want)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    read = spark.read.parquet(f"{SF}/documents.parquet")
    now, columns = read, read.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, stage(spark, now, SF)
        if k < 4:
            assert now.columns == columns
        if k in (0, 1, 2):
            ids = {r.doc_id for r in now.select("doc_id").collect()}
            assert ids and ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if k == 1:
            assert now.select("text").distinct().count() == now.count() == before.select("text").distinct().count()
        now = now.persist()
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == now.agg(F.sum("length")).first()[0]
