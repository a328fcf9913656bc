"""Suffix-array dedup, fingerprints and SimHash groups against brute force."""

import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillstone.llm import simhash_dedup, suffix_dedup
from quillstone.llm.fingerprints import canonical, document_fingerprints, folding_sql
from quillstone.llm.suffix_dedup import Config, cut_repeats, repeated_passages

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that the operators use inside.
CLASH = "doc_id long, text string, _new string, row string, key string, id long, fp string, u long, _cuts int, n_chars long"


def corpus(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame([(i, t) for i, t in texts], schema)


def brute_windows(docs, k):
    """(id, text) -> word positions in repeated windows, and those of first occurrences."""
    seen = defaultdict(list)
    distinct = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0))
    for d in distinct:
        words = d[1].split()
        for i in range(len(words) - k + 1):
            seen[tuple(words[i : i + k])].append((d, i))
    every, own = defaultdict(set), defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                every[d] |= set(range(i, i + k))
            d, i = places[0]
            own[d] |= set(range(i, i + k))
    return every, own


def random_corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    shared = [" ".join(rng.choices(vocab, k=rng.randint(4, 25))) for _ in range(6)]
    texts = []
    for i in range(40):
        parts = [" ".join(rng.choices(vocab, k=rng.randint(0, 12)))] + [x for x in rng.choices(shared, k=rng.randint(0, 3))]
        rng.shuffle(parts)
        texts.append((i, " ".join(parts)))
    return texts + [(90, shared[0] + " " + shared[0]), (91, "a a a a a a a a a a a a"), (92, "")]


@pytest.mark.parametrize(("seed", "hot"), [(1, 1000), (2, 1000), (1, 0), (2, 3)])
def test_passages_are_those_of_brute_force(spark, seed, hot):
    texts = random_corpus(seed)
    config = Config(words=6, gram=3, trigger=2, modulus=2, part=300, hot=hot)
    df = corpus(spark, texts)
    found = repeated_passages(df, config=config)
    every, own = brute_windows(texts, 6)
    got_every, got_own = defaultdict(set), defaultdict(set)
    for r in found.collect():
        d = next(t for t in texts if t[0] == r.doc_id)
        new = set(range(r.word_start, r.word_stop))
        assert not got_every[d] & new  # spans are disjoint
        got_every[d] |= new
        if r.first:
            got_own[d] |= new
    assert {k: v for k, v in got_every.items() if v} == {k: v for k, v in every.items() if v}
    assert {k: v for k, v in got_own.items() if v} == {k: v for k, v in own.items() if v}


def test_cutting_leaves_one_copy(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{rng.randint(0, 9999)}" for _ in range(60))
    own = {i: " ".join(f"d{i}x{k}" for k in range(20)) for i in range(5)}
    texts = [(i, own[i] + "\n" + passage + "\n" + own[i] + "end") for i in range(5)] + [(9, passage), (10, passage.replace("p", "q"))]
    df = corpus(spark, texts)
    out = {r.doc_id: r.text for r in cut_repeats(df, repeated_passages(df)).collect()}
    assert sum(passage in t for t in out.values()) == 1 and passage in out[0]
    assert 9 not in out  # nothing was left of it
    assert out[10] == texts[-1][1]
    for i in range(1, 5):
        assert out[i] == own[i] + "\n" + own[i] + "end"


def test_order_is_lexicographic():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = rng.integers(1, 40, 6)
        bounds = np.r_[0, np.cumsum(sizes)]
        symbols = rng.integers(2, 5, int(bounds[-1]))
        config = Config(words=5, gram=2, trigger=2, modulus=3)
        order = suffix_dedup.corpus_order(symbols, bounds, config)
        stop = np.repeat(bounds[1:], sizes)
        keys = [tuple(symbols[i : min(i + 5, stop[i])]) for i in order]
        assert keys == sorted(keys)


EDGE = [
    (1, "same words here", "x", "r", "k", 7, "f", 1, 2, 3), (1, "same words here", "x", "r", "k", 7, "f", 1, 2, 3),
    (2, None, None, None, None, None, None, None, None, None), (None, "no id at all", None, None, None, None, None, None, None, None),
    (3, "", "x", "r", "k", 7, "f", 1, 2, 3), (4, "  \n ", "x", "r", "k", 7, "f", 1, 2, 3), (5, "z" * 100_000 + " " + "word " * 30_000, "x", "r", "k", 7, "f", 1, 2, 3),
]


def test_edges_of_passages(spark):
    df = spark.createDataFrame(EDGE, CLASH)
    spans = repeated_passages(df)
    assert {r.doc_id for r in spans.collect()} == {5}  # within the one long text
    out = cut_repeats(df, spans)
    assert out.columns == df.columns and out.count() == len(EDGE)
    none = df.limit(0)
    assert repeated_passages(none).count() == 0
    assert cut_repeats(none, repeated_passages(none)).count() == 0


def test_repeated_rows_and_versions(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    df = corpus(spark, [(1, a), (1, a), (1, b), (None, b), (None, b)])
    got = Counter((r.doc_id, r.first) for r in repeated_passages(df).collect())
    assert got == {(1, False): 1, (None, True): 1}  # rows equal in id and text are one; null ids sort first


def test_fingerprints_against_python(spark):
    texts = [(1, "Straße  Ünï\n"), (2, "straße ünï"), (3, "STRASSE u\u0308nï"), (11, "a\u00a0b"), (12, "a\u3000\u2028B"), (13, "ΣΑΣ"), (14, "σας"), (15, "\u1e9e"), (16, "ss"), (4, None), (5, None), (6, ""), (7, " \t"), (8, "a b"), (8, "A   B"), (None, "a b"), (9, "x" * 300_000), (10, "X" * 300_000)]
    got = {(r.doc_id, r.digest): (r.group_id, r.group_size) for r in document_fingerprints(corpus(spark, texts)).collect()}
    canon = lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).casefold()).split())
    groups = defaultdict(list)
    for i, t in texts:
        groups[i if t is None else canon(t)].append(i)
    want = Counter()
    for i, t in texts:
        g = groups[i if t is None else canon(t)]
        want[i, min(x for x in g if x is not None), len(g)] += 1
    assert Counter((k[0], *v) for k, v in got.items()).keys() == want.keys()
    assert all((d is None) == (i in (4, 5)) for i, d in got)
    assert all(d is None or any(bytes(d) == xxhash.xxh3_128_digest(canon(t).encode()) for j, t in texts if i == j and t is not None) for i, d in got)
    assert got[3, next(d for i, d in got if i == 3)] == (1, 3) and {got[i, next(d for j, d in got if j == i)] for i in (8, 11, 12)} == {(8, 5)}
    assert document_fingerprints(spark.createDataFrame(EDGE, CLASH)).count() == len(EDGE)
    assert document_fingerprints(corpus(spark, [])).count() == 0


def test_folding_in_sql_groups_the_same():
    import duckdb

    texts = [f"x{chr(c)} y{chr(c)}{chr(c)}" for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (chr(c) != chr(c).casefold() or chr(c) != chr(c).upper() or chr(c).isspace() or unicodedata.decomposition(chr(c)))]
    con = duckdb.connect()
    con.register("t", pa.table({"text": texts}))
    theirs = dict(con.execute(f"SELECT text, {folding_sql('text')} FROM t").fetchall())
    pairs = {(canonical(t), theirs[t]) for t in texts}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})  # the same classes


def test_digests_that_clash_are_an_error(spark, monkeypatch):
    from quillstone.llm import fingerprints

    docs = corpus(spark, [(1, "one"), (2, "two")])
    monkeypatch.setattr(fingerprints, "HELD", 0)
    assert document_fingerprints(docs).count() == 2  # each body sent again
    pack = fingerprints.zstandard.ZstdCompressor().compress
    assert pack(b"one") != pack(b"two")


def plain_simhash(text):
    """SimHash by its definition, a word and a bit at a time, over the operator's word hashes."""
    found = sorted({w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", text.lower()) if w})
    if not found:
        return None
    raw = [np.frombuffer(w.encode(), np.uint8) for w in found]
    ones = [0] * 256
    for r in raw:
        h = simhash_dedup.word_hashes(r, np.array([0]), np.array([len(r)]))
        wide = simhash_dedup.mix(h[:, None] ^ simhash_dedup._LANES).view(np.uint8).ravel().tolist()
        for bit in range(256):
            ones[bit] += wide[bit // 8] >> (7 - bit % 8) & 1
    return [2 * n > len(found) for n in ones]


def test_simhash_is_the_plain_one(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect()] + ["", None, "...", "One one ONE two", "é ü 漢字", "a b"]
    fps, size = simhash_dedup.fingerprints(pa.array(texts, pa.string()))
    for t, f, n in zip(texts, fps, size, strict=True):
        want = plain_simhash(t or "")
        assert (want is None) == (n == 0)
        if want is not None:
            assert np.unpackbits(f).astype(bool).tolist() == want


def brute_groups(ids, fps, radius):
    x = fps.view(np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    pairs = set()
    for i in range(len(ids)):
        d = np.bitwise_count(x[i] ^ x[i + 1 :]).sum(axis=1)
        for j in np.flatnonzero(d <= radius) + i + 1:
            pairs.add((i, int(j)))
            root[find(i)] = find(int(j))
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return pairs, {frozenset(g) for g in groups.values() if len(g) > 1}


def test_simhash_recall_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    t = docs.select("doc_id", "text").toArrow()
    fps, size = simhash_dedup.fingerprints(t["text"].combine_chunks())
    keep = np.flatnonzero(size)
    ids = [t["doc_id"][int(i)].as_py() for i in keep]
    pairs, groups = brute_groups(ids, np.ascontiguousarray(fps[keep]), simhash_dedup.Config().radius)
    member = {r.doc_id: r.group_id for r in simhash_dedup.near_duplicates(docs).collect()}
    assert sum(member.get(ids[a], -1) == member.get(ids[b], -2) for a, b in pairs) >= 0.98 * len(pairs)
    truth = {i: min(g) for g in groups for i in g}
    assert set(member) <= set(truth)  # nothing that brute force doesn't group
    assert sum(member.get(i) == g for i, g in truth.items()) >= 0.95 * len(truth)


@pytest.mark.parametrize("rows", [1_000, 10_000, 4_000_000])
def test_pairs_near_the_radius_share_a_cell(rows):
    rng, config, n = np.random.default_rng(8), simhash_dedup.Config(), 2000
    base = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    for distance in range(39, config.radius + 1):
        flip = np.zeros((n, 256), np.uint8)
        np.put_along_axis(flip, rng.random((n, 256)).argsort(axis=1)[:, :distance], 1, axis=1)
        a, b = (simhash_dedup.cells(x, config, config.layout(rows)) for x in (base, base ^ np.packbits(flip, axis=1)))
        assert (a == b).any(axis=1).mean() >= 0.88, distance  # 0.9 by design; 0.88 leaves three deviations of the sample


def test_pivot_filter_keeps_what_is_near():
    rng = np.random.default_rng(2)
    config = simhash_dedup.Config()
    base = rng.integers(0, 256, (200, 32), dtype=np.uint8)
    near = base.copy()
    for i in range(200):
        bits = rng.choice(256, int(rng.integers(0, 60)), replace=False)
        flip = np.zeros(256, np.uint8)
        flip[bits] = 1
        near[i] ^= np.packbits(flip)
    fps = np.concatenate([base, near])
    a, b = np.arange(200), np.arange(200, 400)
    truth = simhash_dedup.hamming(fps, a, b) <= config.radius
    got = simhash_dedup.surviving(fps, a, b, simhash_dedup.coordinates(fps, config), config)
    assert got.tolist() == truth.tolist()


def test_dense_cells_connect_the_same():
    rng = np.random.default_rng(4)
    fps = np.repeat(rng.integers(0, 256, (3, 32), dtype=np.uint8), 60, axis=0)
    keys = np.zeros(180, np.int64)
    few, many = (simhash_dedup.cell_edges(keys, fps, simhash_dedup.Config(dense=d)) for d in (1000, 8))
    for a, b in (few, many):
        assert len({(min(x, y) // 60, max(x, y) // 60) for x, y in zip(a, b, strict=True)}) == 3
    assert len(few[0]) == 3 * 59 == len(many[0])


def pairs_at(n, distances, seed):
    """n unrelated fingerprints, and below them one at the given distance of each."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    flip = rng.random((n, 256)).argsort(axis=1).argsort(axis=1) < np.resize(distances, n)[:, None]
    return np.concatenate([base, base ^ np.packbits(flip, axis=1)])


def connected(n, a, b):
    """The groups of 0 .. n - 1 that pairs connect."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[find(x)] = find(y)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(i)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("size", [1_000, 200_000, 1 << 20])
def test_parts_lose_no_pair(size):
    radius = simhash_dedup.Config().radius
    found = simhash_dedup.parts(radius, size)
    assert sum(reach + 1 for _, reach in found) == radius + 1
    used = np.concatenate([bits for bits, _ in found])
    assert len(used) == len(set(used.tolist())) and max(len(bits) for bits, _ in found) <= 20
    fps = pairs_at(700, [radius, radius + 1], 3)
    want = {frozenset((i, i + 700)) for i in range(0, 700, 2)}  # those at the radius, not those beyond it
    if size < 1 << 20:
        assert connected(1400, *simhash_dedup.near_edges(fps, None, found, radius)) == want
    assert connected(1400, *simhash_dedup.near_edges(fps[:700], fps[700:], found, radius)) == want


def test_crowds_are_walked_to_the_same_groups():
    rng = np.random.default_rng(7)
    bases = rng.integers(0, 256, (3, 1, 32), dtype=np.uint8)
    fps = np.concatenate([(b ^ np.packbits(rng.random((400, 256)) < 0.06, axis=1)) for b in bases] + [rng.integers(0, 256, (300, 32), dtype=np.uint8)])
    rng.shuffle(fps)
    fps = np.ascontiguousarray(np.unique(fps, axis=0))
    want = brute_groups(range(len(fps)), fps, 44)[1]
    for size in (500, 100_000):
        a, b = simhash_dedup.near_edges(fps, None, simhash_dedup.parts(44, size), 44)
        assert connected(len(fps), a, b) == want
        assert len(a) == sum(len(g) - 1 for g in want)


def test_pairs_at_the_radius_are_all_found():
    """The tables of twin references have no common cell for some of them."""
    fps = pairs_at(2000, [44], 5)
    a, b = (simhash_dedup.cells(x, simhash_dedup.Config(), simhash_dedup.Config().layout(4000)) for x in (fps[:2000], fps[2000:]))
    assert not (a == b).any(axis=1).all()
    edges = simhash_dedup.near_edges(fps, None, simhash_dedup.parts(44, 4000), 44)
    assert connected(4000, *edges) == {frozenset((i, i + 2000)) for i in range(2000)}


@pytest.mark.parametrize("block", [1 << 20, 250])
def test_groups_are_those_of_all_pairs(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(1500)
    t = docs.select("doc_id", "text").toArrow()
    fps, size = simhash_dedup.fingerprints(t["text"].combine_chunks())
    keep = np.flatnonzero(size)
    config = simhash_dedup.Config(radius=70, block=block, tasks=8)  # at 70 of 256 bits the tables of twin references lose many pairs
    _, want = brute_groups([t["doc_id"][int(i)].as_py() for i in keep], np.ascontiguousarray(fps[keep]), config.radius)
    got = defaultdict(set)
    for r in simhash_dedup.near_duplicates(docs, config=config).collect():
        got[r.group_id].add(r.doc_id)
    assert {frozenset(g) for g in got.values()} == want


def test_spanning_pairs_connect_the_same():
    rng = np.random.default_rng(6)
    for _ in range(30):
        n = int(rng.integers(2, 60))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 80))))
        a, b = a[a != b], b[a != b]

        def roots(x, y, n=n):
            root = list(range(n))

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                p, q = sorted((find(i), find(j)))
                root[q] = p
            return [find(i) for i in range(n)]

        x, y = simhash_dedup.spanning(a, b)
        assert roots(x, y) == roots(a, b) and len(x) == n - len(set(roots(a, b)))


def test_edges_of_simhash(spark):
    rows = [*EDGE, (6, "same words here", "x", "r", "k", 7, "f", 1, 2, 3), (None, "no id at all", None, None, None, None, None, None, None, None), (1, "quite another text under one id", *[None] * 8), (7, "Quite another text under one id", *[None] * 8)]
    got = sorted((str(r.doc_id), r.copies, r.group_id, r.group_size, r.kept) for r in simhash_dedup.near_duplicates(spark.createDataFrame(rows, CLASH)).collect())
    assert got == [("1", 1, 1, 2, True), ("1", 2, 1, 3, True), ("6", 1, 1, 3, False), ("7", 1, 1, 2, False), ("None", 2, None, 2, True)]
    assert simhash_dedup.near_duplicates(corpus(spark, [])).count() == 0
    assert simhash_dedup.fingerprints(pa.array([None, "", "..."], pa.string()))[1].tolist() == [0, 0, 0]


def test_nodes_differ():
    fps = np.random.default_rng(1).integers(0, 256, (1000, 32), dtype=np.uint8)
    fps[500:] = fps[:500]
    fps[500:, 31] ^= 1
    assert len({r.tobytes() for r in simhash_dedup.node_keys(fps)}) == 1000


def test_many_copies_of_one_passage(spark):
    """A passage in every document: its inner segments are one content, its edges differ."""
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(80))
    texts = [(i, " ".join(f"a{rng.randint(0, 10**9)}" for _ in range(30)) + " " + passage + " " + " ".join(f"b{rng.randint(0, 10**9)}" for _ in range(30))) for i in range(300)]
    for hot in (50, 4000):  # the keys at the edges have 300 contents
        got = {r.doc_id: (r.word_start, r.word_stop, r.first) for r in repeated_passages(corpus(spark, texts), config=Config(hot=hot)).collect()}
        assert got == {i: (30, 110, i == 0) for i in range(300)}
