"""Token automaton against a public encoder; packing against plain versions."""

import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm.bpe import Encoder, bpe_decode, bpe_encode, compile_merges, encode_words, tokenizer
from quillstone.llm.queries import TOKENIZER
from quillstone.llm.slack_pack import fullest, minimum_slack, pack_min_slack
from quillstone.llm.textkit import buffers
from quillstone.llm.token_pack import best_fit_decreasing, pack_best_fit, write_matrices
from quillstone.llm.token_windows import Config

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    with open(TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return Encoder(tokenizer(TOKENIZER))


def encode(own, texts):
    data, off = buffers(pa.array(texts, pa.string()))
    ids, ends = own.encode(data, off)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


TRICKY = ["", " ", "  \n\n x", "don't we'll I'VE 's", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "é ü 漢字かな 🎉🎉 ٣٤", "<|endoftext|>", "x" * 5000, "  a 　", "12345 1.5e10 ___--- \t\tif", "'", "a' 's", "’s don’t"]


def test_same_ids(own, reference):
    assert encode(own, TRICKY) == [reference.encode_ordinary(t) for t in TRICKY]


def test_same_ids_on_documents(spark, own, reference):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert encode(own, texts) == [reference.encode_ordinary(t) if t else [] for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdeé '\n0漢s"), max_size=60), min_size=1, max_size=4))
def test_same_ids_on_random_texts(own, reference, texts):
    assert encode(own, texts) == [reference.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("most", [1, 40])
def test_same_ids_when_the_table_begins_anew(reference, most):
    small = Encoder(tokenizer(TOKENIZER), most)
    for _ in range(2):
        assert encode(small, TRICKY) == [reference.encode_ordinary(t) for t in TRICKY]


def test_full_table_keeps_what_is_asked_for_most():
    """Words that recur need no second compilation when the table fills up; results stay."""
    rng = random.Random(4)
    e, whole = Encoder(tokenizer(TOKENIZER), 4000), Encoder(tokenizer(TOKENIZER))
    usual = " ".join("the quick brown fox jumps over a lazy dog and then it sleeps".split() * 5)
    kept, keep = [], e.table.keep
    e.table.keep = lambda: (keep(), kept.append(len(e.table.body)))
    for _ in range(12):
        text = usual + " " + " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(150))
        data = np.frombuffer(text.encode(), np.uint8)
        off = np.array([0, len(data)])
        assert e.encode(data, off)[0].tolist() == whole.encode(data, off)[0].tolist()
    assert kept and all(1 < n <= 3000 for n in kept)  # it was full, and something stayed
    e.table.keep()
    made, compile_ = [], e.table.compile
    e.table.compile = lambda *key: (made.append(key), compile_(*key))[1]
    data = np.frombuffer(usual.encode(), np.uint8)
    e.encode(data, np.array([0, len(data)]))
    assert not made


def plain_merging(word, labels, merges):
    """The definition: of all merges that apply, the first, leftmost, again and again."""
    rank = {(u, v): (k, w) for k, (u, v, w) in enumerate(merges)}
    ids = [labels.index(bytes([b])) for b in word]
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        if not found:
            return ids
        (_, w), i = min(found)
        ids[i : i + 2] = [w]


@pytest.mark.parametrize("seed", range(25))
def test_small_vocabularies_against_plain_merging(seed):
    rng = random.Random(seed)
    labels, merges = [b"a", b"b", b"c"], []
    while len(merges) < 14:  # merges as training would make them: each of two tokens that stand side by side
        text = [rng.choice(b"abc") for _ in range(40)]
        ids = plain_merging(bytes(text), labels, merges)
        i = rng.randrange(len(ids) - 1) if len(ids) > 1 else 0
        if len(ids) > 1 and labels[ids[i]] + labels[ids[i + 1]] not in labels:
            labels.append(labels[ids[i]] + labels[ids[i + 1]])
            merges.append((ids[i], ids[i + 1], len(labels) - 1))
    own = Encoder(compile_merges(labels, merges))
    for _ in range(150):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30)))
        data = np.frombuffer(word, np.uint8)
        ids, _ = encode_words(own.table, data, np.array([0]), np.array([len(data)]))
        assert ids.tolist() == plain_merging(word, labels, merges)


def test_shards_split_without_moving_others(spark):
    config = Config(capacity=64, shard_docs=16)
    shards = {}
    for n in (60, 70, 200):
        df = spark.createDataFrame([(i, f"text {i} " * 5) for i in range(n)], "doc_id long, text string")
        shards[n] = {d: r.shard for r in pack_min_slack(df, TOKENIZER, config=config).collect() for d in r.doc_ids}
    count = {n: 1 << max(0, -(-n // 16) - 1).bit_length() for n in shards}
    for n, m in ((60, 70), (70, 200)):
        assert all(shards[m][d] % count[n] == shards[n][d] for d in shards[n])


def test_round_trip_table(spark):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x"), (4, "long " * 50_000)]
    df = spark.createDataFrame([(*r, "extra", 0) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    out = bpe_encode(df, TOKENIZER)
    assert out.columns == ["doc_id", "ids", "n_tokens", "round_trip"]
    assert out.filter("round_trip").count() == 5 and out.filter("ids IS NULL AND n_tokens IS NULL").count() == 1
    assert sorted(map(str, map(tuple, bpe_decode(out, TOKENIZER).collect()))) == sorted(map(str, rows))
    assert bpe_encode(df.limit(0), TOKENIZER).count() == 0


def test_decoding_awkward_ids(spark):
    ids = spark.createDataFrame([(1, [50_000_000]), (2, None)], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe_decode(ids, TOKENIZER).collect()
    half = tokenizer(TOKENIZER).labels.index(b"\xc3")
    broken = spark.createDataFrame([(1, [half]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, bpe_decode(broken, TOKENIZER).collect())) == [(1, "\ufffd"), (2, None), (3, "")]


def naive_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("plan", [best_fit_decreasing, minimum_slack])
@pytest.mark.parametrize("seed", range(4))
def test_plans_place_all(plan, seed):
    rng = np.random.default_rng(seed)
    length = rng.integers(1, 101, 300)
    window, at = plan(length, 100)
    for w in range(window.max() + 1):
        mine = np.flatnonzero(window == w)
        order = mine[np.argsort(at[mine])]
        assert at[order].tolist() == np.r_[0, np.cumsum(length[order])[:-1]].tolist() and length[order].sum() <= 100
    if plan is best_fit_decreasing:
        assert sorted(100 - np.bincount(window, weights=length).astype(int)) == naive_best_fit(length.tolist(), 100)
    else:
        left = length.tolist()
        for w in range(window.max() + 1):  # each window is as full as what remained allows
            sums = 1
            for n in left:
                sums |= sums << n & (1 << 101) - 1
            mine = length[window == w].tolist()
            assert sum(mine) == sums.bit_length() - 1
            for n in mine:
                left.remove(n)


def test_fullest_is_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 30), 4), reverse=True)
        counts = [rng.randint(1, 3) for _ in lengths]
        cap = rng.randint(30, 60)
        taken = fullest(lengths, counts, cap)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= cap}
        assert sum(n * k for n, k in zip(lengths, taken, strict=False)) == max(sums)
        assert all(k <= c for k, c in zip(taken, counts, strict=False))


@pytest.mark.parametrize("pack", [pack_best_fit, pack_min_slack])
def test_nothing_is_lost(spark, own, pack):
    rows = [(i, f"document {i} " * (i * 7 % 40 + 1)) for i in range(60)] + [(70, "very long " * 3000), (71, None), (72, ""), (73, "twice"), (73, "twice"), (None, "no id")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, shard int, window string").repartition(5)
    config = Config(capacity=128, shard_docs=32, shard_tokens=4000)
    out = pack(df, TOKENIZER, config=config).collect()
    pieces, texts = {}, []
    for w in out:
        ids, pos = np.frombuffer(w.ids, "<u2"), np.frombuffer(w.positions, "<u2")
        assert len(ids) == len(pos) == 128 and w.used + w.slack == 128 and w.cu_seqlens[-1] == w.used
        assert (ids[w.used :] == config.pad).all()
        for k, (doc, start) in enumerate(zip(w.doc_ids, w.starts, strict=True)):
            a, b = w.cu_seqlens[k], w.cu_seqlens[k + 1]
            assert pos[a:b].tolist() == list(range(b - a))
            pieces.setdefault((doc, start), []).append(ids[a:b])
    for (doc, start), first in sorted(pieces.items(), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        if start == 0:
            for p in first:
                whole, at = [p], len(p)
                while (doc, at) in pieces:
                    whole.append(pieces[doc, at][0])
                    at += len(whole[-1])
                ids = np.concatenate(whole)
                assert ids[-1] == config.eos
                texts.append((doc, own.decode(ids[:-1].astype(np.int64), np.array([0, len(ids) - 1]))[0].tobytes().decode()))
    assert sorted(map(str, texts)) == sorted(str(r) for r in rows if r[1])
    assert pack(df.limit(0), TOKENIZER).count() == 0


def test_partitions_do_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    key = lambda d: sorted((r.shard, r.window, bytes(r.ids)) for r in d.collect())
    assert key(pack_min_slack(df, TOKENIZER)) == key(pack_min_slack(df.repartition(7), TOKENIZER))


def test_matrices(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i} " * 30) for i in range(20)], "doc_id long, text string")
    config = Config(capacity=64, shard_docs=5)
    packed = pack_best_fit(df, TOKENIZER, config=config)
    manifest = write_matrices(packed, str(tmp_path)).collect()
    assert sum(m.windows for m in manifest) == packed.count()
    for m in manifest:
        ids = np.fromfile(tmp_path / f"shard-{m.shard}.ids.bin", "<u2").reshape(m.windows, 64)
        rows = sorted(packed.filter(f"shard = {m.shard}").collect(), key=lambda r: r.window)
        assert [r.tobytes() for r in ids] == [bytes(r.ids) for r in rows]
