"""The pipeline's stages against their operators and on awkward tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quillstone.llm import language_id, secret_scan
from quillstone.llm.bpe import Encoder, tokenizer
from quillstone.llm.queries import TOKENIZER
from quillstone.llm.simhash_dedup import Config, fingerprints, near_duplicates
from quillstone.llm.suffix_dedup import repeated_passages
from tests.llm.test_dedup import brute_groups, brute_windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["start"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_stay(staged):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "suffix_dedup", "secret_scan", "packing"]
    for n in names[:-1]:
        assert staged[n].dtypes == staged["start"].dtypes


def test_each_decision_takes_effect(spark, staged):
    start = staged["start"]
    verdict = language_id.identify(start, language_id.fit(start))
    assert ids(staged["language_id"]) == ids(verdict.filter("NOT rejected"))
    groups = near_duplicates(staged["language_id"])
    assert ids(staged["near_dedup"]) == ids(staged["language_id"]) - ids(groups.filter("NOT kept"))
    assert staged["near_dedup"].count() == staged["language_id"].count() - groups.filter("NOT kept").count()
    assert near_duplicates(staged["near_dedup"]).count() == 0
    assert repeated_passages(staged["suffix_dedup"]).filter("NOT first").count() == 0
    assert secret_scan.secret_scan(staged["secret_scan"], ["doc_id"]).findings.count() == 0
    assert staged["secret_scan"].count() == staged["suffix_dedup"].count()


def test_packed_text_is_whole(staged):
    own = Encoder(tokenizer(TOKENIZER))
    parts = {}
    for w in staged["packing"].collect():
        row = np.frombuffer(w.ids, "<u2")
        for k, (doc, start) in enumerate(zip(w.doc_ids, w.starts, strict=True)):
            parts[doc, start] = row[w.cu_seqlens[k] : w.cu_seqlens[k + 1]]
    texts = {}
    for doc, start in sorted(parts):
        texts[doc] = np.r_[texts.get(doc, np.zeros(0, np.int64)), parts[doc, start].astype(np.int64)]
    got = {d: own.decode(x[:-1], np.array([0, len(x) - 1]))[0].tobytes().decode() for d, x in texts.items()}
    assert got == {r.doc_id: r.text for r in staged["secret_scan"].collect() if r.text}


def test_run_is_the_stages(spark, staged):
    key = lambda df: sorted((r.shard, r.window, bytes(r.ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(staged["packing"])


def test_near_duplicates_are_judged_by_id_and_text(spark):
    rng = random.Random(2)
    texts = {k: " ".join(f"{k}{rng.randint(0, 999)}" for _ in range(300)) for k in "abcde"}
    near = texts["a"].rsplit(" ", 1)[0] + " changed"
    rows = [(0, texts["a"], "x"), (1, near, "x"), (1, texts["b"], "x"), (7, texts["c"], "y"), (7, texts["c"], "x"), (None, texts["d"], "x"), (None, texts["d"], "x"), (None, texts["e"], "x"), (8, None, "x"), (8, None, "x"), (9, "", "x"), (9, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    left = [(str(r.doc_id), r.text) for r in out.collect()]
    assert sorted(map(str, left)) == sorted(map(str, [("0", texts["a"]), ("1", texts["b"]), ("7", texts["c"]), ("None", texts["d"]), ("None", texts["e"]), ("8", None), ("8", None), ("9", ""), ("9", "")]))


def _plain_languages(docs, model):
    """Nearest centroid with n-grams counted one by one in a dictionary."""
    fold = lambda b: b if b >= 128 or chr(b).isalpha() else 32
    m32, kept = 0xFFFFFFFF, []
    for d in docs:
        x = [fold(b) for b in (d["text"] or "").lower().encode()]
        x = [b for i, b in enumerate(x) if b != 32 or not i or x[i - 1] != 32]
        tf = np.zeros(model.config.dims)
        for n in (1, 2, 3):
            for i in range(len(x) - n + 1):
                h = n * 0x9E3779B1 & m32
                for b in x[i : i + n]:
                    h = (h ^ b) * 0x01000193 & m32
                h ^= h >> 15
                h = h * 0x85EBCA6B & m32
                tf[(h ^ h >> 13) % model.config.dims] += 1
        letters = sum(b != 32 for b in x)
        v = np.log1p(tf) * model.idf
        best = max((float(c @ v) for c in model.centroids), default=0) / max(float(np.linalg.norm(v)), 1e-9)
        size = max(k for k in range(14) if k == 0 or letters >= 2**k) if letters else 0
        if letters and best >= model.floor[size] - 1e-6:
            kept.append(d)
    return kept


def _plain_near(docs):
    """All pairs by Hamming distance, then one document of each component."""
    fps, size = fingerprints(pa.array([d["text"] for d in docs], pa.string()))
    some = [i for i in range(len(docs)) if size[i]]
    _, groups = brute_groups(some, np.ascontiguousarray(fps[some]), Config().radius)
    gone = {i for g in groups for i in sorted(g, key=lambda i: docs[i]["doc_id"])[1:]}
    return [d for i, d in enumerate(docs) if i not in gone]


def _plain_cut(docs):
    every, own = brute_windows([(d["doc_id"], d["text"]) for d in docs if d["text"]], 50)
    out = []
    for d in docs:
        key = d["doc_id"], d["text"]
        cut = every.get(key, set()) - own.get(key, set())
        if cut:
            words = [(m.start(), m.end()) for m in re.finditer(r"[^\t-\r\x1c-\x20]+", d["text"])]
            ends = [a for a, _ in words[1:]] + [len(d["text"])]
            text = d["text"][: words[0][0]] + "".join(d["text"][a:e] for k, ((a, _), e) in enumerate(zip(words, ends, strict=True)) if k not in cut)
            if not text.strip():
                continue
            d = d | {"text": text, "n_chars": len(text)}
        out.append(d)
    return out


def _plain_redact(docs):
    out = []
    for d in docs:
        spans = sorted((m.start(), m.end(), r.rule_id) for r in secret_scan.RULES for m in re.finditer(r.pattern, d["text"] or ""))
        if spans:
            text, at = "", 0
            for a, b, rule in spans:
                if a >= at:
                    text += d["text"][at:a] + f"[{rule}]"
                at = max(at, b)
            text += d["text"][at:]
            d = d | {"text": text, "n_chars": len(text)}
        out.append(d)
    return out


def test_every_stage_is_its_plain_version(spark, staged):
    """Each stage's rows from those of the one before, by code that shares no step with the operators but the hashes and the fitted model."""
    rows = {n: sorted((r.asDict() for r in staged[n].collect()), key=lambda d: d["doc_id"]) for n in ("start", "language_id", "near_dedup", "suffix_dedup", "secret_scan")}
    assert rows["language_id"] == _plain_languages(rows["start"], language_id.fit(staged["start"]))
    assert rows["near_dedup"] == _plain_near(rows["language_id"])
    assert rows["suffix_dedup"] == _plain_cut(rows["near_dedup"])
    assert rows["secret_scan"] == _plain_redact(rows["suffix_dedup"])
    # packing: window by window, the pieces that remain fill it as far as any of their sums does
    shards = {}
    for w in staged["packing"].collect():
        shards.setdefault(w.shard, []).append(w)
    for windows in shards.values():
        left = [b - a for w in windows for a, b in zip(w.cu_seqlens, w.cu_seqlens[1:], strict=False)]
        for w in sorted(windows, key=lambda w: w.window):
            sums = 1
            for n in left:
                sums |= sums << n & (1 << 2049) - 1
            mine = [b - a for a, b in zip(w.cu_seqlens, w.cu_seqlens[1:], strict=False)]
            assert sum(mine) == w.used == sums.bit_length() - 1
            for n in mine:
                left.remove(n)


@pytest.mark.parametrize("rows", [0, 1])
def test_awkward_tables(spark, rows):
    long = "some words " * 20_000
    data = [(1, "plain text of some words", None, None, None, "x", 1, "t"), (1, "plain text of some words", None, None, None, "x", 1, "t"), (2, None, "en", "s", 1, None, None, None), (None, long, "en", "s", 1, "y", 2, "t"), (3, "", "en", "s", 0, "z", 3, "t"), (4, long, "en", None, 1, "y", 2, "t")] * rows
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, _gone string, key int, TEXT string")  # the last name differs by case alone
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= rows
