"""The classifiers' parts against plain versions, their held-out results, and texts that are odd or very long."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ruleweave.llm import decontam, packing, parity_join, quality, token_count, toxicity
from ruleweave.llm.additive_model import fit
from ruleweave.llm.queries import vocabulary
from ruleweave.llm.textbatch import parts


def odd_texts(seed, n=3000):
    atoms = ["a", "B", "İ", "ı", "ß", "Σ", "e\u0301", "\u0301", "\u0307", "\u0338", "<", "=", ">", "!", ".", "'s", "'", "'ll", "1", "²", "Ⅷ", "\x85", "\u2028", "\xa0", " ", "\n", "\t", "\x0b", "\x1c", "<|endoftext|>", "<|", "|>", "한", "\u1100", "\u1161", "々", "字", "😀", "\u200d", "\ufb1d", "ﬁ", "İ.", "SİLİVRİ.", "Merhaba", "...", "`", "٣", "#", "0", "The"]
    rng = random.Random(seed)
    return ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_tokens_of_odd_texts_equal_the_library():
    from tokenizers import Tokenizer

    texts = odd_texts(11)
    path = vocabulary("word_bpe_49k.json")
    ids, starts = packing.Encoder(path).encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == want
    path = vocabulary("byte_bpe_50k.json")
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_count.Counter(path).count(texts) == want


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        packing.Encoder(vocabulary("byte_bpe_50k.json"))


def test_remembered_words_are_forgotten_beyond_the_bound(monkeypatch):
    texts = [" ".join(f"w{k}x{j}" for j in range(50)) for k in range(40)]
    want = packing.Encoder(vocabulary("word_bpe_49k.json")).encode(pa.array(texts))
    monkeypatch.setattr(packing, "CACHED", 2000)
    encoder = packing.Encoder(vocabulary("word_bpe_49k.json"))
    got = [encoder.encode(pa.array([t]))[0] for t in texts]
    assert np.concatenate(got).tolist() == want[0].tolist()


def test_parts_cut_by_rows_and_bytes():
    rng = random.Random(2)
    texts = [None if rng.random() < 0.1 else "x" * rng.choice([0, 1, 50, 400]) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], ["id", "text"])
    got = list(parts([batch.slice(0, 120), batch.slice(120), batch.slice(0, 0)], 1, rows=9, size=700))
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(200))
    sizes = [[len(t or "") for t in b.column(1).to_pylist()] for b in got]
    assert all(1 <= len(s) <= 9 and (sum(s) <= 700 or len(s) == 1) for s in sizes)


def test_features_equal_plain_counts():
    texts = ["Ab1! ab ab\nx.y $ é", "", None, "same same same\nsame same", "A" * 70_000 + "\n\n", "one"] + odd_texts(3, 50)
    rows = quality.features(pa.array(texts))
    names = quality.FEATURES
    for t, row in zip(texts, rows, strict=True):
        raw, words = (t or "").encode(), re.findall(r"[^\x20\x09-\x0D]+", t or "")
        pairs = list(zip(words, words[1:]))
        want = {
            "log_bytes": math.log1p(len(raw)), "log_words": math.log1p(len(words)), "upper": sum(65 <= b <= 90 for b in raw) / max(1, len(raw)), "digits": sum(48 <= b <= 57 for b in raw) / max(1, len(raw)),
            "symbols": sum(b in b"#*$%&|<>" for b in raw) / max(1, len(words)), "bangs": raw.count(b"!") / max(1, len(words)), "newlines": raw.count(b"\n") / max(1, len(words)), "non_ascii": sum(b > 127 for b in raw) / max(1, len(raw)),
            "distinct_words": len(set(words)) / max(1, len(words)), "top_word": max((words.count(w) for w in set(words)), default=0) / max(1, len(words)), "next_equal": sum(a == b for a, b in pairs) / max(1, len(words)),
            "pairs_again": (len(pairs) - len(set(pairs))) / max(1, len(words)), "line_bytes": len(raw) / (raw.count(b"\n") + 1),
        }
        for name, value in want.items():
            assert row[names.index(name)] == pytest.approx(value), (name, t)


def test_additive_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = fit(x, y)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        bins = [int((e <= v).sum()) for e, v in zip(model.edges, row, strict=True)]
        total = model.bias + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        total += sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for i, j, t in model.pairs)
        assert score == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((model.score(x) > 0.5) == y).mean() > 0.9  # only a pair of features tells the classes apart
    assert set(fit(x, np.zeros(800)).score(x).round(6)) == {fit(x, np.zeros(800)).score(x).round(6)[0]}


def test_label_model_estimates_voters_and_their_copies():
    rng = np.random.default_rng(3)
    truth = (rng.random(6000) < 0.2).astype(int)
    rates = [(0.6, 0.02), (0.5, 0.05), (0.7, 0.1), (0.4, 0.01), (0.5, 0.03)]
    votes = np.stack([np.where(rng.random(6000) < np.where(truth == 1, hit, miss), 1, -1) for hit, miss in rates], 1).astype(np.int8)
    post, weight = toxicity.label_model(votes, 0.2, belief=0)
    # Bayes' rule with the rates known.
    odds = np.full(6000, 0.25)
    for k, (hit, miss) in enumerate(rates):
        odds *= np.where(votes[:, k] == 1, hit / miss, (1 - hit) / (1 - miss))
    exact = odds / (1 + odds)
    assert np.abs(post - exact).mean() < 0.03 and ((post > 0.5) == (exact > 0.5)).mean() > 0.97 and weight.min() == 1
    _, weight = toxicity.label_model(np.concatenate([votes, votes[:, :1], votes[:, :1]], 1), 0.2, belief=0)
    assert weight[0] == weight[5] == weight[6] <= 0.34


def test_measured_terms_equal_plain_counts():
    terms = ["bad", "^gru", "worse"]
    texts = ["You bad, BAD thing", "grumpy grubby " + "x " * 20, "nothing here", "worse bad gruel", None, "", "bad " + "x " * 300]
    row, feature = toxicity.Measure(terms, 2)(pa.array(texts))
    got = {(int(a), int(b)) for a, b in zip(row, feature, strict=True)}
    want, first = set(), toxicity.LEVELS * len(terms)
    for i, t in enumerate(texts):
        words = [w.strip(toxicity.MARKS).lower() for w in (t or "").split()]
        times = [sum(w == "bad" for w in words), sum(w.startswith("gru") and len(w) > 4 for w in words if "^gru" in toxicity._terms(w)), words.count("worse")]
        for k, n in enumerate(times):
            want |= {(i, 3 * k + level) for level, ok in enumerate((n >= 1, n >= 2, n and 100 * n >= len(words))) if ok}
        hits, kinds = times[0] + times[1], (times[0] > 0) + (times[1] > 0)
        spoken = any(w == "bad" and set(words[max(0, k - 3) : k]) & set(toxicity.ADDRESS) for k, w in enumerate(words))
        want |= {(i, first + k) for k, ok in enumerate((kinds >= 2, hits and 100 * hits >= len(words), spoken, hits > kinds, hits == 0)) if ok}
    assert got == want


def test_held_out_results(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.98
    assert all(r.predicted == 1 for r in got if r.quality == 1)
    got = toxicity.toxicity_scores(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted for r in got if r.toxic == 1) >= 0.6 * sum(r.toxic for r in got) and not any(r.predicted for r in got if r.toxic == 0)


def test_very_long_texts_are_read_whole(spark):
    rng = random.Random(6)
    words = [f"word{k}" for k in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(120_000))
    item = " ".join(rng.choice(words) for _ in range(40))
    changed = long[:-9]
    rows = [(1, long + " " + item), (2, long + " " + item), (3, changed), (4, "short"), (5, "x" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 6)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.leaks(docs, bench).collect()) == [1, 2]
    assert {r.doc_id: r.component_id for r in parity_join.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert quality.quality_scores(docs, labels).count() == toxicity.toxicity_scores(docs, labels).count() == 5
    cut = packing.pieces(docs, vocabulary("word_bpe_49k.json"), 1, 4096).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("piece").alias("last")).collect()
    assert {r.doc_id: r.last for r in cut}[4] == 0 and {r.doc_id: r.n for r in cut}[1] == {r.doc_id: r.n for r in cut}[2] > 240_000
    assert token_count.token_counts(docs, vocabulary("byte_bpe_50k.json")).where("n_tokens > 1024").count() == 4
