"""Small brute-force versions, and nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleweave.llm import line_dedup, packing, parity_join, quality, rule_ledger, token_count, toxicity
from ruleweave.llm.queries import vocabulary

WORDS = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "stone", "river", "Übung", "naïve", "x"]
SCHEMA = "doc_id long, text string, source string, n_chars long, n_words long, id long, failed string, base string"


def texts(seed=1):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(rng.choice([3, 6, 20, 60, 200]))) for _ in range(60)]
    out = list(base)
    for b in base[:25]:
        words = b.split()
        for _ in range(rng.randint(1, 3)):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    family = [f"w{k}" for k in range(80)]
    for k in range(40):
        w = list(family)
        w[k] = "edit"
        out.append(" ".join(w))
    return [*out, None, "", "   \n\t ", "one", "Line\nLine\nother\nLine", "long " * 5000, 'token = "abcdef0123456789abcdef0123456789" <|endoftext|> x']


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k % 9 == 0 else f"src{k % 2}", 5, 7, 9, "f", "b") for k, t in enumerate(texts())]
    rows += [(None, "a null id", "src0", 1, 1, 1, "f", "b"), rows[0], rows[0]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_near_duplicates_equal_brute_force(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    low = {k: k + 32 for k in range(65, 91)}
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    component = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low_, high = sorted((component[a], component[b]))
                component = {d: low_ if c == high else c for d, c in component.items()}
    out = parity_join.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == {d: (len(sets[d]), component[d]) for d in sets}
    assert parity_join.near_duplicates(empty).count() == 0


def test_family_chunks_lose_no_link():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 150 - 5 * k], rng.integers(0, 1 << 63, 5 * k).astype(np.uint64)])) for k in rng.integers(0, 8, 60)]
    bands = parity_join.Bands(75, 300)
    ids = np.arange(60)

    def groups(pairs):
        root = list(range(60))
        for a, b in pairs:
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if x in (ra, rb) else x for x in root]
        return root

    every = [(a, b) for a in range(60) for b in range(a) if parity_join.linked(sets[a], sets[b], 75)]
    assert groups(parity_join.spanning_links(ids, sets, np.zeros(60), bands)) == groups(every)
    side = ids % 2
    parts = [parity_join.spanning_links(ids, sets, side, bands)] + [parity_join.spanning_links(ids[side == k], [sets[i] for i in ids[side == k]], side[side == k], bands) for k in (0, 1)]
    assert groups([p for x in parts for p in x]) == groups(every)


def test_linked_sets_send_several_keys_in_common():
    rng = np.random.default_rng(1)
    frequent = np.sort(rng.integers(0, 1 << 63, 40).astype(np.uint64))
    bands = parity_join.Bands(75, 3000)
    for n in [3, 4, 5, 7, 10, 16, 30, 60, 150, 700] * 30:
        a = np.unique(np.concatenate([frequent[: rng.integers(0, min(40, n))], rng.integers(0, 1 << 63, n).astype(np.uint64)]))[:n]
        gone, more = rng.integers(0, n // 7 + 1), rng.integers(0, n // 3 + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
        if not np.array_equal(a, b) and parity_join.linked(a, b, 75):
            assert len(np.intersect1d(*(parity_join.block_keys(x, frequent, bands) for x in (a, b)))) >= parity_join.AGREE


def test_a_common_phrase_makes_no_candidates(spark):
    rng = random.Random(2)
    rows = [" ".join([f"{rng.random():.9f}" for _ in range(60)] + [f"phrase{k % 30}"] * 5) for k in range(300)]
    rows.append(rows[0] + " more")
    docs = spark.createDataFrame([(t,) for t in rows], "text string")
    bands, none = parity_join.Bands(75, 70), spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    assert parity_join.candidates(docs, "text", 5, none, bands, 300 * 61).count() == 1


def test_token_counts_equal_the_library(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = [r.text or "" for r in docs.select("text").collect()]
    rows += ["ab" * 700 + "a" * 900, "it's WE'LL \u0085 \x1c 😀 ́a"]
    want = [len(e.ids) for e in tok.encode_batch(rows, add_special_tokens=False)]
    assert token_count.Counter(vocabulary("byte_bpe_50k.json")).count(rows) == want
    out = by_id(token_count.token_counts(docs, vocabulary("byte_bpe_50k.json")))
    assert out[0].n_tokens == len(tok.encode(texts()[0], add_special_tokens=False).ids)
    assert token_count.token_counts(empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    cut = packing.pieces(docs, path, 1, 256)
    rows = packing.pack(cut, 256).collect()
    want = defaultdict(int)
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for j, a in enumerate(range(0, len(ids), 256)):
            want[r.doc_id, j, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 256
    free = []  # best-fit decreasing, piece by piece
    for n in sorted((r.length for r in rows), reverse=True):
        fits = [x for x in free if x >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(256 - n)
    assert len(places) == len(free)
    assert packing.pack(packing.pieces(empty, path, 1, 256), 256).count() == 0


def test_rules(docs, empty):
    rows = rule_ledger.ledger(docs)
    out = by_id(rows)
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    for d, t in known.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = defaultdict(list)
        for k in range(len(w) - 2):
            seen[tuple(w[k : k + 3])].append(k)
        again = {k + j for v in seen.values() if len(v) > 1 for k in v for j in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (out[d].n_words, out[d].word_chars, out[d].n_repeat_words, out[d].n_dup_lines) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
    kept = rule_ledger.apply_policy(rows, rule_ledger.STRICT_POLICY)
    ablated = {r.rule: r for r in rule_ledger.ablations(rows, rule_ledger.STRICT_POLICY).collect()}
    without = rule_ledger.Policy("x", tuple(r.name for r in rule_ledger.RULES if r.name != "few_words"))
    assert ablated["few_words"].n_kept_without == rule_ledger.apply_policy(rows, without).where("kept").count()
    assert kept.count() == docs.count() and rule_ledger.ledger(empty).count() == 0


def test_line_dedup(spark, docs, empty):
    rows = [(k, f"Header\nbody {k}\nFooter", "h") for k in range(20)] + [(50, None, "h"), (51, "", None), (52, "Header\nFooter", "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = by_id(line_dedup.drop_boilerplate(d))
    assert out[3].text == "body 3" and out[3].n_dropped == 2 and out[50].text is None
    assert out[52].text == "Header\nFooter" and out[52].n_dropped == 0
    assert line_dedup.drop_boilerplate(docs).count() == docs.count() and line_dedup.drop_boilerplate(empty).count() == 0


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_classifiers_take_any_table(spark, docs, empty, score):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(60)] + [(None, 1, None)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    for labels in (none, some):
        rows = score(docs, labels).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert score(empty, none).count() == 0


def test_pipeline_keeps_the_columns_and_one_of_each_group(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, "/root/testdata/sf0.001")
    groups = parity_join.near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == groups.select("component_id").distinct().count()
    assert corpus_pipeline.line_dedup_stage(spark, docs, "").count() == docs.count()


def test_stages_take_any_table(spark, docs, empty, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (7, None)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a null id"), (2, None), (3, texts()[30])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    clash = {c: F.lit(c) for c in ("n_dropped", "N_lines", "component_id", "item", "length", "gone", "n", "score", "cls", "_own")}
    odd = docs.withColumns(clash)
    known = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        rows = out.collect()
        assert out.columns == odd.columns and rows and all(r[c] == c for r in rows for c in clash)
        assert {r.doc_id for r in rows} <= set(known)
        if name == "ngram_jaccard_join":
            assert [r.doc_id for r in rows].count(0) == 1 and [r.doc_id for r in rows].count(None) == 1
        if name == "benchmark_decontamination":
            assert {d for d, t in known.items() if t == texts()[30]}.isdisjoint(r.doc_id for r in rows)
        assert stage(spark, empty, folder).count() == 0
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, odd, folder).where("piece = 0").count() == docs.count() and pack(spark, empty, folder).count() == 0


def test_pipeline_drops_a_line_on_a_tenth_of_a_large_host(spark):
    import corpus_pipeline

    rows = [(k, ("Header\n" if k % 10 == 0 else "") + ("Usual\n" if k % 25 == 0 else "") + f"body {k}", "h") for k in range(1000)]
    out = by_id(corpus_pipeline.line_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), ""))
    assert {k: r.text for k, r in out.items()} == {k: t.replace("Header\n", "") for k, t, _ in rows}


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(5, a), (5, b), (3, a), (7, b), (None, c), (None, c), (None, a), (None, d), (9, d + " more"), (11, ""), (12, ""), (13, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(3, a), (5, b), (None, c), (9, d + " more"), (11, ""), (12, ""), (13, None)]
    assert sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr) == sorted(want, key=repr)


def test_line_dedup_ties_repeats_and_clashing_names(spark):
    rows = [(k, ("Tie\n" if k < 1 else "") + ("Over\n" if k < 9 else "") + f"body {k}", "h", 7, "x") for k in range(128)] + [(900 + k, "Tie\nkept", "h2", 7, "x") for k in range(3)] + [(5, None, "h", 7, "x"), (0, "Tie\nOver\nbody 0", "h", 7, "x")]
    rows += [(300 + k, ("Eight\n" if k < 8 else "") + f"page {k}", None, 7, "x") for k in range(128)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, N_lines int, n_Dropped string")
    out = line_dedup.drop_boilerplate(d)
    assert out.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(d, t and t.replace("Over\n", "")) for d, t, *_ in rows], key=repr)


def test_components_of_hubs_and_chains(spark):
    from ruleweave.operators.graph import components

    edges = [(1, k) for k in range(2, 500)] + [(k, k + 1) for k in range(1000, 1300)] + [(499, 5000), (7, 7), (None, 3), (5000, 1)] + [(k, 9000) for k in range(8000, 8200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    want = {k: 1 for k in [*range(1, 500), 5000]} | {k: 1000 for k in range(1000, 1301)} | {k: 8000 for k in [*range(8000, 8200), 9000]}
    assert got == want


def test_the_pipeline_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    sf, folder = "/root/testdata/sf0.001", str(tmp_path / "run")
    stages = list(corpus_pipeline.STAGES)

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*stages[:2], ("broken", broken), *stages[3:]])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, sf, folder)
    assert sorted(x.name for x in (tmp_path / "run").iterdir()) == ["1"]
    calls = []
    counted = [(name, lambda *a, f=f, name=name: (calls.append(name), f(*a))[1]) for name, f in stages]
    monkeypatch.setattr(corpus_pipeline, "STAGES", counted)
    rows = corpus_pipeline.run(spark, sf, folder).collect()
    assert calls == [name for name, _ in stages[2:]] and sorted(x.name for x in (tmp_path / "run").iterdir()) == ["4"]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    again = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in again)
