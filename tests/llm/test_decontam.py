"""Decontamination against a search of all alignments, without hashes."""

import math
import random

import pytest

from ruleweave.llm import decontam


def plain(text):
    return [w for w in (x.strip(decontam.MARKS).lower() for x in (text or "").replace("\x0b", " ").replace("\x0c", " ").split()) if w]


def leaked(doc, item, min_share=0.6, window=13, min_window=10):
    """The most matches of an alignment that a mask hits and that counts, or None."""
    n, best = len(item), None
    if n < decontam.LEAST:
        return n if n and doc == item else None
    for first in range(1 - n, len(doc)):
        same = [0 <= first + k < len(doc) and doc[first + k] == item[k] for k in range(n)]
        hit = any(all(same[k + j] for j, c in enumerate(mask) if c == "1") for mask in decontam.MASKS for k in range(n - len(mask) + 1) if first + k >= 0 and first + k + len(mask) <= len(doc))
        counts = sum(same) >= math.ceil(min_share * n) or (n >= window and max(sum(same[k : k + window]) for k in range(n - window + 1)) >= min_window)
        if hit and counts and (best is None or sum(same) > best):
            best = sum(same)
    return best


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    words = [f"t{k}" for k in range(40)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    items = [some(n) for n in (1, 3, 4, 5, 6, 8, 9, 13, 20, 30, 30, 60, 60)]
    docs = [some(rng.choice([0, 1, 2, 6, 30, 120])) for _ in range(60)] + [list(x) for x in items[:3]]
    for _ in range(200):
        item = rng.choice(items)
        a = rng.randrange(len(item))
        part = item[a : rng.randint(a + 1, len(item))] if rng.random() < 0.5 else item
        part = [rng.choice(words) if rng.random() < rng.choice([0, 0.1, 0.25, 0.4]) else w for w in part]
        docs.append(some(rng.randint(0, 10)) + part + some(rng.randint(0, 10)))
    texts = [" ".join(w.upper() + "," if rng.random() < 0.2 else w for w in d) for d in docs]
    rows = [(k, t, k % 7, "x") for k, t in enumerate(texts)]
    rows += [(None, texts[70], 1, "x"), (None, None, 2, "y"), (900, "", 3, "y"), (901, "... !!", 3, "y"), rows[70], (902, "deep " * 30_000 + " ".join(items[9]), 4, "z")]
    bench = [(k, " ".join(x)) for k, x in enumerate(items)] + [(None, " ".join(items[9])), (3, " ".join(items[3])), (50, None), (51, ""), (52, "?!"), (10, " ".join(items[11]))]
    return spark.createDataFrame(rows, "doc_id long, text string, item int, n_matched string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")


def test_leaks_are_all_and_only_what_every_alignment_shows(spark, tables):
    docs, bench = tables
    want, items = {}, [(b.item_id, plain(b.text)) for b in bench.collect()]
    for d in docs.collect():
        if d.doc_id != 902:
            for b, item in items:
                got = leaked(plain(d.text), item)
                if got is not None:
                    want[d.doc_id, b] = max(got, want.get((d.doc_id, b), 0))
    rows = decontam.leaks(docs, bench).collect()
    found = {(r.doc_id, r.item_id): r.n_matched for r in rows if r.doc_id != 902}
    assert found == want
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows}) and len(want) > 80
    assert {r.item_id for r in rows if r.doc_id == 902} >= {9, None}
    clean = decontam.decontaminate(docs, bench)
    every = docs.collect()
    bad = {r.text for r in every if r.doc_id is not None and (r.doc_id == 902 or any(d == r.doc_id for d, _ in want))}
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in every if r.text not in bad)


def test_any_kind_of_id_and_empty_tables(spark, tables):
    docs, bench = tables
    named = bench.selectExpr("concat('item ', item_id) as item_id", "text")
    assert decontam.leaks(docs.selectExpr("cast(doc_id as decimal(20,0)) as doc_id", "text"), named).count() == decontam.leaks(docs, bench).count()
    none, empty = bench.limit(0), docs.limit(0)
    assert decontam.leaks(docs, none).count() == 0 and decontam.leaks(empty, bench).count() == 0
    assert decontam.decontaminate(docs, none).count() == docs.count() and decontam.decontaminate(empty, bench).count() == 0
