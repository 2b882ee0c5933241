"""Secret scans: base spans against re, and the battery on random and ordinary strings of every encoding and length."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ruleweave.llm import queries, secret_scan

ASSIGN = re.compile(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
SYLLABLES = ("get", "User", "list", "page", "index", "Main", "data", "file", "name", "2024", "v1", "test", "item", "the", "A", "x9")


def base_spans(text):
    found = [("assign", 0, m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", 1, m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", 2, m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for k, _, (s, e) in sorted(found, key=lambda x: (x[2][0], x[1]))]


def test_base_spans_equal_re(spark, tmp_path):
    rng = random.Random(2)
    atoms = ["token", "API_KEY", "apikey", "Secret", "passwd", "password", "=", ":", " ", "  ", '"', "'", "abc", "hunter22", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "\n", "...", "-", "ſ", "KEY", "😀", "x" * 30]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None, "", "token=" + "a1" * 50_000, "token=abc " * 2000]
    rows = [(k, t, "c", 1) for k, t in enumerate(texts)] + [(None, "token=abcdef", "c", 1), (3, texts[3], "c", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, base string, n_hex int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op4_secret_scans(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    known = {d: base_spans(t or "") for d, t, _, _ in rows}
    for r in out:
        want = known[r.doc_id]
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if x and not x.startswith("random")) == said


def ordinary(rng, kind, n):
    """Strings that people write, in the characters of an encoding."""
    if kind == "hex_lower":
        return (rng.choice("0123456789abcdef") * 6 + "%09d" % rng.randint(0, 10**9) + "abcdef0123456789abcdef" * 4)[:n]
    if kind in ("hex_upper", "base32"):
        return ("FACE" + "%02d" % rng.randint(22, 77) + "DEADBEEFCAFEBABEFEEDFACE" * 4)[:n]
    joint = {"alphanumeric": "", "base64": "/", "base64url": "-", "mixed": "-/_"}[kind]
    return ((rng.choice(joint) if joint else "").join(rng.choice(SYLLABLES) for _ in range(60)) + "1a")[:n] if kind != "mixed" else ("a/b-c_1" + "/".join(rng.choice(SYLLABLES) for _ in range(60)))[:n]


@pytest.mark.parametrize("n", [24, 32, 48, 80])
def test_random_strings_are_found_and_ordinary_ones_left(spark, n):
    rng = random.Random(n)
    rows, truth = [], {}
    for kind, pattern, alphabet in secret_scan.ENCODINGS:
        for _ in range(150):
            for real in (True, False):
                x = "".join(rng.choice(alphabet) for _ in range(n)) if real else ordinary(rng, kind, n)
                if re.search("[0-9]", x) and re.search("[A-Za-z]", x) and not re.fullmatch("[0-9a-f]{24,}", x):
                    truth[len(rows)] = real
                    rows.append((len(rows), f"see {x} end"))
    out = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size("added").alias("n")).collect()
    found = {True: [0, 0], False: [0, 0]}
    for r in out:
        found[truth[r.doc_id]][0] += r.n > 0
        found[truth[r.doc_id]][1] += 1
    recall, false = found[True][0] / found[True][1], found[False][0] / sum(x[0] for x in found.values())
    print(f"length {n}: recall {recall:.2f}, ordinary among the reported {false:.3f}")
    assert recall > (0.3 if n < 32 else 0.8) and false < 0.15


def test_copies_count_once_and_single_strings_are_judged(spark):
    token = "9F86D081884C7D659A2FEAA0C55AD015"
    docs = spark.createDataFrame([(k, f"id {token} x") for k in range(10)] + [(99, "id " + "AB12" * 8)], "doc_id long, text string")
    out = {r.doc_id: r.n for r in secret_scan.scan(docs).select("doc_id", F.size("added").alias("n")).collect()}
    assert [out[k] for k in range(10)] == [1] * 10 and out[99] == 0


def test_thresholds_step_up():
    uniform = [1] * 1000
    assert secret_scan.step_up(uniform, 0.1, 0.01) == 0.01
    piled = [1000] * 100 + [1] * 900
    assert 0.09 < secret_scan.step_up(piled, 0.1, 0.01) <= 0.1
    assert secret_scan.step_up([50] + [0] * 999, 0.1, 0.01) is None


def test_any_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.scan(empty).count() == 0
