"""Toxicity by weak supervision.

Voters are a fixed lexicon, words and word beginnings that the labels of the training rows show to be precise, and patterns
over their hits; each votes toxic or harmless or abstains. A generative label model with one hidden class learns by
expectation-maximisation how often each voter casts each vote in each class, finds voters that agree beyond what the classes
explain and shares their weight, and gives each training text a posterior. Labels choose the voters and give their rates a
prior worth ``belief`` rows; no label votes on its row. A logistic classifier over word and voter features is fitted to the
posteriors and scores all documents.

Training uses at most ``max_train`` labelled rows outside the held-out fold (least hash of the id first). Cases: a null or empty text is scored by the bias and the
voter of harmless texts; null ids are scored and never train; labels with a null id or label are ignored; without
training rows the fixed lexicon alone votes; repeated rows and ties give one output row for each input row; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import held_out, settle
from ruleweave.llm.textbatch import Words, parts

MARKS = " \t\n\r\x0b\x0c!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¡¿0123456789"
LEXICON = (
    "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "imbecile", "scum", "loser", "losers", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "vermin", "filth", "dumbass",
    "dummkopf", "abschaum", "ekelhaft", "widerlich", "connard", "ordure", "pathétique", "imbécile", "estúpido", "estúpida", "imbécil", "asqueroso", "escoria",
)
ADDRESS = ("you", "your", "you're", "u", "du", "ihr", "sie", "tu", "vous", "tú", "usted", "eres")
PATTERNS = ("several_terms", "dense", "addressed", "repeated", "no_hit")
#: A term is a word, or ``^`` and the first letters of one; a term's levels are: once, twice, one word in a hundred.
STEMS = (4, 5, 6, 7)
LEVELS = 3


def _terms(word: str) -> list[str]:
    return [word, *["^" + word[:k] for k in STEMS if len(word) > k]] if word else []


def _normal(words: Words) -> list[str]:
    return [w.strip(MARKS).lower() for w in words.vocabulary.to_pylist()]


def _spread(words: Words, of_code: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(word position, id) for each word of the batch and each of its code's ids."""
    many = np.array([len(x) for x in of_code] or [0])
    flat = np.array([y for x in of_code for y in x], dtype=np.int64)
    first = np.cumsum(many) - many
    place = np.flatnonzero(many[words.codes] > 0) if len(words.codes) else np.zeros(0, np.int64)
    n = many[words.codes[place]] if len(place) else np.zeros(0, np.int64)
    start = np.repeat(first[words.codes[place]], n) if len(place) else np.zeros(0, np.int64)
    return np.repeat(place, n), flat[start + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if len(place) else flat[:0]


def _levels(row: np.ndarray, term: np.ndarray, terms: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, level) for every level that a term reaches in a row of ``n`` words."""
    key, times = np.unique(row * max(1, terms) + term, return_counts=True)
    r, t = key // max(1, terms), key % max(1, terms)
    reached = [np.ones(len(r), bool), times >= 2, 100 * times >= n[r]]
    return tuple(np.concatenate(x) for x in zip(*[(r[ok], t[ok], np.full(int(ok.sum()), k)) for k, ok in enumerate(reached)], strict=True))


class Measure:
    """Binary features of batches of texts: each term at each level, then PATTERNS over the first ``lexicon`` terms."""

    def __init__(self, terms: list[str], lexicon: int):
        self.terms, self.lexicon = {w: k for k, w in enumerate(terms)}, lexicon
        self.address = set(ADDRESS)
        self.width = LEVELS * len(terms) + len(PATTERNS)

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of all features that are 1."""
        words = Words(texts)
        rows, n, at = len(words.starts) - 1, words.counts(), words.rows()
        normal = _normal(words)
        place, term = _spread(words, [[self.terms[t] for t in _terms(w) if t in self.terms] for w in normal])
        row, which, level = _levels(at[place], term, len(self.terms), n)
        lexical = place[term < self.lexicon]
        hits = np.bincount(at[lexical], minlength=rows)
        kinds = np.bincount(row[(which < self.lexicon) & (level == 0)], minlength=rows)
        you = np.array([w in self.address for w in normal] or [False])
        said = you[words.codes] if len(words.codes) else np.zeros(0, bool)
        addressed = np.zeros(rows, bool)
        for back in (1, 2, 3):
            p = lexical[lexical >= back]
            p = p[(at[p - back] == at[p]) & said[p - back]]
            addressed[at[p]] = True
        flags = [kinds >= 2, (hits > 0) & (100 * hits >= n), addressed, hits > kinds, hits == 0]
        first = LEVELS * len(self.terms)
        row = np.concatenate([row, *[np.flatnonzero(f) for f in flags]])
        feature = np.concatenate([which * LEVELS + level, *[np.full(int(f.sum()), first + k) for k, f in enumerate(flags)]])
        return row, feature


def label_model(votes: np.ndarray, prior: float, believed: list[np.ndarray] | None = None, belief: float = 50, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 for rows of ``votes`` (1, 0 harmless, -1 abstains), and each voter's weight.

    ``believed`` are prior rates of each vote (-1, 0, 1) by class and voter, worth ``belief`` rows of each class.

    Voters are independent given the class but for found correlations: a voter's weight is the inverse of the number of
    voters whose votes, less what the classes explain, correlate with its own above 0.2.
    """
    n, m = votes.shape
    weight = np.ones(m)
    cast = [(votes == v).astype(np.float32) for v in (-1, 0, 1)]
    if believed is None:
        believed = [np.full((2, m), 1 / 3)] * 3
    score, accuses = (votes == 1).sum(1) - (votes == 0).sum(1), (votes == 1).sum(0) >= (votes == 0).sum(0)
    post = np.clip(np.where(score > 0, 0.9, np.where(score < 0, 0.05, prior)), 0.01, 0.99)
    for turn in range(2):
        for _ in range(steps):
            total = np.array([1 - post, post], np.float32)
            rates = [(total @ c + 0.5 + belief * b) / (total.sum(1, keepdims=True) + 1.5 + belief) for c, b in zip(cast, believed, strict=True)]
            # A voter that would speak against its own vote says nothing, lest the hidden class turn into another one.
            wrong = np.where(accuses, rates[2][1] < rates[2][0], rates[1][0] < rates[1][1])
            for r in rates:
                r[:, wrong] = r[:, wrong].mean(0)
            logit = np.log(prior / (1 - prior)) + sum(c @ (weight * (np.log(r[1]) - np.log(r[0]))) for c, r in zip(cast, rates, strict=True))
            new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            done = np.abs(new - post).max() < 1e-4
            post = new
            if done:
                break
        if turn == 0 and n > 10:
            fired = cast[2] - cast[1]
            expected = np.outer(1 - post, rates[2][0] - rates[1][0]) + np.outer(post, rates[2][1] - rates[1][1])
            rest = fired - expected
            rest -= rest.mean(0)
            scale = np.sqrt((rest**2).sum(0)) + 1e-6
            correlated = np.abs((rest.T @ rest) / np.outer(scale, scale)) > 0.2
            weight = 1.0 / np.maximum(1, correlated.sum(1))
    return post, weight


def fit_linear(rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int], target: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic weights and bias for binary features given as (row, column) pairs and soft targets."""
    n, m = shape
    w, b = np.zeros(m), 0.0
    moment, second = np.zeros(m + 1), np.zeros(m + 1)
    for k in range(1, steps + 1):
        z = b + np.bincount(rows, w[columns], n)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / max(1, n)
        g = np.append(np.bincount(columns, d[rows], m) + decay * w, d.sum())
        moment, second = 0.9 * moment + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = rate * (moment / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8) / np.sqrt(k)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _term_counts(sample: DataFrame) -> DataFrame:
    """Texts of each label in which a term reaches a level: (term, level, n0, n1)."""

    def run(batches):
        for batch in parts(batches, rows=1000):
            words = Words(batch.column(0))
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids: dict[str, int] = {}
            place, term = _spread(words, [[ids.setdefault(t, len(ids)) for t in _terms(w)] for w in _normal(words)])
            row, which, level = _levels(words.rows()[place], term, len(ids), words.counts())
            key = which * LEVELS + level
            n = np.bincount(key, minlength=len(ids) * LEVELS)
            n1 = np.bincount(key, label[row] if len(row) else None, len(ids) * LEVELS).astype(np.int64)
            seen = np.flatnonzero(n)
            names = pa.array(list(ids), pa.string()).take(pa.array(seen // LEVELS))
            yield pa.RecordBatch.from_arrays([names, pa.array((seen % LEVELS).astype(np.int32)), pa.array((n - n1)[seen]), pa.array(n1[seen])], ["term", "level", "n0", "n1"])

    return sample.select("text", "label").mapInArrow(run, "term string, level int, n0 long, n1 long").groupBy("term", "level").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


class ToxicModel:
    def __init__(self, terms: list[str], lexicon: int, weights: np.ndarray, bias: float):
        self.terms, self.lexicon, self.weights, self.bias = terms, lexicon, weights, bias

    def scorer(self):
        measure = Measure(self.terms, self.lexicon)

        def score(texts) -> np.ndarray:
            row, feature = measure(texts)
            return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(row, self.weights[feature], len(texts)), -30, 30)))

        return score


def _chosen(rows: list, most: int, taken: list[str]) -> list[str]:
    """Terms of ``rows`` in order, without those that stand in the same texts as a shorter form already chosen."""
    seen, out = set(), []
    for r in rows:
        kind = (r["n0"], r["n1"], r["term"].lstrip("^")[: STEMS[0]])
        if r["term"] not in taken and r["term"] not in out and kind not in seen and len(out) < most:
            seen.add(kind)
            out.append(r["term"])
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id", max_train: int = 20_000, induced: int = 96, words: int = 320, precision: float = 0.9, least: int = 5, belief: float = 50) -> ToxicModel:
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    chosen = known.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "label").limit(max_train)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = settle(texts.join(F.broadcast(chosen), "id").select("id", "text", "label"))
    ones, total = sample.agg(F.sum("label"), F.count("*")).first()
    ones, total = ones or 0, total or 0
    prior = min(0.9, max(0.01, (ones + 1) / (total + 10)))
    counts = settle(_term_counts(sample).where("n0 + n1 >= 5"))
    share0, share1 = (F.col("n0") + 0.5) / (total - ones + 1), (F.col("n1") + 0.5) / (ones + 1)
    precise = counts.where((F.col("n1") >= least) & (F.col("n1") >= precision * (F.col("n0") + F.col("n1"))) & (share1 >= 8 * share0))
    lexicon = list(LEXICON)
    voters = precise.orderBy(F.col("n1").desc(), "n0", F.length("term"), "term", "level").limit(8 * induced).collect()
    lexicon += _chosen(voters, induced, lexicon)
    # What separates the labels best, by the signed square root of the likelihood ratio's main term.
    spread = counts.orderBy((F.abs(share1 - share0) / F.sqrt(share1 + share0)).desc(), F.length("term"), "term", "level").limit(8 * words).collect()
    terms = lexicon + _chosen(spread, words, lexicon)
    level_of = {}
    for r in voters:
        level_of.setdefault(r["term"], r["level"])

    def run(batches):
        measure = Measure(terms, len(lexicon))
        for batch in parts(batches):
            row, feature = measure(batch.column(0))
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature[order], pa.int32())), batch.column(1)], ["f", "label"])

    got = sample.orderBy("id", "label").select("text", "label").mapInArrow(run, "f array<int>, label int").limit(max_train).collect()
    n, m = len(got), LEVELS * len(terms) + len(PATTERNS)
    if n == 0:
        weights = np.zeros(m)
        weights[: LEVELS * len(lexicon) : LEVELS] = 6.0
        return ToxicModel(terms, len(lexicon), weights, -3.0)
    rows = np.repeat(np.arange(n), [len(r["f"]) for r in got]).astype(np.int64)
    features = np.array([c for r in got for c in r["f"]], dtype=np.int64)
    voter_of = np.full(m, -1)
    for k, term in enumerate(lexicon):
        voter_of[LEVELS * k + level_of.get(term, 0)] = k
    voter_of[m - len(PATTERNS) :] = len(lexicon) + np.arange(len(PATTERNS))
    votes = np.full((n, len(lexicon) + len(PATTERNS)), -1, np.int8)
    casts = voter_of[features] >= 0
    votes[rows[casts], voter_of[features[casts]]] = 1
    votes[:, -1] = np.where(votes[:, -1] == 1, 0, -1)  # no_hit votes harmless
    # The labels say how often each voter casts each vote, as a prior worth a few rows; no label is a vote on its own row.
    label = np.array([r["label"] for r in got])
    believed = [np.stack([((votes == v)[label == y].sum(0) + 0.5) / ((label == y).sum() + 1.5) for y in (0, 1)]) for v in (-1, 0, 1)]
    post, _ = label_model(votes, prior, believed, belief)
    return ToxicModel(terms, len(lexicon), *fit_linear(rows, features, (n, m), post))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher: toxic likelier), predicted (score >= threshold)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, **options))

    def run(batches):
        score = model.value.scorer()
        for batch in parts(batches, 1, size=4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
