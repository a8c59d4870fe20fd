"""Toxicity scoring: a learned lexicon, matched exactly and with misspellings, weighed by its context.

The lexicon is learned from labelled rows: words whose document frequency among toxic rows stands out. It is held as a trie; a
Levenshtein automaton of each unknown word walks it, so a term of five letters or more within one edit (a swap of neighbours is
one) is found without comparing the word with every term, unless the word is itself a plain one in clean training rows. Stems (terms with a
star at the end) stand for words that share a beginning, each too rare to be learned by itself. A hit counts as quoted if quotation or reporting marks stand in the words around it. A logistic model
of hit counts and densities, fitted on the same rows, gives the score.

Labels are read from training rows only; labels, lang, source and doc_id are never inputs of a score. Null and empty texts have
no hits and get the model's score for that. Repeated rows are scored alike. Without a toxic training row the lexicon is empty
and every score is the base rate.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

SAMPLE = 30_000  #: most labelled rows used for fitting, the smallest by hash of doc_id
STEMS = range(5, 9)  #: letters of a stem
WINDOW = 6  #: words on each side that tell quotation from abuse
WORD = re.compile(r"[^\W_]+")
# fixed values: marks of quotation and report in the four languages
QUOTES = set("\"'«»„“”‚‘’")
REPORT = {"said", "says", "wrote", "quote", "quoted", "called", "word", "term", "dijo", "dice", "escribió", "palabra", "dit", "écrit", "mot", "cité", "sagte", "schrieb", "wort", "zitat"}
MEMORY = 200_000  #: words a worker remembers
FEATURES = 9


class Trie:
    """Nested dicts; the key '' holds a term's number."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for i, t in enumerate(terms):
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = i

    def near(self, word: str, edits: int) -> bool:
        """Whether a term lies within `edits` of word. The automaton's states (characters read, edits left) are simulated on the
        trie's paths; once no edit is left only one path remains, so an unrelated word is done after a few steps."""
        n, stack = len(word), [(self.root, 0, edits)]
        while stack:
            node, i, left = stack.pop()
            if not left:
                while node is not None and i < n:
                    node = node.get(word[i])
                    i += 1
                if node is not None and "" in node:
                    return True
                continue
            if i == n:
                if "" in node:
                    return True
            else:
                if (same := node.get(word[i])) is not None:
                    stack.append((same, i + 1, left))
                if i + 1 < n and (next_ := node.get(word[i + 1])) is not None and (swapped := next_.get(word[i])) is not None:
                    stack.append((swapped, i + 2, left - 1))
                stack.append((node, i + 1, left - 1))
            for c, child in node.items():
                if c:
                    stack.append((child, i, left - 1))
                    if i < n and c != word[i]:
                        stack.append((child, i + 1, left - 1))
        return False


class Matcher:
    """Terms of five letters or more are also found within one edit: a letter more, less or other, or two neighbours swapped. A term
    that ends with a star is a stem, found in every word that begins with it."""

    def __init__(self, terms: list[str], plain: list[str] | tuple[str, ...] = ()):
        """plain: words that are no misspellings, though they are within one edit."""
        self.stems = {t[:-1] for t in terms if t.endswith("*")}
        self.stem_sizes = sorted(set(map(len, self.stems)))
        terms = [t for t in terms if not t.endswith("*")]
        long_ = [t for t in terms if len(t) >= 5]
        self.plain = set(plain)
        self.exact, self.trie, self.seen = set(terms), Trie(long_), {}
        # one edit leaves a term's first half at a word's start or its second half at the end; a swap across the halves leaves
        # all but a letter of each
        self.starts, self.ends = {t[: len(t) // 2] for t in long_} | {t[: len(t) // 2 - 1] for t in long_}, {t[len(t) // 2 :] for t in long_}
        self.start_sizes, self.end_sizes = sorted(set(map(len, self.starts))), sorted(set(map(len, self.ends)))
        self.longest = max(map(len, long_), default=0)

    def kind(self, word: str) -> int:
        """2: a term; 3: a word with a stem; 1: a misspelled term; 0: none of them."""
        if (k := self.seen.get(word)) is None:
            k = 2 if word in self.exact else 3 if any(word[:n] in self.stems for n in self.stem_sizes) else 1 if 4 <= len(word) <= self.longest + 1 and word not in self.plain and self.worth(word) and self.trie.near(word, 1) else 0
            if len(self.seen) >= MEMORY:
                self.seen.clear()
            if len(word) < 100:
                self.seen[word] = k
        return k

    def worth(self, word: str) -> bool:
        return any(word[:n] in self.starts for n in self.start_sizes) or any(word[-n:] in self.ends for n in self.end_sizes)

    def features(self, text: str | None) -> list[float]:
        """Counts and densities of exact, misspelled, quoted and stem hits."""
        text = (text or "").lower()
        get, kind = self.seen.get, self.kind
        words = WORD.findall(text)
        hits = [(i, k) for i, w in enumerate(words) if (k := get(w) if w in self.seen else kind(w))]
        counts = [0.0, 0.0, 0.0, 0.0]
        if hits:
            places = [m.span() for m in WORD.finditer(text)]
            for i, k in hits:
                a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
                before, after = text[places[a][0] : places[i][0]], text[places[i][1] : places[b - 1][1]]
                quoted = bool(QUOTES & set(before[-3:]) and QUOTES & set(after[:3])) or any(w in REPORT for w in words[a:i])
                counts[2 if quoted else (3, 1, 0, 3)[k]] += 1
        n = max(len(words), 1)
        return [np.log1p(counts[0]), np.log1p(counts[1]), np.log1p(counts[2]), min(1.0, 20 * counts[0] / n), min(1.0, 20 * counts[1] / n), float(counts[0] > 0), float(counts[1] > 0), np.log1p(counts[3]), min(1.0, 20 * counts[3] / n)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the last one the intercept, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of at most `limit` labelled rows: those with the smallest hash of doc_id among the allowed ones."""
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `limit` pairs of numbers
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))  # one text for each doc_id


def learn_stems(rows: DataFrame, each: DataFrame, nt: float, nc: float) -> list[str]:
    """Stems: beginnings of at least 3 words of toxic rows, none of which makes up half of their occurrences (rows of each word, added
    up); at least 6 of these occurrences, in 3 toxic rows or more, and 8 times as many a row as among the others. each: (w, t, c),
    rows of a word among the toxic and the other ones; rows: (w) of each toxic row, with a number `row`."""
    stem = F.explode(F.array(*[F.when(F.length("w") >= n, F.left("w", F.lit(n))) for n in STEMS])).alias("stem")
    found = each.select("t", "c", stem).filter("stem is not null").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if(F.col("t") > 0).alias("words"), F.max("t").alias("top"))
    found = found.filter("words >= 3 and t >= 6 and 2 * top < t").filter(F.col("t") / nt >= 8 * (F.col("c") + 0.5) / max(nc, 1)).select("stem")
    held = rows.select("row", stem).filter("stem is not null").distinct().groupBy("stem").agg(F.count("*").alias("n")).filter("n >= 3")
    return sorted(r["stem"] for r in held.join(found, "stem").select("stem").collect())  # beginnings of the training rows' words


def standing_out(t, c, nt: float, nc: float):
    """Log-likelihood ratio of t toxic and c other rows against the share of toxic rows; without other rows everything stands out."""
    if not nc:
        return F.lit(math.inf)
    base, n = nt / (nt + nc), t + c
    part = lambda x, share: F.when(x > 0, x * F.log(x / (n * share))).otherwise(0.0)
    return 2 * (part(t, base) + part(c, 1 - base))


def learn_lexicon(rows: DataFrame) -> tuple[list[str], list[str]]:
    """(terms, plain words). Terms: words in at least 3 toxic rows and 0.4 % of them, whose rate there is 8 times that among others
    and stands out more than chance lets any of the words in 3 rows do, the clearest first: no more than 250 times the mean number of
    distinct words of a toxic row; then stems, with a star. Words with
    a stem aren't terms of their own. Plain words: words within one edit of a term that at least 2 other rows hold, at a rate not below
    that among toxic rows."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))
    each = rows.select("y", F.explode(words).alias("w")).groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).cache()
    total = rows.agg(F.sum("y").alias("nt"), F.sum(1 - F.col("y")).alias("nc")).first()
    if not total[0]:
        each.unpersist()
        return [], []
    toxic, clean = F.col("t") / total[0], F.col("c") / max(total[1], 1)
    tried = each.filter("t + c >= 3").count()
    clear = standing_out(F.col("t"), F.col("c"), *total) >= 2 * math.log(max(tried, 1))
    kept = each.filter("t >= 3").filter(clear).filter((toxic >= 0.004) & (toxic >= 8 * (F.col("c") + 0.5) / max(total[1], 1))).orderBy(F.desc("t"), "w")
    stems = learn_stems(rows.filter("y > 0").select(F.col("doc_id").alias("row"), F.explode(words).alias("w")), each, total[0], total[1])
    begun = Matcher([f"{s}*" for s in stems])
    terms = [r["w"] for r in kept.collect() if not begun.kind(r["w"])] + [f"{s}*" for s in stems]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            yield batch.filter(pa.array([matcher.kind(w.as_py()) == 1 for w in batch.column(0)], pa.bool_()))

    plain = [r["w"] for r in each.filter(clean >= toxic).filter("c >= 2").select("w").mapInArrow(near, "w string").collect()]  # words of the training rows
    each.unpersist()
    return terms, plain


def model(docs: DataFrame, labels: DataFrame, allowed, limit: int = SAMPLE) -> tuple[list[str], list[str], list[float]]:
    """(terms, plain words, weights), learnt from at most `limit` rows."""
    rows = training_rows(docs, labels, "toxic", allowed, limit).cache()
    terms, plain = learn_lexicon(rows)
    made = rows.mapInArrow(_featurizer(terms, plain), "y double, x array<double>").collect()  # at most `limit` short rows
    rows.unpersist()
    if not made:
        return terms, plain, [0.0] * (FEATURES + 1)
    return terms, plain, [float(w) for w in fit_logistic(np.array([r["x"] for r in made]), np.array([r["y"] for r in made]))]


def _featurizer(terms: list[str], plain: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, plain)
        for batch in batches:
            x = [matcher.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    return run


_matchers: dict[int, Matcher] = {}


def score(docs: DataFrame, fitted: tuple[list[str], list[str], list[float]], text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, exact, misspelled, quoted): score from 0 to 1; the counts are log1p of hits."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # words of the training rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, plain, w = shared.value
        w = np.array(w)
        k = hash((*terms, "", *plain))
        if k not in _matchers:
            _matchers.clear()
            _matchers[k] = Matcher(terms, plain)
        for batch in batches:
            x = np.array([_matchers[k].features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(w) - 1)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2])], [key, "score", "exact", "misspelled", "quoted"])

    return docs.select(key, text_col).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, score double, exact double, misspelled double, quoted double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = model(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, fitted).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
