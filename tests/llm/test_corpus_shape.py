"""Source divergence, conversation trie and source mixing against brute force, on tables with edge rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, divergence, embedding, mixing, queries, suffix, trie

DOCS = "doc_id long, text string, lang string, source string, value string, p long"


@pytest.fixture(scope="module")
def docs(spark):
    """A source with half of the rows, nulls, empty and long texts, repeated rows and ids, columns named like those made."""
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in "ab Éç漢".split() + ["x", "Yy"] for b in ("one", "TWO", "drei")]
    rows = []
    for i in range(240):
        k = 0 if i % 2 else int(rng.integers(1, 7))
        text = " \t".join(rng.choice(words[: 4 + 2 * k], int(rng.integers(1, 40))))
        rows.append((i, text + f", {i}!", "en" if i % 3 else "fr", f"s{k}", "x", 1))
    rows += [(None, None, None, None, None, None), (None, "", "en", None, "", 2), (7, rows[7][1], "en", "s0", "x", 1), (300, "only here " * 30_000, "de", "", "x", 1), (301, "12 34 !!", "it", "s1", "x", 1)]
    rows += [(9, "same row every time", "en", "s9", "x", 1)] * 40
    return spark.createDataFrame(rows, DOCS)


def brute_divergence(rows, min_docs, top):
    count, held = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        terms = [t.encode().lower().decode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r.text or "")]
        count[r.lang or "", r.source or ""].update(terms)
        held[r.lang or ""].update(set(terms))
    out = []
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        groups = {s: {t: c[t] for t in kept} for (g, s), c in count.items() if g == lang}
        share = lambda c: {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole = share({t: sum(c[t] for c in groups.values()) for t in kept})
        p = {s: share(c) for s, c in groups.items()}
        for s in groups:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            term = [(t, f(p[s][t], whole[t])) for t in kept if groups[s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", pair), ("term", term)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[: None if part == "pair" else top]
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, docs, small, monkeypatch):
    if small:  # many ranges of paths, batches that cut runs, counters handed on often, texts in slices, no broadcast
        for k, v in {"ROWS_A_RANGE": 5, "PAIRS_HELD": 3, "HELD": 10, "SLICE": 20, "SENT_GROUPS": 0}.items():
            monkeypatch.setattr(divergence, k, v)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = divergence.audit(docs, 3, 4)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == brute_divergence(docs.collect(), 3, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_shares_paths():
    """Terms with the same counts are one path, and each pair of nodes is valued once for all of them."""
    import pyarrow as pa

    items = pa.array([[{"no": 1, "p": 50, "absent": 2}, {"no": 2, "p": 9, "absent": 3}], [{"no": 1, "p": 50, "absent": 2}, {"no": 3, "p": 20, "absent": 1}]])
    batch = pa.record_batch([pa.array(["en", "en"]), items, pa.array([1000, 7])], names=["lang", "items", "n"])
    f = lambda p, q: (p - q) ** 2 // (p + q)
    want = {(1, 2): 1000 * (f(50, 9) - f(50, 3) - f(2, 9) + f(2, 3)), (1, 3): 7 * (f(50, 20) - f(50, 1) - f(2, 20) + f(2, 1))}
    (out,) = divergence.both_have(iter([batch]))
    assert {(r["a"], r["b"]): r["value"] for r in out.to_pylist()} == want


def brute_trie(seqs):
    """seqs: conv_id -> [(role, text)]"""
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    out = []
    for k, members in nodes.items():
        under = [u for u in nodes if u[: len(k)] == k]
        leaves = [u for u in under if not any(len(v) == len(u) + 1 and v[: len(u)] == u for v in under)]
        saved = sum((len(nodes[u]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", u[-1][1])) for u in under if u)
        ended = ",".join(str(c) for c in sorted(members) if len(seqs[c]) == len(k))
        kids = sum(len(u) == len(k) + 1 for u in under)
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids, len(leaves), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def conversations(spark):
    rng = np.random.default_rng(12)
    texts = ["", "one", "two words", "three short words", " \t padded  out ", "long " * 5_000]
    rows = []
    for c in range(-3, 150):
        kind = c % 5
        turns = [(t, ("user", "assistant", "system")[t % 3], texts[int(rng.integers(0, 2 if kind < 3 else 6))]) for t in range(int(rng.integers(1, 9)))]
        turns = [(t, "user", "copy") for t in range(4)] if kind == 4 else turns
        rows += [(c, t, r, x, "extra") for t, r, x in turns]
    rows += [(500, t, "user", f"turn {t}", "") for t in range(300)] + [(501, t, "user", f"turn {t}", "") for t in range(299)]  # 500 begins 501, but for its head
    rows += [(600, None, None, None, None), (600, 0, "user", "b", None), (600, 0, "user", "a", None), (600, 0, "user", "a", None), (None, 0, "user", "nobody's", None), *((c, 0, "user", "alone", None) for c in range(701, 709))]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string")


def sequences(rows, head=True):
    own = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            role, text = r.role or "", r.text or ""
            own[r.conv_id].append(((r.turn is not None, r.turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 if head else 0 for c in own}
    base = lambda c: c - int(np.fmod(c, 20))  # noqa: E731  as SQL's %
    return {c: own.get(base(c), [])[: h[c]] + t[h[c] :] for c, t in own.items()}


@pytest.mark.parametrize("size", [trie.TURNS_A_RANGE, 40, 9])
def test_trie(spark, conversations, size, monkeypatch, tmp_path):
    """Ranges of 9 turns: nodes that span many ranges, and sequences longer than a range."""
    monkeypatch.setattr(trie, "TURNS_A_RANGE", size)
    monkeypatch.setattr(trie, "SENT_OPEN", 0 if size == 9 else trie.SENT_OPEN)
    conversations.write.parquet(f"{tmp_path}/conversations.parquet")
    want = sequences(conversations.collect())
    assert any(not s for s in want.values())
    got = trie.op12_trie(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(want)
    assert trie.trie(trie.turns_of(conversations.limit(0))).count() == 0


def test_trie_of_copies(spark, monkeypatch):
    """A third of all conversations are one sequence, and one more is its beginning."""
    monkeypatch.setattr(trie, "TURNS_A_RANGE", 30)
    rows = [(c, t, "user", f"t{t}" if c % 3 == 0 else f"t{min(t, c % 7)} {c if t > 2 else ''}") for c in range(90) for t in range(5 if c else 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = trie.trie(trie.turns_of(df))
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(sequences(df.collect(), head=False))


def brute_targets(sizes, share, weights, most):
    key = lambda s: (s is None, s or "")
    w = {s: weights[k % len(weights)] for k, s in enumerate(sorted(sizes, key=key))}
    stopped, budget = set(), share * sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in stopped]
        left = budget - sum(most * sizes[s] for s in stopped)
        target = {s: Fraction(left * w[s], sum(w[x] for x in free)) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return {**target, **{s: Fraction(most * sizes[s]) for s in stopped}}
        stopped |= set(over)


@pytest.mark.parametrize("small", [False, True])
def test_mixing(spark, docs, small, monkeypatch):
    if small:
        monkeypatch.setattr(mixing, "SENT_SOURCES", 0)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows, sizes = docs.collect(), Counter()
    for r in rows:
        sizes[r.source] += count(r.text)
    nested = []
    for share in (Fraction(1, 2), Fraction(3, 2), Fraction(9, 5)):
        got = mixing.mix(docs, share).collect()
        assert len(got) == len(rows) and got[0].__fields__ == [*docs.columns, "size", "source_size", "target", "taken"]
        target, taken, largest = brute_targets(sizes, share, (3, 1, 2), 2), Counter(), Counter()
        for r in got:
            assert r.size == count(r.text) and r.source_size == sizes[r.source] and r.target == pytest.approx(float(target[r.source]), rel=1e-12)
            assert r.taken in (0, r.size, 2 * r.size)
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r.size)
        for s in sizes:
            assert abs(taken[s] - target[s]) <= max(largest[s] / 2, 1e-6)
        assert taken["s9"] == pytest.approx(target["s9"], abs=2)  # of rows that are all alike some are in
        nested.append(Counter((r.doc_id, r.text, r.taken // r.size) for r in got if r.size))
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3), share).collect()))
    copies = [{k[:2]: sum(x[2] * n for x, n in c.items() if x[:2] == k[:2]) for k in c} for c in nested]
    assert all(copies[0][k] <= copies[1][k] <= copies[2][k] for k in copies[0])
    assert mixing.mix(docs.limit(0)).count() == 0
    empty = mixing.mix(docs.filter("text is null or text = ''")).collect()
    assert len(empty) == 2 and all(r.target == 0 and r.taken == 0 for r in empty)


def test_mixing_is_native(spark, docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert docs.select(F.max("doc_id")).first()[0] == 301


def test_links_of_embeddings_that_share_a_vec_id(spark):
    """Each row has the links and the component of its own embedding; components are named by their smallest vec_id."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (0, [0.02, 1.0]), (9, [-1.0, 0.0]), (9, [-1.0, 0.0]), (9, None)]
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(1, 1, 1, True), (1, 2, 0, False), (2, 1, 1, False), (3, 2, 0, False), (0, 2, 0, True), (9, 0, 9, True), (9, 0, 9, True), (9, 0, 9, True)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_repeats_of_a_row_cost_no_more_than_rows(spark):
    """What is collected for a text doesn't grow with how often its row is repeated."""
    passage = " ".join(f"shared{i}" for i in range(400))
    rows = [(1, passage + " first"), *[(2, "head " + passage + " tail")] * 60, (3, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = suffix.repeated(df).collect()
    assert len(got) == 62 and {(r.doc_id, bytes(r.kept)) for r in got if r.doc_id == 2} == {(2, b"head tail")}
    texts = df.withColumn("dups", F.lit(None).cast("array<binary>"))
    for wide, entries in ((True, suffix.all_chunks(50)), (False, suffix.own_anchors(50))):
        lists = suffix.meet_by_hash(texts.select("doc_id", "text", F.lit(0), "dups"), entries, wide, not wide, 4).collect()
        size = {r.doc_id: sum(len(x) for x in r.hashes) for r in lists}
        assert size[2] <= len(passage) * 8


def test_tokens_in_one_step(spark, docs):
    spec = queries.vocabulary()
    both = bpe.encode_and_check(docs.drop("p"), spec).collect()
    apart = bpe.decode(bpe.encode(docs, spec), spec).collect()
    assert both[0].__fields__ == ["doc_id", "lang", "source", "value", "ids", "decoded_sha256"]
    assert sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in both if r.doc_id is not None) == sorted((r.doc_id, list(r.ids), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in apart if r.doc_id is not None)
    assert len(both) == len(apart) == docs.count()


def test_embeddings_with_few_pivots(spark):
    """A cap on pivots that bites: lists grow longer, and links are still found."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(4000, 48))
    x[3000:] = x[0] + 0.3 * x[3000:]  # a dense group
    z = x[:500] / np.linalg.norm(x[:500], axis=1, keepdims=True)
    y = rng.normal(size=z.shape)
    y -= (y * z).sum(1, keepdims=True) * z
    x[500:1000] = 0.902 * z + np.sqrt(1 - 0.902**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in embedding.near_duplicates(df, most_pivots=24).collect()}
    assert all(found[i] <= n for i, n in enumerate(links))
    assert sum(found[i] for i in range(1000)) >= 0.99 * links[:1000].sum() and sum(found.values()) >= 0.99 * links.sum()
    with pytest.raises(ValueError, match="16 bits"):
        embedding.near_duplicates(df, most_pivots=40_000)
