"""Operators against brute force on small tables with edge rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from tests.compare import same
from tidemark.llm import bpe, chat, decontaminate, embedding, minhash, quality, queries, sharding, suffix, toxicity, urlfilter
from tidemark.llm.common import components, join_with_hot_keys, materialize

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
DOCS = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(WORDS, 60)) + f" unique{i}" for i in range(6)]
    near = [b.replace("unique", "Unique", 1) + (" tail" if i % 2 else "") for i, b in enumerate(base)]
    texts = base + near + [base[0], base[0], None, "", "one two", "one two", "é" * 70, "x" + "é" * 70, "aaaa " * 50, "aaaa " * 40]
    rows = [(i, t, "s", "en") for i, t in enumerate(texts)] + [(3, base[3], "s", "en"), (None, base[1], None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7)], "a long, b long")
    assert {(r.node, r.component) for r in components(e).collect()} == {(5, 1), (4, 1), (3, 1), (1, 1), (9, 8), (8, 8)}


def test_join_with_hot_keys(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(500)] + [(99, 0)], "e long, v long")
    per = rows.filter("e < 50").groupBy("e").agg(F.count("*").alias("n"))
    hot = spark.createDataFrame([(1,), (2,)], "e long")
    want = sorted(map(tuple, rows.join(per, "e").select("e", "v", "n").collect()))
    assert sorted(map(tuple, join_with_hot_keys(rows, per, "e", hot).select("e", "v", "n").collect())) == want
    assert sorted(map(tuple, join_with_hot_keys(rows, per, "e", hot.limit(0)).select("e", "v", "n").collect())) == want


def test_minhash(spark, docs):
    def shingles(t, k=5):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    rows = [r for r in docs.collect() if r.doc_id is not None]
    group = {r.doc_id: r.doc_id for r in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                x, y = shingles(a.text), shingles(b.text)
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    group[a.doc_id] = group[b.doc_id] = min(group[a.doc_id], group[b.doc_id])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.component_id == (None if r.doc_id is None else group[r.doc_id])
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_minhash_texts_of_one_id(spark):
    rng = np.random.default_rng(8)
    a, b, c = (" ".join(rng.choice([f"w{i}" for i in range(300)], 80)) for _ in range(3))
    rows = [(3, a), (5, a + " end"), (5, b), (9, "start " + b), (7, c), (7, None), (8, c + " more"), (7, c)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    empty_row = (7, 7, True)  # a text without words
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False), (7, 7, True), empty_row, (8, 7, False), (7, 7, True)])


def brute_repeats(rows, n=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            first[b[k : k + n]] = min(first.get(b[k : k + n], i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < i:
                gone[k : k + n] = True
        out[i, t] = np.frombuffer(b, np.uint8)[~gone].tobytes()
    return out


@pytest.mark.parametrize("chunk", [suffix.CHUNK, 100])
def test_suffix(spark, docs, chunk, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    want = brute_repeats([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    got = suffix.repeated(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert bytes(r.kept) == (want[r.doc_id, r.text] if r.doc_id is not None else r.text.encode())
    assert suffix.without_repeats(docs).columns == docs.columns
    assert suffix.repeated(empty(spark)).count() == 0


def test_suffix_texts_of_one_id(spark):
    passage = "".join(map(str, range(100, 140)))
    rows = [(1, passage), (2, "a head " + passage + " a tail"), (2, "other words " * 3 + passage[:70]), (2, "clean" * 11)]
    want = brute_repeats(rows)
    got = suffix.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and all(bytes(r.kept) == want[r.doc_id, r.text] for r in got)


def test_suffix_anchor_of_many_snippets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = lambda k: "".join(map(chr, rng.integers(97, 123, k)))
    phrase, tails = words(49), [words(12) for _ in range(50)]
    rows = [(i, words(40) + phrase + (tails[i % 50] if i % 3 == 0 else words(40))) for i in range(12_000)]
    largest, apply = [], GroupedData.applyInArrow

    def counted(self, func, schema):
        if "snippet" in self._df.columns:
            largest.append(self._df.groupBy("bucket").count().agg(F.max("count")).first()[0])
        return apply(self, func, schema)

    monkeypatch.setattr(GroupedData, "applyInArrow", counted)
    want = brute_repeats(rows)
    got = suffix.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(bytes(r.kept) == want[r.doc_id, r.text] for r in got)
    assert sum(len(r.kept) < len(r.text) for r in got) > 3_000
    assert largest and (largest[0] or 0) <= 10_000


def test_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(30):
        s = rng.integers(97, 99, rng.integers(1, 200)).astype(np.uint8)
        o, b = suffix.suffix_order(s, 50), s.tobytes() + bytes(100)
        assert sorted(o) == list(range(len(s))) and all(b[i : i + 50] <= b[j : j + 50] for i, j in zip(o, o[1:], strict=False))


def test_bpe(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, spec = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), queries.vocabulary()
    rows = [(1, "Hello's WORLD  ümlaut Σίσυφος 123 <|endoftext|>x y 😀 á"), (2, None), (3, ""), (4, "zzzzqqqq " * 3000)]
    done = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), spec), spec).collect()
    for r in done:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert queries.bpe_report(empty(spark), spec).count() == 0


def test_bpe_code_points():
    """Every code point alone, and random ones together, as the library has them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t, mine = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), bpe.Encoder(queries.vocabulary())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(points[k : k + 2000]) for k in range(0, len(points), 2000)] + ["".join(points[k : k + 7]) for k in range(0, 0x3000, 7)]
    rng = np.random.default_rng(9)
    low, marks = rng.integers(0, 0x3000, (6000, 5)), [0x300, 0x327, 0x611, 0x1DFA, 0x7FD, 0x898, 0x3A3, 0x130]
    texts += ["".join(points[c] for c in row) + "a" + "".join(chr(c) for c in rng.choice(marks, 3)) for row in low]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [x for x, w in zip(texts, want, strict=True) if mine.encode(x) != w] == []


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "alpha beta"), (2, None), (None, "one two"), (3, "one, TWO"), (4, " ".join(WORDS))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(spark.createDataFrame([(1, "x one two y"), (2, None), (3, "Alpha-beta alpha beta"), (4, "clean")], "doc_id long, text string"), bench).collect()}
    assert (got[1].n_hit, got[1].n_items, got[3].n_hit, got[2].n_words, got[4].contaminated) == (2, 1, 4, 0, False)
    assert got[1].items_sha256 == hashlib.sha256(b"3").hexdigest()
    held = materialize(docs)
    want = Counter(map(str, decontaminate.marks(held, bench, 10, "text", 1000, ["doc_id"]).select("doc_id", "hits", "items").collect()))
    for hashes in (0, 1000):  # beyond the windows that the plan takes, and beyond the hashes that are broadcast
        assert Counter(map(str, decontaminate.marks(held, bench, 10, "text", 0, ["doc_id"], hashes).select("doc_id", "hits", "items").collect())) == want
    assert decontaminate.report(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_chat(spark):
    rows = [(1, 0, "us\ner", "a\\n<|im_end|>\\"), (1, 1, "assistant", "<|im_start|>é"), (1, 1, "assistant", None), (None, 0, None, "x")]
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("us\ner", "a\\n<|im_end|>\\"), ("assistant", ""), ("assistant", "<|im_start|>é")]
    assert back[1].loss == "<|im_start|>é" and back[None].turns[0].role == ""
    assert chat.fold(chat.parse("{% if 'a' == 'a' %}x{{ 'b' + 'c' | upper }}{% else %}y{% endif %}")) == ("block", [("write", ("const", "xbC"))])
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{{ x.__class__() }}")


def test_decontamination_removes_spans_or_documents(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = [(1, "say Alpha, beta gamma! now", "a", 7), (2, "alpha beta", "b", 7), (None, "alpha beta gamma", None, None), (3, None, "c", 1), (4, "", "d", 1), (1, "other", "e", 2)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, items string, hits int"))
    marked = decontaminate.decontaminate(docs.drop("hits"), bench)
    cut = {(r.doc_id, r.text) for r in decontaminate.without_spans(marked).collect()}
    assert cut == {(1, "say! now"), (2, "alpha beta"), (None, ""), (3, None), (4, ""), (1, "other")}
    assert sorted((str(r.doc_id), r.text) for r in decontaminate.without_documents(marked).collect()) == [("1", "other"), ("2", "alpha beta"), ("3", None), ("4", "")]
    assert decontaminate.without_documents(marked, 0.7).count() == 5
    assert decontaminate.report(docs, bench).count() == 6  # further columns whose names clash
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def test_sharding(spark, docs):
    a, b = sharding.initial_map(40), sharding.initial_map(41)
    assert all(x == y or y == 40 for x, y in zip(a, b, strict=True)) and max(Counter(a).values()) - min(Counter(a).values()) <= 3
    maps = sharding.map_table(spark, {40: a, 41: b})
    clash = docs.withColumns({"size": F.lit("x"), "shard": F.lit(1), "place": F.lit(2)})
    got = sharding.assign(clash, maps, 40, 41).collect()
    for s in {r.shard for r in got}:
        assert sorted(r.place for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) and r["size"] == len((r.text or "").encode()) + 16 for r in got)
    load = Counter()
    for r in got:  # the slot is Spark's hash of the id, seed 42
        h = xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little", signed=True), 42) if r.doc_id is not None else 42
        slot = (h - (1 << 64) if h >= 1 << 63 else h) % sharding.SLOTS
        assert (r.virtual_slot, r.shard, r.grown_shard) == (slot, a[slot], b[slot])
        load[slot] += r["size"]
    assert all(r.slot_bytes == load[r.virtual_slot] for r in got)
    assert sharding.assign(empty(spark), maps, 40, 41).count() == 0
    stats = sharding.slot_stats(sharding.assign(docs, maps, 40, 41), "size", ["virtual_slot"])
    grown = sharding.rebalance(stats, a)
    assert all(x == y or y == 40 for x, y in zip(a, grown, strict=True)) and {s: n for s, _, n in stats.collect()} == load


def test_shard_map_is_kept(spark, docs, tmp_path):
    """A later run reads the versions that are there and adds what is lacking; complete ones are never written again."""
    path = f"file://{tmp_path}/map"
    of = lambda df, v: [r.shard for r in df.filter(F.col("version") == v).orderBy("virtual_slot").collect()]
    files = lambda v: sorted(f.name for f in (tmp_path / "map" / f"version={v}").glob("part-*"))
    first = sharding.stored_map(spark, path, [4, 5], slots=64)
    assert of(first, 4) == sharding.initial_map(4, 64) and of(first, 5) == sharding.initial_map(5, 64)
    before = files(4), files(5)
    stats = spark.createDataFrame([(s, 1000 if s == 63 else 10) for s in range(64)], "virtual_slot int, bytes long")
    second = sharding.stored_map(spark, path, [5, 7], stats, slots=64)
    assert (files(4), files(5)) == before and {r.version for r in second.select("version").distinct().collect()} == {4, 5, 6, 7}
    for v in (6, 7):
        assert of(second, v) == sharding.rebalance(stats, of(second, v - 1))
        assert all(x == y or y == v - 1 for x, y in zip(of(second, v - 1), of(second, v), strict=True))
    assert of(second, 6) != sharding.initial_map(6, 64)
    spark.createDataFrame([(0, 0)], "virtual_slot int, shard int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version=7")  # a writer that died
    assert of(sharding.stored_map(spark, path, [7], stats, slots=64), 7) == sharding.rebalance(stats, of(second, 6))
    assert of(sharding.stored_map(spark, path, [3], slots=64), 3) == sharding.initial_map(3, 64)


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 32))
    noise = rng.normal(size=(200, 32))
    x[200:] = x[:200] + 0.42 * noise * (np.linalg.norm(x[:200], axis=1) / np.linalg.norm(noise, axis=1))[:, None]  # cosines near 0.92
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, x[0].tolist()), (401, None), (402, [0.0] * 32), (403, [float("nan")] * 32), (404, [None] * 32), (405, [1.0])]
    got = {r.vec_id: r for r in embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = np.array([r[1] for r in rows[:401]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    found = sum(got[i].n_links for i in range(401))
    assert found >= 0.9 * links.sum() and all(got[i].n_links <= links[i] for i in range(401))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(401, 406)) and got[400].component_id == 0


def brute_links(x):
    """Links of each row and the smallest row reachable, by all products."""
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links, part = [], np.arange(len(u))
    near = [np.concatenate(e) for e in zip(*[(lambda i, j: (i + k, j))(*np.nonzero(u[k : k + 2000] @ u.T >= 0.9)) for k in range(0, len(u), 2000)], strict=True)]
    links = np.bincount(near[0], minlength=len(u)) - 1
    while True:
        new = part.copy()
        np.minimum.at(new, near[0], part[near[1]])
        if (new == part).all():
            return links, part
        part = new


@pytest.mark.parametrize("spread", [0.3, 0.45, 0.7])
def test_embeddings_of_a_large_group(spark, spread):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 64))
    x[:2000] = x[0] + spread * x[:2000]
    x[5000:5500] = x[4000:4500] + 0.45 * x[5000:5500]
    x = x.astype(np.float32)
    links, part = brute_links(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding.near_duplicates(df).collect()}
    found = np.array([got[i].n_links for i in range(6000)])
    assert (found <= links).all() and found.sum() >= 0.995 * links.sum()
    assert sum(got[i].component_id == part[i] for i in range(6000)) >= 0.995 * 6000


def test_embeddings_recall_of_50_000(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50_000, 64))
    z = rng.normal(size=(5000, 64))
    u = x[:5000] / np.linalg.norm(x[:5000], axis=1, keepdims=True)
    z -= (z * u).sum(1, keepdims=True) * u
    x[5000:10_000] = 0.901 * u + np.sqrt(1 - 0.901**2) * z / np.linalg.norm(z, axis=1, keepdims=True)  # pairs at 0.901
    x[40_000:] = x[40_000] + 0.4 * x[40_000:]
    links, _ = brute_links(x)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(50_000), "embedding": pa.array(list(x))}))
    got = embedding.near_duplicates(df).toArrow().to_pandas().sort_values("vec_id")
    found = got.n_links.to_numpy()
    assert (found <= links).all()
    assert found[:10_000].sum() >= 0.99 * links[:10_000].sum() and found.sum() >= 0.99 * links.sum()


def test_embeddings_scale_and_dimension(spark):
    rows = [(1, [1e-200, 1e-203]), (2, [1e-203, 1e-200]), (3, [1e200, 1e200]), (4, [1e200, 1.01e200]), (5, [1.0, 0.0, 0.0]), (6, [2.0, 0.01, 0.0]), (7, [1.0]), (8, [3.0]), (9, [-3.0]), (10, []), (11, [5e-324, 0.0]), (None, [1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (1, 7), 9: (0, 9), 10: (0, 10), 11: (1, 1), None: (0, None)}
    assert embedding.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_toxicity(spark, sf):
    t = toxicity.Trie(["idiot", "moron"])
    assert t.near("idi0t", 1) and t.near("idiott", 1) and t.near("diot", 1) and not t.near("ixxot", 1)
    m = toxicity.Matcher(["idiot"])
    assert m.features("you idiot")[0] > 0 and m.features('he said "idiot"')[2] > 0 and m.features(None) == m.features("")
    rows = toxicity.op7_toxicity(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_toxicity_terms_by_plain_edit_distance():
    """The trie and its states find what comparing with every term finds."""
    rng = np.random.default_rng(4)
    word = lambda k: "".join(rng.choice(list("abcd"), k))
    terms = sorted({word(rng.integers(4, 9)) for _ in range(60)})
    words = [word(rng.integers(3, 10)) for _ in range(1500)] + [t[:i] + t[i + 1 :] for t in terms for i in range(len(t))] + [t[:i] + t[i + 1] + t[i] + t[i + 2 :] for t in terms for i in range(len(t) - 1)]
    m = toxicity.Matcher(terms)
    for w in words:
        near = any(edits(w, t) <= 1 for t in terms if len(t) >= 5)
        assert m.kind(w) == (2 if w in terms else 1 if near else 0), w


def edits(a, b):
    """Edit distance with neighbouring letters swapped as one edit."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_toxicity_held_out(spark):
    """Held-out toxic rows are found, misspelled ones included, quoted and clean ones left alone."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    common, bad = [word() for _ in range(300)], ["vrilnok", "zurqash", "wexto", "quodviz"]
    rows, labels = [], []
    for i in range(1200):
        text, toxic = list(rng.choice(common, 40)), i % 4 == 0
        if toxic:
            for at in rng.choice(40, 3, replace=False):
                t = bad[rng.integers(4)]
                text[at] = t if rng.random() < 0.8 else t[:2] + t[3:]
        rows.append((i, " ".join(text), "s", "en"))
        labels.append((i, int(toxic), 1))
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + labels[:50] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    repeated = df.unionByName(df.filter("doc_id < 40")).unionByName(df.filter("doc_id < 5").withColumn("text", F.lit("x")))  # a doc_id with other texts
    scores = {r.doc_id: r.score for r in toxicity.score(df, toxicity.model(repeated, lab, ~toxicity.held_out())).collect()}
    out = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([scores[i] >= 0.3 for i in out if i % 4 == 0]) >= 0.95 and np.mean([scores[i] >= 0.3 for i in out if i % 4]) <= 0.02
    none = toxicity.score(df.limit(3), toxicity.model(df, lab.limit(0), ~toxicity.held_out())).collect()
    assert len(none) == 3 and all(0 <= r.score <= 1 for r in none)
    assert toxicity.score(df.limit(0), ([], [], [0.0] * 8)).count() == 0


def test_toxicity_stems(spark):
    """Rows marked by a stem with ever other endings are found; chance words of toxic rows are no terms."""
    rng = np.random.default_rng(8)
    word = lambda k: "".join(rng.choice(list("abcdefghij"), k))
    rows, labels = [], []
    for i in range(800):
        text = [word(6) for _ in range(30)]
        if i % 8 == 0:
            text[3], text[9], text[20] = ("vrilnok" + word(3) for _ in range(3))
        elif i % 8 == 1:
            text[5] = "vrilm" + word(3)
        rows.append((i, " ".join(text), "s", "en"))
        labels.append((i, int(i % 8 == 0), 1))
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    terms, plain, weights = toxicity.model(df, lab, ~toxicity.held_out())
    assert "vrilnok*" in terms and all(t.startswith("vriln") for t in terms) and len(weights) == toxicity.FEATURES + 1
    m = toxicity.Matcher(terms)
    assert (m.kind("vrilnokx"), m.kind("vrilnok"), m.kind("vrilm"), m.kind("avrilnok")) == (3, 3, 0, 0)
    got = {r.doc_id: r.score >= 0.3 for r in toxicity.score(df, (terms, plain, weights)).collect()}
    assert all(got[i] == (i % 8 == 0) for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2)
    only = toxicity.model(df.filter("doc_id % 8 = 0"), lab, ~toxicity.held_out())  # no other rows
    assert toxicity.score(df, only).count() == 800


def test_quality(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = spark.read.parquet(f"{sf}/documents.parquet")
    both = quality.of_documents(known, labels).join(labels, "doc_id")
    assert both.filter(F.col("keep") == (F.col("quality") == 1)).count() >= 0.9 * both.count()
    assert quality.of_documents(docs, labels).count() == docs.count()
    assert quality.of_documents(docs, labels.limit(0)).filter("not keep").count() == 0
    assert quality.of_documents(empty(spark), labels).count() == 0


def test_quality_held_out(spark, sf):
    """Labels that weren't fitted: nearly all good documents stay and nearly all bad ones go, in each of five folds together."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    kept = {0: [], 1: []}
    for k in range(5):
        judged = quality.of_documents(docs, labels.filter(fold != k)).join(labels.filter(fold == k).select("doc_id", "quality"), "doc_id")
        for r in judged.select("quality", "keep").collect():
            kept[r.quality].append(r.keep)
    print("held out: good kept", np.mean(kept[1]), "bad kept", np.mean(kept[0]), len(kept[0]), len(kept[1]))
    assert np.mean(kept[1]) >= 0.95 and np.mean(kept[0]) <= 0.1


def test_quality_posteriors(spark, sf):
    """Every posterior again in Python, from the evidence of the rows."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.unionByName(docs.limit(3).withColumns({"source": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long")}))
    rows = quality.of_documents(docs, labels).collect()
    groups, hosts = defaultdict(list), defaultdict(list)
    for r in rows:
        groups[r.host, r.path].append(r.p)
        hosts[r.host].append(r.p)

    def strength(sites):
        n, good = np.array([len(x) for x in sites]), np.array([sum(x) for x in sites])
        mean = good.sum() / n.sum()
        spread = (good / n).var(ddof=1) - mean * (1 - mean) * (1 / n).mean()
        return mean, min(1e4, max(2.0, mean * (1 - mean) / max(spread, 1e-6) - 1))

    (mean, k_host), (_, k_path) = strength(list(hosts.values())), strength(list(groups.values()))
    for r in rows:
        h, g = hosts[r.host], groups[r.host, r.path]
        host = (k_host * mean + sum(h)) / (k_host + len(h))
        path = min(max((k_path * host + sum(g) - r.p) / (k_path + len(g) - 1), 1e-4), 1 - 1e-4)
        p = min(max(r.p, 1e-9), 1 - 1e-9)
        z = np.log(p / (1 - p)) + quality.STEP * (np.log(path / (1 - path)) - np.log(mean / (1 - mean)))
        assert (r.host_posterior, r.path_posterior, r.score) == pytest.approx((host, path, 1 / (1 + np.exp(-z))), rel=1e-6)
        assert r.keep == (r.score >= 0.5)


def test_quality_training_rows_are_distinct(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, "a good text " * 5 if i % 2 else "## $$ {} || " * 5, "s", "en") for i in range(40)] * 5, DOCS)
    w, odds = quality.fit(docs, labels, 20)
    assert len(w) == 13 and abs(odds) < 3


def test_url_intervals(spark):
    e = spark.createDataFrame([("x.com", "a", "add", 1), ("x.com", "a", "remove", 5), ("x.com/b", None, "add", 3), (None, "a", "add", 1)], "key string, category string, action string, at long")
    c = spark.createDataFrame([(1, "http://w.x.com/", 2), (2, "http://x.com/b/c", 5), (3, None, 2), (4, "http://x.com", None), (1, "http://w.x.com/", 2)], "page_id long, url string, fetched long")
    for sent in (urlfilter.SENT, 0):  # broadcast, and joined with a key's captures dealt to several tasks
        got = sorted((r.page_id, r.n_active) for r in urlfilter.judge(c, urlfilter.intervals(e), sent).collect())
        assert got == [(1, 1), (1, 1), (2, 1), (3, 0), (4, 0)]
    tied = spark.createDataFrame([("y.com", "a", "remove", 1), ("y.com", "a", "add", 1), ("z.com", "a", "add", 1), ("z.com", "a", "add", 1)], "key string, category string, action string, at long")
    assert [(r.key, r.since, r.until) for r in urlfilter.intervals(tied).collect()] == [("z.com", 1, None)]
    assert urlfilter.judge(c.limit(0), urlfilter.intervals(e.limit(0))).count() == 0


def test_long_texts_and_clashing_columns(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    long_ = " ".join(f"w{i % 977} x{i % 13}" for i in range(40_000))
    names = ["ids", "decoded", "n_shingles", "set_key", "bands", "component_id", "kept", "spans", "rest", "score", "p", "hits", "n_words", "row_no", "virtual_slot", "before", "toxic", "quality", "y", "host", "path"]
    rows = [(1, long_, "s", "en"), (2, long_ + "#tail", "s", "en"), (3, "short", "s", "en"), (4, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(k) for k, c in enumerate(names)})
    near = {r.doc_id: r for r in minhash.near_duplicates(df, k=4).collect()}
    words = (long_ + "#tail").split()
    assert near[2].n_shingles == len({tuple(words[i : i + 4]) for i in range(len(words) - 3)}) and (near[1].component_id, near[2].component_id, near[4].component_id) == (1, 1, 4)
    cut = {r.doc_id: r for r in suffix.repeated(df).collect()}
    assert bytes(cut[1].kept).decode() == long_ and bytes(cut[2].kept) == b"#tail" and cut[2].bands == names.index("bands") and [(s.start, s.stop) for s in cut[2].spans] == [(0, len(long_))]
    spec, t = queries.vocabulary(), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: r for r in bpe.decode(bpe.encode(df, spec), spec).collect()}
    assert list(ids[1].ids) == t.encode(long_, add_special_tokens=False).ids and ids[4].decoded == "" and ids[3].score == names.index("score")
    bench = spark.createDataFrame([(1, "w5 x5 w6 x6 w7 x7 w8 x8 w9 x9 w10 x10")], "item_id long, text string")
    marked = {r.doc_id: r for r in decontaminate.report(df, bench).collect()}
    assert marked[1].n_words == 80_000 and marked[1].contaminated and not marked[3].contaminated
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.of_documents(df, labels).count() == 4
    assert toxicity.score(df, toxicity.model(df, labels, F.lit(True))).count() == 4
