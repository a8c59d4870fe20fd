"""The stages of corpus_pipeline.py against brute force, and on tables with edge rows."""

import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_llm import brute_repeats
from tidemark.llm.queries import vocabulary

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, item_id string, kept string"
ITEM = "one two three four five six seven eight nine ten eleven twelve"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A benchmark and labels: rows of letters are good, rows of signs aren't."""
    d = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 90)) if i % 2 else "#### $$ == {} || " * 12 + f"{i}{i}{i}" for i in range(20)]
    good = [" ".join(rng.choice(words, 90)) for _ in range(4)]
    texts += [good[0], good[0] + " tail", good[0], good[1] + " " + good[2], good[2] + " " + good[3], f"{good[3]} {ITEM}", "x" * 20_000, None, ""]
    rows = [(i, t, "en", "s", None, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, None, None, None, None, None, None), (21, texts[21], "en", "s", 1, "x", "y")], COLUMNS)


def texts_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality_stage(spark, docs, folder):
    got = {r.doc_id for r in STAGES["quality"](spark, docs, folder).collect()}
    assert set(range(1, 20, 2)) <= got and not got & set(range(0, 20, 2)) and None in got


def test_near_duplicate_stage(spark, docs, folder):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    rows = sorted({(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None}, key=lambda r: r[0])
    sets, group = [shingles(t) for _, t in rows], {i: i for i, _ in rows}
    for _ in rows:
        for (a, _), x in zip(rows, sets, strict=True):
            for (b, _), y in zip(rows, sets, strict=True):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
    got = STAGES["near_duplicates"](spark, docs, folder)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {None} | {i for i, g in group.items() if i == g}


def test_suffix_stage(spark, docs, folder):
    want = brute_repeats([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    got = STAGES["suffix_dedup"](spark, docs, folder)
    assert got.columns == docs.columns
    assert {(r.item_id, r.kept) for r in got.filter("doc_id is not null").collect()} == {("x", "y")}  # further columns stay
    for r in got.filter("doc_id is not null").collect():
        assert (r.text or "").encode() in {k for (i, _), k in want.items() if i == r.doc_id}


def test_decontamination_stage(spark, docs, folder):
    got = STAGES["decontamination"](spark, docs, folder)
    assert got.columns == docs.columns
    assert texts_of(got) == [r for r in texts_of(docs) if ITEM not in (r[1] or "")]


def test_tokens_stage(spark, docs, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    assert vocabulary()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    rows = STAGES["tokens"](spark, docs, folder).collect()
    assert len(rows) == docs.count() and all(list(r.ids) == want[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty(spark, docs, folder, name):
    assert STAGES[name](spark, docs.limit(0), folder).count() == 0


def test_verdicts_are_on_rows_not_ids(spark, docs, folder):
    """A contaminated or rejected row without a doc_id goes; a clean row stays, though another row of its doc_id goes."""
    good, bad = docs.filter("doc_id = 1").first().text, "#### $$ == {} || " * 12
    rows = [(50, good), (50, bad), (None, bad), (None, good), (51, f"{good} {ITEM}"), (51, good), (None, f"x {ITEM}")]
    df = spark.createDataFrame([(i, t, "en", "s", None, "x", "y") for i, t in rows], COLUMNS)
    d = f"{folder}/rows.parquet"
    docs.unionByName(df).write.mode("overwrite").parquet(d)
    held = spark.read.parquet(d)
    mine = lambda out: sorted(((str(r.doc_id), r.text) for r in out.collect() if r.doc_id in (50, 51) or r.doc_id is None and r.text), key=str)
    assert mine(STAGES["decontamination"](spark, held, folder)) == sorted([("50", good), ("50", bad), ("None", bad), ("None", good), ("51", good)])
    assert ("50", bad) not in mine(STAGES["quality"](spark, held, folder)) and ("None", bad) not in mine(STAGES["quality"](spark, held, folder))
    assert {("50", good), ("None", good)} <= set(mine(STAGES["quality"](spark, held, folder)))
