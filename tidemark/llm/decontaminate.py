"""Benchmark decontamination with DataFrame functions alone.

A document's words are runs of digits, a-z (after lower-casing A-Z) and characters beyond ASCII. The benchmark's windows (n
consecutive words; a shorter item is one window of its own length) form a hash set that is sent to every executor; each
document window is hashed and looked up, and hits are verified word for word by an equi-join. Up to SENT windows the set is part
of the plan; up to SENT_HASHES, their hashes are broadcast; beyond that, hashes are joined by whatever join Spark picks. In both
latter cases the places of hits go back to their rows, where the words are, and are verified there.

Null texts have no words. Repeated rows are told apart by their place in the input; null doc_ids are rows like others. Items
without words or with a null id are passed over. Empty tables: no windows, so nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, materialize, table

SENT, SENT_HASHES = 200_000, 1_000_000  #: most windows in the plan, and most whose hashes are broadcast (64 MB, measured; 96 MB with the size as a second key)
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PIECES = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), ""), lower_ascii)


def benchmark_windows(benchmark: DataFrame, n: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (window, size, items, hash): each distinct window once, with the items that hold it."""
    item = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    item = item.withColumn("size", F.least(F.size("w"), F.lit(n)))
    each = item.select("item", "size", F.explode(F.expr("transform(sequence(1, size(w) - size + 1), i -> slice(w, i, size))")).alias("window"))
    return each.groupBy(F.array_join("window", " ").alias("window"), "size").agg(F.collect_set("item").alias("items"), F.first(F.xxhash64("window")).alias("hash"))


def marks(docs: DataFrame, benchmark: DataFrame, n: int, text_col: str, max_set: int, keys: list[str], max_hashes: int = SENT_HASHES) -> DataFrame:
    """A row for each row of docs: its keys, n_words, hits and items. One pass over the texts up to max_set windows, else two, for
    which docs must be a table (or a checkpoint) whose rows come in the same order each time; only hits are shuffled."""
    windows = benchmark_windows(benchmark, n)
    sent = windows.select("hash", "size").limit(max_set + 1).collect()  # bounded by max_set
    small = len(sent) <= max_set
    by_size: dict[int, list[int]] = {}
    if not small:
        windows = materialize(windows)
    for h, size in sent if small else windows.select(F.lit(0), "size").distinct().collect():  # sizes: n at most
        by_size.setdefault(size, []).append(h)
    base = docs.select(*keys, F.monotonically_increasing_id().alias("row_no"), words(F.col(text_col)).alias("w"))

    def places(make) -> str:
        """SQL of the array of make(size, test) over all windows of a row."""
        looks = [make(size, f"sequence(1, greatest(size(w) - {size - 1}, 1))", hashes) for size, hashes in sorted(by_size.items())]
        return f"flatten(array({', '.join(looks)}))"

    window = "array_join(slice(w, i, {0}), ' ') as window"
    if not by_size:
        found = F.expr("cast(array() as array<struct<at:int,size:int,window:string>>)")
    elif small:
        found = F.expr(places(lambda size, at, hashes: f"transform(filter({at}, i -> size(w) >= {size} and xxhash64(slice(w, i, {size})) in ({', '.join(map(str, hashes))})), i -> struct(i - 1 as at, {size} as size, {window.format(size)}))"))
    else:
        each = F.expr(places(lambda size, at, _: f"transform(filter({at}, i -> size(w) >= {size}), i -> struct(i as at, {size} as size, xxhash64(slice(w, i, {size})) as hash))"))
        known = windows.select("hash").distinct()  # one long key, which Spark packs; a hit of another size falls at the check of its words
        known = F.broadcast(known) if known.limit(max_hashes + 1).count() <= max_hashes else known
        hit = base.select("row_no", F.explode(each).alias("x")).select("row_no", "x.*").join(known, "hash", "left_semi")
        hit = hit.groupBy("row_no").agg(F.collect_list(F.struct("at", "size")).alias("ats"))  # at most n windows for each word of a row
        base = base.join(hit, "row_no", "left")
        found = F.expr("transform(ats, x -> struct(x.at - 1 as at, x.size as size, array_join(slice(w, x.at, x.size), ' ') as window))")
    # the words of a document stay within its row: what is exploded and shuffled is its hits
    rows = base.select(*keys, "row_no", F.size("w").cast("long").alias("n_words"), F.explode_outer(found).alias("hit")).select(*keys, "row_no", "n_words", "hit.*")
    true = windows.select("window", "size", "items")
    checked = rows.join(F.broadcast(true) if small else true, ["window", "size"], "left")
    return checked.groupBy("row_no").agg(
        *[F.first(k).alias(k) for k in keys],
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("items").isNotNull(), F.expr("sequence(at, at + size - 1)")))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", max_set: int = SENT) -> DataFrame:
    """docs with n_words, hits (places of hit words, from 0) and items (ids of items with an occurring window). docs is read
    twice, so it must be a table (or a checkpoint) whose rows come in the same order each time."""
    kept = docs.drop(*[c for c in ("n_words", "hits", "items", "row_no") if c in docs.columns])
    return kept.withColumn("row_no", F.monotonically_increasing_id()).join(marks(kept, benchmark, n, text_col, max_set, []), "row_no").drop("row_no")


def without_spans(marked: DataFrame, text_col: str = "text") -> DataFrame:
    """Cuts the hit words, with the breaks before them, out of texts that have any."""
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(PIECES), F.lit(0))
    cut = F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains("hits", i)), "")
    return marked.withColumn(text_col, F.when(F.size("hits") > 0, cut).otherwise(F.col(text_col)))


def without_documents(marked: DataFrame, share: float = 0.0) -> DataFrame:
    """Drops documents of whose words more than `share` are hit."""
    return marked.filter(F.size("hits") <= F.col("n_words") * share)


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    marked = marks(docs, benchmark, n, "text", SENT, ["doc_id"])
    return marked.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bwin AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bwin),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, d.n, i, item_id FROM dwin d JOIN bwin USING (n, win)),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
