"""Source divergence audit: how far the sources of a language are apart in the terms they use.

Terms are counted task by task, and kept if enough of their language's documents hold them. Every group (language and source) gives
every kept term a smoothed share p of a billion; two shares differ by f = floor((p - q)^2 / (p + q)). The sum of f over all kept terms
would need a value for each term and pair of sources. Instead, all terms count at first as absent from both sources; what a term adds
where one source has it depends on that source's count alone, and what it adds where both have it is found in a frequent-pattern
tree: the term's sources with their shares, in source order, are inserted as a path, terms with a common beginning share its nodes,
and each node meets each of its ancestors once, times the terms that pass through it. Ranges of the sorted paths make trees of
their own; since sums are linear in the number of terms, trees of different ranges just add up.

All arithmetic is in integers. Null text, lang and source are read as ''. Terms are found as runs of letters (A-Z lower-cased) and
characters beyond ASCII, whatever the length of the text. Repeated rows count each time. Without kept terms, values are 0; an empty
table gives no rows. Equal values are ranked by item. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, settled, table

UNIT = 1_000_000_000
HELD = 400_000  #: counted terms that a task holds before it hands them on
PAIRS_HELD = 500_000  #: sums of source pairs that a task holds
SLICE = 1 << 22  #: bytes of a text that are split at once
SENT_GROUPS = 100_000  #: most groups that are broadcast
ROWS_A_RANGE = 50_000
LETTERS = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
SUMMED = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, so many bytes at a time."""
    plain, at = text.translate(LETTERS), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE) if at + SLICE < len(plain) else -1
        end = end if end >= 0 else len(plain)
        yield plain[at:end].split()
        at = end


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text (binary), lang, source -> occurrences and documents of each term in each group, and a row without a term for each group."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())
            size = len(terms)
            yield pa.record_batch([pa.array([lang] * size), pa.array([source] * size), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())], schema=COUNTED)
        groups.clear()

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            for text, lang, source in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in slices(text):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                held += len(n) - before
                if held > HELD:
                    yield from flush()
                    held = 0
    yield from flush()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exact for any long."""
    top = (count + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", top, (total + 2 * terms).cast("decimal(20,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of longs up to UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def both_have(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted paths (lang, items: sources with the share and the share of an absent term, n: terms) -> for pairs of sources, what terms
    that both have add. The tree is the sorted paths themselves: a node is a run of rows that begin alike, told by how many items a
    row has in common with the one before it. A run cut by the end of a batch makes two nodes, whose sums add up."""
    sums: dict[tuple[str, int, int], int] = {}

    def flush() -> pa.RecordBatch:
        keys = [*zip(*sums, strict=True)] if sums else [(), (), ()]
        out = pa.record_batch([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.int32()), pa.array(sums.values(), pa.int64())], schema=SUMMED)
        sums.clear()
        return out

    f = lambda p, q: (p - q) ** 2 // (p + q)
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        edges = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1), len(langs)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(lo, hi - lo)
            lists, times = part.column("items"), part.column("n").to_numpy()
            flat, width = lists.flatten(), np.diff(lists.offsets.to_numpy())
            starts = np.cumsum(width) - width
            source, p, absent = (flat.field(k).to_numpy() for k in ("no", "p", "absent"))
            depths = [np.flatnonzero(width > d) for d in range(width.max(initial=0))]
            # shared[r]: items that row r has in common with row r - 1
            shared, on = np.zeros(len(width), np.int64), np.arange(len(width)) > 0
            for d, rows in enumerate(depths):
                ok = rows[on[rows]]
                ok = ok[width[ok - 1] > d]
                a, b = starts[ok] + d, starts[ok - 1] + d
                ok = ok[(source[a] == source[b]) & (p[a] == p[b])]
                on[:] = False
                on[ok] = True
                shared[ok] = d + 1
            passed = np.concatenate([[0], np.cumsum(times)])
            for d in range(1, len(depths)):
                first = np.flatnonzero(shared <= d)  # a run of depth d begins, or one ends
                n = passed[np.append(first[1:], len(width))] - passed[first]
                node = width[first] > d
                first, n = first[node], n[node]
                here = starts[first] + d
                for e in range(d):
                    up = starts[first] + e
                    value = n * (f(p[up], p[here]) - f(p[up], absent[here]) - f(absent[up], p[here]) + f(absent[up], absent[here]))
                    codes, at = np.unique(source[up].astype(np.int64) << 32 | source[here], return_inverse=True)
                    total = np.zeros(len(codes), np.int64)
                    np.add.at(total, at, value)
                    for code, v in zip(codes.tolist(), total.tolist(), strict=True):
                        key = (langs[lo], code >> 32, code & 0xFFFFFFFF)
                        sums[key] = sums.get(key, 0) + v
            if len(sums) > PAIRS_HELD:
                yield flush()
    yield flush()


def counts(docs: DataFrame, min_docs: int, lang: str, source: str, text: str) -> DataFrame:
    """(lang, term, items: source and occurrences) of kept terms, and a row without a term for each lang, with all its sources."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (text, lang, source)])
    counted = read.select(F.col(text).cast("binary"), lang, source).mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    each = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    per_term = each.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("items"), F.sum("docs").alias("docs"))
    return per_term.filter(F.col("term").isNull() | (F.col("docs") >= min_docs)).drop("docs")


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank). Part 'pair': every other source of the lang; part 'term': the `top` terms by which the
    source stands out from its lang."""
    rows = settled(lambda: counts(docs, min_docs, lang, source, text))
    kept = rows.filter("term is not null").withColumn("of_lang", F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    each = kept.select("lang", "term", "of_lang", F.inline("items"))
    names = rows.filter("term is null").select("lang", F.inline("items")).drop("n")
    per = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("of_lang").alias("lang_total"))
    groups = names.join(per, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    absent = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
    groups = materialize(groups.withColumns({"no": F.row_number().over(Window.partitionBy("lang").orderBy("source")), "absent": absent}))
    few = groups.limit(SENT_GROUPS + 1).count() <= SENT_GROUPS
    sent = F.broadcast(groups) if few else groups
    placed = each.filter("n > 0").join(sent, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    # terms that a source has more often than its lang
    q = share(F.col("of_lang"), F.col("lang_total"), F.col("terms"))
    stands_out = placed.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = stands_out.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    # pairs: as if no term was in either, what one has, what both have
    other = sent.select("lang", F.col("source").alias("item"), F.col("no").alias("b"), F.col("absent").alias("other"))
    pairs = groups.select("lang", "source", F.col("no").alias("a"), "absent", "terms").join(other, "lang").filter("a <> b")
    pairs = pairs.select("lang", "source", "item", "a", "b", F.when(F.col("terms") > 0, F.col("terms") * apart(F.col("absent"), F.col("other"))).otherwise(0).alias("base"))
    one = placed.groupBy("lang", F.col("no").alias("a"), "absent", "p").agg(F.count("*").alias("n")).join(other, "lang").filter("a <> b")
    one = one.select("lang", "a", "b", (F.col("n") * (apart(F.col("p"), F.col("other")) - apart(F.col("absent"), F.col("other")))).alias("value"))
    paths = placed.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("no", "p", "absent"))).alias("items"))
    paths = materialize(paths.groupBy("lang", "items").agg(F.count("*").alias("n")))
    ranges = max(1, -(-paths.count() // ROWS_A_RANGE))
    ordered = paths.repartitionByRange(ranges, "lang", "items").sortWithinPartitions("lang", "items")
    both = ordered.mapInArrow(both_have, "lang string, a int, b int, value long")
    parts = [one, one.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"), both, both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")]
    added = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("lang", "a", "b").agg(F.sum("value").alias("added"))
    valued = pairs.join(added, ["lang", "a", "b"], "left").withColumn("value", F.col("base") + F.coalesce("added", F.lit(0)))
    far = valued.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return far.unionByName(best).select("lang", "source", "part", "item", F.col("value").cast("long"), F.col("rank").cast("int"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of audit(): terms in at least 10 documents, all pairs, ten terms."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS MATERIALIZED (SELECT lang, source, r, unnest(w) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
have AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN (SELECT lang, source, sum(n) AS total FROM have GROUP BY ALL) h ON g.lang = h.lang AND g.source = h.source
  LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) k ON g.lang = k.lang),
dense AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 2)::HUGEINT) // (total + 2 * v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN have h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
langs AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)::HUGEINT) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM have GROUP BY lang, term),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM dense JOIN langs USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
