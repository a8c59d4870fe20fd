"""Conversation prefix trie: which conversations begin alike, and what sharing their beginnings saves.

A conversation is a sequence of turns, a turn the digest of its role and text; texts themselves aren't moved. Equal sequences are
folded. The rest is dealt to ranges of the order and sorted there, so neighbours have the longest beginnings in common. Each edge
between neighbours is that common length; taking edges from the longest to the shortest, union-find merges the rows on both sides, and
each merge makes a branching node (or adds to one of its depth) whose rows are one run of the order. Below the last merge, a
component is a chain of nodes with one child each, which is expanded when it's merged. A range knows the last row before it and the
first after it. Nodes that they share are its open ones: at most two paths, whatever the range holds. Their members, leaves, children
and words are sums over ranges (each node being counted where it first occurs), so the forest of a range is contracted to these
paths, and equal open nodes are added up.

Rows with a null conv_id belong to no conversation and are passed over. Null turns come first; rows of one turn are ordered by the
digest of role and text; null roles and texts are read as empty. Repeated rows are turns of their own. Texts may have any length. An
empty table has no nodes. Further columns are ignored. A range holds 20 bytes for each turn of its sequences, so a single conversation's
turns (not their texts) have to fit into a task; the ids of a node's complete conversations go through one task, which holds one
batch of them, since a digest is made from start to end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, settled, table

WORD = r"[^\x20\x09-\x0D]+"
DIGEST = 16  #: bytes of a turn
TURNS_A_RANGE = 200_000
SENT_OPEN = 100_000  #: most open nodes that are broadcast
NOTHING = hashlib.sha256(b"").hexdigest()
FOLDED = pa.schema([("seq", pa.binary()), ("words", pa.list_(pa.int64())), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])
NODES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("node", pa.binary()), ("parent", pa.binary())])
NODES_DDL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary, parent binary"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, no, digest, words): turns numbered from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    slim = conversations.filter("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    no = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest"))
    return slim.select("conv_id", no.alias("no"), "digest", "words")


def rebuilt(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """turns with each conversation's first `head` turns (`most` at most) replaced by those of conversation `base` (both of conv_id); a
    conversation that has no turn left is a row with a null no."""
    convs = turns.filter("no = 1").select("conv_id").withColumns({"_base": base, "_head": head})
    own = turns.withColumn("_head", head).filter("no > _head").drop("_head")
    heads = turns.filter(F.col("no") <= most).withColumnRenamed("conv_id", "_base").join(convs, "_base").filter("no <= _head").select("conv_id", "no", "digest", "words")
    return convs.select("conv_id").join(own.unionByName(heads), "conv_id", "left")


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (seq, words, conv_id), sorted -> one row for each sequence, with the digest of its conv_ids."""
    seq = words = first = sha = None
    n, out = 0, []
    for batch in batches:
        for s, w, c in zip(*(batch.column(k).to_pylist() for k in ("seq", "words", "conv_id")), strict=True):
            if s != seq:
                if sha:
                    out.append((seq, words, n, first, sha.hexdigest()))
                seq, words, first, n, sha = s, w, c, 1, hashlib.sha256(str(c).encode())
            else:
                n += 1
                sha.update(b",%d" % c)
        if len(out) >= 1000:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), FOLDED, strict=True)], schema=FOLDED)
            out = []
    if sha:
        out.append((seq, words, n, first, sha.hexdigest()))
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), FOLDED, strict=True)], schema=FOLDED)


def common(a: bytes | None, b: bytes | None) -> int:
    """Turns that two sequences begin with alike; -1 if one is missing."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(s, "V16", n) for s in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def node_ids(seq: bytes, deepest: int) -> list[bytes]:
    """Digests of the first 0 to `deepest` turns."""
    sha, out = hashlib.sha256(), []
    for d in range(deepest + 1):
        out.append(sha.copy().digest()[:DIGEST] + d.to_bytes(8, "big"))
        sha.update(seq[d * DIGEST : (d + 1) * DIGEST])
    return out


def forest(rows: pa.Table, bounds: pa.Table) -> pa.Table:
    """The trie over the rows of a range: closed nodes complete, open ones (with their `node`) as far as the range has them."""
    if not rows.num_rows:
        return NODES.empty_table()
    rows = rows.sort_by("seq")
    seqs, firsts, times, ends = (rows.column(k).to_pylist() for k in ("seq", "conv_id", "n", "ends"))
    before, after = (bounds.column(k)[0].as_py() for k in ("last_before", "first_after"))
    before, after = common(before, seqs[0]), common(seqs[-1], after)
    size = len(seqs)
    upto = [np.concatenate([[0], np.cumsum(w)]).tolist() for w in rows.column("words").to_pylist()]  # words of the first d turns
    lcp = [common(a, b) for a, b in zip(seqs[:-1], seqs[1:], strict=True)]
    front, back = node_ids(seqs[0], max(before, 0)), node_ids(seqs[-1], max(after, 0))

    # a component, by its first row: its last row, its top node's depth, and sums over what is below the top
    root, last = list(range(size)), list(range(size))
    top = [len(s) // DIGEST for s in seqs]
    n, least, end = list(times), list(firsts), list(ends)
    passed, once = [0] * size, [0] * size  # words below the top: for each conversation, and for each node
    leaves = [int(a < t) for a, t in zip([*lcp, after], top, strict=True)]  # no row goes on from it
    children, pending = [0] * size, [[] for _ in range(size)]
    chains: list[tuple] = []
    over: list[int] = []  # the chain above each chain

    def find(r: int) -> int:
        while root[r] != r:
            root[r] = root[root[r]]
            r = root[r]
        return r

    def raised(r: int, depth: int) -> None:
        """Ends the chain from the top of component r to below `depth`, which becomes its top."""
        if top[r] == depth:
            return
        new, words = len(chains), upto[r]
        chains.append((r, depth + 1, top[r], last[r] == size - 1, n[r], least[r], leaves[r], children[r], passed[r], once[r], end[r]))
        over.append(-1)
        for below in pending[r]:
            over[below] = new
        pending[r] = [new]
        known = before if r == 0 else -1  # nodes so deep are counted in a range before this
        if depth >= 0:
            passed[r] += n[r] * (words[top[r]] - words[depth])
            once[r] += words[top[r]] - words[min(max(depth, known), top[r])]
        children[r], top[r], end[r] = int(depth + 1 > known), depth, None

    for e in sorted(range(size - 1), key=lambda e: -lcp[e]):
        a, b = find(e), find(e + 1)
        raised(a, lcp[e])
        raised(b, lcp[e])
        root[b], last[a] = a, last[b]
        n[a] += n[b]
        least[a] = min(least[a], least[b])
        end[a] = end[a] or end[b]
        for sums in (passed, once, leaves, children):
            sums[a] += sums[b]
        pending[a] += pending[b]
        pending[b] = []
    raised(0, -1)

    out: list[tuple] = []
    for k, (r, lo, hi, has_last, members, conv, leaf, kids, all_words, node_words, ended) in enumerate(chains):
        known = before if r == 0 else -1
        is_open = max(known, after if has_last else -1)
        words, above = upto[r], chains[over[k]] if over[k] >= 0 else None
        for d in range(lo, hi + 1):
            down = words[hi] - words[max(d - 1, 0)]
            saved = all_words + members * down - node_words - (words[hi] - words[min(max(d - 1, 0, known), hi)])
            child = kids if d == hi else int(d + 1 > known)
            # whether the node above is open, and on which of the two paths
            if d == 0:
                parent, parent_conv = None, None
            else:
                p_first, p_last = (r == 0, has_last) if d > lo else (above[0] == 0, above[3])
                p_front, p_back = p_first and d - 1 <= before, p_last and d - 1 <= after
                parent = front[d - 1] if p_front else back[d - 1] if p_back else None
                parent_conv = None if parent else conv if d > lo else above[5]
            node = None if d > is_open else front[d] if d <= known else back[d]
            out.append((conv, d, parent_conv, members, child, leaf, saved, (ended if d == hi else None), node, parent))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), NODES, strict=True)], schema=NODES)


def trie(turns: DataFrame) -> DataFrame:
    """turns: (conv_id, no, digest, words), a null no for a conversation without turns. A row for each node."""
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("no").isNotNull(), F.struct("no", "digest", "words")))).alias("t"))
    whole = per.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), "")).alias("seq"), F.col("t.words").alias("words"))
    dealt = whole.repartition("seq").sortWithinPartitions("seq", "conv_id")
    folded = materialize(dealt.mapInArrow(fold, "seq binary, words array<long>, n long, conv_id long, ends string"))
    turns_in_all = folded.agg(F.sum(F.octet_length("seq")) / DIGEST + F.count("*")).first()[0] or 0
    ranges = max(1, -(-int(turns_in_all) // TURNS_A_RANGE))
    ranged = materialize(folded.repartitionByRange(ranges, "seq").withColumn("range", F.spark_partition_id()))
    edges = ranged.groupBy("range").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))  # a row a range
    order = Window.orderBy("range")
    bounds = edges.select("range", F.lag("hi").over(order).alias("last_before"), F.lead("lo").over(order).alias("first_after"))
    nodes = materialize(ranged.groupBy("range").cogroup(bounds.groupBy("range")).applyInArrow(forest, NODES_DDL))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    opened = nodes.filter("node is not null").groupBy("node", "depth", "parent").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    opened = materialize(opened)
    ups = opened.select(F.col("node").alias("parent"), F.col("conv_id").alias("of_parent"))
    ups = F.broadcast(ups) if ups.limit(SENT_OPEN + 1).count() <= SENT_OPEN else ups
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    made = nodes.filter("node is null").select(*cols, "parent").unionByName(opened.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*cols, "parent"))
    made = made.join(ups, "parent", "left").withColumns({"parent_conv_id": F.coalesce("parent_conv_id", "of_parent"), "ends_sha256": F.coalesce("ends_sha256", F.lit(NOTHING))})
    return made.select(*cols)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of trie(): conversation c begins with the first crc32(c) % 4 turns of conversation c - c % 20."""
    conv = F.col("conv_id")
    head = (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")
    turns = materialize(turns_of(table(spark, sf_dir, "conversations")))
    return settled(lambda: trie(rebuilt(turns, conv - conv % 20, head, 3)))


ORACLE = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b:
           list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT c, n, role, text FROM turns JOIN convs USING (c) WHERE n > h
  UNION ALL SELECT v.c, n, role, text FROM convs v JOIN turns t ON t.c = v.c - v.c % 20 AND n <= h),
paths AS (
  SELECT c, row_number() OVER w AS d, list({'r': role, 't': text}) OVER w AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
steps AS (SELECT c, d, md5(path::JSON::VARCHAR) AS k, words FROM paths UNION ALL SELECT c, 0, '', 0 FROM convs),
member AS MATERIALIZED (SELECT *, min(c) OVER (PARTITION BY d, k) AS m, d = max(d) OVER (PARTITION BY c) AS ends FROM steps),
parents AS (SELECT a.*, b.m AS pm FROM member a LEFT JOIN member b ON a.c = b.c AND b.d = a.d - 1),
nodes AS MATERIALIZED (
  SELECT m, d, any_value(pm) AS pm, count(*) AS n, any_value(words) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends FROM parents GROUP BY m, d),
kids AS (SELECT pm AS m, d - 1 AS d, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS MATERIALIZED (SELECT nodes.*, coalesce(kids, 0) AS kids FROM nodes LEFT JOIN kids USING (m, d)),
below AS (SELECT v.m, v.d, sum((u.n - 1) * u.words) AS saved, count(*) FILTER (u.kids = 0) AS leaves FROM full_nodes u JOIN member v ON v.c = u.m AND v.d <= u.d GROUP BY v.m, v.d)
SELECT m AS conv_id, d::BIGINT AS depth, pm AS parent_conv_id, n::BIGINT AS n_convs, kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM full_nodes JOIN below USING (m, d)
"""
