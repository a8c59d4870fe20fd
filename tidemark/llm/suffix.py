"""Removal of repeated substrings with a distributed difference-cover suffix sort.

What counts is which n-byte strings a document shares with one of a smaller doc_id. Equal n-byte strings are first brought to one
task, then sorted there:

1. Every n-byte string has an anchor: the GRAM bytes within it whose hash is the smallest; equal strings have equal anchors. Some
   anchors, chosen by their hash, cut the text into chunks; a chunk that a smaller doc_id has too is removed as a whole and
   searched no further. Of the rest, only anchors that two documents share can belong to a repeated string (`meet_by_hash`).
2. Around each shared anchor the strings it anchors form a snippet of at most 2n - GRAM bytes. Equal snippets are folded into
   one with its smallest doc_id, and snippets are dealt out by their anchor (`snippets`).
3. Each task sorts the suffixes of its snippets by a difference cover modulo 3: the suffixes at places 1 and 2 modulo 3 are
   sorted by triples of bytes and named, then by triples of names, until names stand for more than n bytes; the places 0 modulo
   3 are merged in by their first byte and the name behind it. Adjacent prefixes of n bytes are compared; those equal form a
   class, whose smallest doc_id decides (`repeated_windows`).

A task holds the snippets of some anchors, folded, and sorts about PART bytes of them at once; buckets grow in number with the
text, not in size. An anchor of more than HOT distinct snippets isn't sorted in its bucket: the n-byte strings of its snippets are
grouped by themselves, so that they spread over all tasks (`repeated_of_hot`).

Null and short texts have nothing to remove. A null doc_id is neither smaller nor larger than another: such rows keep all their
bytes. Rows that share a doc_id don't shorten each other; repeated rows are each returned. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, discard, materialize, table

N, GRAM = 50, 32  #: GRAM long enough that few are shared by chance, however large the table
CHUNK, BLOCK = 1 << 20, 1 << 15  #: bytes that a task works on at once; places that are hashed at once
DEAL = 12 << 20  #: bytes of text for each bucket of chunk or anchor hashes
BUCKET = 4 << 20  #: bytes of text for each bucket of snippets
PART = 1 << 17  #: bytes of a bucket's snippets that are sorted at once, if no anchor alone has more
HOT, SENT = 10_000, 200_000  #: distinct snippets of an anchor that a bucket sorts at most; hot anchors that are broadcast at most
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words_at(s: np.ndarray) -> np.ndarray:
    """The 8 bytes that start at each place of s, but the last 7."""
    return np.ndarray((len(s) - 7,), "<u8", s.tobytes(), strides=(1,)).astype(np.uint64)


def anchors(s: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last) of each anchor: the n-byte strings from `first` to `last`, consecutive ones of `starts`, have it.

    Works on BLOCK places at a time, so what it holds for each byte is a place and a hash."""
    if not len(starts):
        return np.empty(0, np.uint64), starts, starts, starts
    size, total = n - GRAM + 1, len(s)
    raw = s.tobytes() + bytes(GRAM + 8)
    hashes, places = np.empty(total, np.uint64), np.empty(total - size + 1, np.int32)
    numbers = np.arange(BLOCK + size, dtype=np.uint64)
    for at in range(0, len(places), BLOCK):
        windows = min(BLOCK, len(places) - at)
        k = windows + size - 1
        w = np.ndarray((k + GRAM - 7,), "<u8", raw, offset=at, strides=(1,)).astype(np.uint64)
        h = w[:k] * M1
        t = np.empty_like(h)
        for b in range(8, GRAM, 8):  # each step mixes in 8 bytes
            np.right_shift(h, np.uint64(29), out=t)
            h ^= t
            h *= M3
            h += w[min(b, GRAM - 8) : k + min(b, GRAM - 8)]
        h *= M2
        np.right_shift(h, np.uint64(32), out=t)
        h ^= t
        hashes[at : at + k] = h
        h &= np.uint64(0xFFFFFFFF00000000)
        h |= numbers[:k]  # of equal hashes the first place counts
        have = 1
        while 2 * have <= size:
            h = np.minimum(h[: len(h) - have], h[have:])
            have *= 2
        if have < size:
            h = np.minimum(h[: len(h) - (size - have)], h[size - have :])
        h &= np.uint64(0xFFFFFFFF)
        places[at : at + windows] = h
        places[at : at + windows] += at
    place = places[starts]
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    place = place[new].astype(np.int64)
    return hashes[place], place, starts[new], starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])]


def pieces(batch: pa.RecordBatch, text: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row of each piece, its offset in the text, its first byte in bytes) of about CHUNK bytes. Long texts come in pieces
    that overlap by n - 1 bytes, so each n-byte string lies in exactly one."""
    parts, rows, offsets, total = [], [], [], 0

    def pack():
        sizes = np.array([len(p) for p in parts])
        return np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.array(offsets), np.concatenate([[0], np.cumsum(sizes)])

    for r, x in enumerate(batch.column(text)):
        raw = x.as_py()
        raw = raw.encode("utf-8", "surrogatepass") if isinstance(raw, str) else zstandard.decompress(raw)
        for at in range(0, max(len(raw) - n + 1, 0), CHUNK):
            parts.append(raw[at : at + CHUNK + n - 1])
            rows.append(r)
            offsets.append(at)
            total += len(parts[-1])
            if total >= CHUNK:
                yield pack()
                parts, rows, offsets, total = [], [], [], 0
    if parts:
        yield pack()


def piece_anchors(s: np.ndarray, edges: np.ndarray, n: int):
    """anchors() of whole pieces, and the piece of each."""
    ok = np.ones(len(s), bool)
    for k in range(1, n):
        ok[edges[1:] - k] = False
    found = anchors(s, np.flatnonzero(ok), n)
    return *found, np.searchsorted(edges, found[2], side="right") - 1


def cut_points(h: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Which anchors begin a chunk: about every sixteenth, chosen by content, and the first of each piece."""
    new = (h >> np.uint64(7)) % np.uint64(16) == 0
    if len(new):
        new[0] = True
        new[1:] |= piece[1:] != piece[:-1]
    return new


def chunk_keys(s: np.ndarray, first: np.ndarray, last: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, bucket bits, chunk of each anchor): key hashes all bytes of the chunk's n-byte strings."""
    start = np.flatnonzero(begins)
    chunk = np.cumsum(begins) - 1
    raw = s.tobytes()
    ends = np.concatenate([start[1:], [len(first)]]) - 1 if len(start) else start
    made = np.array([xxhash.xxh3_128_digest(raw[a : b + n]) for a, b in zip(first[start], last[ends], strict=True)], "S16") if len(start) else np.empty(0, "S16")
    both = np.frombuffer(b"".join(x.ljust(16, b"\0") for x in made.tolist()), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1], chunk


def meet_by_hash(texts: DataFrame, entries, wide: bool, shared: bool, buckets: int) -> DataFrame:
    """(doc_id, hashes): of the entries (hash, further bits, row) that `entries(batch)` yields for texts, each document's hashes that
    another document has (shared), or that a smaller doc_id has (not shared). wide: all 128 bits must be equal, else the first 32,
    which is good enough to choose what is looked at. The further bits choose the bucket.

    Entries travel as packed arrays, one for each bucket and piece of input. Within a piece, a hash of several documents is
    settled at once; its first document, or its two ends, stand for it elsewhere, so a common hash costs a bucket no more than
    an entry or two for each piece.
    """
    kind = np.uint64 if wide else np.uint32

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for h, bits, rows in entries(batch):
                doc, h, bucket = ids[rows], h.astype(kind), (bits % np.uint64(buckets)).astype(np.int32)
                more = bits if wide else np.zeros(len(h), np.uint8)
                order = np.lexsort((doc, more, h, bucket))
                doc, h, more, bucket = doc[order], h[order], more[order], bucket[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (more[1:] != more[:-1]) | (bucket[1:] != bucket[:-1])
                new = fresh.copy()
                new[1:] |= doc[1:] != doc[:-1]
                doc, h, more, bucket, fresh = doc[new], h[new], more[new], bucket[new], fresh[new]
                known = np.ones(len(h), bool)
                known[fresh] = False
                if shared:
                    known[:-1] &= ~fresh[1:]
                    known[-1:] = False
                bucket[known] += buckets
                order = np.argsort(bucket, kind="stable")
                doc, h, more, bucket = doc[order], h[order], more[order], bucket[order]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, int)
                stop = np.concatenate([cut[1:], [len(bucket)]]) if len(cut) else cut
                by_doc = [np.argsort(doc[a:b], kind="stable") + a for a, b in zip(cut, stop, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), *[pa.array([x[o].tobytes() for o in by_doc], pa.binary()) for x in (h, more, doc)]], ["bucket", "h", "more", "doc"])

    def meet(group: pa.Table) -> pa.Table:
        h, more, doc = (np.frombuffer(b"".join(group[c].to_pylist()), t) for c, t in (("h", kind), ("more", np.uint64 if wide else np.uint8), ("doc", np.int64)))
        if group["bucket"][0].as_py() < buckets:
            order = np.lexsort((doc, more, h))
            h, more, doc = h[order], more[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])]))
            size = np.diff(np.concatenate([first, [len(h)]]))
            low = np.repeat(doc[first], size)
            keep = np.repeat(doc[first] != doc[first + size - 1], size) if shared else doc != low
            h, doc = h[keep], doc[keep]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        once = np.ones(len(h), bool)  # rows that are repeated say the same
        once[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        h, doc = h[once], doc[once]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, int)
        stop = np.concatenate([first[1:], [len(doc)]]) if len(doc) else first
        return pa.table({"doc_id": doc[first], "hashes": pa.array([h[a:b].tobytes() for a, b in zip(first, stop, strict=True)], pa.binary())})

    flat = texts.mapInArrow(deal, "bucket int, h binary, more binary, doc binary").groupBy("bucket").applyInArrow(meet, "doc_id long, hashes binary")
    return flat.groupBy("doc_id").agg(F.collect_list("hashes").alias("hashes"))


def listed(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of a column of lists of packed hashes."""
    blobs = [b"".join(x.as_py() or []) for x in column]
    width = np.dtype(kind).itemsize
    return np.repeat(np.arange(len(blobs)), [len(b) // width for b in blobs]), np.frombuffer(b"".join(blobs), kind)


def member(row: np.ndarray, h: np.ndarray, of_row: np.ndarray, of_h: np.ndarray) -> np.ndarray:
    """Whether (row, h) is among (of_row, of_h)."""
    tag = lambda r, x: x.astype(np.uint64) * M1 ^ (r.astype(np.uint64) * M2)
    return np.isin(tag(row, h), tag(of_row, of_h))


def all_chunks(n: int):
    """Entries of every chunk."""

    def entries(batch: pa.RecordBatch):
        for s, rows, _, edges in pieces(batch, 1, n):
            h, _, first, last, piece = piece_anchors(s, edges, n)
            begins = cut_points(h, piece)
            key, bits, _ = chunk_keys(s, first, last, begins, n)
            yield key, bits, rows[piece[begins]]

    return entries


def own_anchors(n: int):
    """Entries of the anchors outside chunks that a smaller doc_id has (column 3)."""

    def entries(batch: pa.RecordBatch):
        of_row, of_h = listed(batch.column(3), np.uint64)
        for s, rows, _, edges in pieces(batch, 1, n):
            h, _, _, _, piece, _, _ = own_parts(s, rows, edges, of_row, of_h, n)
            yield h, h >> np.uint64(32), rows[piece]

    return entries


def own_parts(s, rows, edges, of_row, of_h, n):
    """(hash, place, first, last, piece) of the anchors in own chunks, and (first, last) of each chunk that is not own."""
    h, place, first, last, piece = piece_anchors(s, edges, n)
    begins = cut_points(h, piece)
    key, _, chunk = chunk_keys(s, first, last, begins, n)
    start = np.flatnonzero(begins)
    ends = np.concatenate([start[1:], [len(first)]]) - 1 if len(start) else start
    seen = member(rows[piece[start]], key, of_row, of_h)
    own = ~seen[chunk] if len(chunk) else np.empty(0, bool)
    gone = (piece[start[seen]], first[start[seen]], last[ends[seen]])
    return h[own], place[own], first[own], last[own], piece[own], chunk[own], gone


def snippets(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(doc_id, text_key, bucket, offset, snippet, first): the bytes around each shared anchor; offset: of the anchor within them. texts:
    doc_id, packed, text_key, dups and shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(0, batch.num_rows, 1000):
                part = batch.slice(j, 1000)
                ids = part.column(0).to_numpy()
                (dup_row, dup_h), (of_row, of_h) = listed(part.column(3), np.uint64), listed(part.column(4), np.uint32)
                for s, rows, offsets, edges in pieces(part, 1, n):
                    h, place, first, last, piece, _, _ = own_parts(s, rows, edges, dup_row, dup_h, n)
                    good = member(rows[piece], h.astype(np.uint32), of_row, of_h)
                    h, place, first, last, piece = (x[good] for x in (h, place, first, last, piece))
                    size = last - first + n
                    stop = np.cumsum(size)
                    data = s[np.repeat(first - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
                    column = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], stop]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[rows[piece]]), part.column(2).take(pa.array(rows[piece], pa.int64())), pa.array(((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)), pa.array((place - first).astype(np.int32)), column, pa.array((first - edges[piece] + offsets[piece]).astype(np.int32))],
                        ["doc_id", "text_key", "bucket", "offset", "snippet", "first"],
                    )

    return texts.mapInArrow(run, "doc_id long, text_key int, bucket int, offset int, snippet binary, first int")


def rename(keys: np.ndarray) -> np.ndarray:
    """Names of keys, from 1, in their order."""
    order = np.argsort(keys)
    k = keys[order]
    names = np.empty(len(k), np.uint64)
    names[order] = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]]))
    return names


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Places of s in the order of their suffixes, compared by at least `depth` bytes (more, if names already tell them apart)."""
    n = len(s)
    pad = np.concatenate([s, np.zeros(depth * 3 + 9, np.uint8)]).astype(np.uint64)
    cover = np.flatnonzero(np.arange(n) % 3 != 0)
    name = np.zeros(len(pad) + 3 * depth, np.uint64)
    i = cover
    name[i] = rename((pad[i] << np.uint64(16)) | (pad[i + 1] << np.uint64(8)) | pad[i + 2])
    step = 3
    while step < depth and name[i].max(initial=0) < len(i):
        bits = np.uint64(int(name[i].max()).bit_length())
        if 3 * int(bits) <= 64:
            key = (name[i] << (bits * np.uint64(2))) | (name[i + step] << bits) | name[i + 2 * step]
        else:  # too many names for one word: two of the three first
            key = (rename((name[i] << bits) | name[i + step]) << bits) | name[i + 2 * step]
        name[i] = rename(key)
        step *= 3
    bits = np.uint64(max(1, int(name.max()).bit_length()))
    inner = i[np.argsort(name[i], kind="stable")]
    zero = np.flatnonzero(np.arange(n) % 3 == 0)
    byte_name = lambda p: (pad[p] << bits) | name[p + 1]
    two_name = lambda p: (pad[p] << (bits + np.uint64(8))) | (pad[p + 1] << bits) | name[p + 2]
    zero = zero[np.argsort(byte_name(zero), kind="stable")]
    one, two = inner[inner % 3 == 1], inner[inner % 3 == 2]
    where = np.searchsorted(byte_name(one), byte_name(zero)) + np.searchsorted(two_name(two), two_name(zero))
    return np.insert(inner, where, zero)


def repeated_windows(parts: list[bytes], least: np.ndarray, n: int) -> np.ndarray:
    """For each snippet, bits of the n-byte strings (by offset) that occur in a snippet whose least doc_id is smaller."""
    sizes = np.array([len(p) for p in parts])
    s = np.frombuffer(b"".join(parts), np.uint8)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    ok = np.ones(len(s), bool)
    for k in range(1, n):
        ok[edges[1:] - k] = False
    order = suffix_order(s, n)
    order = order[ok[order]]
    w = words_at(np.concatenate([s, np.zeros(8, np.uint8)]))
    same = np.ones(len(order) - 1, bool)
    for at in [*range(0, n - 7, 8), n - 8]:
        v = w[order + at]
        same &= v[1:] == v[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    snippet = np.searchsorted(edges, order, side="right") - 1
    lowest = np.repeat(np.minimum.reduceat(least[snippet], first), np.diff(np.concatenate([first, [len(order)]])))
    hit = lowest < least[snippet]
    bits = np.bincount(snippet[hit], 2.0 ** (order[hit] - edges[snippet[hit]]), len(parts))  # under 2**53: exact
    return bits.astype(np.int64)


def by_anchor(anchor: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Numbers of the snippets in parts of about PART bytes; an anchor's snippets are in one part."""
    order = np.argsort(anchor, kind="stable")
    a, stop = anchor[order], np.cumsum(sizes[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    part = (stop[new] - sizes[order[new]]) // PART
    return np.split(order, new[1:][part[1:] != part[:-1]])


def repeated_of_hot(snippets: DataFrame, n: int) -> DataFrame:
    """(bucket, key, least, bits), as repeated_windows has bits, by grouping equal strings. snippets: bucket, key, least, snippet."""
    strings = snippets.select("bucket", "key", "least", F.posexplode(F.expr(f"transform(sequence(0, octet_length(snippet) - {n}), i -> substring(snippet, i + 1, {n}))")).alias("k", "string"))
    low = strings.groupBy("string").agg(F.min("least").alias("low"), F.max("least").alias("high")).filter("low < high").select("string", "low")
    hits = strings.join(low, "string").filter("low < least").select("bucket", "key", "least", F.expr("shiftleft(1L, k)").alias("bits"))
    none = snippets.select("bucket", "key", "least", F.lit(0).cast("long").alias("bits"))
    return hits.unionByName(none).groupBy("bucket", "key", "least").agg(F.bit_or("bits").alias("bits"))


def repeated(docs: DataFrame, n: int = N, readable: bool = False) -> DataFrame:
    """docs (doc_id long, text string, further columns) with kept (binary: the bytes left; readable: a string without the characters
    of which bytes are gone) and spans array<struct<start, stop>> of what is removed."""
    if not GRAM + 8 <= n <= GRAM + 50:
        raise ValueError(f"n must be from {GRAM + 8} to {GRAM + 50}")
    bounded_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "kept", "spans")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("nothing"))  # further columns travel as one
    docs = docs.select("doc_id", "text", rest.alias("rest"), (F.col("doc_id").isNotNull() & (F.coalesce(F.octet_length("text"), F.lit(0)) >= n)).alias("ok"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    deals, buckets = max(8, total // DEAL), max(8, total // BUCKET)
    rest_type = docs.schema["rest"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([squeeze.compress(x.as_py().encode("utf-8", "surrogatepass")) for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, batch.column(2)], ["doc_id", "packed", "rest"])

    long_ = docs.filter("ok").select("doc_id", "text", "rest")
    # chunks that a smaller doc_id has need no more work than to be removed; the rest is searched string by string
    dups = materialize(meet_by_hash(long_.select("doc_id", "text"), all_chunks(n), True, False, deals)).withColumnRenamed("hashes", "dups")
    packed = long_.mapInArrow(pack, T.StructType().add("doc_id", "long").add("packed", "binary").add("rest", rest_type))
    key = F.hash("packed").alias("text_key")  # places are of one text, should texts share a doc_id
    texts = materialize(packed.filter("doc_id is not null").join(dups, "doc_id", "left").select("doc_id", "packed", "rest", "dups", key))
    shared = materialize(meet_by_hash(texts, own_anchors(n), False, True, deals).withColumnRenamed("hashes", "shared"))
    found = materialize(snippets(texts.join(shared, "doc_id").select("doc_id", "packed", "text_key", "dups", "shared"), n, buckets))
    key = F.xxhash64("offset", "snippet").alias("key")  # with the bucket, whose number grows with the input
    anchor = F.xxhash64(F.expr(f"substring(snippet, offset + 1, {GRAM})")).alias("anchor")
    folded = materialize(found.groupBy("bucket", "offset", "snippet").agg(F.min("doc_id").alias("least")).select("bucket", "snippet", "least", key, anchor))
    hot = materialize(folded.groupBy("bucket", "anchor").count().filter(F.col("count") > HOT).select("bucket", "anchor"))  # fewer than snippets / HOT

    def sort(group: pa.Table) -> pa.Table:
        least = group["least"].to_numpy()
        group_snippets, bits = group["snippet"].combine_chunks(), np.zeros(len(least), np.int64)
        for part in by_anchor(group["anchor"].to_numpy(), pc.binary_length(group_snippets).to_numpy().astype(np.int64)):
            bits[part] = repeated_windows(group_snippets.take(pa.array(part)).to_pylist(), least[part], n)
        return pa.table({"bucket": group["bucket"], "key": group["key"], "least": least, "bits": bits})

    some = not hot.isEmpty()
    sent = F.broadcast(hot) if hot.limit(SENT + 1).count() <= SENT else hot
    cold = folded.join(sent, ["bucket", "anchor"], "left_anti") if some else folded
    judged = cold.groupBy("bucket").applyInArrow(sort, "bucket int, key long, least long, bits long")
    spread = []
    if some:
        spread = [materialize(folded.join(sent, ["bucket", "anchor"]).select("bucket", "key", "least", "snippet"))]
        judged = judged.unionByName(repeated_of_hot(spread[0], n))
    seen = found.select("doc_id", "text_key", "bucket", key, "first", (F.octet_length("snippet") - n + 1).alias("strings"))
    bits = F.when(F.col("doc_id") > F.col("least"), F.expr("shiftleft(1L, strings) - 1")).otherwise(F.col("bits"))
    covers = seen.join(judged, ["bucket", "key"]).select("doc_id", "text_key", F.struct("first", bits.alias("bits")).alias("cover")).filter("cover.bits <> 0")
    covers = materialize(covers.groupBy("doc_id", "text_key").agg(F.collect_set("cover").alias("covers")))  # a text's own, however often it is repeated
    for step in (shared, found, folded, hot, *spread):
        discard(step)

    def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        """Rows of about CHUNK bytes of text together, and their texts."""
        raws, at, size = [], 0, 0
        for k, x in enumerate(batch.column(1)):
            raws.append(zstandard.decompress(x.as_py()))
            size += len(raws[-1])
            if size >= CHUNK:
                yield batch.slice(at, k + 1 - at), raws
                raws, at, size = [], k + 1, 0
        if raws:
            yield batch.slice(at), raws

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in (x for b in batches for x in slices(b)):
            edges_of = [np.zeros(len(r) + 1, np.int32) for r in raws]
            of_row, of_h = listed(batch.column(3), np.uint64)
            with_dups = np.unique(of_row)  # other rows have no chunk to remove
            for s, rows, offsets, edges in pieces(batch.take(pa.array(with_dups)), 1, n):
                rows = with_dups[rows]
                *_, (piece, first, last) = own_parts(s, rows, edges, of_row, of_h, n)
                for p, a, b in zip(piece.tolist(), first.tolist(), last.tolist(), strict=True):
                    shift = int(offsets[p] - edges[p])
                    edges_of[rows[p]][a + shift] += 1
                    edges_of[rows[p]][b + shift + n] -= 1
            spans, left = [], []
            for raw, edge, c in zip(raws, edges_of, batch.column(4), strict=True):
                if c := c.as_py():
                    first, bits = np.array([y["first"] for y in c]), np.array([y["bits"] for y in c], np.int64)
                    for k in range(n - GRAM + 1):
                        at = first[(bits >> k) & 1 == 1] + k
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + n, -1)
                gone = np.cumsum(edge)[:-1] > 0
                step = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                spans.append([{"start": a, "stop": b} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
                left.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            text = pa.array([r.decode("utf-8", "surrogatepass") for r in raws], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text, kept(left), pa.array(spans, kind), batch.column(2)], ["doc_id", "text", "kept", "spans", "rest"])

    def kept(left: list[bytes]) -> pa.Array:
        return pa.array([x.decode("utf-8", "ignore") for x in left], pa.string()) if readable else pa.array(left, pa.binary())

    done = texts.join(covers, ["doc_id", "text_key"], "left").select("doc_id", "packed", "rest", "dups", "covers")
    shape = T.StructType().add("doc_id", "long").add("text", "string").add("kept", "string" if readable else "binary").add("spans", T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))).add("rest", rest_type)
    done = done.mapInArrow(cut, shape)
    short = docs.filter("not ok").select("doc_id", "text", F.coalesce(F.col("text").cast("string" if readable else "binary"), F.lit("" if readable else b"")).alias("kept"), F.expr("cast(array() as array<struct<start:long,stop:long>>)").alias("spans"), "rest")
    return done.unionByName(short).select("doc_id", "text", "kept", "spans", *[F.col(f"rest.`{c}`").alias(c) for c in others])


def without_repeats(docs: DataFrame, n: int = N) -> DataFrame:
    """docs with what is left of each text; characters of which bytes are gone go as a whole."""
    own = {c: f"{c}_of_docs" for c in ("kept", "spans") if c in docs.columns}
    cut = repeated(docs.withColumnsRenamed(own), n, readable=True).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept")))
    return cut.drop("kept", "spans").withColumnsRenamed({v: k for k, v in own.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeated(table(spark, sf_dir, "documents"))
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return done.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
