"""BPE encoding and decoding with a public word-end vocabulary.

Encoding: a word's candidate tokens come from one Aho-Corasick pass (the longest token that starts at each place), and are taken
left to right; a token may follow another only if byte-pair merging would keep their boundary (the pair-compatibility table),
else the encoder falls back to the next shorter token or steps back. Each place is given up at most once, so a word takes linear
time. Distinct words are remembered per worker, up to a bound. Decoding copies each id's bytes out of one concatenated table
by offsets.

Letters, numbers, composed forms and lower case differ between versions of Unicode. Texts beyond the Latin blocks are normalised and
cut into words by the tokenizer library's own normalizer and splitter, so that its tables decide; merges are made here.

Null texts are empty; empty texts have no ids. Whole texts are encoded, however long. Rows are independent: repeated rows,
null or repeated keys and further columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from tidemark.llm.common import bounded_batches

LATIN = 0x250  #: end of the Latin blocks
ROWS = 64  #: encoded or decoded at once
END = "\0"  #: stands for the word end; no byte is written so in byte-level tokens


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Encoder:
    """Merges of one vocabulary file (its JSON text); max_words bounds the words and pairs that are remembered."""

    def __init__(self, spec: str, max_words: int = 100_000):
        spec = json.loads(spec)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        inner = lambda s: s[: -len(suffix)] + END if s.endswith(suffix) else s
        size = max(vocab.values()) + 1
        self.length, self.rank, self.left, self.right, self.shorter = [0] * size, [-1] * size, [-1] * size, [-1] * size, [-1] * size
        own = {inner(s): i for s, i in vocab.items()}
        self.matches = ahocorasick.Automaton()
        for s, i in own.items():
            self.length[i] = len(s)
            self.matches.add_word(s, i)
            self.shorter[i] = next((own[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in own), -1)
        self.matches.make_automaton()
        self.merge_rank = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = vocab[a + b]
            self.merge_rank[vocab[a], vocab[b]] = r
            self.rank[made], self.left[made], self.right[made] = r, vocab[a], vocab[b]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # fixed value: the vocabulary's own pattern of words
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.words = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        # the same for texts of Latin characters alone, whose classes all versions agree on; they are composed already
        sets = {r"\p{L}": "L", r"\p{N}": "N", r"\s": "Z"}
        for name, kind in sets.items():
            pattern = pattern.replace(name, "".join(re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c))[0] == kind or kind == "Z" and 9 <= c <= 13 or kind == "Z" and c == 0x85))
        self.latin_words, self.beyond = re.compile(pattern), re.compile(f"[^\0-{chr(LATIN - 1)}]")
        self.letters = byte_letters()
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.max_words = max_words

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the boundary between tokens a and b. Undoes their merges from the last to the first; a merge
        across the boundary that comes before the next one undone would have been made."""
        key, limit = (a, b), 1 << 60
        if (found := self.pairs.get(key)) is not None:
            return found
        while True:
            r = self.merge_rank.get((a, b))
            if r is not None and r < limit:
                answer = False
                break
            if self.rank[a] > self.rank[b]:
                limit, a = self.rank[a], self.right[a]
            elif self.rank[b] >= 0:
                limit, b = self.rank[b] + 1, self.left[b]
            else:
                answer = True
                break
        if len(self.pairs) >= self.max_words:
            self.pairs.clear()
        self.pairs[key] = answer
        return answer

    def word(self, word: str) -> list[int]:
        if (found := self.known.get(word)) is not None:
            return found
        s = "".join([self.letters[b] for b in word.encode("utf-8", "surrogatepass")]) + END
        n, longest = len(s), [-1] * len(s)
        for end, i in self.matches.iter(s):
            longest[end - self.length[i] + 1] = i  # later ends are longer
        open_, out, at, i = [True] * (n + 1), [], 0, longest[0]
        while at < n:
            if i < 0:
                open_[at] = False
                i = out.pop()
                at -= self.length[i]
                i = self.shorter[i]
            elif open_[at + self.length[i]] and (not out or self.compatible(out[-1], i)):
                out.append(i)
                at += self.length[i]
                i = longest[at] if at < n else -1
            else:
                i = self.shorter[i]
        if len(self.known) >= self.max_words:
            self.known.clear()
        if n < 200:
            self.known[word] = out
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.cut.split(text) if self.cut and "<|" in text else (text,)):
            if k % 2:
                out.append(self.special[part])
                continue
            get, word = self.known.get, self.word
            low = part.lower()
            if low.isascii() or not self.beyond.search(low):
                words = self.latin_words.findall(low)
            else:
                words = [w for w, _ in self.words.pre_tokenize_str(self.normal.normalize_str(part))]
            for w in words:
                out += get(w) or word(w)
        return out


_encoder: dict[int, Encoder] = {}


def _encoder_of(spec: str) -> Encoder:
    """The worker's encoder: made once for each vocabulary."""
    key = hash(spec)
    if key not in _encoder:
        _encoder.clear()
        _encoder[key] = Encoder(spec)
    return _encoder[key]


def _pieces(spec: str) -> tuple[bytes, np.ndarray]:
    """All tokens, a space after each, as one string, and where each begins."""
    data = json.loads(spec)
    tokens = {i: s for s, i in data["model"]["vocab"].items()} | {t["id"]: t["content"] for t in data["added_tokens"]}
    pieces = [(tokens.get(i, "") + " ").encode() for i in range(max(tokens) + 1)]
    return b"".join(pieces), np.cumsum([0, *map(len, pieces)])


def _text(ids: np.ndarray, blob: np.ndarray, offset: np.ndarray) -> str:
    first, size = offset[ids], offset[ids + 1] - offset[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return ""
    place = np.arange(total, dtype=np.int64 if len(blob) + total >= 1 << 31 else np.int32)
    place += np.repeat((first - (ends - size)).astype(place.dtype), size)
    return blob[place[:-1]].tobytes().decode()


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        for k in range(0, max(batch.num_rows, 1), ROWS):
            part = batch.slice(k, ROWS)
            yield part, part.column(part.schema.get_field_index(column))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))


def encode(docs: DataFrame, spec: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ids_col: the token ids of text_col. spec is the vocabulary file's JSON text, sent to each executor once."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # a vocabulary file: bounded, about 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _encoder_of(shared.value).encode
        for part, texts in _parts(batches, text_col):
            ids = [np.array(one(x.as_py() or ""), np.int32) for x in texts]
            yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids)], [*part.schema.names, ids_col])

    kept = docs.drop(ids_col) if ids_col in docs.columns else docs
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, spec: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds text_col: the tokens of ids_col joined by spaces, as a vocabulary file without a decoder has it. Null ids: empty."""
    bounded_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(_pieces(spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, offset = np.frombuffer(shared.value[0], np.uint8), shared.value[1]
        for part, lists in _parts(batches, ids_col):
            texts = [_text(x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, np.int32), blob, offset) for x in lists]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, text_col])

    kept = encoded.drop(text_col) if text_col in encoded.columns else encoded
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(text_col, T.StringType())]))


def encode_and_check(docs: DataFrame, spec: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """encode() without text_col, and decoded_sha256: the digest of what decode() makes of the ids. One Python step does both, so a task
    has one worker, which holds one vocabulary, and decoded texts stay in it."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder_of(shared.value)
        blob, offset = _pieces(shared.value)
        blob = np.frombuffer(blob, np.uint8)
        for part, texts in _parts(batches, text_col):
            ids = [np.array(encoder.encode(x.as_py() or ""), np.int32) for x in texts]
            sha = pa.array([hashlib.sha256(_text(x, blob, offset).encode()).hexdigest() for x in ids], pa.string())
            others = [k for k, c in enumerate(part.schema.names) if c != text_col]
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in others], _lists(ids), sha], [*[part.schema.names[k] for k in others], ids_col, "decoded_sha256"])

    kept = docs.drop(*[c for c in (ids_col, "decoded_sha256") if c in docs.columns])
    fields = [f for f in kept.schema.fields if f.name != text_col]
    return kept.mapInArrow(run, T.StructType([*fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())]))
