"""Token ids in a content-addressed store.

Each document's id stream is cut where a rolling hash of its last ids says so, so equal passages give equal chunks
wherever they stand. A chunk is kept once, under the digest of its bytes; a document is a recipe of digests with a
Merkle root over them, each part of the recipes has a manifest with the Merkle root over its documents, and one row
holds the root over all parts. Reading verifies every chunk against its digest, every document against its root,
every part against its manifest and the manifests against the store's root, so a lost document or part is noticed.

Layout of a store, all Parquet: ``pieces/kind=chunk`` (key: the digest, n, data: ids as little-endian integers of the
store's width), ``recipes`` (j, id, start, n_tokens, digests, lengths, root, part; in id order), ``manifest`` (part,
documents, tokens, root) and ``store`` (parts, documents, tokens, root; one row). Writing encodes each text once and
moves chunk bytes once, to bring equal digests together; a task sends a chunk's bytes once, however often it meets it.

Encoding looks up pieces of words that a worker has met before, where the tokenizer's own file shows that the ids of a
text are those of its pieces in turn (``piecewise``); any other tokenizer gets whole texts.

Defined cases: null or empty text is the end id alone; rows are in the order of (id, text), nulls last; repeated rows
are documents of their own with the same chunks; a text longer than a slice is encoded in parts cut at white space; an
empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import keys
from . import textvec as tv

#: Ids that the rolling hash sees, mean and greatest length of a chunk.
ROLLING, MEAN, GREATEST = 8, 512, 4096
#: Pieces that a worker's cache holds before it starts anew; each takes about 50 bytes.
CACHE_PIECES = 1 << 20
#: Digests that a task remembers so as not to send their bytes again; each takes about 100 bytes.
RECENT_CHUNKS = 100_000

# How a tokenizer file says that it lower-cases, drops white space and cuts words into runs of letters,
# single digits and runs of other characters, each of which is a word to its merges.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Kinds of bytes. ODD ones make their word one piece that the tokenizer gets as it is.
BLANK, LETTER, DIGIT, MARK, ODD = range(5)


def _kinds() -> np.ndarray:
    table = np.full(256, ODD, np.uint8)
    for b in range(0x21, 0x7F):
        c = chr(b)
        table[b] = LETTER if c.isalpha() else DIGIT if c.isdigit() else ODD if c in "'<" else MARK
    table[tv.SPACE] = BLANK
    return table


_KIND = _kinds()


def piecewise(spec: str) -> bool:
    """Whether ids of a text are those of its pieces in turn, by what the tokenizer's file declares.

    Contractions need an apostrophe and added tokens a ``<``; words with either are pieces as they are.
    """
    x = json.loads(spec)
    model, normalizer, pre = x["model"], x.get("normalizer") or {}, x.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [])
    return (
        normalizer.get("type") == "Sequence" and normalizer.get("normalizers") == _NORMALIZERS
        and len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": _SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
        and steps[1].get("type") == "ByteLevel" and steps[1].get("add_prefix_space") is False and steps[1].get("use_regex") is False
        and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("continuing_subword_prefix")
        and not x.get("truncation") and not x.get("padding")
        and all("<" in t["content"] and not any(c.isspace() for c in t["content"]) for t in x.get("added_tokens", []))
    )


class _Grown:
    """Array that doubles its room."""

    def __init__(self, kind):
        self._room, self._n = np.zeros(1024, kind), 0

    def __len__(self) -> int:
        return self._n

    def extend(self, values) -> None:
        n = self._n + len(values)
        if n > len(self._room):
            self._room = np.concatenate([self._room[: self._n], np.zeros(max(n, 2 * self._n) - self._n, self._room.dtype)])
        self._room[self._n : n] = values
        self._n = n

    def values(self) -> np.ndarray:
        return self._room[: self._n]


def pieces_of(texts: tv.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, odd) of the pieces of a slice: lower-cased runs of one kind, and odd words as they are.

    Letters are those of ASCII and the Latin-1 block, whose lower case is one bit away.
    """
    data, kind = texts.data, _KIND[texts.data]
    lead = np.flatnonzero(data == 0xC3)
    after = data[lead + 1]
    letter = (after != 0x97) & (after != 0xB7)
    low = tv.LOWER[data]
    low[lead[letter & (after <= 0x9E)] + 1] += 0x20
    kind[lead[letter]] = kind[lead[letter] + 1] = LETTER
    starts, ends, _ = tv.words(texts)
    begin = np.ones(len(data), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begin &= kind != BLANK
    begin[starts] = True
    strange = np.concatenate([[0], np.cumsum(kind == ODD)])
    odd_word = np.flatnonzero(strange[ends] > strange[starts])
    inside = tv.ranges(starts[odd_word], (ends - starts)[odd_word])
    low[inside] = data[inside]
    begin[inside] = False
    begin[starts[odd_word]] = True
    at = np.flatnonzero(begin)
    word = np.searchsorted(starts, at, "right") - 1
    return low, at, np.minimum(np.append(at[1:], len(data)), ends[word]) if len(at) else at, strange[ends[word]] > strange[starts[word]]


class PieceEncoder:
    """Ids of texts by way of their pieces; remembers pieces by 128-bit hash, in bounded memory."""

    def __init__(self, spec: str, whole_texts: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(spec)
        self.size = self.tokenizer.get_vocab_size()
        self.whole = whole_texts or not piecewise(spec)
        if not self.whole:
            # Pieces come lower-cased and cut already, so blanks part them.
            self.plain = Tokenizer.from_str(spec)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.array([t.endswith("</w>") for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])])
            self.reset()

    def reset(self) -> None:
        self.hashes, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # ascending hashes with their codes
        self.second, self.start, self.length, self.pool = _Grown(np.uint64), _Grown(np.int64), _Grown(np.int32), _Grown(np.uint32)

    def _add(self, second: np.ndarray, ids, ends: np.ndarray) -> None:
        begins = np.concatenate([[0], ends[:-1]])
        self.second.extend(second)
        self.start.extend(len(self.pool) + begins)
        self.length.extend(ends - begins)
        self.pool.extend(ids)

    def _add_each(self, pieces: list[str], second: np.ndarray) -> None:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        self._add(second, [t for x in lists for t in x], np.cumsum([len(x) for x in lists]))

    def _learn(self, pieces: list[bytes], odd: np.ndarray, second: np.ndarray) -> np.ndarray:
        """New codes for the pieces; end-of-word marks tell the ids of plain ones apart."""
        codes, base = np.empty(len(pieces), np.int32), len(self.second)
        order = np.argsort(odd, kind="stable")
        codes[order] = np.arange(base, base + len(pieces))
        plain, strange = order[: len(pieces) - int(odd.sum())], order[len(pieces) - int(odd.sum()) :]
        for at in range(0, len(plain), 4000):
            some = plain[at : at + 4000]
            ids = self.plain.encode_batch_fast([b" ".join([pieces[i] for i in some]).decode("utf-8", "replace")], add_special_tokens=False)[0].ids
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                self._add(second[some], ids, ends)
            else:
                self._add_each([pieces[i].decode("utf-8", "replace") for i in some], second[some])
        if len(strange):
            self._add_each([pieces[i].decode("utf-8", "replace") for i in strange], second[strange])
        return codes

    def _codes(self, low: np.ndarray, at: np.ndarray, to: np.ndarray, odd: np.ndarray) -> np.ndarray:
        if len(self.hashes) > CACHE_PIECES:
            self.reset()
        one, two = (tv.span_hashes(low, at, to, s) for s in (0, 1))
        value, first, inverse = np.unique(one, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, value)
        known = np.zeros(len(value), bool)
        inner = place < len(self.hashes)
        known[inner] = self.hashes[place[inner]] == value[inner]
        fresh = np.flatnonzero(~known)
        raw = low.tobytes()
        if len(fresh):
            f = first[fresh]
            codes = self._learn([raw[s:e] for s, e in zip(at[f].tolist(), to[f].tolist(), strict=True)], odd[f], two[f])
            self.hashes, self.codes = np.insert(self.hashes, place[fresh], value[fresh]), np.insert(self.codes, place[fresh], codes)
            place = np.searchsorted(self.hashes, value)
        code = self.codes[place][inverse]
        for i in np.flatnonzero(self.second.values()[code] != two).tolist():  # another piece of the same 64 bits
            code[i] = len(self.second)
            self._add_each([raw[at[i] : to[i]].decode("utf-8", "replace")], two[i : i + 1])
        return code

    def encode(self, texts: tv.Texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by ``end_id``, and their offsets)."""
        if self.whole:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([texts.text(i).decode("utf-8", "replace") for i in range(len(texts))], add_special_tokens=False)]
            offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lists])]).astype(np.int64)
            return np.array([t for x in lists for t in [*x, end_id]], np.uint32), offsets
        if len(texts) == 1 and len(texts.data) > 2 * tv.SLICE_BYTES:
            parts = [self._encode_slice(part, end_id)[0][:-1] for part in tv.cut_at(texts.data, tv.SPACE, tv.SLICE_BYTES)]
            ids = np.concatenate([*parts, np.array([end_id], np.uint32)])
            return ids, np.array([0, len(ids)])
        return self._encode_slice(texts, end_id)

    def _encode_slice(self, texts: tv.Texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        low, at, to, odd = pieces_of(texts)
        code = self._codes(low, at, to, odd)
        length, start = self.length.values()[code].astype(np.int64), self.start.values()[code]
        first = np.searchsorted(at, texts.offsets)
        sums = np.concatenate([[0], np.cumsum(length)])
        offsets = np.concatenate([[0], np.cumsum(sums[first[1:]] - sums[first[:-1]] + 1)])
        ids = np.full(int(offsets[-1]), end_id, np.uint32)
        body = np.ones(len(ids), bool)
        body[offsets[1:] - 1] = False
        ids[body] = self.pool.values()[tv.ranges(start, length)]
        return ids, offsets


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(spec: str, whole_texts: bool) -> PieceEncoder:
    """This worker's encoder for a tokenizer: later tasks of the worker find its pieces learnt."""
    key = (hashlib.sha256(spec.encode()).digest(), whole_texts)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(spec, whole_texts)
    return _ENCODERS[key]


def cuts(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks, ascending: where the rolling hash says so, at document ends, and after GREATEST ids."""
    rolled = tv.windows(tv.mix(ids.astype(np.uint64) + np.uint64(1)), ROLLING)
    ends = np.unique(np.concatenate([offsets[1:], np.flatnonzero(rolled % np.uint64(MEAN) == 0) + ROLLING]))
    ends = ends[ends > 0]
    # A window that reaches over a document's start must not decide: equal documents are to be cut alike.
    begin = offsets[:-1][np.searchsorted(offsets, ends, "left") - 1]
    ends = ends[(ends - begin >= ROLLING) | np.isin(ends, offsets[1:])]
    starts = np.concatenate([[0], ends[:-1]])
    more = (ends - starts - 1) // GREATEST
    return np.unique(np.concatenate([ends, np.repeat(starts, more) + GREATEST * (tv.ranges(np.zeros(len(more), np.int64), more) + 1)]))


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; an odd node moves up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_POLYNOMIAL = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2) modulo the CRC-32 polynomial, bit-reflected."""
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    b = np.broadcast_to(b, out.shape).astype(np.uint32)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ _POLYNOMIAL, b >> np.uint32(1))
    return out


def crc_shift(crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to that of a text in which ``n_bytes`` bytes follow it."""
    power = np.full(len(crcs), 1 << 31, np.uint32)
    square = np.array([1 << 23], np.uint32)  # x**8
    left = n_bytes.astype(np.int64)
    while (left > 0).any():
        odd = np.flatnonzero(left & 1)
        power[odd] = _times(power[odd], square)
        square = _times(square, square)
        left = left >> 1
    return _times(crcs.astype(np.uint32), power)


_PIECE = "kind string, key binary, n long, j long, id long, data binary, digests array<binary>, lengths array<long>, root binary"
_MANIFEST = "part int, documents long, tokens long, root binary"


def _manifests(recipes: DataFrame) -> DataFrame:
    """The manifest of every part of ``recipes`` (part, j, n_tokens, root), in constant memory but for one root a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, tokens, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = held.setdefault(part, [0, 0, []])
                x[0], x[1] = x[0] + 1, x[1] + tokens
                x[2].append(root)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.int32()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1] for x in held.values()], pa.int64()), pa.array([merkle(x[2]) for x in held.values()], pa.binary())], names=["part", "documents", "tokens", "root"]
        )

    return recipes.select("part", "j", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "j").select("part", "n_tokens", "root").mapInArrow(run, _MANIFEST)


def _store_root(manifests: DataFrame) -> DataFrame:
    """One row over all manifests: a few dozen bytes for each part."""
    listed = manifests.agg(F.count("*").alias("parts"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.sort_array(F.collect_list(F.struct("part", "root"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([merkle([y["root"] for y in x]) for x in batch.column(3).to_pylist()], pa.binary())], names=["parts", "documents", "tokens", "root"])

    return listed.mapInArrow(run, "parts long, documents long, tokens long, root binary")


def write_store(spark: SparkSession, documents: DataFrame, path: str, spec: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", whole_texts: bool = False) -> None:
    """Encode every text with the tokenizer whose JSON is ``spec`` and write the store to ``path``."""
    shared = spark.sparkContext.broadcast(spec)  # a vocabulary file, a few MB

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value, whole_texts)
        width = np.dtype("<u2") if max(coder.size - 1, end_id) < 1 << 16 else np.dtype("<u4")
        met: set[bytes] = set()
        for batch in batches:
            for at, texts in tv.slices(batch.column(2)):
                ids, offsets = coder.encode(texts, end_id)
                ends = cuts(ids, offsets)
                starts = np.concatenate([[0], ends[:-1]])
                raw = ids.astype(width).tobytes()
                data = [raw[s:e] for s, e in zip((starts * width.itemsize).tolist(), (ends * width.itemsize).tolist(), strict=True)]
                digests = [hashlib.blake2b(x, digest_size=16).digest() for x in data]
                if len(met) > RECENT_CHUNKS:
                    met.clear()
                fresh = [i for i, d in enumerate(digests) if d not in met and not met.add(d)]
                k, m = len(texts), len(fresh)
                if m:
                    none = pa.nulls(m, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(["chunk"] * m), pa.array([digests[i] for i in fresh], pa.binary()), pa.array((ends - starts)[fresh]), none, none, pa.array([data[i] for i in fresh], pa.binary()), pa.nulls(m, pa.list_(pa.binary())), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.binary())],
                        names=names,
                    )
                first = np.searchsorted(starts, offsets)  # every document has a chunk, of its end id at least
                j = batch.column(0).slice(at, k)
                lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), x) for x in (pa.array(digests, pa.binary()), pa.array(ends - starts))]
                roots = [merkle(digests[s:e]) for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                spread = [x.to_bytes(8, "little", signed=True) for x in j.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["recipe"] * k), pa.array(spread, pa.binary()), pa.array(np.diff(offsets)), j, batch.column(1).slice(at, k), pa.nulls(k, pa.binary()), *lists, pa.array(roots, pa.binary())], names=names
                )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key, each key's first."""
        last = None
        for batch in batches:
            key = batch.column(1).to_pylist()
            new = [d != e for d, e in zip(key, [last, *key[:-1]], strict=True)]
            last = key[-1] if key else last
            yield batch.filter(pa.array(new, pa.bool_()))

    names = ["kind", "key", "n", "j", "id", "data", "digests", "lengths", "root"]
    numbered = keys.shared_dir(spark)
    encoded = keys.keyed(spark, documents, id_col, text_col, numbered).select("j", "id", "text").mapInArrow(tv.released(encode), _PIECE)
    encoded.repartition("key").sortWithinPartitions("kind", "key").mapInArrow(once, _PIECE).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/pieces")
    keys.discard(spark, numbered)

    recipes = spark.read.schema(_PIECE).parquet(f"{path}/pieces").filter("kind = 'recipe'").select("j", "id", F.col("n").alias("n_tokens"), "digests", "lengths", "root")
    ordered = keys.shared_dir(spark)
    parts = keys.stored(spark, recipes.repartitionByRange("j").sortWithinPartitions("j").withColumn("part", F.spark_partition_id()), ordered)
    sums = parts.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = sums.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a part
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("start", F.col("base") + F.col("inside"))
    placed.select("j", "id", "start", "n_tokens", "digests", "lengths", "root", "part").write.parquet(f"{path}/recipes")
    keys.discard(spark, ordered)
    _manifests(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    _store_root(spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")).write.parquet(f"{path}/store")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_PIECE).parquet(f"{path}/pieces").filter("kind = 'chunk'").select(F.col("key").alias("digest"), "n", "data")


def _wide(data: bytes, n: int) -> bytes:
    """A chunk's ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(data, f"<u{len(data) // n}").astype("<u4").tobytes()


def verify_manifests(spark: SparkSession, path: str) -> None:
    """Raise unless every part's documents make the root of its manifest, and the manifests that of the store."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    names = ["documents", "tokens", "root"]
    found = _manifests(spark.read.parquet(f"{path}/recipes")).select("part", *(F.col(c).alias(f"found_{c}") for c in names))
    differs = F.lit(False)
    for c in names:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"found_{c}"))
    wrong = [r["part"] for r in found.join(manifest, "part", "full").filter(differs).select("part").limit(10).collect()]
    if wrong:
        raise ValueError(f"parts {wrong} do not match their manifests")
    if [tuple(r) for r in _store_root(manifest).collect()] != [tuple(r) for r in spark.read.parquet(f"{path}/store").limit(2).collect()]:
        raise ValueError("the manifests do not match the store's root")


def verified_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files; a broken chunk, recipe or manifest raises.

    Bytes stay where they are read: the CRC of a document is composed of its chunks' CRCs.
    """
    verify_manifests(spark, path)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for digest, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hashlib.blake2b(data, digest_size=16).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} does not match its digest")
                crcs.append(zlib.crc32(_wide(data, n)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ordered = [sorted(x, key=lambda y: y["i"]) for x in batch.column(5).to_pylist()]
            for want, root, n_tokens, x in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_pylist(), ordered, strict=True):
                if len(x) != want or merkle([y["digest"] for y in x]) != root or sum(y["n"] for y in x) != n_tokens:
                    raise ValueError("a document does not match its Merkle root")
            counts = np.array([len(x) for x in ordered])
            n = np.array([y["n"] for x in ordered for y in x], np.int64)
            crc = np.array([y["crc"] for x in ordered for y in x], np.int64)
            first = np.concatenate([[0], np.cumsum(counts)])
            sums = np.concatenate([[0], np.cumsum(n)])
            after = np.repeat(sums[first[1:]], counts) - sums[1:]
            share = crc_shift(crc, 4 * after)
            whole = np.bitwise_xor.reduceat(share, first[:-1]) if len(ordered) else np.zeros(0, np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(whole.astype(np.int64))], names=["id", "start", "n_tokens", "ids_crc32"])

    recipes = spark.read.parquet(f"{path}/recipes")
    places = recipes.select("j", F.posexplode("digests").alias("i", "digest"))
    # Left, so that a document whose chunk is lost is still composed, and raises.
    met = places.join(_chunks(spark, path).mapInArrow(check, "digest binary, n long, crc long"), "digest", "left").groupBy("j").agg(F.collect_list(F.struct("i", "digest", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"))).alias("x"))
    joined = recipes.select("j", "id", "start", "n_tokens", "root", F.size("digests").alias("k")).join(met, "j")
    return joined.select("id", "start", "n_tokens", "root", "k", "x").mapInArrow(compose, "id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(j, id, start, ids) of every document, its chunks put together again in order."""
    recipes = spark.read.parquet(f"{path}/recipes")
    places = recipes.select("j", "id", "start", F.posexplode("digests").alias("i", "digest"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [np.frombuffer(b"".join(_wide(y["data"], y["n"]) for y in sorted(x, key=lambda y: y["i"])), "<u4") for x in batch.column(3).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in whole])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *whole]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ids], names=["j", "id", "start", "ids"])

    met = places.join(_chunks(spark, path), "digest").groupBy("j", "id", "start").agg(F.collect_list(F.struct("i", "n", "data")).alias("x"))
    return met.mapInArrow(rebuild, "j long, id long, start long, ids array<long>")


def tokenizer_spec(name: str = "word_bpe_49k.json") -> str:
    """JSON of a public tokenizer, read by the driver from the installed vocabulary files."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


def encode_documents(spark: SparkSession, documents: DataFrame, *, spec: str | None = None, end_id: int = 1) -> DataFrame:
    """Write ``documents`` to a new store in the shared folder and return what reading it back gives."""
    path = keys.shared_dir(spark)
    write_store(spark, documents, path, spec or tokenizer_spec(), end_id=end_id)
    return verified_documents(spark, path).withColumnRenamed("id", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
