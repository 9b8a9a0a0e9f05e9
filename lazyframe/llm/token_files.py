"""Raw token-id files with a minimal perfect hash index from document key to place.

A shard is three files in the shared folder: ``<n>.ids`` holds the ids of its documents
one after the other and nothing else (16-bit little-endian where the vocabulary allows,
else 32-bit); ``<n>.off`` in 64-bit integers a mark, the bytes an id has, how many rows
have no key (they come first), and then the first id of each row and the end;
``<n>.mph`` a minimal perfect hash from key to row with a 32-bit fingerprint a key. Any
64-bit integer may be a key.
The hash is a cascade of bit arrays (as in BBHash, Limasset et al. 2017): a key that is
alone at its bit stays there, the others go on to the next array, and the rank of a bit
is the key's number. A lookup reads a few words, whatever the size.
"""

from __future__ import annotations

import bisect
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, fresh, mixed, partitions, pieces, texts, work, written

VOCABULARY = "word_bpe_49k.json"
END = 2
#: The first number of an offsets file.
MARK = 0x5344494E454B4F54


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys; ``values`` holds a number for each key.

    ``lookup`` gives the value, or -1 where the fingerprint says that the key is foreign
    (a foreign key passes with a chance of 2**-32).
    """

    SPREAD = 2.0

    def __init__(self, sizes: np.ndarray, words: np.ndarray, prints: np.ndarray, values: np.ndarray):
        self.sizes, self.words, self.prints, self.values = sizes, words, prints, values
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @staticmethod
    def _hash(keys: np.ndarray, level: int) -> np.ndarray:
        return mixed(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> PerfectHash:
        left, sizes, bits, level = keys.astype(np.int64).view(np.uint64), [], [], 0
        while len(left):
            size = -(-int(len(left) * cls.SPREAD + 1) // 64) * 64
            at = (cls._hash(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
            level += 1
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        words = np.packbits(flat, bitorder="little").view(np.uint64) if len(flat) else np.zeros(0, np.uint64)
        made = cls(np.array(sizes, np.int64), words, np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64))
        if len(keys):
            n = made._number(keys.astype(np.int64).view(np.uint64))
            made.prints[n] = cls._print(keys.astype(np.int64).view(np.uint64))
            made.values[n] = values
        return made

    @classmethod
    def _print(cls, keys: np.ndarray) -> np.ndarray:
        return (cls._hash(keys, 1000) >> np.uint64(32)).astype(np.uint32)

    def _number(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = (self._hash(keys[open_], level) % np.uint64(size)).astype(np.int64) + self.first[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = self.before[word[hit]] + below
            open_ = open_[~hit]
        return out

    def lookup(self, keys) -> np.ndarray:
        keys = np.asarray(keys, np.int64).view(np.uint64)
        n = self._number(keys)
        if not len(self.values):
            return np.full(len(keys), -1, np.int64)
        good = (n >= 0) & (self.prints[n] == self._print(keys))
        return np.where(good, self.values[n], -1)

    def dump(self) -> bytes:
        return struct.pack("<qqq", len(self.sizes), len(self.words), len(self.values)) + self.sizes.tobytes() + self.words.tobytes() + self.values.tobytes() + self.prints.tobytes()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        levels, words, n = struct.unpack_from("<qqq", data)
        at, parts = 24, []
        for kind, count in ((np.int64, levels), (np.uint64, words), (np.int64, n), (np.uint32, n)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += np.dtype(kind).itemsize * count
        return cls(parts[0], parts[1], parts[3], parts[2])


#: The parts of a tokenizer file that drop blanks, join nothing across them, lower letters and use the byte alphabet.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def parts_at_blanks(tokenizer) -> bool:
    """Whether the tokenizer's own file says that texts may be encoded word by word, and words of Latin-1 letters by the merges alone."""
    told = json.loads(tokenizer.to_str())
    added = [t for t in told.get("added_tokens") or [] if t["content"].isalpha() or t["lstrip"] or t["rstrip"] or t["normalized"] or any(c.isspace() for c in t["content"])]
    return not added and told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == PRE_TOKENIZER and told["post_processor"] is None and told["truncation"] is None and told["padding"] is None and told["model"]["type"] == "BPE" and not told["model"]["dropout"]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


class _Words(dict):
    """Ids (as bytes) of texts without blanks, by the tokenizers library; kept up to a bound.

    Where the tokenizer's file allows it (``parts_at_blanks``), texts are cut at blanks, and
    a word of Latin-1 letters, which needs no more than lower case and the byte alphabet
    before the library's merges, goes straight to them; any other word, and with any other
    tokenizer the whole text, goes through the library.
    """

    def __init__(self, tokenizer, kind: str, most: int = 700_000):
        super().__init__()
        self.tokenizer, self.kind, self.most, self.letters = tokenizer, kind, most, _byte_letters()
        self.model, self.by_words = tokenizer.model, parts_at_blanks(tokenizer)
        self.code = {2: "H", 4: "I"}[np.dtype(kind).itemsize]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        end = word[-1:]
        ended = end == "." or end == ","
        core = word[:-1] if ended else word
        if not core.isalpha():
            return self._whole(word)
        if core.isascii():  # the byte alphabet leaves these letters as they are
            core = core.lower()
            if core != word:  # the bare word is likely known
                return self[core] + self[end] if ended else self[core]
        else:
            try:
                core.encode("latin-1")
            except UnicodeEncodeError:
                return self._whole(word)
            core = core.lower().encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(core)]
        got = struct.pack(f"<{len(ids)}{self.code}", *ids)
        return got + self[end] if ended else got

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        got = self[word] = self._word(word)
        return got

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _split(text))) if self.by_words else self._whole(text)


_TOKENIZERS: dict = {}


def _forget() -> None:
    _TOKENIZERS.clear()


def _words(path: str, kind: str) -> _Words:
    if (path, kind) not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path, kind] = _Words(Tokenizer.from_file(path), kind)
    return _TOKENIZERS[path, kind]


def _put(store, at: str, data: bytes) -> None:
    """Whole or not at all: a task that runs twice replaces the file by the same bytes."""
    name = f"{at}.{np.random.default_rng().integers(1 << 62):x}"
    with store.open_output_stream(name) as f:
        f.write(data)
    store.move(name, at)


def _get(uri: str) -> bytes:
    store, at = arrow_fs.FileSystem.from_uri(uri)
    with store.open_input_stream(at) as f:
        return f.read()


def write_token_files(docs: DataFrame, to: str, tokenizer: str | None = None, end_id: int = END, shards: int | None = None) -> DataFrame:
    """Encodes every row's whole text and writes the shards to ``to`` (a URI that all executors reach).

    Rows go by range of doc_id (nulls first), and of a hash of the text among equal ids, to
    shards and lie there in ascending order; one range exchange of the texts. An id that very
    many rows have spreads over shards. Returns a table of rows (doc_id, occurrence, shard,
    n_tokens), kept in the shared folder. Rows with the same id lie next to each other and
    are told apart by shard and ``occurrence``. Null texts count as empty: only the end id;
    other columns are left aside. An empty table writes nothing. Texts are encoded word by
    word only where the tokenizer drops blanks and never joins across them.
    """
    from tokenizers import Tokenizer

    path = tokenizer or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    kind = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"

    @work("token-files", _forget)
    def run(batches):
        from pyspark import TaskContext

        schema = pa.schema([("doc_id", pa.int64()), ("occurrence", pa.int64()), ("shard", pa.int64()), ("n_tokens", pa.int64())])
        shard = TaskContext.get().partitionId()
        store, folder = arrow_fs.FileSystem.from_uri(to)
        words, end = _words(path, kind), np.array([end_id], kind).tobytes()
        width, counts, keys, nulls, name = np.dtype(kind).itemsize, [], [], 0, f"{folder}/{shard}.ids.{np.random.default_rng().integers(1 << 62):x}"
        out = None
        for x in pieces(batches, 1000):
            if out is None:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(name)
            nulls += x.column(0).null_count
            keys.append(x.column(0).drop_null().to_numpy(zero_copy_only=False))
            for text in texts(x.column(1)):
                data = words.encode(text)
                out.write(data)
                out.write(end)
                counts.append(len(data) // width + 1)
        if out is None:
            return
        out.close()
        store.move(name, f"{folder}/{shard}.ids")
        key, n = np.concatenate(keys), np.array(counts, np.int64)
        row = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        _put(store, f"{folder}/{shard}.off", np.concatenate([[MARK, width, nulls, 0], np.cumsum(n)]).astype("<i8").tobytes())
        _put(store, f"{folder}/{shard}.mph", PerfectHash.build(key[row], row + nulls).dump())
        occurrence = np.concatenate([np.arange(nulls), np.arange(len(key)) - np.repeat(row, np.diff(np.concatenate([row, [len(key)]])))])
        yield batch(schema, pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(key, pa.int64())]), occurrence, np.full(len(n), shard), n)

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    n = shards or partitions(spark, d)
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = d.repartitionByRange(n, *by).sortWithinPartitions(*by, "text")
    return written(dealt.mapInArrow(run, "doc_id long, occurrence long, shard long, n_tokens long"), "token-rows")


def _split(text: str) -> list[str]:
    """At spaces and line ends only, which any tokenizer of this kind takes for blanks."""
    return text.replace("\n", " ").split(" ")


class _Shard:
    """The index and offsets of one shard, and its ids if asked for."""

    def __init__(self, at: str, shard: int, ids: bool = False):
        head = np.frombuffer(_get(f"{at}/{shard}.off"), "<i8")
        if len(head) < 4 or head[0] != MARK:
            raise ValueError(f"{at}/{shard}.off is no offsets file")
        self.kind, self.nulls, self.offsets = f"<u{head[1]}", int(head[2]), head[3:]
        self.index = PerfectHash.load(_get(f"{at}/{shard}.mph"))
        self.ids = np.frombuffer(_get(f"{at}/{shard}.ids"), self.kind) if ids else None

    def row(self, keys: pa.Array) -> np.ndarray:
        """The first row of each key, -1 where there is none."""
        out = self.index.lookup(keys.fill_null(0).to_numpy(zero_copy_only=False))
        return np.where(keys.is_null().to_numpy(zero_copy_only=False), 0 if self.nulls else -1, out)


def read_token_files(rows: DataFrame, at: str) -> DataFrame:
    """Reads each row of ``rows`` (doc_id, occurrence, shard) by its key from the files in ``at``.

    Returns doc_id, start, n_tokens, ids_crc32. ``start`` counts the ids before the row over
    all shards; the shards' totals, one number a shard, are all that the driver gathers.
    """
    spark: SparkSession = rows.sparkSession
    totals = {r[0]: r[1] for r in rows.groupBy("shard").agg(F.sum("n_tokens")).collect()}
    before, start = 0, {}
    for shard in sorted(totals):
        start[shard] = before
        before += totals[shard]

    @work("token-files", _forget)
    def run(batches):
        open_, held = None, None
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for x in batches:
            shards = x.column(2).to_numpy(zero_copy_only=False)
            keys = x.column(0)
            out_start, out_n, out_crc = (np.zeros(len(keys), np.int64) for _ in range(3))
            for shard in np.unique(shards):
                mine = np.flatnonzero(shards == shard)
                if shard != open_:
                    held, open_ = _Shard(at, shard, True), shard
                offsets, ids = held.offsets, held.ids
                row = held.row(keys.take(pa.array(mine)))
                if (row < 0).any():
                    raise ValueError(f"shard {shard} lacks a key that was written to it")
                row = row + x.column(1).to_numpy(zero_copy_only=False)[mine]
                out_start[mine], out_n[mine] = offsets[row] + start[int(shard)], offsets[row + 1] - offsets[row]
                out_crc[mine] = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[row], offsets[row + 1], strict=True)]
            yield batch(schema, x.column(0), out_start, out_n, out_crc)

    dealt = rows.select("doc_id", "occurrence", "shard").repartition(max(len(totals), 1), "shard").sortWithinPartitions("shard", "doc_id")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


class TokenStore:
    """Keyed access from one process: the shard by the ranges of ids, then the hash, two offsets and one range read."""

    def __init__(self, rows: DataFrame, at: str):
        ranges = rows.groupBy("shard").agg(F.max("doc_id")).orderBy("shard").collect()  # one row a shard
        self.at, self.open = at, {}
        self.shards = [r[0] for r in ranges]
        self.last = [-(1 << 63) if r[1] is None else r[1] for r in ranges]  # ascending; a shard of null ids only comes first

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first row with this id, or None."""
        if not self.shards:
            return None
        k = 0 if doc_id is None else bisect.bisect_left(self.last, doc_id)
        while k < len(self.shards):
            shard = self.shards[k]
            if shard not in self.open:
                self.open[shard] = _Shard(self.at, shard)
            held = self.open[shard]
            row = int(held.row(pa.array([doc_id], pa.int64()))[0])
            if row >= 0:
                store, path = arrow_fs.FileSystem.from_uri(f"{self.at}/{shard}.ids")
                a, b, width = int(held.offsets[row]), int(held.offsets[row + 1]), np.dtype(held.kind).itemsize
                with store.open_input_file(path) as f:
                    return np.frombuffer(f.read_at((b - a) * width, a * width), held.kind)
            if doc_id is None or self.last[k] > doc_id or self.last[k] == self.last[-1]:
                return None
            k += 1  # only shards of null ids end in the least integer without holding it
        return None


def token_files(docs: DataFrame) -> DataFrame:
    """Writes the files of ``docs`` to a fresh folder and returns what reading them back by key gives."""
    at = fresh(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, at), at)
