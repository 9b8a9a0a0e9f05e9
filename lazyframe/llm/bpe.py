"""Byte-level BPE by longest matches and backtracking.

A token list is the one that the merges give exactly if each adjacent pair in it is
compatible: merging the pair's bytes alone stops at that pair. So an encoder may walk
the text once, take the longest token at each place, and step back to a shorter token
(or drop the last one) where the pair doesn't fit; places that lead nowhere are marked,
so each is left once and the work is linear in the text. The longest matches come from
an Aho-Corasick automaton over the vocabulary, whose bytes are read as Latin-1 letters.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import batch, pieces, texts, work

VOCABULARY = "byte_bpe_50k.tiktoken"


def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes by ``ranks``; ``pattern`` cuts the text into pieces that are encoded alone.

    ``most_pieces`` and ``most_pairs`` bound the memory of remembered pieces and of pairs whose
    compatibility is known; beyond it they are forgotten and found anew.
    """

    def __init__(self, vocabulary: dict[bytes, int], pattern: str, most_pieces: int = 200_000, most_pairs: int = 200_000):
        self.ids = vocabulary
        self.bytes_of = {i: b for b, i in vocabulary.items()}
        self.find = regex.compile(pattern).findall
        self.machine = ahocorasick.Automaton()
        for b, i in vocabulary.items():
            self.machine.add_word(b.decode("latin-1"), (i, len(b)))
        self.machine.make_automaton()
        self.by_text = {b.decode("latin-1"): i for b, i in vocabulary.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}  # by left * 2**32 + right
        self.most_pairs = most_pairs
        self.shorter: dict[int, int] = {}
        whole = {}
        self.bytes_by_name = {str(i): b for i, b in self.bytes_of.items()}
        for b, i in vocabulary.items():
            try:
                whole[b.decode()] = str(i)
            except UnicodeDecodeError:
                pass
        self.pieces = _Remembered(self, whole, most_pieces)

    def merged(self, data: bytes) -> list[bytes]:
        """The plain merge loop; used for the halves of a token, which are short."""
        parts = [data[i : i + 1] for i in range(len(data))]
        whole = self.ids.get(data)
        while len(parts) > 1:
            found = min(((r, k) for k in range(len(parts) - 1) if (r := self.ids.get(parts[k] + parts[k + 1])) is not None and r != whole), default=None)
            if found is None:
                break
            k = found[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def rest(self) -> None:
        """Lets go of remembered pieces and pairs; the vocabulary stays."""
        self.pieces.begin()
        self.fits = {}

    def half(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; of a single byte, twice itself."""
        got = self.halves.get(token)
        if got is None:
            parts = self.merged(self.bytes_of[token])
            got = self.halves[token] = (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else (token, token)
        return got

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both stops at just these two tokens.

        Undoes the later of the two merges again and again: on the seam between them no
        merge may exist that comes before the merges undone so far.
        """
        key = left << 32 | right
        got = self.fits.get(key)
        if got is not None:
            return got
        if len(self.fits) > self.most_pairs:
            self.fits.clear()
        before, a, b, bytes_of, ids = 1 << 62, left, right, self.bytes_of, self.ids
        while True:
            seam = ids.get(bytes_of[a] + bytes_of[b])
            if seam is not None and seam < before:
                got = False
                break
            a2, b2 = self.half(a)[1], self.half(b)[0]
            if a == a2 and b == b2:
                got = True
                break
            # the later merge is undone; of equal ones the right, as merges run from the left
            if b == b2 or (a != a2 and a > b):
                before, a = a, a2
            else:
                before, b = b + 1, b2
        self.fits[key] = got
        return got

    def prefix(self, token: int) -> int:
        """The longest token that begins ``token`` and isn't it; -1 for none."""
        got = self.shorter.get(token)
        if got is None:
            b = self.bytes_of[token]
            got = self.shorter[token] = next((self.ids[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.ids), -1)
        return got

    def encode_piece(self, data: bytes) -> list[int]:
        s = data.decode("latin-1")
        if s in self.by_text:
            return [self.by_text[s]]
        longest = [-1] * len(s)
        for end, (token, n) in self.machine.iter(s):  # for one start, later ends are longer tokens
            longest[end - n + 1] = token
        out: list[int] = []
        bytes_of, place, token = self.bytes_of, 0, longest[0]
        dead = bytearray(len(s) + 1)
        while place < len(s):
            if token < 0:  # nothing fits here: take back the last token
                dead[place] = 1
                token = out.pop()
                place -= len(bytes_of[token])
                token = self.prefix(token)
                continue
            end = place + len(bytes_of[token])
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                place = end
                token = longest[end] if end < len(s) else -1
            else:
                token = self.prefix(token)
        return out

    def encode_text(self, text: str) -> str:
        """The ids in decimal, joined by one space."""
        return " ".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str) -> tuple[str, list[int]]:
        """The ids joined by one space, and the ids."""
        joined = self.encode_text(text)
        return joined, list(map(int, joined.split()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_text(self, ids: list[str]) -> bytes:
        """The bytes of ids in decimal."""
        return b"".join(map(self.bytes_by_name.__getitem__, ids))


class _Remembered(dict):
    """The ids of a piece, joined by one space. Pieces that are one token stay; others are kept up to a bound."""

    def __init__(self, codec: Codec, whole: dict, most: int):
        super().__init__(whole)
        self.codec, self.whole, self.most = codec, whole, most + len(whole)

    def begin(self) -> None:
        self.clear()
        self.update(self.whole)

    def __missing__(self, piece: str):
        if len(self) > self.most:
            self.begin()
        got = self[piece] = " ".join(map(str, self.codec.encode_piece(piece.encode())))
        return got


_CODECS: dict[str, Codec] = {}


def _forget() -> None:
    _CODECS.clear()


def _rest() -> None:
    """More workers than tasks live on in turns, so only those at work remember pieces."""
    for coder in _CODECS.values():
        coder.rest()


def codec(path: str | None = None) -> Codec:
    """The codec of a vocabulary file, made once in a Python worker."""
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _CODECS:
        _CODECS[path] = Codec(ranks(path), public_tokenizers.PATTERN)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text.

    One narrow pass: no shuffle, memory bounded by an Arrow batch and the remembered
    pieces. Null texts count as empty (0 tokens, the hash of nothing); null ids, repeated
    rows and other columns are carried or left aside without effect; an empty table gives none.
    """

    @work("bpe", _forget, _rest)
    def run(batches):
        coder = codec(path)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        for x in pieces(batches, 1000):
            counts, ids_hash, text_hash = [], [], []
            for text in texts(x.column(1)):
                joined = coder.encode_text(text)
                ids = joined.split()
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                text_hash.append(hashlib.sha256(coder.decode_text(ids)).hexdigest())
            yield batch(schema, x.column(0).cast(pa.int64()), counts, ids_hash, text_hash)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids of every row's whole text as array<int>; nulls as in ``encode_documents``."""

    @work("bpe", _forget, _rest)
    def run(batches):
        coder = codec(path)
        for x in pieces(batches, 1000):
            yield batch(pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), x.column(0), [coder.encode(t)[1] for t in texts(x.column(1))])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes of ``ids``; null ids decode to no bytes, an id outside the vocabulary fails."""

    @work("bpe", _forget, _rest)
    def run(batches):
        coder = codec(path)
        for x in pieces(batches, 1000):
            yield batch(pa.schema([("doc_id", pa.int64()), ("data", pa.binary())]), x.column(0), [coder.decode(t or []) for t in x.column(1).to_pylist()])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
