"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A vocabulary file of ranks (base64 token and rank on each line) is read on the driver, turned into the
library's byte-level form (every byte stands for one printable character) and shipped to the workers.
Ids are those of the ranks. Offsets are rebuilt from the byte lengths of the tokens, so a token that
ends inside a character is seen as such: its end is rounded up to the character that it splits.

Decoding reverses the byte table and joins the bytes of all tokens before it reads them as UTF-8, so
characters that are split over tokens come back whole; ``errors="replace"`` is for cut id lists only.

Each match of the pattern is encoded by itself. Texts repeat few different matches, so a worker keeps the
ids of those it has met (a bounded memory) and the library gets each new match once in a batch.

Defined cases: null text is the empty text (no tokens); null doc_id and repeated rows are kept as they
are; ids out of the vocabulary raise; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

#: Matches whose ids a worker keeps; it starts anew beyond that.
KEPT = 800_000


def byte_characters() -> list[str]:
    """The printable character for each byte: printable Latin-1 stands for itself, the rest from 256 up."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a rank file."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def merges_of(tokens: list[bytes]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token of more than one byte: what its bytes become under earlier ranks."""
    rank = {t: i for i, t in enumerate(tokens)}
    out = []
    for at, token in enumerate(tokens):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], at))
            if rank.get(parts[best] + parts[best + 1], at) >= at:
                raise ValueError(f"rank {at} can't be reached from earlier ranks")
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        out.append((parts[0], parts[1]))
    return out


def tokenizer_json(tokens: list[bytes]) -> str:
    """The library's definition of a byte-level BPE with these ranks; what it gets is one match, never split again."""
    char = byte_characters()
    name = ["".join(char[b] for b in t) for t in tokens]
    text = lambda t: "".join(char[b] for b in t)
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
                  "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
                  "vocab": {n: i for i, n in enumerate(name)}, "merges": [[text(a), text(b)] for a, b in merges_of(tokens)]}})


def byte_of_character() -> np.ndarray:
    """The byte table reversed: the byte for the number of each of its characters."""
    out = np.zeros(512, dtype=np.uint8)
    for b, c in enumerate(byte_characters()):
        out[ord(c)] = b
    return out


BYTE_OF = byte_of_character()


class Codec:
    """Encoder and decoder of one vocabulary; picklable, the library's object is made in each worker."""

    def __init__(self, path: str, pattern: str) -> None:
        self.tokens = read_ranks(path)
        self.pattern = pattern
        self.definition = tokenizer_json(self.tokens)
        char = byte_characters()
        self.names = ["".join(char[b] for b in t) for t in self.tokens]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        split, known, tok = _worker(self.definition, self.pattern)
        for text in texts:
            parts = split(text)
            new = set(parts).difference(known)
            if new:
                if len(known) + len(new) > KEPT:
                    known.clear()
                    new = set(parts)
                new = list(new)
                for part, e in zip(new, tok.encode_batch_fast(new, add_special_tokens=False), strict=True):
                    known[part] = np.array(e.ids, dtype="<u4").tobytes()
            yield np.frombuffer(b"".join(map(known.__getitem__, parts)), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a list of ids: the characters of their tokens, taken back through the byte table."""
        if len(ids) and int(ids.min()) < 0:
            raise IndexError("an id is out of the vocabulary")
        text = "".join(map(self.names.__getitem__, ids.tolist()))
        return BYTE_OF[np.frombuffer(text.encode("utf-16-le"), dtype="<u2")].tobytes()

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Start and end of each token in characters, and the number of tokens that end inside one."""
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ends = np.cumsum(_lengths(self.definition, self)[ids], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        inside = np.zeros(len(raw) + 1, dtype=bool)
        inside[: len(raw)] = (raw & 0xC0) == 0x80
        return heads[starts] - inside[starts], heads[ends], int(inside[ends].sum())


@lru_cache(maxsize=4)
def _worker(definition: str, pattern: str) -> tuple:
    """What one worker process keeps: the splitter, the ids of matches it has met, the library's encoder."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    import regex
    from tokenizers import Tokenizer

    return regex.compile(pattern).findall, {}, Tokenizer.from_str(definition)


_LENGTHS: dict[int, np.ndarray] = {}


def _lengths(definition: str, codec: Codec) -> np.ndarray:
    key = hash(definition)
    if key not in _LENGTHS:
        _LENGTHS[key] = np.array([len(t) for t in codec.tokens], dtype=np.int64)
    return _LENGTHS[key]


def _run(docs: DataFrame, codec: Codec, schema: str, row) -> DataFrame:  # noqa: ANN001
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(codec)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = [row(own, t, ids) for t, ids in zip(texts, own.encode(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * len(row.kinds), row.kinds, strict=True))], names=["doc_id", *row.names])

    return docs.select("doc_id", "text").mapInArrow(work, schema)


class _Full:
    names = ("ids", "starts", "ends", "n_split")
    kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())

    def __call__(self, codec: Codec, text: str, ids: np.ndarray) -> tuple:
        starts, ends, split = codec.offsets(text, ids)
        return ids.astype(np.int32), starts.astype(np.int32), ends.astype(np.int32), split


class _Digest:
    names = ("n_tokens", "ids_sha256", "decoded_sha256", "n_split")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())

    def __call__(self, codec: Codec, text: str, ids: np.ndarray) -> tuple:
        back = codec.decode(ids)
        split = codec.offsets(text, ids)[2]
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), split


def encode(docs: DataFrame, codec: Codec) -> DataFrame:
    """``doc_id``, token ``ids``, their ``starts`` and ``ends`` in characters, ``n_split`` tokens that end inside one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _run(docs, codec, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>, n_split long", _Full())


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``ids``; null ids are none."""
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(codec)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [shared.value.decode(np.array(x or [], dtype=np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, codec: Codec) -> DataFrame:
    """Encode and decode every text and keep only the digests of both."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _run(docs, codec, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long", _Digest())


class _Checked(_Digest):
    names = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    kinds = (pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string())

    def __call__(self, codec: Codec, text: str, ids: np.ndarray) -> tuple:
        back = codec.decode(ids)
        return ids.astype(np.int32), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()


def encode_checked(docs: DataFrame, codec: Codec) -> DataFrame:
    """``doc_id``, token ``ids``, their number, and digests of the ids and of the decoded bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _run(docs, codec, f"doc_id {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string", _Checked())


def public_codec() -> Codec:
    """The 50k byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_codec())
