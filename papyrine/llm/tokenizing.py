"""Encoding a corpus with a public byte-level tokenizer, over Arrow batches.

Defined results: a null text and an empty text both have the ids ``[]`` (offsets
``[]``), so every document keeps a row. Special-token strings inside a text are
ordinary text. Texts are encoded whole, whatever their length; extra columns are
dropped unless named as key; repeated rows stay repeated. Lone surrogates cannot
occur, since Spark strings are UTF-8.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"


@lru_cache(maxsize=4)
def load(name: str = TOKENIZER, folder: str = TOKENIZER_DIR):
    """The tokenizer of a worker process, read once from the shared folder."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{folder}/{name}.json")
    t.encode_special_tokens = True
    return t


def byte_of_symbol() -> dict[str, int]:
    """The byte each vocabulary symbol stands for: printable bytes are themselves, the rest follow from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


@lru_cache(maxsize=4)
def piece_bytes(name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> dict[int, bytes]:
    """Bytes of each id, from the reversed byte table. Added tokens are their own UTF-8."""
    back = byte_of_symbol()
    vocab = load(name, folder).get_vocab(with_added_tokens=True)
    return {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s, i in vocab.items()}


def decode_ids(ids: Iterable[int], name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> str:
    """Text of ids. A character split over ids is joined again; bytes that form none become U+FFFD."""
    table = piece_bytes(name, folder)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def decode_pieces(ids: Sequence[int], name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> list[str]:
    """Text each id completes: of a character split over ids the last one gets it, the others get ''."""
    import codecs

    table, reader = piece_bytes(name, folder), codecs.getincrementaldecoder("utf-8")("replace")
    return [reader.decode(table[t], final=k == len(ids) - 1) for k, t in enumerate(ids)]


def _lists(values: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.fromiter((x for v in values for x in v), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", offsets: bool = False, name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key, ids`` of each row, with ``starts, ends`` (code points) if ``offsets``.

    Offsets are those of the characters an id touches: ids that share a split
    character all span it. A narrow map: no shuffle, two columns read.
    """
    kind = df.schema[key].dataType.simpleString()
    extra = ", starts array<int>, ends array<int>" if offsets else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(name, folder)
        fast = t.encode_batch if offsets else getattr(t, "encode_batch_fast", t.encode_batch)
        for b in batches:
            done = fast([x or "" for x in b.column(1).to_pylist()], add_special_tokens=False)
            cols = [b.column(0), _lists([e.ids for e in done])]
            if offsets:
                spans = [e.offsets for e in done]
                cols += [_lists([[s for s, _ in x] for x in spans]), _lists([[e for _, e in x] for x in spans])]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "ids", "starts", "ends"][: len(cols)])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>{extra}")


def count_tokens(df: DataFrame, keys: Sequence[str], text: str = "text", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``*keys, n_tokens`` of each row; 0 for null and empty texts."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(name, folder)
        fast = getattr(t, "encode_batch_fast", t.encode_batch)
        for b in batches:
            done = fast([x or "" for x in b.column(len(keys)).to_pylist()], add_special_tokens=False)
            n = pa.array([len(e) for e in done], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], n], names=[*keys, "n_tokens"])

    return df.select(*keys, F.col(text)).mapInArrow(run, schema)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key, text`` of encoded rows; null ids give a null text, ``[]`` gives ''."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else decode_ids(x, name, folder) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")
