"""Token counts of whole texts under a public vocabulary."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batches, prepare, texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenizer of byte-level BPE vocabularies of this kind.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the pre-tokenizer always cuts: before white space after any other character, and between letters, digits and
#: other signs, but not after an apostrophe, which may belong to the letters after it.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
_encoders: dict[bytes, tuple] = {}


def spans(tokens: list[bytes]) -> frozenset[tuple[bytes, bytes]]:
    """What stands around the places between characters within the tokens: the end of the one before, the begin of the one after.

    Where a token begins or ends inside a character it is the part that the token has.
    """
    out = set()
    for t in tokens:
        lead = [i for i, c in enumerate(t) if not 0x80 <= c < 0xC0]
        for k, i in enumerate(lead):
            if i:
                out.add((t[lead[k - 1] if k else 0 : i], t[i : lead[k + 1] if k + 1 < len(lead) else len(t)]))
    return frozenset(out)


def encoder(ranks: bytes) -> tuple:
    """The encoder of a ``.tiktoken`` file's bytes and its :func:`spans`, kept for the worker's life."""
    key = hashlib.sha256(ranks).digest()
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding(key.hex(), pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), spans(list(table))
    return _encoders[key]


def crossed(left: str, right: str, inside: frozenset) -> bool:
    """Whether a token could reach from one character into the next."""
    a, b = left.encode("utf-8", "surrogatepass"), right.encode("utf-8", "surrogatepass")
    return any((a[i:], b[:j]) in inside for i in range(len(a)) for j in range(1, len(b) + 1))


def boundary(text: str, at: int, inside: frozenset, step: int = 4096) -> int:
    """The first safe place from ``at`` on, or the text's end.

    It is one where the pre-tokenizer cuts, or one within a run of letters, of digits or of signs that no token of the vocabulary
    reaches across: there, neither what is left of it nor what is right of it can merge with the other.
    """
    while at < len(text):
        end = min(len(text), at + step)
        m = SAFE.search(text, at, min(len(text), end + 1))
        stop = m.start() if m else end
        for i in range(at, stop):
            a, b = text[i - 1], text[i]
            if not a.isspace() and not b.isspace() and b != "'" and a != "'" and not crossed(a, b, inside):
                return i
        if m:
            return stop
        at = end
    return len(text)


def pieces(text: str, most: int, inside: frozenset) -> Iterator[str]:
    """Parts of the text of about ``most`` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > most:
        to = boundary(text, at + most, inside)
        yield text[at:to]
        at = to
    if at < len(text):
        yield text[at:]


def lengths(enc, inside: frozenset, rows: list[str], piece: int, batch: int) -> np.ndarray:
    """Tokens of each row. Pieces go to the encoder in groups of nearly equal bytes, at most about ``batch``."""
    parts = [(i, p) for i, row in enumerate(rows) for p in pieces(row or "", piece, inside)]
    size = np.array([len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for _, p in parts], np.int64)
    groups = max(1, -(-int(size.sum()) // batch))
    # a group ends where its share of all bytes does
    which = np.minimum((np.cumsum(size) - size / 2) * groups // max(int(size.sum()), 1), groups - 1).astype(int)
    out = np.zeros(len(rows), np.int64)
    for g in range(groups):
        own = [parts[k] for k in np.flatnonzero(which == g)]
        texts_ = [p for _, p in own]
        for (i, _), ids in zip(own, enc.encode_ordinary_batch(texts_, num_threads=1) if len(own) > 1 else map(enc.encode_ordinary, texts_)):
            out[i] += len(ids)
    return out


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", piece: int = 1 << 16, batch: int = 1 << 20) -> DataFrame:
    """``(doc_id, n_tokens)`` of every row.

    ``vocabulary`` is a ``.tiktoken`` file that the driver can read; its bytes are
    broadcast (a vocabulary doesn't grow with the data). Texts of more than ``piece`` characters are
    encoded in parts, cut where no token can cross, also within words or signs without white space; where there is no such place (a run of
    digits only), the run stays whole. Special tokens' strings
    are ordinary text. A null or empty text has 0 tokens; repeated rows each get
    their count; an empty table gives none; a null id stays null.
    """
    spark = docs.sparkSession
    prepare(spark)
    ranks = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, inside = encoder(ranks.value)
        for b in batches(it, most=batch):
            n = lengths(enc, inside, b.column(1).to_pylist(), piece, batch)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")
