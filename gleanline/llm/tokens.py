"""Encoding of a corpus with a public byte-pair vocabulary.

A text is cut where encoding can't depend on what is on the other side, into fragments of bounded
size, so that the work is linear in a text's length and equal fragments are encoded once.  A cut between two characters is certain where the two bytes
that meet never stand side by side inside a vocabulary token, so that no merge crosses it, and
where the pre-tokenizer can't tell: its only looks to either side are at white space before and at
apostrophes, so a cut never follows white space and never touches an apostrophe.  Bytes of characters
beyond ASCII are told apart like others.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters a fragment has at least, but for the last; it ends at the next certain cut.
FRAGMENT = 512
#: Fragments a worker remembers: at most about 100 MB.
MEMO = 20_000
#: Characters after which a worker hands its ids on.
BATCH_CHARS = 4_000_000


def vocabulary_folder() -> str:
    """Folder of the vocabulary files; ``GLEANLINE_TOKENIZERS`` overrides the installed one."""
    return os.environ.get("GLEANLINE_TOKENIZERS", "/opt/tokenizers")


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tiktoken encoding of a ranks file, without special tokens."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def joined_pairs(path: str) -> frozenset[int]:
    """Byte pairs (256 * left + right) that stand side by side inside some token."""
    return frozenset(256 * a + b for token in _ranks(path) for a, b in zip(token, token[1:]))


def _spans(codes: list[int]) -> str:
    """Character class of the code points, as ranges."""
    out, start = [], 0
    for i, code in enumerate(codes):
        if i + 1 == len(codes) or codes[i + 1] != code + 1:
            out.append(f"\\U{codes[start]:08x}-\\U{code:08x}")
            start = i + 1
    return "".join(out)


@lru_cache(maxsize=4)
def cut_pattern(path: str) -> re.Pattern:
    """Matches the empty string at certain cuts: between two characters whose bytes that meet never do so inside a token.

    The left character's last byte and the right one's first byte decide, whether the two are ASCII or not:
    right characters with one first byte are a range of code points, left characters with one last byte are
    those of one remainder by 64, which are listed for the code points below U+3400; a left character
    beyond counts as all last bytes at once.  The pre-tokenizer looks around only at white space and
    apostrophes, so neither stands left of a cut, nor an apostrophe right of it.
    """
    joined = joined_pairs(path)
    tails = range(0x80, 0xC0)

    def firsts(byte: int) -> tuple[int, int]:
        """Code points whose UTF-8 starts with ``byte``."""
        if byte < 0x80:
            return byte, byte
        if byte < 0xE0:
            return (byte & 0x1F) << 6, (byte & 0x1F) << 6 | 0x3F
        if byte < 0xF0:
            return max((byte & 0xF) << 12, 0x800), (byte & 0xF) << 12 | 0xFFF
        return max((byte & 7) << 18, 0x10000), min((byte & 7) << 18 | 0x3FFFF, 0x10FFFF)

    starts = [b for b in [*range(0x80), *range(0xC2, 0xF5)] if b != 0x27]
    right = lambda free: "".join("\\U{:08x}-\\U{:08x}".format(*firsts(b)) for b in free)
    groups: dict[str, list[int]] = {}
    for a in [*range(0x80), *tails]:
        if a < 0x80 and (chr(a).isspace() or a == 0x27):
            continue
        if free := [b for b in starts if 256 * a + b not in joined]:
            groups.setdefault(right(free), []).append(a)
    always = [b for b in starts if not any(256 * a + b in joined for a in tails)]
    if always:
        groups.setdefault(right(always), []).append(-1)
    parts = []
    for free, lefts in groups.items():
        codes = {c for a in lefts if 0 <= a < 0x80 for c in (a,)}
        codes |= {c for a in lefts if a >= 0x80 for c in range(a & 0x3F | 0x80, 0x3400, 64) if not chr(c).isspace()}
        left = _spans(sorted(codes)) + ("\\U00003400-\\U0010ffff" if -1 in lefts else "")
        parts.append(f"(?<=[{left}])(?=[{free}])")
    return re.compile("|".join(parts) or r"(?!)")


def fragments(text: str, path: str, at_least: int = FRAGMENT) -> Iterator[str]:
    """The text's pieces between certain cuts, joined up to ``at_least`` characters."""
    search, start = cut_pattern(path).search, 0
    while len(text) - start > at_least and (cut := search(text, start + at_least)):
        if cut.start() == len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, path: str, memo: dict[str, list[int]] | None = None, at_least: int = FRAGMENT) -> list[int]:
    """Ids of a text; none for an empty or null one."""
    if not text:
        return []
    memo = {} if memo is None else memo
    encoding, out = encoder(path), []
    for fragment in fragments(text, path, at_least):
        ids = memo.get(fragment)
        if ids is None:
            ids = encoding.encode_ordinary(fragment)
            if len(fragment) <= 2 * FRAGMENT:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[fragment] = ids
        out.append(ids)
    return out[0] if len(out) == 1 else list(chain.from_iterable(out))


def _counter(path: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, list[int]] = {}
        for batch in batches:
            yield pd.Series([len(encode(text, path, memo)) for text in batch], index=batch.index, dtype="int32")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def token_count(text: Column, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> Column:
    """Number of a text's ids; 0 for empty and null texts."""
    path = os.path.join(folder or vocabulary_folder(), vocabulary)
    return F.pandas_udf(_counter(path), "int")(text)


def encode_corpus(documents: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row, ids without special tokens and empty for empty and null texts.

    Repeated rows stay repeated, null ids of documents stay null, other columns are left out.  Narrow: no
    shuffle.  Ids leave the worker as flat Arrow buffers, a bounded number of characters at a time.
    """
    path = os.path.join(folder or vocabulary_folder(), vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[int]] = {}
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            keys, texts, start = batch.column(0), batch.column(1), 0
            while start < len(texts):
                flat, ends, chars, at = array("i"), [0], 0, start
                while at < len(texts) and chars < BATCH_CHARS:
                    text = texts[at].as_py()
                    flat.extend(encode(text, path, memo))
                    ends.append(len(flat))
                    chars += len(text or "")
                    at += 1
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, "int32")), pa.array(np.frombuffer(flat, "int32") if flat else np.empty(0, "int32")))
                yield pa.RecordBatch.from_arrays([keys.slice(start, at - start), ids], schema=schema)
                start = at

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")
