"""Texts cut, in whole Arrow batches, into space-led pieces that a tokenizer's own pre-tokenisation never joins."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Texts are handled in runs of about so many bytes.
CHUNK_BYTES = 4 << 20
MARK = "\x01"
#: A space beside other white space: such texts are cut with a look-around, which is slower.
_beside = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] | [\s\x0b\x1c-\x1f\x{85}\p{Z}]|\x01"
_alone = re.compile(r"(?<=\S)(?= \S)")


def runs(texts: pa.Array):
    """(first row, texts) of consecutive rows of about CHUNK_BYTES; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(texts):
        done = int(ends[row - 1]) if row else 0
        end = max(row + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, side="right")))
        yield row, texts.slice(row, end - row)
        row = end


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many pieces each text has, and all pieces, coded. Joined, a text's pieces are the text; each but the first starts with a space.

    A cut is made only before a single space between two characters that aren't white space. There every byte-level and word-level
    tokenizer starts a new pre-token, so a text's ids are those of its pieces, one after the other.
    """
    odd = pc.match_substring_regex(texts, _beside)
    plain = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), " ", MARK + " "), MARK)
    if pc.any(odd).as_py():
        parts = plain.to_pylist()
        for row in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            parts[row] = _alone.split(texts[int(row)].as_py())
        plain = pa.array(parts, pa.large_list(pa.large_string()))
    counts = pc.list_value_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    return counts, plain.flatten().dictionary_encode()


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file: tokenizers for .json, sentencepiece for .model; loaded once in each worker."""
    if path.endswith(".model"):
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def encode(path: str, pieces: list[str]) -> list[list[int]]:
    """The ids of each piece, without begin, end or added special tokens."""
    own = tokenizer(path)
    if path.endswith(".model"):
        return own.encode([p[1:] if p[:1] == " " else p for p in pieces], num_threads=1)
    return [e.ids for e in own.encode_batch_fast(pieces, add_special_tokens=False)]
