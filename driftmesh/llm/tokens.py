"""Token counts by overlap resynchronisation.

A text of at most ``chunk_chars`` is encoded whole. A longer one is cut into
overlapping chunks. Each chunk's pieces get byte offsets from their surfaces;
the counts are spliced at a boundary that both chunks have and that is proven
stable: the start of a run of spaces after another character. No piece of the
vocabulary holds a space mark after another character (checked when the
vocabulary is loaded), so no merge crosses such a place whatever surrounds it.
Where the overlap holds no such place it is doubled, in the end to the text's
end, and so the count is always the library's own.

Null and empty texts count 0 tokens; a null id stays null. Repeated rows are each
counted; an empty table gives an empty table. Only the id and the text are read,
so no other column can clash. Of several stable places the first counts. A text
of any length takes memory for one chunk's pieces at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import load, map_rows

MARK = "▁"


@lru_cache(maxsize=4)
def encoder(path: str) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """encode(text) and each piece's surface length in UTF-8 bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece of this vocabulary crosses a space: chunk boundaries can't be proven")
    sizes = np.array([1 if model.is_byte(i) else len(p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)], dtype=np.int64)
    return model.encode, sizes


def boundary(text: str, lo: int, hi: int) -> int:
    """The last place in [lo, hi) where a space follows another character, -1 if none."""
    at = hi
    while (at := text.rfind(" ", lo, at)) >= 0:
        if at > 0 and text[at - 1] not in (" ", MARK):
            return at
    return -1


def count(text: str | None, encode: Callable[[str], list[int]], sizes: np.ndarray, chunk_chars: int = 1 << 16, overlap: int = 256) -> int:
    if not text:
        return 0
    if len(text) <= chunk_chars or MARK in text:
        return len(encode(text))
    total, start = 0, 0
    while True:
        end, wide = min(len(text), start + chunk_chars), overlap
        while end < len(text):
            reach = min(len(text), end + wide)
            left = encode(text[start + (start > 0) : reach])
            cut = boundary(text, max(start + 1, end - wide), reach - 1)
            if cut > start:
                ends = np.cumsum(sizes[left])
                # the dummy space in front stands for the space that was left out, or is one byte more
                goal = len(text[start:cut].encode()) + (start == 0)
                k = int(np.searchsorted(ends, goal))
                right = encode(text[cut + 1 : min(len(text), cut + 1 + wide)])
                tail, own = left[k + 1 : k + 1 + max(1, len(right) // 2)], right[: max(1, len(right) // 2)]
                if k < len(ends) and ends[k] == goal and tail[: len(own) // 2] == own[: len(tail) // 2][: len(own) // 2]:
                    total, start = total + k + 1, cut
                    break
            if reach == len(text):
                return total + len(left)
            wide *= 2
        else:
            return total + len(encode(text[start + (start > 0) :]))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, chunk_chars: int = 1 << 16, overlap: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit). Repeated rows stay repeated."""

    def row(state: tuple, key: int, text: str | None) -> tuple:
        n = count(text, *state, chunk_chars, overlap)
        return key, len((text or "").encode()), n, n > limit

    return map_rows(docs, [id_col, text_col], row, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean", lambda: encoder(path))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
