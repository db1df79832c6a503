"""Token counts of whole texts, with overlap resynchronisation for huge ones.

The vocabulary is a sentencepiece BPE model with identity normalisation in which no piece
holds a space mark after another character (this is checked when the model is loaded).
Merges therefore never cross from a non-space to a space: a text is a run of independent
segments, each with the spaces before it, and such a point is a *stable boundary* at which
any encoding of the surrounding text must agree.

Texts of up to ``huge_bytes`` are counted as sums over their segments, which the library
encodes once and a bounded table remembers. Longer texts are encoded in overlapping chunks
with token offsets; neighbours are spliced at a stable boundary in their overlap at which
both have a token boundary, and an overlap without one is widened until there is one or it
takes in the rest of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import needed

SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_chunks int"
REMEMBERED, BLOCK_CHARS = 400_000, 1 << 21
_SEGMENT = re.compile(" *[^ ]+| +$")


class Encoder:
    """A vocabulary with token widths in bytes, and a bounded memory of segments' counts."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.separable = all("▁" not in p.lstrip("▁") for p in pieces)
        self.width = np.array([1 if self.model.is_byte(i) else len(p.replace("▁", " ").encode()) for i, p in enumerate(pieces)])
        self.seen: dict[str, int] = {}

    def segments(self, text: str) -> list[str]:
        """A text's segments; each after the first gives up one space, for which the library's
        own space before a text stands. A space mark in a text counts as a space."""
        text = text.replace("▁", " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            first, *rest = _SEGMENT.findall(text)
            return [first, *(x[1:] for x in rest)]
        return text.split(" ") if text else []

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if not self.separable:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        parts = [self.segments(x) for x in texts]
        seen = self.seen
        missing = set().union(*parts).difference(seen)
        if len(seen) + len(missing) > REMEMBERED:
            seen.clear()
            missing = set().union(*parts)
        missing = list(missing)
        seen.update(zip(missing, map(len, self.model.encode(missing, num_threads=1)), strict=True))
        seen[""] = 1  # a lone space at the end of a text
        return [sum(map(seen.__getitem__, x)) for x in parts]

    def spans(self, text: bytes, start: int, end: int) -> tuple[np.ndarray, int]:
        """Token boundaries, as byte offsets in the text, of its part from start to end. The
        part is encoded as the library does: with one space before it. A part within the text
        gives up its own first space for that, so it has to start at one to be aligned at once."""
        own = text[start:end]
        ids = self.model.encode(own.decode("utf-8", "ignore"))
        return start - 1 + np.concatenate(([0], np.cumsum(self.width[ids]))), len(ids)


def _even(text: bytes, at: int) -> int:
    """The first character boundary at or after a byte."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def count_in_chunks(encoder: Encoder, text: str, chunk: int, overlap: int) -> tuple[int, int]:
    """Tokens of a huge text, and the number of chunks encoded.

    Each chunk starts ``overlap`` bytes before the point where the last one ended. A splice
    point is a byte before a space and after a non-space at which both chunks have a token
    boundary; by the argument above the whole text's encoding has one there as well.
    """
    raw = text.replace("▁", " ").encode()
    if not encoder.separable:
        return len(encoder.model.encode(text)), 1
    total, chunks = 0, 1
    left, end, step = 0, _even(raw, chunk), chunk
    bounds, _ = encoder.spans(raw, 0, end)
    while end < len(raw):
        wide = overlap
        while True:
            begin = _even(raw, max(left, end - wide))
            stop = _even(raw, min(len(raw), end + step))
            following, _ = encoder.spans(raw, begin, stop)
            chunks += 1
            common = np.intersect1d(bounds[bounds > begin], following[(following > begin) & (following < min(end, len(raw)))])
            common = [p for p in common.tolist() if raw[p] == 32 and raw[p - 1] != 32]
            if common:
                break
            if begin == left:  # nothing to splice at: take the chunk in whole
                break
            wide *= 4
        if common:
            at = common[len(common) // 2]
            total += int(np.searchsorted(bounds, at)) - int(np.searchsorted(bounds, left - (left == 0)))
            left, bounds, step = at, following, chunk
        else:
            # the rest from the last splice, together with the next chunk; chunks double until one
            # splices, so that a text without a boundary is encoded a few times and not once a chunk
            step *= 2
            bounds, _ = encoder.spans(raw, left + (left > 0), stop)
        end = stop
    return total + len(bounds) - 1 - int(np.searchsorted(bounds, left - (left == 0))), chunks


def token_counts(docs: DataFrame, model_path: str, *, limit: int = 4096, huge_bytes: int = 1 << 16, chunk_bytes: int = 1 << 15, overlap_bytes: int = 256) -> DataFrame:
    """Count the tokens of every whole text (columns ``doc_id, text``; others are ignored).

    A null text counts as empty: no bytes, no tokens. Repeated rows are counted one by one;
    an empty table gives no rows. Returns doc_id, n_bytes, n_tokens (long), over_limit
    (boolean), n_chunks (int: library calls for a huge text, else 1).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sizes = [len(x) if x.isascii() else len(x.encode()) for x in texts]
            tokens, chunks = [0] * len(texts), [1] * len(texts)
            block, held = [], 0
            for k, (text, size) in enumerate(zip(texts, sizes, strict=True)):
                if size > huge_bytes:
                    tokens[k], chunks[k] = count_in_chunks(encoder, text, chunk_bytes, overlap_bytes)
                else:
                    block.append(k)
                    held += size
                if block and (held > BLOCK_CHARS or k + 1 == len(texts)):
                    for j, n in zip(block, encoder.counts([texts[j] for j in block]), strict=True):
                        tokens[j] = n
                    block, held = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(chunks, pa.int32())], names=["doc_id", "n_bytes", "n_tokens", "n_chunks"])

    counted = needed(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(count, SCHEMA)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")
