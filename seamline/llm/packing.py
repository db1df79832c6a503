"""Packing of token pieces into fixed-length sequences by first-fit decreasing.

Documents are cut into pieces of the sequence length; the last, shorter pieces are packed by
first-fit decreasing within randomised groups of documents, each group on its own. A
tournament tree over the bins' free space (each node holds the larger of its children) finds
the first bin with room in logarithmic time.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import needed, staged

CUT_SCHEMA = "doc_id long, doc_tokens long, crcs array<long>, draw long"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
REMEMBERED = 300_000
BLOCK_CHARS = 1 << 21
#: White space of other kinds, or a special token's text: such a text goes to the tokenizer whole.
_WHOLE = re.compile("[\x1c-\x1f\x85\xa0  -     　﻿᠎]|<\\|endoftext\\|>")
_PIECES = re.compile(r" ?[^\s]+|\s+(?!\S)|\s")
_PLAIN = re.compile("[!-~À-ÖØ-öø-ɏ ]+")


class ByteEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit integers.

    No token of a byte-level vocabulary crosses from one run of non-space characters, with at
    most one space before it, to the next; so texts are put together from such runs, encoded
    once and kept in a bounded table. Runs of plain Latin text are encoded with ``ranks_path``
    (the same vocabulary as merge ranks), many at once with a line feed between; all others,
    and texts that hold special tokens or other white space, with ``path`` itself.
    """

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.quick = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.feed = self.quick.encode_ordinary("\n")[0]
        self.seen: dict[str, bytes] = {}

    def exact(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, runs: list[str]) -> None:
        plain = [x for x in runs if self.quick and _PLAIN.fullmatch(x)]
        if plain:
            ids = np.array(self.quick.encode_ordinary("\n".join(plain)), "<u4")
            ends = np.append(np.flatnonzero(ids == self.feed), len(ids)) * 4
            raw, start = ids.tobytes(), 0
            for run, end in zip(plain, ends.tolist(), strict=True):
                self.seen[run] = raw[start:end]
                start = end + 4
        rest = [x for x in runs if x not in self.seen]
        self.seen.update(zip(rest, self.exact(rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        parts: list[list[str] | None] = []
        for text in texts:
            if _WHOLE.search(text):
                parts.append(None)
            elif "\x00" in text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\t" in text or "\r" in text or "\v" in text or "\f" in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"):
                parts.append(_PIECES.findall(text))
            else:
                parts.append(text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00"))
        found = set().union(*(x for x in parts if x))
        missing = found.difference(self.seen)
        if len(self.seen) + len(missing) > REMEMBERED:
            self.seen.clear()
            missing = found
        self.learn(list(missing))
        get = self.seen.__getitem__
        return [self.exact([text])[0] if part is None else b"".join(map(get, part)) for text, part in zip(texts, parts, strict=True)]


def cut(docs: DataFrame, path: str, ranks_path: str | None, pattern: str | None, length: int) -> DataFrame:
    """Encode whole texts and cut them: for each document its number of ids, with the id 0 at
    its end, the checksums of its pieces of ``length`` ids, and a random number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(path, ranks_path, pattern)
        draws = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sizes, crcs, first = [], [], 0
            while first < len(texts):
                last, held = first, 0
                while last < len(texts) and (held < BLOCK_CHARS or last == first):
                    held += len(texts[last])
                    last += 1
                for raw in encoder.encode(texts[first:last]):
                    raw += b"\0\0\0\0"
                    sizes.append(len(raw) // 4)
                    crcs.append([zlib.crc32(raw[a : a + 4 * length]) for a in range(0, len(raw), 4 * length)])
                first = last
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(draws.integers(0, 1 << 62, len(texts)))],
                names=["doc_id", "doc_tokens", "crcs", "draw"],
            )

    return needed(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, CUT_SCHEMA)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[list[int], list[int], int]:
    """The bin and the offset of each item, and the number of bins. Ties keep their order."""
    n = len(sizes)
    width = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * width)
    bins, offsets, used = [0] * n, [0] * n, 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        at = 1
        while at < width:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[k], offsets[k] = at - width, capacity - tree[at]
        used = max(used, at - width + 1)
        tree[at] -= size
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
    return bins, offsets, used


def pack(docs: DataFrame, path: str, *, ranks_path: str | None = None, pattern: str | None = None, length: int = 1024, group_docs: int = 4096) -> DataFrame:
    """Pack all documents (columns ``doc_id, text``) into sequences of at most ``length`` ids.

    ``ranks_path`` and ``pattern``: the same vocabulary as merge ranks, a faster way to the
    same ids. ``group_docs``: the mean size of the random groups that are packed one by one.

    A null text is empty: one piece with the closing id 0. Repeated rows are packed one by
    one, a null doc_id stays null, an empty table gives no rows. Returns for each piece
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (long).
    """
    cuts = staged(cut(docs, path, ranks_path, pattern, length), "cuts")
    groups = -(-cuts.count() // group_docs) or 1

    def place(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        order = np.argsort(table.column("draw").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        tokens = table.column("doc_tokens").to_numpy()
        crcs = table.column("crcs").combine_chunks()
        pieces = np.diff(crcs.offsets.to_numpy())
        row = np.repeat(np.arange(len(tokens)), pieces)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
        size = np.minimum(length, tokens[row] - start)
        full = size == length
        sequence, offset = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        short = np.flatnonzero(~full)
        bins, offsets, used = first_fit_decreasing(size[short], length)
        sequence[short], offset[short] = bins, offsets
        sequence[full] = used + np.arange(full.sum())
        return pa.table(
            {"doc_id": table.column("doc_id").take(pa.array(row)), "start": start, "length": size, "ids_crc32": crcs.flatten(), "doc_tokens": tokens[row], "sequence_id": sequence + (group << 32), "offset": offset}
        )

    return cuts.withColumn("group", F.col("draw") % groups).groupBy("group").applyInArrow(place, PIECE_SCHEMA)
