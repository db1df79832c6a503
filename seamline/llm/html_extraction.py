"""Main text of web pages by wrapper induction on same-host pages.

Some pages of each host, chosen by a hash, are its references. The trees of the host's other pages
are aligned with each by simple tree matching, and each text leaf of a reference is counted:
in how many pages it has a counterpart, and in how many with the same text. Leaves that stay
constant are the host's template; slots that vary are content. A second reference finds what the
first lacks, such as the blocks of another layout.

A page that shares much more of a reference's text than the host's pages usually do is a copy of
it and no evidence of a template, so it has no vote: copies on one host do not turn an article
into template, and a long template does not make all pages copies.

The wrapper goes first. Of the slots that are left, those that markup itself sets apart from an
article (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) are no content.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._dom import Node, align, body, leaves, parse
from ._stage import needed, scratch, staged
from .url_filter import split_url

VOTE_SCHEMA = "host string, slot int, share int, leaf int, met long, alike long"
TEXT_SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks int, n_template int"
REFERENCE_SCHEMA = "host string, slot int, draw long, reference string"
HELD_BYTES, REMEMBERED = 32 << 20, 256
#: Steps in which the share of a reference's text is counted.
SHARES = 20


def references(pages: DataFrame, slots: int) -> DataFrame:
    """For each host and slot one page: of those whose hash falls into the slot, that with the
    smallest. Tasks send one page a host and slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, int], tuple[int, str]] = {}
        held = 0

        def out() -> pa.RecordBatch:
            columns = ([k[0] for k in best], [k[1] for k in best], [x[0] for x in best.values()], [x[1] for x in best.values()])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["host", "slot", "draw", "reference"])

        for batch in batches:
            page = batch.column(2)
            for k, (host, draw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                key = host, draw % slots
                if key not in best or draw < best[key][0]:
                    held -= len(best[key][1]) if key in best else 0
                    best[key] = draw, page[k].as_py()
                    held += len(best[key][1])
            if held > HELD_BYTES:
                yield out()
                best.clear()
                held = 0
        if best:
            yield out()

    rows = pages.filter("html is not null and host <> ''").select("host", F.xxhash64("page_id", "url", F.length("html")).alias("draw"), "html")
    found = rows.mapInArrow(run, REFERENCE_SCHEMA)
    return found.groupBy("host", "slot").agg(F.min_by("reference", F.struct("draw", "reference")).alias("reference"))


class _Parsed(dict):
    """Trees of references, the last few hundred of them."""

    def __missing__(self, page: str) -> Node:
        if len(self) >= REMEMBERED:
            self.clear()
        self[page] = parse(page)
        return self[page]


def counterparts(reference: Node, page: Node) -> list[tuple[int, Node]]:
    """The reference's text leaves, by number, with their counterparts in a page."""
    found: dict[int, Node] = {}
    align(reference, page, {}, found)
    return [(k, found[id(x)]) for k, x in enumerate(leaves(reference)) if id(x) in found]


def votes(joined: DataFrame) -> DataFrame:
    """For each leaf of a reference, and each step of the share of the reference's text that
    pages have: the pages in which the leaf has a counterpart, and those in which its text is the
    same. Leaf -1 counts the pages of a step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = _Parsed()
        names = [x.split()[0] for x in VOTE_SCHEMA.split(", ")]
        for batch in batches:
            total: dict[tuple[str, int, int, int], list[int]] = {}
            for host, html, references in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                page = None
                for slot, reference in ((x["slot"], x["reference"]) for x in references):
                    if html == reference:
                        continue
                    page = page or parse(html)
                    own = parsed[reference]
                    texts = [x.text for x in leaves(own)]
                    pairs = [(k, texts[k] == x.text) for k, x in counterparts(own, page)]
                    alike = sum(len(texts[k]) for k, same in pairs if same)
                    share = SHARES * alike // max(1, sum(map(len, texts)))
                    for k, same in [(-1, False), *pairs]:
                        count = total.setdefault((host, slot, share, k), [0, 0])
                        count[0] += 1
                        count[1] += same
            if total:
                columns = [*zip(*total, strict=True), *zip(*total.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=names)

    return joined.select("host", "html", "references").mapInArrow(run, VOTE_SCHEMA).groupBy("host", "slot", "share", "leaf").agg(F.sum("met").alias("met"), F.sum("alike").alias("alike"))


def constant_leaves(counted: DataFrame, least_pages: int, percent: int, copy_share: float) -> DataFrame:
    """The leaves of each reference that stay constant: host, slot, constant. Pages are copies
    above ``copy_share``, or above the middle between the host's median share and all."""
    pages = counted.filter("leaf = -1").groupBy("host", "slot").agg(F.percentile("share", 0.5, F.col("met")).alias("middle"))
    own = counted.filter("leaf >= 0").join(pages, ["host", "slot"])
    own = own.filter(F.col("share") <= F.greatest(F.lit(copy_share * SHARES), (F.col("middle") + SHARES) / 2))
    own = own.groupBy("host", "slot", "leaf").agg(F.sum("met").alias("met"), F.sum("alike").alias("alike"))
    return own.filter((F.col("met") >= least_pages) & (F.col("alike") * 100 >= F.col("met") * percent)).groupBy("host", "slot").agg(F.array_sort(F.collect_list("leaf")).alias("constant"))


def texts(joined: DataFrame) -> DataFrame:
    """The main text of each page: what its host's wrappers leave, then what markup leaves of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = _Parsed()

        def template(page: Node, html: str, wrappers: list[dict]) -> set[int]:
            found: set[int] = set()
            for wrapper in wrappers:
                reference, wanted = wrapper["reference"], set(wrapper["constant"])
                if html == reference:
                    found |= {id(x) for k, x in enumerate(leaves(page)) if k in wanted}
                else:
                    own = parsed[reference]
                    known = leaves(own)
                    found |= {id(x) for k, x in counterparts(own, page) if k in wanted and x.text == known[k].text}
            return found

        for batch in batches:
            found: list[str] = []
            blocks, dropped = [], []
            for html, wrappers in zip(*(batch.column(k).to_pylist() for k in range(2, 4)), strict=True):
                page = parse(html or "")
                constant = template(page, html, wrappers or [])
                content = [x.text for x in body(page)[0] if id(x) not in constant]
                found.append("\n\n".join(content))
                blocks.append(len(content))
                dropped.append(len(constant))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64()), pa.array(blocks, pa.int32()), pa.array(dropped, pa.int32())],
                names=[x.split()[0] for x in TEXT_SCHEMA.split(", ")],
            )

    return joined.select("page_id", "url", "html", "wrappers").mapInArrow(run, TEXT_SCHEMA)


def extract_text(pages: DataFrame, *, slots: int = 2, least_pages: int = 4, percent: int = 80, copy_share: float = 0.5, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Extract the main text of every whole page (columns ``page_id, url, html``; others are ignored).

    ``slots``: references of a host. ``least_pages`` and ``percent``: a leaf of a reference is template
    if at least so many other pages have it, and at least so many percent of them with the same
    words. ``copy_share``: a page with more of a reference's text than this has no vote, unless the
    host's pages usually have that much. ``broadcast_bytes``: references of up to so many bytes in
    all are broadcast, larger ones are joined by shuffle.

    Null html is empty and gives an empty text. Pages without a host are not aligned; their
    markup alone decides. Repeated rows are extracted one by one; an empty table gives no rows.
    Markup may be broken or cut off anywhere. Returns page_id (long), url, text (string), n_chars
    (long), n_blocks, n_template (int: the page's blocks that are template, wherever they stand).
    """
    rows = needed(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", split_url(F.col("url"))[0].alias("host"), "html")
    with scratch(pages.sparkSession):
        chosen = staged(references(rows, slots), "references")
        size = chosen.agg(F.sum(F.octet_length("reference") + F.octet_length("host"))).first()[0] or 0
        hint = F.broadcast if size <= broadcast_bytes else lambda x: x
        together = chosen.groupBy("host").agg(F.collect_list(F.struct("slot", "reference")).alias("references"))  # one for each slot
        counted = staged(votes(rows.filter("html is not null").join(hint(together), "host")), "votes")
        constant = constant_leaves(counted, least_pages, percent, copy_share)
        wrappers = chosen.join(constant, ["host", "slot"]).groupBy("host").agg(F.collect_list(F.struct("reference", "constant")).alias("wrappers"))
        wrappers = staged(wrappers, "wrappers", keep=True)
    return texts(rows.join(hint(wrappers), "host", "left"))
