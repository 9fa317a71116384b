"""Table functions for SQL: cards of a FITS header and blocks of Markdown lines.

``register`` makes them known to a session::

    SELECT f.path, t.* FROM files f, LATERAL fits_cards(f.head) t
    SELECT * FROM md_blocks(TABLE(lines) PARTITION BY doc ORDER BY pos)

The second takes (doc, pos, kind, level, text) as markdown.lines gives them and holds one block's
lines at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from framelake.sources import fits


@udtf(returnType="pos int, key string, value string")
class FitsCards:
    def eval(self, head: bytes) -> Iterator[tuple]:
        """Cards with a value up to END, in order; repeated keys come each time. None without an END."""
        if head is None:
            return
        out = []
        for pos, at in enumerate(range(0, len(head) - fits.CARD + 1, fits.CARD)):
            card = bytes(head[at : at + fits.CARD]).decode("ascii", "replace")
            if card[:8].strip() == "END":
                yield from out
                return
            if card[8:10] == "= ":
                out.append((pos, card[:8].strip(), fits.card_value(card[10:])))


@udtf(returnType="doc long, block long, kind string, level int, text string, n_lines long")
class MdBlocks:
    def __init__(self) -> None:
        self.block, self.open, self.lines = 0, None, []

    def _close(self) -> Iterator[tuple]:
        if self.open:
            self.block += 1
            doc, kind, level = self.open
            yield doc, self.block, kind, level, (" " if kind == "paragraph" else "\n").join(self.lines), len(self.lines)
        self.open, self.lines = None, []

    def eval(self, line: Row) -> Iterator[tuple]:
        """Runs of one kind are a block; headings and rules stand alone, blank lines end one."""
        if self.open is None or line["kind"] != self.open[1] or line["kind"] in ("heading", "rule"):
            yield from self._close()
            if line["kind"] != "blank":
                self.open = (line["doc"], line["kind"], line["level"])
        if self.open:
            self.lines.append(line["text"])

    def terminate(self) -> Iterator[tuple]:
        yield from self._close()


def register(spark: SparkSession) -> None:
    spark.udtf.register("fits_cards", FitsCards)
    spark.udtf.register("md_blocks", MdBlocks)
