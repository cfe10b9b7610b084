"""Tables of reports as facts: a grid of rows and columns from cells that span several, header paths, units, long form.

Cells are laid out in tasks, a report at a time. Paths of headers, numbers and facts are Spark's: joins and
aggregates over cells. What is no number stays, as a row that says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.evidence import AVAILABLE, UNVERIFIED
from attestra.sources.archive import members

CELLS = "archive string, member string, nth int, row int, col int, header boolean, label boolean, first boolean, text string, unit string, error string"
#: The tags of data cells, what a unit is announced by, and what a unit's name multiplies by.
DATA_TAGS, UNIT = ("TD", "TE", "TU"), re.compile(r"\(?\s*(?:단위|unit)\s*[:：]\s*([^)\n,]+?)\s*\)?\s*$", re.I | re.M)
UNITS = {"원": 1, "천원": 1000, "백만원": 10**6, "억원": 10**8, "won": 1, "thousand won": 1000, "million won": 10**6}
#: Rows or columns that a cell may span; more is a broken table.
MOST_SPAN = 1000


def text_of(node: ElementTree.Element) -> str:
    return " ".join("".join(node.itertext()).split())


def span(cell: ElementTree.Element, name: str) -> int:
    number = next((v for k, v in cell.attrib.items() if k.lower() == name), "1").strip()
    return min(MOST_SPAN, max(1, int(number))) if number.isdecimal() else 1


def laid_out(table: ElementTree.Element) -> Iterator[tuple[int, int, bool, bool, bool, str]]:
    """(row, column, whether it is a header, whether it is a row's label, whether the cell begins here, text) of each place of the grid. A cell that spans several is in all of them; where two claim a place, the earlier has it."""
    taken: set[tuple[int, int]] = set()
    heads = {row for head in table.iter("THEAD") for row in head.iter("TR")}
    for r, row in enumerate(table.iter("TR")):
        c = 0
        for cell in row:
            if cell.tag != "TH" and cell.tag not in DATA_TAGS:
                continue
            while (r, c) in taken:
                c += 1
            header, text = cell.tag == "TH" or row in heads, text_of(cell)
            width, height = span(cell, "colspan"), span(cell, "rowspan")
            for i in range(r, r + height):
                for j in range(c, c + width):
                    if (i, j) not in taken:
                        taken.add((i, j))
                        yield i, j, header, not header and c == 0, (i, j) == (r, c), text
            c += width


def announced(table: ElementTree.Element, before: str) -> str | None:
    """The unit that a table's own title gives, or else the text right before it."""
    for text in (*(text_of(x) for x in table.iter() if x.tag in ("TITLE", "CAPTION")), before):
        if found := UNIT.search(text):
            return found[1].strip().lower()
    return None


def tables_of(text: str) -> Iterator[tuple[ElementTree.Element, str | None]]:
    """Each table with its unit, in order; tables within tables are tables of their own."""
    declaration = text.find("?>") + 2 if text.startswith("<?xml") else 0
    before = ""
    for node in ElementTree.fromstring(text[declaration:]).iter():
        if node.tag == "P":
            before = text_of(node)
        elif node.tag == "TABLE":
            yield node, announced(node, before)
            before = ""


def cells_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CELLS.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    kinds = [types[x.split()[1]] for x in CELLS.split(", ")]
    for batch in batches:
        for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for member, text, error in members(content or b""):
                rows: list[tuple] = []
                try:
                    for n, (table, unit) in enumerate(tables_of(text) if text is not None else ()):
                        rows += [(archive, member, n, *cell, unit, None) for cell in laid_out(table)]
                except ElementTree.ParseError:
                    rows, error = [], "malformed XML"
                if error:
                    rows.append((archive, member, *[None] * 8, error))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def table_cells(archives: DataFrame) -> DataFrame:
    """archives: of archive.archives. A row for each place of each table's grid: archive, member, nth (table), row, col, header, label, first, text, unit; a report that can't be read is a row with an error."""
    return archives.mapInArrow(cells_in, CELLS)


def number(text: Column) -> Column:
    """A number as reports write it: thousands by commas, negative by a sign, a triangle or brackets; else null."""
    plain = F.regexp_replace(F.trim(text), r"[,\s₩]", "")
    negative = plain.rlike(r"^(\(.*\)|[△▲\-−–].*)$")
    digits = F.regexp_replace(plain, r"^[(△▲\-−–]+|\)$", "")
    value = F.when(digits.rlike(r"^[0-9]+(\.[0-9]+)?$"), digits.try_cast("decimal(38,2)"))
    return F.when(negative, -value).otherwise(value)


def table_facts(cells: DataFrame, units: Mapping[str, int] = UNITS) -> DataFrame:
    """cells: of table_cells, written if they are read again. A row for each data cell that isn't blank: archive, member, nth, row, col, account (the headers of its row, outside in), period (those of its column), value (in ones), unit, text, reason, state.

    Headers of a column are the header cells above it, those of a row the labels and header cells left of it; one that spans several is named once.
    A cell that spans several counts once, where it begins. Not a number, or a unit that isn't in ``units``: value null, with the reason, ``unverified``; a table
    that names no unit is in ones. A report that couldn't be read is one such row.
    """
    place = ["archive", "member", "nth"]
    whole = cells.where("error IS NULL")
    data = whole.where("NOT header AND NOT label AND first AND text <> ''").select(*place, "row", "col", "text", "unit")
    heads = whole.where("(header OR label) AND text <> ''").select(*place, F.col("row").alias("head_row"), F.col("col").alias("head_col"), "label", F.col("text").alias("head"))

    def path(on: Column, keep: Column, order: str) -> DataFrame:
        met = data.select(*place, "row", "col").join(heads, place).where(on & keep)
        named = F.array_sort(F.collect_list(F.struct(order, "head")))
        # the same words from one cell over two rows or columns count once
        once = F.aggregate(F.transform(named, lambda x: x["head"]), F.array().cast("array<string>"), lambda out, x: F.when(F.element_at(F.concat(F.array(F.lit(None).cast("string")), out), -1).eqNullSafe(x), out).otherwise(F.array_append(out, x)))
        return met.groupBy(*place, "row", "col").agg(F.array_join(once, " / ").alias("path"))

    above = path((F.col("head_col") == F.col("col")) & (F.col("head_row") < F.col("row")), ~F.col("label"), "head_row").withColumnRenamed("path", "period")
    left = path((F.col("head_row") == F.col("row")) & (F.col("head_col") < F.col("col")), F.lit(True), "head_col").withColumnRenamed("path", "account")
    at = [*place, "row", "col"]
    times = F.create_map(*(F.lit(x) for k, v in units.items() for x in (k, v)))
    rows = data.join(left, at, "left").join(above, at, "left").withColumn("times", F.when(F.col("unit").isNull(), 1).otherwise(F.try_element_at(times, F.col("unit"))))
    rows = rows.withColumn("number", number(F.col("text")))
    reason = F.when(F.col("number").isNull(), "no number").when(F.col("times").isNull(), "unknown unit").when(F.col("account").isNull(), "no account")
    value = (F.col("number") * F.col("times").cast("decimal(12,0)")).cast("decimal(38,2)")
    out = rows.select(*at, "account", "period", F.when(reason.isNull(), value).alias("value"), "unit", "text", reason.alias("reason"))
    broken = cells.where("error IS NOT NULL").select(*place, "row", "col", *(F.lit(None).cast(t).alias(c) for c, t in (("account", "string"), ("period", "string"), ("value", "decimal(38,2)"))), "unit", "text", F.col("error").alias("reason"))
    return out.unionByName(broken).withColumn("state", F.when(F.col("reason").isNull(), AVAILABLE).otherwise(UNVERIFIED))
