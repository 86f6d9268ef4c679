"""Tables and lists out of a column of HTML pages.

A page is scanned once from left to right: comments, scripts and styles go, and every tag, whose quoted
attributes may hold ``<`` and ``>``, becomes a marker (control characters, which no page may hold, at the begin of
the name, the begin of the attributes and the end). What is left between markers is text. All further steps look at
markers only, so nothing depends on quotes or on the spelling of an end tag.

The marked page is cut at its table markers, and counting open and closed ones gives each piece its depth: a
table is its own pieces plus the plain text of tables nested in its cells, and a nested table is a table
of its own, in document order. End tags may be left out: a row ends at the next row, section or the
table's end, a cell at the next cell or the row's end, a list item at the next item or list; a cell outside a
row begins one. The wanted table is picked inside its page, by header words or by position, and only
the cells of that table are turned into text, so nothing is shuffled and a row never grows beyond its
page. ``posexplode_outer`` plus a null filter is used on purpose: for the inner form Spark infers a size
filter that evaluates the whole extraction a second time. ``colspan`` repeats the cell, ``rowspan`` puts it
into the rows below; spans beyond the limits of the HTML standard (1,000 columns, 65,534 rows) count as
those limits.

Character references: all numeric ones (decimal, hexadecimal, with or without semicolon, 128 to 159 as
browsers read them; what is no character becomes U+FFFD), the named ones of HTML 4, and without
semicolon those that HTML 5 allows so, as whole words. Others stay as they are."""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import LOCALITY_HEADERS, LOCALITY_REQUIRED, LOCALITY_TABLE_WORDS
from ..functions import NBSP

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
#: What is hidden (no group), a tag, and a tag with a quote that never closes, which ends at the first ">".
MARKUP = (r"(?is)<(?:!--.*?(?:-->|\z)"
          rf"|script(?=[\s/>]){_ATTRIBUTES}>.*?(?:</script\s*>|\z)|style(?=[\s/>]){_ATTRIBUTES}>.*?(?:</style\s*>|\z)"
          r"|[!?][^>]*>"
          rf"|(/?[a-z][^\s/>]*+)(?:({_ATTRIBUTES})>|([^>]*)>))")
MARKER = r"\x01[^\x03]*\x03"
NOT_OF_TABLES = r"(?i)\x01(?!/?(?:table|caption|thead|tbody|tfoot|tr|td|th)\x02)[^\x03]*\x03"
END_MARKER = r"\x01(/[^\x02]*)\x02[^\x03]+\x03"
TABLE_OPENS, TABLE_CLOSES = r"(?i)\x01table\x02", r"(?i)\x01/table\x02\x03"
#: A cell that follows no row marker of its own.
LOOSE_CELL = r"(?i)(\x01(?:table|/?caption|/?thead|/?tbody|/?tfoot|/tr)\x02[^\x03]*\x03[^\x01]*+)(?=\x01t[dh]\x02)"
ROW = r"(?is)\x01tr\x02[^\x03]*\x03(.*?)(?=\x01/?(?:tr|thead|tbody|tfoot|table)\x02|\z)"
CELL = r"(?i)\x01t[dh]\x02[^\x03]*\x03[^\x01]*"
SPAN = r"""(?is)^\x01t[dh]\x02(?:[^"'\x03]|"[^"\x03]*"|'[^'\x03]*')*?(?<=[\s/"']){0}\s*=\s*["']?\s*([0-9]+)"""
COLSPAN, ROWSPAN = SPAN.format("colspan"), SPAN.format("rowspan")
MOST_COLUMNS, MOST_ROWS = 1000, 65534
DATA_CELL = r"(?i)^\x01td\x02"
LIST_ITEM = r"(?is)\x01li\x02[^\x03]*\x03(.*?)(?=\x01/?(?:li|ul|ol)\x02|\z)"
ONE_LINK = r"(?is)^[ \t\r\n]*\x01a\x02\s[^\x03]*\x03((?:(?!\x01/?a\x02).)*+)\x01/a\x02[^\x03]*\x03[ \t\r\n]*\z"
NUMERIC = r"^#(?:0*([0-9]{1,7})(?![0-9])|[xX]0*([0-9a-fA-F]{1,6})(?![0-9a-fA-F]));?"
NAMED = "^([A-Za-z][A-Za-z0-9]*;?)"


def _names() -> dict[str, str]:
    """References by name, from Python's tables: those of HTML 4 with a semicolon, and the ones HTML 5
    knows without."""
    return {f"{name};": chr(code) for name, code in name2codepoint.items()} | {
        name: text for name, text in html5.items() if not name.endswith(";")}


def _upper_controls() -> str:
    """The characters that browsers read 128 to 159 as (windows-1252 where that has one)."""
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))


def _character(code: Column) -> Column:
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.when(code.between(128, 159), F.substring(F.lit(_upper_controls()), (code - 127).cast("int"), F.lit(1))).otherwise(plain)


def decode_references(text: Column) -> Column:
    """Character references of a text without markup. Each one is decoded once: ``&amp;lt;`` is ``&lt;``."""
    names = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in _names().items())), F.lit("\x01"), F.lit("\x02"))

    def one(part: Column) -> Column:
        digits, hexadecimal = F.regexp_extract(part, NUMERIC, 1), F.regexp_extract(part, NUMERIC, 2)
        code = F.when(digits != "", digits.try_cast("long")).otherwise(F.conv(hexadecimal, 16, 10).try_cast("long"))
        name = F.regexp_extract(part, NAMED, 1)
        named = F.try_element_at(names, name)
        return F.when(part.rlike(NUMERIC), F.concat(_character(code), F.regexp_replace(part, NUMERIC, ""))).when(
            named.isNotNull(), F.concat(named, F.substring(part, F.length(name) + 1, F.length(part)))).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    after = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)
    return F.when(text.contains("&"), F.concat(F.get(parts, 0), F.array_join(after, ""))).otherwise(text)


def plain_text(text: Column) -> Column:
    """A text between markers: references decoded, white space collapsed."""
    return F.trim(F.regexp_replace(decode_references(text), r"[ \t\r\n]+", " "))


def marked(html: Column) -> Column:
    """The page with its tags as markers, without comments, scripts and styles."""
    clean = F.when(html.rlike(r"[\x01-\x04]"), F.regexp_replace(html, r"[\x01-\x04]", "")).otherwise(html)
    return F.replace(F.regexp_replace(clean, MARKUP, "\x01$1\x02$2$3\x03"), F.lit("\x01\x02\x03"), F.lit(""))


def with_tables(pages: DataFrame, keep: list[str], html: str) -> DataFrame:
    """``keep`` and ``tables``: the page's tables as marked text, in document order. A table that never closes
    ends with the page."""
    structure = F.regexp_replace(F.regexp_replace(marked(F.col(html)), NOT_OF_TABLES, ""), END_MARKER, "\x01$1\x02\x03")
    edged = F.regexp_replace(F.regexp_replace(structure, TABLE_OPENS, "\x04$0"), TABLE_CLOSES, "$0\x04")
    pieces = pages.select(*keep, F.split(F.when(F.col(html).rlike("(?i)<table"), edged).otherwise(""), "\x04").alias("_p"))
    flagged = pieces.select(*keep, "_p", F.transform("_p", lambda p: F.struct(
        p.rlike(r"(?i)^\x01table\x02").alias("opens"), p.rlike(r"(?i)\x01/table\x02\x03$").alias("closes"))).alias("_f"))
    counted = flagged.select(*keep, "_p", "_f", F.expr("""aggregate(_f,
        named_struct('depth', 0, 'all', cast(array() as array<int>)),
        (a, f) -> named_struct('depth', a.depth + int(f.opens) - int(f.closes), 'all', concat(a.all, array(a.depth + int(f.opens)))),
        a -> a.all)""").alias("_d"))
    placed = counted.select(*keep, "_p", "_d", F.expr("""transform(
        filter(sequence(0, size(_p) - 1), i -> _f[i].opens), i -> named_struct('first', i, 'last', coalesce(
            element_at(filter(sequence(i, size(_p) - 1), j -> _d[j] = _d[i] and _f[j].closes), 1), size(_p) - 1)))""").alias("_t"))
    return placed.select(*keep, F.transform("_t", lambda t: F.regexp_replace(F.array_join(F.transform(
        F.sequence(t["first"], t["last"]), lambda j: F.when(F.get("_d", j) == F.get("_d", t["first"]), F.get("_p", j)).otherwise(
            F.regexp_replace(F.get("_p", j), MARKER, " "))), ""), LOOSE_CELL, "$1\x01tr\x02\x03")).alias("tables"))


def _span(cell: Column, pattern: str, most: int) -> Column:
    given = F.coalesce(F.regexp_extract(cell, pattern, 1).try_cast("int"), F.lit(1))
    return F.least(F.greatest(given, F.lit(1)), F.lit(most))


def raw_cells(row: Column) -> Column:
    """Cell fragments of a row, a spanning cell repeated."""
    cells = F.regexp_extract_all(row, F.lit(CELL), F.lit(0))
    return F.when(row.rlike("(?i)colspan"), F.flatten(F.transform(
        cells, lambda cell: F.array_repeat(cell, _span(cell, COLSPAN, MOST_COLUMNS))))).otherwise(cells)


_PLACED = "array<struct<col:int,more:int,cell:string>>"
# Rows from top to bottom; ``held`` are cells from above that still reach into the row, by column. Each
# of the row's own cells goes to the next free column. ``more`` counts the rows a cell reaches further.
GRID = f"""aggregate(_spans, named_struct('held', cast(array() as {_PLACED}), 'rows', cast(array() as array<array<string>>)),
  (a, row) -> element_at(transform(array(aggregate(row, named_struct('col', 0, 'out', cast(array() as {_PLACED})),
      (s, c) -> element_at(transform(array(aggregate(a.held, s.col, (x, h) -> if(h.col = x, x + 1, x))), free -> named_struct(
          'col', free + c.wide, 'out', concat(s.out, transform(sequence(0, c.wide - 1),
              k -> named_struct('col', free + k, 'more', c.high - 1, 'cell', c.cell))))), 1),
      s -> s.out)),
    own -> named_struct(
      'held', array_sort(concat(
          filter(transform(a.held, h -> named_struct('col', h.col, 'more', h.more - 1, 'cell', h.cell)), h -> h.more > 0),
          filter(own, h -> h.more > 0))),
      'rows', concat(a.rows, array(transform(array_sort(concat(a.held, own)), h -> h.cell))))), 1),
  a -> a.rows)"""


def with_rows(df: DataFrame, keep: list[str], table: str) -> DataFrame:
    """``keep`` and ``rows``: the table's rows as arrays of cell fragments."""
    fragments = df.select(*keep, F.col(table).rlike("(?i)rowspan").alias("_tall"),
                          F.regexp_extract_all(F.col(table), F.lit(ROW), F.lit(1)).alias("_rows"))
    spans = F.transform("_rows", lambda row: F.transform(F.regexp_extract_all(row, F.lit(CELL), F.lit(0)), lambda cell: F.struct(
        cell.alias("cell"), _span(cell, COLSPAN, MOST_COLUMNS).alias("wide"), _span(cell, ROWSPAN, MOST_ROWS).alias("high"))))
    spread = fragments.select(*keep, "_tall", "_rows", F.when(F.col("_tall"), spans).alias("_spans"))
    return spread.select(*keep, F.when(F.col("_tall"), F.expr(GRID)).otherwise(
        F.transform("_rows", raw_cells)).alias("rows"))


def cell_text(cell: Column) -> Column:
    return plain_text(F.split_part(cell, F.lit("\x03"), F.lit(2)))


def _numbered(df: DataFrame, keep: list[str], items: Column, number: str, name: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(items).alias(number, name)).filter(F.col(number).isNotNull())


def html_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per cell: key, table_no, row_no, cell_no, cell (numbers from 0)."""
    tables = _numbered(with_tables(pages, [key], html), [key], F.col("tables"), "table_no", "t")
    rows = _numbered(with_rows(tables, [key, "table_no"], "t"), [key, "table_no"], F.col("rows"), "row_no", "r")
    cells = _numbered(rows, [key, "table_no", "row_no"], F.col("r"), "cell_no", "c")
    return cells.select(key, "table_no", "row_no", "cell_no", cell_text(F.col("c")).alias("cell"))


def html_list_items(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per list item that is one link and nothing else: key, item_no, item text."""
    items = F.regexp_extract_all(marked(F.col(html)), F.lit(LIST_ITEM), F.lit(1))
    links = F.filter(items, lambda item: item.rlike(ONE_LINK))
    text = plain_text(F.regexp_replace(F.regexp_extract("i", ONE_LINK, 1), MARKER, ""))
    return _numbered(pages, [key], links, "item_no", "i").select(key, "item_no", text.alias("item"))


def table_with_words(tables: Column, words=tuple(LOCALITY_TABLE_WORDS)) -> Column:
    """First table whose first row contains every word; null when there is none."""
    def has_all(table: Column) -> Column:
        header = F.lower(plain_text(F.regexp_replace(F.regexp_extract(table, ROW, 1), MARKER, " ")))
        found = F.lit(True)
        for word in words:
            found = found & header.contains(word)
        return found

    return F.try_element_at(F.filter(tables, has_all), F.lit(1))


def header_role(cell: Column, rules=tuple(LOCALITY_HEADERS)) -> Column:
    """Column name of a header cell: collapsed lower case, first matching keyword wins."""
    text = F.lower(F.trim(F.regexp_replace(cell, f"[\\s{NBSP}]+", " ")))
    role = F.when(F.lit(False), F.lit(None).cast("string"))
    for keyword, name in rules:
        role = role.when(text.contains(keyword), F.lit(name))
    return role


def _body(rows: Column) -> Column:
    """Rows with at least one data cell (header rows go)."""
    return F.filter(rows, lambda row: F.exists(row, lambda cell: cell.rlike(DATA_CELL)))


def _required(value: Column, strict: bool, message: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(message))) if strict else value


def locality_rows(pages: DataFrame, key: str = "page_id", html: str = "html",
                  strict: bool = True) -> DataFrame:
    """Rows of each page's locality table with columns named by its header words.
    ``strict`` fails the run on a page without the table or without a required column."""
    names = [name for _, name in LOCALITY_HEADERS]
    found = with_tables(pages, [key], html)
    picked = found.select(key, _required(table_with_words(F.col("tables")), strict, "no locality table on the page").alias("t"))
    headed = with_rows(picked, [key], "t").select(key, "rows", F.transform(
        F.try_element_at("rows", F.lit(1)), lambda cell: header_role(cell_text(cell))).alias("roles"))
    for name in LOCALITY_REQUIRED if strict else []:
        headed = headed.withColumn("roles", F.when(F.array_contains(F.col("roles"), name), F.col("roles"))
                                   .otherwise(F.raise_error(F.lit(f"no column for {name}"))))
    body = _numbered(headed, [key, "roles"], _body(F.col("rows")), "row_no", "r")
    cells = body.select(key, "roles", F.col("r").alias("cells"))

    def named(name: str) -> Column:
        position = F.array_position("roles", F.lit(name)).cast("int")
        return F.when(position > 0, cell_text(F.try_element_at("cells", position)))

    return cells.select(key, *[named(name).alias(name) for name in names])


def positional_rows(pages: DataFrame, table_no: int, columns: dict[str, int], key: str = "page_id",
                    html: str = "html", skip: int = 0, min_tables: int = 4, strict: bool = True) -> DataFrame:
    """Body rows of the table at ``table_no`` (from 0) with cells picked by position.
    ``skip`` body rows are left out; ``strict`` fails on a page with too few tables."""
    found = with_tables(pages, [key], html)
    enough = F.when(F.size("tables") >= min_tables, F.try_element_at("tables", F.lit(table_no + 1)))
    picked = found.select(key, _required(enough, strict, "too few tables on the page").alias("t"))
    body = _numbered(with_rows(picked, [key], "t"), [key], _body(F.col("rows")), "row_no", "r").filter(F.col("row_no") >= skip)
    cells = body.select(key, "row_no", F.col("r").alias("cells"))
    return cells.select(key, "row_no", *[
        cell_text(F.try_element_at("cells", F.lit(position + 1))).alias(name) for name, position in columns.items()
    ])
