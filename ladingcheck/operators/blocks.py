"""Documents to label/value blocks.

Everything here works inside one document row: two passes of one regular
expression cut the text, array functions do the rest. Nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ladingcheck import constants as K
from ladingcheck import schema
from ladingcheck.functions import labels, matching, numbers
from ladingcheck.functions.text import let, line_ends, strip, trimmed
from ladingcheck.sources.inbox import decode_text, detect_format, with_hash

# A label line and its continuation: lines that are neither blank, nor a rule,
# nor a label line themselves. Possessive, so long values need no stack.
BLOCK_PATTERN = (
    rf"(?md)^{K.LABEL_LINE}[ \t]*.*+"
    rf"(?:\n(?!{K.LABEL_LINE})(?!{K.RULE_LINE})(?!{K.BLANK_LINE}).*+)*+"
)
# A block, or else one line.
_PIECE_PATTERN = rf"(?md)^(?:{BLOCK_PATTERN.removeprefix('(?md)^')}|.*+)"


def locator(kind: str, place: Column | None = None, start: Column | None = None,
            end: Column | None = None) -> Column:
    def part(c, type_):
        return (c if c is not None else F.lit(None)).cast(type_)

    return F.struct(F.lit(kind).alias("kind"), part(place, "string").alias("place"),
                    part(start, "int").alias("start"), part(end, "int").alias("end"))


def no_blocks() -> Column:
    return F.array().cast(f"array<{schema.BLOCK}>")


def label_spans(text: Column) -> Column:
    """array<struct(label, value, label_start, label_end, value_start, value_end)>.

    Offsets count code points; ``substring(text, start + 1, end - start)`` is the
    label or the value, always.
    """
    # Blocks are whole lines, and every line outside of them is a piece of its own: a piece
    # starts one line end after the one before it, so nothing is searched for a second time.
    def step(acc, piece):
        start = acc["at"]
        found = F.array(F.struct(piece.alias("hit"), start.alias("start")))
        return F.struct((start + F.length(piece) + 1).alias("at"), F.when(
            piece.rlike(rf"(?d)\A{K.LABEL_LINE}"), F.concat(acc["found"], found)).otherwise(acc["found"]).alias("found"))

    def cut(hit, start, before):
        head = F.rtrim(before, F.lit(" \t"))
        value = F.ltrim(F.substring(hit, F.length(before) + 2, F.length(hit)), F.lit(" \t"))
        end = start + F.length(hit)
        return F.struct(
            trimmed(head).alias("label"), value.alias("value"),
            start.alias("label_start"), (start + F.length(head)).alias("label_end"),
            (end - F.length(value)).alias("value_start"), end.alias("value_end"),
        )

    pieces = F.regexp_extract_all(text, F.lit(_PIECE_PATTERN), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<hit:string,start:int>>").alias("found"))
    blocks = F.aggregate(pieces, zero, step, lambda acc: acc["found"])
    return F.transform(blocks, lambda p: let(
        F.substring_index(p["hit"], ":", 1), lambda before: cut(p["hit"], p["start"], before)))


def text_blocks(text: Column) -> Column:
    """Blocks of a plain text, with exact text-range locators."""
    def block(span, i):
        return F.struct(
            i.cast("int").alias("ord"), span["label"].alias("label"), span["value"].alias("value"),
            locator("text_range", start=span["value_start"], end=span["value_end"]).alias("locator"),
            locator("text_range", start=span["label_start"], end=span["label_end"]).alias("label_locator"),
            F.array().cast(f"array<struct<locator:{schema.LOCATOR},text:string>>").alias("extra"),
        )

    return F.transform(label_spans(text), block)


def label_blocks(documents: DataFrame) -> DataFrame:
    """documents(document_id, text) to one row per ``Label: value`` block."""
    return (
        documents.select("document_id", F.posexplode(label_spans(F.col("text"))).alias("ord", "b"))
        .select("document_id", "ord", "b.*")
    )


def heading(text: Column) -> Column:
    """The first non-empty lines that are no rules, trimmed."""
    lines = F.filter(
        F.split(text, "\n"),
        lambda line: line.rlike(rf"[^{K.WS}]") & ~line.rlike(rf"^[=\-_*~]{{3,}}[{K.WS}]*$"))
    return F.array_join(F.transform(F.slice(lines, 1, K.HEADING_LINES), strip), "\n")


# --- two-column pages ------------------------------------------------------------


def column_spans(text: Column) -> Column:
    """array<struct(label, value, line)> of ``Label   value`` lines of one page.

    One pass over the lines with two facts carried along: the value column of the
    block that is open (-1 without one) and the line it began on. A line that
    belongs to a ``Label: value`` block neither starts nor continues a column.
    """
    def taken_lines(spans):
        return F.flatten(F.transform(spans, lambda s: F.sequence(s["line"], s["line"] + s["extra"])))

    def span_lines(t):
        return F.transform(label_spans(t), lambda s: F.struct(
            F.regexp_count(F.substring(t, F.lit(1), s["label_start"]), F.lit("\n")).alias("line"),
            F.regexp_count(s["value"], F.lit("\n")).alias("extra")))

    def walk(page):
        lines = F.split(page["text"], "\n")

        def step(acc, item):
            line, i = item["line"], item["i"]
            free = ~F.array_contains(page["taken"], i)
            stop = (strip(line) == "") | line.rlike(rf"^[=\-_*~]{{3,}}[{K.WS}]*$")
            indent = F.length(line) - F.length(F.ltrim(line, F.lit(K.WS_CHARS)))
            goes_on = (acc["column"] >= 0) & ~stop & (indent >= acc["column"]) & free
            starts = ~goes_on & free & line.rlike(K.COLUMN_LINE)
            column = F.length(line) - F.length(F.regexp_extract(line, K.COLUMN_LINE, 2))
            owner = F.when(goes_on, acc["owner"]).when(starts, i).otherwise(-1)
            return F.struct(
                F.when(goes_on, acc["column"]).when(starts, column).otherwise(-1).alias("column"),
                owner.alias("owner"),
                F.concat(acc["owners"], F.array(owner)).alias("owners"),
            )

        zero = F.struct(F.lit(-1).alias("column"), F.lit(-1).alias("owner"),
                        F.array().cast("array<int>").alias("owners"))
        numbered = F.transform(lines, lambda line, i: F.struct(line.alias("line"), i.alias("i")))
        owners = F.aggregate(numbered, zero, step, lambda acc: acc["owners"])
        return F.struct(lines.alias("lines"), owners.alias("owners"))

    def collect(walked):
        tagged = F.arrays_zip(walked["lines"].alias("line"), walked["owners"].alias("owner"))
        heads = F.filter(F.array_distinct(walked["owners"]), lambda o: o >= 0)

        def block(o):
            own = F.transform(F.filter(tagged, lambda t: t["owner"] == o), lambda t: t["line"])
            # The value runs from its column on the first line to the last line's end.
            first = F.regexp_extract(own[0], K.COLUMN_LINE, 2)
            rest = F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0)))
            value = F.rtrim(F.array_join(F.concat(F.array(first), rest), "\n"), F.lit(K.WS_CHARS))
            return F.struct(strip(F.regexp_extract(own[0], K.COLUMN_LINE, 1)).alias("label"),
                            value.alias("value"), o.alias("line"))

        return F.transform(heads, block)

    page = let(text, lambda t: F.struct(t.alias("text"), taken_lines(span_lines(t)).alias("taken")))
    return let(let(page, walk), collect)


#: Step of a block's place from page to page; a page has fewer blocks.
PAGE_STEP = 1 << 32


def page_blocks(pages: DataFrame) -> DataFrame:
    """pages(document_id, page, text) to blocks in page order: both layouts.

    ``ord`` is unique and increasing within a document (page, then place).
    """
    text = line_ends(F.col("text"))
    lined = pages.select("document_id", "page", text.alias("text")).withColumn(
        "colon", F.transform(label_spans(F.col("text")), lambda s: F.struct(
            F.regexp_count(F.substring(F.col("text"), F.lit(1), s["label_start"]), F.lit("\n")).alias("line"),
            s["label"].alias("label"), s["value"].alias("value"))))
    columns = F.transform(column_spans(F.col("text")), lambda s: F.struct(
        s["line"].alias("line"), s["label"].alias("label"), s["value"].alias("value")))
    return (
        lined.withColumn("spans", F.array_sort(F.concat("colon", columns)))
        # The outer form: the inner one makes the planner test the size of the spans first, cutting every page twice.
        .select("document_id", "page", F.posexplode_outer("spans").alias("i", "s")).filter("s is not null")
        .select(
            "document_id", "page",
            (F.col("page").cast("bigint") * PAGE_STEP + F.col("i")).alias("ord"),
            "s.line", "s.label", "s.value",
        )
    )


# --- grids: sheets and word tables ---------------------------------------------------


#: Rows and columns (as powers of two) of the areas in which cells learn which sizes of ranges lie over them.
_AREA = (12, 8)


def _level(size: Column) -> Column:
    """The smallest n with 2^n >= size."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1)))


def _tiles(low: Column, high: Column, level: Column) -> Column:
    return F.sequence(_tile(low, level), _tile(high, level))


def _tile(place: Column, level: Column) -> Column:
    return F.floor(place / F.pow(F.lit(2.0), level))


def merged_cells(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Drop the cells a merged range covers, except its top-left origin.

    ranges (document_id, container, min_row, max_row, min_col, max_col). A range of h x w cells is laid on tiles of
    the next powers of two, so it meets at most 2 x 2 of them; cells join it on the tile, not on the sheet. Ranges of a
    sheet do not overlap, so a tile holds a bounded number of ranges of its size. Which sizes occur is first told to each
    area of a sheet. Ranges with a null or no cell cover nothing; repeated and overlapping ones are allowed; cells with a
    null key stay.
    """
    key = ["document_id", "container"]
    r = ranges.select(*key, *[F.col(c).cast("bigint").alias(c) for c in ("min_row", "max_row", "min_col", "max_col")]).dropna().filter(
        "min_row <= max_row and min_col <= max_col").distinct().withColumns({
            "_up": _level(F.col("max_row") - F.col("min_row") + 1), "_across": _level(F.col("max_col") - F.col("min_col") + 1)})
    places = cells.select(*key, F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col")).dropna()
    high, wide = F.lit(_AREA[0]), F.lit(_AREA[1])
    sizes = r.withColumn("_down", F.explode(_tiles(F.col("min_row"), F.col("max_row"), high))).withColumn(
        "_right", F.explode(_tiles(F.col("min_col"), F.col("max_col"), wide))).select(
        *key, "_down", "_right", "_up", "_across").distinct()
    on_tiles = r.withColumn("_tr", F.explode(_tiles(F.col("min_row"), F.col("max_row"), F.col("_up")))).withColumn(
        "_tc", F.explode(_tiles(F.col("min_col"), F.col("max_col"), F.col("_across"))))
    tile = [*key, "_up", "_across", "_tr", "_tc"]
    sized = places.withColumns({"_down": _tile(F.col("row"), high), "_right": _tile(F.col("col"), wide)}).join(
        sizes, [*key, "_down", "_right"]).withColumns({
            "_tr": _tile(F.col("row"), F.col("_up")), "_tc": _tile(F.col("col"), F.col("_across"))})
    inside = F.col("row").between(F.col("min_row"), F.col("max_row")) & F.col("col").between(
        F.col("min_col"), F.col("max_col")) & ~((F.col("row") == F.col("min_row")) & (F.col("col") == F.col("min_col")))
    covered = sized.join(on_tiles, tile).filter(inside).select(*key, "row", "col").distinct()
    return cells.join(covered, [*key, "row", "col"], "left_anti").select(cells.columns)


def render_cell(cell_type: Column, text_value: Column, num_value: Column) -> Column:
    """The stored text of a typed cell."""
    number = numbers.canonical(num_value.cast("decimal(38,12)").cast("string"))
    return (
        F.when(cell_type == "bool", F.when(num_value != 0, "TRUE").otherwise("FALSE"))
        .when(cell_type == "int", num_value.cast("bigint").cast("string"))
        .when(cell_type == "float", number)
        .when(cell_type.isin("datetime", "text"), line_ends(text_value))
        .otherwise("")
    )


def grid_blocks(cells: DataFrame) -> DataFrame:
    """cells(document_id, kind, container, row, col, text) to label/value pairs.

    A cell without a ``Label:`` span is a label; its value is the next non-empty
    cell to the right. A sheet adds one further cell, a word table all of them.
    """
    filled = cells.filter(strip(F.col("text")) != "")
    right = Window.partitionBy("document_id", "container", "row").orderBy("col")
    # One array per row of a word table, cut at each cell; sheets collect nothing, however long their rows are.
    whole = right.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = ~F.col("kind").eqNullSafe("sheet")
    paired = filled.withColumns({
        "next_text": F.lead("text", 1).over(right),
        "next_col": F.lead("col", 1).over(right),
        "second": F.lead("text", 2).over(right),
        "others": F.collect_list(F.when(table, F.col("text"))).over(whole),
        "place": F.row_number().over(right),
    })
    label = strip(F.rtrim(strip(F.col("text")), F.lit(":")))
    extra = F.when(F.col("kind") == "sheet", F.array_compact(F.array("second"))).otherwise(
        F.slice("others", F.col("place") + 2, F.size("others")))

    def piece(i, label, value, value_col, extra):
        return F.struct(i.cast("int").alias("i"), label.alias("label"), value.alias("value"),
                        value_col.alias("value_col"), extra.cast("array<string>").alias("extra"))

    def pieces(spans):
        return F.when(F.size(spans) > 0, F.transform(
            spans, lambda s, i: piece(i, s["label"], s["value"], F.col("col"), F.array()))
        ).otherwise(F.filter(F.array(piece(F.lit(0), label, F.col("next_text"), F.col("next_col"), extra)),
                             lambda p: p["value"].isNotNull() & (p["label"] != "")))

    # Both kinds leave one pass over the windows; a cell is cut once.
    return paired.select(
        "document_id", "container", "row", "col", F.explode_outer(let(label_spans(F.col("text")), pieces)).alias("p"),
    ).filter("p is not null").select("document_id", "container", "row", "col", "p.*")


# --- status of a document ---------------------------------------------------------------


def page_status(pages: DataFrame) -> DataFrame:
    """Per paged document: status, text, and the diagnostics its pages give rise to."""
    blank = strip(F.col("text")) == ""
    d = pages.groupBy("document_id").agg(
        F.count("*").alias("page_count"),
        F.count_if(~blank).alias("text_pages"),
        F.count_if(blank & F.col("has_images")).alias("image_pages"),
    )
    return d.withColumns({
        "status": F.when(F.col("text_pages") > 0, "OK").otherwise("UNREADABLE"),
        "diagnostics": F.array_compact(F.array(
            F.when(F.col("page_count") > K.MAX_PDF_PAGES, "PAGE_LIMIT"),
            F.when(F.col("image_pages") > 0, "IMAGE_ONLY_PAGE"),
            F.when(F.col("text_pages") == 0, "IMAGE_ONLY_DOCUMENT"),
        )),
    })


def grid_status(cells: DataFrame) -> DataFrame:
    """Per grid document: status and diagnostics."""
    blank = strip(F.col("text")) == ""
    return cells.groupBy("document_id").agg(
        F.count_if(~blank).alias("filled"),
        F.count("*").alias("cell_count"),
        F.count_if((F.col("cell_type") == "blank") & F.col("formula").startswith("=")).alias("uncached"),
    ).withColumns({
        "status": F.when(F.col("filled") > 0, "OK").otherwise("UNREADABLE"),
        "diagnostics": F.array_compact(F.array(
            F.when(F.col("cell_count") > K.MAX_SHEET_CELLS, "CELL_LIMIT"),
            F.when(F.col("uncached") > 0, "FORMULA_WITHOUT_CACHED_VALUE"),
            F.when(F.col("filled") == 0, "EMPTY_DOCUMENT"),
        )),
    })


# --- parsed documents ----------------------------------------------------------------------


#: Words of which a match of the pattern holds at least one, in lower case; the white space is all that ASCII has.
_HINTS = {
    K.SI_HEADING: ("instruction",),
    K.BL_HEADING: ("lading", "draft", "waybill"),
    K.OTHER_HEADING: ("invoice", "packing", "certificate", "debit", "credit", "delivery"),
    K.SI_BODY: ("booking", *("oc" + space for space in " \t\n\x0b\f\r"), "mark", "kinds"),
    K.BL_BODY: ("b/l", "bl", "lading", "carrier", "board", "freight"),
}


def _plain_search(pattern: str, first: str) -> str:
    """The pattern's form for ASCII texts, tried only where one of its first letters stands."""
    flags, rest = matching.plain_form(pattern).split(")", 1)
    return f"{flags})(?=[{first}]){rest}"


#: First letters of all that a pattern matches.
_FIRST = {K.SI_HEADING: "sb", K.BL_HEADING: "dbohs", K.OTHER_HEADING: "cpid", K.SI_BODY: "boks", K.BL_BODY: "beof"}


def role_scores(text: Column) -> Column:
    """struct(si, bl, other): how strongly the content supports each document type.

    An ASCII text is searched for a pattern only where it holds one of the pattern's words,
    and matches are walked with what precedes them only where it holds a negation word.
    """
    def score(hits, t, head):
        return F.struct(
            (3.0 * hits(head, K.SI_HEADING) + hits(t, K.SI_HEADING) + 0.5 * hits(t, K.SI_BODY)).alias("si"),
            (3.0 * hits(head, K.BL_HEADING) + hits(t, K.BL_HEADING) + 0.5 * hits(t, K.BL_BODY)).alias("bl"),
            (4.0 * hits(head, K.OTHER_HEADING) + hits(t, K.OTHER_HEADING)).cast("double").alias("other"),
        )

    def plain(t, head):
        # A word of the heading is a word of the text: lines are cut at their ends only.
        def held(low):
            return F.struct(*[reduce(or_, [low.contains(w) for w in words]).alias(f"p{i}") for i, words in enumerate(_HINTS.values())],
                            t.rlike(_plain_search(K.NEGATION_WORD, "ni")).alias("negated"))

        def scored(has):
            flag = {pattern: has[f"p{i}"] for i, pattern in enumerate(_HINTS)}

            def hits(c, pattern):
                plain = _plain_search(pattern, _FIRST[pattern])
                return F.when(~flag[pattern], 0).when(~has["negated"], F.regexp_count(c, F.lit(plain))).otherwise(
                    matching.count_not_negated(c, plain))

            return score(hits, t, head)

        return let(let(F.lower(t), held), scored)

    return let(text, lambda t: let(heading(t), lambda head: F.when(
        matching.is_plain(t), plain(t, head)).otherwise(score(matching.count_not_negated, t, head))))


def with_fields(blocks: Column) -> Column:
    """Only the blocks whose label names a canonical field, with that field."""
    tagged = F.transform(blocks, lambda b: F.struct(labels.match_field(b["label"]).alias("field"), b.alias("b")))
    return F.transform(
        F.filter(tagged, lambda t: t["field"].isNotNull()),
        lambda t: F.struct(t["b"]["ord"].alias("ord"), t["field"].alias("field"),
                           t["b"]["label"].alias("label"), t["b"]["value"].alias("value"),
                           t["b"]["locator"].alias("locator"), t["b"]["label_locator"].alias("label_locator"),
                           t["b"]["extra"].alias("extra")),
    )


def describe_documents(documents: DataFrame) -> DataFrame:
    """documents(status, text, blocks, …) plus scores, convention and field blocks."""
    readable = F.col("status") == "OK"
    none = F.struct(*[F.lit(0.0).alias(n) for n in ("si", "bl", "other")])
    return documents.withColumns({
        "scores": F.when(readable, role_scores(F.col("text"))).otherwise(none),
        "convention": F.when(readable, numbers.document_convention(F.col("text"))).otherwise(""),
        "field_blocks": with_fields(F.col("blocks")),
    }).withColumn(
        "field_labels", F.size(F.array_distinct(F.transform("field_blocks", lambda b: b["field"]))))


def decode_files(files: DataFrame) -> DataFrame:
    """files(registry, path, content) with hash, size, format, text and encoding."""
    hashed = with_hash(files).withColumn("decoded", decode_text(F.col("content")))
    decodable = F.col("decoded.encoding").isNotNull()
    typed = hashed.withColumn("format", detect_format(F.col("content"), decodable))
    is_text = F.col("format") == "text"
    return typed.withColumns({
        "text": F.when(is_text, F.col("decoded.text")),
        "encoding": F.when(is_text, F.col("decoded.encoding")),
        "status": F.when(is_text, "OK").when(F.col("format") == "unsupported", "UNSUPPORTED")
        .otherwise("NOT_PARSED"),
    }).drop("decoded", "content")


def parse_documents(files: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """One narrow row per file, ready for the join with the mails: no shuffle, no text.

    ``decoded`` optionally supplies documents decoded elsewhere (pages or cells)
    as (registry, path, content_hash, size_bytes, format, status, text, blocks,
    diagnostics).
    """
    plain = decode_files(files)
    is_text = F.col("format") == "text"
    plain = plain.withColumns({
        "blocks": F.when(is_text, text_blocks(F.col("text"))).otherwise(no_blocks()),
        "diagnostics": F.array_compact(F.array(
            F.when(is_text, "TEXT_ENCODING"),
            F.when(is_text & F.col("text").contains("�"), "REPLACEMENT_CHARACTER"),
            F.when(F.col("status") == "UNSUPPORTED", "UNSUPPORTED_FORMAT"),
        )),
    }).drop("encoding")
    if decoded is not None:
        supplied = decoded.select("registry", "path")
        plain = plain.join(supplied, ["registry", "path"], "left_anti").unionByName(decoded)
    return describe_documents(plain).drop("text", "blocks")
