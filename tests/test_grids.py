"""Merged ranges and label/value pairs of grids."""

import random

from pyspark.sql import functions as F

from ladingcheck.operators import blocks

RANGES = "document_id string, container string, min_row int, max_row int, min_col int, max_col int"


def test_merged_cells_equal_brute_force(spark):
    rng = random.Random(2)
    ranges = []
    for doc in ("a", "b"):
        for _ in range(40):
            top, left = rng.randint(1, 90), rng.randint(1, 60)
            ranges.append((doc, "s", top, top + rng.choice([0, 0, 1, 3, 40]), left, left + rng.choice([0, 1, 2, 9, 50])))
    # Repeated, reaching over tile and area edges, of one cell, upside down, incomplete, on a sheet without cells.
    ranges += [ranges[0], ("a", "s", 1, 9000, 70, 70), ("a", "s", 5, 5, 64, 600), ("b", "s", 9, 9, 9, 9), ("b", "s", 9, 3, 1, 2),
               ("b", "s", None, 4, 1, 4), ("z", "s", 1, 4, 1, 4)]
    cells = [(d, "s", r, c, f"{r},{c}") for d in ("a", "b") for r in (*range(1, 100, 3), 4095, 4096, 9000, 9001)
             for c in (*range(1, 75, 2), 70, 255, 256, 600, 601)]
    cells += [("a", None, 1, 1, "null"), ("a", "t", 1, 1, "other"), ("a", "s", 5, 65, "again")]

    def covered(d, s, r, c):
        return any(d == x[0] and s == x[1] and None not in x and x[2] <= r <= x[3] and x[4] <= c <= x[5] and (r, c) != (x[2], x[4])
                   for x in ranges)

    got = blocks.merged_cells(
        spark.createDataFrame(cells, "document_id string, container string, row int, col int, text string"),
        spark.createDataFrame(ranges, RANGES))
    assert got.columns == ["document_id", "container", "row", "col", "text"]
    key = lambda t: tuple(str(v) for v in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((c for c in cells if not covered(*c[:4])), key=key)


def test_merged_cells_of_one_large_sheet(spark):
    """Every second row of a wide sheet is merged in blocks of 8 columns: no key holds more than a few ranges."""
    cells = spark.range(400 * 800).select(
        F.lit("d").alias("document_id"), F.lit("s").alias("container"), F.floor(F.col("id") / 800).cast("int").alias("row"),
        (F.col("id") % 800).cast("int").alias("col"))
    ranges = cells.filter("row % 2 = 0 and col % 8 = 0").select(
        "document_id", "container", F.col("row").alias("min_row"), F.col("row").alias("max_row"), F.col("col").alias("min_col"),
        (F.col("col") + 7).alias("max_col"))
    assert blocks.merged_cells(cells, ranges).count() == 200 * 800 + 200 * 100


def test_grid_rows_of_tables_and_sheets(spark):
    cells = [("t", "table", "1", 1, c, x) for c, x in enumerate(["Port", "A", " ", "B", "C"])]
    cells += [("s", "sheet", "1", 1, c, x) for c, x in enumerate(["Port", "A", "B", "C"])]
    cells += [("w", "sheet", "1", 1, c, f"x{c}") for c in range(6000)]
    got = blocks.grid_blocks(spark.createDataFrame(
        cells, "document_id string, kind string, container string, row int, col int, text string"))
    rows = {(r.document_id, r.label): (r.value, list(r.extra)) for r in got.collect()}
    assert rows["t", "Port"] == ("A", ["B", "C"]) and rows["t", "A"] == ("B", ["C"]) and rows["t", "B"] == ("C", [])
    assert rows["s", "Port"] == ("A", ["B"]) and rows["s", "B"] == ("C", [])
    assert rows["w", "x5997"] == ("x5998", ["x5999"]) and len(rows) == 3 + 3 + 5999
