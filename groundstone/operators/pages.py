"""Page texts: printed labels, tabular pages, table rendering, label coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from groundstone.functions.text import SPACES, lines, strip

# Lines searched at head and tail, longest line that is only a label, longest line with one at its edge.
SCAN_LINES, ALONE_CHARS, EDGE_CHARS = 8, 12, 60
#: A line that is only a number or roman numeral; a number at a line's edge; a cell of figures.
ALONE = r"(?i)^[\s|\-–—.]*(?:page\s+)?([0-9]{1,4}|[ivxlcdm]{1,7})[\s|\-–—.]*$"
EDGE = r"^(?:([0-9]{1,4})\s+[^0-9].*|.*[^0-9]\s+([0-9]{1,4}))$"
FIGURE = r"^[(\-–]?[0-9,]+(?:\.[0-9]+)?[)%]?$"
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman(c: Column) -> Column:
    """Value of a roman numeral, read from its end; null if a letter is none or the sum is 0."""
    letters = F.reverse(F.filter(F.split(F.lower(c), ""), lambda ch: ch != ""))
    worth = F.transform(letters, lambda ch: F.coalesce(*[F.when(ch == k, v) for k, v in ROMAN.items()], F.lit(-1)))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("most"))
    total = F.aggregate(worth, start, lambda a, d: F.struct((a["sum"] + F.when(d < a["most"], -d).otherwise(d)).alias("sum"), F.greatest(a["most"], d).alias("most")), lambda a: a["sum"])
    return F.when(F.array_contains(worth, -1) | (F.length(c) == 0), None).otherwise(F.nullif(total, F.lit(0)))


def label_candidates(text: Column) -> Column:
    """array<struct(label, value)> of the numbers that may be the page's printed label."""
    all_lines = lines(text)
    n = F.size(all_lines)
    scan = F.concat(F.slice(all_lines, 1, SCAN_LINES), F.slice(all_lines, F.greatest(n - SCAN_LINES + 1, F.lit(1)), SCAN_LINES))

    def token(line: Column) -> Column:
        alone, edge = F.regexp_extract(line, ALONE, 1), F.concat(F.regexp_extract(line, EDGE, 1), F.regexp_extract(line, EDGE, 2))
        return F.when((F.length(line) <= ALONE_CHARS) & (alone != ""), alone).when(F.length(line) <= EDGE_CHARS, edge).otherwise("")

    tokens = F.array_distinct(F.filter(F.transform(F.transform(scan, strip), token), lambda t: t != ""))
    valued = F.transform(tokens, lambda t: F.struct(t.alias("label"), F.when(t.rlike("^[0-9]+$"), t.try_cast("int")).otherwise(roman(t)).alias("value")))
    return F.filter(valued, lambda x: (x["value"] >= 1) & (x["value"] <= 9999))


def page_labels(pages: DataFrame) -> DataFrame:
    """id, document_id, pdf_page_index and the resolved label of every page.

    A candidate counts if a neighbouring page has the number one or two on in its direction.  The
    longest run of consecutive numbers gives the label, its first and last number if it has several;
    of equally long runs the first.  Candidates are the rows that are joined, on document, page and
    value, so a document of any length spreads over tasks.  Pages without text or support: null.
    """
    keyed = pages.select("id", "document_id", F.col("pdf_page_index").alias("page"), F.explode(label_candidates(F.col("text"))).alias("c")).select("id", "document_id", "page", "c.label", "c.value")
    claims = keyed.select("document_id", F.explode(F.array(*[F.struct((F.col("page") - d).alias("page"), (F.col("value") - d * step).alias("value")) for d in (-1, 1) for step in (1, 2)])).alias("x")).select("document_id", "x.page", "x.value").distinct()
    supported = keyed.join(claims, ["document_id", "page", "value"], "left_semi")
    one = supported.groupBy("id", "value").agg(F.max("label").alias("label"))  # a page's labels are few: 2 x SCAN_LINES
    island = F.col("value") - F.row_number().over(Window.partitionBy("id").orderBy("value"))
    runs = one.withColumn("island", island).groupBy("id", "island").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.min_by("label", "value").alias("first"), F.max_by("label", "value").alias("last"))
    best = runs.groupBy("id").agg(F.max_by(F.struct("n", "first", "last"), F.struct("n", -F.col("low"))).alias("b"))
    label = F.when(F.col("b.n") > 1, F.concat("b.first", F.lit("-"), "b.last")).otherwise(F.col("b.first"))
    return pages.select("id", "document_id", "pdf_page_index").join(best, "id", "left").select("id", "document_id", "pdf_page_index", label.alias("label"))


def figure_lines(text: Column) -> Column:
    """How many lines are mostly figures."""

    def mostly(line: Column) -> Column:
        tokens = F.filter(F.split(line, SPACES), lambda t: t != "")
        hits = F.size(F.filter(tokens, lambda t: t.rlike(FIGURE)))
        return (hits > 0) & (hits >= F.greatest(F.lit(1), F.floor(F.size(tokens) / 2)))

    return F.size(F.filter(lines(text), mostly))


def looks_tabular(text: Column, least: int = 4) -> Column:
    return figure_lines(text) >= least


def markdown(rows: Column) -> Column:
    """array<array<string>> as a table in markdown; ragged rows are padded, '' without cells."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.trim(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "), F.lit("|"), F.lit("\\|")))
    padded = lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(padded(r), cell), " | "), F.lit(" |"))
    rendered = F.transform(rows, line)
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---|"), width), ""))
    return F.when((F.size(rows) == 0) | (width == 0), "").otherwise(F.array_join(F.concat(F.slice(rendered, 1, 1), F.array(rule), F.slice(rendered, 2, F.greatest(F.size(rows), F.lit(1)))), "\n"))


def located_span(text: Column, cells: Column) -> Column:
    """struct(start, end) over the first places of the cells of three characters or more; nulls if none is found."""
    found = F.filter(F.transform(F.filter(F.transform(cells, strip), lambda c: F.length(c) >= 3), lambda c: F.struct((F.position(c, text) - 1).alias("s"), F.length(c).alias("n"))), lambda x: x["s"] >= 0)
    return F.struct(F.array_min(F.transform(found, lambda x: x["s"])).alias("start"), F.array_max(F.transform(found, lambda x: x["s"] + x["n"])).alias("end"))


def label_coverage(pages: DataFrame) -> DataFrame:
    """Per document: pages, labelled pages, coverage, characters a page, and whether it looks scanned."""
    labelled = F.col("printed_page_label").isNotNull() & (F.col("printed_page_label") != "")
    out = pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if(labelled).alias("labelled"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    return out.select("document_id", "pages", "labelled", (F.col("labelled") / F.col("pages")).alias("coverage"), (F.col("chars") / F.col("pages") < 120).alias("probably_scanned"))
