"""Structure of documents: pages, sections, references, tables of profiles, label matching."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import normalize_heading, normalize_label
from quire.operators.ordered import islands


def page_contents(units: DataFrame) -> DataFrame:
    """(doc, page, content) of units (doc, idx, is_break, content): pages are runs between breaks."""
    return islands(units, ["doc"], "idx", F.col("is_break")).groupBy("doc", F.col("island").alias("page")).agg(
        F.sum("content").alias("content")
    )


def blank_pages(units: DataFrame) -> DataFrame:
    """(doc, blank): pages without content, one trailing page aside."""
    pages = page_contents(units)
    last = W.partitionBy("doc")
    marked = pages.withColumn("last", F.max("page").over(last) == F.col("page"))
    blank = F.count(F.when((F.col("content") == 0) & ~F.col("last"), 1))
    return marked.groupBy("doc").agg(blank.alias("blank"))


def broken_references(references: DataFrame, targets: DataFrame) -> DataFrame:
    """References (doc, ref) without a target of that name, by an anti join."""
    return references.join(targets, ["doc", "ref"], "left_anti")


def section_bodies(lines: DataFrame) -> DataFrame:
    """(doc, section, heading, body, n_lines) of lines (doc, idx, is_heading, text); lines before a heading are left out."""
    marked = islands(lines, ["doc"], "idx", F.col("is_heading")).filter("island > 0")
    body = F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("idx", "text"))))
    return marked.groupBy("doc", F.col("island").alias("section")).agg(
        F.max(F.when(F.col("is_heading"), F.col("text"))).alias("heading"),
        F.concat_ws("\n", F.transform(body, lambda x: x["text"])).alias("body"),
        F.count(F.when(~F.col("is_heading"), 1)).alias("n_lines"),
    )


def locate_headings(paragraphs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where each wanted heading (section, heading) stands in (doc, idx, text): equal when normalised, else contained.

    The wanted headings are a configuration, broadcast for the theta part.
    """
    lines = paragraphs.select("doc", "idx", normalize_heading(F.col("text")).alias("norm")).filter("norm <> ''")
    want = wanted.select("section", normalize_heading(F.col("heading")).alias("want"))
    pairs = lines.join(F.broadcast(want), F.contains("norm", "want"))
    order = W.partitionBy("doc", "section").orderBy((F.col("norm") != F.col("want")).cast("int"), "idx")
    best = pairs.withColumn("r", F.row_number().over(order)).filter("r = 1")
    exact = (F.col("norm") == F.col("want")).alias("exact")
    return best.select("doc", "section", "idx", exact)


def match_labels(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Match row labels (row_id, label) with values (ord, key): equal first, else the first key that contains or is contained.

    Equal labels are an equi-join; only the rest meets the keys, a small broadcast table.
    """
    labelled = rows.select("row_id", normalize_label(F.col("label")).alias("norm")).filter("norm <> ''")
    keys = values.select("ord", normalize_label(F.col("key")).alias("k"), "key").filter("k <> ''")
    exact = labelled.join(F.broadcast(keys), F.col("norm") == F.col("k")).groupBy("row_id").agg(F.min_by("key", "ord").alias("key"))
    rest = labelled.join(exact.select("row_id"), "row_id", "left_anti")
    loose = rest.join(F.broadcast(keys), F.contains("norm", "k") | F.contains("k", "norm"))
    found = loose.groupBy("row_id").agg(F.min_by("key", "ord").alias("key"))
    return exact.withColumn("how", F.lit("exact")).unionByName(found.withColumn("how", F.lit("contained")))


def merge_ranges(grid: DataFrame) -> DataFrame:
    """Bounding boxes of cells that cover several positions: (table_id, cell_id, top, left, bottom, right)."""
    return grid.groupBy("table_id", "cell_id").agg(
        F.min("row_ix").alias("top"), F.min("col_ix").alias("left"), F.max("row_ix").alias("bottom"), F.max("col_ix").alias("right"),
        F.count(F.lit(1)).alias("n"),
    ).filter("n > 1").drop("n")


def alignment(columns: DataFrame) -> DataFrame:
    """The alignment of each column (table_id, col_ix, align): the one given, mixed, or unspecified."""
    some = F.collect_set(F.when(F.col("align") != "unspecified", F.col("align")))
    value = F.when(F.size(some) == 0, "unspecified").when(F.size(some) == 1, F.get(some, F.lit(0))).otherwise("mixed")
    return columns.groupBy("table_id", "col_ix").agg(value.alias("alignment"))


def conformance(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Issues of candidate tables against reference tables (table_id, n_rows, n_cols, header_rows)."""
    c = candidate.select("table_id", *(F.col(x).alias(f"c_{x}") for x in ("n_rows", "n_cols", "header_rows")), F.lit(True).alias("there"))
    joined = reference.join(c, "table_id", "left")
    issue = lambda cond, code: F.when(cond, F.lit(code))
    issues = F.array_compact(
        F.array(
            issue(F.col("there").isNull(), "TABLE_MISSING"),
            *(issue(F.col(x) != F.col(f"c_{x}"), f"{x.upper()}_MISMATCH") for x in ("n_rows", "n_cols", "header_rows")),
        )
    )
    return joined.select("table_id", F.explode(issues).alias("issue"))


def tile_grid(images: DataFrame, edge: int) -> DataFrame:
    """The tiles of images (image_id, width, height), row by row: (image_id, tile, x, y, w, h)."""
    across = F.ceil(F.col("width") / edge).cast("int")
    down = F.ceil(F.col("height") / edge).cast("int")
    tiles = images.filter("width > 0 and height > 0").select(
        "image_id", "width", "height", across.alias("across"), F.explode(F.sequence(F.lit(0), across * down - 1)).alias("tile")
    )
    x, y = (F.col("tile") % F.col("across")) * edge, F.expr("tile div across").cast("int") * edge
    return tiles.select(
        "image_id", "tile", x.alias("x"), y.alias("y"),
        F.least(F.lit(edge), F.col("width") - x).alias("w"), F.least(F.lit(edge), F.col("height") - y).alias("h"),
    )


def passed(invariants: DataFrame) -> DataFrame:
    """Whether each document's checked invariants (doc, status, passed) hold; none checked passes."""
    checked = F.col("status") == "checked"
    ok = F.coalesce(F.bool_and(F.when(checked, F.col("passed"))), F.lit(True))
    return invariants.groupBy("doc").agg(ok.alias("passed"), F.count(F.when(checked, 1)).alias("n_checked"))
