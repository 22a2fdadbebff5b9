"""Layout documents: JSON scan, blocks, cells, page text, part merging and summaries.

All work on one document happens inside its row, on arrays; nothing is shuffled to put a document
back together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BBOX = "struct<x1:double,y1:double,x2:double,y2:double,x3:double,y3:double,x4:double,y4:double>"
BLOCK = f"struct<content:string,page_number:long,index:long,role:string,bounding_box:{_BBOX}>"
LAYOUT_SCHEMA = (
    f"metadata struct<page_count:long,model:string>, "
    f"text_blocks array<struct<content:string,text:string,page_number:long,page:long,index:long,role:string,bounding_box:{_BBOX}>>, "
    "tables array<struct<row_count:long,column_count:long,page_number:long,cells:array<struct<row_index:long,column_index:long,content:string,kind:string>>>>"
)


def read_layouts(spark: SparkSession, path: str, pattern: str = r"(\d+)\.json$") -> DataFrame:
    """Layout JSON files; ``pattern`` takes the document id out of the file name."""
    raw = spark.read.schema(LAYOUT_SCHEMA).option("multiLine", True).json(path)
    key = F.regexp_extract(F.input_file_name(), pattern, 1).cast("long")
    return unify_keys(raw.withColumn("doc_id", key))


def unify_keys(layouts: DataFrame) -> DataFrame:
    """Older layouts use `text`/`page`; missing block numbers are filled with the position."""
    blocks = F.transform(
        F.coalesce("text_blocks", F.array()),
        lambda b, i: F.struct(
            F.coalesce(b["content"], b["text"]).alias("content"),
            F.coalesce(b["page_number"], b["page"], F.lit(0)).alias("page_number"),
            F.coalesce(b["index"], i.cast("long")).alias("index"),
            b["role"].alias("role"),
            b["bounding_box"].alias("bounding_box"),
        ),
    )
    return layouts.withColumn("text_blocks", blocks)


def explode_blocks(layouts: DataFrame, *keys: str) -> DataFrame:
    return layouts.select(*keys, F.posexplode("text_blocks").alias("idx", "b")).select(*keys, F.col("idx").cast("long").alias("idx"), "b.*")


def explode_cells(layouts: DataFrame, *keys: str) -> DataFrame:
    tables = layouts.select(*keys, F.posexplode("tables").alias("table_no", "t"))
    cells = tables.select(*keys, "table_no", F.col("t.page_number").alias("page_number"), F.explode("t.cells").alias("c"))
    return cells.select(*keys, "table_no", "page_number", "c.*")


def _texts(blocks: Column, tables: Column | None) -> Column:
    own = F.transform(blocks, lambda b: F.struct(b["page_number"].alias("page"), b["content"].alias("text")))
    if tables is None:
        return own
    cells = F.flatten(
        F.transform(
            tables,
            lambda t: F.transform(t["cells"], lambda c: F.struct(t["page_number"].alias("page"), c["content"].alias("text"))),
        )
    )
    return F.concat(own, F.coalesce(cells, F.array().cast("array<struct<page:long,text:string>>")))


def all_text(blocks: Column, tables: Column | None = None) -> Column:
    """Whole text of a document: blocks, then cells, one line each; empty parts left out."""
    kept = F.filter(F.transform(_texts(blocks, tables), lambda x: x["text"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.array_join(kept, "\n")


def page_texts(layouts: DataFrame, *keys: str, tables: str | None = None) -> DataFrame:
    """(keys, page_number, text), one pass inside each row.

    Texts are sorted by page once; each page is then a run of that list, cut out by its bounds.
    """
    texts = F.transform(_texts(F.col("text_blocks"), F.col(tables) if tables else None), lambda x, i: F.struct(x["page"].alias("page"), i.alias("i"), x["text"].alias("text")))
    staged = layouts.select(*keys, F.array_sort(texts).alias("__texts"))
    at = lambda i: F.get("__texts", i)
    bounds = F.filter(F.sequence(F.lit(0), F.size("__texts") - 1), lambda i: (i == 0) | ~at(i)["page"].eqNullSafe(at(i - 1)["page"]))
    staged = staged.select("*", F.when(F.size("__texts") > 0, bounds).alias("__starts"))
    ends = F.concat(F.slice("__starts", F.lit(2), F.size("__starts")), F.array(F.size("__texts")))
    spans = F.zip_with("__starts", ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))

    def page(span: Column) -> Column:
        own = F.filter(F.slice("__texts", span["s"] + 1, span["e"] - span["s"]), lambda x: F.coalesce(x["text"], F.lit("")) != "")
        return F.struct(at(span["s"])["page"].alias("page_number"), F.array_join(F.transform(own, lambda x: x["text"]), "\n").alias("text"))

    return staged.select(*keys, F.inline(F.transform(spans, page)))


def merge_parts(parts: DataFrame, *keys: str) -> DataFrame:
    """Join page-range parts of a document: pages are shifted by the part's first page, parts kept in order."""
    moved = F.transform("text_blocks", lambda b: b.withField("page_number", b["page_number"] + F.col("first_page") - 1))
    grouped = parts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("first_page", moved.alias("blocks")))).alias("parts")
    )
    return grouped.select(*keys, F.flatten(F.transform("parts", lambda p: p["blocks"])).alias("text_blocks"))


def layout_summary(layouts: DataFrame, *keys: str, previews: int = 10, width: int = 70) -> DataFrame:
    first = F.transform(F.slice("text_blocks", 1, previews), lambda b: F.substring(b["content"], 1, width))
    return layouts.select(
        *keys,
        F.size("text_blocks").cast("long").alias("block_count"),
        F.coalesce(F.array_max(F.transform("text_blocks", lambda b: b["page_number"])), F.lit(0)).alias("page_count"),
        first.alias("previews"),
    )


def saved_pages(documents: DataFrame, existing: DataFrame) -> DataFrame:
    """Page rows still to be written: 1..page_count minus the pages already there."""
    wanted = documents.where(F.col("page_count") > 0).select(
        "document_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page_count").cast("long"))).alias("page_number")
    )
    return wanted.join(existing.select("document_id", "page_number"), ["document_id", "page_number"], "left_anti")


def blob_location(df: DataFrame, uri: str) -> DataFrame:
    """Container and path of `azure://account/container/path`; null when a part is missing."""
    pattern = r"^azure://[^/]*/([^/]*)/(.+)$"

    def part(group: int) -> Column:
        return F.nullif(F.regexp_extract(uri, pattern, group), F.lit(""))

    return df.withColumn("container", part(1)).withColumn("blob_path", part(2))
