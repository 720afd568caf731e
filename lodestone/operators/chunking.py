"""From spans to blocks, from blocks to sections, from sections to parent and child chunks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import keys
from lodestone.functions.splitting import split_column
from lodestone.functions.text import has_bullet, strip
from lodestone.operators.stages import stored

ATOMIC = ("table", "image")
#: How much larger than body text a heading's font is, for any heading and for levels 1 and 2.
HEADING_RATIO, LEVEL_RATIOS = 1.15, (1.8, 1.4)
HEADING_LENGTH = 200
#: Rows' places that every task may hold; more are joined.
MOST_PLACES = 200_000


def body_size(spans: DataFrame) -> DataFrame:
    """``source, page, body``: the upper median font size of a page's spans."""
    sizes = F.array_sort(F.collect_list("size"))
    return spans.groupBy("source", "page").agg(F.element_at(sizes, (F.floor(F.size(sizes) / 2) + 1).cast("int")).alias("body"))


def blocks(spans: DataFrame) -> DataFrame:
    """Spans joined to lines and lines to blocks, each classified as heading, bullet or text, with a heading's level."""
    page = body_size(spans)
    joined = lambda column, order, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column]), by)
    lines = spans.groupBy("source", "page", "block", "line").agg(joined("text", "span", "").alias("text"), F.max("size").alias("size"))
    each = lines.groupBy("source", "page", "block").agg(joined("text", "line", "\n").alias("content"), F.max("size").alias("size"))
    each = each.withColumn("content", strip(F.col("content"))).filter("content <> ''").join(page, ["source", "page"])
    ratio = F.col("size") / F.col("body")
    heading = (ratio >= HEADING_RATIO) & (F.length("content") < HEADING_LENGTH)
    kind = F.when(heading, "heading").when(has_bullet(F.col("content")), "bullet").otherwise("text")
    level = F.when(heading, heading_level(ratio))
    return each.select("source", "page", "block", "content", kind.alias("type"), level.alias("level"))


def heading_level(ratio: Column) -> Column:
    return F.when(ratio >= LEVEL_RATIOS[0], 1).when(ratio >= LEVEL_RATIOS[1], 2).otherwise(3)


def _places(rows: DataFrame, order: tuple[str, ...], **more: Column) -> DataFrame:
    """What orders and tells apart the rows of a source, without their texts, in ranges of (source, order), each numbered in ``_part``, so that a large
    source is many ranges and no task's alone. Rows that agree in all of this are one place."""
    told = rows.select("source", *order, _said(rows).alias("_said"), *(c.alias(n) for n, c in more.items()))
    # Ranges are found by a sample, which must not read the texts again. What is ranged by source and order needs no other shuffle to lose its repeats.
    return stored(stored(told).repartitionByRange("source", *order).distinct().withColumn("_part", F.spark_partition_id()))


def _filled(rows: DataFrame) -> Column:
    return F.coalesce(strip(F.col("content")) != "", F.lit(False)) if "content" in rows.columns else F.lit(True)


def _said(rows: DataFrame) -> Column:
    return F.xxhash64("content") if "content" in rows.columns else F.lit(0).cast("bigint")


def _placed(rows: DataFrame, places: DataFrame, order: tuple[str, ...], *found: str) -> DataFrame:
    """``rows`` with what was ``found`` for their places; texts stay where they are if the places are few enough to be sent to all tasks."""
    places = stored(places.select(F.col("source").alias("_source"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.col("_said"), *found))
    same = [F.col("source").eqNullSafe(F.col("_source")), *(F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(order)), _said(rows).eqNullSafe(F.col("_said"))]
    sent = F.broadcast(places) if places.count() <= MOST_PLACES else places
    return rows.drop(*found).join(sent, reduce(and_, same)).drop("_source", "_said", *(f"_o{i}" for i in range(len(order))))


def _carried(ranged: DataFrame, columns: dict[str, Column], over: Callable[[str], Column]) -> DataFrame:
    """``ranged`` with each of ``columns`` (aggregates of a range) taken over the source's ranges before a row's own, by ``over``."""
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tails = ranged.groupBy("source", "_part").agg(*(c.alias(n) for n, c in columns.items()))
    tails = tails.select(F.col("source").alias("_source"), F.col("_part").alias("_of"), *(over(n).over(before).alias(n) for n in columns))
    return ranged.join(tails, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_of")), "left").drop("_source", "_of")


def outline(rows: DataFrame, *order: str) -> DataFrame:
    """``source``, what orders its rows, ``heading, section_path, section`` of every place (``source, level, type, page, content``).

    A heading holds until one of its level or a higher one follows; pages do not end it. A heading, another path or another page begins a
    section; tables and images are in the one before and begin none. Sections are numbered from 0. Each range of a source is walked alone;
    what holds at its start comes from a row for each range before it. Of texts only those of headings move.
    """
    return _outlined(_headed(rows, order), order).drop("_said", "_n")


def _headed(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Places with all that an outline needs."""
    atomic, heading = (F.coalesce(c, F.lit(False)) for c in (F.col("type").isin(*ATOMIC), F.col("type") == "heading"))
    return _places(rows, order, level=F.col("level"), page=F.col("page"), _atomic=atomic, _whole=atomic & _filled(rows), _begin=heading, _head=F.when(F.col("level").isNotNull(), F.col("content")))


def _path(last: dict[int, Column]) -> tuple[Column, Column]:
    """The path and the innermost heading of the last headings of each level (``at, said``)."""
    later = lambda k, j: last[j].isNull() | (last[k]["at"] > last[j]["at"])
    holds = {k: last[k].isNotNull() & reduce(and_, (later(k, j) for j in range(1, k)), F.lit(True)) for k in last}
    shown = F.filter(F.array(*(F.when(holds[k], last[k]["said"]) for k in last)), lambda x: x.isNotNull())
    return F.array_join(shown, " > "), F.coalesce(F.try_element_at(shown, F.lit(-1)), F.lit(""))


def _outlined(places: DataFrame, order: tuple[str, ...]) -> DataFrame:
    over = Window.partitionBy("source", "_part").orderBy(*order, "_said")
    so_far, earlier = over.rowsBetween(Window.unboundedPreceding, 0), over.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order, "_said").alias("at")
    last = {f"_h{k}": F.max(F.when(F.col("level") == k, F.struct(at, F.col("_head").alias("said")))) for k in (1, 2, 3)}
    before = {"_text": F.max(F.when(~F.col("_atomic"), F.struct(at, "page")))}
    rows = _carried(places, last | before, F.max)
    start = _path({k: F.col(f"_h{k}") for k in (1, 2, 3)})[0]
    rows = rows.withColumns({f"_n{k}": F.coalesce(last[f"_h{k}"].over(so_far), F.col(f"_h{k}")) for k in (1, 2, 3)} | {"_start": start, "_text": F.coalesce(before["_text"].over(earlier), F.col("_text"))})
    path, heading = _path({k: F.col(f"_n{k}") for k in (1, 2, 3)})
    rows = rows.withColumns({"section_path": path, "heading": heading})
    # Only headings change the path, and they are texts: the row before tells that of the text before.
    other = ~F.col("section_path").eqNullSafe(F.coalesce(F.lag("section_path").over(over), F.col("_start"))) | ~F.col("page").eqNullSafe(F.col("_text.page"))
    begins = F.when(F.col("_atomic") | F.col("_text").isNull(), 0).otherwise((F.col("_begin") | other).cast("int"))
    rows = rows.select("source", *order, "_said", "_part", "section_path", "heading", begins.alias("_begins"), F.col("_whole").cast("int").alias("_whole"))
    rows = _carried(rows, {"_earlier": F.sum("_begins"), "_wholes": F.sum("_whole")}, F.sum)
    running = lambda c, start, frame: F.coalesce(start, F.lit(0)) + F.coalesce(F.sum(c).over(frame), F.lit(0))
    section, n = running("_begins", "_earlier", so_far), running("_whole", "_wholes", earlier)
    return rows.select("source", *order, "_said", "heading", "section_path", section.cast("bigint").alias("section"), n.cast("bigint").alias("_n"))


def breadcrumbs(rows: DataFrame, *order: str, numbered: bool = False) -> DataFrame:
    """``rows`` with the ``heading`` and ``section_path`` of their ``outline``; ``numbered``: with ``_section`` and ``_n`` too, which spare a chunker walks of its own."""
    need = {c: F.lit(None).cast("string") for c in ("type", "page") if c not in rows.columns}
    found = _outlined(_headed(rows.withColumns(need) if need else rows, order), order).groupBy("source", *order, "_said").agg(F.max(F.struct("section", "_n", "section_path", "heading")).alias("o"))
    numbers = [F.col("o.section").alias("_section"), F.col("o._n").alias("_n")] if numbered else []
    found = found.select("source", *order, "_said", "o.section_path", "o.heading", *numbers)
    return _placed(rows, found, order, "section_path", "heading", *(["_section", "_n"] if numbered else []))


def sections(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``section``, numbered from 0: a heading, another path or another page begins one.

    Each range of a source is walked alone: its first row is compared with the last one of the range before, and its sections follow those.
    """
    places = _places(rows, order, page=F.col("page"), _head=F.col("type") == "heading", _path=F.xxhash64("section_path"))
    over = Window.partitionBy("source", "_part").orderBy(*order, "_said")
    ranged = _carried(places, {"_last": F.max(F.struct(F.struct(*order, "_said").alias("at"), "_path", "page"))}, F.max)
    before = lambda c: F.when(F.row_number().over(over) == 1, F.col(f"_last.{c}")).otherwise(F.lag(c).over(over))
    first = (F.row_number().over(over) == 1) & F.col("_last").isNull()
    begins = F.coalesce("_head", F.lit(False)) | ~F.col("_path").eqNullSafe(before("_path")) | ~F.col("page").eqNullSafe(before("page"))
    ranged = ranged.withColumn("_begins", F.when(first, 0).otherwise(begins.cast("int"))).drop("_last")
    counted = _carried(ranged, {"_earlier": F.sum("_begins")}, F.sum)
    section = F.coalesce("_earlier", F.lit(0)) + F.sum("_begins").over(over.rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("section", section.cast("bigint"))
    return _placed(rows, counted.groupBy("source", *order, "_said").agg(F.max("section").alias("section")), order, "section")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``_n``, their number in their source from 0."""
    over = Window.partitionBy("source", "_part").orderBy(*order, "_said").rowsBetween(Window.unboundedPreceding, 0)
    counted = _carried(_places(rows, order), {"_earlier": F.count(F.lit(1))}, F.sum)
    return _placed(rows, counted.withColumn("_n", F.coalesce("_earlier", F.lit(0)) + F.row_number().over(over) - 1), order, "_n")


def _atomic(rows: DataFrame, strategy: str, *order: str) -> DataFrame:
    """Tables and images, whole: each its own parent."""
    index = F.lit(keys.ATOMIC_START) + F.col("_n")
    kept = rows.filter(F.col("type").isin(*ATOMIC) & (strip(F.col("content")) != ""))
    kept = kept if "_n" in rows.columns else _numbered(kept, *order)
    return kept.select("content", "page", "type", "source", "heading", "section_path", F.col("content").alias("parent_content"), keys.parent_id(F.col("source"), F.col("page"), F.col("section_path"), index).alias("parent_id"), F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), F.lit(strategy).alias("strategy"))


def hierarchical(rows: DataFrame, *order: str, child: tuple[int, int] = (512, 80), parent: tuple[int, int] = (1500, 100)) -> DataFrame:
    """Chunks of blocks (``content, page, type, source, heading, section_path`` and what orders them).

    A section's texts are cut to parents and each parent to children, which carry it; tables and images stay whole. Metadata is
    that of a section's first block.
    """
    text = rows.filter(~F.col("type").isin(*ATOMIC))
    text = text.withColumnRenamed("_section", "section") if "_section" in rows.columns else sections(text, *order)
    each = F.struct(*order, "content", "page", "type", "heading", "section_path")
    # A number of its own: cutting is much work for few bytes, so partitions must not be put together by their size.
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = text.repartition(spread, "source", "section").groupBy("source", "section").agg(F.array_sort(F.collect_list(each)).alias("b"))
    joined = F.array_join(F.transform("b", lambda x: x["content"]), "\n\n")
    grouped = grouped.select("source", "section", joined.alias("whole"), F.col("b")[0].alias("m"))
    parents = grouped.select("source", "section", "m", F.posexplode(split_column(F.col("whole"), "recursive", *parent)).alias("p", "parent_content"))
    index = F.col("section") * keys.SECTION_STEP + F.col("p")
    parents = parents.withColumn("parent_id", keys.parent_id(F.col("source"), F.col("m.page"), F.col("m.section_path"), index))
    cut = parents.withColumn("c", split_column(F.col("parent_content"), "recursive", *child)).withColumn("total_chunks", F.size("c"))
    out = cut.select("source", "m", "parent_content", "parent_id", "total_chunks", F.posexplode("c").alias("chunk_index", "content"))
    chunks = out.select("content", "m.page", "m.type", "source", "m.heading", "m.section_path", "parent_content", "parent_id", "chunk_index", "total_chunks", F.lit("hierarchical").alias("strategy"))
    return chunks.unionByName(_atomic(rows, "hierarchical", *order))


def flat(rows: DataFrame, how: str, size: int, overlap: int, *order: str) -> DataFrame:
    """Each text block cut alone, by ``recursive`` or ``fixed``; tables and images pass. No parents."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    text = rows.filter(~F.col("type").isin(*ATOMIC))
    text = text.repartition(cores) if len(rows.inputFiles()) < cores else text
    cut = text.withColumn("c", split_column(F.col("content"), how, size, overlap)).withColumn("total_chunks", F.size("c"))
    none = F.lit(None).cast("string")
    out = cut.select(F.posexplode("c").alias("chunk_index", "content"), "page", "type", "source", "heading", "section_path", none.alias("parent_content"), none.alias("parent_id"), "total_chunks", F.lit(how).alias("strategy"))
    return out.select("content", "page", "type", "source", "heading", "section_path", "parent_content", "parent_id", "chunk_index", "total_chunks", "strategy").unionByName(_atomic(rows, "none", *order).withColumns({"parent_content": none, "parent_id": none}))


_STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "hierarchical": hierarchical,
    "recursive": lambda rows, *order: flat(rows, "recursive", 500, 50, *order),
    "fixed": lambda rows, *order: flat(rows, "fixed", 500, 50, *order),
}


def available_strategies() -> list[str]:
    return sorted(_STRATEGIES)


def chunker(strategy: str) -> Callable[..., DataFrame]:
    """A strategy by name: a function of blocks and the columns that order them."""
    if strategy not in _STRATEGIES:
        raise ValueError(f"no chunking strategy {strategy!r}; there are {', '.join(available_strategies())}")
    return _STRATEGIES[strategy]


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row of count, mean, shortest and longest length; none for no chunks."""
    n = F.length("content")
    out = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.bround(F.avg(n)).cast("bigint").alias("mean_length"), F.min(n).cast("bigint").alias("min_length"), F.max(n).cast("bigint").alias("max_length"))
    return out.filter("n_chunks > 0")


def type_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
