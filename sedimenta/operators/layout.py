"""Text by place on a page: captions above tables, text outside of them.

Boxes and characters meet by cells of a grid, so a page is spread over as many
tasks as it has cells. A character lies in one cell only, its middle's, and a
box in all that it touches, so that they meet at most once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Side of a cell in points. A box is in about (width / CELL + 1) * (height / CELL + 1) cells.
CELL = 100
#: A caption lies at most so far above its table.
ABOVE = 30
#: Characters are of one line if their tops differ by no more from one to the next, and of one word if so does the gap.
NEAR = 3


def _cell(at: Column | str) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / CELL)


def _in_cells(boxes: DataFrame, x0: str, x1: str, y0: str, y1: str) -> DataFrame:
    """A row a cell that a box touches; boxes turned inside out or with a null side touch none."""
    sound = (F.col(x0) <= F.col(x1)) & (F.col(y0) <= F.col(y1))
    b = boxes.where(sound).withColumn("_gx", F.explode(F.sequence(_cell(x0), _cell(x1))))
    return b.withColumn("_gy", F.explode(F.sequence(_cell(y0), _cell(y1))))


def outside_boxes(chars: DataFrame, boxes: DataFrame) -> DataFrame:
    """``page``, ``text`` of characters (page, x, top, c) whose place is in no box (page, x0, x1, y0, y1).

    A character starts a new line if its top is over ``NEAR`` from the one
    before, in order of top, then x. Characters of a null place are in no box,
    and stand first. Those of equal tops are put together before lines are told.
    """
    b = boxes.select(F.col("page").alias("_p"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("y0").alias("_y0"), F.col("y1").alias("_y1"))
    b = _in_cells(b, "_x0", "_x1", "_y0", "_y1")
    meet = (F.col("page") == F.col("_p")) & (_cell("x") == F.col("_gx")) & (_cell("top") == F.col("_gy"))
    inside = meet & F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("top").between(F.col("_y0"), F.col("_y1"))
    free = chars.select("page", "x", "top", "c").join(b, inside, "left_anti")
    tops = free.groupBy("page", "top").agg(F.collect_list(F.struct("top", "x", "c")).alias("cs"))
    w = Window.partitionBy("page").orderBy("top")
    jump = F.coalesce((F.col("top") - F.lag("top").over(w) > NEAR).cast("int"), F.lit(0))
    run = tops.withColumn("jump", jump).withColumn("line", F.sum("jump").over(w))
    lines = run.groupBy("page", "line").agg(F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("cs"))), lambda s: s["c"]), "").alias("t"))
    return lines.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda s: s["t"]), "\n").alias("text"))


def captions(chars: DataFrame, boxes: DataFrame, above: float = ABOVE) -> DataFrame:
    """``page``, ``box``, ``caption``: the text that lies wholly over a table and at most ``above`` points above it.

    ``chars``: page, x0, x1, top, bottom, c; ``boxes``: page, box, x0, x1, y0,
    y1 (tops grow downwards). Lines and words are told by ``NEAR``, all white
    space becomes one space. A table with no such text, or of a null or
    reversed side, has a null caption. Each row of ``boxes`` gives one row;
    boxes of equal page and name should have equal places, else all of their
    text is given to each of them.
    """
    over = boxes.select(F.col("page").alias("_p"), F.col("box").alias("_b"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.greatest(F.lit(0), F.col("y0") - above).alias("_y0"), F.col("y0").alias("_y1")).distinct()
    over = _in_cells(over, "_x0", "_x1", "_y0", "_y1")
    place = chars.select("page", "x0", "x1", "top", "bottom", "c")
    middle = lambda a, b: _cell((F.col(a) + F.col(b)) / 2)
    meet = (F.col("page") == F.col("_p")) & (middle("x0", "x1") == F.col("_gx")) & (middle("top", "bottom") == F.col("_gy"))
    within = meet & (F.col("x0") >= F.col("_x0")) & (F.col("x1") <= F.col("_x1")) & (F.col("top") >= F.col("_y0")) & (F.col("bottom") <= F.col("_y1"))
    hit = place.join(over, within).select("page", F.col("_b").alias("box"), "x0", "x1", "top", "c")
    w = Window.partitionBy("page", "box")
    down = w.orderBy("top", "x0", "x1", "c")
    jump = F.coalesce((F.col("top") - F.lag("top").over(down) > NEAR).cast("int"), F.lit(0))
    lined = hit.withColumn("jump", jump).withColumn("line", F.sum("jump").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    along = w.orderBy("line", "x0", "x1", "c")
    new = (F.lag("line").over(along) < F.col("line")) | (F.col("x0") - F.lag("x1").over(along) > NEAR)
    piece = F.when(F.coalesce(new, F.lit(False)), F.concat(F.lit(" "), F.col("c"))).otherwise(F.col("c"))
    one = F.struct("line", "x0", "x1", "c", "piece")
    read = lined.withColumn("piece", piece).groupBy("page", "box").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["piece"]), "").alias("t"))
    bare = F.trim(F.regexp_replace("t", r"[\s\p{Z}]+", " "))
    told = read.select(F.col("page").alias("_p"), F.col("box").alias("_b"), F.when(bare != "", bare).alias("caption"))
    same = (F.col("page") == F.col("_p")) & (F.col("box") == F.col("_b"))
    return boxes.select("page", "box").join(told, same, "left").select("page", "box", "caption")
