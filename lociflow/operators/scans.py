"""Running sums and maxima in two levels, so that a long chromosome isn't one task's work.

Rows are grouped in blocks of neighbouring positions. What stands before (or after) a block comes from one
row a block; within the block an ordinary window does the rest. All columns of a scan go in one pass, so the
rows that it starts from are shuffled once and that shuffle serves both levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOLDS = {"sum": F.sum, "max": F.max}
WIDTH = 1024


def running(df: DataFrame, keys: list[str], order: list[str], position: str, folds: dict[str, tuple[str, Column]], before: bool, width: int = WIDTH, cell: Column | None = None, next_position: str | None = None, totals: bool = False) -> DataFrame:
    """df with a column for each of folds (name: kind, value): its running fold by keys and order.

    before: up to the row before, else with the row itself. A block is `width` positions, or where cell has one
    value, which may not fall along the order. next_position: name of a column with the next row's position, null
    in the last. totals: also all_<name>, the fold of all rows of the keys.
    """
    block = F.floor(F.col(position) / width) if cell is None else cell
    df = df.withColumns({"_block": block} | {f"_v_{n}": v for n, (_, v) in folds.items()})
    fold = {n: FOLDS[kind] for n, (kind, _) in folds.items()}
    per_block = [f(f"_v_{n}").alias(f"_t_{n}") for n, f in fold.items()] + ([F.min(position).alias("_first")] if next_position else [])
    blocks = df.groupBy(*keys, "_block").agg(*per_block)
    by_block = Window.partitionBy(*keys).orderBy("_block")
    ahead = by_block.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    extra = {f"_a_{n}": f(f"_t_{n}").over(ahead) for n, f in fold.items()}
    extra |= {f"all_{n}": f(f"_t_{n}").over(whole) for n, f in fold.items()} if totals else {}
    extra |= {"_after": F.lead("_first").over(by_block)} if next_position else {}
    blocks = blocks.withColumns(extra).drop("_first", *[f"_t_{n}" for n in folds])
    in_block = Window.partitionBy(*keys, "_block").orderBy(*order)
    rows = in_block.rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    inner = {f"_i_{n}": f(f"_v_{n}").over(rows) for n, f in fold.items()}
    inner |= {"_next": F.lead(position).over(in_block)} if next_position else {}
    # Blocks are few beside rows: the join brings them to where the windows have put the rows.
    out = df.withColumns(inner).join(blocks, [*keys, "_block"])
    zero = F.lit(0)
    both = {n: F.coalesce(F.col(f"_a_{n}"), zero) + F.coalesce(F.col(f"_i_{n}"), zero) if kind == "sum" else F.greatest(f"_a_{n}", f"_i_{n}") for n, (kind, _) in folds.items()}
    both |= {next_position: F.coalesce("_next", "_after")} if next_position else {}
    return out.withColumns(both).drop("_block", "_next", "_after", *[f"_{x}_{n}" for n in folds for x in "vai"])


def following(df: DataFrame, keys: list[str], position: str, columns: dict[str, str], width: int = WIDTH) -> DataFrame:
    """df with new columns (name: column) of the next row by position, which differs within the keys; null in the last."""
    df = df.withColumn("_block", F.floor(F.col(position) / width))
    rest = list(dict.fromkeys(columns.values()))
    row = F.struct(position, *[c for c in rest if c != position])
    blocks = df.groupBy(*keys, "_block").agg(F.min(row).alias("_first"))
    blocks = blocks.withColumn("_after", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block"))).drop("_first")
    inner = F.lead(row).over(Window.partitionBy(*keys, "_block").orderBy(position))
    out = df.withColumn("_next", inner).join(blocks, [*keys, "_block"])
    return out.withColumns({n: F.coalesce(F.col(f"_next.{c}"), F.col(f"_after.{c}")) for n, c in columns.items()}).drop("_block", "_next", "_after")


def haloed(df: DataFrame, position: str, reach: int, width: int = WIDTH) -> DataFrame:
    """df with _block and _own: each row in its block of positions and, not as its own, in those that `reach` comes to.

    What a row within reach of others needs is then in its own block: windows go by block, not by chromosome.
    """
    width = max(width, 4 * reach)
    near = F.sequence(F.floor((F.col(position) - reach) / width), F.floor((F.col(position) + reach) / width))
    return df.withColumn("_block", F.explode(near)).withColumn("_own", F.col("_block") == F.floor(F.col(position) / width))


def running_sum(df: DataFrame, keys: list[str], order: list[str], position: str, value: Column, out: str, width: int = WIDTH, cell: Column | None = None) -> DataFrame:
    return running(df, keys, order, position, {out: ("sum", value)}, False, width, cell)


def max_before(df: DataFrame, keys: list[str], order: list[str], position: str, value: Column, out: str, width: int = WIDTH) -> DataFrame:
    return running(df, keys, order, position, {out: ("max", value)}, True, width)
