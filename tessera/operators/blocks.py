"""Block grid for quadratic vector work (pair distances).

The left and right tables are each cut into hash blocks of bounded size. The
left block ``i`` and the right block ``j`` meet in grid cell ``(i, j)``: every
left row is replicated once per right block and every right row once per left
block, then one shuffle on the cell id brings both halves of a cell into one
``applyInPandas`` group. A cell holds at most about ``left_rows + right_rows``
rows, so no group grows with the data; the number of cells does. Each cell
emits a bounded summary (per-cluster sums), never all pairs.

Block counts are derived from two ``count()`` actions on the driver; no row
data passes through the driver and nothing is broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import parallelism

DEFAULT_LEFT_ROWS = 4096
DEFAULT_RIGHT_ROWS = 16384
# Memory budget of one side of a cell as float64 vectors (wide vectors get
# fewer rows per block).
DEFAULT_CELL_BYTES = 128 << 20
MIN_BLOCK_ROWS = 256
# Smallest left block worth a Python worker when splitting only for parallelism.
MIN_LEFT_ROWS_FOR_PARALLELISM = 64


@dataclass(frozen=True)
class Grid:
    left_blocks: int
    right_blocks: int

    @property
    def cells(self) -> int:
        return self.left_blocks * self.right_blocks


def plan_grid(spark, n_left: int, n_right: int, left_rows: int = DEFAULT_LEFT_ROWS,
              right_rows: int = DEFAULT_RIGHT_ROWS, dims: int | None = None,
              cell_bytes: int = DEFAULT_CELL_BYTES) -> Grid:
    """Choose block counts so every cell stays within the row and byte budgets.

    With ``dims`` known, a block holds at most ``cell_bytes`` of float64
    vectors, so wide embeddings get proportionally smaller blocks.
    """
    if dims:
        per_row = 8 * dims
        right_rows = min(right_rows, max(MIN_BLOCK_ROWS, cell_bytes // per_row))
        left_rows = min(left_rows, max(MIN_BLOCK_ROWS, cell_bytes // (4 * per_row)))
    par = parallelism(spark)
    bl = max(1, math.ceil(n_left / left_rows))
    br = max(1, math.ceil(n_right / right_rows))
    # Keep every core busy when the data is small: split the left side further.
    want = min(2 * par, max(1, n_left // MIN_LEFT_ROWS_FOR_PARALLELISM))
    if bl * br < want:
        bl = max(bl, math.ceil(want / br))
    return Grid(bl, br)


def grid_cells(left: DataFrame, right: DataFrame, grid: Grid,
               left_key: str = "_id", right_key: str = "_id") -> DataFrame:
    """Union of both sides keyed by grid cell, hash-partitioned on the cell.

    Output columns: all input columns (both sides must share them) plus
    ``_side`` (0 left, 1 right) and ``_cell``. Blocks are assigned by a hash of
    the row key, so the assignment is identical on every recomputation.
    """
    bl, br = grid.left_blocks, grid.right_blocks
    lhs = (left.withColumn("_lb", F.pmod(F.xxhash64(F.col(left_key)), F.lit(bl)))
           .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.lit(br - 1))))
           .withColumn("_side", F.lit(0).cast("byte")))
    rhs = (right.withColumn("_rb", F.pmod(F.xxhash64(F.col(right_key)), F.lit(br)))
           .withColumn("_lb", F.explode(F.sequence(F.lit(0), F.lit(bl - 1))))
           .withColumn("_side", F.lit(1).cast("byte")))
    both = lhs.unionByName(rhs)
    both = both.withColumn("_cell", (F.col("_lb") * F.lit(br) + F.col("_rb")).cast("long"))
    # Explicit partition count: AQE does not coalesce it, so small inputs keep
    # about one cell per task instead of collapsing into a single task; large
    # grids share the configured shuffle width.
    spark = left.sparkSession
    try:
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        width = 200
    n_parts = max(1, min(grid.cells, max(width, parallelism(spark))))
    return both.drop("_lb", "_rb").repartition(n_parts, "_cell")
