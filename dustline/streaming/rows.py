"""Row blocks as a stream: ordered, gap-free frames, row by row with bounded state.

State of a frame is the next expected row and blocks that came early; a block that overlaps or repeats rows is an error. Rows leave in
order, whatever order blocks arrive in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dustline.operators.analysis import working

BLOCKS = "frame_id string, start_row int, valid_rows int, width int, last boolean, ir array<int>, r array<int>"
ROWS = "frame_id string, y int, width int, n_low long, sum_ir long, complete boolean"
STATE = "next int, ended int, held string"


def blocks(spark: SparkSession, path: str, per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files of row blocks."""
    return spark.readStream.schema(BLOCKS).option("maxFilesPerTrigger", per_trigger).parquet(path)


def ordered_rows(stream: DataFrame, threshold: float) -> DataFrame:
    """One row for each row of a frame as soon as all rows before it are there: samples at or below the threshold, the sum of infrared, and whether the frame is complete with it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        nxt, ended, held = (state.get[0], state.get[1], json.loads(state.get[2])) if state.exists else (0, -1, {})
        for pdf in batches:
            for b in pdf.itertuples():
                if b.start_row < nxt or str(b.start_row) in held:
                    raise ValueError(f"{key[0]}: rows from {b.start_row} overlap what has come")
                ir = list(b.ir)
                if len(ir) != b.valid_rows * b.width:
                    raise ValueError(f"{key[0]}: a block's samples don't fill its rows")
                lines = [[int(sum(v <= threshold for v in ir[i : i + b.width])), int(sum(ir[i : i + b.width]))] for i in range(0, len(ir), b.width)]
                held[str(b.start_row)] = [int(b.width), lines]
                if b.last:
                    ended = int(b.start_row + b.valid_rows)
        out = []
        while str(nxt) in held:
            width, lines = held.pop(str(nxt))
            for low, total in lines:
                out.append((key[0], nxt, width, low, total, nxt + 1 == ended))
                nxt += 1
        if held and ended >= 0 and nxt >= ended:
            raise ValueError(f"{key[0]}: rows come after the last block")
        state.update((nxt, ended, json.dumps(held)))
        yield pd.DataFrame(out, columns=["frame_id", "y", "width", "n_low", "sum_ir", "complete"])

    return stream.groupBy("frame_id").applyInPandasWithState(run, ROWS, STATE, "append", GroupStateTimeout.NoTimeout)


def response_stream(stream: DataFrame) -> DataFrame:
    """A stateless stream: the response of every sample, in micro-batches."""
    px = stream.select("frame_id", "start_row", "width", F.posexplode(F.arrays_zip("r", "ir")).alias("i", "s"))
    px = px.select("frame_id", F.expr("cast(start_row + i div width AS int)").alias("y"), F.expr("cast(i % width AS int)").alias("x"), F.col("s.r").alias("r"), F.col("s.r").alias("g"), F.col("s.r").alias("b"), F.col("s.ir").alias("ir"))
    return working(px).select("frame_id", "y", "x", "wr", "wi")


def epoch_counts(stream: DataFrame, rows: int = 8) -> DataFrame:
    """Count-based tumbling windows: accepted samples of each band of so many rows (complete mode)."""
    px = stream.select("frame_id", "start_row", "width", F.posexplode("ir").alias("i", "ir"))
    return px.groupBy("frame_id", F.expr(f"cast((start_row + i div width) div {rows} AS int)").alias("band")).agg(F.count("*").alias("n"), F.sum("ir").alias("sum_ir"))
