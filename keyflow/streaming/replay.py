"""The fold of a command log as a stream: one state for each key, with its deadline as data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import COMMANDS
from ..plans import fold

OUT = "seq long, sub int, key binary, kind string, ival long, bulk binary, val binary, is_int boolean, deadline_ns long"
HELD = "val binary, is_int boolean, deadline_ns long"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A key's rows of a micro-batch, in order; every reply row also shows the entry after it."""
    entry = None
    if state.exists:
        val, is_int, deadline = state.get
        entry = fold.Entry(bytes(val), bool(is_int), None if deadline is None else int(deadline))
    rows = []
    for r in pd.concat([*frames]).sort_values(["seq", "sub"]).itertuples():
        reply, entry = fold.step(entry, r.name, [bytes(a) for a in r.args], int(r.now_ns))
        rows.append((r.seq, r.sub, key[0], *reply, *(entry or (None, None, None))))
    if entry is None:
        if state.exists:
            state.remove()
    else:
        state.update(tuple(entry))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
    yield out.astype({"ival": "Int64", "deadline_ns": "Int64", "is_int": "boolean"})


def replies(commands: DataFrame) -> DataFrame:
    """A stream of replies (and entries after them) for a stream of commands that act key by key.

    Micro-batches are taken in the order of arrival, and rows within one in the order of ``seq``. Commands must have keys: others, and
    barriers, belong to a batch replay. Expiry follows each command's ``now_ns``, so a rerun gives the same replies."""
    from ..plans.replay import parts

    upper = commands.withColumn("name", F.upper("name")).filter(F.col("name").isin(*fold.COMMANDS))
    return parts(upper).groupBy("key").applyInPandasWithState(_step, OUT, HELD, "append", "NoTimeout")


def read_commands(spark, folder: str, files_at_once: int = 1) -> DataFrame:
    """A stream of the command files (Parquet) of a folder, in the order of their times."""
    return spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", files_at_once).parquet(folder)
