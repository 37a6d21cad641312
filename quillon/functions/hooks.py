"""Seams for functions that a user brings (V1, V2)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def token_counter(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """V1: a function of a text as a column function, by Arrow batches; a null counts 0."""

    @F.arrow_udf(IntegerType())
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([0 if t is None else count(t) for t in texts.to_pylist()], pa.int32())

    return counted


def judged(df: DataFrame, key: str, prompt: str, call: Callable[[list[str]], list[str]], schema: str, batch: int = 16) -> DataFrame:
    """V2: key, answer (parsed by schema, null if it doesn't fit) and error of a remote judge, which gets lists of prompts.  An exception is
    the error of its whole list, so that one failure doesn't end the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                try:
                    answers, error = call(part.column(1).to_pylist()), None
                except Exception as e:  # noqa: BLE001  whatever the remote side raises is data here
                    answers, error = [None] * part.num_rows, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(answers, pa.string()), pa.array([error] * part.num_rows, pa.string())], names=[key, "raw", "error"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(key, prompt).mapInArrow(run, f"`{key}` {kind}, raw string, error string")
    answer = F.from_json("raw", schema, {"mode": "PERMISSIVE"})
    return out.select(key, answer.alias("answer"), F.coalesce("error", F.when(F.try_parse_json("raw").isNull(), "not JSON")).alias("error"))
