"""Replies of outside models that last: a store by prompt, calls with retries and a breaker, failures by row."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.package import ship
from ..sources.shared import read_or_empty

Model = Callable[[list[str]], list[str]]
ROWS = "key string, reply string, error string, tries int"


@dataclass(frozen=True)
class Gate:
    """How a model is called: prompts at a time, tries for each, seconds before the first retry, failed prompts in a row that shut it."""

    batch: int = 16
    tries: int = 3
    wait: float = 0.5
    shut: int = 8


def _asked(model: Model, prompts: list[str]) -> list[str | None]:
    """A whole list of replies, or an error: half an answer says nothing about which prompts it is for."""
    out = list(model(prompts))
    if len(out) != len(prompts):
        raise ValueError(f"{len(out)} replies to {len(prompts)} prompts")
    return out


def called(model: Model, prompts: list[str], gate: Gate, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[str | None, str | None, int]]:
    """(reply, error, tries) of each prompt, in order.

    A batch is sent once. Where it fails, or has too few replies, or a reply is null, its prompts go one by one, up to
    ``tries`` times each, the waits doubling. After ``shut`` prompts in a row without a reply the service counts as gone:
    what is left isn't sent and says so.
    """
    lost = 0
    for at in range(0, len(prompts), gate.batch):
        part = prompts[at : at + gate.batch]
        first: list[str | None] = [None] * len(part)
        if lost < gate.shut:
            try:
                first = _asked(model, part)
            except Exception as e:  # an outside service may fail in any way
                why = repr(e)
            else:
                why = "no reply"
        for prompt, reply in zip(part, first, strict=True):
            if lost >= gate.shut:
                yield None, "unavailable", 0
                continue
            tries = 1
            while reply is None and tries < gate.tries:
                sleep(gate.wait * 2 ** (tries - 1))
                tries += 1
                try:
                    reply = _asked(model, [prompt])[0]
                except Exception as e:
                    why = repr(e)
            lost = 0 if reply is not None else lost + 1
            yield reply, None if reply is not None else why[:500], tries


def reply_key(prompt: Column, name: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(name), prompt), 256)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (key, reply) that the store holds, each key once; failures don't count."""
    return read_or_empty(spark, f"{folder}/replies", ROWS).where("reply is not null").groupBy("key").agg(F.min("reply").alias("reply"))


def with_replies(rows: DataFrame, prompt: Column, model: Model | None, folder: str, name: str = "model", gate: Gate = Gate(), commits: int = 4) -> DataFrame:
    """Add ``reply`` and ``error`` to each row; both null without a prompt, "no model" where there is no model and no stored reply.

    Each distinct prompt is sent once, if the store in ``folder`` has no reply of the model ``name`` to it. Replies are written in
    ``commits`` appends, each of which readers see whole or not at all, before any row is joined: neither a lost executor nor a
    second run sends a prompt again, and after a run that was killed only what its open append held is sent again. Failed
    prompts are on record with their error and tries and are sent again by the next run. One writer at a time is assumed;
    two that send the same prompt cost a call, and the same reply is then given to all.
    """
    spark = rows.sparkSession
    ship(spark)
    x = rows.withColumn("_key", reply_key(prompt, name)).withColumn("_key", F.when(prompt.isNotNull(), F.col("_key")))
    asked = x.where("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.min(prompt).alias("prompt"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = list(called(model, part["prompt"].tolist(), gate))
            yield pd.DataFrame({"key": part["key"], "reply": [g[0] for g in got], "error": [g[1] for g in got], "tries": [g[2] for g in got]})

    if model is not None:
        for i in range(commits):
            mine = asked.where(F.pmod(F.xxhash64("key"), F.lit(commits)) == i).join(stored(spark, folder), "key", "left_anti")
            mine.mapInPandas(run, ROWS).write.mode("append").parquet(f"{folder}/replies")
    failed = read_or_empty(spark, f"{folder}/replies", ROWS).where("reply is null").groupBy("key").agg(F.max("error").alias("error"))
    known = stored(spark, folder).join(failed, "key", "full").select(F.col("key").alias("_key"), "reply", F.when(F.col("reply").isNull(), F.col("error")).alias("error"))
    out = x.join(known, "_key", "left")
    return out.withColumn("error", F.coalesce("error", F.when(F.col("reply").isNull() & F.col("_key").isNotNull(), "no model"))).drop("_key")
