"""A store of answers, so that equal requests are paid for once.

A request's key is a hash of all that decides its answer: prompt, model,
completion budget, sampling parameters, and a name for the provider's version.
Successful answers stay in a Parquet folder, one subfolder for each run. A run
meets its requests with the keys of the store (an anti-join on the hash; no
prompt is shuffled but those to be sent), calls the provider for the others,
each distinct request once, and appends. So a second output, a changed corpus
or a restart pays only for what is new, and a failed request is tried again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.operators.annotate import ANSWER_SCHEMA, REQUEST_PARAMS, Provider, annotate, route_model

STORED = "key string, " + ANSWER_SCHEMA + ", run string"
ANSWER_COLS = [f.split()[0] for f in ANSWER_SCHEMA.split(", ")]


def request_key(prompt, model, budget, version: str = "") -> Column:
    """Hash of a request. Null fields differ from empty ones; field lengths keep neighbours apart."""
    chat = {k: v for k, v in REQUEST_PARAMS.items() if k != "top_p"}
    params = F.when(route_model(model), F.lit(json.dumps(chat, sort_keys=True))).otherwise(F.lit(json.dumps(REQUEST_PARAMS, sort_keys=True)))
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    fields = [F.lit(version), F.col(model), F.col(budget).cast("string"), params, F.col(prompt)]
    return F.sha2(F.concat(*[part(c) for c in fields]), 256)


class AnswerStore:
    """Answers under one folder of storage that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.createDataFrame([], STORED).drop("run").write.mode("ignore").parquet(f"{self.folder}/run=none")

    def answers(self) -> DataFrame:
        """(key, answer columns, run) of every stored answer, a key once."""
        all_ = self.spark.read.schema(STORED).option("basePath", self.folder).parquet(f"{self.folder}/run=*")
        first = F.min_by(F.struct(*ANSWER_COLS, "run"), F.col("run")).alias("a")
        return all_.where("error is null").groupBy("key").agg(first).select("key", "a.*")

    def annotate(self, requests: DataFrame, provider: Provider, *, keep: list[str] | None = None, prompt_col: str = "prompt",
                 model_col: str = "model", budget_col: str = "max_tokens", version: str = "", run: str | None = None,
                 **options) -> DataFrame:
        """``annotate`` through the store: ``keep`` columns, the answer columns,
        and ``run``, the run whose call gave the answer (null for a request that failed).

        ``version`` names the provider as far as it changes answers; ``run``
        names this run (a name is used once). ``options`` go to ``annotate``."""
        keep = list(keep or ["path", "identifier"])
        run = run or uuid.uuid4().hex
        keyed = requests.withColumn("_key", request_key(prompt_col, model_col, budget_col, version))
        sent = keyed.select(F.col("_key").alias("key"), F.col(prompt_col).alias("prompt"), F.col(model_col).alias("model"),
                            F.col(budget_col).alias("max_tokens"))
        new = sent.join(self.answers().select("key"), "key", "left_anti").dropDuplicates(["key"])
        place = f"{self.folder}/run={run}"
        # Written once; what follows reads the files, so nothing calls the provider again.
        annotate(new, provider, keep=["key"], **options).write.mode("error").parquet(place)
        failed = (self.spark.read.schema(STORED).parquet(place).where("error is not null")
                  .select("key", *ANSWER_COLS, F.lit(None).cast("string").alias("run")))
        known = self.answers().select("key", *ANSWER_COLS, "run").unionByName(failed)
        return (keyed.select(*keep, F.col("_key").alias("key")).join(known, "key")
                .select(*keep, *ANSWER_COLS, "run"))
