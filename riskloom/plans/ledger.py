"""Decisions and their audit events written as one: staged files, then one commit that shows both or neither.

A batch's decisions and events are written to folders named by the attempt. The commit is a manifest of the next number,
put in its place by a rename that fails if the number is taken, so two writers can't commit on the same head; the loser
starts again from the new head or gives up. Readers see only stages that a manifest names. A batch that has been committed
before is left alone, so a repeated micro-batch changes nothing. What an attempt that failed has left is never read.

Events carry on the chain of `audit`: numbers and blocks go on from the head, and each manifest's head covers the one before
and the hashes of the blocks it adds. `verify` checks rows, blocks, heads, and the stored columns against the payloads.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit

EMPTY = {"number": -1, "batch": None, "stage": None, "next_seq": 0, "next_block": 0, "head": audit.GENESIS}


class CommitConflict(RuntimeError):
    """Another writer has committed on the same head."""


class Ledger:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        return jvm, place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifests(self) -> list[dict]:
        """All commits in order: one small record a batch."""
        _, place, files = self._files()
        if not files.exists(place):
            return []
        rows = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(f"{self.folder}/commits").collect()
        return sorted((json.loads(r[0]) for r in rows), key=lambda m: m["number"])

    def _put(self, manifest: dict) -> None:
        """The manifest at its number; a number that is taken is a conflict."""
        jvm, place, files = self._files()
        files.mkdirs(place)
        staged = jvm.org.apache.hadoop.fs.Path(place, f".{uuid.uuid4().hex}")
        out = files.create(staged, False)
        out.write(json.dumps(manifest, sort_keys=True).encode())
        out.close()
        target = jvm.org.apache.hadoop.fs.Path(place, f"{manifest['number']:012d}.json")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(staged, target, options)
        except Exception as e:
            files.delete(staged, False)
            raise CommitConflict(f"commit {manifest['number']} is there already") from e

    def _write_decisions(self, decisions: DataFrame, stage: str) -> None:
        decisions.write.parquet(f"{self.folder}/decisions/stage={stage}")

    def _write_events(self, decisions: DataFrame, stage: str, last: dict) -> DataFrame:
        """The decisions' audit events, chained on from the head; each with the columns that its payload must equal."""
        records = audit.ranked(audit.payload(decisions), "t0", "k").withColumnRenamed("rank", "seq")
        blocks = records.withColumn("block", F.lit(last["next_block"]).cast("long") + F.expr("cast(seq div 1000 as long)")).withColumn("seq", F.col("seq") + F.lit(last["next_seq"]))
        chained = audit.hashed(blocks.select("block", "seq", "k", "payload"))
        events = chained.join(decisions.select("k", *(c for c in audit.CHECKED if c in decisions.columns)), "k").withColumn("event_type", F.lit("DECISION_CREATED"))
        events.write.parquet(f"{self.folder}/events/stage={stage}")
        return self.spark.read.parquet(f"{self.folder}/events/stage={stage}")

    def commit(self, batch: str, decisions: DataFrame) -> bool:
        """Write a batch's decisions and events; false if the batch has been committed before. An order id may be in it once."""
        known = self.manifests()
        if any(m["batch"] == batch for m in known):
            return False
        last, stage = known[-1] if known else EMPTY, uuid.uuid4().hex
        self._write_decisions(decisions, stage)
        stored = self.spark.read.parquet(f"{self.folder}/decisions/stage={stage}")
        events = self._write_events(stored, stage, last)
        row = events.agg(F.count("*").alias("n"), (F.max("block") + 1).alias("next_block")).first()
        manifest = {"number": last["number"] + 1, "batch": batch, "stage": stage, "next_seq": last["next_seq"] + row["n"], "next_block": last["next_block"] if row["next_block"] is None else row["next_block"], "head": self._head(last["head"], events)}
        self._put(manifest)
        return True

    @staticmethod
    def _head(before: str, events: DataFrame) -> str:
        """Covers the head before and the top of the tree over the new blocks."""
        top = audit.tree_top(audit.leaves(events))
        return hashlib.sha256((before + (top or "")).encode()).hexdigest()

    def _read(self, name: str) -> DataFrame | None:
        stages = [(m["stage"],) for m in self.manifests()]
        try:
            df = self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException:  # nothing has been written yet
            return None
        committed = self.spark.createDataFrame(stages, "stage string")
        return df.join(F.broadcast(committed), "stage", "left_semi").drop("stage")

    def decisions(self) -> DataFrame | None:
        """The decisions of all commits; None before the first attempt."""
        return self._read("decisions")

    def events(self) -> DataFrame | None:
        return self._read("events")

    def sink(self, name: str = "batch"):
        """For foreachBatch."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.commit(f"{name}-{batch_id}", batch)

        return write

    def verify(self) -> dict:
        """rows_checked, broken (rows, blocks and columns) and bad_heads (numbers of commits whose head doesn't hold)."""
        events = self.events()
        if events is None:
            return {"rows_checked": 0, "broken": 0, "bad_heads": []}
        row = audit.verify(events).first()
        columns = audit.column_faults(events).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        bad, before = [], audit.GENESIS
        for m in self.manifests():
            head = self._head(before, self.spark.read.parquet(f"{self.folder}/events/stage={m['stage']}"))
            if head != m["head"]:
                bad.append(m["number"])
            before = m["head"]
        return {"rows_checked": row["rows_checked"], "broken": row["broken"] + columns, "bad_heads": bad}
