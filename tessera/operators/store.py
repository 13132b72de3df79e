"""Statements on disk, by snapshots: what a write changes is written beside what is there, then one small file is
replaced that names the folders which count. Readers see all of a write or nothing; only the models of a write are
written again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import uris
from ..model import MODEL_VERSION, NODE_TYPE, STATEMENT, STATEMENT_COLUMNS
from . import delta, maintain
from .normalize import Normalized, once, stamped

TABLES = {"statement": STATEMENT, "node_type": NODE_TYPE}


class Store:
    """A store in a folder that all machines reach. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self.jvm.Path(f"{self.root}/{name}" if name else self.root)

    # --- The file that counts.

    def current(self) -> dict:
        """{"seq": n, "statement": {model: folder}, "node_type": {...}, "versions": {model: n}, "prefixes": {...}}"""
        at = self._path("_current")
        if not self.files.exists(at):
            return {"seq": 0, "statement": {}, "node_type": {}, "versions": {}, "prefixes": dict(uris.STATIC_PREFIXES)}
        stream = self.files.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        temporary = self._path(f"_current.{state['seq']}")
        out = self.files.create(temporary, True)
        try:
            out.write(json.dumps(state).encode())
        finally:
            out.close()
        context = self.jvm.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, self._path("_current"), overwrite)

    # --- Reading.

    def _read(self, name: str, state: dict | None = None) -> DataFrame:
        folders = sorted(set((state or self.current())[name].values()))
        return self.spark.read.schema(TABLES[name]).parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[name])

    def statements(self, models: list[str] | None = None) -> DataFrame:
        """All statements, ended ones too; with models those of these models, of which alone the folders are read."""
        state = self.current()
        if models is not None:
            state = {**state, "statement": {m: f for m, f in state["statement"].items() if m in models}}
        return self._read("statement", state)

    def types(self) -> DataFrame:
        return self._read("node_type")

    def versions(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.current()["versions"].items()), MODEL_VERSION)

    def prefixes(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.current()["prefixes"].items()), uris.PREFIX)

    # --- Writing.

    def _write(self, name: str, rows: DataFrame, seq: int) -> dict[str, str]:
        """Folders by model of rows written, each sorted by record so that readers skip."""
        folder = f"{self.root}/{name}/{seq:08d}"
        spread = rows.withColumn("_m", F.concat(F.lit("m"), F.hex(F.encode("model", "UTF-8")))).repartition("_m", "record_id")
        spread.sortWithinPartitions("_m", "record_id").write.mode("overwrite").partitionBy("_m").parquet(folder)
        out = {}
        for status in self.files.listStatus(self.jvm.Path(folder)):
            part = status.getPath().getName()
            if part.startswith("_m="):
                out[bytes.fromhex(part[4:]).decode()] = f"{folder}/{part}"
        return out

    def replace(self, statements: DataFrame, types: DataFrame | None, versions: dict[str, int], models: list[str]) -> None:
        """Publishes statements (and types) as all that the models have."""
        state = self.current()
        seq = state["seq"] + 1
        for name, rows in (("statement", statements), ("node_type", types)):
            if rows is not None:
                kept = {m: f for m, f in state[name].items() if m not in models}
                state[name] = {**kept, **self._write(name, rows, seq)}
        self._publish({**state, "seq": seq, "versions": {**state["versions"], **versions}})

    def put(self, new: Normalized, versioning: bool = True, schema: delta.ContentSchema | None = None, deprecate_missing: str | None = None) -> dict[str, int]:
        """Writes a delivery and returns the versions of the models that changed.

        With versioning records are matched with those stored (by schema), without it statements that are lacking are
        added at the latest version. deprecate_missing names a record class whose records end if the delivery lacks them.
        """
        models = [r[0] for r in new.statements.select("model").union(new.types.select("model")).distinct().collect()]
        state = self.current()
        history = self.statements(models)
        latest = {m: state["versions"].get(m, 0) for m in models}
        version = {m: max(1, v + 1 if versioning else v) for m, v in latest.items()}
        if not models:
            return {}
        at = F.create_map(*[x for m, v in version.items() for x in (F.lit(m), F.lit(v))])[F.col("model")]
        if not any(m in state["statement"] for m in models):
            rows = stamped(once(new.statements), at)
        elif versioning:
            rows = delta.put(history, new.statements, at, schema or delta.ContentSchema())[0]
        else:
            rows = delta.append(history, new.statements, at)
        if deprecate_missing:
            # The types of the delivery tell nothing of what it lacks, so those stored are enough.
            own = self.spark.createDataFrame([(m,) for m in models], "model string")
            rows = maintain.deprecate_records(rows, maintain.missing_records(rows, self.types(), new.statements, deprecate_missing, own), at)
        rows = rows.select(STATEMENT_COLUMNS)
        types = self.types().filter(F.col("model").isin(models)).unionByName(new.types).dropDuplicates(["model", "node_id", "type_uri"])
        seq_state = self.current()
        seq = seq_state["seq"] + 1
        folders = {"statement": self._write("statement", rows, seq), "node_type": self._write("node_type", types, seq)}
        written = self.spark.read.schema(STATEMENT).parquet(*folders["statement"].values()) if folders["statement"] else rows.limit(0)
        touched = written.filter((F.col("valid_from") == at) | (F.col("valid_to") == at)).groupBy("model").count().collect()
        # What ended at the version a write without versioning takes place at may have ended before; nothing new is no change.
        changed = {r[0]: version[r[0]] for r in touched if version[r[0]] != latest[r[0]]}
        names = uris.dictionary(new.statements.select("predicate"), "predicate", self.prefixes()).collect()
        for name in TABLES:
            seq_state[name] = {**seq_state[name], **folders[name]}
        self._publish({**seq_state, "seq": seq, "versions": {**seq_state["versions"], **changed}, "prefixes": {r[0]: r[1] for r in names}})
        return changed

    def wipe(self) -> dict[str, int]:
        """Empties the store and returns {"deleted": n}; the folders stay until vacuum()."""
        deleted = maintain.deletion_rows(self.statements(), self.types(), self.prefixes()).first()[0]
        self._publish({"seq": self.current()["seq"] + 1, "statement": {}, "node_type": {}, "versions": {}, "prefixes": dict(uris.STATIC_PREFIXES)})
        return {"deleted": deleted}

    def deprecate(self, records: DataFrame | None = None, model: str | None = None) -> dict[str, int]:
        """Ends a model, or the listed records, at a new version and returns {"deprecated": n}; twice gives 0."""
        models = [model] if model is not None else [r[0] for r in records.select("model").distinct().collect()]
        before = self.statements(models)
        version = {m: v + 1 for m, v in self.current()["versions"].items() if m in models}
        if not version:
            return {"deprecated": 0}
        at = F.create_map(*[x for m, v in version.items() for x in (F.lit(m), F.lit(v))])[F.col("model")]
        after = maintain.end(before, F.lit(True), at) if model is not None else maintain.end(
            before.join(records.select("model", "record_id").distinct().withColumn("_hit", F.lit(True)), ["model", "record_id"], "left"), F.coalesce("_hit", F.lit(False)), at
        ).drop("_hit")
        n = maintain.deprecated(before, after).first()[0]
        if n:
            self.replace(after.select(STATEMENT_COLUMNS), None, version, models)
        return {"deprecated": n}

    def vacuum(self) -> int:
        """Deletes the folders that no longer count and returns how many."""
        state = self.current()
        used = {f.rsplit("/", 2)[1] for name in TABLES for f in state[name].values()}
        n = 0
        for name in TABLES:
            at = self._path(name)
            for status in self.files.listStatus(at) if self.files.exists(at) else []:
                if status.getPath().getName() not in used:
                    n += bool(self.files.delete(status.getPath(), True))
        return n


def ping(spark: SparkSession) -> str:
    return "pong" if spark.range(1).count() == 1 else ""
