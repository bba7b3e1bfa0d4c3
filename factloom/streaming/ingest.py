"""Landing folders to the fact store: the batch pipeline per micro-batch."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom import interfaces
from factloom.functions import units
from factloom.operators import compare, matching, pipeline, store
from factloom.session import materialize


def new_documents(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Facts of documents of which the store has none yet; a document that is there already is skipped as a whole."""
    return batch.join(stored.select("document_id").distinct(), "document_id", "left_anti")


def canonicalise(batch: DataFrame) -> DataFrame:
    return units.with_normalized(batch)


def append_batch(batch: DataFrame, store_path: str, epoch: int, force: bool = False) -> None:
    """Adds a micro-batch to the Parquet store in a folder of its own, so that a repeated epoch replaces itself."""
    spark = batch.sparkSession
    try:
        stored = spark.read.option("basePath", store_path).parquet(store_path).filter(F.col("epoch") != epoch)
        fresh = batch if force else new_documents(batch, stored)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        fresh = batch
    canonicalise(fresh).write.mode("overwrite").parquet(f"{store_path}/epoch={epoch}")


def stream_facts(spark: SparkSession, landing: str, store_path: str, checkpoint: str, schema, force: bool = False, files_per_trigger: int = 1) -> StreamingQuery:
    """Reads Parquet facts that land in a folder and adds those of new documents to the store; ends when the folder is worked off."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)
    return source.writeStream.foreachBatch(lambda df, epoch: append_batch(df, store_path, epoch, force)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- the whole ingest of a batch of facts ------------------------------------------------------------------------------


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A part of the state; empty before the first epoch."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.read.schema(schema + ", epoch bigint").option("basePath", path).parquet(path).select(*names, "epoch") if there else spark.createDataFrame([], schema + ", epoch bigint")


#: Parts of the state, each in folders by epoch.
STATE = {
    "facts": "fact_id string, document_id string, statement string, canonical_entity string, raw_attribute string, value string, unit string, scope string, content_hash string, ingest_seq bigint, embedding array<float>",
    "edges": interfaces.EDGE,
    "entities": "seq bigint, name string",
    "attributes": "seq bigint, name string",
    "jobs": "status string, phase string, message string, n_facts bigint, n_edges bigint, n_rule bigint, elapsed_seconds double",
}


def ingest_facts(batch: DataFrame, state: str, epoch: int, embedder: interfaces.Embedder, judge: interfaces.Judge, force: bool = False, k: int = pipeline.TOP_K) -> dict[str, object]:
    """Takes a batch of extracted facts in: skips documents that the store has (unless ``force``), makes the facts canonical against the registries and lets those grow, stores them with
    their vectors, compares them with what came before, and stores the edges in both directions.

    ``batch``: ``fact_id, document_id, statement, canonical_entity, raw_attribute, value, unit, scope, ingest_seq``. The state lies in ``state`` by part and epoch; a repeated
    epoch replaces itself and sees only other epochs. A phase that fails ends the batch and is recorded with its message in ``jobs`` (status ``error``), what earlier phases stored
    stays; a pair on which the judge fails costs only its edge. Returns the row of ``jobs``.
    """
    began, spark, phase = time.time(), batch.sparkSession, "skip"
    job: dict[str, object] = {"status": "processing", "phase": phase, "message": None, "n_facts": 0, "n_edges": 0, "n_rule": 0, "elapsed_seconds": 0.0}

    def held(part: str) -> DataFrame:
        return _read(spark, f"{state}/{part}", STATE[part]).filter(F.col("epoch") < epoch).drop("epoch")

    def keep(part: str, df: DataFrame) -> DataFrame:
        names = [c.split()[0] for c in STATE[part].split(", ")]
        path = f"{state}/{part}/epoch={epoch}"
        df.select(*names).write.mode("overwrite").parquet(path)
        return spark.read.schema(STATE[part]).parquet(path)

    keep("jobs", spark.createDataFrame([tuple(job.values())], STATE["jobs"]))
    try:
        stored = held("facts")
        fresh = materialize(batch if force else new_documents(batch, stored), "fresh")
        phase = "canonicalise"
        entities, attributes = held("entities"), held("attributes")
        for part, column, registry in (("entities", "canonical_entity", entities), ("attributes", "raw_attribute", attributes)):
            named = fresh.filter(F.trim(column) != "").groupBy(F.col(column).alias("name")).agg(F.min("ingest_seq").alias("first_seq"))
            known = interfaces.embed(registry, embedder)
            if part == "attributes":
                named = named.join(matching.snap(named.select("name"), registry).filter("how = 'none'").select("name"), "name", "left_semi")
            grown = matching.grow_registry(interfaces.embed(named, embedder), known)
            keep(part, grown.join(registry.select("seq"), "seq", "left_anti"))
        canonical = pipeline.canonicalise_facts(fresh, _read(spark, f"{state}/entities", STATE["entities"]).drop("epoch"), _read(spark, f"{state}/attributes", STATE["attributes"]).drop("epoch"), embedder)
        canonical = canonical.withColumns({"canonical_entity": F.col("entity"), "raw_attribute": F.col("attribute"), "doc_text": F.concat_ws(" ", "entity", "attribute", "statement")})
        phase = "store"
        facts = keep("facts", interfaces.embed(canonical.select(*[c.split()[0] for c in STATE["facts"].split(", ")][:-1], "doc_text"), embedder, "doc_text"))
        job["n_facts"] = facts.count()
        phase = "compare"
        found = materialize(pipeline.compare_new_facts(facts, stored, held("edges"), judge, k), "found")
        keep("edges", pipeline.both_ways(found))
        counts = found.agg(F.count("*").alias("n"), F.count_if(F.col("source") == "rule").alias("rule")).first()
        job |= {"n_edges": counts["n"], "n_rule": counts["rule"], "status": "done", "phase": "done"}
    except Exception as e:  # noqa: BLE001
        job |= {"status": "error", "phase": phase, "message": str(e)[:500]}
    job["elapsed_seconds"] = time.time() - began
    keep("jobs", spark.createDataFrame([tuple(job.values())], STATE["jobs"]))
    return job


def stream_ingest(spark: SparkSession, landing: str, state: str, checkpoint: str, schema, embedder: interfaces.Embedder, judge: interfaces.Judge, force: bool = False) -> StreamingQuery:
    """:func:`ingest_facts` for each micro-batch of Parquet facts that land in a folder; ends when the folder is worked off."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    return source.writeStream.foreachBatch(lambda df, epoch: ingest_facts(df, state, epoch, embedder, judge, force)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_status(spark: SparkSession, state: str) -> DataFrame:
    """``epoch`` and the row of ``jobs`` of each batch."""
    return _read(spark, f"{state}/jobs", STATE["jobs"])


def rejudge(edges: DataFrame, pairs: DataFrame, facts: DataFrame, judge: interfaces.Judge, at: float) -> DataFrame:
    """The relationship store after the listed ``pairs(fact_id_a, fact_id_b)`` were judged anew at time ``at``: both directions are overwritten, pairs
    on which nothing is decided keep their edges."""
    again = interfaces.judged(compare.judge_pairs(pairs.select("fact_id_a", "fact_id_b").distinct(), facts), facts, judge)
    columns = ["fact_id_a", "fact_id_b", "relationship_type", "confidence", "justification", "created_at"]
    return store.latest_relationships(edges.select(*columns).unionByName(pipeline.both_ways(again.withColumn("created_at", F.lit(float(at))).select(*columns))))
