"""Version store: snapshots of a batch as JSON, restoring them, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def create_snapshots(rows: DataFrame, versions: DataFrame, summary: str, user: str) -> DataFrame:
    """One new version for each batch of rows: batch_id, version_number, n_rows, snapshot, changes_summary, created_by.

    A snapshot is the JSON array of the batch's rows by id; numbers follow the greatest one of the batch.
    """
    last = versions.groupBy("batch_id").agg(F.max("version_number").alias("last"))
    fields = [c for c in rows.columns if c != "batch_id"]
    packed = rows.groupBy("batch_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", *[c for c in fields if c != "id"])))).alias("snapshot"), F.count("*").alias("n_rows"))
    out = packed.join(last, "batch_id", "left")
    return out.select("batch_id", (F.coalesce("last", F.lit(0)) + 1).alias("version_number"), "n_rows", "snapshot", F.lit(summary).alias("changes_summary"), F.lit(user).alias("created_by"))


def restore(versions: DataFrame, schema: StructType) -> DataFrame:
    """Rows of the given versions, with their own ids: a later diff by id then shows only what has changed."""
    from pyspark.sql.types import ArrayType

    own = StructType([f for f in schema.fields if f.name != "batch_id"])
    return versions.select("batch_id", "version_number", F.inline(F.from_json("snapshot", ArrayType(own))))


def replace_batches(table: DataFrame, restored: DataFrame) -> DataFrame:
    """The table with the rows of restored batches in the place of its own."""
    kept = table.join(restored.select("batch_id").distinct(), "batch_id", "left_anti")
    return kept.unionByName(restored.select(*table.columns))


def increment(table: DataFrame, keys: list[str], counter: str, hits: DataFrame) -> DataFrame:
    """Counters grown by the number of hits on their key."""
    n = hits.groupBy(*keys).agg(F.count("*").alias("_n"))
    return table.join(n, keys, "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n").select(*table.columns)


#: Names of blocks that say nothing, names that can be trusted, layers that can't.
GENERIC_BLOCKS = r"(?i)^(block|\*u\d+|\*d\d+|\*t\d+|\*x\d+|_|)$|^(unnamed|sin nombre|no name)"
TRUSTED_BLOCKS = r"(?i)^(eq|equipo|fixture|artefacto|mueble|furniture|mob|enc|interruptor|tomacorriente|luminaria|tablero|wc|lavamanos|lavaplatos|ducha|tina|inodoro|ac|aire|difusor|rejilla|duct|pilar|columna|viga|fundacion|puerta|ventana|door|window|p\d+|v\d+)"
TRUSTED_CODES = r"^[A-Z]{2,4}[-_]\d+"
UNTRUSTED_LAYERS = ["0", "defpoints", "layer0", "capa0", "temp", "tmp", "trash", "borrar", "delete"]


def block_trust(name: Column, layer: Column) -> Column:
    """struct<generic, trusted, confidence, penalty> of a block by its name and layer."""
    own, where = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.lower(F.coalesce(layer, F.lit(""))))
    generic, trusted, poor = own.rlike(GENERIC_BLOCKS), own.rlike(TRUSTED_BLOCKS) | own.rlike(TRUSTED_CODES), where.isin(UNTRUSTED_LAYERS)
    named = (F.length(own) > 2) & ~poor
    pick = lambda a, b, c, d, e: F.when(generic, a).when(poor & ~trusted, b).when(trusted, c).when(named, d).otherwise(e)
    return F.struct(pick(True, True, False, False, False).alias("generic"), pick(False, False, True, True, False).alias("trusted"), pick("none", "low", "high", "medium", "low").alias("confidence"), pick(1.0, 0.8, 0.0, 0.1, 0.5).alias("penalty"))


def broken_rules(rows: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """Each row with the ids of the enabled range rules (JSON config {field, min, max}) that it breaks, sorted.

    Rows meet the rules of their fields in an equi-join on the field's name, whatever the number of rules.
    """
    numeric = [f for f, t in rows.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]
    own = rules.where("enabled AND rule_type = 'range'").select(F.col("id").alias("rule"), F.from_json("config", "field string, min double, max double").alias("c")).select("rule", "c.*")
    values = rows.select(F.col(key).alias("_key"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in numeric])))
    hit = values.join(own, "field").where("value < min OR value > max")
    broken = hit.groupBy("_key").agg(F.array_sort(F.collect_set("rule")).alias("broken"))
    out = rows.join(broken, rows[key] == broken["_key"], "left").drop("_key")
    return out.withColumn("broken", F.coalesce("broken", F.array().cast("array<string>")))
