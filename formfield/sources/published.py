"""Publishing a view in one step: files first, then a manifest of them, then the pointer that readers follow.

A version is written to a folder of its own, dealt by ranges of its order. Its manifest holds a row per file with row count,
checksum and bounds, made by reading back what was stored. The pointer entry comes last, and readers know only versions with
an entry; so a write that dies at any point, or is repeated, leaves the version before it as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from formfield.sources.files import exists, remove

#: Folders of a published view; readers of plain folders pass over names with a leading underscore.
VERSIONS, MANIFESTS, POINTERS = "_versions", "_manifests", "_current"
POINTER = "number long, version string, format string, schema string, ordered array<string>, files long, rows long, checksum decimal(38,0)"
CSV_OPTIONS = {"header": True, "nullValue": "", "emptyValue": ""}


def _options(format: str) -> dict:
    return CSV_OPTIONS if format == "csv" else {}


def _stored(spark: SparkSession, path: str, pointer: Row) -> DataFrame:
    schema = StructType.fromJson(json.loads(pointer.schema))
    reader = spark.read.schema(schema).format(pointer.format).options(**_options(pointer.format))
    return reader.load(f"{path}/{VERSIONS}/{pointer.version}")


def _per_file(stored: DataFrame, ordered: list[str]) -> DataFrame:
    """File name, rows, checksum (sum of row hashes, whatever their order) and bounds of the first ordered column."""
    columns = [F.col(f"`{c}`") for c in stored.columns]
    bound = F.col(f"`{ordered[0]}`")
    return stored.groupBy(F.substring_index(F.input_file_name(), "/", -1).alias("file")).agg(
        F.count("*").alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("decimal(38,0)").alias("checksum"),
        F.min(bound).cast("string").alias("first"), F.max(bound).cast("string").alias("last"),
    )


def published(spark: SparkSession, path: str) -> list[Row]:
    """The pointer entries of a view, newest first; one small row per version."""
    if not exists(spark, f"{path}/{POINTERS}"):
        return []
    entries = spark.read.schema(POINTER).option("recursiveFileLookup", True).parquet(f"{path}/{POINTERS}").collect()
    return sorted(entries, key=lambda e: (e.number, e.version), reverse=True)


def publish_view(df: DataFrame, path: str, order: str | list[str], format: str = "parquet", files: int | None = None) -> Row:
    """Store ``df`` as the newest version of the view at ``path``; returns its pointer entry.

    ``order`` names the columns whose ranges the files hold, so a reader of a range opens few of them; ``files`` is
    their number, else Spark chooses it by size. An empty view is a version without rows. Of two
    that publish at once both are stored and one is newest. Columns of maps have no checksum and are refused by Spark.
    """
    spark, order = df.sparkSession, [order] if isinstance(order, str) else list(order)
    version = uuid.uuid4().hex
    keys = [F.col(f"`{c}`") for c in order]
    ranged = df.repartitionByRange(*keys) if files is None else df.repartitionByRange(files, *keys)
    ranged.sortWithinPartitions(*keys).write.format(format).options(**_options(format)).save(f"{path}/{VERSIONS}/{version}")
    entry = Row(number=0, version=version, format=format, schema=df.schema.json(), ordered=order, files=0, rows=0, checksum=None)
    manifest = f"{path}/{MANIFESTS}/{version}"
    _per_file(_stored(spark, path, entry), order).write.parquet(manifest)
    total = spark.read.parquet(manifest).agg(F.count("*"), F.sum("rows"), F.sum("checksum").cast("decimal(38,0)")).first()
    number = max((e.number for e in published(spark, path)), default=0) + 1
    entry = Row(**{**entry.asDict(), "number": number, "files": total[0], "rows": total[1] or 0, "checksum": total[2]})
    spark.createDataFrame([tuple(entry)], POINTER).coalesce(1).write.parquet(f"{path}/{POINTERS}/{number:012d}-{version}")
    return entry


def damaged_files(spark: SparkSession, path: str, pointer: Row) -> DataFrame:
    """Files of a version whose rows or checksum are not those of its manifest, lost and added ones included."""
    told = spark.read.parquet(f"{path}/{MANIFESTS}/{pointer.version}").select("file", F.struct("rows", "checksum").alias("told"))
    found = _per_file(_stored(spark, path, pointer), pointer.ordered).select("file", F.struct("rows", "checksum").alias("found"))
    return told.join(found, "file", "full_outer").filter(~F.col("told").eqNullSafe(F.col("found")))


def read_view(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """The newest published version; with ``verify`` its files are first compared with the manifest, in one more scan."""
    entries = published(spark, path)
    if not entries:
        raise FileNotFoundError(f"no published view at {path}")
    if verify:
        bad = [r.file for r in damaged_files(spark, path, entries[0]).select("file").take(5)]
        if bad:
            raise ValueError(f"version {entries[0].version} differs from its manifest, first in {', '.join(bad)}")
    return _stored(spark, path, entries[0])


def drop_superseded(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the ``keep`` newest versions, pointers first; returns what went. Readers of those must be done."""
    if keep < 1:
        raise ValueError("the newest version stays")
    old = published(spark, path)[keep:]
    for e in old:
        remove(spark, f"{path}/{POINTERS}/{e.number:012d}-{e.version}")
        remove(spark, f"{path}/{VERSIONS}/{e.version}")
        remove(spark, f"{path}/{MANIFESTS}/{e.version}")
    return [e.version for e in old]
