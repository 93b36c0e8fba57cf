"""A model bundle: a folder of Parquet tables, saved models and a JSON manifest, on any file system that Spark reads."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from taxolith.operators.features import Features
from taxolith.operators.hierarchy import Tree
from taxolith.operators.models import Centroids, LevelModels, Linear, PlattMargins
from taxolith.operators.sparse import TableModel

CLOSED = {"Linear": Linear, "Centroids": Centroids, "PlattMargins": PlattMargins}

#: In place of the levels' models: one table of terms.
TABLE = "table"


def _tuples(x: object) -> object:
    return tuple(map(_tuples, x)) if isinstance(x, list) else x


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced whole."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()
    return row.value


def there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


@dataclass
class Bundle:
    models: LevelModels | TableModel
    vectorizer: object | None = None
    cleaner: Mapping | None = None
    thresholds: Mapping[str, Mapping[int, float | None]] = field(default_factory=dict)  # "level" and "prefix"
    temperatures: list[float] | None = None
    config: Mapping = field(default_factory=dict)
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    stamp: Mapping = field(default_factory=dict)


def save(spark: SparkSession, path: str, b: Bundle) -> None:
    """The manifest is written last: a folder without it is unfinished."""
    kinds = []
    if isinstance(b.models, TableModel):
        kinds = TABLE
        b.models.weights.write.mode("overwrite").parquet(f"{path}/weights")
        write_text(spark, f"{path}/model.json", json.dumps({"kind": b.models.kind, "prior": b.models.prior, "low": b.models.low, "how": asdict(b.models.how), "n_terms": b.models.n_terms, "temperature": b.models.temperature}))
    for k, model in enumerate([] if kinds == TABLE else b.models.models):
        kinds.append(type(model).__name__)
        if type(model).__name__ in CLOSED:
            write_text(spark, f"{path}/model_{k}.json", json.dumps(model.__dict__))
        else:
            model.write().overwrite().save(f"{path}/model_{k}")
    if b.vectorizer is not None:
        b.vectorizer.write().overwrite().save(f"{path}/vectorizer")
    for name, df in b.tables.items():
        df.write.mode("overwrite").parquet(f"{path}/table_{name}")
    limits = {kind: {str(d): t for d, t in own.items()} for kind, own in b.thresholds.items()}  # null: unreachable
    manifest = {"tree": b.models.tree.record(), "models": kinds, "vectorizer": b.vectorizer is not None, "tables": sorted(b.tables), "cleaner": b.cleaner, "thresholds": limits, "temperatures": b.temperatures, "config": b.config, "stamp": b.stamp}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest))


def load(spark: SparkSession, path: str, stamp: Mapping | None = None) -> Bundle:
    """Everything that the manifest lists; a missing part, or another stamp than expected, raises."""
    import importlib

    if not there(spark, f"{path}/manifest.json"):
        raise FileNotFoundError(f"{path}/manifest.json")
    m = json.loads(read_text(spark, f"{path}/manifest.json"))
    if stamp and (bad := {k: (m["stamp"].get(k), v) for k, v in stamp.items() if m["stamp"].get(k) != v}):
        raise ValueError(f"another bundle than expected: {bad}")
    tree, models = Tree.of_record(m["tree"]), []
    for k, kind in enumerate([] if m["models"] == TABLE else m["models"]):
        if kind in CLOSED:
            record = json.loads(read_text(spark, f"{path}/model_{k}.json"))
            models.append(CLOSED[kind](**{n: _tuples(v) for n, v in record.items()}))
        else:
            models.append(getattr(importlib.import_module("pyspark.ml.classification"), kind).load(f"{path}/model_{k}"))
    vectorizer = importlib.import_module("pyspark.ml").PipelineModel.load(f"{path}/vectorizer") if m["vectorizer"] else None
    limits = {kind: {int(d): t for d, t in own.items()} for kind, own in m["thresholds"].items()}
    tables = {name: spark.read.parquet(f"{path}/table_{name}") for name in m["tables"]}
    if m["models"] == TABLE:
        record = json.loads(read_text(spark, f"{path}/model.json"))
        how = Features(**{n: tuple(v) if isinstance(v, list) else v for n, v in record.pop("how").items()})
        own = TableModel(tree, spark.read.parquet(f"{path}/weights"), how=how, **record)
    else:
        own = LevelModels(tree, models)
    return Bundle(own, vectorizer, m["cleaner"], limits, m["temperatures"], m["config"], tables, m["stamp"])
