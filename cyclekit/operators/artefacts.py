"""Model artefacts: a fitted pipeline with its contract, scaler and split, saved under a
version and loaded again in another call or application (ML1-ML3).

Layout under ``path`` (shared storage): ``<name>/v<k>/model`` (Spark ML) and
``<name>/v<k>/artefact.json``, which is written last and makes the version visible."""
from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FeatureSpec


@dataclass(frozen=True)
class Artefact:
    model: PipelineModel
    spec: FeatureSpec
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)
    split: dict[str, str] = field(default_factory=dict)
    version: int = 0


class ModelStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, place: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{place}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self, name: str) -> list[int]:
        """Complete versions, oldest first."""
        fs, p = self._at(name)
        if not fs.exists(p):
            return []
        found = [f.getPath().getName() for f in fs.listStatus(p)]
        done = [v for v in found if v[:1] == "v" and v[1:].isdigit() and fs.exists(self._at(f"{name}/{v}/artefact.json")[1])]
        return sorted(int(v[1:]) for v in done)

    def save(self, name: str, model: PipelineModel, spec: FeatureSpec, scaler: dict[str, tuple[float, float]] | None = None,
             split: dict[str, str] | None = None) -> int:
        """Save as the next version; gives its number. The contract must hold."""
        spec.assert_valid()
        fs, p = self._at(name)
        used = [int(n[1:]) for n in (f.getPath().getName() for f in fs.listStatus(p)) if n[:1] == "v" and n[1:].isdigit()] if fs.exists(p) else []
        k = max(used, default=0) + 1          # a version that was cut short keeps its number
        model.write().save(f"{self.path}/{name}/v{k}/model")
        about = {"spec": asdict(spec) | {"forbidden": sorted(spec.forbidden)}, "scaler": scaler or {}, "split": split or {}}
        out = self._at(f"{name}/v{k}/artefact.json")[0].create(self._at(f"{name}/v{k}/artefact.json")[1], False)
        out.write(bytearray(json.dumps(about, ensure_ascii=False).encode()))
        out.close()
        return k

    def load(self, name: str, version: int | None = None) -> Artefact:
        """The given or the newest complete version. The contract is checked again."""
        have = self.versions(name)
        if not have or version is not None and version not in have:
            raise FileNotFoundError(f"{self.path}/{name}: no version {version if version is not None else ''}")
        k = have[-1] if version is None else version
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.path}/{name}/v{k}/artefact.json").collect())
        about = json.loads(text)
        s = about["spec"]
        spec = FeatureSpec(s["name"], tuple(s["features"]), s["target"], frozenset(s["forbidden"]),
                           None if s["monotone"] is None else tuple(s["monotone"]), s["extra"])
        spec.assert_valid()
        model = PipelineModel.load(f"{self.path}/{name}/v{k}/model")
        return Artefact(model, spec, {c: tuple(v) for c, v in about["scaler"].items()}, about["split"], k)


def missing_features(df: DataFrame, features: list[str]) -> DataFrame:
    """ML3: one row, ``n_rows`` and ``n_unscored``: rows that a model cannot score because a
    feature is null or NaN."""
    bad = F.lit(False)
    for c in features:
        kind = df.schema[c].dataType.typeName()
        bad = bad | F.col(c).isNull() | (F.isnan(c) if kind in ("double", "float") else F.lit(False))
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows"), F.count(F.when(bad, 1)).cast("long").alias("n_unscored"))
