"""Open-set models by version: every registration scales anew by the training rows of all known classes, and fits all.

A version is a key of one grouped job, so versions that grow one class at a time are fitted together. ``ModelTable`` keeps
versions, and the rows that they were fitted on, as written tables; a version is there once its number is published.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phmspark.operators import moments, ranking
from phmspark.operators.quantiles import exact_quantiles
from phmspark.sources.scratch import written

LEAST_ROWS = 5  # fewer rows of a class leave no training and calibration rows
MODELS = "version int, cls int, n long, mu array<double>, precision array<double>, shrinkage double, threshold double"
SCALERS = "version int, centre array<double>, spread array<double>"
MEMBERS = "vec_id long, cls int, role string, f array<double>"


def fit(rows: DataFrame, confidence: float = 0.95, estimator: str = "ledoit_wolf") -> tuple[DataFrame, DataFrame]:
    """Models (version, cls, n, mu, precision, shrinkage, threshold) and scalers (version, centre, spread) of rows
    (version, cls, role, f). A class of a version with fewer than ``LEAST_ROWS`` rows is refused."""
    short = rows.groupBy("version", "cls").agg(F.count("*").alias("n")).filter(F.col("n") < LEAST_ROWS).limit(1).collect()
    if short:
        raise ValueError(f"class {short[0]['cls']} has {short[0]['n']} rows; {LEAST_ROWS} are needed for training and calibration")
    scalers = written(moments.scaling(rows.filter("role = 'train'").select("version", "f"), ["version"]), "scalers")
    z = written(moments.scaled(rows.filter("role <> 'holdout'").select("version", "cls", "role", "f"), scalers, ["version"]), "scaled")
    models = written(moments.fit_mahalanobis(z.filter("role = 'train'").select("version", "cls", "f"), ["version", "cls"], estimator=estimator), "models")
    pair = F.concat_ws(":", "version", "cls")
    own = moments.distances(z.filter("role = 'cal'").withColumn("_own", pair), models.withColumn("_own", pair).withColumn("_one", F.lit("d")), "_one", key="_own")
    limit = exact_quantiles(own.select("version", "cls", F.col("ds")["d"].alias("d")), ["version", "cls"], "d", [confidence]).select("version", "cls", F.col("x").alias("threshold"))
    return models.join(limit, ["version", "cls"]).select(*(c.split()[0] for c in MODELS.split(", "))), scalers


def scores(rows: DataFrame, models: DataFrame, scalers: DataFrame) -> DataFrame:
    """``rows`` (version, f, ...) with score (least distance over its class's threshold) and cls (that class; ties to the
    smaller), under the models of the row's version."""
    kept = F.col("f").alias("_f")
    z = moments.scaled(rows.withColumn("_f", kept), scalers, ["version"])
    over = models.withColumn("precision", F.transform("precision", lambda x: x / F.pow(F.greatest("threshold", F.lit(1e-12)), F.lit(2.0))))
    best = F.array_min(F.transform(F.map_entries("ds"), lambda e: F.struct(e["value"].alias("score"), e["key"].cast("int").alias("cls"))))
    told = moments.distances(z, over, "cls", key="version").withColumn("_b", best)
    return told.withColumn("f", F.col("_f")).withColumn("score", F.col("_b.score")).withColumn("cls", F.col("_b.cls")).drop("ds", "_b", "_f")


def verdict(score: str = "score", cls: str = "cls") -> Column:
    """unknown above 1, healthy for class 0, else known."""
    return F.when(F.col(score) > 1, "unknown").when(F.col(cls) == 0, "healthy").otherwise("known")


class ModelTable:
    """Versions of models in a folder all executors share.

    Each class's rows are written once, under its number; version v knows classes 0 to v. A version's tables are written
    before its number is, so a reader never meets half of one, and what was broken off is written anew.
    """

    def __init__(self, spark: SparkSession, path: str, confidence: float = 0.95):
        self.spark, self.path, self.confidence = spark, path, confidence

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{path}")

    def latest(self) -> int | None:
        """The newest published version; None before the first."""
        try:
            return self._read("published", "version int").agg(F.max("version")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def models(self, version: int) -> DataFrame:
        return self._read(f"version={version}/models", MODELS)

    def scalers(self, version: int) -> DataFrame:
        return self._read(f"version={version}/scalers", SCALERS)

    def members(self, version: int) -> DataFrame:
        """vec_id, cls, role, f of all rows that the version knows."""
        found = self._read("class=0", MEMBERS)
        for k in range(1, version + 1):
            found = found.unionByName(self._read(f"class={k}", MEMBERS))
        return found

    def register(self, rows: DataFrame, version: int | None = None) -> int:
        """Rows (vec_id, f) become the next class, or that of ``version``, split by hash; everything is fitted anew. Gives
        the new version."""
        if version is None:
            last = self.latest()
            version = 0 if last is None else last + 1
        own = ranking.with_role(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "f"), [], "vec_id")
        n = rows.count()
        if n < LEAST_ROWS:
            raise ValueError(f"{n} rows; {LEAST_ROWS} are needed for training and calibration")
        own.select("vec_id", F.lit(version).alias("cls"), "role", "f").write.mode("overwrite").parquet(f"{self.path}/class={version}")
        models, scalers = fit(self.members(version).withColumn("version", F.lit(version)), self.confidence)
        models.write.mode("overwrite").parquet(f"{self.path}/version={version}/models")
        scalers.write.mode("overwrite").parquet(f"{self.path}/version={version}/scalers")
        self.spark.createDataFrame([(version,)], "version int").write.mode("append").parquet(f"{self.path}/published")
        return version

    def score(self, rows: DataFrame, version: int | None = None) -> DataFrame:
        """``rows`` (f, ...) with version, score, cls and verdict, under the version (the newest)."""
        version = self.latest() if version is None else version
        if version is None:
            raise ValueError("no version has been published")
        return scores(rows.withColumn("version", F.lit(version)), self.models(version), self.scalers(version)).withColumn("verdict", verdict())

    def boundary(self, version: int) -> float:
        """The largest score of any known class's calibration rows: how far known data may lie."""
        return self.score(self.members(version).filter("role = 'cal'").select("f"), version).agg(F.max("score")).first()[0]
