"""Scoring by the newest model version, quarantine by batch, and the staged replay that learns classes from it.

All state is in written tables under numbers: model versions, quarantine batches, stages. What a number names is written
again with the same rows if its batch or stage is run again, so a run that broke off goes on from the last whole stage.
True configurations ride along for evaluation only; nothing is fitted or decided by them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phmspark.operators import moments, ranking
from phmspark.operators.registered import ModelTable, verdict
from phmspark.sources.scratch import written
from phmspark.streaming import discovery

WAVE = 16  # attempts to cluster that are keys of one job
LEAST, EVERY, MARGIN = 25, 10, 2.0  # rows held, new rows since the last try, score above which a row is held


def score_latest(stream: DataFrame, table: ModelTable, out: str, checkpoint: str) -> StreamingQuery:
    """The stream (f, ...) scored batch by batch under the version that is newest when the batch begins, appended to
    ``out`` under the batch's number: a version published between batches judges the later ones only."""

    def put(batch: DataFrame, number: int) -> None:
        table.score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Quarantine:
    """Rows beyond the margin, equal vectors once, as they arrive: vec_id, f, score, n (number in the quarantine) and
    attempt (whether clustering is tried at it). A batch is a folder of its number and sees only earlier numbers."""

    SCHEMA = "vec_id long, f array<double>, score double, n long, attempt boolean"

    def __init__(self, spark: SparkSession, path: str, margin: float = MARGIN, least: int = LEAST, every: int = EVERY):
        self.spark, self.path, self.margin, self.least, self.every = spark, path, margin, least, every

    def rows(self, before: int | None = None) -> DataFrame:
        """All rows; or those of batches before a number."""
        try:
            found = self.spark.read.schema(f"{self.SCHEMA}, batch int").parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = self.spark.createDataFrame([], f"{self.SCHEMA}, batch int")
        return found if before is None else found.filter(F.col("batch") < before)

    def add(self, scored: DataFrame, number: int, order: str = "vec_id") -> bool:
        """Adds a batch (vec_id, f, score, ``order``); whether clustering is tried in it."""
        earlier = self.rows(number)
        held = earlier.count()
        far = scored.filter((F.col("score") > 1) & (F.col("score") > self.margin)).groupBy("f").agg(F.min(F.struct(F.col(order).alias("_order"), "vec_id", "score")).alias("x"))
        new = far.join(earlier.select("f"), "f", "left_anti").select("x._order", "x.vec_id", "f", "x.score")
        numbered = ranking.placed(new, ["_order", "vec_id"]).withColumn("n", F.col("n") + held)
        tried = (F.col("n") >= self.least) & ((F.col("n") - self.least) % self.every == 0)
        numbered.select("vec_id", "f", "score", "n", tried.alias("attempt")).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        return not self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/batch={number}").filter("attempt").isEmpty()


def quarantine_stream(stream: DataFrame, table: ModelTable, held: Quarantine, checkpoint: str, order: str = "vec_id", tried: Callable[[int], None] | None = None) -> StreamingQuery:
    """The stream (vec_id, f, ...) scored by the newest version and put into quarantine; ``tried`` is called with the
    number of each batch in which clustering is to be tried."""

    def put(batch: DataFrame, number: int) -> None:
        if held.add(table.score(batch), number, order) and tried:
            tried(number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def majority(rows: DataFrame, truth: str = "truth") -> tuple[str, float]:
    """The most frequent truth, ties to the smaller name, and its share."""
    top = rows.groupBy(truth).agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("m"), truth)).alias("t"), F.sum("n").alias("whole")).first()
    return top["t"][truth], -top["t"]["m"] / top["whole"]


@dataclass
class Stage:
    """What a stage left: also the state from which the next one starts."""

    stage: int
    config: str
    ticks: int  # until a class was learned, or all
    version: int  # newest after the stage
    since: int  # rows held since the last try
    held: int
    healthy_drawn: int
    duplicates: int
    discovered: bool
    matched: str | None = None
    cluster_size: int | None = None
    purity: float | None = None
    median_score: float | None = None
    boundary: float | None = None
    pruned: int | None = None
    own_holdout: float | None = None
    healthy_holdout: float | None = None
    eval_known: float | None = None
    eval_matched: float | None = None
    eval_n: int | None = None


_STAGE = ", ".join(f"{f.name} {'boolean' if 'bool' in f.type else 'string' if 'str' in f.type else 'double' if 'float' in f.type else 'long'}" for f in fields(Stage))
_REJECTION = "config string, t long, action string, size long, matched string, median_score double, boundary double"
_HELD = "vec_id long, f array<double>, truth string"


class Replay:
    """Configurations of ``pools`` (vec_id, config, f) are injected one after another into a monitor that knows healthy
    rows only. A stage scores its ticks, holds what is beyond the margin, tries to cluster in the order of arrival, and
    ends with the first class it learns or after ``max_ticks``."""

    def __init__(self, pools: DataFrame, healthy: str, sequence: list[str], path: str, max_ticks: int = 600, margin: float = MARGIN, healthy_mix: float = 0.0, seed: int = 42, confidence: float = 0.95):
        if not 0 <= healthy_mix <= 1:
            raise ValueError("the share of healthy rows is from 0 to 1")
        if healthy in sequence:
            raise ValueError("the healthy configuration is not injected")
        self.spark, self.path, self.sequence, self.healthy = pools.sparkSession, path, sequence, healthy
        self.max_ticks, self.margin, self.mix, self.seed = max_ticks, margin, healthy_mix, seed
        self.table = ModelTable(self.spark, f"{path}/models", confidence)
        split = ranking.stream_eval(pools.filter(F.col("config") != healthy), ["config"], "vec_id", seed + 2)
        self.parts = written(split.select(F.col("vec_id").cast("long").alias("vec_id"), "config", "f", "part"), "parts")
        if self.table.latest() is None:
            self.table.register(pools.filter(F.col("config") == healthy).select("vec_id", "f"))
        self.rejections: DataFrame = self._all("rejections", _REJECTION)

    def _all(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/*")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def stages(self) -> list[Stage]:
        """Whole stages, in order: at most one a configuration."""
        return sorted((Stage(**r.asDict()) for r in self._all("stages", _STAGE).collect()), key=lambda s: s.stage)

    def _drawn(self, config: str, healthy_from: int) -> DataFrame:
        """t, vec_id, f, truth of the stage's ticks: each takes the next row of the configuration's pool, or of the
        healthy holdout with the probability of the mix; rows return in a new order when all have been drawn."""
        mixed = ranking.uniform(self.seed + 3, F.lit(config), F.col("t")) < self.mix
        ticks = self.spark.range(1, self.max_ticks + 1).withColumnRenamed("id", "t").withColumn("healthy", mixed)
        ticks = ticks.withColumn("k", F.row_number().over(Window.partitionBy("healthy").orderBy("t")).cast("long"))  # at most max_ticks rows
        own = self.parts.filter((F.col("config") == config) & (F.col("part") == "stream")).select("vec_id", "f")
        sides = [(own, self.seed + 1, False, 0, config)]
        if self.mix > 0:
            sides.append((self.table.members(0).filter("role = 'holdout'").select("vec_id", "f"), self.seed + 4, True, healthy_from, self.healthy))
        found = None
        for rows, seed, healthy, start, truth in sides:
            n = rows.count()
            laps = -(-(start + self.max_ticks) // max(1, n))
            drawn = ranking.replay(rows, [], "vec_id", laps, seed).select(F.col("t").alias("k"), "vec_id", "f")
            met = ticks.filter(F.col("healthy") == healthy).withColumn("k", F.col("k") + start).join(drawn, "k").select("t", "vec_id", "f", F.lit(truth).alias("truth"))
            found = met if found is None else found.unionByName(met)
        return found

    def run(self) -> list[Stage]:
        """Runs the stages that are not there yet."""
        done = self.stages()
        for k in range(len(done), len(self.sequence)):
            done.append(self._stage(k, done[-1] if done else None))
        return done

    def _quarantine(self, stage: int) -> DataFrame:
        return self.spark.read.schema(_HELD).parquet(f"{self.path}/quarantine/stage={stage}") if stage >= 0 else self.spark.createDataFrame([], _HELD)

    def _stage(self, number: int, before: Stage | None) -> Stage:
        config, version = self.sequence[number], before.version if before else 0
        since, healthy_from = (before.since, before.healthy_drawn) if before else (0, 0)
        ticks = written(self.table.score(self._drawn(config, healthy_from), version).select("t", "vec_id", "f", "truth", "score"), "ticks")
        held = self._quarantine(number - 1)
        beyond = ticks.filter((F.col("score") > 1) & (F.col("score") > self.margin))
        far = beyond.groupBy("f").agg(F.min(F.struct("t", "vec_id", "truth")).alias("x")).join(held.select("f"), "f", "left_anti").select("x.*", "f")
        far = written(far.withColumn("k", F.row_number().over(Window.orderBy("t"))), "far")  # at most max_ticks rows
        at = [r["t"] for r in far.select("t").orderBy("k").collect()]
        n, j, rejected, learned = held.count(), 0, [], None
        boundary: float | None = None
        while True:
            tries: list[tuple[int, int, int]] = []  # n, since, j of the next attempts, as long as none finds a candidate
            while len(tries) < WAVE:
                need = max(1, LEAST - n, EVERY - since)
                if j + need > len(at):
                    break
                n, j, since = n + need, j + need, 0
                if tries and n > discovery.BESIDE_ROWS:
                    n, since, j = tries[-1]
                    break
                tries.append((n, since, j))
            if not tries:
                n, since, j = n + len(at) - j, since + len(at) - j, len(at)
                break
            met = held.withColumn("k", F.lit(0)).unionByName(far.filter(F.col("k") <= j).select("vec_id", "f", "truth", "k"))
            found = self._clustered(met, [x[2] for x in tries], tries[0][0], version)
            if found is None:
                continue
            n, since, j = next(x for x in tries if x[2] == found[0])
            top = found[1]
            now = written(met.filter(F.col("k") <= j).drop("k"), "held")
            own = written(self.table.score(now.join(top, "vec_id", "left_semi"), version), "cluster")
            boundary = self.table.boundary(version) if boundary is None else boundary
            verdict_, size = discovery.adopt(own, boundary)
            matched, purity = majority(own)
            median = own.agg(F.percentile("score", 0.5)).first()[0]  # of a cluster of the quarantine
            held = written(held.join(top, "vec_id", "left_anti"), "held")
            far = written(far.join(top, "vec_id", "left_anti"), "far")
            n, since = n - size, EVERY
            if verdict_ != "adopted":
                rejected.append((config, at[j - 1], verdict_, size, matched, median, boundary))
                continue
            learned = self._learn(number, config, version, own, now.join(top, "vec_id", "left_anti"), matched)
            learned |= {"matched": matched, "cluster_size": size, "purity": purity, "median_score": median, "boundary": boundary}
            break
        last = at[j - 1] if learned else self.max_ticks
        rest = learned.pop("rest") if learned else held.unionByName(far.select("vec_id", "f", "truth"))
        rest.write.mode("overwrite").parquet(f"{self.path}/quarantine/stage={number}")
        self.spark.createDataFrame(rejected, _REJECTION).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/rejections/stage={number}")
        seen = ticks.filter(F.col("t") <= last)
        counts = seen.agg(F.count_if(F.col("truth") == self.healthy).alias("healthy"), F.count_if((F.col("score") > 1) & (F.col("score") > self.margin)).alias("beyond")).first()
        row = Stage(number, config, last, version + bool(learned), since, self._quarantine(number).count(), healthy_from + counts["healthy"], counts["beyond"] - sum(t <= last for t in at), bool(learned), **(learned or {}))
        self.spark.createDataFrame([tuple(asdict(row).values())], _STAGE).write.mode("overwrite").parquet(f"{self.path}/stages/stage={number}")  # last: now the stage is whole
        self.rejections = self._all("rejections", _REJECTION)
        return row

    def _clustered(self, held: DataFrame, ends: list[int], n: int, version: int) -> tuple[int, DataFrame] | None:
        """The first of ``ends`` at which rows (vec_id, f, k) up to it have a candidate, and its vec_ids. ``n``: rows at the
        first end; more than one task holds are clustered by jobs, and are the only end."""
        rows = held.withColumn("version", F.lit(version))
        z = written(moments.scaled(rows, self.table.scalers(version), ["version"]).select("vec_id", "f", "k"), "scaled")
        if n <= discovery.BESIDE_ROWS:
            return discovery.first_candidate(z, ends, "k", LEAST)
        top = discovery.candidate(z, LEAST)[1].select("vec_id")
        return None if top.isEmpty() else (ends[0], top)

    def _learn(self, number: int, config: str, version: int, cluster: DataFrame, rest: DataFrame, matched: str) -> dict:
        """Registers the cluster as the next class, drops from quarantine what the new version explains, and looks at
        holdout and external rows."""
        new = self.table.register(cluster.select("vec_id", "f"), version + 1)
        held = rest.count()
        again = self.table.score(rest, new)
        stays = written(again.filter((F.col("score") > 1) & (F.col("score") > self.margin)).select("vec_id", "f", "truth"), "held")
        names = self._matches(new, matched)
        members = self.table.members(new).filter("role = 'holdout'")
        sets = members.filter(F.col("cls") == new).select(F.lit("own").alias("of"), "f").unionByName(members.filter("cls = 0").select(F.lit("healthy").alias("of"), "f"))
        sets = sets.unionByName(self.parts.filter((F.col("config") == config) & (F.col("part") == "eval")).select(F.lit("eval").alias("of"), "f"))
        told = self.table.score(sets, new)
        share = lambda which, right: F.avg(F.when(F.col("of") == which, right.cast("double")))
        known = (F.col("verdict") == "known").cast("boolean")
        found = told.agg(
            share("own", known & (F.col("cls") == new)).alias("own_holdout"),
            share("healthy", F.col("verdict") == "healthy").alias("healthy_holdout"),
            share("eval", known).alias("eval_known"),
            share("eval", known & F.col("cls").isin([c for c, m in names.items() if m == config])).alias("eval_matched"),
            F.count_if(F.col("of") == "eval").alias("eval_n"),
        ).first()
        return {"rest": stays, "pruned": held - stays.count(), **found.asDict()}

    def _matches(self, version: int | None = None, matched: str | None = None) -> dict[int, str]:
        """Class number -> majority of the cluster it was learned from."""
        names = {s.version: s.matched for s in self.stages() if s.discovered}
        return names | ({version: matched} if version is not None else {})

    def external(self) -> DataFrame:
        """config, n, unknown, healthy, known, matched: what the last version makes of each configuration's external rows."""
        last = self.stages()[-1].version if self.stages() else 0
        names = self._matches()
        told = self.table.score(self.parts.filter(F.col("part") == "eval").filter(F.col("config").isin(self.sequence)).select("config", "f"), last)
        of = F.create_map(*(x for c, m in names.items() for x in (F.lit(c), F.lit(m))))[F.col("cls")] if names else F.lit(None).cast("string")
        rate = lambda right: F.avg(F.coalesce(right, F.lit(False)).cast("double"))
        is_ = lambda v: F.col("verdict") == v
        return told.groupBy("config").agg(F.count("*").alias("n"), rate(is_("unknown")).alias("unknown"), rate(is_("healthy")).alias("healthy"), rate(is_("known")).alias("known"), rate(is_("known") & (of == F.col("config"))).alias("matched"))

    def delays(self) -> dict[str, int]:
        """Ticks from a configuration's first injection until a class was first learned mostly from it."""
        began, now, found = {}, 0, {}
        for s in self.stages():
            began[s.config] = now
            now += s.ticks
            if s.discovered and s.matched in began:
                found.setdefault(s.matched, now - began[s.matched])
        return found


__all__ = ["ModelTable", "Quarantine", "Replay", "Stage", "quarantine_stream", "score_latest", "verdict"]
