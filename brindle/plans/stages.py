"""Wall-clock times of the tasks of the stages that ran, from the scheduler's own records."""

from __future__ import annotations

from pyspark.sql import SparkSession


class ReducerTimes:
    """Seconds of each task of the widest stage that read a shuffle inside the ``with``: one task is one reducer."""

    def __init__(self, spark: SparkSession):
        self.spark, self.seconds = spark, []

    def _stages(self):
        sc = self.spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        gateway = sc._gateway
        none = gateway.new_array(gateway.jvm.double, 0)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, none, gateway.jvm.java.util.ArrayList())
        return [found.apply(i) for i in range(found.size())]

    def __enter__(self) -> ReducerTimes:
        self.before = max((s.stageId() for s in self._stages()), default=-1)
        return self

    def __exit__(self, kind, *_: object) -> None:
        if kind is not None:
            return
        read = [s for s in self._stages() if s.stageId() > self.before and s.shuffleReadRecords() > 0]
        if read:
            s = max(read, key=lambda s: (s.shuffleReadRecords(), s.stageId()))
            tasks = self.spark.sparkContext._jsc.sc().statusStore().taskList(s.stageId(), s.attemptId(), 1_000_000)
            times = [tasks.apply(i).duration() for i in range(tasks.size())]
            self.seconds = [t.get() / 1000 for t in times if t.isDefined()]

    def summary(self) -> dict:
        """The times and their coefficient of variation (population), 0 for none."""
        n = len(self.seconds)
        mean = sum(self.seconds) / n if n else 0.0
        cov = (sum((t - mean) ** 2 for t in self.seconds) / n) ** 0.5 / mean if mean else 0.0
        return {"seconds": self.seconds, "cov": cov}
