"""What a job shuffles."""

from collections.abc import Callable

from pyspark.sql import SparkSession


def shuffled(spark: SparkSession, job: Callable[[], object]) -> int:
    """Bytes of shuffle that the job writes."""
    sc = spark.sparkContext

    def written() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        none = sc._gateway.new_array(sc._gateway.jvm.double, 0)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = written()
    job()
    return written() - before
