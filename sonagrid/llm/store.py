"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from contextlib import AbstractContextManager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from sonagrid.sources.shared import shared_folder


#: Partitions that one driver can keep track of in a shuffle.
MOST_PARTITIONS = 100_000
#: Bytes of input for a partition that is dealt by this library's own repartitions.
PARTITION_BYTES = 64 << 20


def partitions(spark: SparkSession, source: DataFrame | None = None) -> int:
    """The session's shuffle partitions, or more if ``source`` is so large, by its size as
    the optimizer knows it, that they would be over ``PARTITION_BYTES`` each."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if source is None:
        return least
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    unknown = int(spark.conf.get("spark.sql.defaultSizeInBytes", str((1 << 63) - 1)))
    return least if size >= unknown else max(least, min(MOST_PARTITIONS, -(-size // PARTITION_BYTES)))


def trim(spark: SparkSession) -> bool:
    """Gives back to the system what the driver's JVM has freed outside its heap: the C library
    keeps it, in arenas that the hundreds of threads of exchanges and broadcasts fill.
    False where the JVM has no such command."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # by the interface, as the server's own class is not open to callers
        kinds = [jvm.java.lang.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        takes, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        for k, x in enumerate((name, "systemTrimNativeHeap", array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0))):
            takes[k], given[k] = kinds[k], x
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", takes).invoke(server, given)
    except Py4JError:
        return False
    return True


class Scratch(AbstractContextManager):
    """Tables written once and read many times, removed at the end of the block."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def table(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def done(self, *names: str) -> None:
        """Removes tables that nothing reads any more, and lets Spark remove the files of
        shuffles that no plan needs: its cleaner learns of them when the driver collects its
        garbage, which a driver with memory to spare puts off. What that frees goes back to the
        system."""
        for name in names:
            self.drop(name)
        self.spark._jvm.System.gc()
        trim(self.spark)

    def __exit__(self, *_: object) -> None:
        self.drop()
