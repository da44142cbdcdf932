from types import SimpleNamespace

import pytest

from keyflow.llm.scratch import FREE, release, shared_dir


def test_a_cluster_has_no_local_folders():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf={}))
    assert shared_dir(SimpleNamespace(sparkContext=context, conf={"spark.checkpoint.dir": "hdfs://host/shared/"})) == "hdfs://host/shared"


def test_the_heap_that_is_free_is_given_back(spark):
    context = spark.sparkContext
    beans = context._jvm.java.lang.management.ManagementFactory
    options = beans.getPlatformMXBean(context._jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
    before = [options.getVMOption(name).getValue() for name in FREE]
    context._gateway.detach(context._jvm.java.nio.ByteBuffer.allocate(300 << 20))  # garbage
    release(spark)
    heap = beans.getMemoryMXBean().getHeapMemoryUsage()
    assert heap.getCommitted() < 1.5 * heap.getUsed()
    assert [options.getVMOption(name).getValue() for name in FREE] == before
