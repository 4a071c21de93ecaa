"""What the driver's JVM keeps beside its heap."""

import re
from pathlib import Path

import pytest

from closura.llm.common import tidy


def test_tidy_gives_back_what_the_jvm_freed(spark):
    jvm = spark.sparkContext._jvm
    if not re.match(r"(17\.0\.(9|[1-9]\d)|1[89]|[2-9]\d)", jvm.System.getProperty("java.version")):
        pytest.skip("this Java has no command for it")
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024
    tidy(spark)
    packers = [jvm.java.util.zip.Deflater() for _ in range(600)]  # some 260 KB each, beside the heap
    for x in packers:
        x.setInput(bytes(range(256)) * 40)
        x.finish()
        x.deflate(bytearray(9000))
    for i, x in enumerate(packers):
        if i % 10:
            x.end()
    jvm.System.gc()
    jvm.System.gc()
    before = held()
    tidy(spark)
    after = held()
    for x in packers[::10]:
        x.end()
    assert before - after > 30, (before, after)
