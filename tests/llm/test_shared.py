"""The subpackage stands alone, and works where only Spark ships it."""

from __future__ import annotations

import os
import re
import subprocess
import sys
import textwrap

from tests.conftest import ROOT, SMALL


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "seqlake")):
        if "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert not re.search(r"seqlake\.llm|import llm|public_tokenizers", f.read()), n


def test_workers_need_no_copy(tmp_path):
    """Queries run from another folder, with the library on the driver's path alone."""
    code = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
        from seqlake.llm import queries
        for name in ("op7_langid", "op10_media"):
            assert queries.QUERIES[name](spark, {SMALL!r}).count() == 200, name
        print("fine")
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
