"""What the driver calls, also where operators or what they need are missing."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(missing):
    code = f"import sys; sys.modules.update(dict.fromkeys({missing!r})); import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True, check=True)
    return set(done.stdout.split())


def test_other_queries_stay_without_operators():
    every, without = names([]), names(["tallgrass.llm.queries"])
    assert without == {x for x in every if not x.startswith("op") and x != "pipeline"} and len(without) > 100
    assert names(["zstandard"]) == without or names(["zstandard"]) == every
    assert names(["corpus_pipeline"]) == every - {"pipeline"}
