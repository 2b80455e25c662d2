"""A session of another folder, without the repository on its path, runs Python-backed operators."""

import os
import subprocess
import sys


def test_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""import sys; sys.path.insert(0, {root!r})
from quarry.session import get_spark
from quarry.operators import vectors as V
s = get_spark(master="local[2]", shuffle_partitions=2)
v = s.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
q = s.createDataFrame([(9, [1.0, 0.1])], "query_id long, embedding array<double>")
print("FOUND", V.knn(v, q, 1).first().vec_id)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND 1" in out.stdout, out.stderr[-2000:]
