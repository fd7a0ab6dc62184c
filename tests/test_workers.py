"""Workers get the package with the functions they run, not from a path of theirs."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from driftline import session
from driftline.operators.chunks import write_chunks
from driftline.session import new_folder
spark = session("workers", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
df = spark.range(100).selectExpr("id", "cast(id as string) AS name")
files = write_chunks(df, new_folder(spark, "chunks"), df.columns, 200)
print("ROWS", files.agg({{"row_count": "sum"}}).first()[0])
"""


def test_chunks_without_a_prepared_path(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {key: value for key, value in os.environ.items() if key != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True,
        timeout=300,
    )
    assert "ROWS 100" in done.stdout, done.stderr[-2000:]
