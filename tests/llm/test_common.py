import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from quillspark.llm import exact
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert not spark.sparkContext.getConf().get("spark.checkpoint.dir")
docs = spark.createDataFrame([(i, "text %d" % (i % 3)) for i in range(9)], "doc_id long, text string")
assert sorted(r.keep_id for r in exact.dedup(docs).collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2]
"""


def test_without_a_shared_folder_named(tmp_path):
    """No defaults file names spark.checkpoint.dir, and Spark runs in one process: a folder of this machine serves."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=repo)], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": repo, "SPARK_CONF_DIR": str(tmp_path)})
    assert done.returncode == 0, done.stderr[-2000:]
