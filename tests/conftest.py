import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from srcgraph.session import local_session

    session = local_session("8", 4)
    # Tiny inputs: compiling plans costs more than running them. The SQL comparison keeps codegen on.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    return session


@pytest.fixture(scope="session")
def make_files(spark):
    """Files of one repository from a path -> text mapping."""
    from pyspark.sql import functions as F

    from srcgraph.sources.adapters import with_hash

    def build(sources: dict[str, str], repository: str = "demo", revision: str = "one"):
        rows = [(repository, revision, path, text) for path, text in sources.items()]
        frame = spark.createDataFrame(
            rows, "repository_id string, revision string, file_path string, content string"
        )
        return with_hash(frame.withColumn("content", F.col("content")))

    return build
