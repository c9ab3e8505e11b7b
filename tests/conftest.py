import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("colweave-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate a function of columns ``a, b, ...`` over rows of text in one query."""

    def run(build, *rows):
        from pyspark.sql import functions as F

        names = "abcd"[: len(rows[0])]
        schema = "i int, " + ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        out = df.select("i", build(*[F.col(n) for n in names]).alias("out"))
        return [r["out"] for r in out.orderBy("i").collect()]

    return run


ATTRIBUTE = (
    "Apple ,Banana,Banana,Grapes,Apple ,Apple ,Orange,Orange,Apple ,Pineapple ,Grapes,Banana,Pear,Pear,Lemon"
).split(",")


@pytest.fixture(scope="session")
def sample(spark):
    """The rebuilt sample run: one dashboard column, five source columns."""
    source, dash = [], []
    for i, value in enumerate(ATTRIBUTE):
        rid = f"L{i + 1}"
        once = value if i == 3 else "1111"
        twice = value if i in (4, 7) else "0000"
        source.append((rid, once, twice, value, f"[{value}, zz]", f"{value}, zz"))
        dash.append((rid, value))
    names = ["Lifecycle", *[f"DBR_Att{i}" for i in range(1, 6)]]
    return spark.createDataFrame(source, names), spark.createDataFrame(dash, ["Lifecycle", "Att1"])
