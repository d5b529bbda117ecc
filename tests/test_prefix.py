import pandas as pd
import pytest

from rankloom.operators.prefix import running_totals


@pytest.mark.parametrize("partitions", [1, 6])
def test_running_totals(spark, partitions):
    rows = [("a" if i % 3 else None, i // 2, i, i % 5 if i % 7 else None, "x") for i in range(200)] + [("b", 1, 1000, 4, "x")]
    df = spark.createDataFrame(rows, "g string, o long, id long, v long, s string")
    got = running_totals(df, "g", ["o", "id"], "v", partitions=partitions).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "o", "id", "v", "s"]).sort_values(["o", "id"])
    pdf["v"] = pdf.v.fillna(0)
    want = (pdf.groupby("g", dropna=False).v.cumsum() - pdf.v).groupby(pdf.id).first().astype(int)
    assert got.set_index("id").before.to_dict() == want.to_dict()


def test_empty(spark):
    assert running_totals(spark.createDataFrame([], "g string, o long, v long"), "g", ["o"], "v").count() == 0
