"""Row identity, range borders and chat records where they used to lose something."""

import pytest
from pyspark.sql import functions as F

from citeflow.operators import audit, dedup, numbering
from citeflow.sources import readers


def test_microseconds_and_zeros(spark):
    rows = spark.sql(
        """select 'k' as k, timestamp'2024-01-01 00:00:00.000001' + make_dt_interval(0, 0, 0, id * 0.000001) as ts,
                  array(0.0d, if(id % 2 = 0, 0.0d, -0.0d)) as a, named_struct('x', -0.0d) as s from range(4)"""
    )
    both = rows.unionByName(rows.withColumn("a", F.array(-F.lit(0.0), F.lit(0.0))).withColumn("s", F.struct(F.lit(0.0).alias("x"))))
    got = dedup.dedup_project(both, ["k"], row_id="id")
    assert got.count() == 4 and got.select("id").distinct().count() == 4
    assert audit.split_overlap(both.withColumn("split", F.lit("a")), ["ts"]).count() == 0


@pytest.mark.parametrize("rows, hot", [(3000, 2), (1000, 1000), (500, 30)])
def test_borders_grow_with_the_rows(spark, rows, hot):
    df = spark.range(rows).withColumn("k", F.concat(F.lit("x"), F.format_string("%06d", (F.col("id") * 7919) % rows)))
    got = numbering.number_by_value(df, F.col("k"), "n", hot_rows=hot).orderBy("k").collect()
    assert [r.n for r in got] == list(range(1, rows + 1))


def test_every_chat_record_is_checked(spark, tmp_path):
    path = tmp_path / "chat.json"
    path.write_text('{"messages": [{"role": "user", "content": "a"}]}\n{"other": 1}\n')
    with pytest.raises(KeyError):
        readers.read_chat(spark, str(path))
