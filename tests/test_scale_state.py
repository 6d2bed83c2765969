import os

from skyrisk.schemas import APPROACH
from skyrisk.streaming.new_ids import run_available, stream_new_ids


def _row(i, epoch=1, name="a", miss=5.0):
    return (i, name, 20.0, 0.1, 0.2, "2000-01-01", "2000-Jan-01 00:00", epoch, 10.0, miss, "Earth", False, False, "u")


def test_state_stream_has_no_python_step(spark, tmp_dir):
    inp, out, ck = (os.path.join(tmp_dir, x) for x in ("in", "out", "ck"))
    spark.createDataFrame([_row(1, 10), _row(1, None), _row(2, 5, "b", 1.0), _row(2, 5, None, 0.5), _row(None, 1)], APPROACH).repartition(3).write.parquet(f"{inp}/d1")
    found = stream_new_ids(spark.readStream.schema(APPROACH).parquet(f"{inp}/*"))
    assert "InPandas" not in found._jdf.queryExecution().analyzed().toString()
    run_available(found, out, ck)
    spark.createDataFrame([_row(1, 99), _row(3, 7), _row(None, 9)], APPROACH).write.parquet(f"{inp}/d2")
    run_available(found, out, ck)
    run_available(found, out, ck)  # nothing new
    got = sorted(((r.id, r.name, r.epoch_date_close_approach) for r in spark.read.parquet(f"{out}/batch=*").collect()), key=str)
    assert got == sorted([(1, "a", None), (2, None, 5), (3, "a", 7), (None, "a", 1)], key=str)
