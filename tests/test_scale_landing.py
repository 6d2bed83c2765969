import os

from skyrisk.schemas import APPROACH
from skyrisk.sources import fixtures as FX
from skyrisk.sources import ingest as IN


def _row(i, epoch=1, name="a", miss=5.0):
    return (i, name, 20.0, 0.1, 0.2, "2000-01-01", "2000-Jan-01 00:00", epoch, 10.0, miss, "Earth", False, False, "u")


def test_landed_documents_are_compressed(spark, tmp_dir):
    rows = spark.createDataFrame([_row(1), _row(2, 9, None)], APPROACH)
    FX.land_feed(rows, os.path.join(tmp_dir, "landing"))
    files = [f for f in os.listdir(os.path.join(tmp_dir, "landing")) if f.startswith("part")]
    assert files and all(f.endswith(".gz") for f in files)
    assert sorted(IN.flatten_feed(IN.read_feed(spark, os.path.join(tmp_dir, "landing"))).collect()) == sorted(rows.collect())
