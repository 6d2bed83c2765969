"""The checkpoint folder stays the same across checkpoints (Spark nests a new sub-folder on every
setCheckpointDir call, so it must be set at most once)."""

from skyrisk.session import checkpoint_dir, cut_lineage, scratch_path


def test_checkpoint_dir_is_stable(spark):
    first = checkpoint_dir(spark)
    for _ in range(3):
        assert cut_lineage(spark.range(5)).count() == 5
    assert checkpoint_dir(spark) == first
    assert scratch_path(spark, "x").startswith(first)
