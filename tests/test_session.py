"""Session policy: the checkpoint folder comes from the session once set, and
shipping the package to workers happens once."""

from assay.session import ensure_checkpoint_dir, scratch_dir, ship_package


def test_checkpoint_dir_is_stable(spark):
    a = ensure_checkpoint_dir(spark)
    assert a and ensure_checkpoint_dir(spark) == a
    assert scratch_dir(spark, "x").startswith(a.rstrip("/"))


def test_ship_package_once(spark):
    ship_package(spark)
    ship_package(spark)
    assert getattr(spark.sparkContext, "_assay_shipped", False)
