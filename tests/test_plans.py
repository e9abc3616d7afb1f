"""Plans: generated code compiles, indexes are read by part, lookups are pushed down."""

import pytest

from testlattice.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["j7_d7_unmapped_reasons", "w8_f22_commented_reason", "w8_p10_commented_kinds", "w6_one_patch", "f1_p12_changed_classes", "j6_modified_known_tests", "p11_many_globs"])
def test_generated_code_compiles(spark, name):
    """Without the fallback to interpreted expressions, code that doesn't compile is an error."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert registry.queries()[name](spark, SF).count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_canonical_views_are_stored_once(spark):
    from testlattice.plans import views

    one, two = views.Views(spark, SF), views.Views(spark, SF)
    assert one.cov_method.inputFiles() == two.cov_method.inputFiles() and "Window" not in two.cov_method._jdf.queryExecution().executedPlan().toString()
    assert views.Views(spark, f"{SF}/").cov_class.count() == one.cov_class.count()
