import pytest

from rankloom.plans import blob_catalog, catalog, evidence_catalog, pair_catalog, parsing_catalog, patch_catalog, posting_catalog, profile_catalog, rule_catalog, tailoring_catalog  # noqa: F401

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    compare(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["job_id", "doc_id", "matches", "query_terms", "coverage", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
