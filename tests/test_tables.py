from lumora import plans
from lumora.operators import tables
from lumora.plans import creators
from lumora.plans.registry import Tables


def test_partitions_follow_rows(spark, monkeypatch):
    """Tasks of windows over creators hold about as many rows, however large the tables are, and results stay."""
    sf = "/root/testdata/sf0.001"
    names = ["grid_order_first_seen", "top_posts", "top_tags_first_seen", "reel_selection_quota"]
    want = {n: sorted(map(tuple, plans.QUERIES[n](spark, sf).collect())) for n in names}
    monkeypatch.setattr(tables, "ROWS", 300)
    n = -(-Tables(spark, sf).lineitem.count() // 300)
    assert creators.posts_by_creator(Tables(spark, sf)).rdd.getNumPartitions() == n > 4
    for name in names:
        assert sorted(map(tuple, plans.QUERIES[name](spark, sf).collect())) == want[name]
    small = spark.range(1000)
    assert tables.dealt(small, 1200, "id") is small and tables.dealt(small, 1201, "id").rdd.getNumPartitions() == 5
