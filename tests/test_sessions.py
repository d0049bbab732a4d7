"""Enrichment of session items: rows, and how often the wide rows move."""

from shelflens.operators.sessions import enrich_items


def test_items_move_once_for_their_id(spark):
    items = spark.createDataFrame([("i1", 1), ("i2", 1), ("i3", 2)], "item_id string, session_id int")
    matches = spark.createDataFrame([("i1", 7, 0.9, "auto", True), ("i2", 8, 0.8, "auto", True), ("i3", 7, 0.7, "auto", False)],
                                    "item_id string, product_id int, score double, decision string, is_active boolean")
    catalog = spark.createDataFrame([(7, "s7", "n7", "b", None, 5)], "product_id int, external_sku string, name string, brand string, size_text string, own_price_minor int")
    evidence = spark.createDataFrame([("i1", "e2", "p2"), ("i1", "e1", "p1"), ("i1", None, "p0"), ("i2", None, "p3")],
                                     "item_id string, evidence_id string, storage_path string")
    sessions = spark.createDataFrame([(1, 11)], "session_id int, customer_id int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = enrich_items(items, matches, catalog, evidence, sessions)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.item_id: (r.product_id, r.has_product, r.evidence_id, r.evidence_path, r.customer_id) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {"i1": (7, True, "e1", "p1", 11), "i2": (8, False, None, None, 11), "i3": (None, False, None, None, None)}
    assert plan.count("Exchange hashpartitioning(") <= 7  # one more if items moved for products and then again for evidence


def test_only_items_meet_orders_and_review_flags_are_made_once(spark, small):
    """Matches, hints and evidence only join items, so lines alone make them; f5 lists its tasks in one pass."""
    import shelflens.plans.catalog  # noqa: F401 - registers the queries
    from shelflens.plans.registry import QUERIES
    for name, orders, lines in (("r13_review_badges", 1, 3), ("f5_review_tasks", 1, 3), ("n18_attention", 2, 3)):  # n18 also reads sessions
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [o_orderkey") <= orders, name
        assert plan.count("Relation [l_orderkey") <= lines, name


def test_an_item_is_in_every_task_list_it_belongs_to(spark):
    from shelflens.operators import review as rv
    flags = spark.createDataFrame([("a", True, True), ("b", False, True), ("c", False, False), ("d", None, None)],
                                  "item_id string, is_size_risk boolean, is_missing_own_price boolean")
    rows = rv.task_rows(flags, ["size_risk", "missing_own_price"]).select("item_id", "task").collect()
    assert sorted(map(tuple, rows)) == [("a", "missing_own_price"), ("a", "size_risk"), ("b", "missing_own_price")]
