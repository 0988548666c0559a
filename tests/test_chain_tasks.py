"""Chains are dealt over tasks; the panel they take is stored, so the line items are read once."""

from tidemark.plans import kernel_queries as kq

SF = "/root/testdata/sf0.001"


def test_chains_are_dealt_over_tasks(spark):
    found = kq.chains(spark, SF, 2, 1, 1)
    parts = found.rdd.mapPartitions(lambda rows: [len(list(rows))]).collect()
    assert len(parts) == kq.TASKS and sum(parts) > 2 and max(parts) <= 2


def test_line_items_are_not_read_again(spark):
    files = kq.monthly_panel(spark, SF).inputFiles()
    assert files and not any("lineitem" in f or "supplier" in f for f in files)
