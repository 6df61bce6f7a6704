"""What the plans must keep: pruned scans, pushed filters, no Python where built-ins do."""

import re

import pytest

from galley.plans import registry


def plan(spark, data, name):
    return registry.queries()[name](spark, data)._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("p2_found", {"id", "payload"}),
        ("q_d04_roles", {"id", "email_id", "order_index", "heading", "text", "links"}),
        ("q_g17_merged_hash", {"id", "email_id", "order_index", "heading", "text", "links", "content_hash"}),
        ("q_d15_urls", {"email_id", "links"}),
        ("q_r06_latest_by_section", {"id", "email_id", "email_section_id", "kind", "category"}),
    ],
)
def test_scans_read_only_what_is_used(spark, data, name, columns):
    read = re.findall(r"ReadSchema: struct<([^\n]*)>", plan(spark, data, name).split("== Physical Plan ==")[1])
    assert read
    for r in read:
        names = set(re.findall(r"(?:^|,)(\w+):", re.sub(r"<[^<>]*>", "", r)))
        assert names <= columns, names


def test_filters_reach_the_scan(spark, data):
    p = plan(spark, data, "q_r04_cascade")
    assert "PushedFilters: [IsNull(email_section_id)]" in p and "IsNotNull(email_section_id)" in p


@pytest.mark.parametrize("name", ["q_d04_roles", "q_g02_decision", "q_g05_units", "q_d10_links", "q_d19_shapes", "q_n02_hash", "q_n08_pack", "q_r08_latest", "q_o03_shown", "q_o04_warnings"])
def test_no_python(spark, data, name):
    p = plan(spark, data, name)
    assert not re.search(r"Python|Pandas|MapInArrow|CartesianProduct", p)


def test_texts_stay_out_of_the_window(spark, data):
    p = plan(spark, data, "q_d04_roles").split("== Physical Plan ==")[1]
    window = next(line for line in p.splitlines() if "Exchange hashpartitioning" in line)
    below = p[p.index(window) :]
    project = next(line for line in below.splitlines() if "Project [" in line)
    assert not re.search(r"[\[ ]text#\d+", project)


def test_latest_is_limited_per_group(spark, data):
    assert "WindowGroupLimit" in plan(spark, data, "q_r08_latest")
