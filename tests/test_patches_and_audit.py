"""Several patches of one row, and the limits of the stored tables on both sides."""

import pytest

from inkgrade.operators import writes


def test_several_patches_apply_in_order(spark):
    base = spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (3, "e", "f")], "id int, x string, y string")
    patches = spark.createDataFrame([
        (1, 2, ["x"], None, "no"), (1, 1, ["x", "y"], "early", "kept"), (1, 3, [], "no", "no"), (2, 1, None, "no", "no"),
        (2, 2, ["y"], "no", "late"), (9, 1, ["x"], "nobody", None)], "id int, at int, set_columns array<string>, x string, y string")
    out = writes.patch_rows(base, patches, "id", ["x", "y"], order="at").orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, None, "kept"), (2, "c", "late"), (3, "e", "f")]
    assert writes.patch_rows(base, patches, "id", ["x", "y"]).count() == 3
    assert sorted(map(tuple, writes.patch_rows(base, patches.limit(0), "id", ["x"]).collect()))[0] == (1, "a", "b")


@pytest.mark.parametrize("table,column,good,bad", [
    ("students", "login", "abc", "ab"), ("students", "login", "l" * 100, "l" * 101), ("students", "full_name", "abc", "ab"),
    ("students", "stage", "s" * 100, "s" * 101), ("tasks", "title", "abc", "ab"), ("teachers", "last_name", "Li", "L"),
    ("teachers", "position", "p" * 150, "p" * 151),
])
def test_limits_on_both_sides(spark, table, column, good, bad):
    rows = spark.createDataFrame([(1, good), (2, bad), (3, None)], f"id int, {column} string")
    found = {(r.rule, r.key) for r in writes.audit_constraints({table: rows}).collect() if r.rule.startswith("length")}
    assert found == {(f"length:{column}", "2")}


def test_addresses(spark):
    rows = spark.createDataFrame(list(enumerate(["a@b.org", "a.b+c@x-y.co.uk", "ab.org", "a@b", "a b@c.org", "a@b..org"])), "id int, email string")
    found = {r.key for r in writes.audit_constraints({"teachers": rows}).collect() if r.rule == "pattern:email"}
    assert found == {"2", "3", "4", "5"}
