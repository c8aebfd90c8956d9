"""A spec of several tables: what is refused, and what its tables and ledgers hold."""

import pytest
from pyspark.sql import functions as F

from plumbline.plans import generate as g
from plumbline.plans import relational as r


def spec(**link):
    people = g.Spec("people", [g.Col("person", "str_id", "sequence", {"prefix": "P", "start": 10})], 300)
    parcels = g.Spec("parcels", [g.Col("parcel", "str_id", "sequence", {"prefix": "L"}), g.Col("n", "int", "uniform", {"low": 0, "high": 9}, g.Mess(missing=0.2))], 2000, duplicate_rate=0.1)
    return r.Relational("post", {"people": people, "parcels": parcels}, [r.Link("parcels", "people", "person", "owner", **link)])


def test_problems_are_all_told():
    assert spec().problems() == []
    bad = r.Relational("x", {"a": g.Spec("a", [g.Col("k", "int", "uniform", {"low": 2, "high": 1})], 5)}, [r.Link("a", "a", "k", "k", 0.7, "odd"), r.Link("a", "b", "k", "f"), r.Link("c", "a", "z", "f", drift=-1)])
    text = "; ".join(bad.problems())
    for part in ("a: k: low is above high", "a.k: k is no sequence of keys", "a.k: the link makes this column", "a.k: orphans is outside", "no such style as odd", "a.f: no table b", "c.f: no table c", "c.f: a has no column z", "c.f: drift is outside"):
        assert part in text
    assert r.Relational("x", {}).problems() == ["there are no tables"]
    with pytest.raises(ValueError):
        r.plan(None, bad)


@pytest.mark.parametrize("style", ["random", "near"])
def test_tables_and_ledgers_agree(spark, style):
    made = r.plan(spark, spec(orphans=0.2, style=style, drift=0.2))
    keys = {x.person for x in made.clean["people"].collect()}
    clean = {x.row_id: x.owner for x in made.clean["parcels"].collect()}
    dirty = {x.row_id: x for x in made.dirty["parcels"].collect()}
    ledger = {x.row_id: x for x in made.references.collect()}
    assert set(clean.values()) <= keys and len(clean) == 2000 and len(set(clean.values())) > 250
    assert 2100 < len(dirty) < 2300
    for i, x in dirty.items():
        true = clean[i if x.duplicate_of is None else x.duplicate_of]
        if i not in ledger:
            assert x.owner == true
            continue
        told = ledger[i]
        assert (told.child, told.fk, told.true_key, told.dirty) == ("parcels", "owner", true, x.owner) and x.owner != true
        assert (x.owner not in keys) if told.mess == "orphan" else (x.owner.strip().upper() == true)
        if told.mess == "orphan" and style == "near":
            assert sorted(x.owner) == sorted(true)
    orphans = sum(x.mess == "orphan" for x in ledger.values())
    assert orphans > 50 and sum(x.mess == "drift" for x in ledger.values()) > 200
    assert style == "near" or abs(orphans / len(dirty) - 0.2) < 0.04


def test_a_table_more_changes_no_other(spark):
    one, more = spec(orphans=0.1), spec(orphans=0.1)
    more.tables["claims"] = g.Spec("claims", [g.Col("claim", "str_id", "sequence", {"prefix": "C"})], 50)
    more.links.insert(0, r.Link("claims", "parcels", "parcel", "about"))
    a, b = (r.plan(spark, s).dirty["parcels"].select("row_id", "n", "owner") for s in (one, more))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    claims = r.plan(spark, more).clean["claims"]
    assert claims.count() == 50 and claims.where(F.col("about").isNull()).count() == 0


def test_rules_and_outcomes_are_part_of_a_spec(spark):
    from plumbline.plans.lint import lint_table

    columns = [g.Col("a", "date", "date_range", {"start": "2001-01-01", "days": 9}), g.Col("b", "date", "date_range", {"start": "1990-01-01", "days": 9}), g.Col("n", "int", "uniform", {"low": 0, "high": 5}), g.Col("x", "float", "uniform", {"low": 1.0, "high": 2.0})]
    good = g.Spec("s", columns, 500, rules=[g.Rule("date_after", "a", "b", days_from="n"), g.Rule("derived", "n", "x", factor=2.0)], outcomes=[g.Outcome("y", {"n": 2.0}, 0.0)])
    assert good.problems() == []
    rows = g.with_outcomes(g.clean_table(spark, good), good).collect()
    assert all((x.b - x.a).days == x.n and x.x == 2 * x.n for x in rows) and 0.3 < sum(x.y for x in rows) / 500 < 0.7
    told = {(x.level, x.code, x.subject) for x in lint_table(spark, good, "with outliers and duplicates").collect()}
    assert told == {("INFO", "prevalence", "y"), ("INFO", "overwritten distribution", "b"), ("INFO", "overwritten distribution", "x"), ("WARN", "asked and not declared", "outlier"), ("WARN", "asked and not declared", "duplicate")}
    late = g.Spec("s", columns, 500, rules=[g.Rule("date_after", "a", "b", days_from="n"), g.Rule("derived", "n", "n", factor=3.0)])
    assert ("WARN", "uncoupled days", "b") in {(x.level, x.code, x.subject) for x in lint_table(spark, late).collect()}
    bad = g.Spec("s", columns, 5, rules=[g.Rule("odd", "a", "b"), g.Rule("date_after", "a", "n"), g.Rule("derived", "z", "x"), g.Rule("date_after", "a", "b", 5, 2)], outcomes=[g.Outcome("a", {"b": 1.0})])
    text = "; ".join(bad.problems())
    for part in ("no such kind as odd", "n has to be date", "no column z", "least and most don't fit", "b is no number", "outcome a is a column already"):
        assert part in text
