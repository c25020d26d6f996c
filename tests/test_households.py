"""Household links of groups of any size."""

from itertools import combinations

from cairn import queries
from cairn.operators import households


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_groups_are_told_by_their_least_persons(spark):
    """Groups of 1 to 12 persons with copies of their records and one without a person: those of 2 to 8 are linked, and of larger ones no row beyond the ninth person is shuffled."""
    groups = {f"SURNAME{n}": range(100 * n, 100 * n + n) for n in range(1, 13)}
    rows = [(p, f"{p} {g}", "s", f"{g}#{k}") for g, of in groups.items() for p in of for k in range(3)] + [(None, "0 SURNAME8", "s", "SURNAME8#0")]
    df = spark.createDataFrame(rows, "person long, display_name string, source string, uid string")
    e = households.edges(df.select("person", "display_name"), df.select("person", "source", "uid"))
    got = {(x.a, x.b, x.kind, x.weight) for x in e.collect()}
    want = {(a, b, f"kin:{g}", 2) for g, of in groups.items() if 2 <= len(of) <= 8 for a, b in combinations(of, 2)}
    want |= {(a, b, "co_mention", 1) for of in groups.values() if 2 <= len(of) <= 4 for a, b in combinations(of, 2)}
    assert got == want
    assert plan(e).count("WindowGroupLimit") == 3


def test_links_are_found_once_for_all_members(spark, sf):
    """The links were computed again for each use, from the parts on."""
    assert "parquet" not in plan(queries.household_members(spark, sf))
    links = spark.createDataFrame([(1, 2, "kin:X", 2), (1, 2, "co_mention", 1), (2, 3, "kin:Y", 2), (4, 5, "co_mention", 1)], "a long, b long, kind string, weight int")
    got = sorted(map(tuple, households.members(households.households(links), links).collect()))
    assert got == sorted(t for a, b, k in ((1, 2, "kin:X"), (2, 3, "kin:Y"), (1, 3, "household"), (4, 5, "co_mention")) for t in ((a, b, k), (b, a, k)))
