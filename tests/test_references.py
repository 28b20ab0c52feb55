from datetime import datetime as D

from figmill.operators import references as R

T = D(2026, 2, 3)


def test_orphans(spark):
    figs = spark.createDataFrame([
        (1, "PMC1", "img/fig1", "PMC1/img/fig1.jpg", T), (2, "pmc1", "FIG1.JPG", "IMG\\FIG1.jpg", T), (3, "1", "fig1.png", "./img//fig1.png", T),
        (4, "PMC2", None, None, T), (5, "PMC3", " ", "", T), (6, None, "x", "y", T), (7, "PMC9", "fig%201", "PMC9/img/fig%201.tif", None), (8, "PMC4", "gone.jpg", "gone.jpg", T),
        (9, "PMC1", "fig1", "other/fig1.jpg", T), (9, "PMC1", "fig1", "other/fig1.jpg", T), (10, "PMC5", "back.png", "back.png", T), (11, "PMC0001", "fig1", None, T),
    ], "row_no long, pmcid string, href string, file_path string, received_at timestamp_ntz").selectExpr("*", "'clash' as name", "1 as k", "0 as bucket", "false as covered")
    arts = spark.createDataFrame([
        (1, "PMC1", "DONE", "2026-01-01T00:00:00Z", T), (2, "PMC2", "REMOVED", "2026-01-03T00:00:00Z", T), (3, "PMC2", "DONE", "2026-01-02T00:00:00Z", T),
        (4, "PMC3", " removed", "2026-01-01T00:00:00Z", T), (5, "PMC3", "NEW", None, T), (6, "PMC4", None, None, T), (7, "PMC5", "NEW", None, T)], "row_no long, pmcid string, status string, updated_at string, received_at timestamp_ntz")
    files = spark.createDataFrame([
        (1, "PMC1", "img/fig1.jpg", None), (2, "PMC9", "img/fig 1.tif", None), (3, "PMC4", "gone.jpg", T), (4, "PMC5", "back.png", T), (5, "pmc 5", "Back.PNG", None), (6, None, "x", None), (7, "PMC1", None, None)],
        "file_no long, pmcid string, member_path string, deleted_at timestamp_ntz")
    got = sorted((r["ref_field"], r["row_no"]) for r in R.orphan_references(figs, arts, files).collect())
    assert got == sorted([("pmcid", 4), ("pmcid", 7), ("href", 3), ("file_path", 3), ("href", 8), ("file_path", 8), ("file_path", 9), ("file_path", 9), ("href", 11)])
    report = {(r["ref_field"], r["period"] is None): r["orphans"] for r in R.orphan_report(R.orphan_references(figs, arts, files)).collect()}
    assert report == {("pmcid", False): 1, ("pmcid", True): 1, ("href", False): 3, ("file_path", False): 4}
    empty = R.orphan_references(figs, arts.where("false"), files.where("false"))
    assert empty.where("ref_field = 'pmcid'").count() == 12 - 1
    assert R.orphan_references(figs.where("false"), arts, files).count() == 0


def test_hashed_keys_are_confirmed(spark):
    refs = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a"), ("s", None), ("s", "12"), ("s", "012"), ("s", "99999999999999999999")], "space string, name string")
    pars = spark.createDataFrame([("s", "a"), ("t", "b"), ("s", "12"), ("s", "11"), ("s", "13")], "space string, name string")
    got = sorted((r["space"], r["name"]) for r in R.orphan_keys(refs, pars).collect())
    assert got == [("s", "012"), ("s", "99999999999999999999"), ("s", "b"), ("t", "a")]
