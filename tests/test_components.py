from figmill.operators.components import label_components, with_box


def test_a_long_path_settles(spark):
    path = spark.createDataFrame([(f"{i:05d}", f"{i + 1:05d}") for i in range(700)], "a string, b string")
    assert {r["root"] for r in label_components(path).collect()} == {"00000"}


def test_the_box_of_a_panel_is_the_smallest(spark):
    boxes = spark.createDataFrame([("p::cls=1", (5, 2)), ("p::cls=1", (3, 9)), ("q::cls=0", (1, 1))], "panel string, box struct<x:int,y:int>")
    panels = spark.createDataFrame([("p::cls=1",), ("q",), ("r",)], "panel string")
    got = {r["panel"]: r["box"] and tuple(r["box"]) for r in with_box(panels, boxes).collect()}
    assert got == {"p::cls=1": (3, 9), "q": (1, 1), "r": None}
