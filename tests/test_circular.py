from recordspark.operators import validation


def test_long_chains_and_tails_are_not_circular(spark):
    edges = [(f"c{i}", f"c{i + 1}") for i in range(300)] + [("x", "y"), ("y", "x"), ("z", "z"), ("e", None)]
    edges += [(f"t{i}", f"t{i + 1}" if i < 299 else "x") for i in range(300)]
    found = validation.circular(spark.createDataFrame(edges, "n string, t string"), "n", "t")
    assert {r.node for r in found.collect()} == {"x", "y", "z"}
