"""Column checks by hand-written expectations."""
from ripplekit.operators.filters import column_report


def test_column_report(spark):
    full = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id long, note string")
    holes = spark.createDataFrame([(1, 5), (None, 6)], "id long, size int")
    got = column_report({"full": full, "holes": holes, "none": holes.limit(0)}, ["id", "size"], ["note"])
    rows = {(r.source, r.column): (r.n_rows, r.required, r.present, r.n_filled, r.ok) for r in got.collect()}
    assert rows == {
        ("full", "id"): (3, True, True, 3, True), ("full", "size"): (3, True, False, 0, False),
        ("full", "note"): (3, False, True, 1, True),
        ("holes", "id"): (2, True, True, 1, False), ("holes", "size"): (2, True, True, 2, True),
        ("holes", "note"): (2, False, False, 0, True),
        ("none", "id"): (0, True, True, 0, True), ("none", "size"): (0, True, True, 0, True),
        ("none", "note"): (0, False, False, 0, True)}
