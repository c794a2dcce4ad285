import pytest

from strataspark.llm.decontamination import decontaminate
from strataspark.llm.license_scan import scan_licenses

FILL = "zig zag zug zag zog zug zig zag zog zig zug zag"


def test_decontamination(spark, empty, odd):
    items = spark.createDataFrame([(1, "If Anna buys 12 apples for 3 dollars and sells 12 of them to her friend Bob then how much is left"), (2, "short one"), (3, None), (4, "Seven tiny words stand here all alone")], "item_id long, text string")
    texts = {
        10: FILL + " If Anna buys 12 apples for 3 dollars and sells 12 of them to her friend Bob then how much is left " + FILL,
        11: FILL + " if Carla buys 40 apples for 7 dollars and sells 40 of them to her friend Dan then how much is left " + FILL,  # re-parameterised
        12: FILL + " if Carla buys 40 apples for 7 dollars and sells 41 of them to her friend Dan then how much is left " + FILL,  # 12 stands for 40 and 41
        13: FILL + " short one " + FILL,
        14: FILL + " seven tiny words stand here all alone " + FILL,
        15: FILL, 16: None, 17: "",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate(df, items).collect()}
    assert {(10, 1), (11, 1), (14, 4)} <= set(got) and not {k for k in got if k[0] in (13, 15, 16, 17)}
    # along an alignment with a slot of two values no window with slots counts
    assert (12, 1) not in got or got[12, 1]["n_slots"] == 0
    assert decontaminate(empty, items).collect() == [] and decontaminate(df, items.limit(0)).collect() == [] and decontaminate(odd, items).collect() == []
    plan = decontaminate(df, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_decontamination_of_slot_dense_items(spark):
    """Verbatim copies of items full of numbers or names are found, other values are not."""
    items = [(1, "12 + 34 + 56 + 78 + 90 + 11 + 13 + 15"), (2, "wie weit ist der Weg vom Haus zum Markt wenn die Frau mit dem Hund und dem Kind am Fluss den Berg vom Dorf zur Stadt nimmt"), (3, "add 4 and 5 or 6")]
    texts = {k: f"{FILL} {t} {FILL}" for k, t in items}
    texts |= {11: f"{FILL} 21 + 43 + 65 + 87 + 19 + 22 + 24 + 26 {FILL}", 13: f"{FILL} add 7 and 8 or 9 {FILL}", 14: FILL}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(k, k) for k, _ in items} and all(r["n_matched"] == r["n_windows"] for r in got.values())


def test_licenses(spark, empty, odd):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    texts = {1: f"{FILL} Licensed under CC BY-NC 4.0. {FILL}", 2: f"{FILL}\n{mit.upper()}\n{FILL}", 3: FILL, 4: "Released under the MIT License.", 5: None, 6: "", 7: f"{FILL} licensed under something else entirely {FILL}"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in scan_licenses(df).collect()}
    assert got == {(1, "CC-BY-NC-4.0"), (2, "MIT"), (4, "MIT")}
    assert scan_licenses(empty).collect() == [] and scan_licenses(odd).collect() == []
    with pytest.raises(ValueError):
        scan_licenses(df, spark.createDataFrame([(1, "x", "too short")], "template_id int, license string, text string"))
    own = scan_licenses(df, spark.createDataFrame([(1, "z", "zig zag zug zag zog zug")], "template_id int, license string, text string"))
    assert {r["doc_id"] for r in own.collect()} == {1, 2, 3, 7}


def test_notices_are_found_at_every_place(spark):
    """The bands' recall over all offsets of a five-word notice within the windows."""
    df = spark.createDataFrame([(k, " ".join(f"u{k}x{i}" for i in range(k % 40)) + " Licensed under CC BY-NC 4.0. " + " ".join(f"v{k}x{i}" for i in range(k % 17))) for k in range(400)], "doc_id long, text string")
    assert scan_licenses(df).count() >= 396
