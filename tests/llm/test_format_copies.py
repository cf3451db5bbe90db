from marlstone.llm import format_copies as fc

SCHEMA = "parsed_id bigint, raw_text string, part int, value string"


def pairs(spark, texts):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts, 1)]
    return {tuple(r) for r in fc.copy_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}


HEAD = "[PAGE 1]\nRuling on jute mats\nRef: AB/1/2020\nDate: 1.2.2020\nTo: Someone\nThe duty is 5 percent. All else follows."


def test_case_space_and_punctuation(spark):
    assert pairs(spark, ["The duty, is five", "THE  DUTY\r\nis-five!", "the duty is six"]) == {(1, 2)}


def test_order_of_labelled_lines(spark):
    moved = "[PAGE 1]\nruling on jute mats\n• To: Someone\n\n- ref: AB/1/2020\nDate : 1.2.2020\nThe duty is 5 percent; all else\nfollows"
    swapped_values = HEAD.replace("Ref: AB/1/2020\nDate: 1.2.2020", "Ref: 1.2.2020\nDate: AB/1/2020")
    swapped_body = HEAD.replace("The duty is 5 percent. All else follows.", "All else follows. The duty is 5 percent.")
    assert pairs(spark, [HEAD, moved, swapped_values, swapped_body]) == {(1, 2)}


def test_header_over_a_page_break(spark):
    a = "[PAGE 1]\nTitle\nRef: 1\nDate: 2\n[PAGE 2]\nTo: x\nBody"
    b = "[PAGE 1]\nTitle\nTo: x\nRef: 1\n[PAGE 2]\nDate: 2\nBody"
    assert pairs(spark, [a, b]) == {(1, 2)}


def test_cells_of_one_row(spark):
    a = "[SHEET: s]\n[ROW 1] Goods: mats | Code: 12 | Rate: 5%\n[ROW 2] Goods: caps | Code: 13"
    b = "[SHEET: S]\n[ROW 1] Rate: 5 % | goods: mats | Code: 12\n[ROW 2] Code: 13 | Goods: caps"
    other_row = "[SHEET: s]\n[ROW 1] Goods: caps | Code: 13\n[ROW 2] Goods: mats | Code: 12 | Rate: 5%"
    assert pairs(spark, [a, b, other_row]) == {(1, 2)}


def test_labelled_lines_inside_the_text_keep_their_order(spark):
    a = "An order was made.\nPort: Kandla\nDuty: five\nIt holds."
    b = "An order was made.\nDuty: five\nPort: Kandla\nIt holds."
    titled = "An order on mats\nPort: Kandla\nDuty: five\nIt holds."
    titled_moved = "An order on mats\nDuty: five\nPort: Kandla\nIt holds."
    assert pairs(spark, [a, b, titled, titled_moved]) == {(3, 4)}


def test_long_labels(spark):
    label = "The number under which the goods were first entered"
    a, b = f"{label}: 12\nPort: Kandla\nBody", f"Port: Kandla\n{label}: 12\nBody"
    assert len(label) > 45 and pairs(spark, [a, b]) == {(1, 2)}


def test_nulls_empty_repeats_and_clashes(spark):
    rows = [(1, None, 0, ""), (2, None, 0, ""), (3, "", 0, ""), (4, " .,\n", 0, ""), (None, "a", 0, ""), (5, "a", 0, ""), (5, "a", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in fc.copy_pairs(df).collect()} == {(3, 4)}
    assert {tuple(r) for r in fc.collapse(df).collect()} == {(3, 2), (5, 1)}
    assert fc.copy_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_group_and_long_text(spark):
    long = "word " * 50_000
    got = pairs(spark, [long] + [long.upper()] * 200 + ["other"])
    assert got == {(1, i) for i in range(2, 202)}
