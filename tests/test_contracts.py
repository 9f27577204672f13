import pytest
from pyspark.sql import functions as F

from titrant.operators import pairing as P, validation as C
from titrant.sources import csv_tables, text_lines

HEADER = "pdb_id,designed_chain,fixed_chain,beta,replicate,sequence,net_charge_reported"
GOOD = {"pdb_id": "7KQ2", "designed_chain": "H", "fixed_chain": "L", "beta": "1.5", "replicate": "4", "sequence": "GWLDE", "net_charge_reported": "3.25"}
#: Cells that break the rule of their column, each in an otherwise good row.
BAD_CELLS = {
    "sequence": ["GWJDE", "", "GW*DE"],
    "beta": ["steep", "", "-inf"],
    "pdb_id": ["Q7K2", "7K", "7KQ2B", ""],
    "replicate": ["four", "-7", "2.25", "8.0"],
    "fixed_chain": ["HEAVY", ""],
    "net_charge_reported": ["none", ""],
    "designed_chain": ['"H,,L"', '"H,H"', "-"],
}
MALFORMED = [(",".join((GOOD | {column: cell}).values()), column) for column, cells in BAD_CELLS.items() for cell in cells]


def write(tmp_path, *rows, header=HEADER, name="designs.csv"):
    path = tmp_path / name
    path.write_text("\n".join([header, *rows]) + "\n")
    return str(path)


def test_every_malformed_row_is_reported_on_its_line(spark, tmp_path):
    path = write(tmp_path, *[row for row, _ in MALFORMED])
    parsed = C.parse_table(csv_tables.read_strict(spark, path, C.DESIGNS.names), C.DESIGNS, keep=["line"])
    got = {r.line: r.column_name for r in C.error_rows(parsed, "line").collect()}
    assert got == {i: column for i, (_, column) in enumerate(MALFORMED, start=2)}


def test_blank_lines_stay_and_count(spark, tmp_path):
    path = write(tmp_path, "7QXP,C,H,4.5,1,WEDGE,-3.5", "", "7qxp,\"C, G\",H,25e-1,+6,we dge,NA")
    rows = csv_tables.read_strict(spark, path, C.DESIGNS.names).orderBy("line").collect()
    assert [r.line for r in rows] == [2, 3, 4]
    assert rows[1].pdb_id == "" and rows[2].net_charge_reported == "NA"
    parsed = C.parse_table(csv_tables.read_strict(spark, path, C.DESIGNS.names), C.DESIGNS, keep=["line"])
    good = {r.line: r for r in parsed.collect()}[4]
    assert (good.pdb_id, good.designed_chain, good.beta, good.replicate, good.sequence) == ("7QXP", ["C", "G"], 2.5, 6, "WEDGE")
    with pytest.raises(ValueError, match="8 problem"):
        C.raise_on_errors(parsed, "line")


def test_report_shows_some_and_counts_all(spark, tmp_path):
    path = write(tmp_path, *[row for row, _ in MALFORMED])
    parsed = C.parse_table(csv_tables.read_strict(spark, path, C.DESIGNS.names), C.DESIGNS, keep=["line"])
    rows = C.error_report(parsed, "line", show=3).collect()
    assert len(rows) == 3 and {r.n_problems for r in rows} == {len(MALFORMED)}


def test_header_rules(spark, tmp_path):
    path = write(tmp_path, header="pdb_id,beta,beta ,designed_chain,fixed_chain,sequence,replicate,odd")
    got = {(r.kind, r.column_name) for r in csv_tables.header_problems(spark, path, C.DESIGNS).collect()}
    assert got == {("duplicate", "beta"), ("missing", "net_charge_reported"), ("unexpected", "odd")}
    relaxed = csv_tables.header_problems(spark, path, C.DESIGNS, allow_extra=True)
    assert "unexpected" not in {r.kind for r in relaxed.collect()}


def test_cells_bind_by_header_name(spark, tmp_path):
    path = write(tmp_path, '4,7KQ2,x,"H, I"', "5,7KQ3,y,H", header='replicate,"pdb_id",odd,designed_chain')
    rows = csv_tables.read_strict(spark, path, ["pdb_id", "designed_chain", "replicate", "beta"]).orderBy("line").collect()
    assert [tuple(r)[2:] for r in rows] == [("7KQ2", "H, I", "4", "", None), ("7KQ3", "H", "5", "", None)]


def test_rows_that_do_not_fit_the_header_are_reported(spark, tmp_path):
    good = ",".join(GOOD.values())
    path = write(tmp_path, good, good + ",more,cells", "7KQ2,H", good.replace("GWLDE", '"GWLDE'), "")
    rows = csv_tables.read_strict(spark, path, C.DESIGNS.names)
    got = {r.line: r.row_problem for r in rows.collect()}
    assert got == {2: None, 3: "9 cells under 7 columns", 4: "2 cells under 7 columns", 5: "quote left open", 6: None}
    parsed = C.parse_table(rows, C.DESIGNS, keep=["line"])
    whole = {(r.line, r.problem) for r in C.error_rows(parsed, "line").where("column_name = '(row)'").collect()}
    assert whole == {(3, got[3]), (4, got[4]), (5, got[5])}


def test_quoted_cells(spark, tmp_path):
    path = write(tmp_path, r'"a ""b""","c \"d\", e",,"' + "x" * 50_000 + '"', header="p,q,r,s")
    row = csv_tables.read_strict(spark, path, ["p", "q", "r", "s"]).first()
    assert (row.p, row.q, row.r, len(row.s), row.row_problem) == ('a "b"', 'c "d", e', "", 50_000, None)


def test_empty_file_has_no_header(spark, tmp_path):
    (tmp_path / "designs.csv").write_text("")
    got = [tuple(r)[1:] for r in csv_tables.header_problems(spark, str(tmp_path / "designs.csv"), C.DESIGNS).collect()]
    assert got == [("empty file", None)]


def test_line_numbers_survive_file_splits(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"row {i}\n" for i in range(1, 4001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = text_lines.numbered(spark, str(path))
        assert text_lines.lines(spark, str(path)).select("block").distinct().count() > 3
        assert rows.where(F.concat(F.lit("row "), F.col("line").cast("string")) != F.col("value")).count() == 0
        assert rows.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_id_list_order_and_limit(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("1abc  2def\n\n 3ghi\n")
    assert [r.id for r in text_lines.id_list(spark, str(tmp_path / "ids.txt")).orderBy("line", "place").collect()] == ["1ABC", "2DEF", "3GHI"]
    assert text_lines.id_list(spark, str(tmp_path / "ids.txt"), 2).count() == 2


def test_chain_lists(spark):
    df = spark.createDataFrame([("A, B",), ("A,,B",), ("A,A",), ("ABCDE",), ("-",)], "c string")
    cell = C.chain_list(F.col("c"))
    got = [tuple(r) for r in df.select(cell.value.alias("v"), cell.problem.alias("p")).collect()]
    assert got == [(["A", "B"], None), (None, "empty chain id"), (None, "repeated chain id"), (None, "not a chain id"), (None, "empty or placeholder")]


def test_table_rules(spark):
    d = spark.createDataFrame([("1A", "A", 0.0, ["A"], ["A"], "MK"), ("1A", "A", 0.0, ["A"], ["B"], "MKK"), ("2B", "A", 0.0, ["A"], ["B"], "M")],
                              "id string, chain string, beta double, designed array<string>, fixed array<string>, seq string")
    assert C.repeated_keys(d, ["id", "chain", "beta"]).first().n_rows == 2
    assert C.chain_overlap(d, "designed", "fixed").count() == 1
    assert [r.id for r in C.varying_length(d, ["id"], "seq").collect()] == ["1A"]
    t = spark.createDataFrame([("c1", "train"), ("c1", "test"), ("c2", "test")], "cluster string, split string")
    assert [r.cluster for r in C.leaking_clusters(t, "cluster", "split").collect()] == ["c1"]
    v = spark.createDataFrame([("k", "AA"), ("k", "AB"), ("j", "AA")], "k string, v string")
    assert {r.k: r.conflict for r in C.one_value_per_key(v, ["k"], "v").collect()} == {"k": True, "j": False}


def test_required_columns(spark):
    with pytest.raises(KeyError, match="needs column"):
        P.require_columns(spark.range(1), ["id", "beta"], "a table")


def test_cells_are_parsed_once(spark):
    """Rows without problems leave no row, and no filter before the explode repeats the parsing."""
    from pyspark.sql import functions as F

    from titrant.operators import validation

    spec = validation.TableSpec("t", (validation.ColumnSpec("a", validation.finite_float, "", ""), validation.ColumnSpec("b", validation.strict_int(0), "", "")))
    raw = spark.range(12).select(F.col("id").alias("line"), F.concat("id", F.when(F.col("id") > 9, "x").otherwise("")).alias("a"), (F.col("id") - 2).cast("string").alias("b"))
    rows = validation.error_rows(validation.parse_table(raw, spec, ["line"]), "line")
    assert sorted(map(tuple, rows.collect())) == [(0, 1, "b", "below 0"), (1, 1, "b", "below 0"), (10, 0, "a", "not a number"), (11, 0, "a", "not a number")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("not a number") == 1
