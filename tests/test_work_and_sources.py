import gzip
import json

from pyspark.sql import functions as F

from titrant.operators import work as K
from titrant.params import AtomParams
from titrant.operators import spatial as S
from titrant.sources import files, json_tables as J, sinks, structures as ST
from titrant.streaming import landing


def jobs(spark, rows):
    return spark.createDataFrame(rows, "key string, complex string, size int, beta double")


def test_largest_first(spark):
    df = jobs(spark, [("d", "x", 5, 0.0), ("a", "y", 9, 0.0), ("c", "z", 9, 0.0), ("b", "w", 1, 0.0)])
    assert [r.key for r in K.largest_first(df, "size", "key", 2).collect()] == ["a", "c", "b", "d"]


def test_spaced_sample_rounds_half_even_and_keeps_the_largest(spark):
    rows = [(f"k{i}{b}", f"c{i}", 10 * i, b) for i in range(6) for b in (-3.0, 0.0, 1.5)]
    got = K.spaced_sample(jobs(spark, rows), "complex", "size", "beta", "key", n=3, each=2).toPandas()
    assert sorted(set(got["complex"])) == ["c0", "c2", "c5"]  # 2.5 rounds to 2
    assert sorted(set(got["beta"])) == [0.0, 1.5]


def test_trailing_run_and_verdict(spark):
    rows = [("a", i, f) for i, f in enumerate([False, True, True, True, True])] + [("b", i, i % 5 != 0) for i in range(10)] + [("c", 0, True)]
    runs = K.trailing_failures(spark.createDataFrame(rows, "g string, o int, failed boolean"), ["g"], "o", "failed")
    got = {r.g: (r["trailing"], r.verdict) for r in K.stop_verdict(runs).collect()}
    assert got == {"a": (4, "stop: consecutive failures"), "b": (4, "stop: consecutive failures"), "c": (1, "continue")}


def test_waves_keep_leftovers(spark):
    df = jobs(spark, [("a", "x", 1, 0.0), ("b", "x", 1, 1.5000000001), ("c", "x", 1, 9.0)])
    assert {r.key: r.w for r in df.select("key", K.wave_of(F.col("beta"), [[0.0], [1.5]]).alias("w")).collect()} == {"a": 0, "b": 1, "c": 2}


def test_first_and_repeat_fall_back(spark):
    df = spark.createDataFrame([("a", 0, 4.0), ("b", 0, 6.0)], "c string, t int, w double")
    assert tuple(K.first_and_repeat(df, "c", ["t"], "w").first()) == (5.0, 5.0)


def atom_line(serial, name, res, chain, seq, x, record="ATOM", icode=" ", alt=" ", element="C"):
    return f"{record:<6}{serial:5d} {name:<4}{alt}{res:>3} {chain}{seq:4d}{icode}   {x:8.3f}{0:8.3f}{0:8.3f}{1:6.2f}{0:6.2f}          {element:>2}"


def test_models_and_gzip(spark, tmp_path):
    text = "\n".join(["HEADER", "MODEL        1", atom_line(1, "CA", "ALA", "A", -5, 1.0), "ENDMDL", "MODEL        2", atom_line(1, "CA", "ALA", "A", -5, 2.0, icode="B"), "ENDMDL", ""])
    (tmp_path / "1abc.pdb").write_text(text)
    with gzip.open(tmp_path / "2xyz.pdb.gz", "wt") as handle:
        handle.write(atom_line(1, "CA", "GLY", "B", 7, 3.0) + "\n")
    first = {r.file.split("/")[-1]: r for r in ST.read_atoms(spark, str(tmp_path)).collect()}
    assert (first["1abc.pdb"].x, first["1abc.pdb"].seqid) == (1.0, -5) and first["2xyz.pdb.gz"].chain == "B"
    second = ST.read_atoms(spark, str(tmp_path), AtomParams(model_index=1)).collect()
    assert [(r.x, r.icode) for r in second] == [(2.0, "B")]
    assert {r.stem for r in files.index(spark, str(tmp_path), (".pdb",)).collect()} == {"1ABC", "2XYZ"}


def test_chain_extraction_rules(spark, tmp_path):
    rows = [("ALA", 3, "ATOM"), ("MSE", 4, "HETATM"), ("HOH", 90, "HETATM"), ("SEP", 5, "HETATM"), ("XXX", 6, "ATOM"), ("LYS", 7, "ATOM")]
    (tmp_path / "a.pdb").write_text("\n".join(atom_line(i, "CA", res, "A", seq, i, record=rec) for i, (res, seq, rec) in enumerate(rows, 1)) + "\n")
    atoms = ST.read_atoms(spark, str(tmp_path / "a.pdb"))
    got = {r.resname: (r.aa, r.pos, r.problem) for r in ST.extract_chains(atoms, "file", "serial").collect()}
    assert got == {"ALA": ("A", 0, None), "MSE": ("M", 1, None), "HOH": (None, None, None), "SEP": (None, None, "charge-altering residue"),
                   "XXX": (None, None, "unknown residue"), "LYS": ("K", 2, None)}
    allowed = {r.resname: r.aa for r in ST.extract_chains(atoms, "file", "serial", allow_charge_altering=True).collect()}
    assert allowed["SEP"] == "S"
    audit = ST.chain_audit(ST.extract_chains(atoms, "file", "serial"), "file").first()
    assert (audit.n_residues, audit.n_substituted, audit.n_skipped, audit.n_problems, audit.substitutions) == (3, 1, 1, 2, "MSE>M")


def test_inventory_comparison(spark, tmp_path):
    left, right = tmp_path / "l", tmp_path / "r"
    left.mkdir(), right.mkdir()
    a, b = atom_line(1, "CA", "ALA", "A", 1, 1.0), atom_line(2, "CB", "ALA", "A", 1, 2.0)
    for folder, name, lines in ((left, "same", [a, b]), (right, "same", [a, b]), (left, "note", [a, b]), (right, "note", ["REMARK", a + "  ", b]),
                                (left, "swap", [a, b]), (right, "swap", [b, a]), (left, "lone", [a]), (right, "new", [a])):
        (folder / f"{name}.pdb").write_text("\n".join(lines) + "\n")
    got = {r.stem: r.status for r in files.compare(spark, str(left), str(right), files.stem).collect()}
    assert got == {"SAME": "identical", "NOTE": "same coordinates", "SWAP": "different", "LONE": "only left", "NEW": "only right"}


def test_drift_and_run_record(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name)
    recorded = spark.createDataFrame([tuple(r) for r in files.digests(spark, str(tmp_path)).collect()], "path string, sha256 string, bytes bigint")
    record = lambda: files.run_record(files.digests(spark, str(tmp_path)).repartition(3), {"b": 1, "a": 2}, {"seed": 0}).first()
    before = record()
    assert before == record() and list(json.loads(before.record)["parameters"]) == ["a", "b"]
    (tmp_path / "b").write_text("changed")
    (tmp_path / "c").unlink()
    got = {r.path[-1]: r.status for r in files.drift(recorded, files.digests(spark, str(tmp_path))).collect()}
    assert got == {"a": "ok", "b": "changed", "c": "missing"}
    assert record().run_hash != before.run_hash


def test_optional_input(spark, tmp_path):
    df, there = files.read_if_present(spark, str(tmp_path / "no.parquet"), "a int, b string")
    assert not there and df.count() == 0 and df.columns == ["a", "b"]


def test_unreadable_records_are_listed(spark, tmp_path):
    for job, text in (("one", '{"key": "one", "score": 0.5}'), ("two", '{"key": "two", bro')):
        (tmp_path / job).mkdir()
        (tmp_path / job / "metrics.json").write_text(text)
    good, bad = J.read_metrics(spark, str(tmp_path))
    assert [r.key for r in good.collect()] == ["one"]
    assert ["two" in r.file for r in bad.collect()] == [True]


def test_landing_counts_each_key_once_and_resumes(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    for step, (keys, left) in enumerate(((("a", "a"), {"b", "c"}), (("b", "a"), {"c"}))):
        (folder / f"{step}.json").write_text("\n".join(json.dumps({"key": k, "score": 1.0}) for k in keys))
        landing.collect_landed(spark, str(folder), out, mark)
        landed = spark.read.schema(J.METRICS).parquet(out)
        assert {r.key for r in landing.missing(expected, landed).collect()} == left
    assert landed.count() == 2


def test_element_of_blank_columns(spark, tmp_path):
    """Atom names as files hold them, with columns 77-78 blank or cut off: hydrogens do not pass."""
    names = {" HA ": "H", "HG11": "H", "1HB ": "H", " CA ": "C", "CA  ": "CA", "ZN  ": "ZN", " OXT": "O", "HO5'": "H", " D1 ": "D"}
    for i, tail in enumerate(("          " + "  ", "")):
        rows = [f"ATOM  {k + 1:5d} {name} ALA A{k + 1:4d}       1.000   2.000   3.000  1.00  0.00{tail}" for k, name in enumerate(names)]
        (tmp_path / f"{i}.pdb").write_text("\n".join(rows) + "\n")
        atoms = ST.read_atoms(spark, str(tmp_path / f"{i}.pdb"))
        assert [r.element for r in atoms.orderBy("serial").collect()] == list(names.values())
        assert {r.atom for r in S.heavy(atoms).collect()} == {n.strip() for n, e in names.items() if e != "H"}


def test_every_landed_record_has_an_account(spark, tmp_path):
    """Records in are records landed, repeated or unreadable, also when a batch runs once more."""
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    lines = [['{"key": "a", "score": 2.0}', '{"key": "a", "score": 1.0}', '{"key": "b", "score": 1.0}', '{"broken'], ['{"score": 3.0}', '{"key": "b", "score": 9.0}', '{"key": "c", "score": 1.0}']]
    for step, records in enumerate(lines):
        (folder / f"{step}.json").write_text("\n".join(records))
        landing.collect_landed(spark, str(folder), out, mark)
    want = (7, 3, 2, 2)
    assert tuple(landing.account(spark, out).first()) == want
    assert {(r.key, r.score) for r in landing.landed(spark, out).collect()} == {("a", 1.0), ("b", 1.0), ("c", 1.0)}
    bad = landing.unreadable(spark, out).collect()
    assert len(bad) == 2 and {r.file.rsplit("/", 1)[1] for r in bad} == {"0.json", "1.json"} and all(r.record for r in bad)
    # The last batch was written, and its end was not: it is done again.
    (tmp_path / "mark" / "commits" / "1").unlink()
    (tmp_path / "mark" / "commits" / ".1.crc").unlink(missing_ok=True)
    landing.collect_landed(spark, str(folder), out, mark)
    assert tuple(landing.account(spark, out).first()) == want and landing.landed(spark, out).count() == 3


def test_doses_overwrite_only_themselves(spark, tmp_path):
    path = str(tmp_path / "d")
    sinks.write_doses(spark.createDataFrame([(0.0, 1), (1.5, 1)], "beta double, v int"), path)
    sinks.write_doses(spark.createDataFrame([(1.5, 2)], "beta double, v int"), path)
    assert {r.beta: r.v for r in spark.read.parquet(path).collect()} == {0.0: 1, 1.5: 2}


def test_column_order(spark):
    df = spark.createDataFrame([(2, 1, 0), (1, 1, 0)], "z int, a int, key int")
    got = sinks.in_order(df, ["key", "absent"], ["z"])
    assert got.columns == ["key", "a", "z"] and [r.z for r in got.collect()] == [1, 2]


def test_missing_charge_falls_back(spark, tmp_path):
    body = {"source": "s", "proteins": [{"entry": "1ABC", "native_seq": "KK", "designs": [{"sequence": "KKD", "beta": 0.0}, {"sequence": "K", "beta": 1.5, "chain_net_charge": 0.25}]}]}
    (tmp_path / "x.json").write_text(json.dumps(body, indent=1))
    got = J.read_designs_export(spark, str(tmp_path / "x.json"), multi_line=True).orderBy("replicate").collect()
    assert [r.net_charge for r in got] == [1.0, 0.25]
