"""The command line and the tools that judge files, on small folders with results worked out by hand."""

import pytest

from stemloom.__main__ import main
from stemloom.functions import structures as st
from stemloom.operators import evaluation as ev
from stemloom.operators.folding import Model, explored, listed_pairs, pair_probabilities
from stemloom.operators.regions import Regions

TWO = ["cucacaacguuugugccucaguuacccguagauguagu", "ucgacaccacu---gccucgguuacccaucggugcagu"]
R = Regions(first=6, low=10, high=16, filler=2)


@pytest.fixture
def folders(tmp_path):
    data, predicted, tables = (tmp_path / x for x in ("data", "predicted", "tables"))
    for x in (data, predicted, tables):
        x.mkdir()
    return data, predicted, tables


def test_regions(spark, folders):
    data, predicted, _ = folders
    #            0123456789012345
    row = "GGGAAACCCCGGAAACCU"
    gold = "((............))"[:6] + ".." + "....))"
    assert len(gold) == 14
    structure = "((............))" + ".."
    for name in ("k_1_0", "k_10_0", "k_10_1"):
        (data / f"{name}.fasta").write_text(f">Wuhan x\n{row}\n>other\n{row}\n")
        (predicted / f"{name}.fasta.txt").write_text(f"energy\n{structure} (-1.0)\n" if name != "k_10_1" else "." * 18 + "\n")
    found = {r.file: r for r in ev.region_metrics(spark, str(data), str(predicted), gold, r=R).collect()}
    # (0, 15) is G-C and (1, 14) G-A: one pair of the two is kept, at 0 and 10 + 5
    assert [round(found["k_1_0.fasta"][c], 6) for c in ("precision", "sensitivity", "f1")] == [1, 0.5, round(2 / 3, 6)]
    assert found["k_1_0.fasta"].distance == 2 and found["k_10_1.fasta"].distance == 4 and found["k_10_1.fasta"].f1 == 0
    whole = {r.family: r for r in ev.region_summary(ev.region_metrics(spark, str(data), str(predicted), gold, r=R)).collect()}
    assert whole["k_1"].distance == 2 and whole["k_10"].distance == 3 and whole["k_10"].distance_most == 4
    assert [r.family for r in ev.region_summary(ev.region_metrics(spark, str(data), str(predicted), gold, r=R), leave_first=True).collect()] == ["k_10"]
    (data / "k_10_2.fasta").write_text(f">Wuhan\n{row}\n")
    assert ev.region_metrics(spark, str(data), str(predicted), gold, strict=False, r=R).count() == 3
    with pytest.raises(Exception, match="no prediction"):
        ev.region_metrics(spark, str(data), str(predicted), gold, r=R).collect()
    (predicted / "k_10_2.fasta.txt").write_text("(((\n")
    with pytest.raises(Exception, match="differ in length|stays open"):
        ev.region_metrics(spark, str(data), str(predicted), gold, r=R).collect()


def test_defects(spark, folders):
    data, predicted, _ = folders
    row = "GGGAAACCCCGGAAACCU"
    (data / "k_1_0.fasta").write_text(f">a\n{row}\n")
    (predicted / "k_1_0.fasta.txt").write_text("1 16 0.9\n1 16 0.5\n2 15 0.25\n3 17 0.125\n6 16 0.5\n\n....\n")
    gold = "(.......(....)"[:6] + ".." + ".....)"
    gold = "(....." + ".." + ".....)"
    found = ev.region_defects(spark, str(data), str(predicted), gold, r=R).first()
    # the first line is skipped; (2, 15) can't pair and (6, 16) is A-C; 3-17 is G-C but 17 is past the region's end
    pairs = {(0, 15): 0.5, (2, 16): 0.125}
    used = [k for p in pairs for k in p]
    free = [k for k in (*range(1, 6), *range(10, 15))]
    expected = 12 - 2 * 0.5 - sum(1 - sum(v for p, v in pairs.items() if k in p) for k in free)
    assert len(used) == 4 and abs(found.defect - round(expected, 2)) < 1e-9


def test_structures(spark, folders):
    data, predicted, tables = folders
    (data / "tRNA.x.fasta").write_text(">fam/a.ct\nGGG-AAACCC\n>fam/b.ct\nGGGAAAA-CC\n")
    (data / "23S.y.fasta").write_text(">fam/a.ct\nGGG-AAACCC\n")
    (predicted / "tRNA.x.fasta.txt").write_text("title\n(((....))) -1\n")
    (tables / "fam").mkdir()
    gold = {"a": "(((...)))", "b": "((.....))"}
    for name, text in gold.items():
        partner = dict(p for i, j in st.parsed(text)[0] for p in ((i, j), (j, i)))
        (tables / "fam" / f"{name}.ct").write_text("9 x\n" + "".join(f"{k + 1} N {k} {k + 2} {partner.get(k, -1) + 1} {k + 1}\n" for k in range(9)))
    rows = {r.name: r for r in ev.structure_metrics(spark, str(data), str(predicted), str(tables), consensus=True).collect()}
    assert rows["fam/a.ct"].distance == 0 and round(rows["fam/a.ct"].f1, 6) == 1
    expected = st.compared(gold["b"], st.projected("(((....)))", "GGGAAAA-CC"))
    assert rows["fam/b.ct"].distance == expected[3] and abs(rows["fam/b.ct"].f1 - expected[2]) < 1e-9
    one = ev.summary(ev.structure_metrics(spark, str(data), str(predicted), str(tables), consensus=True, slip=True)).first()
    assert one.family == "tRNA" and one.distance_least == 0
    (predicted / "tRNA.x.fasta.txt").write_text(gold["a"] + "\n" + gold["b"] + "\n")
    assert [r.distance for r in ev.structure_metrics(spark, str(data), str(predicted), str(tables)).collect()] == [0, 0]
    (tables / "fam" / "b.ct").unlink()
    with pytest.raises(Exception, match="no connection table"):
        ev.structure_metrics(spark, str(data), str(predicted), str(tables)).collect()


def test_folders_of_sequences(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"s{k}.seq").write_text(f"; entry {k}\nname\n{'ACGU' * (k + 48)}11\n")
    found = ev.sequence_sets(spark, str(tmp_path), 2, 3, "SRP").collect()
    assert len(found) == 6 and all(len(r.text) >= 200 and r.name.endswith(".ct") for r in found)
    (tmp_path / "f.a.fasta").write_text(">x\nACGU\n>y\nACG-\n")
    row = ev.alignment_summary(spark, str(tmp_path / "f.a.fasta")).first()
    assert (row.family, row.identity, row.length) == ("f", 75.0, 3.5)


def test_command_line(spark, tmp_path, capsys):
    p = tmp_path / "two.fasta"
    p.write_text("".join(f">s{k}\n{t}\n" for k, t in enumerate(TWO)))
    main(["fold", "-v", str(p)], spark)
    assert "Minimum Free Energy" in (said := capsys.readouterr().out) and "states reached" in said and "beam=100" in said
    main(["fold", "-p", "-g", "0", "-B", str(tmp_path / "b"), "-M", str(tmp_path / "m"), "-C", str(tmp_path / "c"), str(p)], spark)
    said = capsys.readouterr().out
    assert "ThreshKnot" in said and "pmcc" in said
    assert spark.read.text(str(tmp_path / "b")).count() > 10
    assert any("pmcc" in r.value for r in spark.read.text(str(tmp_path / "c")).collect())
    main(["fold", "-s", "4", "--seed", "3", str(p)], spark)
    assert sum(len(x) == 38 for x in capsys.readouterr().out.splitlines()) == 4
    with pytest.raises(SystemExit):
        main(["fold", "-e", "1", str(p)], spark)


def test_one_sweep_and_lazy_sums(spark):
    msa = spark.createDataFrame([(0, k, t) for k, t in enumerate(TWO)], "msa int, seq int, text string")
    found = explored(msa, Model(), count=3).persist()
    whole = {(r.i, r.j): r.prob for r in listed_pairs(found).collect()}
    assert len(found.first().samples) == 3 and found.first().mea
    lazy = {(r.i, r.j): r.prob for r in pair_probabilities(msa, Model(lazy=True)).collect()}
    kept = {(r.i, r.j): r.prob for r in pair_probabilities(msa, Model(floor=None)).collect()}
    for other, least in ((lazy, 5e-3), (kept, 1e-6)):
        assert max(abs(whole.get(k, 0) - other.get(k, 0)) for k in whole | other) < least
