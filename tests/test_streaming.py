"""Alignments that arrive in two lots are each folded once."""

from stemloom.streaming.arrivals import arriving, fold_arrivals


def test_arrivals(spark, tmp_path):
    source, out, kept = (str(tmp_path / x) for x in ("in", "out", "kept"))
    (tmp_path / "in").mkdir()
    for lot in range(2):
        for k in range(2):
            (tmp_path / "in" / f"{lot}{k}.fasta").write_text(">a\nGGGAAAUCCC\n>b\nGGCAAAUGCC\n")
        query = fold_arrivals(arriving(spark, source), out, kept)
        assert query.awaitTermination(120) and query.exception() is None
        found = spark.read.parquet(out)
        assert found.count() == 2 * (lot + 1) and found.select("msa").distinct().count() == 2 * (lot + 1)
    assert {len(r.structure) for r in found.collect()} == {10}
