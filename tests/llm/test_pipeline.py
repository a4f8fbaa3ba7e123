"""The corpus pipeline on a small corpus whose fate is known, and each stage against its operator."""

import zlib

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    text = lambda k: " ".join(f"{zlib.crc32(f'{k} {i}'.encode()):08x}" for i in range(60))
    rows = [(i, text(i)) for i in range(40)]
    rows += [(100, text(0)), (101, text(1) + " end"), (102, text(200) + " " + " ".join(f"b{i}" for i in range(12))), (103, text(300) + " password = abcdefgh12345"), (104, None), (105, ""), (None, text(400)), (107, text(500) + " scum vermin filth")]
    rows += [(200 + i, f"{text(600 + i)} scum vermin filth") for i in range(90)] + [(300 + i, text(700 + i)) for i in range(90)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(200 + i, 1, 1) for i in range(90)] + [(300 + i, 1, 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(rows)


def test_stages_take_effect(spark, tmp_path):
    texts = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), COLUMNS)
        assert docs.columns == before, name
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    toxic = {i for i in texts if i is not None and 200 <= i < 300}
    assert 107 not in seen["toxicity"] and not toxic & set(seen["toxicity"]) and set(range(40)) | {100, 104, 105, None} <= set(seen["toxicity"])
    assert not {100, 101} & set(seen["near_duplicates"]) and set(range(40)) | {None, 104, 105} <= set(seen["near_duplicates"])
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {102}
    assert set(seen["secret_scan"]) == set(seen["decontamination"]) and seen["secret_scan"][103].endswith("[assign]")
    assert all(seen["secret_scan"][i] == t for i, t in seen["decontamination"].items() if i != 103)
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in seen["secret_scan"].items()}
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in pieces.items()} == want


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", COLUMNS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
